"""Comparison of token sequences: shortest edit scripts, moves, residual changes and summaries.

Scripts come from an Arrow-batched function, by bit rows of a table of common subsequences; everything after it is native.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STEP = pa.struct([("op", pa.string()), ("token", pa.string()), ("a", pa.int32()), ("b", pa.int32())])
#: One round of so many is kept.
_STRIDE = 128
#: Pairs compared together, at most so many and, but for a single one, of so many tokens; rounds kept of them in bytes.
_PAIRS, _TOKENS, _HISTORY = 64, 1 << 18, 1 << 26
#: Places of a token are held as bits if they are one in so many of all, or the other text is no longer than the second; else the bits are made each time.
_RARE, _SHORT = 1 << 10, 1 << 14
#: Characters of a partition at most, but for a single pair.
_CHARS = 1 << 22
_OPS = ["keep", "delete", "insert"]


def _round(a: np.ndarray, b: np.ndarray, before: np.ndarray | None, d: int) -> np.ndarray:
    """The furthest places in a after d edits on diagonals -d, -d + 2 .. d; a and b end with marks that equal nothing."""
    n, m = len(a) - 1, len(b) - 1
    if before is None:
        x = np.zeros(1, dtype=np.int32)
    else:
        x = np.empty(d + 1, dtype=np.int32)
        x[0], x[d] = before[0], before[-1] + 1
        x[1:d] = np.where(before[:-1] < before[1:], before[1:], before[:-1] + 1)
    y = x - np.arange(-d, d + 1, 2, dtype=np.int32)
    at = np.arange(d + 1)
    while len(at):
        at = at[a[np.minimum(x[at], n)] == b[np.minimum(y[at], m)]]
        x[at] += 1
        y[at] += 1
    return x


def edit_script(a: list[str], b: list[str], limit: int | None = None) -> list[tuple[str, str, int | None, int | None]] | None:
    """A shortest script of (op, token, place in a, place in b), op being keep, delete or insert.

    Of two ways to a diagonal the one that reaches further is taken, a deletion on ties. None if
    more than ``limit`` edits are needed. Of the furthest places one round in ``_STRIDE`` is kept,
    and the rounds between two are made again on the way back, so that long scripts stay small.
    """
    n, m = len(a), len(b)
    number: dict[str, int] = {}
    x = np.array([number.setdefault(t, len(number)) for t in a] + [-1], dtype=np.int32)
    y = np.array([number.setdefault(t, len(number)) for t in b] + [-2], dtype=np.int32)
    kept: list[np.ndarray] = []
    now = None
    for d in range(n + m + 1):
        if limit is not None and d > limit:
            return None
        now = _round(x, y, now, d)
        if d % _STRIDE == 0:
            kept.append(now)
        # The diagonal of both ends.
        if abs(n - m) <= d and (d + n - m) % 2 == 0 and now[(d + n - m) // 2] >= n:
            break

    def rounds(last: int) -> list[np.ndarray]:
        first = last // _STRIDE * _STRIDE
        out = [kept[first // _STRIDE]]
        for r in range(first + 1, last + 1):
            out.append(_round(x, y, out[-1], r))
        return out

    return _walk_back(a, b, d, rounds)


def _walk_back(a: list[str], b: list[str], edits: int, rounds: Callable[[int], list[np.ndarray]]) -> list[tuple[str, str, int | None, int | None]]:
    out: list[tuple[str, str, int | None, int | None]] = []
    x, y = len(a), len(b)
    ready: list[np.ndarray] = []
    for d in range(edits, -1, -1):
        k = x - y
        if d == 0:
            px, py = 0, 0
        else:
            ready = ready or rounds(d - 1)
            before, i = ready.pop(), (k + d) // 2
            inserted = k == -d or (k != d and before[i - 1] < before[i])
            px = int(before[i] if inserted else before[i - 1])
            py = px - (k + 1 if inserted else k - 1)
        # Kept tokens after the edit, from the end.
        stop_x, stop_y = (px, py) if d == 0 else (px, py + 1) if inserted else (px + 1, py)
        while x > stop_x and y > stop_y:
            x, y = x - 1, y - 1
            out.append(("keep", a[x], x, y))
        if d:
            out.append(("insert", b[py], None, py) if inserted else ("delete", a[px], px, None))
            x, y = px, py
    return out[::-1]


class _Places:
    """The places of each token of a text, as bits."""

    def __init__(self, tokens: list[int], wanted: set[int]) -> None:
        self.n = len(tokens)
        self.at: dict[int, list[int]] = {}
        for i, t in enumerate(tokens):
            if t in wanted:
                self.at.setdefault(t, []).append(i)
        self.held = {t: self._bits(p) for t, p in self.at.items() if self.n <= _SHORT or len(p) * _RARE > self.n}

    def _bits(self, places: list[int]) -> int:
        out = bytearray((self.n >> 3) + 1)
        for i in places:
            out[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(out, "little")

    def __getitem__(self, token: int) -> int:
        return self.held[token] if token in self.held else self._bits(self.at.get(token, []))


def _shared(n: int, b: list[int], rise: int, where: _Places) -> Iterator[tuple[int, int]]:
    """For each token of b: where the longest common subsequence grows by it, and where along a it grows, as bits by places in a, which has n tokens.

    Bit x of the first tells whether the token adds one to what the first x tokens of a share with b so far; bit x of the second is clear if token x of a does. ``rise`` is
    the second before the first of b.
    """
    full = (1 << n) - 1
    for t in b:
        meets = rise & where[t]
        total = rise + meets
        grown = total ^ rise ^ meets
        rise = (total | (rise - meets)) & full
        yield grown, rise


def edits_by_bits(a: list[str], b: list[str]) -> list[tuple[bool, int, int]]:
    """The edits of the script that ``edit_script`` gives, last first: (inserted, place in a, place in b).

    Reaching furthest, a deletion on ties, means on the way back: an insertion where one is on a shortest way, else a deletion, else the token is kept. Both are
    told by single bits of the table of common subsequences, made a row at a time for each token of b. Of long tables one row in so many is kept, and the rows between are made again.
    """
    number: dict[str, int] = {}
    x, y = ([number.setdefault(t, len(number)) for t in side] for side in (a, b))
    same = next((i for i, (s, t) in enumerate(zip(x, y, strict=False)) if s != t), min(len(x), len(y)))
    x, y = x[same:], y[same:]
    n, m = len(x), len(y)
    where = _Places(x, set(y))
    # Rows at every stride-th token, and those of one stride: least in sum where the stride is the root.
    stride = m + 1 if n * m <= 4 * _HISTORY else int(m**0.5) + 1
    first, starts = (1 << n) - 1, []
    rows: list[tuple[int, int]] = []
    for at in range(0, m, stride):
        starts.append(first)
        for row in _shared(n, y[at : at + stride], first, where):
            first = row[1]
            if stride > m:
                rows.append(row)
    out: list[tuple[bool, int, int]] = []
    i, k, low = n, m, 0 if stride > m else m
    while i and k:
        if k <= low or not rows:
            low = (k - 1) // stride * stride
            rows = list(_shared(n, y[low : low + stride], starts[low // stride], where))
        grown, rise = rows[k - 1 - low]
        if not grown >> i & 1:
            k -= 1
            out.append((True, same + i, same + k))
        elif rise >> (i - 1) & 1:
            i -= 1
            out.append((False, same + i, same + k))
        else:
            i, k = i - 1, k - 1
    out += [(True, same + i, same + j) for j in range(k - 1, -1, -1)]
    return out + [(False, same + j, same + k) for j in range(i - 1, -1, -1)]


def edits_together(pairs: list[tuple[list[str], list[str]]]) -> list[list[tuple[bool, int, int]] | None]:
    """For each pair the edits of the script that ``edit_script`` gives, last first: (inserted, place in a, place in b).

    All pairs make a round at once, as rows of one matrix of diagonals. None stands for pairs not ended when the rounds kept are too large.
    """
    number: dict[str, int] = {}
    ids = lambda side, mark: np.array([i for p in pairs for i in (*(number.setdefault(t, len(number)) for t in p[side]), mark)], dtype=np.int32)
    a, b = ids(0, -1), ids(1, -2)
    n, m = (np.array([len(p[side]) for p in pairs], dtype=np.int64) for side in (0, 1))
    a0, b0 = np.cumsum(n + 1) - n - 1, np.cumsum(m + 1) - m - 1
    live, ends = np.arange(len(pairs)), np.full(len(pairs), -1)
    rounds: list[tuple[np.ndarray, np.ndarray]] = []
    x = np.zeros((len(pairs), 0), dtype=np.int32)
    d = size = 0
    while len(live) and size <= _HISTORY:
        now = np.zeros((len(live), d + 1), dtype=np.int32)
        if d:
            now[:, 0], now[:, d] = x[:, 0], x[:, -1] + 1
            now[:, 1:d] = np.where(x[:, :-1] < x[:, 1:], x[:, 1:], x[:, :-1] + 1)
        x = now
        px = x.reshape(-1)
        py = (x - np.arange(-d, d + 1, 2, dtype=np.int32)).reshape(-1)
        of = live.repeat(d + 1)
        at = np.arange(len(px))
        while len(at):
            i = of[at]
            at = at[a[a0[i] + np.minimum(px[at], n[i])] == b[b0[i] + np.minimum(py[at], m[i])]]
            px[at] += 1
            py[at] += 1
        rounds.append((live, x))
        size += x.nbytes
        # The diagonal of both ends.
        k = n[live] - m[live]
        ended = (np.abs(k) <= d) & ((d + k) % 2 == 0)
        ended &= x[np.arange(len(live)), np.clip((d + k) // 2, 0, d)] >= n[live]
        ends[live[ended]] = d
        if ended.any():
            live, x = live[~ended], x[~ended]
        d += 1
    return [_edits(i, int(n[i]), int(m[i]), int(ends[i]), rounds) if ends[i] >= 0 else None for i in range(len(pairs))]


def _edits(pair: int, x: int, y: int, edits: int, rounds: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[bool, int, int]]:
    out = []
    for d in range(edits, 0, -1):
        live, places = rounds[d - 1]
        before = places[np.searchsorted(live, pair)]
        k = x - y
        i = (k + d) // 2
        inserted = bool(k == -d or (k != d and before[i - 1] < before[i]))
        x = int(before[i] if inserted else before[i - 1])
        y = x - (k + 1 if inserted else k - 1)
        out.append((inserted, x, y))
    return out


def _steps(n: int, m: int, edits: list[tuple[bool, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(op, place in a, place in b) of all steps, -1 for none. Each step starts further from the origin than the one before."""
    e = np.array(edits, dtype=np.int64).reshape(-1, 3)
    come = e[:, 0] == 1
    kept_a, kept_b = np.delete(np.arange(n), e[~come, 1]), np.delete(np.arange(m), e[come, 2])
    start = np.concatenate([kept_a + kept_b, e[:, 1] + e[:, 2]])
    order = np.argsort(start)
    op = np.concatenate([np.zeros(len(kept_a), dtype=np.int64), np.where(come, 2, 1)])[order]
    a = np.concatenate([kept_a, np.where(come, -1, e[:, 1])])[order]
    b = np.concatenate([kept_b, np.where(come, e[:, 2], -1)])[order]
    return op, a, b


def _scripts(pairs: list[tuple[list[str], list[str]]]) -> pa.ListArray:
    """The scripts of pairs as lists of steps."""
    ops, tokens, places_a, places_b, sizes = [], [], [], [], [0]
    base = 0
    for a, b in pairs:
        # Long texts that hardly differ are done sooner by rounds of edits than by their table.
        few = edit_script(a, b, _STRIDE) if len(a) * len(b) > 4 * _HISTORY else None
        edits = edits_by_bits(a, b) if few is None else [(o == "insert", p, q) for o, p, q in _starts(few) if o != "keep"]
        op, x, y = _steps(len(a), len(b), edits)
        ops.append(op)
        places_a.append(x)
        places_b.append(y)
        tokens.append(base + np.where(op == 2, len(a) + y, x))
        sizes.append(len(op))
        base += len(a) + len(b)
    words = pa.array([t for p in pairs for side in p for t in side], pa.string())
    x, y = np.concatenate(places_a), np.concatenate(places_b)
    parts = [pa.array(_OPS).take(pa.array(np.concatenate(ops))), words.take(pa.array(np.concatenate(tokens))), pa.array(x.astype(np.int32), mask=x < 0), pa.array(y.astype(np.int32), mask=y < 0)]
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.StructArray.from_arrays(parts, fields=list(_STEP)))


def _starts(script: list[tuple[str, str, int | None, int | None]]) -> Iterator[tuple[str, int, int]]:
    x = y = 0
    for op, *_ in script:
        yield op, x, y
        x, y = x + (op != "insert"), y + (op != "delete")


def _groups(pairs: list[tuple[list[str], list[str]]]) -> Iterator[tuple[int, int]]:
    """Runs of pairs that are compared together."""
    start = size = 0
    for i, (a, b) in enumerate(pairs):
        if i > start and (i - start >= _PAIRS or size + len(a) + len(b) > _TOKENS):
            yield start, i
            start, size = i, 0
        size += len(a) + len(b)
    if pairs:
        yield start, len(pairs)


def edit_scripts(pairs: DataFrame, keys: list[str], left: str = "text_a", right: str = "text_b", by_line: bool = False) -> DataFrame:
    """(keys, pos, op, token, a, b): the script of every pair, one row a step.

    Pairs with equal texts are not compared; null is the empty text. Tokens are words, whatever the size of a pair, or lines with ``by_line``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = ([(t or "").split("\n") if by_line else (t or "").split() for t in batch.column(len(keys) + c).to_pylist()] for c in (0, 1))
            texts = list(zip(*sides, strict=True))
            for start, end in _groups(texts):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, end - start) for c in range(len(keys))), _scripts(texts[start:end])], [*keys, "script"])

    chosen = pairs.filter(F.coalesce(F.col(left), F.lit("")) != F.coalesce(F.col(right), F.lit(""))).select(*keys, left, right)
    # A pair costs far more to compare than to move, and long ones the most: dealt evenly whatever the files, by as many partitions as the texts need.
    chars = chosen.agg(F.sum(F.coalesce(F.length(left), F.lit(0)) + F.coalesce(F.length(right), F.lit(0)))).first()[0] or 0
    chosen = chosen.repartition(max(4 * pairs.sparkSession.sparkContext.defaultParallelism, -(-chars // _CHARS)), *keys)
    kinds = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)
    out = chosen.mapInArrow(run, f"{kinds}, script array<struct<op: string, token: string, a: int, b: int>>")
    return out.select(*keys, F.posexplode("script").alias("pos", "s")).select(*keys, "pos", "s.*")


def replayed(script: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, old, new, growth): both sides put together again from the steps, with blanks between tokens, and how many tokens more the new one has.

    A move takes one from the added and one from the removed, so growth is also what the summary's two differ by.
    """
    side = lambda gone, at: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("op") != gone, F.struct(at, "token")))), lambda s: s["token"]), " ")
    return script.groupBy(*keys).agg(side("insert", "a").alias("old"), side("delete", "b").alias("new"), (F.count_if(F.col("op") == "insert") - F.count_if(F.col("op") == "delete")).alias("growth"))


def _nth(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "token").orderBy(order)))


def moves(script: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, token, from, to): the n-th deletion of a token with its n-th insertion, if its place differs."""
    gone = _nth(script.filter("op = 'delete'"), keys, "a").select(*keys, "token", "nth", F.col("a").alias("from"))
    come = _nth(script.filter("op = 'insert'"), keys, "b").select(*keys, "token", "nth", F.col("b").alias("to"))
    return gone.join(come, [*keys, "token", "nth"]).filter(F.col("from") != F.col("to")).drop("nth")


def residual(script: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, op, token, place) of edits that are no moves: the first of a token's edits are its moves."""
    moved = moves(script, keys).groupBy(*keys, "token").agg(F.count("*").alias("n_moved"))
    edits = script.filter("op <> 'keep'").withColumn("place", F.coalesce("a", "b"))
    nth = F.row_number().over(Window.partitionBy(*keys, "op", "token").orderBy("place"))
    left = edits.withColumn("nth", nth).join(moved, [*keys, "token"], "left").filter(F.col("nth") > F.coalesce("n_moved", F.lit(0)))
    return left.select(*keys, "op", "token", "place")


def summary(script: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, added, removed, moved) of every pair with edits.

    The script is read once: the n-th deletion and insertion of a token are those of ``moves``, and what is left of a token's edits is ``residual``.
    """
    # Kept steps of a pair fold into one row before anything is moved; they only tell that it has a script.
    edited = F.col("op").isin("delete", "insert")
    steps = script.select(*keys, edited.alias("_edit"), F.when(edited, F.col("token")).alias("token"), F.when(F.col("op") == "delete", F.col("a")).alias("a"), F.when(F.col("op") == "insert", F.col("b")).alias("b"))
    gone, come = F.sort_array(F.collect_list("a")), F.sort_array(F.collect_list("b"))
    tokens = steps.groupBy(*keys, "_edit", "token").agg(gone.alias("_gone"), come.alias("_come"))
    far = F.zip_with("_gone", "_come", lambda a, b: F.coalesce(a != b, F.lit(False)))
    moved = F.when(F.col("token").isNotNull(), F.size(F.filter(far, lambda v: v))).otherwise(0)
    counts = tokens.select(*keys, F.size("_come").alias("_in"), F.size("_gone").alias("_out"), moved.alias("_moved"))
    total = lambda c: F.sum(c).cast("bigint")
    return counts.groupBy(*keys).agg(total(F.col("_in") - F.col("_moved")).alias("added"), total(F.col("_out") - F.col("_moved")).alias("removed"), total("_moved").alias("moved"))


def cumulative(summaries: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds the running total of all changes along a document's pages."""
    total = F.col("added") + F.col("removed") + F.col("moved")
    return summaries.withColumn("running", F.sum(total).over(Window.partitionBy(*keys).orderBy(order)))


def pixel_difference(a: DataFrame, b: DataFrame, keys: list[str], tolerance: int = 30) -> DataFrame:
    """(keys, n): pixels of which a channel differs by more than the tolerance, or that only one image has."""
    l, r = a.alias("l"), b.alias("r")  # noqa: E741
    at = [*keys, "x", "y"]
    joined = l.join(r, at, "full")
    far: Column = F.lit(False)
    for c in ("r", "g", "b"):
        far = far | (F.abs(F.col(f"l.{c}") - F.col(f"r.{c}")) > tolerance)
    alone = F.col("l.r").isNull() | F.col("r.r").isNull()
    return joined.groupBy(*keys).agg(F.count_if(alone | far).alias("n"))


def compare_documents(pages_a: DataFrame, pages_b: DataFrame, key: str) -> DataFrame:
    """(key, page_no, added, removed, moved, running) of two versions of documents, page by page.

    Documents with equal digests of all their pages are left out before any page is read again;
    pages that only one version has are not compared.
    """
    digest = lambda p: p.groupBy(key).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("page_no", F.sha2("text", 256).alias("t"))))), 256).alias("d"))
    a, b = digest(pages_a), digest(pages_b).withColumnRenamed("d", "e")
    differ = a.join(b, key).filter(F.col("d") != F.col("e")).select(key)
    pairs = pages_a.select(key, "page_no", F.col("text").alias("text_a")).join(pages_b.select(key, "page_no", F.col("text").alias("text_b")), [key, "page_no"])
    pairs = pairs.join(differ, key, "left_semi")
    found = summary(edit_scripts(pairs, [key, "page_no"]), [key, "page_no"])
    return cumulative(found, [key], "page_no")
