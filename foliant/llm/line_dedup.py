"""Line dedup: of every group of equal or nearly equal lines one occurrence stays.

Lines are normalised (words of ASCII letters, digits and everything beyond ASCII, lower-cased,
joined by single spaces). Equal normalised lines are one node. Lines meet by MinHash over
their words: ``TABLES`` keys of ``ROWS`` minima each, short words being picked less often, as
they tell lines apart less; lines of one equal key are candidates if their lengths let them
pass. Of two lines that share a part s of their words, 1 - (1 - s ** ROWS) ** TABLES meet:
nearly all where one word in ten was changed, nine tenths where two in ten were. Edits inside
most of the words may pass the threshold and yet leave too few words to meet. Candidates
are verified by edit similarity, 1 - distance / length of the longer, over the normalised
characters. Connected groups keep their first occurrence, by doc_id and line number; the
other lines are removed and the text is put together again.

Lines of fewer than ``MIN_WORDS`` words (headings, list marks, blank lines) are never
removed. A group of copies costs as many tests as it has lines (see ``components``).

Defined cases: a null text stays null and has no lines; an empty text has one empty line,
which stays; rows with the same doc_id and text are one document and are cut alike; null
doc_ids come last in the order of occurrences; lines equal but for case and punctuation are
copies; a very long text costs as many rows as it has lines, and a very long line a comparison that grows
with the square of its length where no short script of words settles it; an empty table gives an
empty result; extra columns of any name pass through ``line_dedup``, but ``_n_lines`` and ``_removed``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import edits
from foliant.llm import text as X
from foliant.llm.columns import Apart
from foliant.llm.components import id_filter, join_counted, link_groups, shared_keys
from foliant.llm.scratch import Scratch, tidy
from foliant.operators.diff import edit_script

MIN_WORDS = 5
#: Edit similarity in hundredths.
SIMILARITY = 80
#: Keys of a line, two to a column. Key i hashes five of the 30 minima of the line's words; every
#: minimum serves two keys, and no two keys have more than one in common.
TABLES = 12
_MEMBERS = [(i, (i - 1) % TABLES, TABLES + i, TABLES + (i - 3) % TABLES, 2 * TABLES + i % (TABLES // 2)) for i in range(TABLES)]
#: Words of at most so many bytes are picked less often, by so many powers of two.
SHORT_WORD = 3
SHORT_SHIFT = 4
#: Lines of more characters are compared one by one, after a script of at most so many edits of words.
LONG_LINE = 3000
WORD_EDITS = 24
_MINIMA = (X.mix(np.arange(1, 5 * TABLES // 2 + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_KEYS = [f"k{i}" for i in range(TABLES // 2)]


def _lanes() -> np.ndarray:
    """For a byte, eight lanes of one byte each, holding its bits."""
    bits = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint8)
    return np.ascontiguousarray(bits).view(np.uint64).ravel()


_LANES = _lanes()


def simhashes(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Signs of the bitwise sums of h[bounds[i]:bounds[i+1]], as 64-bit numbers; an even split gives 0.

    Not on the query's path, as two of its tables meet too few near copies.
    """
    n = len(bounds) - 1
    out = np.zeros(n, dtype=np.uint64)
    if len(h) == 0:
        return out
    sizes = np.diff(bounds)
    # Lanes hold 255 at most: longer lines are added up in pieces.
    pieces = np.maximum(-(-sizes // 255), 1)
    owner = np.repeat(np.arange(n), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = bounds[:-1][owner] + 255 * nth
    full = sizes[owner] > 0
    for byte in range(8):
        lanes = _LANES[((h >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.intp)]
        sums = np.zeros(len(owner), dtype=np.uint64)
        sums[full] = np.add.reduceat(lanes, starts[full]) if full.any() else 0
        counts = np.zeros((n, 8), dtype=np.int64)
        parts = sums.view(np.uint8).reshape(-1, 8)
        if len(owner) == n:
            counts += parts
        else:
            np.add.at(counts, owner, parts)
        ones = (2 * counts > sizes[:, None]).astype(np.uint64)
        out |= (ones << np.arange(8, dtype=np.uint64)).sum(axis=1).astype(np.uint64) << np.uint64(8 * byte)
    return out


def _line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text and number of every line, empty ones too, in order."""
    n = len(offsets) - 1
    newline = np.flatnonzero(data == 10)
    start = np.concatenate([offsets[:-1], newline + 1])
    owner = np.concatenate([np.arange(n), np.searchsorted(offsets, newline, side="right") - 1])
    order = np.argsort(start * (n + 1) + owner, kind="stable")
    start, owner = start[order], owner[order]
    end = np.empty_like(start)
    end[:-1] = np.where(owner[1:] == owner[:-1], start[1:] - 1, offsets[1:][owner[:-1]])
    end[-1:] = offsets[-1:]
    return start, end, owner, np.arange(len(start)) - np.searchsorted(owner, owner)


def _lines(c: X.Chunk):
    """The words of a chunk, their hashes, and each line's text, number and first word."""
    low = X.lower_ascii(c.data)
    start, _, owner, number = _line_spans(low, c.offsets)
    w = X.words(X.Chunk(c.first, low, c.offsets), X.ALNUM)
    wh = X.hasher(low)(w.start, w.end)
    return w, wh, owner, number, np.append(np.searchsorted(w.start, start), len(w.start))


def _line_hashes(wh: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each line's word sequence: a sum of words mixed with their places."""
    counts = np.diff(bounds)
    place = np.arange(len(wh)) - np.repeat(bounds[:-1], counts)
    mixed = X.mix(wh ^ X.mix(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7)))
    return X.mix(X.sums(mixed, bounds) + counts.astype(np.uint64)).view(np.int64)


def minima(h: np.ndarray, short: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Row j: the least of the j-th numbers of the words h[bounds[i]:bounds[i+1]], none of which is empty."""
    out = np.zeros((len(_MINIMA), len(bounds) - 1), dtype=np.uint32)
    if len(bounds) < 2:
        return out
    folded = (h >> np.uint64(32)).astype(np.uint32)
    shift = np.where(short, np.uint32(0), np.uint32(SHORT_SHIFT))
    for j, m in enumerate(_MINIMA):
        # The upper bits of a product depend on all lower ones, the lower do not.
        turned = folded * m
        turned ^= turned >> np.uint32(15)
        turned *= np.uint32(0x2C1B3C6D)
        turned >>= shift
        out[j] = np.minimum.reduceat(turned, bounds[:-1])
    return out


def min_keys(least: np.ndarray) -> list[np.ndarray]:
    """Columns of two 32-bit keys each from the minima of lines."""
    keys = []
    for members in _MEMBERS:
        key = np.zeros(least.shape[1], dtype=np.uint64)
        for j in members:
            key = X.mix(key ^ least[j])
        keys.append(key >> np.uint64(32))
    return [((keys[2 * i] << np.uint64(32)) | keys[2 * i + 1]).view(np.int64) for i in range(len(_KEYS))]


@tidy
def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines long enough to be removed: id, hash of the text, line number, hash, place, length in characters and keys of the line."""
    for b in batches:
        for c in X.chunks(b.column(2)):
            w, wh, owner, number, bounds = _lines(c)
            counts = np.diff(bounds)
            take = counts >= MIN_WORDS
            lh = _line_hashes(wh, bounds)
            firsts = np.zeros(len(c.data) + 1, dtype=np.int32)
            np.cumsum((c.data & 0xC0) != 0x80, dtype=np.int32, out=firsts[1:])
            chars = X.sums(firsts[w.end] - firsts[w.start], bounds) + counts - 1
            inside = np.repeat(take, counts)
            keys = min_keys(minima(wh[inside], (w.end - w.start <= SHORT_WORD)[inside], np.concatenate([[0], np.cumsum(counts[take])])))
            rows = pa.array(owner[take] + c.first)
            th = b.column(1).take(rows)
            at = _line_key(th.to_numpy(), number[take])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(rows), th, pa.array(number[take].astype(np.int32)), pa.array(lh[take]), pa.array(at), pa.array(chars[take].astype(np.int32)), *map(pa.array, keys)],
                ["id", "th", "line", "lh", "at", "chars", *_KEYS],
            )


def _line_key(th: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A number for a line of a text, by the hash of the text and the line's number."""
    return X.mix(th.view(np.uint64) ^ X.mix(line.astype(np.uint64) + np.uint64(3))).view(np.int64)


_NORMAL = bytes((b + 32 if 65 <= b <= 90 else b) if X.ALNUM[b] else 32 for b in range(256))


def _normalised(wanted):
    """(lh, norm) of the lines whose key the filter lets pass; other lines are not even cut into words."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = wanted.value
        for b in batches:
            for c in X.chunks(b.column(1)):
                start, end, owner, number = _line_spans(c.data, c.offsets)
                th = b.column(0).slice(c.first, c.n).to_numpy()
                picked = [c.data[start[i] : end[i]].tobytes() for i in np.flatnonzero(sieve.test(_line_key(th[owner], number)))]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in picked], dtype=np.int64)]).astype(np.int64)
                low = X.lower_ascii(np.frombuffer(b"".join(picked), dtype=np.uint8))
                w = X.words(X.Chunk(0, low, offsets), X.ALNUM)
                lh = _line_hashes(X.hasher(low)(w.start, w.end), w.bounds)
                texts = [b" ".join(x.translate(_NORMAL).split()) for x in picked]
                yield pa.RecordBatch.from_arrays([pa.array(lh), pa.array(texts, pa.binary()).cast(pa.string())], ["lh", "norm"])

    return run


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or more than ``most``: bit-parallel over what common ends leave."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = min(len(a), len(b))
    lo = 0
    while lo + 64 <= n and a[lo : lo + 64] == b[lo : lo + 64]:
        lo += 64
    while lo < n and a[lo] == b[lo]:
        lo += 1
    a, b, n = a[lo:], b[lo:], n - lo
    hi = 0
    while hi + 64 <= n and a[len(a) - hi - 64 : len(a) - hi] == b[len(b) - hi - 64 : len(b) - hi]:
        hi += 64
    while hi < n and a[len(a) - hi - 1] == b[len(b) - hi - 1]:
        hi += 1
    a, b = a[: len(a) - hi], b[: len(b) - hi]
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for j, ch in enumerate(b):
        eq = where.get(ch, 0)
        x = eq | down
        flat = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (full & ~(flat | up)), up & flat
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1) | 1, minus << 1
        up, down = (minus | ~(x | plus)) & full, plus & x & full
        # Values along the diagonal that ends in the last cell never fall.
        row = j + 1 + len(a) - len(b)
        if j % 64 == 63 and row > 0:
            above = (1 << row) - 1
            if j + 1 + (up & above).bit_count() - (down & above).bit_count() > most:
                return most + 1
    return score


#: Steps (words of one line, words of the other) after which two lines may agree again, the nearest first.
_STEPS = sorted(((i, k) for i in range(5) for k in range(5) if i + k), key=lambda s: (max(s), sum(s)))


def _word_by_word(a: str, b: str, most: int) -> bool:
    """Whether a greedy alignment of words is near enough; if not, the distance may still be."""
    x, y = a.split(" "), b.split(" ")
    i, k, cost, n, m = 0, 0, 0, len(x), len(y)
    while i < n and k < m:
        if x[i] == y[k]:
            i, k = i + 1, k + 1
            continue
        di, dk = next(((di, dk) for di, dk in _STEPS if i + di < n and k + dk < m and x[i + di] == y[k + dk]), (1, 1))
        # Words with the blank that follows each.
        cost += max(sum(map(len, x[i : i + di])) + di, sum(map(len, y[k : k + dk])) + dk)
        if cost > most:
            return False
        i, k = i + di, k + dk
    return cost + max(sum(map(len, x[i:])) + n - i, sum(map(len, y[k:])) + m - k) <= most


def _by_script(a: str, b: str, most: int) -> bool:
    """Exact: a short script of whole words, where it is near enough, proves it sooner than the distance."""
    x, y = a.split(" "), b.split(" ")
    script = edit_script(x, y, WORD_EDITS)
    cost, i, k = 0, 0, 0
    for i2, k2 in [*((i, k) for op, _, i, k in script or [] if op == "keep"), (len(x), len(y))]:
        # Words with the blank that follows each.
        cost += max(sum(map(len, x[i:i2])) + i2 - i, sum(map(len, y[k:k2])) + k2 - k)
        i, k = i2 + 1, k2 + 1
    return cost <= most or edit_distance(a, b, most) <= most


def near(a: list[str], b: list[str], similarity: int) -> np.ndarray:
    """Which pairs of lines have the edit similarity, in hundredths: exact for all lengths."""
    most = np.array([max(len(x), len(y)) * (100 - similarity) // 100 for x, y in zip(a, b, strict=True)], dtype=np.int64)
    out = np.array([abs(len(x) - len(y)) <= m and _word_by_word(x, y, m) for x, y, m in zip(a, b, most.tolist(), strict=True)], dtype=bool)
    rest = np.flatnonzero(~out)
    long = np.array([max(len(a[i]), len(b[i])) > LONG_LINE for i in rest], dtype=bool)
    short = rest[~long]
    out[short] = edits.within([a[i] for i in short], [b[i] for i in short], most[short])
    for i in rest[long]:
        out[i] = abs(len(a[i]) - len(b[i])) <= most[i] and _by_script(a[i], b[i], int(most[i]))
    return out


def _verified(similarity: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = near(b.column(2).to_pylist(), b.column(3).to_pylist(), similarity)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _keys() -> Column:
    """The keys of a line, each with its number in the upper bits."""
    low = F.lit((1 << 32) - 1)
    halves = [half for k in _KEYS for half in (F.shiftrightunsigned(k, 32), F.col(k).bitwiseAND(low))]
    return F.array(*[half.bitwiseOR(F.lit(i << 32)) for i, half in enumerate(halves)])


def _similar(texts: DataFrame, similarity: int):
    def verify(pairs: DataFrame) -> DataFrame:
        a = texts.select(F.col("lh").alias("a"), F.col("norm").alias("ta"))
        b = texts.select(F.col("lh").alias("b"), F.col("norm").alias("tb"))
        wide = pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb")
        return wide.mapInArrow(_verified(similarity), "a bigint, b bigint")

    return verify


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """(id, th, removed): for documents that lose lines, their sorted numbers; th is xxhash64 of the text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), text_col)
    occ = scratch.save(source.mapInArrow(_occurrences, f"id {kind}, th bigint, line int, lh bigint, at bigint, chars int, {', '.join(f'{k} bigint' for k in _KEYS)}"), "occurrences")

    lines = scratch.save(occ.groupBy("lh").agg(*[F.max(c).alias(c) for c in ("at", "chars", *_KEYS)], F.count("*").alias("_n")), "lines")
    posted = lines.select(F.explode(_keys()).alias("key"), F.col("lh").alias("id"), "chars")
    postings = scratch.save(shared_keys(posted), "postings", narrow=True)

    asked = postings.select(F.col("id").alias("lh")).distinct()
    wanted = spark.sparkContext.broadcast(id_filter(lines.join(asked, "lh", "left_semi").select("at")))
    texts = docs.select(F.xxhash64(text_col).alias("th"), text_col).mapInArrow(_normalised(wanted), "lh bigint, norm string")
    texts = scratch.save(texts.join(asked, "lh", "left_semi").dropDuplicates(["lh"]), "texts")
    # No two lines whose lengths differ by more can be similar enough.
    fit = lambda left, right: 100 * F.abs(left("chars") - right("chars")) <= (100 - similarity) * F.greatest(left("chars"), right("chars"))
    roots = link_groups(postings, ["chars"], fit, _similar(texts, similarity), scratch, star_rounds=3, few_keys=True)
    scratch.drop(postings, texts)

    # Lines of one text that occurs more than once, and lines of groups; the first occurrence of each group stays.
    group = lines.select("lh", "_n", F.col("lh").alias("root"))
    if roots is not None:
        group = group.join(roots.select(F.col("id").alias("lh"), F.col("root").alias("_r")), "lh", "left").filter("_n > 1 OR _r IS NOT NULL")
        group = group.select("lh", "_n", F.coalesce("_r", "root").alias("root"))
    else:
        group = group.filter("_n > 1")
    group = scratch.save(group, "groups")
    members = scratch.save(join_counted(occ.select("id", "th", "line", "lh"), group, "lh"), "members")
    place = F.struct(F.col("id").isNull().alias("late"), "id", "th", "line")
    # By line first, so that a group's places come from its lines, not from their occurrences.
    first = members.groupBy("lh").agg(F.min(place).alias("first"), F.any_value("root").alias("root"), F.any_value("_n").alias("_n"))
    first = scratch.save(first, "first")
    kept = scratch.save(first.groupBy("root").agg(F.min("first").alias("kept"), F.count("*").alias("_n")), "kept")
    fate = scratch.save(join_counted(first.select("lh", "root", F.col("_n").alias("n")), kept, "root").select("lh", "kept", F.col("n").alias("_n")), "fate")
    rest = join_counted(members.select("id", "th", "line", "lh"), fate, "lh")
    rest = rest.filter(~(F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("th") == F.col("kept.th")) & (F.col("line") == F.col("kept.line"))))
    out = rest.groupBy("id", "th").agg(F.array_sort(F.collect_set("line")).alias("removed"))
    out = scratch.save(out, "removed")
    scratch.drop(occ, lines, group, members, first, kept, fate)
    return out


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """docs with the text cut, and _n_lines and _removed (line numbers from 0) added."""
    own = Apart(docs)
    out, lines, removed, text = _cut(own.df, own[id_col], own[text_col], similarity)
    return own.back(out, {text_col: text, "_n_lines": lines, "_removed": removed})


def _cut(docs: DataFrame, id_col: str, text_col: str, similarity: int) -> tuple[DataFrame, Column, Column, Column]:
    """docs with columns of its own, and from them the number of lines, those removed and the text that stays."""
    gone = removed_lines(docs, id_col, text_col, similarity).select(F.col("id").alias("_id"), F.col("th").alias("_th"), F.col("removed").alias("_gone"))
    d = docs.withColumn("_h", F.xxhash64(text_col))
    d = d.join(gone, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_th")), "left")
    d = d.withColumn("_lines", F.split(F.col(text_col), "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    kept = F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")
    text = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(kept)
    removed = F.coalesce("_gone", F.array().cast("array<int>"))
    return d, F.coalesce(F.size("_lines"), F.lit(0)), removed, text


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: one row for each row of documents: its lines, those removed, and the digest of the text that stays."""
    cut = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return cut.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("_n_lines")).alias("n_lines"), F.size("_removed").alias("n_removed"), "_removed", F.sha2(F.col("text"), 256).alias("text_sha256")).withColumnRenamed("_removed", "removed_lines")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without repeated lines; n_chars follows the text; a document that loses all its words goes."""
    own = Apart(docs)
    out, _, removed, text = _cut(own.df, own["doc_id"], own["text"], SIMILARITY)
    stay = out.filter((F.size(removed) == 0) | text.rlike(r"[^\x20\x09-\x0D]"))
    return own.back(stay, {"text": text} | ({"n_chars": F.length(text).cast("bigint")} if "n_chars" in docs.columns else {}))
