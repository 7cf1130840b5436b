"""Words of two engines merged page by page, of which only packed pages are moved.

Words that lie together are packed where they are made: a run of words of one page is one row of bytes, its columns one after
the other, turned so that equal bytes meet, and compressed. These rows are shuffled by page and sorted, and nothing else is
written. A task unpacks some pages at a time; a page is held as a whole, of its pairs so many at once as ``PAIRS`` says.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = ["doc_id", "page_no"]
#: What a word says after its page: whose it is, its place in the order, and its reading.
_FIELDS = ["seq", "x", "y", "w", "h", "confidence"]
_KINDS = {"seq": "bigint", "text": "string", "x": "double", "y": "double", "w": "double", "h": "double", "confidence": "double"}
#: Words that are merged at a time, where pages are small, and pairs of boxes that are held at a time.
WORDS, PAIRS = 1 << 16, 1 << 20
#: Whose a word is: of the first engine, the second, or neither; ``PRIMARY`` is added for rows of the first table.
FIRST, SECOND, OTHER, PRIMARY = 0, 1, 2, 4
_SLACK = 1 + 1e-9


def tagged(words: DataFrame, first: str, second: str, primary: bool = False) -> DataFrame:
    """words as they are packed, with whose they are."""
    who = F.when(F.col("engine") == first, FIRST).when(F.col("engine") == second, SECOND).otherwise(OTHER) + F.lit(PRIMARY if primary else 0)
    return words.select(F.col("doc_id").cast("bigint"), F.col("page_no").cast("int"), who.cast("int").alias("_k"), *[F.col(c).cast(t).alias(c) for c, t in _KINDS.items()])


def _plain(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column, zero for a null, and which are there."""
    there = np.asarray(c.is_valid())
    return np.asarray(c.fill_null(0)) if c.null_count else c.to_numpy(zero_copy_only=False), there


def _turned(a: np.ndarray) -> bytes:
    return a.view(np.uint8).reshape(len(a), -1).T.tobytes()


def _back(raw: bytes, at: int, n: int, kind: str) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8, n * wide, at).reshape(wide, n).T.copy().view(kind).reshape(n)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, page_no, data of each run of words of a page."""
    codec = pa.Codec("zstd")
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        (doc, doc_ok), (page, page_ok) = _plain(b.column("doc_id")), _plain(b.column("page_no"))
        new = np.ones(n, bool)
        new[1:] = (doc[1:] != doc[:-1]) | (page[1:] != page[:-1]) | (doc_ok[1:] != doc_ok[:-1]) | (page_ok[1:] != page_ok[:-1])
        starts = np.flatnonzero(new)
        text = b.column("text").cast(pa.large_string())
        text_ok = np.asarray(text.is_valid())
        text = text.fill_null("") if text.null_count else text
        places = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
        letters = text.buffers()[2]
        letters = memoryview(letters) if letters is not None else memoryview(b"")
        size = np.diff(places).astype(np.int32)
        columns = [_plain(b.column(c)) for c in _FIELDS]
        who = np.asarray(b.column("_k")).astype(np.uint8)
        there = np.stack([text_ok, *(ok for _, ok in columns)])
        out = []
        for lo, hi in zip(starts, np.append(starts[1:], n), strict=True):
            seq = columns[0][0][lo:hi]
            parts = [np.packbits(there[:, lo:hi]).tobytes(), who[lo:hi].tobytes(), _turned(np.diff(seq, prepend=np.int64(0))), *(_turned(np.ascontiguousarray(v[lo:hi])) for v, _ in columns[1:]), _turned(size[lo:hi]), letters[places[lo] : places[hi]]]
            raw = b"".join(parts)
            out.append(struct.pack("<IQ", hi - lo, len(raw)) + codec.compress(raw, asbytes=True))
        at = pa.array(starts)
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("page_no").take(at), pa.array(out, pa.binary())], [*PAGE, "data"])


def _unpack(codec: pa.Codec, data: bytes) -> tuple:
    """there (text and the fields), whose, the fields' values, lengths of texts, and the texts one after the other."""
    n, size = struct.unpack_from("<IQ", data)
    raw = codec.decompress(memoryview(data)[12:], size, asbytes=True)
    rows = 1 + len(_FIELDS)
    bits = -(-rows * n // 8)
    there = np.unpackbits(np.frombuffer(raw, np.uint8, bits), count=rows * n).reshape(rows, n).astype(bool)
    who = np.frombuffer(raw, np.uint8, n, bits)
    at = bits + n
    columns = [np.cumsum(_back(raw, at, n, "<i8"))]
    for i in range(1, len(_FIELDS)):
        columns.append(_back(raw, at + 8 * n * i, n, "<f8"))
    at += 8 * n * len(_FIELDS)
    return there, who, columns, _back(raw, at, n, "<i4"), raw[at + 4 * n :]


class _Words:
    """The words of some pages, as columns; g numbers the pages."""

    def __init__(self, parts: list[tuple], g: np.ndarray) -> None:
        self.there = np.concatenate([p[0] for p in parts], axis=1)
        self.who = np.concatenate([p[1] for p in parts])
        self.at = {c: np.concatenate([p[2][i] for p in parts]) for i, c in enumerate(_FIELDS)}
        size = np.concatenate([[0], np.cumsum(np.concatenate([p[3] for p in parts]), dtype=np.int64)])
        text = pa.LargeStringArray.from_buffers(len(self.who), pa.py_buffer(size), pa.py_buffer(b"".join(p[4] for p in parts)))
        self.text = text if self.there[0].all() else pa.compute.if_else(pa.array(self.there[0]), text, None)
        self.g = g

    def ok(self, c: str) -> np.ndarray:
        return self.there[1 + _FIELDS.index(c)]

    def key(self, i: int) -> tuple:
        """What tells words of one seq apart: place, text and confidence, nulls first."""
        own = lambda c: (bool(self.ok(c)[i]), 0.0 if not self.ok(c)[i] else float("inf") if np.isnan(v := float(self.at[c][i])) else v)
        text = self.text[i].as_py()
        return *map(own, "xywh"), (text is not None, (text or "").encode()), own("confidence")

    def order(self, rows: np.ndarray, engine: np.ndarray) -> np.ndarray:
        """rows by page, engine and seq; equal seqs by place, text and confidence."""
        seq, there = self.at["seq"], self.ok("seq")
        out = rows[np.lexsort((seq[rows], there[rows], engine[rows], self.g[rows]))]
        a, b = out[1:], out[:-1]
        same = (seq[a] == seq[b]) & (there[a] == there[b]) & (engine[a] == engine[b]) & (self.g[a] == self.g[b])
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        for lo, hi in zip(edges[::2], edges[1::2] + 1, strict=True):
            out[lo:hi] = sorted(out[lo:hi], key=self.key)
        return out


def matched(g: np.ndarray, first: np.ndarray, box: np.ndarray, placed: np.ndarray, least: float) -> np.ndarray:
    """For each word the one it is paired with, or -1; words are in order of pages, and of their numbers for each engine.

    Each word of the first takes, one after the other, the free word of the second that it overlaps most, if by ``least``; equal
    overlaps go to the first in order. Boxes meet by bands of a page's largest height and by x: a box of that overlap is at most
    1 / least times as large either way.
    """
    partner = np.full(len(g), -1)
    a, b = np.flatnonzero(first & placed), np.flatnonzero(~first & placed)
    if not len(a) or not len(b):
        return partner
    x, y, w, h = box
    n_pages = int(g.max()) + 1
    high, top, low = np.zeros(n_pages), np.full(n_pages, np.inf), np.full(n_pages, -np.inf)
    np.maximum.at(high, g[a], h[a])
    np.minimum.at(top, g[b], y[b])
    np.maximum.at(low, g[b], y[b])
    a = a[np.isfinite(top[g[a]])]
    far = 1 / least * _SLACK if least >= 0.1 else np.inf
    tall = np.where(np.isfinite(top), np.maximum(high, (low - top) / 1e6), 1.0)
    tall = np.where((tall > 0) & np.isfinite(far), tall, np.inf)
    band = lambda at, v: np.clip(np.floor((v - top[g[at]]) / tall[g[at]]), -1, 2e6).astype(np.int64)
    most = 1 << 22
    xs, rank = np.unique(x[b], return_inverse=True)
    blocks, block = np.unique(g[b] * most + band(b, y[b]), return_inverse=True)
    key = block * (len(xs) + 1) + rank
    order = np.argsort(key, kind="stable")
    b, key = b[order], key[order]
    since = np.maximum(band(a, y[a] - h[a] * far), 0) if np.isfinite(far) else np.zeros(len(a), np.int64)
    until = np.maximum(band(a, y[a] + h[a]), -1) if np.isfinite(far) else np.zeros(len(a), np.int64)
    n = np.maximum(until - since + 1, 0)
    who = np.repeat(a, n)
    wanted = g[who] * most + np.repeat(since, n) + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    found = np.minimum(np.searchsorted(blocks, wanted), len(blocks) - 1)
    who, found = who[blocks[found] == wanted], found[blocks[found] == wanted]
    left = x[who] - w[who] * far if np.isfinite(far) else np.full(len(who), -np.inf)
    begin = np.searchsorted(key, found * (len(xs) + 1) + np.searchsorted(xs, left))
    n = np.searchsorted(key, found * (len(xs) + 1) + np.searchsorted(xs, x[who] + w[who])) - begin
    who, begin, n = who[n > 0], begin[n > 0], n[n > 0]
    # Pairs of so many words at a time; all of a word are together.
    total, ends = np.cumsum(n), np.flatnonzero(np.append(who[1:] != who[:-1], True)) + 1 if len(who) else np.zeros(0, np.int64)
    free = np.ones(len(g), bool)
    at = 0
    while at < len(who):
        done = total[at - 1] if at else 0
        upto = ends[max(np.searchsorted(total[ends - 1], done + PAIRS, side="right") - 1, np.searchsorted(ends, at, side="right"))]
        m = n[at:upto]
        p = np.repeat(who[at:upto], m)
        s = b[np.arange(len(p)) + np.repeat(begin[at:upto] - np.cumsum(m) + m, m)]
        at = upto
        wide = np.minimum(x[p] + w[p], x[s] + w[s]) - np.maximum(x[p], x[s])
        deep = np.minimum(y[p] + h[p], y[s] + h[s]) - np.maximum(y[p], y[s])
        shared = wide * deep
        both = (wide > 0) & (deep > 0) & free[s]
        p, s, shared = p[both], s[both], shared[both]
        union = w[p] * h[p] + w[s] * h[s] - shared
        good = (shared > 0) & (union > 0)
        p, s, iou = p[good], s[good], shared[good] / union[good]
        p, s, iou = p[iou >= least], s[iou >= least], iou[iou >= least]
        alone = (np.bincount(p, minlength=1)[p] == 1) & (np.bincount(s, minlength=1)[s] == 1)
        partner[p[alone]], free[s[alone]] = s[alone], False
        rest = np.lexsort((s[~alone], -iou[~alone], p[~alone]))
        p, s = p[~alone][rest], s[~alone][rest]
        starts = np.flatnonzero(np.diff(p, prepend=-1))
        for lo, hi in zip(starts, np.append(starts[1:], len(p))[: len(starts)], strict=True):
            here = s[lo:hi][free[s[lo:hi]]]
            if len(here):
                partner[p[lo]], free[here[0]] = here[0], False
    return partner


def _merged(words: _Words, keyed: np.ndarray, names: tuple[str, str], least: float, below: float | None) -> tuple:
    """Rows of the words whose reading, page, number and engine come out."""
    engine, primary = words.who % PRIMARY, words.who >= PRIMARY
    rows = np.arange(len(engine))
    sure = np.zeros(0, np.int64)
    if below is not None:
        asked = primary & words.ok("confidence")
        n = np.bincount(words.g[asked], minlength=len(keyed))
        sums = np.bincount(words.g[asked], weights=words.at["confidence"][asked], minlength=len(keyed))
        weak = (keyed & (n > 0) & (sums / np.maximum(n, 1) < below))[words.g]
        sure, rows = rows[primary & ~weak], rows[weak]
    rows = words.order(rows[engine[rows] < OTHER], engine)
    g, first = words.g[rows], engine[rows] == FIRST
    box = np.stack([words.at[c][rows] for c in "xywh"]) if len(rows) else np.zeros((4, 0))
    placed = np.all([words.ok(c)[rows] for c in "xywh"], axis=0) & np.isfinite(box).all(axis=0) & (box[2] > 0) & (box[3] > 0) & keyed[g]
    partner = matched(g, first, box, placed, least)
    other = rows[partner]
    there = words.ok("confidence")
    confidence = words.at["confidence"]
    surer = (partner >= 0) & there[other] & there[rows] & (confidence[other] > confidence[rows])
    taken = np.zeros(len(rows), bool)
    taken[partner[partner >= 0]] = True
    keep = first | ~taken
    reading, source = np.where(surer, other, rows)[keep], np.where(~first, 2, np.where(partner >= 0, 0, 1))[keep]
    g = g[keep]
    new = np.append(True, g[1:] != g[:-1]) if len(g) else np.zeros(0, bool)
    begins = np.flatnonzero(new)
    number = np.arange(len(g)) - np.repeat(begins, np.diff(np.append(begins, len(g))))
    numbered = np.append(words.ok("seq")[sure], np.ones(len(g), bool))
    return np.append(sure, reading), np.append(words.g[sure], g), np.append(words.at["seq"][sure], number), numbered, np.append(np.ones(len(sure), np.int64), source)


_OUT = ["seq", "text", "x", "y", "w", "h", "confidence", "source_engine"]


def _merge(names: tuple[str, str], least: float, below: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        engines = pa.array(["ROVER", *names], pa.string())
        pages, parts, owners, n_words = [], [], [], 0

        def batch() -> Iterator[pa.RecordBatch]:
            words = _Words(parts, np.repeat(owners, [len(p[1]) for p in parts]))
            keyed = np.array([None not in p for p in pages])
            reading, g, seq, numbered, source = _merged(words, keyed, names, least, below)
            docs, numbers = pa.array([p[0] for p in pages], pa.int64()), pa.array([p[1] for p in pages], pa.int32())
            for lo in range(0, len(reading), WORDS):
                cut = slice(lo, lo + WORDS)
                r = reading[cut]
                own = [pa.array(words.at[c][r], mask=~words.ok(c)[r]) for c in _FIELDS[1:]]
                at = pa.array(g[cut])
                yield pa.RecordBatch.from_arrays([docs.take(at), numbers.take(at), pa.array(seq[cut], mask=~numbered[cut]), words.text.take(pa.array(r)).cast(pa.string()), *own, engines.take(pa.array(source[cut]))], [*PAGE, *_OUT])

        for b in batches:
            for doc, page, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if not pages or pages[-1] != (doc, page):
                    if n_words >= WORDS:
                        yield from batch()
                        pages, parts, owners, n_words = [], [], [], 0
                    pages.append((doc, page))
                parts.append(_unpack(codec, data.as_buffer()))
                owners.append(len(pages) - 1)
                n_words += len(parts[-1][1])
        if parts:
            yield from batch()

    return run


def merged(words: DataFrame, parts: int, names: tuple[str, str], least: float, below: float | None = None) -> DataFrame:
    """doc_id, page_no, seq, text, x, y, w, h, confidence, source_engine of words (``tagged``), merged by page in so many partitions (0: Spark's setting).

    With ``below``, pages whose words of the first table are not less sure on average keep these as they are, and no others.
    """
    packed = words.mapInArrow(pack, "doc_id bigint, page_no int, data binary")
    dealt = packed.repartition(parts, *PAGE) if parts else packed.repartition(*PAGE)
    kinds = "doc_id bigint, page_no int, seq bigint, text string, x double, y double, w double, h double, confidence double, source_engine string"
    return dealt.sortWithinPartitions(*PAGE).mapInArrow(_merge(names, least, below), kinds)


def as_kinds(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    column: dict[str, Column] = {c: F.col(c).cast(kind) for c, kind in kinds.items()}
    return rows.select(*[v.alias(c) for c, v in column.items()])
