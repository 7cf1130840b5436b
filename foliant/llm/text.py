"""Vectorised word and shingle hashing over Arrow string columns.

Texts arrive as Arrow batches and are cut into chunks of about half a megabyte, so the
temporary arrays of a worker stay small whatever the batch holds (a single longer text
is a chunk of its own). Words are hashed by a prefix sum of keyed polynomial terms modulo
2**64, finished by a bijective mixer; equal words get equal hashes in every process.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    h = np.asarray(h, dtype=np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def _byte_keys() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


#: Entries of the tables of powers that a worker keeps; a longer text makes its own and gives them back.
KEPT_POWERS = 1 << 20


def _power_table(base: int, n: int) -> np.ndarray:
    table = np.ones(1, dtype=np.uint64)
    while len(table) < n:
        table = np.concatenate([table, table[: n - len(table)] * np.uint64(pow(base, len(table), 1 << 64))])
    return table


@lru_cache(maxsize=1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _power_table(_BASE, KEPT_POWERS), _power_table(pow(_BASE, -1, 1 << 64), KEPT_POWERS)


def _powers(n: int, inverse: bool) -> np.ndarray:
    """base**i, or base**-i, modulo 2**64 for i < n at least."""
    if n <= KEPT_POWERS:
        return _kept_powers()[inverse]
    return _power_table(pow(_BASE, -1, 1 << 64) if inverse else _BASE, n)


def _class_table(spaces: bytes) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(spaces)] = False
    return table


#: Words are runs of bytes outside these: space, and tab to carriage return.
BLANK = _class_table(bytes([0x20, *range(0x09, 0x0E)]))
#: Words are ASCII letters and digits and everything beyond ASCII.
ALNUM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


@dataclass
class Chunk:
    """Consecutive texts: rows [first, first + n), their bytes, and offsets within them."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into chunks of at most ``limit`` bytes, or one text; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offset_buffer, data_buffer = texts.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offset_buffer, dtype=kind, count=len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), first + 65_000, len(texts))
        yield Chunk(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


@dataclass
class Words:
    """Words of a chunk: byte spans, the text each belongs to, and where each text's words start."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def words(chunk: Chunk, kind: np.ndarray = BLANK) -> Words:
    """Maximal runs of bytes in ``kind``; no word crosses from one text to the next."""
    return spans(kind[chunk.data], chunk.offsets)


def spans(inside: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(inside)
    starts, ends = inside.copy(), inside.copy()
    if n:
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        starts[1:] &= ~inside[:-1] | edge[1:n]
        ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    bounds = np.searchsorted(start, offsets)
    return Words(start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(bounds)), bounds)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """p, with ``p[j] - p[i]`` a hash of bytes i..j once divided by base**i."""
    up = _powers(len(data) + 1, False)
    p = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_byte_keys()[data] * up[: len(data)], out=p[1:])
    return p


def span_hashes(p: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    down = _powers(len(p), True)
    raw = (p[end] - p[start]) * down[start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(salt & _MASK))


def _long_span_hash(data: np.ndarray, salt: int) -> np.ndarray:
    """As span_hashes of the whole of data, window by window."""
    raw, up, size = 0, _kept_powers()[0], KEPT_POWERS - 1
    for at in range(0, len(data), size):
        part = data[at : at + size]
        raw += int((_byte_keys()[part] * up[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, at, 1 << 64)
    return mix(np.array([(raw + len(data) * 0xA24BAED4963EE407 + salt) & _MASK], dtype=np.uint64))


def hasher(data: np.ndarray) -> Callable[..., np.ndarray]:
    """A function of (start, end, salt=0), both ascending: hashes of these spans; tables of powers never outgrow a window."""
    if len(data) < KEPT_POWERS:
        return partial(span_hashes, prefix_hashes(data))

    def run(start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        out = np.empty(len(start), dtype=np.uint64)
        i = 0
        while i < len(start):
            lo = int(start[i])
            j = int(np.searchsorted(end, lo + KEPT_POWERS - 1, side="right"))
            if j <= i:
                out[i : i + 1] = _long_span_hash(data[lo : int(end[i])], salt & _MASK)
                i += 1
                continue
            out[i:j] = span_hashes(prefix_hashes(data[lo : int(end[j - 1])]), start[i:j] - lo, end[i:j] - lo, salt)
            i = j
        return out

    return run


def shingle_hashes(word_hash: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, and the text of each.

    A text with fewer words, but at least one, has its whole word sequence as one shingle.
    """
    counts = np.diff(bounds)
    total = len(word_hash)
    texts = np.arange(len(counts))
    full = np.maximum(counts - width + 1, 0)
    if total >= width:
        h = np.zeros(total - width + 1, dtype=np.uint64)
        for j in range(width):
            h = h * np.uint64(_BASE) + word_hash[j : total - width + 1 + j]
        owner = np.repeat(texts, counts)[: len(h)]
        inside = np.arange(len(h)) <= bounds[1:][owner] - width
        h, owner = mix(h[inside]), owner[inside]
    else:
        h, owner = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((counts > 0) & (full == 0))
    if len(short):
        acc = np.zeros(len(short), dtype=np.uint64)
        for j in range(width - 1):
            has = counts[short] > j
            at = np.minimum(bounds[short] + j, max(total - 1, 0))
            acc = np.where(has, acc * np.uint64(_BASE) + word_hash[at], acc)
        acc = mix(acc + counts[short].astype(np.uint64))
        h, owner = np.concatenate([h, acc]), np.concatenate([owner, short])
    return h, owner


def group_sort(h: np.ndarray, owner: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """An order by owner, then by ``first`` (16 bits) where given, then by hash.

    Owners are below 2**16 within a chunk, so two of the three passes are radix sorts.
    """
    order = np.argsort(h, kind="stable" if len(h) < 64 else None)
    if first is not None:
        order = order[np.argsort(first[order].astype(np.uint16), kind="stable")]
    return order[np.argsort(owner[order].astype(np.uint16), kind="stable")]


def distinct(h: np.ndarray, owner: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each owner's distinct hashes, sorted as by group_sort."""
    order = group_sort(h, owner, first)
    h, owner = h[order], owner[order]
    if len(h):
        keep = np.ones(len(h), dtype=bool)
        keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[keep], owner[keep]
    return h, owner


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]], zero where empty."""
    total = np.zeros(len(values) + 1, dtype=values.dtype if values.dtype.kind in "ufi" and values.dtype.itemsize == 8 else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def counts(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of marks[bounds[i]:bounds[i+1]] are set."""
    if len(bounds) == 2:
        return np.array([np.count_nonzero(marks[bounds[0] : bounds[1]])], dtype=np.int64)
    return sums(marks.astype(np.int64), bounds)


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of an array<bigint> column from flat values."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values))
