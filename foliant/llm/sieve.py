"""A Bloom filter of 64-bit ids: a first sieve, never the only one.

Its size follows the counted number of ids, up to ``MOST_BITS``, so what is broadcast is bounded
whatever the input; beyond that it lets more through, and what follows it stays exact. Ids are
dealt by the part of the filter they fall in before any part is filled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bits for each id, and of a whole filter at most: 64 megabytes.
BITS_AN_ID = 16
MOST_BITS = 29
#: Bits of one part, filled by one group.
PART_BITS = 18
_PROBES = 3


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    h = ids.view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(low + np.uint64(i) * high) & np.uint64((1 << bits) - 1) for i in range(_PROBES)])


class Sieve:
    def __init__(self, words: np.ndarray, bits: int) -> None:
        self.words, self.bits = words, bits

    def test(self, ids: np.ndarray) -> np.ndarray:
        """Whether each of the mixed 64-bit ids may be one of the filter's."""
        out = np.ones(len(ids), dtype=bool)
        for p in _places(ids, self.bits):
            out &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out


def sieve(ids: DataFrame, most_bits: int = MOST_BITS) -> Sieve:
    """The filter of a one-column frame of longs that are mixed already."""
    n = ids.count()
    bits = min(most_bits, max(PART_BITS, (n * BITS_AN_ID).bit_length()))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _places(b.column(0).to_numpy(zero_copy_only=False), bits).ravel()
            yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(PART_BITS)).astype(np.int32)), pa.array((p & np.uint64((1 << PART_BITS) - 1)).astype(np.int32))], ["part", "bit"])

    def fill(table: pa.Table) -> pa.Table:
        marks = np.zeros(1 << PART_BITS, dtype=bool)
        marks[table["bit"].to_numpy()] = True
        return pa.table({"part": table["part"].slice(0, 1), "data": [np.packbits(marks, bitorder="little").tobytes()]})

    rows = ids.mapInArrow(deal, "part int, bit int").groupBy("part").applyInArrow(fill, "part int, data binary").toArrow()
    words = np.zeros(1 << (bits - 6), dtype=np.uint64)
    size = 1 << (PART_BITS - 6)
    for part, data in zip(rows["part"].to_pylist(), rows["data"], strict=True):
        words[part * size : (part + 1) * size] = np.frombuffer(data.as_buffer(), dtype=np.uint64)
    return Sieve(words, bits)
