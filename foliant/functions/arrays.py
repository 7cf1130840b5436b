"""Expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entries that are added up one by one; blocks of so many are added up as a whole.
BLOCK = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda done, v: done + v)


def sums_before(values: Column) -> Column:
    """For each entry of an array of int the sum of all before it.

    Sums of blocks come first, so that an entry costs half a block at most and nothing is copied; null gives null.
    """

    def whole(v: Column) -> Column:
        numbers = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
        part = lambda b, n: F.slice(v, b * BLOCK + 1, n)

        def one(b: Column, sums: Column) -> Column:
            return bound(_total(F.slice(sums, F.lit(1), b)), lambda base: F.transform(part(b, F.lit(BLOCK)), lambda _, i: base + _total(part(b, i))))

        return bound(F.transform(numbers, lambda b: _total(part(b, F.lit(BLOCK)))), lambda sums: F.flatten(F.transform(numbers, lambda b: one(b, sums))))

    return bound(values, whole)
