"""Connected groups of rows that share keys, without pairing all rows of a key.

``link_groups`` takes postings (key, id, ...): rows that may link stand under a common key.
It does not test all pairs of a key at once. First each row is tested against one leader
of its key, in rounds with different leaders; links contract rows into components. Rows of
one component need no further test, so what remains are keys that still hold two or more
components; for these, all pairs across components are tested. No link between different
components is left out, so the components are those of all links, while a group of copies
costs as many tests as it has rows.

Components come from rounds of hooking every root to its least neighbour and halving
the paths, all as joins; no links or labels reach the driver.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm import text as X
from foliant.llm.scratch import Scratch, tidy

Verify = Callable[[DataFrame], DataFrame]


#: A key is hot if more than one in so many rows has it, so that there are never more hot keys than this.
HOT_SHARE = 1000
#: Pairs for each row that are tested without looking for another leader first.
OPEN_PAIRS = 1
#: Another leader is tried while one in so many tests links.
FRUITFUL = 50
#: Rows of one key that one task pairs with the others.
BLOCK_ROWS = 1000


def join_counted(rows: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    """rows joined with counted (key once, _n: how many rows have it, ...), without any task that gathers a hot key.

    The at most ``HOT_SHARE`` hot keys are broadcast to where their rows lie; the others are shuffled.
    """
    total, most = counted.agg(F.sum("_n"), F.max("_n")).first()
    if total is None or most * HOT_SHARE <= total:
        return rows.join(counted, key)
    hot = F.col("_n") * HOT_SHARE > total
    few = F.broadcast(counted.filter(hot))
    near = rows.join(few, key)
    return near.unionByName(rows.join(few.select(key), key, "left_anti").join(counted.filter(~hot), key))


@tidy
def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their first column: those that have it in common with a neighbour, and the two ends."""
    held, wanted = None, True
    for b in batches:
        if not b.num_rows:
            continue
        rows = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        key = rows.column(0).to_numpy()
        keep = np.zeros(len(key), dtype=bool)
        keep[1:] = key[1:] == key[:-1]
        keep[:-1] |= keep[1:]
        keep[0] |= wanted
        wanted = bool(keep[-1])
        yield rows.slice(0, len(key) - 1).filter(pa.array(keep[:-1]))
        held = rows.slice(len(key) - 1)
    if held is not None:
        yield held


def shared_keys(postings: DataFrame) -> DataFrame:
    """Of postings (key bigint, ...) those whose key occurs more than once, and at most two others a partition.

    Rows are dealt by ranges of all their columns and sorted, so a hot key is split, and one shuffle does.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in postings.schema.fields)
    return postings.repartitionByRange(*postings.columns[:2]).sortWithinPartitions("key").mapInArrow(_runs, kinds)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) of every id in edges (a, b): root is the least id of its component."""
    edges = scratch.save(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mapping = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hook = scratch.save(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("root")), "hooks")
        for _ in range(2):
            up = hook.select(F.col("id").alias("root"), F.col("root").alias("next"))
            jumped = scratch.save(hook.join(up, "root").select("id", F.col("next").alias("root")), "hooks")
            scratch.drop(hook)
            hook = jumped
        if mapping is None:
            new = hook
        else:
            up = hook.select(F.col("id").alias("root"), F.col("root").alias("next"))
            new = scratch.save(mapping.join(up, "root", "left").select("id", F.coalesce("next", "root").alias("root")), "mapping")
            scratch.drop(mapping)
        mapping = new
        ends = edges.join(hook.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a").join(hook.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b")
        rest = ends.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        rest = scratch.save(rest, "edges")
        scratch.drop(edges)
        if hook is not mapping:
            scratch.drop(hook)
        edges = rest
    if mapping is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    scratch.drop(edges)
    return mapping


def _compose(mapping: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame | None:
    """mapping after the ends of links (a, b), taken to their roots, are joined."""
    if links.isEmpty():
        return mapping
    if mapping is None:
        return components(links, scratch)
    roots = links
    for end in ("a", "b"):
        m = mapping.select(F.col("id").alias(end), F.col("root").alias("_root"))
        roots = roots.join(m, end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    joined = components(roots.select("a", "b"), scratch)
    # The new roots: of ids known before, through their old root; of new ids, their own.
    up = joined.select(F.col("id").alias("root"), F.col("root").alias("next"))
    old = mapping.join(up, "root", "left").select("id", F.coalesce("next", "root").alias("root"))
    new = joined.join(mapping.select("id"), "id", "left_anti")
    return scratch.save(old.unionByName(new.select("id", "root")), "mapping")


def link_groups(
    postings: DataFrame,
    attributes: list[str],
    compatible: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    verify: Verify,
    scratch: Scratch,
    star_rounds: int = 6,
    central: list[str] | None = None,
    few_keys: bool = False,
) -> DataFrame | None:
    """(id, root) of ids with links, or None if there are none.

    postings: (key, id, *attributes), each (key, id) once, keys with two ids or more.
    compatible(left, right): a filter on two rows' attributes that every link passes.
    verify(pairs (a, b)): the pairs that link.
    star_rounds: tests against leaders end after so many rounds, or once few pairs are left, or few linked.
    few_keys: rows stand under a few keys each, so that a pair can be made under its first common key alone.
    central: columns by which the first leader of a key is chosen, least first; one that links with
    many spares most tests.
    """
    mapping: DataFrame | None = None
    tested: list[DataFrame] = []

    def rooted() -> DataFrame:
        if mapping is None:
            return postings.withColumn("_root", F.col("id"))
        m = mapping.select("id", F.col("root").alias("_r"))
        return postings.join(m, "id", "left").withColumn("_root", F.coalesce("_r", "id")).drop("_r")

    for turn in range(star_rounds):
        rows = rooted()
        if turn:
            # Pairs across components, key by key: their number is known without making them.
            parts = rows.groupBy("key", "_root").agg(F.count("*").alias("c")).groupBy("key").agg((F.sum("c") ** 2 - F.sum(F.col("c") ** 2)).alias("open"), F.sum("c").alias("c"))
            left = parts.agg(F.sum(F.col("open") / 2), F.sum("c")).first()
            if not left[1] or left[0] <= OPEN_PAIRS * left[1]:
                break
        order = F.struct(*(central or []), "id") if turn == 0 else F.struct(F.xxhash64(F.lit(turn), "id"))
        leaders = rows.groupBy("key").agg(F.min_by(F.struct("id", "_root", *attributes), order).alias("lead"), F.min("_root").alias("_lo"), F.max("_root").alias("_hi"), F.count("*").alias("_n"))
        leaders = scratch.save(leaders.filter("_lo <> _hi").select("key", "lead", "_n"), "leaders")
        near = join_counted(rows, leaders, "key").filter(F.col("_root") != F.col("lead._root"))
        near = near.filter(compatible(lambda c: F.col(f"lead.{c}"), F.col)).select(F.col("lead.id").alias("a"), F.col("id").alias("b")).distinct()
        pairs = scratch.save(near, "pairs")
        links = scratch.save(verify(pairs), "links")
        tested.append(pairs)
        fruitful = links.count() * FRUITFUL >= pairs.count()
        mapping = _compose(mapping, links, scratch)
        scratch.drop(links, leaders)
        if not fruitful:
            break

    rows = rooted()
    mixed = rows.groupBy("key").agg(F.min("_root").alias("_lo"), F.max("_root").alias("_hi"), F.count("*").alias("_n")).filter("_lo <> _hi").select("key", "_n")
    mixed = scratch.save(join_counted(rows, scratch.save(mixed, "mixed-keys"), "key"), "mixed")
    # The rows of a key are dealt into blocks, and every block meets all rows, so that no task pairs a whole large key.
    blocks = F.ceil(F.col("_n") / BLOCK_ROWS).cast("int")
    columns = ["id", "_root", *attributes]
    if few_keys:
        every = mixed.groupBy("id").agg(F.collect_set("key").alias("_keys"))
        mixed = scratch.save(mixed.join(every, "id"), "keyed")
        columns.append("_keys")
    left = mixed.select("key", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), F.struct(*columns).alias("l"))
    right = mixed.select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.struct(*columns).alias("r"))
    meet = (F.col("l.id") < F.col("r.id")) & (F.col("l._root") != F.col("r._root")) & compatible(lambda c: F.col(f"l.{c}"), lambda c: F.col(f"r.{c}"))
    if few_keys:
        meet = meet & (F.array_min(F.array_intersect("l._keys", "r._keys")) == left["key"])
    wide = left.join(right, (left["key"] == right["key"]) & (left["block"] == right["block"]) & meet)
    pairs = wide.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    pairs = pairs if few_keys else pairs.distinct()
    if tested:
        done = functools.reduce(DataFrame.unionByName, tested)
        pairs = pairs.join(done.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    pairs = scratch.save(pairs, "pairs")
    mapping = _compose(mapping, scratch.save(verify(pairs), "links"), scratch)
    scratch.drop(mixed, pairs, *tested)
    return mapping


#: Bits of the filter below, whatever the number of ids: 8 megabytes.
FILTER_BITS = 26


class IdFilter:
    """A Bloom filter of fixed size: a first sieve of ids, never the only one."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    @staticmethod
    def places(ids: np.ndarray) -> list[np.ndarray]:
        h = X.mix(ids.view(np.uint64))
        return [(h >> np.uint64(s)) & np.uint64((1 << FILTER_BITS) - 1) for s in (0, 19, 38)]

    def __contains__(self, one: int) -> bool:
        return bool(self.test(np.array([one], dtype=np.int64))[0])

    def test(self, ids: np.ndarray) -> np.ndarray:
        out = np.ones(len(ids), dtype=bool)
        for p in self.places(ids):
            out &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out


def id_filter(ids: DataFrame) -> IdFilter:
    """The filter of a one-column frame of longs. Each task fills one of fixed size; they are joined slot by slot."""
    chunk = 1 << 14

    @tidy
    def fill(batches):
        words = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
        for b in batches:
            for p in IdFilter.places(b.column(0).to_numpy(zero_copy_only=False)):
                np.bitwise_or.at(words, p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63)))
        at = [i for i in range(0, len(words), chunk) if words[i : i + chunk].any()]
        slots = [np.flatnonzero(words[i : i + chunk]) + i for i in at]
        flat = np.concatenate(slots) if slots else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(flat.astype(np.int64)), pa.array(words[flat].view(np.int64))], ["slot", "bits"])

    rows = ids.mapInArrow(fill, "slot bigint, bits bigint").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    words[rows["slot"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return IdFilter(words)
