"""N-gram Jaccard join by T-occurrence search, and the groups that its links make.

Two documents link when the Jaccard similarity of their sets of five-word shingles reaches
the threshold. A partner of a document with n shingles must occur in at least T of its n
inverted lists. DivideSkip sets the longest lists aside, merges only the short ones by a
heap, and looks the survivors up in the long lists by binary search.

On a cluster the same division is made twice. Globally, lists of frequent shingles are set
aside: shingles are ordered by how often they occur (counted over all documents in a table
of fixed size, so that frequent ones stand out whatever the input), and only the
lists of the first n - T + 1 shingles of each document are built. Any partner stands in one of
them at a place from which T can still be reached. What these short lists propose is then
searched in groups of one query document and its candidates: an index of the
candidates' shingles, DivideSkip over its lists, and the exact test.

Equal sets are one node from the start, and ``components`` tests a large group of near
copies against leaders, not in all pairs; every link across components is tested.

Shingles and sets go by 64-bit hashes.

Defined cases: null and empty texts, and texts without words, have no shingles, link with
nothing and are their own component; a text of fewer than five words has its whole word
sequence as its one shingle; repeated rows and equal texts link; a document with a null
doc_id takes part, and its component is the smallest doc_id that is not null, or null; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import text as X
from foliant.llm.columns import Apart
from foliant.llm.components import id_filter, link_groups
from foliant.llm.scratch import Scratch, tidy

WIDTH = 5
#: Jaccard threshold in hundredths.
THRESHOLD = 80
#: Counters for frequencies: 2**21, eight megabytes.
COUNT_BITS = 21
#: Shingles of candidates that one local index holds.
BLOCK_SHINGLES = 200_000
#: DivideSkip's weight of a heap step against a binary search.
MU = 0.0085


def overlap_needed(a: int, b: int, threshold: int = THRESHOLD) -> int:
    """The least intersection of sets of sizes a and b at the threshold: 100 i >= t (a + b - i)."""
    return -(-threshold * (a + b) // (100 + threshold))


def divide_skip(lists: list[list[int]], needed: list[int]) -> list[int]:
    """Members that occur in at least ``needed[member]`` of the sorted lists.

    The longest lists are set aside, at most min(needed) - 1 of them; the others are merged by
    a heap; members found often enough there are looked up in the long ones.
    """
    lists = sorted((x for x in lists if x), key=len)
    if not lists:
        return []
    t = min(needed)
    n_long = max(0, min(len(lists), t - 1, int(t / (MU * log2(len(lists[-1]) + 1) + 1))))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    found = []

    def settle(member: int, count: int) -> None:
        want = needed[member]
        if count + len(long) < want:
            return
        left = len(long)
        for x in long:
            if count >= want or count + left < want:
                break
            left -= 1
            i = bisect_left(x, member)
            count += i < len(x) and x[i] == member
        if count >= want:
            found.append(member)

    last, count = -1, 0
    for member in heapq.merge(*short):
        if member == last:
            count += 1
        else:
            if last >= 0:
                settle(last, count)
            last, count = member, 1
    if last >= 0:
        settle(last, count)
    return found


def search(query: np.ndarray, candidates: list[np.ndarray], threshold: int = THRESHOLD) -> list[int]:
    """Which candidates link with the query; all are sorted arrays of shingle hashes."""
    sizes = np.array([len(c) for c in candidates])
    flat = np.concatenate(candidates)
    member = np.repeat(np.arange(len(candidates)), sizes)
    at = np.searchsorted(query, flat)
    at[at == len(query)] = 0
    hit = query[at] == flat
    at, member = at[hit], member[hit]
    order = np.argsort(at, kind="stable")
    at, member = at[order], member[order]
    ends = np.flatnonzero(np.diff(at, append=-1)) + 1
    members = member.tolist()
    lists, start = [], 0
    for e in ends.tolist():
        lists.append(members[start:e])
        start = e
    return divide_skip(lists, [overlap_needed(len(query), int(s), threshold) for s in sizes])


def _shingles(c: X.Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    low = X.lower_ascii(c.data)
    w = X.words(X.Chunk(c.first, low, c.offsets))
    wh = X.hasher(low)(w.start, w.end)
    return X.shingle_hashes(wh, w.bounds, width)


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame, text_col: str, width: int) -> np.ndarray:
    """How often shingles of each hash slot occur; one fixed-size table per task is added up."""
    piece = 1 << 14

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, dtype=np.int64)
        for b in batches:
            for c in X.chunks(b.column(0)):
                h, owner = _shingles(c, width)
                total += np.bincount(_slots(h), minlength=len(total))
        parts = np.minimum(total, (1 << 32) - 1).astype(np.uint32).reshape(-1, piece)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "counts"])

    parts = docs.select(text_col).mapInArrow(count, "part int, counts binary")
    out = np.zeros(1 << COUNT_BITS, dtype=np.int64)
    # 128 rows of fixed size.
    for r in _sum_parts(parts, piece).collect():
        out[r["part"] * piece : (r["part"] + 1) * piece] = np.frombuffer(r["counts"], dtype=np.int64)
    return out


def _sum_parts(parts: DataFrame, piece: int) -> DataFrame:
    @tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if k not in totals:
                    totals[k] = np.zeros(piece, dtype=np.int64)
                totals[k] += np.frombuffer(raw.as_buffer(), dtype=np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], ["part", "counts"])

    return parts.repartition(64, "part").mapInArrow(add, "part int, counts binary")


def frequency_class(counts: np.ndarray) -> np.ndarray:
    """Sixteen steps an octave: enough to order by, in 16 bits."""
    return np.floor(16 * np.log2(np.maximum(counts, 1))).astype(np.uint16)


def _sets(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: int, classes) -> DataFrame:
    """id, n_shingles, uid of the set, and the first shingles of it in global order.

    Of equal sets within a task only the first brings its shingles.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = classes.value
        seen: set[int] = set()
        for b in batches:
            for c in X.chunks(b.column(1)):
                h, owner = _shingles(c, width)
                h, owner = X.distinct(h, owner, table[_slots(h)])
                bounds = np.searchsorted(owner, np.arange(c.n + 1))
                n = np.diff(bounds)
                uid = X.mix(X.sums(X.mix(h + np.uint64(0x51ED270B)), bounds) + n.astype(np.uint64)).view(np.int64)
                length = np.where(n > 0, n - -(-threshold * n // 100) + 1, 0)
                for i, u in enumerate(uid.tolist()):
                    if u in seen:
                        length[i] = 0
                    seen.add(u)
                first = np.arange(len(h)) < (bounds[:-1] + length)[owner]
                cuts = np.concatenate([[0], np.cumsum(length)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.first, c.n), pa.array(n), pa.array(uid), X.lists(h[first], cuts)], [id_col, "n_shingles", "uid", "prefix"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_shingles bigint, uid bigint, prefix array<bigint>")


def _whole_sets(docs: DataFrame, text_col: str, width: int, wanted) -> DataFrame:
    """(uid, shingles): sorted hashes of the sets that the filter lets pass, each at most once a task."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = wanted.value
        seen: set[int] = set()
        for b in batches:
            for c in X.chunks(b.column(0)):
                h, owner = X.distinct(*_shingles(c, width))
                bounds = np.searchsorted(owner, np.arange(c.n + 1))
                n = np.diff(bounds)
                uid = X.mix(X.sums(X.mix(h + np.uint64(0x51ED270B)), bounds) + n.astype(np.uint64)).view(np.int64)
                ids, sets = [], []
                for i in np.flatnonzero(sieve.test(uid) & (n > 0)).tolist():
                    if (u := int(uid[i])) not in seen:
                        seen.add(u)
                        ids.append(u)
                        sets.append(h[bounds[i] : bounds[i + 1]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["uid", "shingles"])

    return docs.select(text_col).mapInArrow(run, "uid bigint, shingles binary")


def _search_groups(threshold: int):
    """Rows (a, b, shingles of a, shingles of b): runs of one query are searched in blocks; linked pairs come out."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, owner, names, block, held = None, None, [], [], 0
        for batch in batches:
            out: list[tuple[int, int]] = []
            for a, b, mine, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if block and (a != owner or held > BLOCK_SHINGLES):
                    out += [(owner, names[i]) for i in search(query, block, threshold)]
                    names, block, held = [], [], 0
                if a != owner:
                    owner, query = a, np.frombuffer(mine.as_buffer(), dtype=np.uint64).copy()
                names.append(b)
                block.append(np.frombuffer(other.as_buffer(), dtype=np.uint64).copy())
                held += len(block[-1])
            yield _pairs(out)
        yield _pairs([(owner, names[i]) for i in search(query, block, threshold)] if block else [])

    return run


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["a", "b"])


def _verifier(docs: DataFrame, text_col: str, width: int, threshold: int, scratch: Scratch):
    """Reads the texts once more for the sets that a round's pairs need, and searches them."""
    held: list[DataFrame] = []

    def verify(pairs: DataFrame) -> DataFrame:
        scratch.drop(*held)
        wanted = docs.sparkSession.sparkContext.broadcast(id_filter(pairs.select("a").union(pairs.select("b"))))
        sets = scratch.save(_whole_sets(docs, text_col, width, wanted).dropDuplicates(["uid"]), "whole")
        held[:] = [sets]
        a = sets.select(F.col("uid").alias("a"), F.col("shingles").alias("sa"))
        b = sets.select(F.col("uid").alias("b"), F.col("shingles").alias("sb"))
        # Joined on the query last, its candidates arrive together; a hot query may be split.
        wide = pairs.join(b, "b").join(a, "a").select("a", "b", "sa", "sb")
        return wide.mapInArrow(_search_groups(threshold), "a bigint, b bigint")

    return verify


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame | None]:
    """id, n_shingles and uid (equal for equal sets) of every row, and (id, root) of the uids with links to others."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    share = spark.sparkContext.broadcast
    classes = share(frequency_class(document_frequencies(docs, text_col, width)))  # four megabytes
    sets = scratch.save(_sets(docs, id_col, text_col, width, threshold, classes), "sets")

    # (key, uid, n, pos) of the short lists, dealt by key once.
    lists = sets.select("uid", F.col("n_shingles").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "key")).repartition("key")
    ends = lists.groupBy("key").agg(*[f(c).alias(a) for f, c, a in ((F.min, "uid", "lo"), (F.max, "uid", "hi"), (F.min, "n", "n0"), (F.max, "n", "n1"), (F.max, "pos", "p1"))], F.count("*").alias("size"))
    # Lists of one set, and of two of sizes that cannot link, are of no use.
    ends = ends.filter("lo <> hi AND p1 >= 0").filter((F.col("size") > 2) | (100 * F.col("n0") >= threshold * F.col("n1"))).select("key")
    shared = lists.join(ends.hint("shuffle_hash"), "key").groupBy("key", F.col("uid").alias("id")).agg(F.max("n").alias("n"), F.max("pos").alias("pos"))
    postings = scratch.save(shared, "postings")
    rows = scratch.save(sets.select(id_col, "n_shingles", "uid"), "rows")
    scratch.drop(sets)

    def compatible(left, right):
        n, m, i, j = left("n"), right("n"), left("pos"), right("pos")
        need = F.ceil(F.lit(threshold) * (n + m) / F.lit(100 + threshold))
        hundred, t = F.lit(100).cast("bigint"), F.lit(threshold).cast("bigint")
        return (hundred * n >= t * m) & (hundred * m >= t * n) & (F.least(n - i, m - j) >= need)

    verify = _verifier(docs, text_col, width, threshold, scratch)
    roots = link_groups(postings, ["n", "pos"], compatible, verify, scratch, star_rounds=1, central=["pos"])
    scratch.drop(postings)
    return rows, roots


def _first_of_groups(rows: DataFrame, roots: DataFrame | None, place: F.Column) -> DataFrame:
    """(uid, first): the least place of each set's group. Places are brought together by set and only then by group."""
    sets = rows.filter("n_shingles > 0").groupBy("uid").agg(F.min(place).alias("first"))
    if roots is None:
        return sets
    r = sets.join(roots.withColumnRenamed("id", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    return r.drop("first").join(r.groupBy("root").agg(F.min("first").alias("first")), "root").select("uid", "first")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """id, n_shingles and component_id of every row."""
    rows, roots = jaccard_groups(docs, id_col, text_col, width, threshold)
    first = _first_of_groups(rows, roots, F.col(id_col))
    joined = rows.join(first, "uid", "left")
    return joined.select(id_col, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("first")).otherwise(F.col(id_col)).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: one row for each row of documents."""
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies the document with the smallest doc_id stays.

    Documents without words are no group. Of rows that repeat a doc_id and a text, which are
    one document, all stay.
    """
    scratch = Scratch(spark, "join-stage")
    own = Apart(docs)
    keyed = own.df.withColumn("_th", F.xxhash64(own["text"]))
    rows, roots = jaccard_groups(docs.select(F.struct("doc_id", F.xxhash64("text").alias("th")).alias("key"), "text"), "key")
    place = F.struct(F.col("key.doc_id").isNull().alias("late"), "key.doc_id", "key.th")
    first = _first_of_groups(rows, roots, place)
    gone = rows.filter("n_shingles > 0").join(first, "uid").filter(~(F.col("key.doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key.th") == F.col("first.th"))))
    gone = gone.select(F.col("key.doc_id").alias("_id"), F.col("key.th").alias("_gone")).distinct()
    return own.back(keyed.join(scratch.save(gone, "gone"), F.col(own["doc_id"]).eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_gone")), "left_anti"))
