"""Phrase collocations from position bitmaps.

Texts are cut into shards of some megabytes. In a shard every place of a word has a position,
with an empty one between pieces, and every word has the set of its positions: words that fill
more than one in ``DENSE`` positions as a packed bitmap, the others as a list of positions, as
compressed bitmaps do. A bitmap is shifted by one and ANDed with that of the next word, and the
bits that are left, counted, are the occurrences of the longer phrase; packed bitmaps are extended
depth first, and a list meets the positions of all other words in one look-up, as a position
has one word. Counts of all shards are summed.

A phrase of m words is as rare as its parts, so shards extend only what may be frequent
everywhere: before each length, the phrases of the length before that reach the least count go
into a sieve of bounded size. What it lets through wrongly is removed by the summed counts.

Words travel as 64-bit hashes of language and word, so counts are exact up to collisions of these;
phrases are spelled out at the end, only those that are first in their language.

Defined cases: a null text counts as empty, a null language as ``und``; a text without words adds
nothing; a very long text is cut into shards where pieces end, so only a single piece is ever whole;
repeated rows, null ids and copies count each; ties are broken by score, count and phrase in that
order; an empty table gives an empty result; extra columns are not read. Languages that differ in
case are different. Counts up to 10**14 are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm import text as X
from foliant.llm.scratch import Scratch
from foliant.llm.sieve import Sieve, sieve

LONGEST = 3
LEAST = 10
#: A phrase goes if a longer one around it has so many of a hundred of its occurrences.
COVERED = 50
TOP = 2000
UNKNOWN = "und"
SHARD_BYTES = 2 << 20
#: Bytes of texts of a batch that goes to a Python worker here.
BATCH_BYTES = 4 << 20
#: Rows of a batch that goes back to Spark.
OUT_ROWS = 1 << 16
#: Of so many positions one is filled by a word whose set is a packed bitmap.
DENSE = 32
#: Parts in which the rows of a language are ranked before they are ranked together.
RANK_PARTS = 64

_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = True
_WORD = ~_BREAKS
_WORD[[0x20, 0x09]] = False


def _hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    chunk = next(X.chunks(words, 1 << 62), None)
    return X.hasher(chunk.data)(chunk.offsets[:-1], chunk.offsets[1:]) if chunk is not None else np.zeros(0, dtype=np.uint64)


def _all_hashes(words: pa.Array) -> np.ndarray:
    parts = [_hashes(words.slice(at, 65_000)) for at in range(0, len(words), 65_000)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def _in_language(h: np.ndarray, lang: str) -> np.ndarray:
    return X.mix(h + X.mix(_hashes(pa.array([lang])) ^ np.uint64(0xD1B54A32D192ED03))[0])


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word."""
    return X.mix(h * np.uint64(0x9E3779B97F4A7C15) + word)


def _shards(texts: pa.Array, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of texts in shards of about ``limit`` bytes; longer texts are cut where a piece ends."""
    for c in X.chunks(texts, limit):
        at, end = 0, len(c.data)
        while end - at > limit:
            breaks = np.flatnonzero(_BREAKS[c.data[at : at + limit]])
            cut = at + int(breaks[-1]) + 1 if len(breaks) else at + limit
            while not len(breaks) and cut < end:
                breaks = np.flatnonzero(_BREAKS[c.data[cut : cut + limit]])
                cut = cut + int(breaks[0]) + 1 if len(breaks) else min(cut + limit, end)
            yield c.data[at:cut], np.array([0, cut - at])
            at = cut
        if at < end:
            yield c.data[at:], np.maximum(c.offsets - at, 0)


class Shard:
    """The words of some texts, which of them stand at which position, and their position sets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        data = X.lower_ascii(data)
        inside = _WORD[data]
        w = X.spans(inside, offsets)
        at = np.zeros(len(w.start) + 1, dtype=np.int32)
        np.cumsum(w.end - w.start, out=at[1:])
        found = pa.StringArray.from_buffers(len(w.start), pa.py_buffer(at), pa.py_buffer(data[inside])).dictionary_encode()
        self.words, ids = found.dictionary, found.indices.to_numpy()
        self.n, self.counts = len(ids), np.bincount(ids, minlength=len(found.dictionary))
        # A piece ends with its text, or where a break stands between two words.
        breaks = np.flatnonzero(_BREAKS[data])
        piece = np.searchsorted(breaks, w.start)
        new = (np.diff(piece, prepend=-1) > 0) | (np.diff(w.text, prepend=-1) > 0)
        position = np.arange(self.n) + np.cumsum(new)
        self.owner = np.full(int(position[-1]) + 2 if self.n else 0, -1, dtype=np.int32)
        self.owner[position] = ids

    def keep(self, wanted: np.ndarray) -> None:
        """Empty the sets of words that are not wanted."""
        self.owner[(self.owner >= 0) & ~wanted[self.owner]] = -1

    def packed(self, word: int) -> np.ndarray:
        bits = np.packbits(self.owner == word, bitorder="little")
        return np.pad(bits, (0, -len(bits) % 8)).view(np.uint64)


def _shift(bits: np.ndarray) -> np.ndarray:
    """A bitmap with every bit one position on."""
    out = bits << np.uint64(1)
    out[1:] |= bits[:-1] >> np.uint64(63)
    return out


def _packed_phrases(shard: Shard, dense: np.ndarray, h: np.ndarray, sieves: list[Sieve], length: int) -> Iterator[tuple[list[int], int]]:
    """Phrases of so many words, all with packed bitmaps, and their counts, depth first."""
    maps = {int(w): shard.packed(w) for w in dense}

    def grow(phrase: list[int], bits: np.ndarray, so_far: np.ndarray) -> Iterator[tuple[list[int], int]]:
        moved = _shift(bits)
        for w, other in maps.items():
            both = moved & other
            n = int(np.bitwise_count(both).sum())
            if not n:
                continue
            longer, key = [*phrase, w], _longer(so_far, h[[w]])
            if len(longer) == length:
                yield longer, n
            elif sieves[len(longer) - 1].test(key)[0]:
                yield from grow(longer, both, key)

    for w, bits in maps.items():
        yield from grow([w], bits, h[[w]])


def _listed_phrases(shard: Shard, dense: np.ndarray, h: np.ndarray, sieves: list[Sieve], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of so many words of which one at least is listed: word ids, a row a phrase, and counts."""
    o = shard.owner
    begin = np.flatnonzero(o >= 0)
    key = h[o[begin]]
    packed = np.zeros(len(h) + 1, dtype=bool)  # its last entry, for empty positions, stays false
    packed[dense] = True
    kept = np.ones(len(begin), dtype=bool)
    for m in range(2, length + 1):
        # A phrase of m words stands where its first m - 1 and its last m - 1 words may be frequent.
        both = np.flatnonzero(kept[:-1] & kept[1:] & (np.diff(begin) == 1)) if len(begin) > 1 else np.zeros(0, dtype=np.int64)
        key, begin = _longer(key[both], h[o[begin[both] + m - 1]]), begin[both]
        kept = sieves[m - 1].test(key) if m < length else np.ones(len(begin), dtype=bool)
    some = ~np.logical_and.reduce([packed[o[begin + i]] for i in range(length)])
    begin = begin[some]
    # Words are numbered from the left: the code of a phrase is that of its start and its last word.
    code, parts = o[begin].astype(np.int64), []
    for i in range(1, length):
        code, back = np.unique(code, return_inverse=True)
        parts.append(code)
        code = back * len(h) + o[begin + i]
    code, n = np.unique(code, return_counts=True)
    ids = []
    for part in reversed(parts):
        ids.append(code % len(h))
        code = part[code // len(h)]
    return np.stack([code, *reversed(ids)], axis=1), n


def _phrases_of(shard: Shard, h: np.ndarray, sieves: list[Sieve], length: int, dense_share: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of so many words that may be frequent: word ids, a row a phrase, and counts."""
    dense = np.flatnonzero(sieves[0].test(h) & (shard.counts * dense_share > len(shard.owner)))
    packed = list(_packed_phrases(shard, dense, h, sieves, length))
    listed, n = _listed_phrases(shard, dense, h, sieves, length)
    ids = np.concatenate([np.array([p for p, _ in packed], dtype=np.int64).reshape(-1, length), listed])
    return ids, np.concatenate([np.array([c for _, c in packed], dtype=np.int64), n])


def _shards_of(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[tuple[str, Shard, np.ndarray]]:
    """Each shard with words, its language and the hashes of its words."""
    for b in batches:
        # A few rows at a time, so that what is made of them is small and given back.
        for c in X.chunks(b.column(1), shard_bytes):
            rows = b.slice(c.first, c.n)
            langs = rows.column(0)
            for lang in pc.unique(langs).to_pylist():
                for data, offsets in _shards(rows.column(1).filter(pc.equal(langs, lang)), shard_bytes):
                    shard = Shard(data, offsets)
                    if shard.n:
                        yield lang, shard, _in_language(_all_hashes(shard.words), lang)
        pa.default_memory_pool().release_unused()


def _out(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    t = pa.table(columns)
    yield from t.to_batches(max_chunksize=OUT_ROWS)


def _longs(m: int) -> list[str]:
    return [f"h{i}" for i in range(m)]


def words(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, h0, f: how often each word stands, by its hash; a row whose h0 is null has the number of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, shard, h in _shards_of(batches, shard_bytes):
            ids = pa.concat_arrays([pa.array(h.view(np.int64)), pa.array([None], pa.int64())])
            yield from _out({"lang": pa.array([lang] * len(ids), pa.string()), "h0": ids, "f": pa.array(np.append(shard.counts, shard.n), pa.int64())})

    return docs.mapInArrow(run, "lang string, h0 bigint, f bigint").groupBy("lang", "h0").agg(F.sum("f").alias("f"))


def counts(docs: DataFrame, length: int, sieves: list, shard_bytes: int = SHARD_BYTES, dense_share: int = DENSE) -> DataFrame:
    """h0, ..., f: counts of phrases of so many words that pass the sieves (broadcast, one for each shorter length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [s.value for s in sieves]
        for _, shard, h in _shards_of(batches, shard_bytes):
            shard.keep(known[0].test(h))
            ids, n = _phrases_of(shard, h, known, length, dense_share)
            longs = h.view(np.int64)
            yield from _out({c: pa.array(longs[ids[:, i]]) for i, c in enumerate(_longs(length))} | {"f": pa.array(n, pa.int64())})

    kinds = ", ".join(f"{c} bigint" for c in _longs(length))
    return docs.mapInArrow(run, f"{kinds}, f bigint").groupBy(*_longs(length)).agg(F.sum("f").alias("f"))


def names(docs: DataFrame, longest: int, sieves: list, shard_bytes: int = SHARD_BYTES, dense_share: int = DENSE) -> DataFrame:
    """w, phrase: the words of phrases of two words or more that pass all sieves, the last of which is of wanted phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *known, wanted = [s.value for s in sieves]
        for _, shard, h in _shards_of(batches, shard_bytes):
            shard.keep(known[0].test(h))
            for m in range(2, longest + 1):
                ids, _ = _phrases_of(shard, h, known, m, dense_share)
                key = h[ids[:, 0]]
                for i in range(1, m):
                    key = _longer(key, h[ids[:, i]])
                ids = ids[wanted.test(key)]
                flat = pa.array(h[ids].ravel().view(np.int64))
                phrase = pc.binary_join_element_wise(*[shard.words.take(pa.array(ids[:, i])) for i in range(m)], " ")
                yield from _out({"w": pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * m), flat), "phrase": phrase})

    return docs.mapInArrow(run, "w array<bigint>, phrase string").groupBy("w").agg(F.min("phrase").alias("phrase"))


def _ids(phrases: DataFrame) -> DataFrame:
    """The hash of every w, as shards know it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = b.column(0)
            flat, at = w.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate([[0], np.cumsum(pc.list_value_length(w).to_numpy())]).astype(np.int64)
            sizes, h = np.diff(at), flat[at[:-1]] if len(w) else np.zeros(0, dtype=np.uint64)
            for i in range(1, int(sizes.max()) if len(w) else 0):
                more = sizes > i
                h[more] = _longer(h[more], flat[at[:-1][more] + i])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["id"])

    return phrases.select("w").mapInArrow(run, "id bigint")


def _exact(c: Column) -> Column:
    """A count as a decimal: a million times its square, and the product of two, stay within 38 digits."""
    return c.cast("decimal(14,0)")


def _scored(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """w, a, l, r, score, lang: of each candidate (w, f) the cut that scores least; frequent (w, f, lang of single words)."""
    w = F.col("w")
    cuts = candidates.select("w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size(w) - 1)).alias("k"))
    halves = F.explode(F.array(F.struct(F.lit(True).alias("left"), F.slice(w, F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("left"), F.slice(w, F.col("k") + 1, F.size(w) - F.col("k")).alias("part"))))
    parts = cuts.select("w", "a", "k", halves.alias("half")).select("w", "a", "k", "half.left", "half.part")
    known = frequent.select(w.alias("part"), "f", "lang")
    cut = parts.join(known, "part").groupBy("w", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"), F.max("lang").alias("lang"))
    cut = cut.withColumn("top", F.lit(1_000_000).cast("decimal(7,0)") * _exact(F.col("a")) * _exact(F.col("a"))).withColumn("under", _exact(F.col("l")) * _exact(F.col("r")))
    cut = cut.withColumn("score", F.expr("top div under"))
    best = cut.groupBy("w", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"), F.max("lang").alias("lang"))
    return best.select("w", "a", "best.l", "best.r", "best.score", "lang")


def _covered(candidates: DataFrame) -> DataFrame:
    """w, most: the largest count of a longer candidate around a phrase of two words or more."""
    w = F.col("w")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size(w) - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.slice(w, i, n))))
    return candidates.filter(F.size(w) > 2).select("f", F.explode(inner).alias("w")).groupBy("w").agg(F.max("f").alias("most"))


def _firsts(scored: DataFrame, top: int, order: list[Column], number: Column) -> DataFrame:
    """Rows of each language whose number in the order is at most ``top``: in parts first, so that no task sorts all of a language."""
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("w"), F.lit(RANK_PARTS))).orderBy(*order)
    some = scored.withColumn("rank", number.over(parts)).filter(F.col("rank") <= top)
    return some.withColumn("rank", number.over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)


def phrases(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, top: int = TOP,
    shard_bytes: int = SHARD_BYTES, dense_share: int = DENSE,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of two to ``longest`` words of each language."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "phrases")
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, str(BATCH_BYTES))
    try:
        best, totals = _best(docs, scratch, lang_col, text_col, longest, least, covered, top, shard_bytes, dense_share)
    finally:
        spark.conf.set(size, before)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _best(
    docs: DataFrame, scratch: Scratch, lang_col: str, text_col: str, longest: int, least: int, covered: int, top: int, shard_bytes: int, dense_share: int
) -> tuple[DataFrame, DataFrame]:
    """The first phrases of each language, and how many words it has; all passes over the texts are done."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(lang_col, F.lit(UNKNOWN)).alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"))
    all_words = scratch.save(words(docs, shard_bytes).filter(F.col("h0").isNull() | (F.col("f") >= least)), "words")
    totals = all_words.filter("h0 IS NULL").select("lang", F.col("f").alias("n"))
    frequent = all_words.filter("h0 IS NOT NULL").select(F.array("h0").alias("w"), "f", "lang")
    candidates, level, sieves = None, frequent, []
    for m in range(2, longest + 1):
        sieves.append(spark.sparkContext.broadcast(sieve(_ids(level))))
        level = counts(docs, m, sieves, shard_bytes, dense_share).filter(F.col("f") >= least)
        level = scratch.save(level.select(F.array(*_longs(m)).alias("w"), "f", F.lit(None).cast("string").alias("lang")), f"frequent-{m}")
        candidates = level if candidates is None else candidates.unionByName(level)
    kept = candidates.join(_covered(candidates), "w", "left").filter(F.coalesce(F.col("most"), F.lit(0)) * 100 < F.col("f") * covered).select("w", "f")
    order = [F.desc("score"), F.desc("a")]
    # Of equals at the end all stay until their words are known.
    first = scratch.save(_firsts(_scored(kept, frequent.unionByName(candidates)), top, order, F.rank()), "first")
    wanted = spark.sparkContext.broadcast(sieve(_ids(first)))
    named = scratch.save(names(docs, longest, [*sieves, wanted], shard_bytes, dense_share), "names")
    for s in [*sieves, wanted]:
        s.unpersist()
    return _firsts(first.join(named, "w"), top, [*order, F.asc("phrase")], F.row_number()), totals


def oracle() -> str:
    """The query's SQL; it needs no pruning, and counts every phrase."""
    return rf"""
WITH p AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
s AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM w WHERE len(w) > 0),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM s, (SELECT unnest(generate_series(1, {LONGEST})) AS m) WHERE i + m - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE m > 1 AND f >= {LEAST}),
inner_ AS (SELECT lang, m, f, w, unnest(generate_series(2, m - 1)) AS k FROM c WHERE m > 2),
inside AS (SELECT lang, f, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT *, unnest(generate_series(1, m - k + 1)) AS i FROM inner_)),
most AS (SELECT lang, phrase, max(f) AS most FROM inside GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN most USING (lang, phrase) WHERE coalesce(most, 0) * 100 < f * {COVERED}),
cuts AS (SELECT lang, phrase, f AS a, w, m, unnest(generate_series(1, m - 1)) AS k FROM kept),
scored AS (SELECT u.lang, u.phrase, u.a, k, x.f AS l, y.f AS r, CAST((CAST(1000000 AS HUGEINT) * u.a * u.a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score FROM cuts u
           JOIN g x ON x.lang = u.lang AND x.phrase = array_to_string(u.w[1:k], ' ') JOIN g y ON y.lang = u.lang AND y.phrase = array_to_string(u.w[k + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN n USING (lang) QUALIFY rank <= {TOP}"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the first 2,000 phrases of each language of documents."""
    return phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))
