"""Mixing sources to target weights, in DataFrame operations only.

Targets come from capped water-filling: every source gets its weight's share of the
budget, but at most ``max_epochs`` times its own size; what a capped source cannot take
goes to the others by weight. The level at which this settles is found from the sources
sorted by the level that would cap them: one pass of running sums, not a loop.

A source then takes each of its documents floor(target / size) times, and once more those
that come first in a seeded order, until the rest of its target is reached. The order is by
hash; to find where it ends, sizes are summed by hash bucket before anything is shuffled,
and only the documents of each source's one boundary bucket are put in order. No group of
a source's documents ever meets in one task.

Defined cases: a null text, or one without words, has size 0 and takes 0; a null source is a
source of its own, last in order; sources without words have target 0; repeated rows (same
id, text and source) are documents of their own with one place in the order, so they are
taken together; an empty table gives an empty result; extra columns pass through
``mix`` and are not read by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.columns import Apart
from foliant.llm.scratch import Scratch

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
#: Hexadecimal digits of the hash that name a bucket for the running sums: 4096 buckets.
BUCKET_DIGITS = 3
#: Java's white-space class here: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, weight, target from one row per source (source, source_size).

    Weights go round in code-point order, null last. Only the table of sources is ordered
    as a whole.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    levels = Window.orderBy("cap_level", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    w = sizes.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn).cast("double"))
    w = w.withColumn("cap", F.col("source_size").cast("double") * max_epochs).withColumn("cap_level", F.col("cap") / F.col("weight"))
    w = w.withColumns({
        "total": F.sum("source_size").over(everything).cast("double"),
        "capped": F.coalesce(F.sum("cap").over(levels), F.lit(0.0)),
        "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(levels), F.lit(0.0)),
    })
    # Sources in order of the level that caps them: the first whose level is not below the
    # level reached with all before it capped sets the water level.
    w = w.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    w = w.withColumn("water", F.min(F.when(F.col("cap_level") >= F.col("level"), F.struct("cap_level", "level"))).over(everything)["level"])
    # Without words no level is reached; every cap is 0 then.
    return w.select("source", "source_size", "weight", F.least("cap", F.col("weight") * F.coalesce("water", F.lit(0.0))).alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """docs with the size, the place in the seeded order and its bucket."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(source_col), F.lit("")))
    d = docs.withColumn("_size", size_of(F.col(text_col))).withColumn("_place", F.md5(key.cast("binary")))
    return d.withColumn("_bucket", F.substring("_place", 1, BUCKET_DIGITS))


def _plan(sized: DataFrame, source_col: str, weights: tuple[int, ...], max_epochs: int, scratch: Scratch) -> DataFrame:
    """One row per source: its target, how often it takes all, and where its last round ends.

    Written as tables of a row per source, so that Spark sees their size and sends them to
    all tasks only while they are small.
    """
    buckets = scratch.save(sized.groupBy(F.col(source_col).alias("source"), F.col("_bucket").alias("bucket")).agg(F.sum("_size").alias("words")), "buckets")
    aims = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    aims = aims.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint"))
    aims = scratch.save(aims.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "aims")

    running = Window.partitionBy("source").orderBy("bucket")
    a = aims.select(F.col("source").alias("aim_source"), "rest")
    ends = buckets.withColumn("upto", F.sum("words").over(running)).join(a, _same(F.col("source"), F.col("aim_source"))).filter(F.col("upto") > F.col("rest"))
    # The bucket in which the rest ends, and how much of the rest is left for it.
    ends = ends.groupBy("source").agg(F.min(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("words")).alias("left"))).alias("end"))
    ends = scratch.save(ends.select(F.col("source").alias("end_source"), "end"), "ends")

    edge = sized.select(F.col(source_col).alias("source"), "_bucket", "_place", "_size")
    edge = edge.join(ends, _same(F.col("source"), F.col("end_source")) & (F.col("_bucket") == F.col("end.bucket")))
    # Repeated rows have one place together.
    places = edge.groupBy("source", F.col("end.left").alias("left"), "_place").agg(F.sum("_size").alias("words"))
    places = places.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("_place")))
    # A document is taken if at least half of it still fits.
    last = places.filter(F.col("upto") - F.col("words") / 2 <= F.col("left")).groupBy(F.col("source").alias("last_source")).agg(F.max("_place").alias("last_place"))

    plan = aims.withColumnRenamed("source", "aim_source").join(ends, _same(F.col("aim_source"), F.col("end_source")), "left").join(last, _same(F.col("aim_source"), F.col("last_source")), "left")
    return scratch.save(plan.select("aim_source", F.struct("source_size", "target", "whole", F.col("end.bucket").alias("bucket"), F.col("last_place").alias("last")).alias("_aim")), "plan")


def _taken(placed: DataFrame, plan: DataFrame, source_col: str, keep: list[str]) -> DataFrame:
    out = placed.join(plan.withColumnRenamed("aim_source", "_aim_source"), _same(F.col(source_col), F.col("_aim_source")), "left")
    before = (F.col("_bucket") < F.col("_aim.bucket")) | ((F.col("_bucket") == F.col("_aim.bucket")) & (F.col("_place") <= F.col("_aim.last")))
    # Without an end bucket the rest is the whole source or nothing.
    times = F.when(F.col("_size") > 0, F.col("_aim.whole") + F.coalesce(before, F.lit(False)).cast("bigint")).otherwise(F.lit(0))
    return out.select(*keep, "_size", F.col("_aim.source_size").alias("_source_size"), F.col("_aim.target").alias("_target"), times.cast("bigint").alias("_times"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
) -> DataFrame:
    """docs with _size, _source_size, _target and _times: how often the mix takes each document."""
    scratch, own = Scratch(docs.sparkSession, "mix"), Apart(docs)
    placed, source = _placed(own.df, own[id_col], own[text_col], own[source_col], seed), own[source_col]
    sized = scratch.save(placed.select(source, "_size", "_place", "_bucket"), "sizes")
    plan = _plan(sized, source, weights, max_epochs, scratch)
    return own.back(_taken(placed, plan, source, own.df.columns), {c: F.col(c) for c in ("_size", "_source_size", "_target", "_times")})


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The same without the texts, which are read once."""
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.save(_placed(docs, id_col, text_col, source_col, SEED).select(id_col, source_col, "_size", "_place", "_bucket"), "sizes")
    return _taken(sized, _plan(sized, source_col, WEIGHTS, MAX_EPOCHS, scratch), source_col, [id_col])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: one row for each row of documents."""
    mixed = mix_sizes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_times")).alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it."""
    own = Apart(docs)
    mixed = mix(own.df, own["doc_id"], own["text"], own["source"])
    return own.back(mixed.withColumn("_i", F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int")))))


def oracle() -> str:
    weights = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                  md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(source, '')) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS n FROM d GROUP BY source),
w AS (SELECT source, n, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} {weights} END AS DOUBLE) AS w FROM s),
c AS (SELECT *, {MAX_EPOCHS} * n AS cap, {MAX_EPOCHS} * n / w AS cap_level, sum(n) OVER () AS total, sum(w) OVER () AS all_w FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER o, 0)) / (all_w - coalesce(sum(w) OVER o, 0)) AS level FROM c
      WINDOW o AS (ORDER BY cap_level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, n, least(cap, w * coalesce((SELECT level FROM l WHERE cap_level >= level ORDER BY cap_level, level LIMIT 1), 0)) AS target FROM l),
a AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS whole FROM t),
p AS (SELECT source, place, sum(size) AS words FROM d GROUP BY source, place),
r AS (SELECT source, place, words, sum(words) OVER (PARTITION BY source ORDER BY place) AS upto FROM p),
m AS (SELECT r.source, max(place) AS last FROM r JOIN a ON r.source IS NOT DISTINCT FROM a.source WHERE upto - words / 2 <= target - whole * n GROUP BY r.source)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, CAST(a.n AS BIGINT) AS source_size, a.target,
       CAST(CASE WHEN d.size = 0 THEN 0 ELSE d.size * (a.whole + CASE WHEN place <= last THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source LEFT JOIN m ON d.source IS NOT DISTINCT FROM m.source"""
