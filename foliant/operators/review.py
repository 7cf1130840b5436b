"""Review comments: filters, threads, replies, exchange packages."""

from __future__ import annotations

import datetime
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values, by number.
REVIEW_STATES = ["None", "Open", "Accepted", "Rejected", "Cancelled", "Completed"]
#: Fixed value: annotations with a later mode are dropped when read.
LAST_SAVED_MODE = 20
REDACT_MODE = 12
PACKAGE_LIMIT = 50 * 1024 * 1024
_ANNOTATION = (
    "id: string, parentId: string, page: int, mode: int, author: string, text: string, color: string, creationDate: string, "
    "reviewState: int, rect: struct<x: double, y: double, w: double, h: double>, points: array<struct<x: double, y: double>>"
)


def status_passes(state: Column, wanted: str) -> Column:
    return F.lit(True) if wanted == "All" else state == wanted


def date_passes(created: Column, within: str, as_of: datetime.date) -> Column:
    """Today, last 7 or last 30 days, counted at ``as_of``. What has no date fails; the future passes."""
    if within == "All":
        return F.lit(True)
    days = F.datediff(F.lit(as_of), F.try_to_timestamp(created))
    return F.coalesce(days <= {"Today": 0, "Week": 7, "Month": 30}[within], F.lit(False))


def filter_comments(comments: DataFrame, state: str = "All", within: str = "All", author: str | None = None, as_of: datetime.date | None = None) -> DataFrame:
    out = comments.filter(status_passes(F.col("state"), state))
    if within != "All":
        out = out.filter(date_passes(F.col("created"), within, as_of or datetime.date.today()))
    return out if author is None else out.filter(F.col("author") == author)


def authors(comments: DataFrame) -> DataFrame:
    return comments.select("author").distinct()


def threads(comments: DataFrame) -> DataFrame:
    """Adds shown_parent: the parent if it is among the rows, else null: the comment stands at the root."""
    parents = comments.select(F.col("id").alias("_p"))
    return comments.join(parents, F.col("parent_id") == F.col("_p"), "left").withColumn("shown_parent", F.col("_p")).drop("_p")


def replies(comments: DataFrame) -> DataFrame:
    """(id, replies): distinct ids of direct replies in order; none gives an empty array."""
    kids = comments.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_set(F.col("id"))).alias("replies"))
    # Every parent among the rows once, with replies or without.
    return comments.select("id").distinct().join(kids, "id", "left").withColumn("replies", F.coalesce("replies", F.array().cast("array<string>")))


def unsized(df: DataFrame) -> DataFrame:
    """df, whose size Spark does not guess: a side of a join is broadcast only once it is counted.

    Rows that a table's rows are made into, in Python or by a list of each, are many more and longer than the guess, which a
    checkpoint keeps. A union with no rows of unknown size has an unknown size.
    """
    spark = df.sparkSession
    return df.union(spark.createDataFrame(spark.sparkContext.emptyRDD(), df.schema))


def _cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, without a guess of its size; only a local session that names none gets a folder of its own."""
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(found or f"file://{tempfile.gettempdir()}/foliant-checkpoints")
    return unsized(df.checkpoint())


def thread_depths(comments: DataFrame) -> DataFrame:
    """(id, root, depth) of every comment under a root, however deep: each round doubles the depth that is resolved.

    ``up`` leads from an id to its ancestor ``reach`` levels above. A cycle of unique ids never meets a
    root, so that no round finds anything of it.
    """
    out = comments.filter("parent_id IS NULL").select("id", F.col("id").alias("root"), F.lit(0).alias("depth"))
    up = _cut(comments.filter("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("above")))
    reach = 1
    while True:
        known = out.select(F.col("id").alias("above"), "root", "depth")
        found = _cut(up.join(known, "above").select("id", "root", (F.col("depth") + reach).alias("depth")))
        if found.isEmpty():
            return out
        out = out.union(found)
        up = _cut(up.join(up.select(F.col("id").alias("above"), F.col("above").alias("next")), "above").select("id", F.col("next").alias("above")))
        reach *= 2


def to_json(annotations: DataFrame) -> Column:
    return F.to_json(F.struct(*annotations.columns))


def package(annotations: DataFrame, source: str, exported_at: str, version: int = 1, keys: list[str] | None = None) -> DataFrame:
    """One JSON document for each key (all rows: none) with its annotations in order of id."""
    keys = keys or []
    rows = annotations.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in annotations.columns if c not in ("id", *keys)]))).alias("annotations"))
    body = F.struct(F.lit(version).alias("version"), F.lit(exported_at).alias("exported_at"), F.lit(source).alias("source"), "annotations")
    return rows.select(*keys, F.to_json(body).alias("json"))


def from_json(df: DataFrame, col: str) -> DataFrame:
    """Annotations of an array or of {"annotations": [...]}; rows with a mode outside the saved ones are dropped."""
    kind = f"array<struct<{_ANNOTATION}>>"
    bare, wrapped = F.from_json(col, kind), F.from_json(F.get_json_object(col, "$.annotations"), kind)
    rest = [c for c in df.columns if c != col]
    rows = df.select(*rest, F.explode(F.when(F.ltrim(col).startswith("["), bare).otherwise(wrapped)).alias("a"))
    return rows.select(*rest, "a.*").filter((F.col("mode") >= 0) & (F.col("mode") <= LAST_SAVED_MODE))


def import_package(existing: DataFrame, package_rows: DataFrame, n_bytes: Column) -> DataFrame:
    """Appends without looking for equal ids; packages over the limit are refused."""
    return existing.unionByName(package_rows.filter(n_bytes <= PACKAGE_LIMIT).select(*existing.columns))


def stroke_box(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    x, y = F.array_min(xs), F.array_min(ys)
    return F.struct(x.alias("x"), y.alias("y"), (F.array_max(xs) - x).alias("w"), (F.array_max(ys) - y).alias("h"))


def hit_test(annotations: DataFrame, points: DataFrame, keys: list[str], reach: float = 10.0) -> DataFrame:
    """For each point its topmost annotation: one that holds it, or a stroke with a vertex nearer than ``reach``.

    Of boxes and vertices that lie in the same place only the topmost can be a point's, and points in one place have one answer, so each place is tested once. Places meet by
    the cells of a grid whose width is the least power of two not below the size of the box, of which it touches four at most; a point looks in one cell for each width on its page.
    """
    c = F.col
    held = F.struct(c("x").alias("x0"), c("y").alias("y0"), (c("x") + c("w")).alias("x1"), (c("y") + c("h")).alias("y1"), F.lit(None).cast("double").alias("vx"), F.lit(None).cast("double").alias("vy"))
    # Twice the reach, so that rounding leaves no vertex out.
    around = F.transform("vertices", lambda v: F.struct(*[(v[d].cast("double") + sign * 2 * reach).alias(f"{d}{i}") for i, sign in enumerate((-1, 1)) for d in ("x", "y")], v["x"].cast("double").alias("vx"), v["y"].cast("double").alias("vy")))
    own = F.array(F.struct(*[held[f].cast("double").alias(f) for f in ("x0", "y0", "x1", "y1", "vx", "vy")]))
    shapes = annotations.select(*keys, "idx", F.explode(F.concat(own, F.coalesce(around, F.filter(own, lambda s: F.lit(False))))).alias("_s")).select(*keys, "idx", "_s.*")
    shapes = shapes.filter("x0 <= x1 AND y0 <= y1").groupBy(*keys, "x0", "y0", "x1", "y1", "vx", "vy").agg(F.max("idx").alias("idx"))
    size = F.greatest(c("x1") - c("x0"), c("y1") - c("y0"), F.lit(2.0**-20))
    shapes = shapes.withColumn("_width", F.pow(F.lit(2.0), F.ceil(F.log2(size))))
    cell = lambda v: F.floor(v / c("_width"))
    # Both ends and no sequence: a box touches at most two columns and two rows, but for rounding of its size, which the middle takes up.
    ends = lambda lo, hi: F.array_distinct(F.array(cell(lo), cell(lo + (hi - lo) / 2), cell(hi)))
    shown = shapes.withColumn("_gx", F.explode(ends(c("x0"), c("x1")))).withColumn("_gy", F.explode(ends(c("y0"), c("y1"))))
    widths = shapes.select(*keys, "_width").distinct()
    places = points.select(*keys, "px", "py").distinct().join(widths, keys).withColumns({"_gx": cell(c("px")), "_gy": cell(c("py"))})
    inside = c("vx").isNull() & c("px").between(c("x0"), c("x1")) & c("py").between(c("y0"), c("y1"))
    near = F.hypot(c("vx") - c("px"), c("vy") - c("py")) < reach
    hits = places.join(shown, [*keys, "_width", "_gx", "_gy"]).filter(F.coalesce(inside | near, F.lit(False)))
    best = hits.groupBy(*keys, "px", "py").agg(F.max("idx").alias("idx"))
    return points.join(best, [*keys, "px", "py"]).groupBy(*keys, "point_id").agg(F.max("idx").alias("idx"))


def recent(df: DataFrame, key: str, ts: str, cap: int = 20) -> DataFrame:
    """Latest use of each key, newest first, at most ``cap``: a top-k list."""
    return df.groupBy(key).agg(F.max(ts).alias("last_used")).orderBy(F.col("last_used").desc(), key).limit(cap)


def remove_recent(recents: DataFrame, key: str, value: object) -> DataFrame:
    """All occurrences of one key go; rows without a key stay."""
    return recents.filter(~F.col(key).eqNullSafe(F.lit(value)))


def prune(recents: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return recents.join(existing.select(key).distinct(), key, "left_semi")
