"""Review queries: conversation turns stand in for comments, each a reply to the turn before it."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import review, search
from foliant.plans.registry import query, table

AS_OF = datetime.date(2024, 3, 1)
COMMENTS = """comments AS (SELECT conv_id || '-' || turn AS id, CASE WHEN turn > t0 THEN conv_id || '-' || (turn - 1) END AS parent_id, role AS author, text,
CAST(DATE '2024-03-05' - CAST((conv_id * 7 + turn * 3) % 50 AS INTEGER) AS VARCHAR) AS created,
CASE (conv_id + turn) % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'Open' WHEN 2 THEN 'Accepted' ELSE 'Rejected' END AS state, conv_id, turn
FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS t0 FROM conversations))"""


def comments_of(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    c = table(spark, d, "conversations").withColumn("t0", F.min("turn").over(Window.partitionBy("conv_id")))
    n = (F.col("conv_id") * 7 + F.col("turn") * 3) % 50
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.when(F.col("turn") > F.col("t0"), F.concat_ws("-", F.col("conv_id"), F.col("turn") - 1)).alias("parent_id"),
        F.col("role").alias("author"),
        "text",
        F.date_sub(F.lit(datetime.date(2024, 3, 5)), n.cast("int")).cast("string").alias("created"),
        F.element_at(F.array(*map(F.lit, review.REVIEW_STATES[:4])), ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int")).alias("state"),
        "conv_id",
        "turn",
    )


@query("comment_threads", f"""WITH {COMMENTS}, f AS (SELECT * FROM comments WHERE state <> 'Open')
SELECT f.id, p.id AS shown_parent FROM f LEFT JOIN f p ON f.parent_id = p.id""")
def comment_threads(spark: SparkSession, d: str) -> DataFrame:
    """Children of a hidden comment stand at the root."""
    return review.threads(comments_of(spark, d).filter("state <> 'Open'")).select("id", "shown_parent")


@query("comment_depths", f"""WITH RECURSIVE {COMMENTS}, t AS (SELECT id, id AS root, 0 AS depth FROM comments WHERE parent_id IS NULL
UNION ALL SELECT c.id, t.root, t.depth + 1 FROM comments c JOIN t ON c.parent_id = t.id) SELECT id, root, depth FROM t""")
def comment_depths(spark: SparkSession, d: str) -> DataFrame:
    return review.thread_depths(comments_of(spark, d).select("id", "parent_id"))


@query("comment_filter", f"WITH {COMMENTS} SELECT id, state FROM comments WHERE state = 'Accepted' AND author = 'user' AND date_diff('day', CAST(created AS DATE), DATE '2024-03-01') <= 30")
def comment_filter(spark: SparkSession, d: str) -> DataFrame:
    return review.filter_comments(comments_of(spark, d), "Accepted", "Month", "user", AS_OF).select("id", "state")


@query("comment_filter_week", f"WITH {COMMENTS} SELECT id FROM comments WHERE date_diff('day', CAST(created AS DATE), DATE '2024-03-01') <= 7")
def comment_filter_week(spark: SparkSession, d: str) -> DataFrame:
    return review.filter_comments(comments_of(spark, d), within="Week", as_of=AS_OF).select("id")


@query("comment_replies", f"WITH {COMMENTS} SELECT c.id, coalesce(string_agg(r.id, ' ' ORDER BY r.id), '') AS replies FROM comments c LEFT JOIN comments r ON r.parent_id = c.id GROUP BY c.id")
def comment_replies(spark: SparkSession, d: str) -> DataFrame:
    return review.replies(comments_of(spark, d)).select("id", F.array_join("replies", " ").alias("replies"))


@query("comment_authors", "SELECT DISTINCT role AS author FROM conversations")
def comment_authors(spark: SparkSession, d: str) -> DataFrame:
    return review.authors(comments_of(spark, d))


@query("annotation_json", f"""WITH {COMMENTS} SELECT conv_id, to_json({{id: id, author: author, state: state}}) AS json FROM comments""")
def annotation_json(spark: SparkSession, d: str) -> DataFrame:
    return comments_of(spark, d).select("conv_id", F.to_json(F.struct("id", "author", "state")).alias("json"))


_NOTES = """SELECT conv_id, turn, conv_id || '-' || turn AS id, CAST((conv_id + turn) % 24 AS INTEGER) AS mode FROM conversations"""


@query("annotation_import", f"SELECT conv_id, id, mode FROM ({_NOTES}) WHERE mode <= {review.LAST_SAVED_MODE}")
def annotation_import(spark: SparkSession, d: str) -> DataFrame:
    """Written as packages and as bare arrays by turns, and read again."""
    c = table(spark, d, "conversations")
    notes = c.select("conv_id", F.concat_ws("-", "conv_id", "turn").alias("id"), ((F.col("conv_id") + F.col("turn")) % 24).cast("int").alias("mode"))
    packed = review.package(notes, "import", "2024-03-01T00:00:00Z", keys=["conv_id"])
    text = F.when(F.col("conv_id") % 2 == 0, F.col("json")).otherwise(F.get_json_object("json", "$.annotations"))
    return review.from_json(packed.select("conv_id", text.alias("json")), "json").select("conv_id", "id", "mode")


@query("annotation_package", f"""SELECT conv_id, '{{"version":1,"exported_at":"2024-03-01T00:00:00Z","source":"s","annotations":[' || string_agg('{{"id":"' || id || '","mode":' || mode || '}}', ',' ORDER BY id) || ']}}' AS json FROM ({_NOTES}) GROUP BY conv_id""")
def annotation_package(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    notes = c.select("conv_id", F.concat_ws("-", "conv_id", "turn").alias("id"), ((F.col("conv_id") + F.col("turn")) % 24).cast("int").alias("mode"))
    return review.package(notes, "s", "2024-03-01T00:00:00Z", keys=["conv_id"])


@query("bookmark_filter", """WITH RECURSIVE n AS (SELECT conv_id || '-' || turn AS id, CASE WHEN turn > t0 THEN conv_id || '-' || (turn - 1) END AS parent_id, text AS title FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS t0 FROM conversations)),
k AS (SELECT id, parent_id FROM n WHERE contains(lower(title), 'dieü') OR contains(lower(title), 'pathetic') UNION SELECT n.id, n.parent_id FROM n JOIN k ON n.id = k.parent_id)
SELECT DISTINCT id FROM k""")
def bookmark_filter(spark: SparkSession, d: str) -> DataFrame:
    nodes = comments_of(spark, d).select("id", "parent_id", F.col("text").alias("title"))
    a, b = search.keep_ancestors(nodes, "Dieü"), search.keep_ancestors(nodes, "pathetic")
    return a.select("id").union(b.select("id")).distinct()


@query("bookmark_first_hit", """SELECT conv_id || '-' || turn AS id FROM conversations WHERE contains(lower(text), 'the') ORDER BY conv_id, turn LIMIT 1""")
def bookmark_first_hit(spark: SparkSession, d: str) -> DataFrame:
    """Depth-first order: conversations are trees of one branch each."""
    c = comments_of(spark, d)
    nodes = c.select("id", "parent_id", F.when(F.col("parent_id").isNull(), F.col("conv_id")).otherwise(F.col("turn")).alias("ordinal"))
    paths = search.depth_first_path(nodes)
    return c.filter(search.contains(F.col("text"), "THE")).join(paths, "id").orderBy("path").limit(1).select("id")


@query("bookmark_count", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id")
def bookmark_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))


@query("chat_history", """SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text)) AS history_sha256 FROM conversations GROUP BY conv_id""")
def chat_history(spark: SparkSession, d: str) -> DataFrame:
    turn = F.struct("turn", "role", "text")
    rows = table(spark, d, "conversations").filter("text IS NOT NULL").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(turn)).alias("t"))
    return rows.select("conv_id", "n_turns", F.sha2(F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n"), 256).alias("history_sha256"))


@query("recent_files", "SELECT user_id, max(ts) AS last_used FROM events GROUP BY user_id ORDER BY last_used DESC, user_id LIMIT 20")
def recent_files(spark: SparkSession, d: str) -> DataFrame:
    return review.recent(table(spark, d, "events"), "user_id", "ts")


@query("prune_recents", "SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) GROUP BY user_id")
def prune_recents(spark: SparkSession, d: str) -> DataFrame:
    recents = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    existing = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"))
    return review.prune(recents, existing, "user_id")


@query("remove_recent", "SELECT event_id, user_id FROM events WHERE user_id IS DISTINCT FROM 7")
def remove_recent(spark: SparkSession, d: str) -> DataFrame:
    return review.remove_recent(table(spark, d, "events").select("event_id", "user_id"), "user_id", 7)


@query("annotation_package_import", "SELECT event_id AS id, event_type AS mode FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, event_type FROM events WHERE event_id % 6 = 0")
def annotation_package_import(spark: SparkSession, d: str) -> DataFrame:
    """Packages of odd ids are over the limit and refused; ids that are there already come twice."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("mode"))
    n_bytes = F.when(F.col("id") % 2 == 0, 100).otherwise(review.PACKAGE_LIMIT + 1)
    return review.import_package(e.filter("id % 2 = 0"), e.filter("id % 3 = 0"), n_bytes)


@query("annotation_hit_test", """WITH a AS (SELECT c_custkey AS idx, c_nationkey AS page, c_custkey % 97 * 5.0::DOUBLE AS x, c_custkey % 89 * 5.0::DOUBLE AS y FROM customer),
p AS (SELECT s_suppkey AS point_id, s_nationkey AS page, s_suppkey % 83 * 6.0::DOUBLE AS px, s_suppkey % 79 * 6.0::DOUBLE AS py FROM supplier)
SELECT p.page, point_id, max(idx) AS idx FROM p JOIN a ON p.page = a.page AND ((px BETWEEN x AND x + 40 AND py BETWEEN y AND y + 30) OR sqrt((x - px) * (x - px) + (y - py) * (y - py)) < 10) GROUP BY p.page, point_id""")
def annotation_hit_test(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    a = c.select(F.col("c_custkey").alias("idx"), F.col("c_nationkey").alias("page"), (F.col("c_custkey") % 97 * 5.0).alias("x"), (F.col("c_custkey") % 89 * 5.0).alias("y"), F.lit(40.0).alias("w"), F.lit(30.0).alias("h"))
    a = a.withColumn("vertices", F.array(F.struct("x", "y")))
    p = s.select(F.col("s_suppkey").alias("point_id"), F.col("s_nationkey").alias("page"), (F.col("s_suppkey") % 83 * 6.0).alias("px"), (F.col("s_suppkey") % 79 * 6.0).alias("py"))
    return review.hit_test(a, p, ["page"])


@query("stroke_boxes", """SELECT user_id, min(value) AS x, min(event_id) AS y, max(value) - min(value) AS w, CAST(max(event_id) - min(event_id) AS DOUBLE) AS h FROM (SELECT user_id, value, CAST(event_id AS DOUBLE) AS event_id FROM events) GROUP BY user_id""")
def stroke_boxes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.struct(F.col("value").alias("x"), F.col("event_id").cast("double").alias("y"))).alias("points"))
    return e.select("user_id", review.stroke_box(F.col("points")).alias("b")).select("user_id", "b.*")
