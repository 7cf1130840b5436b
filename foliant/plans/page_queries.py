"""Queries over pages: document texts cut into pages of 20 lines, and into pages of 3 lines for short ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import strings
from foliant.operators import pages
from foliant.plans.registry import query, table

LINES = """lines AS (SELECT doc_id, CAST((g - 1) // 20 AS INTEGER) AS page_no, CAST(g - 1 AS INTEGER) AS line_no, l AS text
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS g FROM documents WHERE text IS NOT NULL))"""
PAGES = f"""{LINES.replace("// 20", "// 3")},
pages AS (SELECT doc_id, page_no, string_agg(text, chr(10) ORDER BY line_no) AS text, 0 AS rotation FROM lines GROUP BY doc_id, page_no)"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.pages_of(table(spark, d, "documents"), 3)


def _digest(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.sha2("text", 256).alias("text_sha256"))


@query("document_lines", f"WITH {LINES} SELECT doc_id, page_no, line_no, length(text) AS n_chars FROM lines")
def document_lines(spark: SparkSession, d: str) -> DataFrame:
    return pages.lines_of(table(spark, d, "documents")).select("doc_id", "page_no", "line_no", F.length("text").cast("bigint").alias("n_chars"))


@query("document_pages", f"WITH {PAGES} SELECT doc_id, page_no, sha256(text) AS text_sha256 FROM pages")
def document_pages(spark: SparkSession, d: str) -> DataFrame:
    return _digest(_pages(spark, d), "doc_id", "page_no")


@query("merge_pages", f"""WITH {PAGES}
SELECT 0 AS input, doc_id, page_no, sha256(text) AS text_sha256 FROM pages UNION ALL SELECT 1, doc_id, page_no, sha256(text) FROM pages""")
def merge_pages(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d)
    return _digest(pages.merge([p, p]), "input", "doc_id", "page_no")


@query("extract_pages", f"WITH {PAGES} SELECT doc_id, page_no - 1 AS page_no, sha256(text) AS text_sha256 FROM pages WHERE page_no BETWEEN 1 AND 2")
def extract_pages(spark: SparkSession, d: str) -> DataFrame:
    return _digest(pages.extract(_pages(spark, d), 1, 2), "doc_id", "page_no")


@query("delete_pages", f"""WITH {PAGES}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no) - 1 AS INTEGER) AS page_no, sha256(text) AS text_sha256 FROM pages WHERE page_no NOT BETWEEN 1 AND 2""")
def delete_pages(spark: SparkSession, d: str) -> DataFrame:
    return _digest(pages.delete(_pages(spark, d), 1, 2), "doc_id", "page_no")


@query("insert_blank", f"""WITH {PAGES}
SELECT doc_id, CASE WHEN page_no >= 2 THEN page_no + 1 ELSE page_no END AS page_no, sha256(text) AS text_sha256 FROM pages
UNION ALL SELECT doc_id, CAST(least(count(*), 2) AS INTEGER), sha256('') FROM pages GROUP BY doc_id""")
def insert_blank(spark: SparkSession, d: str) -> DataFrame:
    return _digest(pages.insert_blank(_pages(spark, d), 2), "doc_id", "page_no")


@query("reorder_pages", f"""WITH {PAGES}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM pages)
SELECT doc_id, CASE WHEN n <= 2 THEN page_no WHEN page_no = 0 THEN 2 WHEN page_no <= 2 THEN page_no - 1 ELSE page_no END AS page_no, sha256(text) AS text_sha256 FROM n""")
def reorder_pages(spark: SparkSession, d: str) -> DataFrame:
    return _digest(pages.reorder(_pages(spark, d), 0, 2), "doc_id", "page_no")


@query("rotate_pages", f"WITH {PAGES} SELECT doc_id, page_no, CASE WHEN page_no BETWEEN 1 AND 3 THEN (rotation - 450) % 360 ELSE rotation END AS rotation FROM pages")
def rotate_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.rotate(_pages(spark, d), 1, 3, -450).select("doc_id", "page_no", "rotation")


@query("crop_resize_pages", """SELECT doc_id, 10.0::DOUBLE + 5.0::DOUBLE AS x, greatest(612.0::DOUBLE - 5.0 - (n_chars % 700), 0) AS crop_w, CAST(n_chars % 900 AS DOUBLE) AS new_w FROM documents""")
def crop_resize_pages(spark: SparkSession, d: str) -> DataFrame:
    lit = lambda v: F.lit(float(v))
    box = F.struct(lit(10).alias("x"), lit(20).alias("y"), lit(612).alias("w"), lit(792).alias("h"))
    docs = table(spark, d, "documents").withColumn("box", box)
    cropped = pages.crop(F.col("box"), lit(5), lit(0), (F.col("n_chars") % 700).cast("double"), lit(0))
    resized = pages.resize(F.col("box"), (F.col("n_chars") % 900).cast("double"), lit(792))
    return docs.select("doc_id", cropped["x"].alias("x"), cropped["w"].alias("crop_w"), resized["w"].alias("new_w"))


@query("page_range_parse", """
WITH o AS (SELECT o_orderkey, o_orderkey % 9 AS a, o_custkey % 14 AS b, o_custkey % 12 + 1 AS c, 4 + o_orderkey % 7 AS n FROM orders),
p AS (SELECT o_orderkey, list_concat(generate_series(greatest(a, 1) - 1, least(b, n) - 1), CASE WHEN c <= n THEN [c - 1] ELSE [] END) AS p FROM o)
SELECT o_orderkey, array_to_string(list_sort(list_distinct(p)), ' ') AS pages FROM p""")
def page_range_parse(spark: SparkSession, d: str) -> DataFrame:
    """Specifications such as "3-7,2" with bad parts between, of documents of 4 to 10 pages."""
    a, b, c = F.col("o_orderkey") % 9, F.col("o_custkey") % 14, F.col("o_custkey") % 12 + 1
    spec = F.concat(a.cast("string"), F.lit(" - "), b.cast("string"), F.lit(", x,3-,"), c.cast("string"), F.lit(","), c.cast("string"))
    found = pages.page_range(spec, (4 + F.col("o_orderkey") % 7).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(found.cast("array<string>"), " ").alias("pages"))


@query("page_range_clamp", """SELECT o_orderkey, CASE WHEN a <= 0 THEN 1 ELSE a END AS first, CASE WHEN b <= 0 OR b > n THEN n ELSE b END AS last
FROM (SELECT o_orderkey, o_custkey % 7 - 2 AS a, o_orderkey % 13 - 3 AS b, CAST(8 AS BIGINT) AS n FROM orders)""")
def page_range_clamp(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 7 - 2).alias("a"), (F.col("o_orderkey") % 13 - 3).alias("b"))
    first, last = pages.clamp_range(F.col("a"), F.col("b"), F.lit(8).cast("bigint"))
    return o.select("o_orderkey", first.alias("first"), last.alias("last"))


@query("bates_labels", f"""WITH {PAGES}, n AS (SELECT doc_id, page_no, CAST(99998 + row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS VARCHAR) AS s FROM pages)
SELECT doc_id, page_no, 'PROD' || lpad(s, CAST(greatest(length(s), 6) AS INTEGER), '0') || '-C' AS label FROM n""")
def bates_labels(spark: SparkSession, d: str) -> DataFrame:
    return pages.bates(_pages(spark, d), ["page_no"], "PROD", "-C", 6, start=99999).select("doc_id", "page_no", "label")


_BATES = ", ".join(f"({i}, '{n}', '{p}', '{s}', {k}, '{at}')" for i, (n, p, s, k, at) in enumerate(pages.BATES_PRESETS))


@query("bates_presets", f"""WITH {PAGES}, n AS (SELECT doc_id, page_no, CAST(9998 + row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS VARCHAR) AS s FROM pages)
SELECT doc_id, page_no, name, prefix || lpad(s, CAST(greatest(length(s), digits) AS INTEGER), '0') || suffix AS label, place
FROM n JOIN (VALUES {_BATES}) t(position, name, prefix, suffix, digits, place) ON position = doc_id % {len(pages.BATES_PRESETS)}""")
def bates_presets(spark: SparkSession, d: str) -> DataFrame:
    """The pages of every document numbered by one of the presets."""
    kind = "struct<name: string, prefix: string, suffix: string, digits: int, place: string>"
    preset = F.get(F.array(*[F.struct(*map(F.lit, p)).cast(kind) for p in pages.BATES_PRESETS]), (F.col("doc_id") % len(pages.BATES_PRESETS)).cast("int"))
    out = pages.bates(_pages(spark, d).withColumn("preset", preset), ["page_no"], F.col("preset.prefix"), F.col("preset.suffix"), F.col("preset.digits"), start=9999)
    return out.select("doc_id", "page_no", "preset.name", "label", "preset.place")


@query("header_footer", f"WITH {PAGES} SELECT doc_id, page_no, 'Page ' || (page_no + 1) || ' of ' || count(*) OVER (PARTITION BY doc_id) AS footer FROM pages")
def header_footer(spark: SparkSession, d: str) -> DataFrame:
    return pages.header_footer(_pages(spark, d), "Page {page} of {total}").select("doc_id", "page_no", "footer")


@query("split_every_n", f"""WITH {PAGES}, s AS (SELECT doc_id, page_no // 2 AS part, count(*) AS n_pages FROM pages GROUP BY 1, 2)
SELECT doc_id, CAST(part AS INTEGER) AS part, n_pages, 'doc' || doc_id || '_' || (part + 1) || '.pdf' AS name FROM s""")
def split_every_n(spark: SparkSession, d: str) -> DataFrame:
    parts = pages.split_every(_pages(spark, d), 2).groupBy("doc_id", "part").agg(F.count("*").alias("n_pages"))
    return parts.withColumn("name", pages.part_name("{stem}_{n}", F.concat(F.lit("doc"), F.col("doc_id").cast("string")), F.col("part") + 1))


@query("split_at_page", f"WITH {PAGES} SELECT doc_id, CASE WHEN page_no < 2 THEN 0 ELSE 1 END AS part, count(*) AS n_pages FROM pages GROUP BY 1, 2")
def split_at_page(spark: SparkSession, d: str) -> DataFrame:
    return pages.split_at(_pages(spark, d), 2).groupBy("doc_id", "part").agg(F.count("*").alias("n_pages"))


@query("split_by_ranges", f"WITH {PAGES} SELECT doc_id, part, count(*) AS n_pages FROM pages, (VALUES (0, 0, 1), (1, 1, 4)) r(part, first, last) WHERE page_no BETWEEN first AND last GROUP BY 1, 2")
def split_by_ranges(spark: SparkSession, d: str) -> DataFrame:
    ranges = spark.createDataFrame([(0, 0, 1), (1, 1, 4)], "part int, first int, last int")
    return pages.split_by_ranges(_pages(spark, d), ranges).groupBy("doc_id", "part").agg(F.count("*").alias("n_pages"))


@query("image_names", f"WITH {PAGES} SELECT doc_id, page_no, 'd' || doc_id || '_page' || (page_no + 1) || '.png' AS a, 'p' || (page_no + 1) || '.png' AS b FROM pages")
def image_names(spark: SparkSession, d: str) -> DataFrame:
    stem = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    return _pages(spark, d).select("doc_id", "page_no", pages.page_image_name("{stem}.png", stem, F.col("page_no")).alias("a"), pages.page_image_name("p%1.png", stem, F.col("page_no")).alias("b"))


@query("paired_pages", f"""WITH {PAGES} SELECT a.doc_id // 2 AS pair, a.page_no, a.text = b.text AS same FROM pages a JOIN pages b ON a.doc_id + 1 = b.doc_id AND a.page_no = b.page_no WHERE a.doc_id % 2 = 0""")
def paired_pages(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d).withColumn("pair", F.expr("doc_id DIV 2"))
    return pages.paired_pages(p.filter("doc_id % 2 = 0"), p.filter("doc_id % 2 = 1"), "pair").select("pair", "page_no", (F.col("text_a") == F.col("text_b")).alias("same"))


@query("file_list_dedup", "SELECT user_id AS path, min(event_id) AS seq FROM events GROUP BY user_id")
def file_list_dedup(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"))
    return pages.first_of_each(files, "path", "seq")


@query("visible_pages", """SELECT o_orderkey, greatest(CAST(floor(s / 120) AS BIGINT) - 2, 0) AS first, least(CAST(floor((s + 900) / 120) AS BIGINT) + 2, 49) AS last
FROM (SELECT o_orderkey, o_custkey % 5000 AS s FROM orders)""")
def visible_pages(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 5000).alias("s"))
    first, last = pages.visible_window(F.col("s"), F.lit(900), 120, 2, F.lit(50).cast("bigint"))
    return o.select("o_orderkey", first.alias("first"), last.alias("last"))


@query("prefetch_pages", """SELECT p, array_to_string(list_filter([p + 1, p - 1, p + 2, p - 2, p + 3, p - 3], lambda x: x >= 0 AND x < 10), ' ') AS pages FROM (SELECT DISTINCT CAST(o_orderkey % 10 AS INTEGER) AS p FROM orders)""")
def prefetch_pages(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "orders").select((F.col("o_orderkey") % 10).cast("int").alias("p")).distinct()
    return p.withColumn("pages", F.array_join(pages.prefetch(F.col("p"), F.lit(10)).cast("array<string>"), " "))


@query("ordered_with_gaps", f"""WITH {PAGES}, n AS (SELECT doc_id, max(page_no) AS last FROM pages GROUP BY doc_id),
r AS (SELECT doc_id, page_no FROM pages WHERE (doc_id + page_no) % 3 <> 0)
SELECT p.doc_id, p.page_no, CASE WHEN r.doc_id IS NULL THEN 'Timeout' ELSE 'Ok' END AS status FROM pages p LEFT JOIN r ON p.doc_id = r.doc_id AND p.page_no = r.page_no""")
def ordered_with_gaps(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d)
    done = p.filter("(doc_id + page_no) % 3 <> 0").withColumn("status", F.lit("Ok"))
    return pages.with_gaps(done, p.groupBy("doc_id").agg(F.count("*").cast("int").alias("n")))


@query("heading_list_lines", f"""WITH {LINES} SELECT doc_id, line_no, length(regexp_extract('## ' || text, '^(#{{1,6}}) ', 1)) AS level, regexp_matches('- ' || text, '^[-*] ') AS item FROM lines""")
def heading_list_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = pages.lines_of(table(spark, d, "documents"))
    return lines.select("doc_id", "line_no", strings.heading_level(F.concat(F.lit("## "), "text")).cast("bigint").alias("level"), strings.is_list_item(F.concat(F.lit("- "), "text")).alias("item"))


@query("page_history", """WITH v AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
m AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM v WHERE before IS NULL OR before <> event_type)
SELECT user_id, event_id, event_type FROM m WHERE back <= 10""")
def page_history(spark: SparkSession, d: str) -> DataFrame:
    from foliant.operators.search import visits

    return visits(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type", 10)


@query("cumulative_offsets", f"""WITH {PAGES} SELECT doc_id, page_no, CAST(coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM pages""")
def cumulative_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Byte offset of every page within its document."""
    w = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    return _pages(spark, d).select("doc_id", "page_no", F.coalesce(F.sum(F.octet_length("text")).over(w), F.lit(0)).cast("bigint").alias("start"))
