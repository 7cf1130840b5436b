"""Image, page-element and export queries. Pixels, boxes and placed texts are derived by arithmetic from events, orders and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import geometry
from foliant.operators import documents, images, redaction, review, scan
from foliant.plans.layout_queries import WORDS, words_of
from foliant.plans.registry import query, table
from foliant.sources import objects

_PIXELS = """pixels AS (SELECT user_id AS doc_id, 0 AS page_no, CAST(event_id // 150 % 8 AS INTEGER) AS x, CAST(event_id // 1200 AS INTEGER) AS y, CAST(event_id * 7 % 256 AS INTEGER) AS r, CAST(event_id * 13 % 256 AS INTEGER) AS g, CAST(user_id * 5 % 256 AS INTEGER) AS b FROM events)"""
_HIST = f"""{_PIXELS}, hist AS (SELECT doc_id, page_no, (r * 299 + g * 587 + b * 114) // 1000 AS lum, count(*) AS n FROM pixels GROUP BY 1, 2, 3),
t AS (SELECT *, sum(n) OVER u AS wb, sum(n * lum) OVER u AS sb, sum(n) OVER w AS wt, sum(n * lum) OVER w AS st FROM hist WINDOW u AS (PARTITION BY doc_id, page_no ORDER BY lum), w AS (PARTITION BY doc_id, page_no)),
v AS (SELECT doc_id, page_no, lum, CASE WHEN wt > wb THEN wb::DOUBLE * (wt - wb) * (sb / wb - (st - sb) / (wt - wb)) * (sb / wb - (st - sb) / (wt - wb)) END AS var FROM t),
otsu AS (SELECT doc_id, page_no, coalesce((SELECT lum FROM v b WHERE b.doc_id = a.doc_id AND var > 0 ORDER BY var DESC, lum LIMIT 1), 128) AS threshold FROM v a GROUP BY doc_id, page_no)"""


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, d, "events").select(
        u.alias("doc_id"), F.lit(0).alias("page_no"), (F.floor(e / 150) % 8).cast("int").alias("x"), F.floor(e / 1200).cast("int").alias("y"),
        (e * 7 % 256).cast("int").alias("r"), (e * 13 % 256).cast("int").alias("g"), (u * 5 % 256).cast("int").alias("b"),
    )


@query("luminance_histogram", f"WITH {_HIST} SELECT doc_id, page_no, CAST(lum AS INTEGER) AS lum, n FROM hist")
def luminance_histogram(spark: SparkSession, d: str) -> DataFrame:
    return images.histogram(_pixels(spark, d))


@query("otsu_threshold", f"WITH {_HIST} SELECT doc_id, page_no, CAST(threshold AS INTEGER) AS threshold FROM otsu")
def otsu_threshold(spark: SparkSession, d: str) -> DataFrame:
    return images.otsu(images.histogram(_pixels(spark, d)))


@query("mrc_layers", f"""WITH {_HIST}, m AS (SELECT p.*, CASE WHEN x < 6 AND NOT (x BETWEEN 2 AND 3) AND (r * 299 + g * 587 + b * 114) // 1000 <= threshold THEN 1 ELSE 0 END AS mask FROM pixels p JOIN otsu o ON p.doc_id = o.doc_id)
SELECT doc_id, page_no, y, coalesce(CAST(trunc(avg(r) FILTER (mask = 0)) AS INTEGER), 255) AS r, coalesce(CAST(trunc(avg(g) FILTER (mask = 0)) AS INTEGER), 255) AS g, coalesce(CAST(trunc(avg(b) FILTER (mask = 0)) AS INTEGER), 255) AS b FROM m GROUP BY 1, 2, 3""")
def mrc_layers(spark: SparkSession, d: str) -> DataFrame:
    """Background rows of pages whose region of text is crossed by a figure, both as high as the page."""
    p = _pixels(spark, d)
    page = p.select("doc_id", "page_no").distinct()
    boxes = F.array(F.struct(F.lit(0).alias("region_id"), F.lit("Paragraph").alias("type"), F.lit(0).alias("x"), F.lit(6).alias("w")), F.struct(F.lit(1).alias("region_id"), F.lit("Figure").alias("type"), F.lit(2).alias("x"), F.lit(2).alias("w")))
    regions = page.withColumn("r", F.explode(boxes)).select("doc_id", "page_no", "r.*", F.lit(0).alias("y"), F.lit(1 << 30).alias("h"))
    return images.background_rows(images.foreground(p, images.otsu(images.histogram(p)), regions))


@query("mrc_estimates", """SELECT p_partkey, CAST(trunc(raw * 0.7::DOUBLE / 10) AS BIGINT) + CAST(trunc(raw * 0.3::DOUBLE / 10) AS BIGINT) AS lossless, CAST(trunc(raw * 0.7::DOUBLE / 30) AS BIGINT) + CAST(trunc(raw * 0.3::DOUBLE / 10) AS BIGINT) AS balanced,
CAST(trunc(raw * 0.7::DOUBLE / 50) AS BIGINT) + CAST(trunc(raw * 0.3::DOUBLE / 10) AS BIGINT) AS aggressive, raw * 0.25::DOUBLE AS dialog FROM (SELECT p_partkey, CAST((p_partkey % 3000) * (p_size * 40) * 3 AS DOUBLE) AS raw FROM part)""")
def mrc_estimates(spark: SparkSession, d: str) -> DataFrame:
    w, h = F.col("p_partkey") % 3000, F.col("p_size") * 40
    return table(spark, d, "part").select("p_partkey", *[images.mrc_estimate(w, h, m).alias(m.lower()) for m in images.MRC_RATIOS], (w * h * 3 * images.DIALOG_MRC_SHARE).alias("dialog"))


@query("cache_eviction", """SELECT user_id, event_id AS id FROM (SELECT user_id, event_id, sum(100 + event_id % 50) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS upto FROM events) WHERE upto <= 2000""")
def cache_eviction(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("used"), (100 + F.col("event_id") % 50).alias("bytes"))
    return images.keep_recent(e, "user_id", 2000).select("user_id", "id")


@query("clean_report", """SELECT user_id, count(*) AS total, count(*) FILTER (k >= 35) AS written, count(*) FILTER (k < 35) AS skipped, coalesce(string_agg(CAST(page_no AS VARCHAR), ',' ORDER BY page_no) FILTER (k < 35), '') AS skipped_pages
FROM (SELECT user_id, event_id AS page_no, event_id % 90 AS k FROM events) GROUP BY user_id""")
def clean_report(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("page_no"), (F.col("event_id") % 90 / 10000).alias("black_ratio"))
    return images.clean_report(e, 0.0035, ["user_id"])


@query("blank_pages", "SELECT event_id FROM events WHERE event_id % 90 >= 35")
def blank_pages(spark: SparkSession, d: str) -> DataFrame:
    return images.ink_pages(table(spark, d, "events").withColumn("black_ratio", F.col("event_id") % 90 / 10000), 0.0035).select("event_id")


@query("image_filters", f"""WITH {_PIXELS}, l AS (SELECT doc_id, x, y, (r * 299 + g * 587 + b * 114) // 1000 AS v FROM pixels),
n AS (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY y, x, v) - 1 AS i, count(*) OVER (PARTITION BY doc_id) // 8 AS height FROM l),
c AS (SELECT doc_id, height, i, i // 8 AS y, i % 8 AS x, v FROM n WHERE i < height * 8),
w AS (SELECT a.doc_id, a.i, a.v, a.y > 0 AND a.y < a.height - 1 AND a.x > 0 AND a.x < 7 AS inside, list_sort(list(b.v) FILTER (abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1)) AS around, sum(b.v)::DOUBLE / count(*) AS mean, sum(b.v * b.v)::DOUBLE / count(*) AS square
FROM c a JOIN c b ON a.doc_id = b.doc_id AND abs(a.x - b.x) <= 7 AND abs(a.y - b.y) <= 7 GROUP BY a.doc_id, a.i, a.v, a.x, a.y, a.height),
f AS (SELECT doc_id, i, CASE WHEN inside THEN around[5] ELSE v END AS median,
CASE WHEN v > mean * (1::DOUBLE + 0.2::DOUBLE * (sqrt(greatest(square - mean * mean, 0)) / 128::DOUBLE - 1)) THEN 255 ELSE 0 END AS adaptive FROM w),
p AS (SELECT doc_id, 'median' AS filter, i, median AS v FROM f UNION ALL SELECT doc_id, 'adaptive', i, adaptive FROM f),
g AS (SELECT doc_id, filter, unhex(string_agg(printf('%02X', CAST(v AS INTEGER)), '' ORDER BY i)) AS gray FROM p GROUP BY 1, 2)
SELECT doc_id, filter, sha256(coalesce(gray, ''::BLOB)) AS sha256 FROM (SELECT DISTINCT doc_id FROM pixels) CROSS JOIN (VALUES ('median'), ('adaptive')) v(filter) LEFT JOIN g USING (doc_id, filter)""")
def image_filters(spark: SparkSession, d: str) -> DataFrame:
    """Median and adaptive threshold of images made of pixel rows, as digests."""
    p = _pixels(spark, d).withColumn("v", geometry.luminance(F.col("r"), F.col("g"), F.col("b")))
    # Eight pixels a row, in order of place; an unfinished last row is left off.
    rows = p.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("c")).withColumn("height", F.expr("size(c) DIV 8").cast("int"))
    gray = F.unhex(F.array_join(F.transform(F.slice("c", 1, F.col("height") * 8), lambda t: F.lpad(F.hex(t["v"]), 2, "0")), ""))
    whole = rows.select("doc_id", F.lit(8).alias("width"), "height", gray.alias("gray"))
    out = [images.filtered(whole, n).select("doc_id", F.lit(n).alias("filter"), F.sha2("gray", 256).alias("sha256")) for n in ("median", "adaptive")]
    return out[0].unionByName(out[1])


@query("ink_components", f"""WITH RECURSIVE {_PIXELS}, ink AS (SELECT DISTINCT doc_id, page_no, x, y, y * 8 + x AS place FROM pixels WHERE r < 128),
near AS (SELECT a.doc_id, a.page_no, a.place, b.place AS next FROM ink a JOIN ink b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
reach AS (SELECT doc_id, page_no, place AS root, place FROM ink UNION SELECT r.doc_id, r.page_no, r.root, n.next FROM reach r JOIN near n ON r.doc_id = n.doc_id AND r.page_no = n.page_no AND r.place = n.place WHERE n.next > r.root),
labels AS (SELECT doc_id, page_no, place, min(root) AS root FROM reach GROUP BY 1, 2, 3)
SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY root) - 1 AS INTEGER) AS component, CAST(count(*) AS INTEGER) AS area, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h
FROM ink JOIN labels USING (doc_id, page_no, place) GROUP BY doc_id, page_no, root""")
def ink_components(spark: SparkSession, d: str) -> DataFrame:
    from foliant.operators import layout

    return layout.components(_pixels(spark, d).filter("r < 128").distinct())


@query("clean_scan", """
WITH p AS (SELECT p_partkey AS k, 5 + p_size AS w, p_partkey % 20 + 1 AS h, p_partkey % 4 + 1 AS n FROM part)
SELECT k AS doc_id, CAST(10 * w + CASE WHEN h > 3 OR h = 1 THEN 0 ELSE 2 * h END + CASE WHEN n >= 3 THEN n ELSE 0 END AS BIGINT) AS ink, 4 AS components, CAST(10 * w + 2 * h + n + 1 AS BIGINT) AS ink_before FROM p""")
def clean_scan(spark: SparkSession, d: str) -> DataFrame:
    """A page a part, in two strips of 40 rows: print over their border, a band along the left edge, and two specks that may be large enough to stay."""
    k = F.col("doc_id")
    pixels = lambda n: F.repeat(F.lit("FF"), n.cast("int"))
    paper = lambda n: F.repeat(F.lit("00"), n.cast("int"))
    block, speck, few = F.col("p_size") + 5, k % 20, k % 4 + 1

    def row(y: Column) -> Column:
        left = F.when((y >= 30) & (y <= 30 + k % 20), F.lit("0000FFFF" + "00" * 16)).otherwise(F.lit("00" * 20))
        right = (
            F.when((y >= 35) & (y < 45), F.concat(pixels(block), paper(80 - block))).when(y == 60, F.concat(paper(speck + 10), F.lit("FF"), paper(69 - speck)))
            .when(y == 70, F.concat(paper(F.lit(10)), pixels(few), paper(70 - few))).otherwise(F.lit("00" * 80))
        )
        return F.concat(left, right)

    parts = objects.spread(table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), "p_size"), "doc_id")
    two = parts.select("doc_id", "p_size", F.explode(F.array(F.lit(0), F.lit(1))).alias("strip"))
    # A strip is made where its part is, so no row of pixels is moved.
    lines = F.transform(F.sequence(F.col("strip") * 40, F.col("strip") * 40 + 39), row)
    strips = review.unsized(two.select("doc_id", F.lit(0).alias("page_no"), "strip", F.lit(100).alias("width"), F.unhex(F.array_join(lines, "")).alias("data")))
    ink = lambda s: s.groupBy("doc_id").agg(F.sum(F.floor(F.length(F.replace(F.hex("data"), F.lit("00"), F.lit(""))) / 2)).alias("ink"))
    known = scan.components(review._cut(scan.strip_labels(strips)))
    found = known[0].groupBy("doc_id").agg(F.count("*").cast("int").alias("components"))
    return ink(scan.cleaned(strips, known)).join(found, "doc_id").join(ink(strips).withColumnRenamed("ink", "ink_before"), "doc_id")


@query("image_pages", """
WITH p AS (SELECT p_partkey AS k, p_partkey // 6 AS list_id, 1 + p_partkey % 900 AS w, 1 + p_size * 17 AS h, p_partkey % 101 = 0 OR p_partkey % 103 = 0 AS bad FROM part),
g AS (SELECT *, max(bad) OVER (PARTITION BY list_id) AS refused, least(595.0::DOUBLE / w, 842.0::DOUBLE / h) AS s FROM p)
SELECT list_id, CAST(row_number() OVER (PARTITION BY list_id ORDER BY k) - 1 AS INTEGER) AS page_no, 'image' || k AS path, (595.0::DOUBLE - w * s) / 2 AS x, (842.0::DOUBLE - h * s) / 2 AS y, w * s AS w, h * s AS h FROM g WHERE NOT refused""")
def image_pages(spark: SparkSession, d: str) -> DataFrame:
    """Six images a list, of five formats by their first bytes; some are missing, some of no format, and take their list along."""
    k, p = F.col("p_partkey"), table(spark, d, "part")
    w, h = 1 + k % 900, 1 + F.col("p_size") * 17
    big = lambda n, size: F.lpad(F.hex(n.cast("bigint")), 2 * size, "0")
    little = lambda n, size: F.concat(*[F.substring(big(n, size), 2 * i + 1, 2) for i in range(size - 1, -1, -1)])
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    png = text("89504E470D0A1A0A0000000D49484452", big(w, 4), big(h, 4))
    gif = text("474946383961", little(w, 2), little(h, 2))
    bmp = text("424D", "00" * 12, "36000000", little(w, 4), little(h, 4))
    jpeg = text("FFD8FFE00006AABBCCDD", "FFC0001108", big(h, 2), big(w, 2), "03")
    tiff = text("49492A0008000000", "0200", "0001030001000000", little(w, 2), "0000", "0101040001000000", little(h, 4))
    head = F.unhex(F.get(F.array(png, gif, bmp, jpeg, tiff), (k % 5).cast("int")))
    files = p.filter(k % 101 != 0).select(F.concat(F.lit("image"), k.cast("string")).alias("path"), F.when(k % 103 == 0, F.encode(F.lit("no image"), "UTF-8")).otherwise(head).alias("head"))
    members = p.select(F.floor(k / 6).alias("list_id"), k.alias("place"), F.concat(F.lit("image"), k.cast("string")).alias("path"))
    return images.pages_of_images(members, files)[0]


_RECTS = "rects AS (SELECT DISTINCT doc_id, page_no, 100.0::DOUBLE AS x, CAST(doc_id % 9 * 20 AS DOUBLE) AS y, 160.0::DOUBLE AS w, 30.0::DOUBLE AS h FROM lines)"


def _rects(spark: SparkSession, d: str) -> DataFrame:
    w = words_of(spark, d).select("doc_id", "page_no").distinct()
    return w.select("doc_id", "page_no", F.lit(100.0).alias("x"), (F.col("doc_id") % 9 * 20).cast("double").alias("y"), F.lit(160.0).alias("w"), F.lit(30.0).alias("h"))


@query("redact_page_texts", f"""{WORDS}, {_RECTS} SELECT e.doc_id, e.page_no, count(*) AS n FROM words e WHERE NOT EXISTS (SELECT 1 FROM rects r WHERE r.doc_id = e.doc_id AND r.page_no = e.page_no AND e.y BETWEEN r.y AND r.y + r.h AND e.x <= r.x + r.w AND e.x + e.w >= r.x) GROUP BY 1, 2""")
def redact_page_texts(spark: SparkSession, d: str) -> DataFrame:
    kept = redaction.untouched(words_of(spark, d), _rects(spark, d), redaction.baseline_inside("e", "r"))
    return kept.groupBy("doc_id", "page_no").agg(F.count("*").alias("n"))


@query("redact_page_images", f"""{WORDS}, {_RECTS} SELECT count(*) AS n_touched FROM words e WHERE EXISTS (SELECT 1 FROM rects r WHERE r.doc_id = e.doc_id AND r.page_no = e.page_no AND e.y <= r.y + r.h AND r.y <= e.y + e.h AND e.x <= r.x + r.w AND r.x <= e.x + e.w)""")
def redact_page_images(spark: SparkSession, d: str) -> DataFrame:
    return redaction.touched(words_of(spark, d), _rects(spark, d), redaction.closed_overlap("e", "r")).agg(F.count("*").alias("n_touched"))


@query("redact_page_annotations", f"""{WORDS}, {_RECTS} SELECT count(*) AS n_touched FROM words e WHERE EXISTS (SELECT 1 FROM rects r WHERE r.doc_id = e.doc_id AND r.page_no = e.page_no AND e.y < r.y + r.h AND r.y < e.y + e.h AND e.x < r.x + r.w AND r.x < e.x + e.w)""")
def redact_page_annotations(spark: SparkSession, d: str) -> DataFrame:
    return redaction.touched(words_of(spark, d), _rects(spark, d), redaction.open_overlap("e", "r")).agg(F.count("*").alias("n_touched"))


@query("redact_page_points", f"""{WORDS}, {_RECTS} SELECT count(*) AS n_touched FROM words e WHERE EXISTS (SELECT 1 FROM rects r WHERE r.doc_id = e.doc_id AND r.page_no = e.page_no AND e.x BETWEEN r.x AND r.x + r.w AND e.y BETWEEN r.y AND r.y + r.h)""")
def redact_page_points(spark: SparkSession, d: str) -> DataFrame:
    return redaction.touched(words_of(spark, d), _rects(spark, d), redaction.point_inside("e", "r")).agg(F.count("*").alias("n_touched"))


@query("unapplied_annotations", "SELECT event_id AS id, event_type AS kind FROM events WHERE event_type IS DISTINCT FROM 'click'")
def unapplied_annotations(spark: SparkSession, d: str) -> DataFrame:
    """What stays after marks were applied; clicks stand in for marks."""
    mode = F.when(F.col("event_type") == "click", "Redact").otherwise("Note")
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), mode.alias("mode"))
    return redaction.drop_marks(e).select("id", "kind")


@query("redaction_marks", """SELECT user_id AS doc_id, CAST(event_id % 4 AS INTEGER) AS page_no, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY event_id) AS ids, count(*) AS n FROM events WHERE event_type = 'click' AND user_id % 3 <> 0 GROUP BY 1, 2""")
def redaction_marks(spark: SparkSession, d: str) -> DataFrame:
    """Marks by page; documents with a signature are refused."""
    e = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 4).cast("int").alias("page_no"), F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "Redact").otherwise("Note").alias("mode"), *[F.lit(0.0).alias(c) for c in "xywh"])
    signed = e.filter("doc_id % 3 = 0").select("doc_id")
    marks = redaction.marks_by_page(redaction.unsigned_only(e, signed))
    return marks.select("doc_id", "page_no", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"), "n")


@query("image_placements", """SELECT event_id, sqrt(value * value + 16) AS w, 5.0::DOUBLE AS h, least(value * 2, 0) + least(3.0::DOUBLE * 1, 0) + 7 AS x FROM events""")
def image_placements(spark: SparkSession, d: str) -> DataFrame:
    """Size under a transform, and the left edge of a box mapped by one."""
    v, lit = F.col("value"), lambda x: F.lit(float(x))
    p = geometry.placement(v, lit(4), lit(3), lit(4))
    m = geometry.affine_concat([v, lit(0), lit(0), lit(1), lit(0), lit(0)], [lit(1), lit(0), lit(1), lit(1), lit(7), lit(0)])
    b = geometry.affine_box(geometry.box(lit(0), lit(0), lit(2), lit(3)), m)
    return table(spark, d, "events").select("event_id", p["w"].alias("w"), p["h"].alias("h"), b["x"].alias("x"))


@query("export_text", f"""{WORDS}, g AS (SELECT *, y - lag(y) OVER (PARTITION BY doc_id, page_no ORDER BY seq) AS dy FROM words),
p AS (SELECT doc_id, page_no, string_agg(CASE WHEN dy IS NULL THEN '' WHEN abs(dy) > 12 * 0.8 THEN chr(10) ELSE ' ' END || text, '' ORDER BY seq) || chr(10) || chr(10) AS t FROM g GROUP BY 1, 2)
SELECT doc_id, sha256(string_agg(t, '' ORDER BY page_no)) AS text_sha256 FROM p GROUP BY doc_id""")
def export_text(spark: SparkSession, d: str) -> DataFrame:
    e = words_of(spark, d).withColumn("font_size", F.lit(12.0))
    return documents.to_text(e, ["doc_id"]).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query("export_csv", f"""{WORDS}, r AS (SELECT doc_id, page_no, y, string_agg('"' || replace(text, '"', '""') || '"', ',' ORDER BY x, seq) AS l FROM words GROUP BY 1, 2, 3)
SELECT doc_id, sha256(string_agg(l, chr(10) ORDER BY page_no, y) || chr(10)) AS csv_sha256 FROM r GROUP BY doc_id""")
def export_csv(spark: SparkSession, d: str) -> DataFrame:
    e = words_of(spark, d).withColumn("font_size", F.lit(12.0))
    return documents.to_csv(e, ["doc_id"]).select("doc_id", F.sha2("csv", 256).alias("csv_sha256"))


@query("export_html", f"""{WORDS}, h AS (SELECT doc_id, page_no, seq, '<div style="position:absolute;left:' || CAST(x AS BIGINT) || 'pt;top:' || CAST(792 - y - 12 AS BIGINT) || 'pt;font-size:12pt">' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</div>' AS e FROM words),
p AS (SELECT doc_id, page_no, '<div class="page">' || chr(10) || string_agg(e, chr(10) ORDER BY seq) || chr(10) || '</div>' || chr(10) AS t FROM h GROUP BY 1, 2)
SELECT doc_id, sha256('<!DOCTYPE html>' || chr(10) || '<html><body>' || chr(10) || string_agg(t, '' ORDER BY page_no) || '</body></html>' || chr(10)) AS html_sha256 FROM p GROUP BY doc_id""")
def export_html(spark: SparkSession, d: str) -> DataFrame:
    e = words_of(spark, d).withColumn("font_size", F.lit(12.0))
    return documents.to_html(e, ["doc_id"]).select("doc_id", F.sha2("html", 256).alias("html_sha256"))


@query("slide_boxes", f"""{WORDS} SELECT doc_id, seq, CAST(x * 12700 AS BIGINT) AS x, greatest(CAST(trunc((500 - y - 12) * 12700) AS BIGINT), 0) AS y, greatest(CAST(w * 12700 AS BIGINT), 1) AS w, 1200 AS size FROM words""")
def slide_boxes(spark: SparkSession, d: str) -> DataFrame:
    e = words_of(spark, d).withColumn("font_size", F.lit(12.0))
    return documents.slide_boxes(e, 500.0).select("doc_id", "seq", "x", "y", "w", "size")


@query("element_order", f"""{WORDS}, f AS (SELECT doc_id, page_no, seq, x, 400 - y AS y FROM words), l AS (SELECT *, lag(y) OVER (PARTITION BY doc_id, page_no ORDER BY y DESC, x, seq) AS y0 FROM f),
b AS (SELECT *, sum(CASE WHEN y0 - y >= 6 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY y DESC, x, seq) AS line FROM l)
SELECT doc_id, page_no, seq, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line, x, seq) - 1 AS INTEGER) AS place FROM b""")
def element_order(spark: SparkSession, d: str) -> DataFrame:
    e = words_of(spark, d).withColumn("y", 400 - F.col("y")).withColumn("font_size", F.lit(12.0))
    return documents.sort_elements(e, ["doc_id", "page_no"]).select("doc_id", "page_no", "seq", "place")
