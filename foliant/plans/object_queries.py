"""Queries over the objects of page files whose bytes Spark derives from the tables.

Each document becomes a file of pages of 20 lines: two nodes below the root of the page tree share the
pages, the first has a size of its own and the root a turn; each line is one hexadecimal string, and each page
shows its lines by two streams of which the second begins with an operator whose operands end the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import graph, nested, review
from foliant.plans.page_queries import LINES
from foliant.plans.registry import query, table
from foliant.sources import objects

_REFS = lambda numbers: F.array_join(F.transform(numbers, lambda n: F.concat(n.cast("string"), F.lit(" 0 R"))), " ")


def _object(number: Column, body: Column) -> Column:
    return F.concat(number.cast("string"), F.lit(" 0 obj\n"), body, F.lit("\nendobj\n"))


def _stream(text: Column) -> Column:
    return F.concat(F.lit("<< /Length "), F.length(text).cast("string"), F.lit(" >>\nstream\n"), text, F.lit("\nendstream"))


def _file(*parts: Column) -> Column:
    """ASCII objects, a header and a trailer, without a table of places, as bytes."""
    return F.encode(F.concat(F.lit("%PDF-1.5\n"), *parts, F.lit("trailer\n<< /Root 1 0 R >>\n%%EOF\n")), "ISO-8859-1")


def _document_files(spark: SparkSession, d: str) -> DataFrame:
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.hex(F.encode(x, "UTF-8")))
    n = F.ceil(F.size("l") / 20).cast("int")
    page = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.slice("l", i * 20 + 1, 20))
    docs = objects.spread(table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text"), "doc_id").select(F.col("doc_id").alias("file"), lines.alias("l")).withColumn("n", n).withColumn("p", page)
    half = F.floor((F.col("n") + 1) / 2).cast("int")
    number = lambda i: i * 3 + 10

    def page_objects(shown: Column, i: Column) -> Column:
        text = F.array_join(F.transform(shown, lambda x: F.concat(F.lit("<"), x, F.lit("> Tj\n"))), "")
        own = F.concat(F.lit("<< /Type /Page /Contents ["), _REFS(F.array(number(i) + 1, number(i) + 2)), F.lit("] >>"))
        return F.concat(_object(number(i), own), _object(number(i) + 1, _stream(F.lit("BT /F1 12 Tf 1 0 0 1 50"))), _object(number(i) + 2, _stream(F.concat(F.lit("700 Tm\n"), text, F.lit("ET")))))

    left = F.transform(F.sequence(F.lit(0), half - 1), number)
    right = F.when(F.col("n") > half, F.transform(F.sequence(half, F.col("n") - 1), number)).otherwise(F.array().cast("array<int>"))
    tree = [
        F.lit("1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n"),
        F.lit("2 0 obj\n<< /Type /Pages /Kids [4 0 R 3 0 R] /MediaBox [0 0 612 792] /Rotate 90 >>\nendobj\n"),
        _object(F.lit(3), F.concat(F.lit("<< /Type /Pages /Kids ["), _REFS(right), F.lit("] >>"))),
        _object(F.lit(4), F.concat(F.lit("<< /Type /Pages /MediaBox [0 0 300 400] /Kids ["), _REFS(left), F.lit("] >>"))),
    ]
    return docs.select("file", _file(*tree, F.array_join(F.transform("p", page_objects), "")).alias("content"))


_COUNTED = f"{LINES}, n AS (SELECT doc_id, max(page_no) + 1 AS n FROM lines GROUP BY doc_id)"


@query("page_tree", f"""WITH {_COUNTED} SELECT DISTINCT l.doc_id AS file, page_no, CASE WHEN page_no < (n + 1) // 2 THEN 300.0 ELSE 612.0 END::DOUBLE AS width,
CASE WHEN page_no < (n + 1) // 2 THEN 400.0 ELSE 792.0 END::DOUBLE AS height, 90 AS rotate FROM lines l JOIN n USING (doc_id)""")
def page_tree(spark: SparkSession, d: str) -> DataFrame:
    """Pages in the order of the tree, with the size and the turn they inherit."""
    # Parsed once, and without the bytes of streams.
    pages = graph.page_tree(review._cut(objects.object_rows(_document_files(spark, d)).drop("data")))
    return pages.select("file", "page_no", F.get("box", F.lit(2)).alias("width"), F.get("box", F.lit(3)).alias("height"), "rotate")


@query("page_texts", f"""WITH {LINES} SELECT doc_id AS file, page_no, count(*) FILTER (text <> '') AS n_elements, sha256(coalesce(string_agg(text, ' ' ORDER BY line_no) FILTER (text <> ''), '')) AS text_sha256
FROM lines GROUP BY doc_id, page_no""")
def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """Text of every page from its two streams; pages without text have an empty section."""
    rows = review._cut(objects.object_rows(_document_files(spark, d)))
    pages = graph.page_tree(rows)
    elements = graph.page_elements(graph.page_contents(rows, pages))
    n = elements.groupBy("file", "page_no").agg(F.count("*").alias("n_elements"))
    # Strings of the format are bytes: those of the text's own encoding.
    sections = graph.page_sections(pages, elements).join(n, ["file", "page_no"], "left")
    return sections.select("file", "page_no", F.coalesce("n_elements", F.lit(0)).alias("n_elements"), F.sha2(F.encode("text", "ISO-8859-1"), 256).alias("text_sha256"))


@query("structure_json", """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s FROM orders)
SELECT k AS file, sha256('{"version":2,"objects":{"obj:1 0 R":{"value":{"/Pages":"2 0 R","/Type":"/Catalog"}},"obj:2 0 R":{"value":{"/Count":' || (k % 5) || ',"/Kids":[' ||
  array_to_string(list_transform(generate_series(0, k % 5 - 1), lambda i: '"' || (i + 3) || ' 0 R"'), ',') || '],"/Type":"/Pages"}},' ||
  array_to_string(list_transform(generate_series(0, k % 5 - 1), lambda i: '"obj:' || (i + 3) || ' 0 R":{"value":{"/Note":"u:' || s || '(' || (c * i) || ')","/Open":true,"/Type":"/Page"}},'), '') ||
  '"trailer":{"value":{"/Root":"1 0 R"}}}}') AS json_sha256, k % 5 + 2 AS n_objects FROM o""")
def structure_json(spark: SparkSession, d: str) -> DataFrame:
    """Files of up to four pages, a file an order, as JSON; and how many objects each has."""
    o = objects.spread(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey").select(F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s"), (F.col("o_orderkey") % 5).cast("int").alias("n"))
    numbers = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    page = lambda i: _object(i + 3, F.concat(F.lit("<< /Open true /Type /Page /Note ("), F.col("s"), F.lit("\\("), (F.col("c") * i).cast("string"), F.lit("\\)) >>")))
    root = _object(F.lit(2), F.concat(F.lit("<< /Type /Pages /Kids ["), _REFS(F.transform(numbers, lambda i: i + 3)), F.lit("] /Count "), F.col("n").cast("string"), F.lit(" >>")))
    files = o.select("file", _file(F.lit("1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n"), root, F.array_join(F.transform(numbers, page), "")).alias("content"))
    rows = review._cut(objects.object_rows(files).drop("data"))
    status = objects.load_status(rows)
    return graph.structure_json(rows).join(status, "file").select("file", F.sha2("json", 256).alias("json_sha256"), "n_objects")


@query("image_inventory", """
WITH p AS (SELECT p_partkey AS k, 1 + p_size AS s, p_partkey % 7 AS t FROM part)
SELECT k AS file, i AS seq, 'Im' || CASE i WHEN 1 THEN 'B' ELSE 'A' END AS name,
       CAST(CASE i WHEN 0 THEN 10 WHEN 1 THEN 10 + 5 * s ELSE 0 END AS DOUBLE) AS x, CAST(CASE i WHEN 0 THEN t WHEN 1 THEN t + 7 * s ELSE 0 END AS DOUBLE) AS y,
       CAST(CASE i WHEN 0 THEN s WHEN 1 THEN 3 * s ELSE 1 END AS DOUBLE) AS w, CAST(CASE i WHEN 0 THEN 2 * s WHEN 1 THEN 2 * s ELSE 1 END AS DOUBLE) AS h,
       CAST(CASE i WHEN 1 THEN 0 ELSE 0 END AS DOUBLE) AS rotation, CASE i WHEN 1 THEN 64 ELSE CAST(k % 100 AS INTEGER) END AS width_px
FROM p, (SELECT unnest([0, 1, 2]) AS i)""")
def image_inventory(spark: SparkSession, d: str) -> DataFrame:
    """A page a part: one image drawn twice, another under a second transform; a form and an unknown name are not images, and the last restore has no save."""
    k, s, t = F.col("p_partkey"), (1 + F.col("p_size")).cast("string"), (F.col("p_partkey") % 7).cast("string")
    text = F.concat(F.lit("q "), s, F.lit(" 0 0 "), s, F.lit(" 10 "), t, F.lit(" cm q 1 0 0 2 0 0 cm /ImA Do Q q 3 0 0 2 5 7 cm /ImB Do /Fm Do Q Q Q /ImA Do /No Do"))
    body = F.lit(
        "1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Resources 4 0 R >>\nendobj\n3 0 obj\n<< /Type /Page /Contents 5 0 R >>\nendobj\n"
        "4 0 obj\n<< /XObject << /ImA 6 0 R /ImB 7 0 R /Fm 8 0 R >> >>\nendobj\n7 0 obj\n<< /Subtype /Image /Width 64 /Length 0 >>\nstream\n\nendstream\nendobj\n"
        "8 0 obj\n<< /Subtype /Form /Length 0 >>\nstream\n\nendstream\nendobj\n"
    )
    image = _object(F.lit(6), F.concat(F.lit("<< /Subtype /Image /Height 3 /Width "), (k % 100).cast("string"), F.lit(" /Length 0 >>\nstream\n\nendstream")))
    files = objects.spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select(k.alias("file"), _file(body, image, _object(F.lit(5), _stream(text))).alias("content"))
    rows = review._cut(objects.object_rows(files))
    pages = graph.page_tree(rows)
    found = graph.image_inventory(rows, pages, graph.page_contents(rows, pages))
    # Names that are no image have numbers too.
    seq = F.when(F.col("seq") == 3, 2).otherwise(F.col("seq"))
    return found.select("file", seq.alias("seq"), "name", "x", "y", "w", "h", "rotation", "width_px")


@query("annotation_scan", """
WITH c AS (SELECT conv_id AS f, turn, role, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
a AS (SELECT f, turn, role, CASE WHEN turn % 4 = 1 AND turn < last THEN turn + 1 WHEN turn % 4 = 2 AND turn > 0 THEN 0 END AS up FROM c)
SELECT f AS file, CAST(turn % 2 AS INTEGER) AS page_no, 'n' || turn AS id, 'n' || up AS parent_id, CASE WHEN turn % 3 = 0 THEN 'Highlight' ELSE 'AddComment' END AS mode, role AS author,
       CAST(700 - turn AS DOUBLE) AS y, (SELECT count(*) FROM a b WHERE b.f = a.f AND b.up = a.turn) AS n_replies FROM a""")
def annotation_scan(spark: SparkSession, d: str) -> DataFrame:
    """A file a conversation, a note a turn on two pages: answers before what they answer, on the other page, and to objects that are not there."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("file"), "turn", "role")
    up = F.when(F.col("turn") % 4 == 1, F.col("turn") + 1).when(F.col("turn") % 4 == 2, F.lit(0)).when(F.col("turn") % 4 == 3, F.lit(5000))
    irt = F.coalesce(F.concat(F.lit(" /IRT "), (up + 10).cast("string"), F.lit(" 0 R")), F.lit(""))
    kind = F.when(F.col("turn") % 3 == 0, "Highlight").otherwise("Text")
    note = F.concat(
        F.lit("<< /Subtype /"), kind, F.lit(" /NM (n"), F.col("turn").cast("string"), F.lit(") /T ("), F.col("role"), F.lit(") /Rect [1 2 3 "), (F.col("turn") + 92).cast("string"), F.lit("]"), irt, F.lit(" >>")
    )
    notes = c.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("turn", _object(F.col("turn") + 10, note).alias("o")))).alias("n"))
    on = lambda side: _REFS(F.transform(F.filter("n", lambda x: x["turn"] % 2 == side), lambda x: x["turn"] + 10))
    body = F.lit("1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R 4 0 R] /MediaBox [0 0 612 792] >>\nendobj\n4 0 obj\n<< /Type /Page /Annots 5 0 R >>\nendobj\n")
    lists = F.concat(_object(F.lit(3), F.concat(F.lit("<< /Type /Page /Annots ["), on(0), F.lit("] >>"))), _object(F.lit(5), F.concat(F.lit("["), on(1), F.lit("]"))))
    rows = review._cut(objects.object_rows(notes.select("file", _file(body, lists, F.array_join(F.transform("n", lambda x: x["o"]), "")).alias("content"))))
    found = graph.annotation_scan(rows, graph.page_tree(rows))
    return found.select("file", "page_no", "id", "parent_id", "mode", "author", "y", F.size("replies").cast("bigint").alias("n_replies"))


@query("repaired_files", """SELECT event_id AS file, CASE WHEN event_id % 5 = 0 THEN 'error' WHEN event_id % 5 = 1 THEN 'ok' ELSE 'repaired' END AS status, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 2 END::BIGINT AS n_objects FROM events""")
def repaired_files(spark: SparkSession, d: str) -> DataFrame:
    """A file an event: with a right table, a table that is some bytes off, one that lacks an object, none, or no objects at all."""
    e = F.col("event_id")
    one = F.concat(F.lit("1 0 obj\n<< /Type /Catalog /N "), e.cast("string"), F.lit(" >>\nendobj\n"))
    body = F.concat(F.lit("%PDF-1.5\n"), one, F.lit("2 0 obj\n[1 2]\nendobj\n"))
    second = F.length(one) + 9
    entry = lambda n: F.concat(F.lpad(n.cast("string"), 10, "0"), F.lit(" 00000 n \n"))
    off = F.when(e % 5 == 2, 3).otherwise(0)
    rows_of = F.concat(F.lit("xref\n0 "), F.when(e % 5 == 3, "2").otherwise("3"), F.lit("\n0000000000 65535 f \n"), entry(F.lit(9) + off), F.when(e % 5 == 3, "").otherwise(entry(second + off)))
    tail = F.concat(F.lit("trailer\n<< /Root 1 0 R >>\nstartxref\n"), F.length(body).cast("string"), F.lit("\n%%EOF\n"))
    whole = F.when(e % 5 == 0, F.lit("%PDF-1.5\nnothing")).when(e % 5 == 4, F.concat(body, tail)).otherwise(F.concat(body, rows_of, tail))
    files = objects.spread(table(spark, d, "events").select("event_id"), "event_id").select(e.alias("file"), F.encode(whole, "ISO-8859-1").alias("content"))
    return objects.load_status(objects.object_rows(files)).select("file", "status", "n_objects")


@query("redact_forms", """
WITH c AS (SELECT c_custkey AS k, (c_custkey % 200 - 100) / 2.0 AS x0, c_custkey % 90 - 50 AS x1 FROM customer),
r AS (SELECT k AS file, 0 AS page_no, x0 + 2.5 >= 10 AND x0 <= 40 AS gone FROM c UNION ALL SELECT k, 1, x1 + 5 >= 10 AND x1 <= 40 FROM c)
SELECT file, page_no, 'outer' AS text, 1::BIGINT AS n_removed, 1::BIGINT AS n_copies FROM r WHERE gone""")
def redact_forms(spark: SparkSession, d: str) -> DataFrame:
    """A form that two pages draw, on one of them twice as large: a file a customer, a rectangle a page."""
    k = F.col("c_custkey")
    body = F.lit(
        "1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R 4 0 R] /Resources << /XObject << /A 10 0 R >> >> >>\nendobj\n"
        "3 0 obj\n<< /Type /Page /Contents 5 0 R >>\nendobj\n4 0 obj\n<< /Type /Page /Contents 6 0 R >>\nendobj\n"
    )
    first, second = F.lit("BT /F 10 Tf 1 0 0 1 5 5 Tm (plain) Tj ET q 2 0 0 2 100 100 cm /A Do Q"), F.lit("q 1 0 0 1 50 50 cm /A Do Q")
    form = F.lit("<< /Subtype /Form /BBox [0 0 200 200] /Length 42 >>\nstream\nBT /F 10 Tf 1 0 0 1 10 10 Tm (outer) Tj ET\nendstream")
    customers = objects.spread(table(spark, d, "customer").select("c_custkey"), "c_custkey")
    files = customers.select(k.alias("file"), _file(body, _object(F.lit(5), _stream(first)), _object(F.lit(6), _stream(second)), _object(F.lit(10), form)).alias("content"))
    rows = review._cut(objects.object_rows(files))
    pages = graph.page_tree(rows)
    sides = F.explode(F.array(F.struct(F.lit(0).alias("page_no"), (k % 200).alias("x"), F.lit(119).alias("y")), F.struct(F.lit(1).alias("page_no"), (k % 90).alias("x"), F.lit(59).alias("y"))))
    rects = review.unsized(customers.select(k.alias("file"), sides.alias("s")).select("file", "s.*", F.lit(5).alias("w"), F.lit(5).alias("h")))
    out = nested.redact(rows, pages, graph.page_contents(rows, pages), rects)
    removed = out["removed"].groupBy("file", "page_no", "text").agg(F.count("*").alias("n_removed"))
    return removed.join(out["copies"].groupBy("file", "page_no").agg(F.count("*").alias("n_copies")), ["file", "page_no"])
