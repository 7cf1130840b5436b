"""Queries over decisions, summaries, reports and objects; events, orders and parts stand in for files and flags."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import strings
from foliant.operators import sanitize, status
from foliant.plans.registry import query, table
from foliant.sources import records


@query("batch_summary", """SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'view') AS warnings, count(*) FILTER (event_type <> 'error') AS succeeded,
bool_or(event_type = 'error') AS has_errors FROM events GROUP BY user_id""")
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    severity = F.when(F.col("event_type") == "error", "Error").when(F.col("event_type") == "view", "Warning").otherwise("Info")
    return status.batch_summary(table(spark, d, "events").withColumn("severity", severity), ["user_id"], "severity")


@query("batch_run", """SELECT 'f' || event_id AS path, event_type <> 'error' AS ok, CASE WHEN event_type <> 'error' THEN upper('f' || event_id) END AS result, CASE WHEN event_type = 'error' THEN 'ValueError: unreadable' END AS error FROM events""")
def batch_run(spark: SparkSession, d: str) -> DataFrame:
    bad = table(spark, d, "events").select(F.concat(F.lit("f"), "event_id", F.when(F.col("event_type") == "error", "!").otherwise("")).alias("path"))

    def work(path: str) -> str:
        if path.endswith("!"):
            raise ValueError("unreadable")
        return path.upper()

    return status.run_batch(bad, "path", work).withColumn("path", F.rtrim(F.replace("path", F.lit("!"), F.lit(""))))


@query("batch_eta", """SELECT event_id, CASE WHEN done > 0 AND done < 100 THEN (elapsed // done) * (100 - done) END AS eta FROM (SELECT event_id, event_id * 37 AS elapsed, event_id % 101 AS done FROM events)""")
def batch_eta(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", (F.col("event_id") * 37).alias("elapsed"), (F.col("event_id") % 101).alias("done"))
    return e.select("event_id", status.eta_ms(F.col("elapsed"), F.when(F.col("done") > 0, F.col("done")), F.lit(100)).alias("eta"))


_LOG = """SELECT event_id AS entry, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, CASE event_type WHEN 'error' THEN 'Error' WHEN 'view' THEN 'Warning' ELSE 'Info' END AS severity, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'f' || user_id || '.pdf' END AS file,
CASE WHEN event_id % 3 = 0 THEN -1 ELSE event_id % 9 END AS page, 'said "' || event_type || '"' AS message, props AS details FROM events"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    severity = F.when(F.col("event_type") == "error", "Error").when(F.col("event_type") == "view", "Warning").otherwise("Info")
    return e.select(
        F.col("event_id").alias("entry"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), severity.alias("severity"),
        F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit("f"), F.col("user_id").cast("string"), F.lit(".pdf"))).alias("file"),
        F.when(F.col("event_id") % 3 == 0, -1).otherwise(F.col("event_id") % 9).alias("page"),
        F.concat(F.lit('said "'), "event_type", F.lit('"')).alias("message"), F.col("props").alias("details"),
    )


@query("error_log_csv", f"""SELECT entry, concat_ws(',', '"' || timestamp || '"', '"' || severity || '"', '"' || file || '"', CASE WHEN page >= 0 THEN CAST(page AS VARCHAR) ELSE '' END, '"' || replace(message, '"', '""') || '"', '"' || replace(details, '"', '""') || '"') AS value FROM ({_LOG})""")
def error_log_csv(spark: SparkSession, d: str) -> DataFrame:
    return status.log_csv(_log(spark, d))


@query("error_log_json", f"""SELECT entry, '{{"timestamp":"' || timestamp || '","severity":"' || severity || '","message":"' || replace(message, '"', '\\"') || '","technicalDetails":"' || replace(details, '"', '\\"') || '"' ||
CASE WHEN file <> '' THEN ',"file":"' || file || '"' ELSE '' END || CASE WHEN page >= 0 THEN ',"page":' || page ELSE '' END || '}}' AS value FROM ({_LOG})""")
def error_log_json(spark: SparkSession, d: str) -> DataFrame:
    return status.log_json(_log(spark, d))


@query("output_paths", """SELECT p_partkey, '/in/' || replace(p_name, ' ', '_') || '_compressed.pdf' AS compressed, '/in/' || replace(p_name, ' ', '_') || '_watermarked.pdf' AS marked,
CASE WHEN p_size % 2 = 0 THEN '/out' ELSE '/in' END || '/' || replace(p_name, ' ', '_') || '_pdfa.pdf' AS pdfa, '/in/' || replace(p_name, ' ', '_') || '.docx' AS converted FROM part""")
def output_paths(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("path", F.concat(F.lit("/in/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".pdf")))
    out = F.when(F.col("p_size") % 2 == 0, " /out ").otherwise("")
    path = F.col("path")
    return p.select("p_partkey", status.output_path(path, "compress").alias("compressed"), status.output_path(path, "watermark").alias("marked"), status.output_path(path, "pdfa", out).alias("pdfa"), status.output_path(path, "convert", None, status.CONVERT_EXTENSIONS[0]).alias("converted"))


@query("office_files", f"SELECT p_partkey FROM (SELECT p_partkey, ['DOCX', 'pdf', 'odt', 'png', 'Txt'][p_partkey % 5 + 1] AS ext FROM part) WHERE lower(ext) IN ({', '.join(repr(e) for e in status.OFFICE_EXTENSIONS)})")
def office_files(spark: SparkSession, d: str) -> DataFrame:
    ext = F.get(F.array(*map(F.lit, ["DOCX", "pdf", "odt", "png", "Txt"])), (F.col("p_partkey") % 5).cast("int"))
    p = table(spark, d, "part").withColumn("path", F.concat(F.lit("/a.b/c"), F.col("p_partkey").cast("string"), F.lit("."), ext))
    return p.filter(status.is_office(F.col("path"))).select("p_partkey")


@query("ocr_languages", f"SELECT lang, code IN ({', '.join(repr(x) for x in status.OCR_LANGUAGES)}) AS allowed FROM (SELECT DISTINCT lang, CASE lang WHEN 'de' THEN 'deu' WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' ELSE 'xyz' END AS code FROM documents)")
def ocr_languages(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("lang") == "de", "deu").when(F.col("lang") == "en", "eng").when(F.col("lang") == "fr", "fra").otherwise("xyz")
    return table(spark, d, "documents").select("lang").distinct().withColumn("allowed", code.isin(status.OCR_LANGUAGES))


@query("dimension_guards", """SELECT o_orderkey, w <= 10000 AND h <= 10000 AS ocr, w <= 20000 AND h <= 20000 AND w * h <= 120000000 AS render FROM (SELECT o_orderkey, o_orderkey % 23000 AS w, o_custkey * 17 % 24000 AS h FROM orders)""")
def dimension_guards(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 23000).alias("w"), (F.col("o_custkey") * 17 % 24000).alias("h"))
    w, h = F.col("w"), F.col("h")
    return o.select("o_orderkey", status.within_limits(w, h, "ocr").alias("ocr"), status.within_limits(w, h, "render").alias("render"))


@query("newer_versions", """
WITH v AS (SELECT p_partkey, p_size % 4 AS a1, p_partkey % 13 AS a2, p_size % 3 AS b1, p_partkey % 11 AS b2, CASE p_partkey % 5 WHEN 4 THEN 1 ELSE 0 END AS b3 FROM part)
SELECT p_partkey, a1 > b1 OR (a1 = b1 AND (a2 > b2 OR (a2 = b2 AND 0 > b3))) AS newer FROM v""")
def newer_versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions of two parts against those of two or three, of which some have no number."""
    k, s = F.col("p_partkey"), F.col("p_size")
    dotted = lambda *parts: F.concat_ws(".", *[p.cast("string") for p in parts])
    tail = F.get(F.array(F.lit(""), F.lit(".0"), F.lit(".x"), F.lit("."), F.lit(".1")), (k % 5).cast("int"))
    return table(spark, d, "part").select("p_partkey", status.is_newer(dotted(s % 4, k % 13), F.concat(dotted(s % 3, k % 11), tail)).alias("newer"))


@query("provenance_guard", """SELECT event_id, CASE WHEN p = 'DjotThenSave' AND s THEN 'error' WHEN p = 'DjotThenSave' AND o = 'BornPDF' THEN 'warn' ELSE 'allow' END AS verdict FROM
(SELECT event_id, ['BornPDF', 'BornDjot', 'BornOCR'][event_id % 3 + 1] AS o, user_id % 2 = 0 AS s, ['DirectStructural', 'DjotThenSave', 'DjotThenSaveAsCopy'][event_id // 3 % 3 + 1] AS p FROM events)""")
def provenance_guard(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    e = F.col("event_id")
    origin, path = pick(["BornPDF", "BornDjot", "BornOCR"], e % 3), pick(["DirectStructural", "DjotThenSave", "DjotThenSaveAsCopy"], F.floor(e / 3) % 3)
    return table(spark, d, "events").select("event_id", status.provenance_verdict(origin, F.col("user_id") % 2 == 0, path).alias("verdict"))


@query("byte_ranges", """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'Unsigned' WHEN event_id % 13 = 0 THEN 'Malformed' WHEN a < 0 OR b < 0 OR c < 0 OR e < 0 THEN 'Malformed' WHEN a + b > c THEN 'ByteRangeOverlap' WHEN a <> 0 THEN 'ByteRangeMismatch'
WHEN c + e > 900 THEN 'ByteRangeMismatch' WHEN event_id % 17 = 0 THEN 'Unsigned' ELSE 'Ok' END AS status FROM (SELECT event_id, event_id % 5 // 4 AS a, event_id % 300 - 5 AS b, 200 + event_id % 90 AS c, event_id % 700 AS e FROM events)""")
def byte_ranges(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    four = F.array(F.floor(e % 5 / 4), e % 300 - 5, 200 + e % 90, e % 700)
    r = F.when(e % 11 == 0, None).when(e % 13 == 0, F.slice(four, 1, 3)).otherwise(four)
    return table(spark, d, "events").select("event_id", status.byte_range_status(r, F.lit(900), F.when(e % 17 != 0, "x")).alias("status"))


_FLAGS = {"verified": 2, "weak_key": 7, "cert_expired": 5, "eku_ok": 3, "time_ok": 4, "has_dss": 6, "forged_crl": 9, "untrusted_chain": 8, "integrity_ok": 10, "ocsp_no_match": 11, "ocsp_revoked": 13, "unsigned_trailing": 12}


@query("signature_trust", "WITH f AS (SELECT event_id, " + ", ".join(f"event_id % {m} {'<>' if k in ('eku_ok', 'time_ok') else '='} 0 AS {k}" for k, m in _FLAGS.items()) + """ FROM events),
s AS (SELECT *, CASE WHEN weak_key THEN 'WeakKey' WHEN cert_expired THEN 'CertExpired' WHEN verified THEN CASE WHEN eku_ok AND time_ok THEN CASE WHEN has_dss THEN 'ValidWithDSS' ELSE 'Valid' END WHEN NOT eku_ok THEN 'InvalidEKU' ELSE 'SigningTimeOutOfRange' END
WHEN forged_crl THEN 'Invalid' WHEN untrusted_chain OR integrity_ok THEN 'UntrustedChain' ELSE 'Invalid' END AS st FROM f),
o AS (SELECT *, CASE WHEN st IN ('WeakKey', 'CertExpired') THEN st WHEN ocsp_revoked THEN 'Revoked' WHEN ocsp_no_match AND st IN ('Valid', 'ValidWithDSS') THEN 'UntrustedChain' ELSE st END AS s2 FROM s)
SELECT event_id, CASE WHEN unsigned_trailing AND s2 IN ('Valid', 'ValidWithDSS') THEN 'ValidWithUnsignedChanges' ELSE s2 END AS status FROM o""")
def signature_trust(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    for k, m in _FLAGS.items():
        zero = F.col("event_id") % m == 0
        e = e.withColumn(k, ~zero if k in ("eku_ok", "time_ok") else zero)
    return e.select("event_id", status.trust_status(e).alias("status"))


@query("ocsp_match", """WITH s AS (SELECT o_orderkey, o_custkey AS doc_id, o_orderkey % 7 AS serial FROM orders), r AS (SELECT c_custkey AS doc_id, c_nationkey % 7 AS serial FROM customer WHERE c_custkey % 2 = 0)
SELECT o_orderkey, EXISTS (SELECT 1 FROM r WHERE r.doc_id = s.doc_id) AND NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = s.doc_id AND r.serial = s.serial) AS ocsp_no_match FROM s""")
def ocsp_match(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 7).alias("serial"), F.lit("h").alias("issuer_hash"))
    r = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("doc_id"), (F.col("c_nationkey") % 7).cast("bigint").alias("serial"), F.lit("h").alias("issuer_hash"))
    return status.ocsp_matched(s, r, ["doc_id"]).select("o_orderkey", "ocsp_no_match")


@query("permission_flags", "SELECT event_id, " + ", ".join(f"(event_id >> {b - 1}) & 1 = 1 AS {n}" for n, b in status.PERMISSIONS.items()) + " FROM events")
def permission_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", *status.permissions(F.col("event_id")))


@query("stale_files", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 24 HOUR")
def stale_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter(status.stale(F.col("ts"), datetime.datetime(2024, 1, 20, 12))).select("event_id")


@query("orphan_autosaves", """WITH s AS (SELECT user_id, max(ts) AS modified FROM events WHERE event_type = 'click' GROUP BY 1), o AS (SELECT user_id, max(ts) AS modified FROM events WHERE event_type = 'view' AND user_id % 3 <> 0 GROUP BY 1)
SELECT s.user_id FROM s LEFT JOIN o ON s.user_id = o.user_id WHERE o.user_id IS NULL OR s.modified > o.modified""")
def orphan_autosaves(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    last = lambda df: df.groupBy("user_id").agg(F.max("ts").alias("modified"))
    return status.orphan_autosaves(last(e.filter("event_type = 'click'")), last(e.filter("event_type = 'view' AND user_id % 3 <> 0")), "user_id").select("user_id")


@query("page_sizes", """SELECT o_orderkey, CASE WHEN s BETWEEN 590 AND 600 AND l BETWEEN 835 AND 847 THEN 'A4' WHEN s BETWEEN 605 AND 618 AND l BETWEEN 785 AND 798 THEN 'Letter' WHEN s BETWEEN 605 AND 618 AND l BETWEEN 1000 AND 1015 THEN 'Legal' ELSE 'Custom' END AS size
FROM (SELECT o_orderkey, least(w, h) AS s, greatest(w, h) AS l FROM (SELECT o_orderkey, 585 + o_orderkey % 40 AS w, [842, 792, 1008][o_custkey % 3 + 1] + o_orderkey % 5 AS h FROM orders))""")
def page_sizes(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderkey")
    h = F.get(F.array(*map(F.lit, [842, 792, 1008])), (F.col("o_custkey") % 3).cast("int")) + o % 5
    return table(spark, d, "orders").select("o_orderkey", status.page_size(h, 585 + o % 40).alias("size"))


@query("watermark_places", """SELECT p_partkey, CASE p WHEN 'Center' THEN (612 - w) / 2 WHEN 'TopRight' THEN 612 - w - 20 WHEN 'BottomLeft' THEN 20 ELSE 0 END AS x, CASE p WHEN 'Center' THEN (792 - h) / 2 WHEN 'TopRight' THEN 792 - h - 20 WHEN 'BottomLeft' THEN 20 ELSE 0 END AS y, w, h
FROM (SELECT p_partkey, ['Center', 'TopRight', 'BottomLeft', 'Tile'][p_partkey % 4 + 1] AS p, 612.0::DOUBLE * 0.25::DOUBLE AS w, 612.0::DOUBLE * 0.25::DOUBLE * (CAST(p_size AS DOUBLE) / 100) AS h FROM part)""")
def watermark_places(spark: SparkSession, d: str) -> DataFrame:
    place = F.get(F.array(*map(F.lit, ["Center", "TopRight", "BottomLeft", "Tile"])), (F.col("p_partkey") % 4).cast("int"))
    w = status.watermark(F.lit(612.0), F.lit(792.0), F.lit(100), F.col("p_size"), 0.25, place)
    return table(spark, d, "part").select("p_partkey", w.alias("w")).select("p_partkey", "w.*")


@query("cache_hit_rate", "SELECT user_id, count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type <> 'view') AS misses, count(*) FILTER (event_type = 'view') / count(*) AS rate FROM events GROUP BY user_id")
def cache_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    return status.hit_rate(table(spark, d, "events"), ["user_id"], F.col("event_type") == "view")


_COMPRESS = ", ".join(f"('{n}', {dpi}, {q}, {str(s).lower()})" for n, dpi, q, s in status.COMPRESS_PRESETS)


@query("compress_presets", f"""
SELECT p_partkey, name, dpi, quality, strip_metadata, greatest(CAST(trunc(w * least(1.0::DOUBLE, dpi::DOUBLE / 300)) AS INTEGER), 1) AS w
FROM (SELECT p_partkey, p_partkey % 3000 AS w, ['Screen', 'Ebook', 'Printer', 'None'][p_partkey % 4 + 1] AS name FROM part) JOIN (VALUES {_COMPRESS}) t(name, dpi, quality, strip_metadata) USING (name)""")
def compress_presets(spark: SparkSession, d: str) -> DataFrame:
    """Images of 300 dots an inch under a preset by name; an unknown name has none."""
    name = F.get(F.array(*map(F.lit, ["Screen", "Ebook", "Printer", "None"])), (F.col("p_partkey") % 4).cast("int"))
    p = table(spark, d, "part").withColumn("name", name).withColumn("p", status.compress_preset(F.col("name"))).filter("p IS NOT NULL")
    w = F.greatest((F.col("p_partkey") % 3000 * F.least(F.lit(1.0), F.col("p.dpi") / 300)).cast("int"), F.lit(1))
    return p.select("p_partkey", "name", "p.dpi", "p.quality", "p.strip_metadata", w.alias("w"))


@query("sanitized_objects", """SELECT event_id, kind, CASE WHEN event_id % 3 = 0 THEN 'GoTo' END AS action, CASE kind WHEN 'trailer' THEN 'Keep' WHEN 'catalog' THEN 'Info Keep V' WHEN 'page' THEN 'Info Keep V' WHEN 'annotation' THEN 'Info Keep V' WHEN 'field' THEN 'Info Keep' ELSE 'Info Keep V' END AS names
FROM (SELECT event_id, ['trailer', 'catalog', 'page', 'annotation', 'field', 'other'][event_id % 6 + 1] AS kind FROM events) WHERE NOT (kind = 'annotation' AND event_id % 5 = 0)""".replace("WHEN 'trailer' THEN 'Keep'", "WHEN 'trailer' THEN 'AA Keep V'").replace("WHEN 'catalog' THEN 'Info Keep V'", "WHEN 'catalog' THEN 'Info Keep V'").replace("WHEN 'field' THEN 'Info Keep'", "WHEN 'field' THEN 'AA Info Keep'").replace("ELSE 'Info Keep V'", "ELSE 'AA Info Keep V'"))
def sanitized_objects(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    kind = F.get(F.array(*map(F.lit, ["trailer", "catalog", "page", "annotation", "field", "other"])), (e % 6).cast("int"))
    entries = F.create_map(*[F.lit(x) for k in ("AA", "Info", "Keep", "V") for x in (k, "1")])
    o = table(spark, d, "events").select("event_id", kind.alias("kind"), F.when(e % 5 == 0, "Movie").otherwise("Link").alias("subtype"), F.when(e % 3 == 0, "GoTo").when(e % 3 == 1, "URI").alias("action"), entries.alias("entries"))
    return sanitize.sanitize(o).select("event_id", "kind", "action", F.array_join(F.array_sort(F.map_keys("entries")), " ").alias("names"))


@query("downsampled_images", """SELECT p_partkey, greatest(CAST(trunc(w * least(1.0::DOUBLE, 150.0::DOUBLE / dpi)) AS INTEGER), 1) AS w, greatest(CAST(trunc(h * least(1.0::DOUBLE, 150.0::DOUBLE / dpi)) AS INTEGER), 1) AS h FROM (SELECT p_partkey, p_partkey % 3000 AS w, p_size * 40 AS h, 72 + p_partkey % 400 AS dpi FROM part)""")
def downsampled_images(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", sanitize.downsampled(p % 3000, F.col("p_size") * 40, 72 + p % 400, 150).alias("s")).select("p_partkey", "s.*")


@query("marked_content", """SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_nationkey = o.o_orderkey % 25)""")
def marked_content(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 25).alias("mcid"))
    r = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").cast("bigint").alias("mcid"))
    return sanitize.marked_content(e, r).select("o_orderkey", "o_custkey")


@query("detector_json", """SELECT user_id, CAST(event_id AS DOUBLE) AS x, 20.0::DOUBLE AS w, CASE WHEN event_id % 2 = 0 THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM events WHERE event_id % 7 <> 0""")
def detector_json(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    box = F.when(e % 7 != 0, F.array(e.cast("double"), F.lit(1.0), e + 20.0, F.lit(9.0))).otherwise(F.array(e.cast("double"), F.lit(1.0)))
    item = F.struct(box.alias("bbox"), F.when(e % 2 == 0, 0.5).alias("text_line_score"))
    docs = table(spark, d, "events").groupBy("user_id").agg(F.to_json(F.collect_list(item)).alias("json"))
    return records.detector_lines(docs, ["user_id"], "json").select("user_id", "x", "w", "confidence")


@query("validation_report", """SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id""")
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    check = F.struct(F.lit("6.1").alias("clause"), F.col("event_id").cast("string").alias("ruleId"), F.lit('a "quoted" text').alias("description"), (F.col("event_id") % 9).cast("int").alias("page"))
    docs = table(spark, d, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.collect_list(check).alias("failedChecks"))
    report = F.struct(F.struct(F.array(F.struct(F.struct("failedChecks").alias("validationResult"))).alias("jobs")).alias("report"))
    rows = records.violations(docs.select("user_id", F.to_json(report).alias("json")), ["user_id"], "json")
    return records.violation_report(rows, ["user_id"]).select("user_id", "n")


@query("export_presets", """SELECT s_suppkey, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 300 ELSE 150 END AS dpi, true AS compressed, false AS "pdfA" FROM supplier""")
def export_presets(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    json = F.to_json(F.array(F.struct(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, 300).alias("dpi"))))
    return records.presets(s.select("s_suppkey", json.alias("json")), ["s_suppkey"], "json").select("s_suppkey", "name", "dpi", "compressed", "pdfA")


@query("update_manifests", """SELECT s_suppkey, '1.' || s_suppkey AS version FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 4 <> 0""")
def update_manifests(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    url = F.when(k % 3 == 0, "http://example.org/x").otherwise("HTTPS://example.org/x")
    m = F.to_json(F.struct(F.concat(F.lit("1."), k.cast("string")).alias("version"), url.alias("downloadUrl"), F.when(k % 4 != 0, "ab").otherwise(" ").alias("sha256")))
    return records.update_manifest(table(spark, d, "supplier").select("s_suppkey", m.alias("json")), ["s_suppkey"], "json").select("s_suppkey", "version")


@query("document_metadata", "SELECT doc_id, 'T' || doc_id AS title, lang || ', ' || source AS keywords FROM documents")
def document_metadata(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"), F.lit("a").alias("author"), F.lit("s").alias("subject"), F.array("lang", "source").alias("keywords"), F.lit("c").alias("creator"), F.lit("p").alias("producer"))
    return records.metadata(t, ["doc_id"]).select("doc_id", "title", "keywords")


@query("character_cells", "SELECT doc_id, length(text) AS n, CASE WHEN length(text) > 0 THEN (length(text) - 1) * 6.0::DOUBLE END AS last_x FROM documents WHERE text IS NOT NULL")
def character_cells(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", records.characters(F.col("text")).alias("c"))
    return t.select("doc_id", F.size("c").cast("bigint").alias("n"), F.try_element_at("c", F.lit(-1))["x"].alias("last_x"))


@query("embedded_files", """WITH RECURSIVE t AS (SELECT conv_id, turn, role AS name FROM conversations WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn, c.role FROM conversations c JOIN t ON c.conv_id = t.conv_id AND c.turn = t.turn + 1)
SELECT conv_id AS doc_id, name, count(*) AS n FROM t GROUP BY 1, 2""")
def embedded_files(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("node"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent"), F.col("role").alias("name"))
    return records.embedded_files(c).groupBy("doc_id", "name").agg(F.count("*").alias("n"))


@query("font_and_initials", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '?' ELSE upper(substr(c_name, 1, 1)) END AS initial, split_part(c_name, '#', 1) AS font FROM customer")
def font_and_initials(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_name"))
    font = F.concat(F.lit("/ABCDEF+"), F.regexp_extract("c_name", "^[^#]*", 0), F.lit("-Bold"))
    return table(spark, d, "customer").select("c_custkey", strings.initial(name).alias("initial"), strings.base_font(font).alias("font"))


@query("word_attribute_strings", """SELECT event_id, a || '|f' || user_id || '.pdf' AS joined, a AS attributes, 'f' || user_id || '.pdf' AS path FROM (SELECT event_id, user_id, '{pdf-page=' || user_id % 9 || ' pdf-bbox="1 2 3 4" pdf-font="F" ocr-conf=0.92}' AS a FROM events)""")
def word_attribute_strings(spark: SparkSession, d: str) -> DataFrame:
    one = [F.lit(v) for v in (1, 2, 3, 4)]
    a = strings.word_attributes(F.col("user_id") % 9, *one, F.lit("F"), F.lit(92))
    e = table(spark, d, "events").select("event_id", strings.provenance(a, F.concat(F.lit("f"), F.col("user_id").cast("string"), F.lit(".pdf"))).alias("joined"))
    return e.select("event_id", "joined", strings.provenance_parts(F.col("joined")).alias("p")).select("event_id", "joined", "p.*")


@query("header_versions", "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN '1.' || (doc_id % 8) ELSE '1.7' END AS version FROM documents")
def header_versions(spark: SparkSession, d: str) -> DataFrame:
    """Two texts of three get a header in front; the others have none."""
    body = F.coalesce("text", F.lit(""))
    headed = F.concat(F.lit("%PDF-1."), F.col("doc_id") % 8, F.lit("\n"), body)
    content = F.encode(F.when(F.col("doc_id") % 3 != 0, headed).otherwise(body), "UTF-8")
    return table(spark, d, "documents").select("doc_id", status.header_version(content).alias("version"))


@query("layer_names", "SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS place, role AS name FROM conversations WHERE turn < 5 AND turn <> 1")
def layer_names(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("object"), F.when(F.col("turn") != 1, F.col("role")).alias("name"))
    catalogs = c.groupBy("doc_id").agg(F.sequence(F.lit(0), F.max("object")).alias("groups"))
    return records.layers(catalogs, c.filter("object <> 5"))
