"""Queries over document texts: patterns, redaction, search, replacement, tokens, escapes, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import patterns, strings
from foliant.operators import dedup, documents, redaction, search
from foliant.plans.registry import query, table

_NAMES = list(patterns.NAMED)
_MARK = "[X]"


def _counts(source: str) -> str:
    return " UNION ALL ".join(f"SELECT lang, '{n}' AS pattern, len(regexp_extract_all(text, '{p}')) AS n FROM {source}" for n, p in patterns.NAMED.items())


@query("pattern_match_counts", f"""
SELECT lang, pattern, count(*) FILTER (n > 0) AS n_docs, CAST(sum(n) AS BIGINT) AS n_matches FROM ({_counts("documents")}) GROUP BY lang, pattern HAVING sum(n) > 0""")
def pattern_match_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    found = F.array(*[F.struct(F.lit(n).alias("pattern"), patterns.count(F.col("text"), p).alias("n")) for n, p in patterns.NAMED.items()])
    # One pass over the texts; rows without matches go before the shuffle.
    hits = docs.select("lang", F.explode(F.filter(found, lambda x: x["n"] > 0)).alias("m"))
    return hits.groupBy("lang", F.col("m.pattern").alias("pattern")).agg(F.count("*").alias("n_docs"), F.sum("m.n").alias("n_matches"))


_CATALOG = ", ".join(f"({i}, '{n}', '{p}')" for i, (n, p) in enumerate(patterns.NAMED.items()))


@query("pattern_catalog", f"""
SELECT position, name, t.pattern, coalesce(n_docs, 0) AS n_docs FROM (VALUES {_CATALOG}) t(position, name, pattern)
LEFT JOIN (SELECT pattern AS name, count(*) AS n_docs FROM ({_counts("documents")}) WHERE n > 0 GROUP BY 1) USING (name)""")
def pattern_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue of patterns, and how many documents have a match of each."""
    has = F.array(*[F.when(patterns.count(F.col("text"), p) > 0, n) for n, p in patterns.NAMED.items()])
    found = table(spark, d, "documents").select(F.explode(F.array_compact(has)).alias("name")).groupBy("name").agg(F.count("*").alias("n_docs"))
    return patterns.available_patterns(spark).join(found, "name", "left").select("position", "name", "pattern", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


@query("pattern_matches", f"""
WITH m AS (SELECT doc_id, regexp_extract_all(text, '{patterns.NAMED["email"]}') AS f FROM documents)
SELECT doc_id, generate_subscripts(f, 1) - 1 AS seq, unnest(f) AS match FROM m""")
def pattern_matches(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    found = patterns.matches(F.col("text"), patterns.named_pattern("email"))
    return docs.select("doc_id", F.posexplode(found).alias("seq", "match")).withColumn("seq", F.col("seq").cast("bigint"))


@query("pattern_spans", f"""
WITH m AS (SELECT doc_id, regexp_extract_all(text, '{patterns.NAMED["ipv4"]}') AS f, regexp_split_to_array(text, '{patterns.NAMED["ipv4"]}') AS g FROM documents WHERE regexp_matches(text, '{patterns.NAMED["ipv4"]}')),
e AS (SELECT doc_id, f, g, unnest(generate_series(1, len(f))) AS k FROM m)
SELECT doc_id, CAST(k - 1 AS INTEGER) AS seq, f[k] AS match, CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:k - 1], lambda x: length(x))), 0) AS INTEGER) AS start FROM e""")
def pattern_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every match of each document with its place."""
    docs = table(spark, d, "documents")
    spans = docs.select("doc_id", F.posexplode(patterns.match_spans(F.col("text"), patterns.named_pattern("ipv4"))).alias("seq", "s"))
    return spans.select("doc_id", "seq", "s.match", "s.start")


def _redacted_sql(column: str) -> str:
    for n in _NAMES:
        column = f"regexp_replace({column}, '{patterns.NAMED[n]}', '{_MARK}', 'g')"
    return column


@query("pattern_redact_text", f"SELECT doc_id, sha256({_redacted_sql('text')}) AS redacted_sha256, length({_redacted_sql('text')}) AS redacted_chars FROM documents")
def pattern_redact_text(spark: SparkSession, d: str) -> DataFrame:
    out = redaction.redact_patterns(table(spark, d, "documents").select("doc_id", "text"), "text", _NAMES, _MARK)
    return out.select("doc_id", F.sha2("text", 256).alias("redacted_sha256"), F.length("text").cast("bigint").alias("redacted_chars"))


def _audit_sql() -> str:
    column, counts = "text", []
    for n in _NAMES:
        counts.append(f"CASE WHEN len(regexp_extract_all({column}, '{patterns.NAMED[n]}')) > 0 THEN '{n}:' || len(regexp_extract_all({column}, '{patterns.NAMED[n]}')) END")
        column = f"regexp_replace({column}, '{patterns.NAMED[n]}', '{_MARK}', 'g')"
    return f"SELECT * FROM (SELECT doc_id, concat_ws(',', {', '.join(counts)}) AS operations, sha256(text) AS before_sha256, sha256({column}) AS after_sha256 FROM documents) WHERE operations <> ''"


@query("redaction_audit", _audit_sql())
def redaction_audit(spark: SparkSession, d: str) -> DataFrame:
    return redaction.audit(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", _NAMES, _MARK)


@query("redact_literal", "SELECT doc_id, sha256(replace(text, 'the', '[X]')) AS text_sha256 FROM documents WHERE contains(text, 'the')")
def redact_literal(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text").filter(F.contains("text", F.lit("the")))
    return redaction.redact_literal(docs, "text", "the", "[X]").select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query("search_documents", r"""
SELECT doc_id, len(regexp_extract_all(text, '(?i)\b(?:licen[cs]e)\b')) AS n_hits FROM documents WHERE regexp_matches(text, '(?i)\b(?:licen[cs]e)\b')""")
def search_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return search.search(docs, "text", "licen[cs]e", whole_word=True, is_regex=True).select("doc_id", F.col("n_hits").cast("bigint").alias("n_hits"))


@query("search_fixed_string", "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'tion the')")
def search_fixed_string(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(search.contains(F.col("text"), "Tion The")).select("doc_id", "lang")


@query("search_first_comment", "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'th') ORDER BY conv_id, turn LIMIT 1")
def search_first_comment(spark: SparkSession, d: str) -> DataFrame:
    return search.first_hit(table(spark, d, "conversations"), "text", "TH", ["conv_id", "turn"]).select("conv_id", "turn")


@query("search_positions", """
WITH l AS (SELECT doc_id, string_split(text, 'and') AS g FROM documents WHERE contains(text, 'and'))
SELECT doc_id, len(g) - 1 AS n, CAST(length(g[1]) AS INTEGER) AS first_at,
       CAST(list_sum(list_transform(g[1:len(g) - 1], lambda x: length(x))) + 3 * (len(g) - 2) AS INTEGER) AS last_at FROM l""")
def search_positions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter(F.contains("text", F.lit("and"))).select("doc_id", search.positions(F.col("text"), "and").alias("p"))
    return docs.select("doc_id", F.size("p").cast("bigint").alias("n"), F.get("p", F.lit(0)).alias("first_at"), F.element_at("p", -1).alias("last_at"))


@query("find_replace", "SELECT doc_id, CAST((length(text) - length(replace(text, 'ing', ''))) / 3 AS BIGINT) AS n_replaced, sha256(replace(text, 'ing', 'en')) AS text_sha256 FROM documents")
def find_replace(spark: SparkSession, d: str) -> DataFrame:
    out = search.replace_all(table(spark, d, "documents").select("doc_id", "text"), "text", "ing", "en")
    return out.select("doc_id", "n_replaced", F.sha2("text", 256).alias("text_sha256"))


@query("replace_first", """
SELECT doc_id, sha256(CASE WHEN strpos(text, 'ing') > 0 THEN substr(text, 1, strpos(text, 'ing') - 1) || 'en' || substr(text, strpos(text, 'ing') + 3) ELSE text END) AS text_sha256 FROM documents""")
def replace_first(spark: SparkSession, d: str) -> DataFrame:
    return search.replace_first(table(spark, d, "documents").select("doc_id", "text"), "text", "ing", "en").select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query("token_stats", r"""
WITH t AS (SELECT lang, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM documents)
SELECT lang, count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_tokens, max(len(w)) AS most_tokens, CAST(sum(len(list_distinct(w))) AS BIGINT) AS n_types FROM t GROUP BY lang""")
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("lang", strings.tokens(F.col("text")).alias("w"))
    return t.groupBy("lang").agg(
        F.count("*").alias("n_docs"),
        F.sum(F.size("w")).alias("n_tokens"),
        F.max(F.size("w")).cast("bigint").alias("most_tokens"),
        F.sum(F.size(F.array_distinct("w"))).alias("n_types"),
    )


@query("escaped_text", r"""
SELECT doc_id, sha256(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS xml_sha256,
       sha256(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS html_sha256,
       sha256(regexp_replace(text, '([\\*_`\[\]{}^~<>])', '\\\1', 'g')) AS djot_sha256,
       sha256('"' || replace(text, '"', '""') || '"') AS csv_sha256 FROM documents""")
def escaped_text(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    named = {"xml": strings.xml_escape(t), "html": strings.html_escape(t), "djot": strings.djot_escape(t), "csv": strings.csv_quote(t)}
    return table(spark, d, "documents").select("doc_id", *[F.sha2(v, 256).alias(f"{k}_sha256") for k, v in named.items()])


@query("literal_escapes", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(hex(encode(replace(coalesce(text, ''), '\', '/'))), '..') AS b FROM documents),
e AS (SELECT doc_id, len(list_filter(b, lambda x: (x < '20' AND x NOT IN ('08', '09', '0A', '0C', '0D')) OR x > '7E')) = 0 AS plain, array_to_string(list_transform(b, lambda x: CASE WHEN x IN ('28', '29') THEN '\' || chr(CAST('0x' || x AS INTEGER)) WHEN x = '0A' THEN '\n' WHEN x = '0D' THEN '\r' WHEN x = '09' THEN '\t'
      WHEN x = '08' THEN '\b' WHEN x = '0C' THEN '\f' WHEN x < '20' OR x > '7E' THEN '\' || (CAST('0x' || x AS INTEGER) // 64) || (CAST('0x' || x AS INTEGER) // 8 % 8) || (CAST('0x' || x AS INTEGER) % 8)
      ELSE chr(CAST('0x' || x AS INTEGER)) END), '') AS t FROM d)
SELECT doc_id, sha256(t) AS escaped_sha256, length(t) AS n_chars, plain AS again_the_same, true AS back_again FROM e""")
def literal_escapes(spark: SparkSession, d: str) -> DataFrame:
    """Texts as literal strings, without backslashes of their own; whether a second escape changes nothing, as where no byte is in octal, and the first can be undone."""
    docs = table(spark, d, "documents").select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit("\\"), F.lit("/")).alias("text"))
    e = docs.withColumn("e", strings.literal_escape(F.col("text")))
    same = (strings.literal_escape(F.col("e")) == F.col("e")).alias("again_the_same")
    return e.select("doc_id", F.sha2("e", 256).alias("escaped_sha256"), F.length("e").cast("bigint").alias("n_chars"), same, (strings.literal_unescape(F.col("e")) == F.col("text")).alias("back_again"))


_TAGS = {k: [t.replace("'", "''") for t in v] for k, v in documents.PREVIEW_BLOCKS.items()}
_ESC = lambda c: f"replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;')"
_CELL = lambda tag, style, c: f"'<{tag} style=''{style}''>' || {c} || '</{tag}>'"


@query("preview_html", f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, n, n // 20 AS p, CASE n % 6
  WHEN 0 THEN '{_TAGS["Heading"][0]}' || {_ESC("t")} || '{_TAGS["Heading"][1]}'
  WHEN 1 THEN '{_TAGS["Paragraph"][0]}' || '<b>' || {_ESC("t")} || '</b>' || ' &amp; ' || '<i>x&lt;y</i>' || '{_TAGS["Paragraph"][1]}'
  WHEN 2 THEN '{_TAGS["Figure"][0]}' || {_ESC("t")} || '{_TAGS["Figure"][1]}'
  WHEN 3 THEN '{_TAGS["List"][0]}' || array_to_string(list_transform(string_split(t, ' '), lambda w: '<li>' || {_ESC("w")} || '</li>'), '') || '{_TAGS["List"][1]}'
  WHEN 4 THEN '{_TAGS["Table"][0]}' || '<tr>' || {_CELL("th", documents.PREVIEW_HEAD, "n")} || {_CELL("th", documents.PREVIEW_HEAD, _ESC("t"))} || '</tr><tr>' || {_CELL("td", documents.PREVIEW_CELL, _ESC("t"))} || '</tr>' || '{_TAGS["Table"][1]}'
  ELSE '{_TAGS["CodeBlock"][0]}' || {_ESC("t")} || chr(10) || '{_TAGS["CodeBlock"][1]}' END AS h FROM l),
s AS (SELECT doc_id, p, CASE WHEN p % 2 = 1 THEN '{documents.PREVIEW_TITLE.replace("'", "''")}' || 'Page &quot;' || p || '&quot;</h2>' ELSE '' END || string_agg(h, '' ORDER BY n) AS h FROM b GROUP BY doc_id, p)
SELECT doc_id, sha256('{documents.PREVIEW_OPEN.replace("'", "''")}' || string_agg(h, '' ORDER BY p) || '</body></html>') AS html_sha256 FROM s GROUP BY doc_id""")
def preview_html(spark: SparkSession, d: str) -> DataFrame:
    """Every line a block of one of six kinds, pages of 20 lines, every other page with a title."""
    lines = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "t"))
    inline = lambda kind, *texts: F.struct(F.lit(kind).alias("kind"), F.array(*texts).alias("texts"))
    plain = lambda c: F.array(inline("Text", c))
    node = lambda row, cell, inlines: F.struct(row.alias("row_no"), cell.alias("cell_no"), inlines.alias("inlines"))
    zero, k, t = F.lit(0), F.col("n") % 6, F.col("t")
    marked = F.array(inline("Strong", t), inline("Text", F.lit(" & ")), inline("Emph", F.lit("x<"), F.lit("y")))
    items = F.transform(F.split(t, " ", -1), lambda w, i: node(i, zero, plain(w)))
    table_cells = F.array(node(zero, zero, plain(F.col("n").cast("string"))), node(zero, F.lit(1), plain(t)), node(F.lit(1), zero, plain(t)))
    made = F.when(k == 1, F.array(node(zero, zero, marked))).when(k == 3, items).when(k == 4, table_cells).otherwise(F.array(node(zero, zero, plain(t))))
    kind = F.get(F.array(*map(F.lit, ["Heading", "Paragraph", "Figure", "List", "Table", "CodeBlock"])), k)
    page = F.floor(F.col("n") / 20).cast("int")
    nodes = lines.select("doc_id", page.alias("page_no"), F.col("n").alias("block"), kind.alias("kind"), F.explode(made).alias("x")).select("doc_id", "page_no", "block", "kind", "x.*")
    sections = lines.select("doc_id", page.alias("page_no")).distinct().withColumn("title", F.when(F.col("page_no") % 2 == 1, F.concat(F.lit('Page "'), F.col("page_no").cast("string"), F.lit('"'))))
    return documents.to_preview(nodes, sections).select("doc_id", F.sha2("html", 256).alias("html_sha256"))


@query("exact_duplicates", """
SELECT sha256(text) AS text_sha256, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_groups(table(spark, d, "documents"), "doc_id", F.sha2("text", 256)).withColumnRenamed("digest", "text_sha256")


@query("duplicate_map", """
SELECT doc_id, first_doc FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_doc FROM documents) WHERE doc_id <> first_doc""")
def duplicate_map(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_map(table(spark, d, "documents"), "doc_id", F.sha2("text", 256))


@query("optimize_estimate", """
WITH s AS (SELECT doc_id % 10 AS file, text, octet_length(encode(text)) AS bytes FROM documents),
g AS (SELECT file, count(*) AS images, CAST(sum(bytes) AS BIGINT) AS image_bytes, count(*) - count(DISTINCT md5(substr(text, 1, 1024))) AS duplicates, count(DISTINCT length(text) % 7) AS fonts,
             CAST(sum(bytes) + 1000 * count(*) AS BIGINT) AS original FROM s GROUP BY file),
e AS (SELECT *, CAST(trunc(image_bytes * (1.0::DOUBLE - (150.0::DOUBLE / 300.0) * (150.0::DOUBLE / 300.0))) AS BIGINT) + duplicates * (image_bytes // images) + fonts * 15000 + original // 20 AS savings FROM g)
SELECT file, images, image_bytes, duplicates, fonts, original, greatest(original - savings, original // 10) AS estimated FROM e""")
def optimize_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Ten files whose images stand in for by document texts."""
    docs = table(spark, d, "documents")
    parts = docs.select((F.col("doc_id") % 10).alias("file"), F.octet_length("text").cast("bigint").alias("bytes"), F.md5(F.substring("text", 1, 1024).cast("binary")).alias("digest"), (F.length("text") % 7).alias("font"))
    return dedup.optimize_estimate(parts, ["file"], target_dpi=150)
