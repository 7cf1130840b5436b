"""Form queries: events stand in for form records; their JSON properties and columns are the fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import forms
from foliant.plans.registry import query, table

_EVENT_FIELDS = """SELECT event_id, name, value FROM (SELECT event_id, unnest(['k', 'type', 'note']) AS name, unnest([json_extract_string(props, '$.k'), event_type, event_type || ' "' || user_id || '"']) AS value FROM events)"""


def _values(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    note = F.concat("event_type", F.lit(' "'), F.col("user_id").cast("string"), F.lit('"'))
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in (("k", k), ("type", F.col("event_type")), ("note", note))])
    return e.select("event_id", F.explode(pairs).alias("p")).select("event_id", "p.name", "p.value")


@query("form_fields", "SELECT event_id, 'k' AS name, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def form_fields(spark: SparkSession, d: str) -> DataFrame:
    return forms.from_props(table(spark, d, "events"), ["event_id"], "props")


@query("form_export_csv", f"""SELECT event_id, 'FieldName,FieldValue' || chr(10) || string_agg('"' || name || '","' || replace(coalesce(value, ''), '"', '""') || '"', chr(10) ORDER BY name) || chr(10) AS csv FROM ({_EVENT_FIELDS}) GROUP BY event_id""")
def form_export_csv(spark: SparkSession, d: str) -> DataFrame:
    return forms.to_csv(_values(spark, d), ["event_id"])


@query("form_export_fdf", f"""SELECT event_id, '%FDF-1.2' || chr(10) || '1 0 obj' || chr(10) || '<< /FDF << /Fields [' || chr(10) ||
string_agg('<< /T (' || name || ') /V (' || regexp_replace(coalesce(value, ''), '([\\\\()])', '\\\\\\1', 'g') || ') >>', chr(10) ORDER BY name) || chr(10) ||
'] >> >>' || chr(10) || 'endobj' || chr(10) || 'trailer' || chr(10) || '<< /Root 1 0 R >>' || chr(10) || '%%EOF' || chr(10) AS fdf FROM ({_EVENT_FIELDS}) GROUP BY event_id""")
def form_export_fdf(spark: SparkSession, d: str) -> DataFrame:
    return forms.to_fdf(_values(spark, d), ["event_id"])


@query("form_import_csv", _EVENT_FIELDS.replace("unnest([json_extract_string(props, '$.k'), ", "unnest([coalesce(json_extract_string(props, '$.k'), ''), "))
def form_import_csv(spark: SparkSession, d: str) -> DataFrame:
    """A round trip: the export read again."""
    csv = forms.to_csv(_values(spark, d), ["event_id"])
    return forms.fields(csv.withColumn("m", forms.from_csv(F.col("csv"))), ["event_id"], "m")


@query("form_import_fdf", _EVENT_FIELDS.replace("unnest([json_extract_string(props, '$.k'), ", "unnest([coalesce(json_extract_string(props, '$.k'), ''), "))
def form_import_fdf(spark: SparkSession, d: str) -> DataFrame:
    fdf = forms.to_fdf(_values(spark, d), ["event_id"])
    return forms.fields(fdf.withColumn("m", forms.from_fdf(F.col("fdf"))), ["event_id"], "m")


@query("form_fill", f"""WITH v AS ({_EVENT_FIELDS}),
f AS (SELECT event_id, unnest(['k', 'type', 'note', 'other']) AS name, unnest(['text', CASE WHEN user_id % 3 = 0 THEN 'radio' ELSE 'text' END, 'checkbox', 'text']) AS kind, 'old' AS value FROM events)
SELECT f.event_id, f.name, kind, CASE WHEN v.name IS NULL OR kind = 'radio' THEN f.value WHEN kind = 'checkbox' THEN CASE WHEN lower(v.value) IN ('true', '1', 'yes', 'on') THEN 'true' ELSE 'false' END ELSE v.value END AS value,
       v.name IS NOT NULL AS read_only FROM f LEFT JOIN v ON f.event_id = v.event_id AND f.name = v.name""")
def form_fill(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kinds = {"k": F.lit("text"), "type": F.when(F.col("user_id") % 3 == 0, "radio").otherwise("text"), "note": F.lit("checkbox"), "other": F.lit("text")}
    rows = F.array(*[F.struct(F.lit(n).alias("name"), k.alias("kind"), F.lit("old").alias("value")) for n, k in kinds.items()])
    form = e.select("event_id", F.explode(rows).alias("f")).select("event_id", "f.*")
    return forms.fill(form, _values(spark, d), ["event_id"])


@query("form_flatten", """SELECT doc_id, page_no, x, y, text FROM (
SELECT event_id AS doc_id, 0 AS page_no, 1.0::DOUBLE AS x, 2.0::DOUBLE AS y, 'label' AS text FROM events
UNION ALL SELECT event_id, 0, value, 3.0::DOUBLE, event_type FROM events WHERE event_type <> 'error')""")
def form_flatten(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.lit(0).alias("page_no"), F.col("value").alias("x"), F.lit(3.0).alias("y"), "event_type")
    form = e.select("doc_id", "page_no", "x", "y", F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("").alias("value"))
    texts = e.select("doc_id", "page_no", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit("label").alias("text"))
    return forms.flatten(form, texts)


@query("form_field_changes", """SELECT event_id, event_type AS name, CASE WHEN event_type = 'click' THEN 5.0::DOUBLE ELSE value END AS x,
CASE event_type WHEN 'signup' THEN 0 WHEN 'click' THEN 1 ELSE event_id + 2 END AS tab FROM events WHERE event_type NOT IN ('error', 'view')""")
def form_field_changes(spark: SparkSession, d: str) -> DataFrame:
    """Fields removed, one moved, and a tab order set."""
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("name"), F.col("value").alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("w"), F.lit(1.0).alias("h"), F.col("event_id").alias("ordinal"))
    gone = spark.createDataFrame([("error",), ("view",)], "name string")
    moved = forms.move(forms.remove(e, gone), "click", 5.0, 0.0, 1.0, 1.0)
    return forms.tab_order(moved, ["signup", "click"]).select("event_id", "name", "x", "tab")


@query("form_detect", "SELECT n_nationkey AS page, name, kind, x, y FROM nation, (VALUES " + ", ".join(f"('{n}', '{k}', {x}::DOUBLE, {y}::DOUBLE)" for n, k, x, y, _, _ in forms.DETECTED) + ") t(name, kind, x, y)")
def form_detect(spark: SparkSession, d: str) -> DataFrame:
    return forms.detected(table(spark, d, "nation").withColumnRenamed("n_nationkey", "page"), "page").select("page", "name", "kind", "x", "y")
