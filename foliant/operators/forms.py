"""Form data: scan, exchange as CSV and FDF, filling, flattening, and changes to fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.strings import csv_quote

#: Kinds of fields that filling leaves as they are.
NOT_FILLED = ["radio", "button", "signature"]
#: What detection proposes, whatever the page.
DETECTED = [("AutoName", "Text", 100.0, 200.0, 200.0, 25.0), ("AutoDate", "Date", 100.0, 250.0, 200.0, 25.0), ("AutoCheck", "Checkbox", 100.0, 300.0, 20.0, 20.0)]
CSV_HEADER = "FieldName,FieldValue"


def fields(df: DataFrame, keys: list[str], values: str) -> DataFrame:
    """(keys, name, value) of a map column."""
    return df.select(*keys, F.explode(F.map_entries(values)).alias("e")).select(*keys, F.col("e.key").alias("name"), F.col("e.value").alias("value"))


def from_props(df: DataFrame, keys: list[str], json: str) -> DataFrame:
    """(keys, name, value) of a flat JSON object."""
    return fields(df.withColumn("_m", F.from_json(json, "map<string, string>")), keys, "_m")


def has_xfa(names: Column) -> Column:
    return F.exists(names, lambda n: n == "XFA")


def to_csv(values: DataFrame, keys: list[str]) -> DataFrame:
    """One CSV text for each key: a header, then fields by name."""
    line = F.concat(csv_quote(F.col("name")), F.lit(","), csv_quote(F.col("value")))
    rows = values.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("name", line.alias("line")))).alias("_l"))
    return rows.select(*keys, F.concat(F.lit(CSV_HEADER + "\n"), F.array_join(F.transform("_l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("csv"))


def pdf_escape(text: Column) -> Column:
    """Backslash and brackets of a literal string."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([\\()])", r"\\$1")


def to_fdf(values: DataFrame, keys: list[str]) -> DataFrame:
    entry = F.concat(F.lit("<< /T ("), pdf_escape(F.col("name")), F.lit(") /V ("), pdf_escape(F.col("value")), F.lit(") >>"))
    rows = values.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("name", entry.alias("entry")))).alias("_l"))
    body = F.array_join(F.transform("_l", lambda x: x["entry"]), "\n")
    return rows.select(*keys, F.concat(F.lit("%FDF-1.2\n1 0 obj\n<< /FDF << /Fields [\n"), body, F.lit("\n] >> >>\nendobj\ntrailer\n<< /Root 1 0 R >>\n%%EOF\n")).alias("fdf"))


def _last_of_each(pairs: Column) -> Column:
    """A map of name to value from pairs in order; the last of a name holds."""
    # An accumulated map without the name, then with it anew.
    empty = F.create_map().cast("map<string,string>")
    return F.aggregate(pairs, empty, lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["name"]), F.create_map(p["name"], p["value"])))


def from_csv(text: Column) -> Column:
    """Name to value of a two-column CSV text with a header; doubled quotes are undone in both columns."""
    lines = F.filter(F.slice(F.split(text, "\r?\n"), 2, 1 << 30), lambda x: x.contains('","'))
    undo = lambda s: F.replace(s, F.lit('""'), F.lit('"'))
    cells = F.transform(lines, lambda x: F.split(F.regexp_replace(x, '^"|"$', ""), '","', 2))
    return _last_of_each(F.transform(cells, lambda c: F.struct(undo(c[0]).alias("name"), undo(c[1]).alias("value"))))


def from_fdf(text: Column) -> Column:
    """Name to value of all /T (...) /V (...) entries."""
    entry = r"/T\s*\(((?:[^()\\]|\\.)*)\)\s*/V\s*\(((?:[^()\\]|\\.)*)\)"
    undo = lambda s: F.regexp_replace(s, r"\\([\\()])", "$1")
    names, values = (F.regexp_extract_all(text, F.lit(entry), i) for i in (1, 2))
    return _last_of_each(F.transform(names, lambda n, i: F.struct(undo(n).alias("name"), undo(F.get(values, i)).alias("value"))))


def fill(form: DataFrame, data: DataFrame, keys: list[str]) -> DataFrame:
    """form: (keys, name, kind, value); data: (keys, name, value).

    Matched fields take the value, unless their kind is left as it is, and become read-only in
    any case; the others stay untouched.
    """
    d = data.select(*keys, "name", F.col("value").alias("_new"), F.lit(True).alias("_hit"))
    out = form.join(d, [*keys, "name"], "left")
    takes = F.col("_hit").isNotNull() & ~F.col("kind").isin(NOT_FILLED)
    coerced = F.when(F.col("kind") == "checkbox", F.when(F.lower("_new").isin("true", "1", "yes", "on"), "true").otherwise("false")).otherwise(F.col("_new"))
    return out.select(*keys, "name", "kind", F.when(takes, coerced).otherwise(F.col("value")).alias("value"), F.col("_hit").isNotNull().alias("read_only"))


def flatten(form: DataFrame, texts: DataFrame) -> DataFrame:
    """Filled fields become text elements (doc_id, page_no, x, y, text); no field is left."""
    drawn = form.filter("value IS NOT NULL AND value <> ''").select("doc_id", "page_no", "x", "y", F.col("value").alias("text"))
    return texts.unionByName(drawn)


def remove(form: DataFrame, names: DataFrame) -> DataFrame:
    return form.join(names.select("name").distinct(), "name", "left_anti")


def move(form: DataFrame, name: str, x: float, y: float, w: float, h: float) -> DataFrame:
    new = {"x": x, "y": y, "w": w, "h": h}
    return form.withColumns({c: F.when(F.col("name") == name, F.lit(v)).otherwise(F.col(c)) for c, v in new.items()})


def tab_order(form: DataFrame, order: list[str]) -> DataFrame:
    """Named fields first, in the given order; the others after them, as they were."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("name")) if order else F.lit(0).cast("bigint")
    return form.withColumn("tab", F.when(place > 0, place - 1).otherwise(F.col("ordinal") + len(order)))


def detected(form: DataFrame, key: str) -> DataFrame:
    # The same three proposals for every page, whatever is on it: an array literal, not a join.
    proposals = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("name", "kind", "x", "y", "w", "h"), row, strict=True)]) for row in DETECTED])
    return form.select(key).distinct().select(key, F.explode(proposals).alias("f")).select(key, "f.*")
