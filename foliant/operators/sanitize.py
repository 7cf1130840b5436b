"""Sanitising of document objects, held as rows with a map of their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys dropped from each kind of object.
DROPPED = {
    "trailer": ["Info"],
    "catalog": ["Metadata", "PieceInfo", "MarkInfo", "OutputIntents", "EmbeddedFiles", "JavaScript", "OpenAction", "AA", "OCProperties", "Outlines", "Collection"],
    "page": ["AA", "A", "PieceInfo", "Thumb", "Metadata"],
    "annotation": ["Contents", "RC", "AA"],
    "field": ["V", "DV"],
    "struct": ["Alt", "ActualText", "E"],
}
KEPT_ACTIONS = ["GoTo"]
REMOVED_SUBTYPES = ["RichMedia", "Screen", "Movie"]


def pruned(kind: Column, entries: Column) -> Column:
    """The map without the keys that its kind loses."""
    out = entries
    for k, keys in DROPPED.items():
        out = F.when(kind == k, F.map_filter(entries, _not_in(keys))).otherwise(out)
    return out


def _not_in(keys: list[str]):
    return lambda name, _: ~name.isin(keys)


def allowed_action(action: Column) -> Column:
    """Only actions on the list stay; what is unknown or null goes."""
    return F.coalesce(action.isin(KEPT_ACTIONS), F.lit(False))


def sanitize(objects: DataFrame) -> DataFrame:
    """objects: (doc_id, obj, kind, subtype, action, entries). Some rows go, the others lose keys and actions."""
    kept = objects.filter(~((F.col("kind") == "annotation") & F.coalesce(F.col("subtype").isin(REMOVED_SUBTYPES), F.lit(False))))
    action = F.when(allowed_action(F.col("action")), F.col("action"))
    return kept.withColumn("action", action).withColumn("entries", pruned(F.col("kind"), F.col("entries")))


def downsampled(w: Column, h: Column, dpi: Column, target: int) -> Column:
    """struct<w, h> of an image brought down to a resolution; never grown, one pixel at least."""
    ratio = F.least(F.lit(1.0), F.lit(float(target)) / dpi)
    return F.struct(F.greatest((w * ratio).cast("int"), F.lit(1)).alias("w"), F.greatest((h * ratio).cast("int"), F.lit(1)).alias("h"))


def marked_content(elements: DataFrame, redacted: DataFrame) -> DataFrame:
    """Structure elements whose marked content is not redacted."""
    return elements.join(redacted.select("doc_id", "mcid").distinct(), ["doc_id", "mcid"], "left_anti")
