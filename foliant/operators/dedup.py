"""Exact duplicates by digest, and what an optimisation would save."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the estimate: bytes a subset font saves, and the resolution images are taken to have.
FONT_SAVING = 15000
SOURCE_DPI = 300


def duplicate_groups(df: DataFrame, key: str, digest: Column) -> DataFrame:
    """(digest, first_doc, n) of contents that occur more than once. Only digests are shuffled."""
    return df.select(key, digest.alias("digest")).groupBy("digest").agg(F.min(key).alias("first_doc"), F.count("*").alias("n")).filter("n > 1")


def duplicate_map(df: DataFrame, key: str, digest: Column) -> DataFrame:
    """(key, first_doc) of every row but the first of its content."""
    rows = df.select(key, digest.alias("digest"))
    first = rows.groupBy("digest").agg(F.min(key).alias("first_doc"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(first, "digest").filter(F.col(key) != F.col("first_doc")).select(key, "first_doc")


def optimize_estimate(
    parts: DataFrame, keys: list[str], target_dpi: int, downsample: bool = True, deduplicate: bool = True, subset_fonts: bool = True, remove_unused: bool = True
) -> DataFrame:
    """One row a file from its images (bytes, digest of the first bytes, font)."""
    g = parts.groupBy(*keys).agg(
        F.count("*").alias("images"),
        F.sum("bytes").alias("image_bytes"),
        (F.count("*") - F.count_distinct("digest")).alias("duplicates"),
        F.count_distinct("font").alias("fonts"),
        (F.sum("bytes") + 1000 * F.count("*")).alias("original"),
    )
    ratio = F.lit(target_dpi / SOURCE_DPI)
    zero = F.lit(0).cast("bigint")
    savings = zero
    if downsample:
        savings = savings + (F.col("image_bytes") * (1.0 - ratio * ratio)).cast("bigint")
    if deduplicate:
        savings = savings + F.col("duplicates") * F.expr("image_bytes DIV images")
    if subset_fonts:
        savings = savings + F.col("fonts") * FONT_SAVING
    if remove_unused:
        savings = savings + F.expr("original DIV 20")
    return g.withColumn("estimated", F.greatest(F.col("original") - savings, F.expr("original DIV 10")))
