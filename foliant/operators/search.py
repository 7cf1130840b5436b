"""Text search, and find and replace."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import arrays, patterns
from foliant.operators import trees


def _quoted(text: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|/-])", r"\\\1", text)


def search_pattern(needle: str, match_case: bool = False, whole_word: bool = False, is_regex: bool = False) -> str:
    """One pattern for a search with its options."""
    body = patterns.checked_pattern(needle) if is_regex else _quoted(needle)
    if whole_word:
        body = rf"\b(?:{body})\b"
    return body if match_case else f"(?i){body}"


def contains(text: Column, needle: str, match_case: bool = False) -> Column:
    """A fixed string, without a regular expression."""
    return F.contains(text, F.lit(needle)) if match_case else F.contains(F.lower(text), F.lit(needle.lower()))


def search(df: DataFrame, text: str, needle: str, **options: bool) -> DataFrame:
    """Rows with a hit, with the number of hits and the character position of the first, from 0."""
    pattern = patterns.java_pattern(search_pattern(needle, **options))
    out = df.filter(F.col(text).rlike(pattern))
    return out.withColumns({"n_hits": F.regexp_count(text, F.lit(pattern)), "first_at": F.regexp_instr(text, F.lit(pattern)) - 1})


def first_hit(df: DataFrame, text: str, needle: str, order: list[str], **options: bool) -> DataFrame:
    """The first row with a hit in a total order."""
    return search(df, text, needle, **options).orderBy(*order).limit(1)


def positions(text: Column, needle: str) -> Column:
    """Start positions of a fixed string, from 0, without overlap."""
    gaps = F.split(text, _quoted(needle), -1)
    none = F.array().cast("array<int>")

    def placed(lengths: Column) -> Column:
        return F.zip_with(arrays.sums_before(F.transform(lengths, lambda g: g + len(needle))), lengths, lambda before, g: before + g)

    lengths = F.transform(F.slice(gaps, F.lit(1), F.size(gaps) - 1), F.length)
    return F.coalesce(arrays.bound(lengths, placed), none)


def replace_all(df: DataFrame, text: str, needle: str, by: str) -> DataFrame:
    """Every occurrence of a fixed string replaced; n_replaced tells how many."""
    n = ((F.length(text) - F.length(F.replace(F.col(text), F.lit(needle), F.lit("")))) / len(needle)).cast("bigint")
    return df.withColumn("n_replaced", n).withColumn(text, F.replace(F.col(text), F.lit(needle), F.lit(by)))


def replace_first(df: DataFrame, text: str, needle: str, by: str) -> DataFrame:
    at = F.instr(text, needle)
    new = F.concat(F.substring(F.col(text), F.lit(1), at - 1), F.lit(by), F.substring(F.col(text), at + len(needle), F.length(text)))
    return df.withColumn(text, F.when(at > 0, new).otherwise(F.col(text)))


def union_box(chars: DataFrame, keys: list[str]) -> DataFrame:
    """One box around all characters of a match; boxes without area are left out."""
    real = chars.filter("w > 0 AND h > 0")
    boxes = real.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))
    return boxes.select(*keys, "x", "y", (F.col("x1") - F.col("x")).alias("w"), (F.col("y1") - F.col("y")).alias("h"))


def keep_ancestors(nodes: DataFrame, needle: str) -> DataFrame:
    """Tree rows (id, parent_id, title) whose title, or that of a row below, holds the needle, whatever the case."""
    return nodes.join(trees.with_ancestors(nodes, nodes.filter(contains(F.col("title"), needle))), "id", "left_semi")


def depth_first_path(nodes: DataFrame) -> DataFrame:
    """(id, path): the ordinals from the root, so that ordering by path is depth first."""
    return trees.paths(nodes, F.col("ordinal"))


def visits(df: DataFrame, key: str, order: str, value: str, cap: int = 100) -> DataFrame:
    """A history without immediate repeats, the last ``cap`` of each key."""
    w = Window.partitionBy(key).orderBy(order)
    moved = df.withColumn("_before", F.lag(value).over(w)).filter(F.col("_before").isNull() | (F.col("_before") != F.col(value)))
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return moved.withColumn("_back", back).filter(F.col("_back") <= cap).drop("_before", "_back")
