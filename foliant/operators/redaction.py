"""Redaction of text and of page elements, with an audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import patterns


def redact_patterns(df: DataFrame, text: str, names: list[str], mark: str = "█") -> DataFrame:
    """Matches of the named patterns, one after the other, replaced by the mark."""
    out = F.col(text)
    for name in names:
        out = patterns.redact(out, patterns.named_pattern(name), mark)
    return df.withColumn(text, out)


def redact_literal(df: DataFrame, text: str, needle: str, mark: str = "█") -> DataFrame:
    return df.withColumn(text, F.replace(F.col(text), F.lit(needle), F.lit(mark)))


def audit(before: DataFrame, key: str, text: str, names: list[str], mark: str = "█") -> DataFrame:
    """One row for each row that changes: which patterns, how often, and hashes of before and after.

    Patterns are applied in order, so each is counted on the text that the earlier ones leave.
    """
    done = patterns.redact_counted(F.col(text), names, mark)
    # Rows without a match go as the state is unpacked: a filter would be pushed down and do all replacements again.
    changed = F.explode(F.filter(F.array(done), lambda s: F.exists(s["n"], lambda n: n > 0)))
    counts = [F.when(F.col("_s.n")[i] > 0, F.concat(F.lit(f"{name}:"), F.col("_s.n")[i].cast("string"))) for i, name in enumerate(names)]
    rows = before.select(key, F.col(text).alias("_before"), changed.alias("_s"))
    return rows.select(key, F.concat_ws(",", *counts).alias("operations"), F.sha2("_before", 256).alias("before_sha256"), F.sha2("_s.t", 256).alias("after_sha256"))


def closed_overlap(a: str, b: str) -> Column:
    """Rectangles x, y, w, h under two aliases that meet, edges included."""
    c = F.col
    return (
        (c(f"{a}.x") <= c(f"{b}.x") + c(f"{b}.w")) & (c(f"{b}.x") <= c(f"{a}.x") + c(f"{a}.w"))
        & (c(f"{a}.y") <= c(f"{b}.y") + c(f"{b}.h")) & (c(f"{b}.y") <= c(f"{a}.y") + c(f"{a}.h"))
    )


def open_overlap(a: str, b: str) -> Column:
    """Rectangles that share area."""
    c = F.col
    return (
        (c(f"{a}.x") < c(f"{b}.x") + c(f"{b}.w")) & (c(f"{b}.x") < c(f"{a}.x") + c(f"{a}.w"))
        & (c(f"{a}.y") < c(f"{b}.y") + c(f"{b}.h")) & (c(f"{b}.y") < c(f"{a}.y") + c(f"{a}.h"))
    )


def baseline_inside(text: str, rect: str) -> Column:
    """A text span whose baseline y lies in the rectangle and whose x interval meets it, edges included."""
    c = F.col
    return (c(f"{text}.y") >= c(f"{rect}.y")) & (c(f"{text}.y") <= c(f"{rect}.y") + c(f"{rect}.h")) & (c(f"{text}.x") <= c(f"{rect}.x") + c(f"{rect}.w")) & (c(f"{text}.x") + c(f"{text}.w") >= c(f"{rect}.x"))


def point_inside(point: str, rect: str) -> Column:
    c = F.col
    return (c(f"{point}.x") >= c(f"{rect}.x")) & (c(f"{point}.x") <= c(f"{rect}.x") + c(f"{rect}.w")) & (c(f"{point}.y") >= c(f"{rect}.y")) & (c(f"{point}.y") <= c(f"{rect}.y") + c(f"{rect}.h"))


def on_page(a: str, b: str, keys: tuple[str, ...] = ("doc_id", "page_no")) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (F.col(f"{a}.{k}") == F.col(f"{b}.{k}"))
    return out


def touched(elements: DataFrame, rects: DataFrame, rule: Column) -> DataFrame:
    """Elements (alias e) that meet a rectangle (alias r) of their page. Pages have few rectangles, so these are looked up and elements are not sorted."""
    return elements.alias("e").join(rects.hint("shuffle_hash").alias("r"), on_page("e", "r") & rule, "left_semi")


def untouched(elements: DataFrame, rects: DataFrame, rule: Column) -> DataFrame:
    return elements.alias("e").join(rects.hint("shuffle_hash").alias("r"), on_page("e", "r") & rule, "left_anti")


def marks_by_page(marks: DataFrame) -> DataFrame:
    """Redaction marks as one row a page, rectangles in order of their id."""
    only = marks.filter("mode = 'Redact'")
    return only.groupBy("doc_id", "page_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "x", "y", "w", "h"))), lambda s: s["id"]).alias("ids"), F.count("*").alias("n"))


def drop_marks(annotations: DataFrame) -> DataFrame:
    """What stays once the marks are applied; annotations without a mode stay."""
    return annotations.filter(~F.col("mode").eqNullSafe(F.lit("Redact")))


def unsigned_only(pages: DataFrame, signed_docs: DataFrame) -> DataFrame:
    """Documents with any signature are refused."""
    return pages.join(signed_docs.select("doc_id").distinct(), "doc_id", "left_anti")
