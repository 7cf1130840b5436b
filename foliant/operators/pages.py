"""Pages as rows (doc_id, page_no, ...): set operations, ranges, numbering and splitting.

Pages count from 0. Everything is a filter, a union or an index expression; only operators
that must number rows anew shuffle, by document.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.strings import padded_number

#: Name, prefix, suffix, digits, position.
BATES_PRESETS = [
    ("Custom", "", "", 6, "BottomRight"),
    ("Legal Production", "PROD", "", 6, "BottomRight"),
    ("Exhibit", "EX-", "", 4, "BottomCenter"),
    ("Confidential", "CONF-", "", 6, "BottomRight"),
    ("Sequential Plain", "", "", 4, "BottomRight"),
]


def _page() -> Column:
    return F.col("page_no")


def lines_of(docs: DataFrame, per_page: int = 20) -> DataFrame:
    """(doc_id, page_no, line_no, text): texts cut at newlines, a fixed number of lines a page."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text")).select("doc_id", F.expr(f"line_no DIV {per_page}").cast("int").alias("page_no"), "line_no", "text")


def pages_of(docs: DataFrame, per_page: int = 20) -> DataFrame:
    """(doc_id, page_no, text, rotation): one row a page, without a shuffle."""
    lines = F.split("text", "\n")
    starts = F.sequence(F.lit(0), F.size(lines) - 1, F.lit(per_page))
    pages = F.transform(starts, lambda s: F.array_join(F.slice(lines, s + 1, F.lit(per_page)), "\n"))
    return docs.filter("text IS NOT NULL").select("doc_id", F.posexplode(pages).alias("page_no", "text")).withColumn("rotation", F.lit(0))


def merge(inputs: list[DataFrame]) -> DataFrame:
    """Pages of all inputs in their order: a union with the input's place."""
    out = None
    for i, df in enumerate(inputs):
        part = df.withColumn("input", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def renumber(pages: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return pages.withColumn("page_no", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("int"))


def extract(pages: DataFrame, first: int, last: int) -> DataFrame:
    return pages.filter(_page().between(first, last)).withColumn("page_no", _page() - first)


def delete(pages: DataFrame, first: int, last: int) -> DataFrame:
    gone = max(last - first + 1, 0)
    return pages.filter(~_page().between(first, last)).withColumn("page_no", F.when(_page() > last, _page() - gone).otherwise(_page()))


def insert_blank(pages: DataFrame, at: int) -> DataFrame:
    """An empty page at a place in every document, at its end if it has fewer pages."""
    n = pages.groupBy("doc_id").agg(F.least(F.count("*"), F.lit(at)).cast("int").alias("page_no"))
    blank = n.withColumns({"text": F.lit(""), "rotation": F.lit(0)})
    moved = pages.withColumn("page_no", F.when(_page() >= at, _page() + 1).otherwise(_page()))
    return moved.unionByName(blank)


def reorder(pages: DataFrame, source: int, target: int) -> DataFrame:
    """The page at source goes to target; those between move by one. Documents too short for either stay."""
    n = pages.groupBy("doc_id").agg(F.count("*").alias("_n"))
    p = _page()
    if source < target:
        moved = F.when(p == source, target).when((p > source) & (p <= target), p - 1).otherwise(p)
    else:
        moved = F.when(p == source, target).when((p >= target) & (p < source), p + 1).otherwise(p)
    return pages.join(n, "doc_id").withColumn("page_no", F.when(F.col("_n") > max(source, target), moved).otherwise(p)).drop("_n")


def rotate(pages: DataFrame, first: int, last: int, angle: int) -> DataFrame:
    """Remainders keep the sign of the sum."""
    return pages.withColumn("rotation", F.when(_page().between(first, last), (F.col("rotation") + angle) % 360).otherwise(F.col("rotation")))


def crop(box: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """A page box less its margins; never below zero width or height."""
    return F.struct(
        (box["x"] + left).alias("x"), (box["y"] + bottom).alias("y"), F.greatest(box["w"] - left - right, F.lit(0.0)).alias("w"), F.greatest(box["h"] - top - bottom, F.lit(0.0)).alias("h")
    )


def resize(box: Column, width: Column, height: Column) -> Column:
    return F.struct(box["x"].alias("x"), box["y"].alias("y"), width.alias("w"), height.alias("h"))


def page_range(spec: Column, n_pages: Column) -> Column:
    """Sorted distinct page numbers from 0 of a text such as 1-3,5: clamped, bad or reversed parts skipped."""
    parts = F.transform(F.split(spec, ","), lambda p: F.trim(p))
    good = F.filter(parts, lambda p: p.rlike(r"^\d{1,9}(\s*-\s*\d{1,9})?$"))

    def pages(p: Column) -> Column:
        ends = F.transform(F.split(p, "-"), lambda e: F.trim(e).cast("int"))
        first, last = F.greatest(F.element_at(ends, 1), F.lit(1)), F.least(F.element_at(ends, -1), n_pages)
        return F.when(first <= last, F.sequence(first - 1, last - 1)).otherwise(F.array().cast("array<int>"))

    return F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform(good, pages)))), F.array().cast("array<int>"))


def redact_range(spec: str, n_pages: int) -> list[int]:
    """Pages of a range for redaction; what cannot be read is refused, never taken as all pages."""
    if not re.fullmatch(r"\s*\d+(\s*-\s*\d+)?(\s*,\s*\d+(\s*-\s*\d+)?)*\s*", spec):
        raise ValueError(f"not a page range: {spec!r}")
    out: set[int] = set()
    for part in spec.split(","):
        first, _, last = part.partition("-")
        out |= set(range(max(int(first), 1), min(int(last or first), n_pages) + 1))
    return sorted(p - 1 for p in out)


def clamp_range(first: Column, last: Column, n_pages: Column) -> tuple[Column, Column]:
    """Open ends: a first page of 0 or less is the first, a last below 1 the last."""
    return F.when(first <= 0, 1).otherwise(first), F.when((last <= 0) | (last > n_pages), n_pages).otherwise(last)


def bates(pages: DataFrame, order: list[str], prefix: str | Column, suffix: str | Column, digits: int | Column, start: int = 1, partition: list[str] | None = None) -> DataFrame:
    """A running number on every page; numbers longer than ``digits`` keep all digits.

    Numbers run through ``partition`` (one document or production set), so that no single
    task orders everything.
    """
    n = F.row_number().over(Window.partitionBy(*(partition or ["doc_id"])).orderBy(*order)) - 1 + start
    return pages.withColumn("label", F.concat(F.lit(prefix), padded_number(n, F.lit(digits)), F.lit(suffix)))


def header_footer(pages: DataFrame, template: str) -> DataFrame:
    """{page} counts from 1 and {total} is the number of pages of the document."""
    total = F.count("*").over(Window.partitionBy("doc_id"))
    text = F.replace(F.replace(F.lit(template), F.lit("{page}"), (_page() + 1).cast("string")), F.lit("{total}"), total.cast("string"))
    return pages.withColumn("footer", text)


def split_every(pages: DataFrame, n: int) -> DataFrame:
    return pages.withColumn("part", F.expr(f"page_no DIV {n}").cast("int"))


def split_at(pages: DataFrame, n: int) -> DataFrame:
    return pages.withColumn("part", F.when(_page() < n, 0).otherwise(1))


def split_by_ranges(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges: (part, first, last), pages from 0, ends included."""
    return pages.join(ranges, _page().between(F.col("first"), F.col("last"))).drop("first", "last")


def part_name(template: str, stem: Column, n: Column) -> Column:
    """{stem} and {n} filled in; .pdf is added where it is missing."""
    name = F.replace(F.replace(F.lit(template), F.lit("{stem}"), stem), F.lit("{n}"), n.cast("string"))
    return F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))


def page_image_name(template: str, stem: Column, page: Column) -> Column:
    """%1 stands for the page number; without it, _pageN goes before the extension."""
    if "%1" in template:
        return F.replace(F.replace(F.lit(template), F.lit("{stem}"), stem), F.lit("%1"), (page + 1).cast("string"))
    base, dot, ext = template.rpartition(".")
    return F.concat(F.replace(F.lit(base if dot else template), F.lit("{stem}"), stem), F.lit("_page"), (page + 1).cast("string"), F.lit(dot + ext if dot else ""))


def paired_pages(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Pages of two documents at the same place; pages that only one has are left out."""
    return a.select(key, "page_no", F.col("text").alias("text_a")).join(b.select(key, "page_no", F.col("text").alias("text_b")), [key, "page_no"])


def first_of_each(files: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, in the order of insertion."""
    return files.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_r = 1").drop("_r")


def visible_window(scroll: Column, view: Column, height: int, buffer: int, n_pages: Column) -> tuple[Column, Column]:
    """First and last page to draw, with a buffer on both ends, clamped."""
    first = F.greatest(F.floor(scroll / height) - buffer, F.lit(0))
    last = F.least(F.floor((scroll + view) / height) + buffer, n_pages - 1)
    return first.cast("bigint"), last.cast("bigint")


def prefetch(center: Column, n_pages: Column, reach: int = 3) -> Column:
    """Pages around one, nearest first and the next before the previous, in bounds."""
    offsets = [s * k for k in range(1, reach + 1) for s in (1, -1)]
    return F.filter(F.array(*[center + o for o in offsets]), lambda p: (p >= 0) & (p < n_pages))


def with_gaps(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """Every page of 0..n-1 in order; one without a result is a timeout."""
    all_pages = counts.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("page_no"))
    status = F.when(F.col("status").isNull(), "Timeout").otherwise(F.col("status"))
    return all_pages.join(pages.select("doc_id", "page_no", "status"), ["doc_id", "page_no"], "left").withColumn("status", status)
