"""Redaction that follows forms: drawings that pages, and forms themselves, draw by name.

The rectangles of a page are carried down the graph of who draws whom, a level a round, each time through the
inverse of the transform under which a form is drawn. A form that is drawn in many places loses text only
where a rectangle reaches it: such a place has a copy of its own, the others share the form. A form that
draws itself is followed to the depth limit, as everything else is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import geometry
from foliant.operators import graph
from foliant.operators.redaction import baseline_inside
from foliant.operators.review import _cut as cut
from foliant.sources.objects import path_is

#: Fixed value: forms within forms are followed so deep.
DEPTH = 32
_IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def _six(m: Column) -> list[Column]:
    return [F.get(m, F.lit(i)) for i in range(6)]


def inverse_box(b: Column, m: list[Column]) -> Column:
    """The upright box around what a transform takes to a box; null where it has no inverse."""
    p, q, r, s, e, f = m
    det = p * s - q * r
    way = [s / det, -q / det, -r / det, p / det, (r * f - s * e) / det, (q * e - p * f) / det]
    return F.when(F.abs(det) > 1e-12, geometry.affine_box(b, way))


def forms(objects: DataFrame) -> DataFrame:
    """file, canvas, content, resources, matrix, box of every form; a form without a box has null and is reached by all."""
    typed = objects.filter(path_is("Subtype") & (F.col("value") == "Form")).select("file", "object")
    streams = objects.filter(path_is() & (F.col("kind") == "stream")).select("file", "object", F.col("data").alias("content"))
    res = objects.filter(path_is("Resources") & F.col("kind").isin("dict", "ref")).select(
        "file", "object", F.when(F.col("kind") == "ref", F.struct(F.col("target").alias("object"), F.array().cast("array<string>").alias("path"))).otherwise(F.struct("object", "path")).alias("resources")
    )
    out = typed.join(streams, ["file", "object"]).join(res, ["file", "object"], "left")
    out = out.join(graph.numbers(objects, "Matrix"), ["file", "object"], "left").join(graph.numbers(objects, "BBox"), ["file", "object"], "left")
    matrix = F.when(F.size("Matrix") == 6, F.col("Matrix")).otherwise(F.array(*map(F.lit, _IDENTITY)))
    return out.select("file", F.col("object").alias("canvas"), "content", "resources", matrix.alias("matrix"), F.when(F.size("BBox") == 4, F.col("BBox")).alias("box"))


def uses(objects: DataFrame, pages: DataFrame, contents: DataFrame, found: DataFrame) -> DataFrame:
    """file, canvas, seq, form, m: every time a page or form (by its object) draws a form, and the transform from the form's space to its own."""
    page_canvas = contents.join(pages.select("file", "page_no", F.col("object").alias("canvas"), "resources"), ["file", "page_no"])
    canvases = page_canvas.select("file", "canvas", "content", "resources").unionByName(found.select("file", "canvas", "content", "resources"))
    drawn = graph.drawings(canvases.select("file", F.col("canvas").alias("page_no"), "content")).withColumnRenamed("page_no", "canvas")
    named = graph.named_resources(objects, canvases.filter("resources IS NOT NULL").select("file", "canvas", "resources")).select("file", "canvas", "name", F.col("target").alias("form"))
    placed = drawn.join(named, ["file", "canvas", "name"]).join(found.select("file", F.col("canvas").alias("form"), "matrix"), ["file", "form"])
    return placed.select("file", "canvas", "seq", "form", F.array(*geometry.affine_concat(_six(F.col("matrix")), _six(F.col("m")))).alias("m"))


def reached(rects: DataFrame, pages: DataFrame, drawn: DataFrame, found: DataFrame, depth: int = DEPTH) -> DataFrame:
    """file, page_no, way, canvas, x, y, w, h: rectangles (file, page_no, x, y, w, h) in the space of the page and of every form they reach.

    way holds which drawings lead from the page to the form; it is empty for the page itself.
    """
    own = rects.join(pages.select("file", "page_no", F.col("object").alias("canvas")), ["file", "page_no"])
    level = cut(own.select("file", "page_no", F.array().cast("array<int>").alias("way"), "canvas", geometry.box(*(F.col(c).cast("double") for c in "xywh")).alias("r")))
    out = level
    b, r = F.col("box"), F.col("r")
    edge = lambda i, j, least: least(F.get(b, F.lit(i)), F.get(b, F.lit(j)))
    inside = (
        b.isNull() | ((r["x"] <= edge(0, 2, F.greatest)) & (r["x"] + r["w"] >= edge(0, 2, F.least)) & (r["y"] <= edge(1, 3, F.greatest)) & (r["y"] + r["h"] >= edge(1, 3, F.least)))
    )
    boxes = found.select("file", F.col("canvas").alias("form"), "box")
    for _ in range(depth):
        below = level.join(drawn, ["file", "canvas"]).select("file", "page_no", F.concat("way", F.array("seq")).alias("way"), "form", inverse_box(r, _six(F.col("m"))).alias("r"))
        level = cut(below.filter("r IS NOT NULL").join(boxes, ["file", "form"]).filter(inside).select("file", "page_no", "way", F.col("form").alias("canvas"), "r"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.select("file", "page_no", "way", "canvas", "r.*")


def redact(objects: DataFrame, pages: DataFrame, contents: DataFrame, rects: DataFrame, depth: int = DEPTH) -> dict[str, DataFrame]:
    """What rectangles take away.

    removed: file, page_no, way, canvas, seq, text of every text that goes, on the page or in a form.
    copies: file, page_no, way, canvas, n of every place whose form needs a copy: one from which text goes, there or further down
    (n counts what goes there).
    """
    found = cut(forms(objects))
    drawn = cut(uses(objects, pages, contents, found))
    hit = reached(rects, pages, drawn, found, depth)
    page_canvas = contents.join(pages.select("file", "page_no", F.col("object").alias("canvas")), ["file", "page_no"]).select("file", "canvas", "content")
    canvases = page_canvas.unionByName(found.select("file", "canvas", "content"))
    texts = graph.page_elements(canvases.select("file", F.col("canvas").alias("page_no"), "content")).withColumnRenamed("page_no", "canvas")
    near = texts.alias("e").join(hit.alias("r"), (F.col("e.file") == F.col("r.file")) & (F.col("e.canvas") == F.col("r.canvas")) & baseline_inside("e", "r"))
    removed = cut(near.select("e.file", "r.page_no", "r.way", "e.canvas", "e.seq", "e.text").distinct())
    # All forms above one that changes change too: they draw the copy.
    upto = removed.select("file", "page_no", F.explode(F.transform(F.sequence(F.lit(0), F.size("way")), lambda n: F.slice("way", F.lit(1), n))).alias("way")).filter(F.size("way") > 0).distinct()
    there = removed.groupBy("file", "page_no", "way").agg(F.count("*").alias("n"))
    place = hit.select("file", "page_no", "way", "canvas").distinct()
    copies = upto.join(place, ["file", "page_no", "way"]).join(there, ["file", "page_no", "way"], "left")
    return {"removed": removed, "copies": copies.select("file", "page_no", "way", "canvas", F.coalesce("n", F.lit(0)).alias("n"))}
