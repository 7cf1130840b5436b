"""Cleaning of scanned pages that are held as strips of rows, so that one page may be the work of many tasks.

Ink of a strip is taken as runs of pixels, runs of neighbouring rows that touch are one label, and labels
of neighbouring strips that touch over their border are joined into components by rounds of joins. Sizes of
components add up from those of labels, and rules on sizes say which components go: specks, and what lies
along an edge of the page. Coloured marks go before that, pixel by pixel, with the rows next to a strip in view.

Strips are (doc_id, page_no, strip, width, data): strips are numbered from 0 down the page, and data holds
whole rows, of a byte a pixel for ink (0 is none) and of three for colours. A strip that is not the last of its page has
three rows at least. A page without ink has no components and stays as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.review import _cut as cut
from foliant.sources.objects import gathered

PAGE = ["doc_id", "page_no"]
#: Shares of the page's pixels and sides that tell specks and edge artefacts.
SPECK_SHARE, SPECK_AREA, SPECK_HEIGHT = 0.0000008, 3, 3
EDGE_X, EDGE_Y, LONG_SHARE, SIDE_WIDTH, END_HEIGHT = 0.045, 0.025, 0.045, 0.12, 0.08
#: Rows around a strip that its coloured pixels may reach into.
HALO = 3


def runs_of(ink: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of every run of ink, in order."""
    edges = np.diff(np.pad(ink.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, first = np.nonzero(edges == 1)
    return y, first, np.nonzero(edges == -1)[1] - 1


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n things' component under links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(up := new[new], new):
            new = up
        if np.array_equal(new, root):
            return root
        root = new


def touching(y: np.ndarray, first: np.ndarray, last: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs of neighbouring rows that touch: sides (reach 0) or corners too (reach 1)."""
    if not len(y):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    wide = int(last.max()) + 4
    begins, ends = y * wide + first + 1, y * wide + last + 1
    lo = np.searchsorted(ends, (y + 1) * wide + np.maximum(first - reach, -1) + 1)
    hi = np.searchsorted(begins, (y + 1) * wide + last + reach + 1, side="right")
    n = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(y)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def labelled(y: np.ndarray, first: np.ndarray, last: np.ndarray, eight: bool) -> np.ndarray:
    """For each run, in order of rows and columns, the first run of its component."""
    a, b = touching(y, first, last, int(eight))
    return _roots(len(y), a, b)


def _ink(b: pa.RecordBatch, r: int, width: int, data: int) -> np.ndarray:
    return np.frombuffer(b.column(data)[r].as_buffer(), dtype=np.uint8).reshape(-1, b.column(width)[r].as_py()) > 0


_LABEL = "doc_id bigint, page_no int, strip int, label int, rows int, area bigint, left int, right int, top int, bottom int, upper array<struct<first: int, last: int>>, lower array<struct<first: int, last: int>>"
_EDGE = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def strip_labels(strips: DataFrame, eight: bool = True) -> DataFrame:
    """Labels of each strip: pixels, box (rows from the strip's first) and runs in its first and last row. A strip without ink has one row without a label."""

    def found(ink: np.ndarray) -> list[tuple]:
        y, first, last = runs_of(ink)
        if not len(y):
            return [(None, len(ink), *[None] * 5, [], [])]
        labels, back = np.unique(labelled(y, first, last, eight), return_inverse=True)
        n = len(labels)
        at = lambda reduce, v, start: _reduced(reduce, back, v, n, start).tolist()
        ends = [[[] for _ in range(n)], [[] for _ in range(n)]]
        for side, row in ((0, 0), (1, len(ink) - 1)):
            for i in np.flatnonzero(y == row):
                ends[side][back[i]].append({"first": int(first[i]), "last": int(last[i])})
        sizes = at(np.add, last - first + 1, 0), at(np.minimum, first, 1 << 30), at(np.maximum, last, -1), at(np.minimum, y, 1 << 30), at(np.maximum, y, -1)
        return list(zip(range(n), [len(ink)] * n, *sizes, *ends, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.int32()] * 4, _EDGE, _EDGE]
        for b in batches:
            keys = [k.cast(t) for k, t in zip(b.columns[:3], (pa.int64(), pa.int32(), pa.int32()), strict=True)]
            yield from gathered(keys, (found(_ink(b, r, 3, 4)) for r in range(b.num_rows)), [*PAGE, "strip", "label", "rows", "area", "left", "right", "top", "bottom", "upper", "lower"], kinds)

    return strips.select(*PAGE, "strip", "width", "data").mapInArrow(run, _LABEL)


def _reduced(reduce: np.ufunc, group: np.ndarray, values: np.ndarray, n: int, start: int) -> np.ndarray:
    out = np.full(n, start, dtype=np.int64)
    reduce.at(out, group, values)
    return out


def connected(nodes: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """nodes (keys, node) with root, the least node linked to each; links are (keys, a, b). Each round every node takes the least root around it, and then its root's root."""
    both = cut(links.select(*keys, "a", "b").unionByName(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = cut(nodes.select(*keys, "node", F.col("node").alias("root")))
    while True:
        around = both.join(state.select(*keys, F.col("node").alias("b"), "root"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("root").alias("_least"))
        seen = state.join(around, [*keys, "node"], "left").select(*keys, "node", "root", F.least("root", F.coalesce("_least", "root")).alias("_new"))
        # A root that hears of a lesser one takes its whole tree along.
        hooks = seen.groupBy(*keys, "root").agg(F.min("_new").alias("_to"))
        hooked = seen.join(hooks, [*keys, "root"]).select(*keys, "node", F.col("root").alias("_old"), F.col("_to").alias("root"))
        moved = cut(hooked)
        jumped = moved.join(moved.select(*keys, F.col("node").alias("root"), F.col("root").alias("_up")), [*keys, "root"]).select(*keys, "node", F.least("root", "_up").alias("root"))
        if moved.filter("root <> _old").isEmpty():
            return moved.select(*keys, "node", "root")
        state = cut(jumped)


def components(labels: DataFrame, reach: int = 1) -> tuple[DataFrame, DataFrame]:
    """Components (doc_id, page_no, component, area, x, y, w, h) and which label of which strip is of which (doc_id, page_no, strip, label, component)."""
    begin = F.coalesce(F.sum("rows").over(Window.partitionBy(*PAGE).orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = labels.groupBy(*PAGE, "strip").agg(F.max("rows").alias("rows")).select(*PAGE, "strip", begin.cast("int").alias("begin"))
    node = F.struct("strip", "label")
    inked = labels.filter("label IS NOT NULL").withColumn("node", node)
    below = inked.select(*PAGE, F.col("node").alias("a"), (F.col("strip") + 1).alias("strip"), F.explode("lower").alias("p"))
    above = inked.select(*PAGE, F.col("node").alias("b"), "strip", F.explode("upper").alias("q"))
    # Of the pairs of runs at a border those that touch; borders are a row wide.
    links = below.join(above, [*PAGE, "strip"]).filter((F.col("p.first") <= F.col("q.last") + reach) & (F.col("q.first") <= F.col("p.last") + reach)).select(*PAGE, "a", "b").distinct()
    members = connected(inked.select(*PAGE, "node"), links, PAGE)
    sized = inked.join(members, [*PAGE, "node"]).join(starts, [*PAGE, "strip"])
    out = sized.groupBy(*PAGE, F.col("root").alias("component")).agg(
        F.sum("area").alias("area"), F.min("left").alias("x"), F.min(F.col("begin") + F.col("top")).alias("y"),
        (F.max("right") - F.min("left") + 1).alias("w"), (F.max(F.col("begin") + F.col("bottom")) - F.min(F.col("begin") + F.col("top")) + 1).alias("h"),
    )
    return out, members.select(*PAGE, "node.strip", "node.label", F.col("root").alias("component"))


def page_sizes(strips: DataFrame, bytes_a_pixel: int = 1) -> DataFrame:
    return strips.groupBy(*PAGE).agg(F.max("width").alias("page_w"), F.sum(F.floor(F.octet_length("data") / (F.col("width") * bytes_a_pixel))).cast("int").alias("page_h"))


def is_speck(pixels: Column) -> Column:
    """Components (area, w, h) too small for print, on a page of so many pixels."""
    return ~((F.col("area") >= F.greatest(F.lit(SPECK_AREA), (pixels * SPECK_SHARE).cast("int"))) | (F.col("h") >= SPECK_HEIGHT))


def is_edge_artefact(page_w: Column, page_h: Column) -> Column:
    """Components (x, y, w, h) that are long, narrow and in the band along an edge."""
    x, y, w, h = (F.col(c) for c in ("x", "y", "w", "h"))
    band_x, band_y = (page_w * EDGE_X).cast("int"), (page_h * EDGE_Y).cast("int")
    side = (x <= band_x) | (x + w >= page_w - band_x)
    end = (y <= band_y) | (y + h >= page_h - band_y)
    return ((side & (w < page_w * SIDE_WIDTH)) | (end & (h < page_h * END_HEIGHT))) & ((h > page_h * LONG_SHARE) | (w > page_w * LONG_SHARE))


def erased(strips: DataFrame, gone: DataFrame, eight: bool = True) -> DataFrame:
    """strips without the ink of the labels in gone (doc_id, page_no, strip, label)."""
    listed = gone.groupBy(*PAGE, "strip").agg(F.collect_set("label").alias("labels"))
    wide = strips.select(*PAGE, "strip", "width", "data").join(listed, [*PAGE, "strip"], "left").select(*PAGE, "strip", "width", "data", "labels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in range(b.num_rows):
                data = b.column(4)[r].as_buffer()
                if b.column(5)[r].is_valid:
                    ink = _ink(b, r, 3, 4)
                    y, first, last = runs_of(ink)
                    _, back = np.unique(labelled(y, first, last, eight), return_inverse=True)
                    pixels = np.frombuffer(data, dtype=np.uint8).reshape(ink.shape).copy()
                    for i in np.flatnonzero(np.isin(back, b.column(5)[r].as_py())):
                        pixels[y[i], first[i] : last[i] + 1] = 0
                    data = pixels.tobytes()
                out.append(bytes(data))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out, pa.binary())], b.schema.names[:5])

    return wide.mapInArrow(run, "doc_id bigint, page_no int, strip int, width int, data binary")


def cleaned(strips: DataFrame, parts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Strips of ink without specks and without what lies along an edge; parts are the strips' components, where they are known."""
    found, members = parts or components(cut(strip_labels(strips)))
    w, h = F.col("page_w"), F.col("page_h")
    sized = found.join(page_sizes(strips), PAGE)
    gone = sized.filter(is_speck(w.cast("bigint") * h) | is_edge_artefact(w, h)).select(*PAGE, "component")
    return erased(strips, members.join(gone, [*PAGE, "component"]).select(*PAGE, "strip", "label"))


def coloured(rgb: np.ndarray) -> np.ndarray:
    """Which pixels are of pen, stamp or highlighter: reddish, faint pink, or strong in colour."""
    r, g, b = (rgb[..., i].astype(np.int32) for i in range(3))
    value, least = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    spread = value - least
    strength = np.where(value > 0, np.rint(255 * spread / np.maximum(value, 1)), 0)
    by = 60 / np.maximum(spread, 1)
    degrees = np.where(value == r, (g - b) * by, np.where(value == g, 120 + (b - r) * by, 240 + (r - g) * by))
    hue = np.where(spread > 0, np.rint((degrees % 360) / 2) % 180, 0)
    red = ((hue <= 14) | (hue >= 160)) & (strength > 22) & (value > 70) & (r > g + 8)
    pink = (r > 135) & (r > g + 5) & (r > b + 8) & (strength > 12)
    return red | pink | ((strength > 70) & (value > 65))


def _spread(mask: np.ndarray, outside: bool) -> np.ndarray:
    """Whether any pixel of a mask's three by three neighbourhood is set."""
    p = np.pad(mask, 1, constant_values=outside)
    h, w = mask.shape
    return np.logical_or.reduce([p[i : i + h, k : k + w] for i in range(3) for k in range(3)])


def without_colour(strips: DataFrame) -> DataFrame:
    """Strips of colours with coloured marks, closed over gaps and grown by a pixel, made white."""
    order = Window.partitionBy(*PAGE).orderBy("strip")
    edge = F.col("width") * 3 * HALO
    last = F.lag("data").over(order)
    above = F.coalesce(last.substr(F.octet_length(last) - F.least(edge, F.octet_length(last)) + 1, edge), F.lit(b""))
    below = F.coalesce(F.lead("data").over(order).substr(F.lit(1), edge), F.lit(b""))
    wide = strips.select(*PAGE, "strip", "width", "data", above.alias("above"), below.alias("below"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in range(b.num_rows):
                width = b.column(3)[r].as_py()
                up, own, down = (np.frombuffer(b.column(c)[r].as_buffer(), dtype=np.uint8).reshape(-1, width, 3) for c in (5, 4, 6))
                mask = coloured(np.concatenate([up, own, down]))
                closed = ~_spread(~_spread(mask, False), False)
                marks = _spread(closed, False)[len(up) : len(up) + len(own)]
                out.append(np.where(marks[..., None], np.uint8(255), own).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out, pa.binary())], b.schema.names[:5])

    return wide.mapInArrow(run, "doc_id bigint, page_no int, strip int, width int, data binary")
