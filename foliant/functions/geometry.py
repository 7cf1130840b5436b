"""Boxes and transforms as expressions. A box is struct<x, y, w, h>; edges are x, y, x + w, y + h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def overlap_area(a: Column, b: Column) -> Column:
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where either box has no area."""
    shared = overlap_area(a, b)
    union = a["w"] * a["h"] + b["w"] * b["h"] - shared
    return F.when((shared > 0) & (union > 0), shared / union).otherwise(F.lit(0.0))


def center_in(inner: Column, outer: Column) -> Column:
    """Whether a box's centre lies in another, edges included."""
    cx, cy = inner["x"] + inner["w"] / 2, inner["y"] + inner["h"] / 2
    return (cx >= outer["x"]) & (cx <= outer["x"] + outer["w"]) & (cy >= outer["y"]) & (cy <= outer["y"] + outer["h"])


def flip_y(b: Column, page_height: Column) -> Column:
    """Between top-left and bottom-left origin; its own inverse."""
    return box(b["x"], page_height - b["y"] - b["h"], b["w"], b["h"])


def affine_box(b: Column, m: list[Column]) -> Column:
    """The upright box around a box mapped by x' = a x + c y + e, y' = b x + d y + f."""
    ma, mb, mc, md, me, mf = m
    xs, ys = [], []
    for x in (b["x"], b["x"] + b["w"]):
        for y in (b["y"], b["y"] + b["h"]):
            xs.append(ma * x + mc * y + me)
            ys.append(mb * x + md * y + mf)
    left, top = F.least(*xs), F.least(*ys)
    return box(left, top, F.greatest(*xs) - left, F.greatest(*ys) - top)


def affine_concat(p: list[Column], q: list[Column]) -> list[Column]:
    """The transform that applies p and then q."""
    a, b, c, d, e, f = p
    g, h, i, j, k, m = q
    return [a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + m]


def placement(a: Column, b: Column, c: Column, d: Column) -> Column:
    """struct<w, h, rotation in degrees> of the unit square under a transform."""
    return F.struct(F.hypot(a, b).alias("w"), F.hypot(c, d).alias("h"), F.degrees(F.atan2(b, a)).alias("rotation"))


def clipped(cx: Column, cy: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """A box from its centre, cut to the page."""
    left, top = F.greatest(cx - w / 2, F.lit(0.0)), F.greatest(cy - h / 2, F.lit(0.0))
    return box(left, top, F.least(cx + w / 2, page_w) - left, F.least(cy + h / 2, page_h) - top)


def unclipped(b: Column, page_w: Column, page_h: Column) -> Column:
    """A text box grown by three tenths of its height, 2 at least, within the page."""
    pad = F.greatest(F.lit(2), (b["h"] * 0.3).cast("int"))
    left, top = F.greatest(b["x"] - pad, F.lit(0)), F.greatest(b["y"] - pad, F.lit(0))
    return box(left, top, F.least(b["x"] + b["w"] + pad, page_w) - left, F.least(b["y"] + b["h"] + pad, page_h) - top)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def luminance(r: Column, g: Column, b: Column) -> Column:
    """An integer from 0 to 255."""
    return ((r * 299 + g * 587 + b * 114) / 1000).cast("int")


def to_pixels(points: Column, dpi: Column) -> Column:
    return points * dpi / 72


def to_emu(points: Column) -> Column:
    """Units of slide files, 12700 to a point, truncated."""
    return (points * 12700).cast("long")


def down_to_32(n: Column) -> Column:
    """The multiple of 32 below, 32 at least."""
    return F.greatest(F.lit(32), (n - n % 32))


def glyph_advance(glyphs: Column, widths: Column, size: Column, scale: Column, letter: Column, word: Column, blank: Column) -> Column:
    """How far an array of glyphs moves the pen: widths (a map, thousandths) of known glyphs, letter spacing each, word spacing for blanks."""
    wide = lambda g: F.coalesce(F.try_element_at(widths, g) * size * scale / 1000, F.lit(0.0))
    return F.aggregate(glyphs, F.lit(0.0), lambda total, g: total + wide(g) + letter * scale + F.when(g == blank, word * scale).otherwise(0.0))


def pen_gap(advance: Column, size: Column, scale: Column) -> Column:
    """The number that moves the pen as far without a glyph; null where nothing need or can be moved."""
    unit = size * scale
    return F.when((F.abs(advance) > 1e-10) & (F.abs(unit) > 1e-5), -advance * 1000 / unit)
