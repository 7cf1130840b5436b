"""Images as pixel rows or as bytes: thresholds, layers, estimates and filters.

Pixel rows are (doc_id, page_no, x, y, r, g, b). Histograms and means are native; filters over
neighbourhoods work on an image's bytes in Arrow batches, one image at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import geometry

PAGE = ["doc_id", "page_no"]
#: Compression of the background by mode, and of the foreground.
MRC_RATIOS = {"Lossless": 10, "Balanced": 30, "Aggressive": 50}
FOREGROUND_RATIO = 10
DIALOG_MRC_SHARE = 0.25


def histogram(pixels: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    return pixels.groupBy(*keys, geometry.luminance(F.col("r"), F.col("g"), F.col("b")).alias("lum")).agg(F.count("*").alias("n"))


def otsu(hist: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """(keys, threshold): the first level of largest variance between the classes, 128 if there is none.

    Levels that do not occur change neither class, so only those that occur are looked at.
    """
    upto = Window.partitionBy(*keys).orderBy("lum").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    h = hist.withColumns({
        "wb": F.sum("n").over(upto), "sb": F.sum(F.col("n") * F.col("lum")).over(upto), "w": F.sum("n").over(whole), "s": F.sum(F.col("n") * F.col("lum")).over(whole),
    })
    wf = F.col("w") - F.col("wb")
    gap = F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / F.when(wf > 0, wf)
    h = h.withColumn("var", F.col("wb").cast("double") * wf * gap * gap)
    best = h.groupBy(*keys).agg(F.max_by("lum", F.when(F.col("var") > 0, F.struct("var", -F.col("lum")))).alias("t"))
    return best.select(*keys, F.coalesce("t", F.lit(128)).alias("threshold"))


def foreground(pixels: DataFrame, thresholds: DataFrame, regions: DataFrame) -> DataFrame:
    """Adds mask: dark pixels of text regions. Of regions that overlap, the last in order holds.

    regions: (doc_id, page_no, region_id, type, x, y, w, h).
    """
    p, r = pixels.alias("p"), regions.alias("r")
    inside = (F.col("p.x") >= F.col("r.x")) & (F.col("p.x") < F.col("r.x") + F.col("r.w")) & (F.col("p.y") >= F.col("r.y")) & (F.col("p.y") < F.col("r.y") + F.col("r.h"))
    label = p.join(r, (F.col("p.doc_id") == F.col("r.doc_id")) & (F.col("p.page_no") == F.col("r.page_no")) & inside)
    label = label.groupBy("p.doc_id", "p.page_no", "p.x", "p.y").agg(F.max_by("r.type", "r.region_id").alias("type"))
    out = pixels.join(label, [*PAGE, "x", "y"], "left").join(thresholds, PAGE)
    dark = geometry.luminance(F.col("r"), F.col("g"), F.col("b")) <= F.col("threshold")
    return out.withColumn("mask", (F.coalesce(F.col("type") != "Figure", F.lit(False)) & dark).cast("int")).drop("threshold")


def background_rows(masked: DataFrame) -> DataFrame:
    """Mean colour of the pixels of each row outside the mask, in whole numbers; white where there are none."""
    mean = lambda c: F.coalesce(F.avg(F.when(F.col("mask") == 0, F.col(c))).cast("int"), F.lit(255)).alias(c)
    return masked.groupBy(*PAGE, "y").agg(*map(mean, ("r", "g", "b")))


def mrc_estimate(w: Column, h: Column, mode: str) -> Column:
    """Bytes of a page in layers: seven tenths background, three tenths foreground."""
    raw = (w.cast("bigint") * h * 3).cast("double")
    return (raw * 0.70 / MRC_RATIOS[mode]).cast("bigint") + (raw * 0.30 / FOREGROUND_RATIO).cast("bigint")


def keep_recent(cache: DataFrame, key: str, limit: int) -> DataFrame:
    """Entries (key, used, bytes) that a cache of ``limit`` bytes would keep, latest used first."""
    w = Window.partitionBy(key).orderBy(F.col("used").desc(), "id").rowsBetween(Window.unboundedPreceding, 0)
    return cache.withColumn("upto", F.sum("bytes").over(w)).filter(F.col("upto") <= limit).drop("upto")


def ink_pages(pages: DataFrame, least: float) -> DataFrame:
    """Pages with at least a share of ink; others count as blank."""
    return pages.filter(F.col("black_ratio") >= least)


def clean_report(pages: DataFrame, least: float, keys: list[str]) -> DataFrame:
    blank = F.col("black_ratio") < least
    return pages.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(~blank).alias("written"), F.count_if(blank).alias("skipped"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(blank, F.col("page_no")))), lambda p: p.cast("string")), ",").alias("skipped_pages"),
    )


def median3(image: np.ndarray) -> np.ndarray:
    """Median of each pixel's three by three neighbourhood; borders stay."""
    out = image.copy()
    if min(image.shape) >= 3:
        h, w = image.shape
        around = np.stack([image[i : h - 2 + i, j : w - 2 + j] for i in range(3) for j in range(3)])
        out[1:-1, 1:-1] = np.median(around, axis=0).astype(image.dtype)
    return out


def adaptive_threshold(image: np.ndarray, window: int = 15, k: float = 0.2, spread: float = 128.0) -> np.ndarray:
    """Sauvola's local threshold, by sums over windows cut at the borders: 255 paper, 0 ink."""
    h, w = image.shape
    x = image.astype(float)
    half = window // 2
    table = lambda v: np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    s, q = table(x), table(x * x)
    top, bottom = np.clip(np.arange(h) - half, 0, h), np.clip(np.arange(h) + half + 1, 0, h)
    left, right = np.clip(np.arange(w) - half, 0, w), np.clip(np.arange(w) + half + 1, 0, w)
    area = np.outer(bottom - top, right - left)
    window_sum = lambda t: t[np.ix_(bottom, right)] - t[np.ix_(top, right)] - t[np.ix_(bottom, left)] + t[np.ix_(top, left)]
    mean = window_sum(s) / area
    deviation = np.sqrt(np.maximum(window_sum(q) / area - mean * mean, 0))
    return np.where(x > mean * (1 + k * (deviation / spread - 1)), 255, 0).astype(np.uint8)


def skew_angle(ink: np.ndarray, most: float = 5.0, step: float = 0.5) -> float:
    """The rotation in degrees at which rows of ink stand out most."""
    y, x = np.nonzero(ink)
    if not len(y):
        return 0.0
    def sharpness(angle: float) -> float:
        rows = np.round(y - x * np.tan(np.radians(angle))).astype(int)
        return float((np.bincount(rows - rows.min()).astype(float) ** 2).sum())

    return max(np.arange(-most, most + step / 2, step).tolist(), key=lambda a: (sharpness(a), -abs(a)))


def filtered(images: DataFrame, name: str) -> DataFrame:
    """images: (keys..., width, height, gray binary), with gray replaced by the filter's result."""
    work = {"median": median3, "adaptive": adaptive_threshold}[name]

    @F.pandas_udf("binary")
    def apply(gray: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        return pd.Series([work(np.frombuffer(g, dtype=np.uint8).reshape(h, w)).tobytes() for g, w, h in zip(gray, width, height, strict=True)])

    return images.withColumn("gray", apply("gray", "width", "height"))


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The three by three transform that takes four points to four others."""
    rows, out = [], []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        out += [u, v]
    return np.append(np.linalg.solve(np.array(rows, dtype=float), np.array(out, dtype=float)), 1.0).reshape(3, 3)


def warp(image: np.ndarray, transform: np.ndarray, width: int, height: int) -> np.ndarray:
    """Values at the transformed places of a width by height grid, bilinear, clamped at the borders."""
    gx, gy = np.meshgrid(np.arange(width), np.arange(height))
    p = transform @ np.stack([gx.ravel(), gy.ravel(), np.ones(gx.size)])
    x = np.clip(p[0] / p[2], 0, image.shape[1] - 1)
    y = np.clip(p[1] / p[2], 0, image.shape[0] - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, image.shape[1] - 1), np.minimum(y0 + 1, image.shape[0] - 1)
    fx, fy = x - x0, y - y0
    f = image.astype(float)
    v = f[y0, x0] * (1 - fx) * (1 - fy) + f[y0, x1] * fx * (1 - fy) + f[y1, x0] * (1 - fx) * fy + f[y1, x1] * fx * fy
    return v.reshape(height, width)


def _big(b: bytes) -> int:
    return int.from_bytes(b, "big")


def _little(b: bytes) -> int:
    return int.from_bytes(b, "little")


def _jpeg_size(head: bytes) -> tuple[int, int] | None:
    """Segments are passed over by their lengths up to the frame header."""
    at = 2
    while at + 9 <= len(head) and head[at] == 0xFF:
        marker = head[at + 1]
        if marker == 0xFF or 0xD0 <= marker <= 0xD8 or marker == 0x01:
            at += 1 if marker == 0xFF else 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return _big(head[at + 7 : at + 9]), _big(head[at + 5 : at + 7])
        else:
            at += 2 + _big(head[at + 2 : at + 4])
    return None


def _tiff_size(head: bytes) -> tuple[int, int] | None:
    number = _little if head[:2] == b"II" else _big
    at, found = number(head[4:8]), {}
    for i in range(number(head[at : at + 2])):
        entry = head[at + 2 + 12 * i : at + 14 + 12 * i]
        if len(entry) == 12 and (tag := number(entry[:2])) in (256, 257):
            found[tag] = number(entry[8 : 10 if number(entry[2:4]) == 3 else 12])
    return (found[256], found[257]) if len(found) == 2 else None


def image_head_size(head: bytes | None) -> tuple[int, int] | None:
    """Width and height in pixels from the first bytes of an image file, not decoded; null where they do not say."""
    head, size = head or b"", None
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        size = _big(head[16:20]), _big(head[20:24])
    elif head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 10:
        size = _little(head[6:8]), _little(head[8:10])
    elif head[:2] == b"BM" and len(head) >= 26:
        # Rows may stand from the top, with a height below zero.
        size = _little(head[18:22]), abs(int.from_bytes(head[22:26], "little", signed=True))
    elif head[:2] == b"\xff\xd8":
        size = _jpeg_size(head)
    elif head[:4] in (b"II*\0", b"MM\0*"):
        size = _tiff_size(head)
    return size if size and min(size) > 0 else None


def head_sizes(head: Column) -> Column:
    """struct<w, h> of the first bytes of an image file."""

    @F.pandas_udf("w int, h int")
    def sizes(heads: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([image_head_size(h) or (None, None) for h in heads], columns=["w", "h"], dtype="Int32")

    return sizes(head)


def pages_of_images(members: DataFrame, files: DataFrame, page_w: float = 595.0, page_h: float = 842.0, fit: bool = True, dpi: float = 300.0) -> tuple[DataFrame, DataFrame]:
    """Pages (list_id, page_no, path, x, y, w, h) of lists of images (list_id, place, path), and the lists that are refused (list_id, n_bad).

    files: path and head (the first bytes). A list is refused as a whole if one member is missing or of a format that is
    not known. With ``fit`` an image is scaled to the page and centred, else it has its size at ``dpi`` in the lower left corner.
    """
    known = files.withColumn("s", head_sizes(F.col("head"))).select("path", "s.w", "s.h")
    placed = members.join(known, "path", "left")
    bad = placed.filter("w IS NULL OR h IS NULL").groupBy("list_id").agg(F.count("*").alias("n_bad"))
    whole = placed.join(bad.select("list_id"), "list_id", "left_anti")
    number = (F.row_number().over(Window.partitionBy("list_id").orderBy("place")) - 1).cast("int")
    scale = F.least(F.lit(page_w) / F.col("w"), F.lit(page_h) / F.col("h")) if fit else F.lit(72.0 / dpi)
    w, h = F.col("w") * scale, F.col("h") * scale
    x, y = ((F.lit(page_w) - w) / 2, (F.lit(page_h) - h) / 2) if fit else (F.lit(0.0), F.lit(0.0))
    return whole.select("list_id", number.alias("page_no"), "path", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")), bad
