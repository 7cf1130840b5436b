"""Recognition of page images: pluggable engines, detections to regions, and the strategies that combine engines.

Models are not part of this package: an engine is any function from an image's bytes to word
rows, made once in each worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import geometry
from foliant.operators import layout, rover, status

Engine = Callable[[bytes], list[tuple[str, float, float, float, float, int]]]
_NAMES = ["doc_id", "page_no", "engine", "seq", "text", "x", "y", "w", "h", "confidence", "error"]
_KINDS = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.string()]
_WORD = "doc_id bigint, page_no int, engine string, seq int, text string, x double, y double, w double, h double, confidence int, error string"


def recognize(images: DataFrame, name: str, make: Callable[[], Engine]) -> DataFrame:
    """Word rows of images (doc_id, page_no, width, height, content). An image that is too large or fails is a row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = make()
        for b in batches:
            for i in range(b.num_rows):
                doc, page, fits, content = (b.column(k)[i].as_py() for k in range(4))
                try:
                    rows = [(doc, page, name, k, *w, None) for k, w in enumerate(engine(content))] if fits else [(doc, page, name, *[None] * 7, "too large")]
                except Exception as e:  # one page must not end the run
                    rows = [(doc, page, name, *[None] * 7, f"{type(e).__name__}: {e}")]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS)], _NAMES)

    fits = status.within_limits(F.col("width"), F.col("height"), "ocr")
    return images.select(F.col("doc_id").cast("bigint"), F.col("page_no").cast("int"), fits.alias("fits"), "content").mapInArrow(run, _WORD)


def regions(detections: DataFrame, least: float = layout.DETECT_CONFIDENCE) -> DataFrame:
    """Regions from detections (doc_id, page_no, seq, logits, cx, cy, w, h as shares of the page, page_w, page_h).

    The class is the first of largest score; boxes are cut to the page; reading order goes by
    the top left corners.
    """
    best = F.array_max("logits")
    d = detections.withColumns({"confidence": geometry.sigmoid(best), "class_id": (F.array_position("logits", best) - 1).cast("int")}).filter(F.col("confidence") >= least)
    pw, ph = F.col("page_w"), F.col("page_h")
    box = geometry.clipped(F.col("cx") * pw, F.col("cy") * ph, F.col("w") * pw, F.col("h") * ph, pw, ph)
    r = d.select("doc_id", "page_no", "seq", layout.region_type(F.col("class_id")).alias("type"), "confidence", box.alias("b")).select("doc_id", "page_no", "seq", "type", "confidence", "b.*")
    return layout.reading_order(r, "seq", by="corner")


def text_boxes(scores: DataFrame, page_w: Column, page_h: Column, least: float = 0.3) -> DataFrame:
    """Boxes of text lines from score pixels (doc_id, page_no, x, y, score): connected areas, grown a little."""
    areas = layout.components(scores.filter(F.col("score") >= least))
    grown = geometry.unclipped(geometry.box(*[F.col(c) for c in ("x", "y", "w", "h")]), page_w, page_h)
    return areas.select("doc_id", "page_no", "component", "area", grown.alias("b")).select("doc_id", "page_no", "component", "area", "b.*")


def combined(first: DataFrame, second: DataFrame | None, strategy: str, names: tuple[str, str]) -> DataFrame:
    """Words of one page set by a strategy: PrimaryOnly, ConfidenceWeighted or RoverVote.

    ConfidenceWeighted asks the second engine only for pages whose mean confidence is low: give
    ``second`` as a plan that reads those pages' images and it runs for no others.
    """
    alone = first.drop("error", "engine").withColumn("source_engine", F.lit(names[0]))
    if second is None or strategy == "PrimaryOnly":
        return alone
    if strategy == "RoverVote":
        return layout.rover_merge(first.drop("error").unionByName(second.drop("error")), *names)
    if strategy != "ConfidenceWeighted":
        raise ValueError(f"no strategy is named {strategy!r}")
    # The words of both meet once, by page, where the mean of the first's says which are taken.
    parts = layout.parts_for(first.select(*layout.PAGE))
    both = rover.tagged(first, *names, primary=True).unionByName(rover.tagged(second, *names))
    kinds = dict(alone.select(*layout.PAGE, "seq", "text", "x", "y", "w", "h", "confidence", "source_engine").dtypes)
    return rover.as_kinds(rover.merged(both, parts, names, 0.5, layout.SECOND_ENGINE_BELOW), kinds)


def low_pages(words: DataFrame) -> DataFrame:
    """Pages whose words are less sure than the limit on average."""
    return words.groupBy(*layout.PAGE).agg(F.avg("confidence").alias("mean")).filter(F.col("mean") < layout.SECOND_ENGINE_BELOW).select(*layout.PAGE)
