"""Semantic documents as node rows, and the texts written from them.

A node is (doc_id, page_no, block, row_no, cell_no, kind, text): block counts the blocks of a
page in reading order; lists have an item in each row, tables a cell in each row and cell_no.
There is one section a page, so headings stand at the second level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import geometry, strings
from foliant.operators import layout

PAGE = ["doc_id", "page_no"]
NODE = [*PAGE, "block", "row_no", "cell_no", "kind", "text"]
#: A new line where y moves by this share of the font size; units of a slide to a point.
LINE_SHARE = 0.8
EMU = 12700


_FLAT = ["seq", "x", "y", "w", "h", "text"]


def _block_nodes(rows: pa.Table) -> pa.RecordBatch:
    """Nodes of whole blocks: (PAGE, block, kind, _nth, seq, x, y, w, h, text), words of a block by y, x and seq, a block without words as one row without text."""
    seq, x, y, w, h = (rows.column(c).fill_null(0).to_numpy() for c in _FLAT[:-1])
    fresh = rows.column("_nth").to_numpy() == 1
    block = np.cumsum(fresh) - 1
    kinds = rows.column("kind").filter(pa.array(fresh)).to_pylist()
    table = np.array([k == "Table" for k in kinds], dtype=bool)[block]
    banded = np.array([k in ("List", "Table") for k in kinds], dtype=bool)[block]

    # Lines chain by half the height of the word before; within a line words go from the left.
    step = fresh.copy()
    step[1:] |= y[1:] - y[:-1] > np.maximum(h[1:], h[:-1]) * 0.5
    order = np.lexsort((seq, x, np.cumsum(step)))

    # A word joins the first band that is near; words as high and at the same height as one before join its band, so each such run is looked up once.
    band = np.zeros(len(order), dtype=np.int64)
    at = order[banded[order]]
    if len(at):
        begins = np.ones(len(at), dtype=bool)
        begins[1:] = (block[at][1:] != block[at][:-1]) | (y[at][1:] != y[at][:-1]) | (h[at][1:] != h[at][:-1])
        heads = at[begins]
        found = np.empty(len(heads), dtype=np.int64)
        edges = np.flatnonzero(np.concatenate([[True], block[heads][1:] != block[heads][:-1], [True]]))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            found[lo:hi] = layout.first_band(y[heads[lo:hi]].tolist(), h[heads[lo:hi]].tolist())
        band[at] = found[np.cumsum(begins) - 1]

    # Cells of a band of a table: a new one after a gap wider than eight tenths of the mean width. Other bands keep the order of their words.
    nth = np.empty(len(order), dtype=np.int64)
    nth[order] = np.arange(len(order))
    by_row = np.lexsort((np.where(table, 0, nth), np.where(table, seq, 0), np.where(table, x, 0.0), band, block))
    new_row = np.ones(len(by_row), dtype=bool)
    new_row[1:] = (block[by_row][1:] != block[by_row][:-1]) | (band[by_row][1:] != band[by_row][:-1])
    starts = np.flatnonzero(new_row)
    sizes = np.diff(np.append(starts, len(by_row)))
    wide = np.repeat(np.add.reduceat(w[by_row], starts) / sizes * 0.8, sizes)
    xs, right = x[by_row], (x + w)[by_row]
    new_cell = new_row.copy()
    new_cell[1:] |= table[by_row][1:] & (xs[1:] - right[:-1] > wide[1:])
    node = np.flatnonzero(new_cell)
    passed = np.cumsum(new_cell)
    cell = passed[node] - passed[starts][np.cumsum(new_row)[node] - 1]

    text = rows.column("text").combine_chunks().take(pa.array(by_row))
    known = np.append(0, np.cumsum(text.is_valid().to_numpy(zero_copy_only=False)))
    offsets = known[np.append(node, len(by_row))]
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), text.drop_null()), " ")
    first = pa.array(by_row[node])
    keys = [rows.column(c).combine_chunks().take(first) for c in (*PAGE, "block")]
    made = [pa.array(band[by_row[node]], pa.int32()), pa.array(cell, pa.int32())]
    return pa.RecordBatch.from_arrays([*keys, *made, rows.column("kind").combine_chunks().take(first), joined], NODE)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches may end inside a block: its rows wait for the rest."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        starts = np.flatnonzero(b.column("_nth").to_numpy() == 1)
        if len(starts) and (held or starts[-1]):
            yield _block_nodes(pa.Table.from_batches([*held, b.slice(0, starts[-1])]))
            held = []
        if b.num_rows:
            held.append(b.slice(starts[-1]) if len(starts) else b)
    if held:
        yield _block_nodes(pa.Table.from_batches(held))


def from_layout(words: DataFrame, regions: DataFrame) -> DataFrame:
    """Nodes of pages with regions: each region is a block, with the words whose centres it holds.

    Words are read once, those outside the bounds of all regions go before they are moved, and the rest meet their regions by page. The rows of a page then
    lie together in order, and blocks are made of them as they come, whatever their number.
    """
    ordered = layout.reading_order(regions, "region_id").select(*PAGE, F.col("reading_order").alias("block"), layout.block_kind(F.col("type"))["block"].alias("kind"), *[F.col(c).alias(f"_{c}") for c in ("x", "y", "w", "h")])
    edges = regions.agg(F.min("x").alias("_x0"), F.max(F.col("x") + F.col("w")).alias("_x1"), F.min("y").alias("_y0"), F.max(F.col("y") + F.col("h")).alias("_y1"))
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    near = words.select(*PAGE, *_FLAT).join(F.broadcast(edges), cx.between(F.col("_x0"), F.col("_x1")) & cy.between(F.col("_y0"), F.col("_y1"))).select(*PAGE, *_FLAT)
    box = geometry.box(*[F.col(f"r._{c}") for c in ("x", "y", "w", "h")])
    same = (F.col("r.doc_id") == F.col("e.doc_id")) & (F.col("r.page_no") == F.col("e.page_no"))
    inside = geometry.center_in(geometry.box(*[F.col(f"e.{c}") for c in ("x", "y", "w", "h")]), box)
    # Few regions a page, so they are looked up and the words need no sorting for it.
    placed = ordered.hint("shuffle_hash").alias("r").join(near.alias("e"), same & inside, "left")
    # The window brings the rows of a page into one task and in order, and its first rows mark where blocks begin.
    nth = F.row_number().over(Window.partitionBy(*PAGE, "block").orderBy("y", "x", "seq", "text"))
    number = [F.col(c).cast("double") for c in ("x", "y", "w", "h")]
    rows = placed.select(*[F.col(f"r.{c}") for c in (*PAGE, "block", "kind")], *[F.col(f"e.{c}") for c in _FLAT])
    rows = rows.withColumn("_nth", nth).select(*PAGE, "block", "kind", "_nth", F.col("seq").cast("bigint"), *number, "text")
    keys = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in (*PAGE, "block"))
    return rows.mapInArrow(_nodes, f"{keys}, row_no int, cell_no int, kind string, text string")


#: Fixed value: the origin that blocks of read pages name.
READ_TAG = "BornOCR"


def block_provenance(regions: DataFrame, path: Column) -> DataFrame:
    """(doc_id, page_no, block, region_id, kind, tag, x0, y0, x1, y1, source_file) of the block of every region, in reading order.

    source_file holds the attribute of headers, footers, equations, references and captions before the path, and the path alone for others.
    """
    kind = layout.block_kind(F.col("type"))
    ordered = layout.reading_order(regions, "region_id").withColumn("_k", kind)
    edges = [F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1")]
    source = strings.provenance(F.col("_k.attribute"), path)
    return ordered.select(*PAGE, F.col("reading_order").alias("block"), "region_id", F.col("_k.block").alias("kind"), F.lit(READ_TAG).alias("tag"), *edges, source.alias("source_file"))


def part_boxes(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x0, y0, x1, y1): the box around the words of each item, row or cell."""
    right, lower = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    return words.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), right.alias("x1"), lower.alias("y1"))


def error_pages(pages: DataFrame) -> DataFrame:
    """Nodes of pages that failed (doc_id, page_no, error): one paragraph each."""
    text = F.concat(F.lit("[OCR error: "), "error", F.lit("]"))
    zero = F.lit(0)
    return pages.filter("error <> ''").select(*PAGE, zero.alias("block"), zero.alias("row_no"), zero.alias("cell_no"), F.lit("Paragraph").alias("kind"), text.alias("text"))


def to_djot(nodes: DataFrame, level: int = 2) -> DataFrame:
    """(doc_id, djot): headings, paragraphs, lists, pipe tables, code and figures in order."""
    t = strings.djot_escape(F.col("text"))
    # A document's nodes meet once; all groupings below are of parts of documents.
    cells = nodes.repartition("doc_id").withColumn("_t", t).groupBy(*PAGE, "block", "kind", "row_no").agg(F.array_sort(F.collect_list(F.struct("cell_no", "_t"))).alias("_c"))
    only = F.array_join(F.transform("_c", lambda c: c["_t"]), " ")
    ruler = F.when(F.col("row_no") == F.col("_first"), F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size("_c")), F.lit("\n"))).otherwise("")
    row = F.concat(F.lit("|"), F.array_join(F.transform("_c", lambda c: F.concat(F.lit(" "), c["_t"], F.lit(" |"))), ""), F.lit("\n"), ruler)
    line = F.when(F.col("kind") == "Table", row).when(F.col("kind").isin("List"), F.concat(F.lit("- "), only, F.lit("\n"))).when(F.col("kind") == "CodeBlock", F.concat(only, F.lit("\n"))).otherwise(only)
    first = F.min("row_no").over(Window.partitionBy(*PAGE, "block"))
    lines = cells.withColumn("_first", first).withColumn("_l", line)
    blocks = lines.groupBy(*PAGE, "block", "kind").agg(F.array_sort(F.collect_list(F.struct("row_no", "_l"))).alias("_r"))
    body = F.array_join(F.transform("_r", lambda r: r["_l"]), "")
    text = (
        F.when(F.col("kind") == "Heading", F.concat(F.lit("#" * level + " "), body, F.lit("\n\n")))
        .when(F.col("kind").isin("List", "Table"), F.concat(body, F.lit("\n")))
        .when(F.col("kind") == "CodeBlock", F.concat(F.lit("```\n"), body, F.lit("```\n\n")))
        .when(F.col("kind") == "Figure", F.concat(F.lit("::: figure\n"), body, F.lit("\n:::\n\n")))
        .when(F.col("kind") == "ListItem", F.concat(body, F.lit("\n")))
        .otherwise(F.concat(body, F.lit("\n\n")))
    )
    whole = blocks.withColumn("_b", text).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "block", "_b"))).alias("_s"))
    return whole.select("doc_id", F.array_join(F.transform("_s", lambda b: b["_b"]), "").alias("djot"))


def to_text(elements: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text) of elements (seq, y, font_size, text): a line break where y moves by enough, else a blank; pages end with a blank line."""
    w = Window.partitionBy(*keys, "page_no").orderBy("seq")
    gap = F.abs(F.col("y") - F.lag("y").over(w))
    joint = F.when(gap.isNull(), "").when(gap > F.col("font_size") * LINE_SHARE, "\n").otherwise(" ")
    pages = elements.withColumn("_t", F.concat(joint, "text")).groupBy(*keys, "page_no").agg(F.array_sort(F.collect_list(F.struct("seq", "_t"))).alias("_e"))
    pages = pages.withColumn("_p", F.concat(F.array_join(F.transform("_e", lambda e: e["_t"]), ""), F.lit("\n\n")))
    docs = pages.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("page_no", "_p"))).alias("_d"))
    return docs.select(*keys, F.array_join(F.transform("_d", lambda p: p["_p"]), "").alias("text"))


def to_csv(elements: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, csv): rows of elements by line, all cells quoted; rows may differ in length."""
    rows = layout.row_groups(elements, [*keys, "page_no"]).groupBy(*keys, "page_no", "row_no").agg(F.array_sort(F.collect_list(F.struct("x", "seq", "text"))).alias("_c"))
    rows = rows.withColumn("_r", strings.csv_row(F.transform("_c", lambda c: c["text"])))
    docs = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("page_no", "row_no", "_r"))).alias("_d"))
    return docs.select(*keys, F.concat(F.array_join(F.transform("_d", lambda r: r["_r"]), "\n"), F.lit("\n")).alias("csv"))


def html_element(page_height: float) -> Column:
    """One absolutely placed element (x, y from the bottom, font_size, text)."""
    top = F.lit(page_height) - F.col("y") - F.col("font_size")
    number = lambda c: F.round(c).cast("long").cast("string")
    return F.concat(
        F.lit('<div style="position:absolute;left:'), number(F.col("x")), F.lit("pt;top:"), number(top), F.lit("pt;font-size:"), number(F.col("font_size")), F.lit('pt">'),
        strings.html_escape(F.col("text")), F.lit("</div>"),
    )


def to_html(elements: DataFrame, keys: list[str], page_height: float = 792.0) -> DataFrame:
    """(keys, html): a page division for each page, elements in order."""
    pages = elements.withColumn("_h", html_element(page_height)).groupBy(*keys, "page_no").agg(F.array_sort(F.collect_list(F.struct("seq", "_h"))).alias("_e"))
    body = F.concat(F.lit('<div class="page">\n'), F.array_join(F.transform("_e", lambda e: e["_h"]), "\n"), F.lit("\n</div>\n"))
    docs = pages.withColumn("_p", body).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("page_no", "_p"))).alias("_d"))
    return docs.select(*keys, F.concat(F.lit("<!DOCTYPE html>\n<html><body>\n"), F.array_join(F.transform("_d", lambda p: p["_p"]), ""), F.lit("</body></html>\n")).alias("html"))


def slide_boxes(elements: DataFrame, page_height: float) -> DataFrame:
    """Elements with text as slide boxes in integer units: y turned round, places 0 at least, sizes 1 at least."""
    emu = lambda v: (v * EMU).cast("long")
    shown = elements.filter(F.trim("text") != "")
    return shown.select(
        *[c for c in elements.columns if c not in ("x", "y", "w", "h", "font_size")],
        F.greatest(emu(F.col("x")), F.lit(0).cast("long")).alias("x"),
        F.greatest(emu(F.lit(page_height) - F.col("y") - F.col("h")), F.lit(0).cast("long")).alias("y"),
        F.greatest(emu(F.col("w")), F.lit(1).cast("long")).alias("w"),
        F.greatest(emu(F.col("h")), F.lit(1).cast("long")).alias("h"),
        F.greatest((F.col("font_size") * 100).cast("int"), F.lit(100)).alias("size"),
    )


def sort_elements(elements: DataFrame, keys: list[str]) -> DataFrame:
    """place within keys: lines from the top (largest y first) that chain within half a font size, then from the left."""
    w = Window.partitionBy(*keys).orderBy(F.col("y").desc(), "x", "seq")
    step = F.coalesce((F.lag("y").over(w) - F.col("y") >= F.least("font_size", F.lag("font_size").over(w)) * 0.5).cast("int"), F.lit(0))
    lines = elements.withColumn("_s", step).withColumn("_line", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return lines.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("_line", "x", "seq")) - 1).drop("_s", "_line")


#: Tags of a preview with their styles.
PREVIEW_OPEN = "<html><body style='font-family:Manrope,sans-serif;font-size:13px;background:#f4f1ea;color:#1a1a1a;padding:16px;'>"
PREVIEW_TITLE = "<h2 style='font-size:14px;font-weight:700;margin:12px 0 4px;color:#666;border-top:1px solid #ccc;padding-top:8px;'>"
PREVIEW_BLOCKS = {
    "Heading": ("<h1 style='font-size:18px;font-weight:600;margin:8px 0 4px;color:#1a1a1a;'>", "</h1>"),
    "Paragraph": ("<p style='margin:4px 0;color:#1a1a1a;'>", "</p>"),
    "Figure": ("<p style='margin:4px 0;color:#555;font-style:italic;'><span style='background:#dbeafe;padding:1px 4px;border-radius:2px;'>Figure: </span> ", "</p>"),
    "List": ("<ul style='margin:4px 0 4px 20px;color:#1a1a1a;'>", "</ul>"),
    "Table": ("<table style='border-collapse:collapse;margin:6px 0;width:100%;'>", "</table>"),
    "CodeBlock": ("<pre style='background:#f5f5f5;padding:6px;font-family:monospace;font-size:11px;margin:4px 0;overflow:auto;'>", "</pre>"),
    "ListItem": ("", ""),
}
PREVIEW_INLINES = {"Strong": ("<b>", "</b>"), "Emph": ("<i>", "</i>"), "Code": ("<code style='font-family:monospace;background:#e0e0e0;padding:1px 3px;'>", "</code>")}
PREVIEW_HEAD = "border:1px solid #999;padding:3px 6px;background:#e8e8e8;font-weight:600;"
PREVIEW_CELL = "border:1px solid #ccc;padding:3px 6px;"


def inlines_html(inlines: Column) -> Column:
    """HTML of array<struct<kind, texts>>: texts escaped one by one, in the tags of their kind; plain text has none."""

    def one(i: Column) -> Column:
        text = F.array_join(F.transform(i["texts"], strings.html_escape), "")
        out = text
        for kind, (begin, end) in PREVIEW_INLINES.items():
            out = F.when(i["kind"] == kind, F.concat(F.lit(begin), text, F.lit(end))).otherwise(out)
        return out

    return F.coalesce(F.array_join(F.transform(inlines, one), ""), F.lit(""))


def _by_kind(kind: Column, place: int) -> Column:
    out = F.lit("")
    for k, tags in PREVIEW_BLOCKS.items():
        out = F.when(kind == k, tags[place]).otherwise(out)
    return out


def _in_order(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_s"))
    return g.select(*keys, F.array_join(F.transform("_s", lambda s: s[text]), "").alias(text))


def to_preview(nodes: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, html) of nodes (NODE with ``inlines`` in place of text) and sections (doc_id, page_no, title), from the cells up.

    A section without a title has no heading, one without nodes nothing else; the first row of a table is its head.
    """
    at = [*PAGE, "block", "kind"]
    first = F.min("row_no").over(Window.partitionBy(*PAGE, "block")) == F.col("row_no")
    inner = inlines_html(F.col("inlines"))
    tag, style = F.when(F.col("_first"), "th").otherwise("td"), F.when(F.col("_first"), PREVIEW_HEAD).otherwise(PREVIEW_CELL)
    cell = F.concat(F.lit("<"), tag, F.lit(" style='"), style, F.lit("'>"), inner, F.lit("</"), tag, F.lit(">"))
    cells = nodes.withColumn("_first", first).withColumn("_t", F.when(F.col("kind") == "Table", cell).otherwise(inner))
    rows = _in_order(cells, [*at, "row_no"], "cell_no", "_t")
    line = F.when(F.col("kind") == "Table", F.concat(F.lit("<tr>"), "_t", F.lit("</tr>"))).when(F.col("kind") == "List", F.concat(F.lit("<li>"), "_t", F.lit("</li>")))
    rows = rows.withColumn("_t", line.when(F.col("kind") == "CodeBlock", F.concat("_t", F.lit("\n"))).otherwise(F.col("_t")))
    blocks = _in_order(rows, at, "row_no", "_t")
    blocks = blocks.withColumn("_t", F.concat(_by_kind(F.col("kind"), 0), "_t", _by_kind(F.col("kind"), 1)))
    pages = sections.select(*PAGE, "title").join(_in_order(blocks, PAGE, "block", "_t"), PAGE, "left")
    title = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit(PREVIEW_TITLE), strings.html_escape(F.col("title")), F.lit("</h2>"))).otherwise("")
    docs = _in_order(pages.withColumn("_t", F.concat(title, F.coalesce("_t", F.lit("")))), ["doc_id"], "page_no", "_t")
    return docs.select("doc_id", F.concat(F.lit(PREVIEW_OPEN), "_t", F.lit("</body></html>")).alias("html"))
