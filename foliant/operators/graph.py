"""What the objects of page files mean: joins over the rows of ``sources.objects``.

References are followed one step, as the format asks for. What leads nowhere is left out, and a tree with
a cycle loses what hangs on the cycle and nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import geometry
from foliant.operators.review import _cut as cut
from foliant.sources.objects import gathered, path_is
from foliant.sources.records import text_elements

#: Kinds of annotations by their subtype, all others are comments; a page without a size has this one.
ANNOTATION_MODES = {"StrikeOut": "Strikeout", "Squiggly": "Squiggly", "Underline": "Underline", "Highlight": "Highlight", "Stamp": "Stamp", "FreeText": "Callout", "Text": "AddComment"}
DEFAULT_BOX = (0.0, 0.0, 612.0, 792.0)


def entries(objects: DataFrame, name: str) -> DataFrame:
    """file, object, sub, kind, value, target: what stands under one key of each object, a reference there followed."""
    own = objects.filter(F.get("path", F.lit(0)) == name).select("file", "object", F.slice("path", 2, 1 << 30).alias("sub"), "kind", "value", "target")
    far = own.filter((F.size("sub") == 0) & (F.col("kind") == "ref")).select("file", "object", F.col("target").alias("there"))
    there = objects.select("file", F.col("object").alias("there"), F.col("path").alias("sub"), "kind", "value", "target")
    followed = far.join(there, ["file", "there"]).filter("kind <> 'xref'").select("file", "object", "sub", "kind", "value", "target")
    return own.filter((F.size("sub") > 0) | (F.col("kind") != "ref")).unionByName(followed)


def scalar(objects: DataFrame, name: str, kind: str) -> DataFrame:
    """file, object and the value under a key, if it is of the kind."""
    return entries(objects, name).filter((F.size("sub") == 0) & (F.col("kind") == kind)).select("file", "object", F.col("value").alias(name))


def numbers(objects: DataFrame, name: str) -> DataFrame:
    """file, object and the array of numbers under a key."""
    found = entries(objects, name).filter((F.size("sub") == 1) & (F.col("kind") == "number"))
    rows = found.groupBy("file", "object").agg(F.array_sort(F.collect_list(F.struct(F.get("sub", F.lit(0)).cast("int").alias("i"), F.col("value").cast("double").alias("v")))).alias("_v"))
    return rows.select("file", "object", F.transform("_v", lambda x: x["v"]).alias(name))


def catalog(objects: DataFrame) -> DataFrame:
    """file, object: the catalog that the trailer names, else the last object that says it is one."""
    named = objects.filter((F.col("object") == 0) & path_is("Root") & (F.col("kind") == "ref")).select("file", F.col("target").alias("named"))
    typed = objects.filter((F.col("object") > 0) & path_is("Type") & (F.col("value") == "Catalog")).groupBy("file").agg(F.max("object").alias("typed"))
    return typed.join(named, "file", "full").select("file", F.coalesce("named", "typed").alias("object"))


def page_tree(objects: DataFrame) -> DataFrame:
    """file, page_no, object, box, rotate, resources of every page, in the order of the tree.

    The box, the turn and the resources (struct<object, path>: where their dictionary is) come from the
    nearest node above that has them: each round joins every node with the ancestor it has reached, so
    that the depth known doubles.
    """
    kids = entries(objects, "Kids").filter((F.size("sub") == 1) & (F.col("kind") == "ref")).select("file", F.col("target").alias("node"), F.col("object").alias("up"), F.get("sub", F.lit(0)).cast("int").alias("place"))
    # A node with several parents belongs to the first.
    kids = kids.groupBy("file", "node").agg(F.min(F.struct("up", "place")).alias("p")).select("file", "node", "p.up", F.array("p.place").alias("key"))
    root = catalog(objects).join(objects.filter(path_is("Pages") & (F.col("kind") == "ref")), ["file", "object"]).select("file", F.col("target").alias("node"))
    kids = kids.join(root, ["file", "node"], "left_anti")
    res = objects.filter(path_is("Resources") & F.col("kind").isin("dict", "ref")).select(
        "file", "object", F.when(F.col("kind") == "ref", F.struct(F.col("target").alias("object"), F.array().cast("array<string>").alias("path"))).otherwise(F.struct("object", "path")).alias("resources")
    )
    nodes = kids.unionByName(root.select("file", "node", F.lit(None).cast("int").alias("up"), F.array().cast("array<int>").alias("key")))
    for more in (numbers(objects, "MediaBox").withColumnRenamed("MediaBox", "box"), scalar(objects, "Rotate", "number").select("file", "object", F.col("Rotate").cast("double").cast("int").alias("rotate")), res):
        nodes = nodes.join(more.withColumnRenamed("object", "node"), ["file", "node"], "left")
    sizes = nodes.groupBy("file").agg(F.count("*").alias("most"))
    state = cut(nodes.join(sizes, "file"))
    done = state.filter("up IS NULL")
    left = state.filter("up IS NOT NULL")
    carried = ["box", "rotate", "resources"]
    while not left.isEmpty():
        above = done.unionByName(left).select("file", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("key").alias("_key"), *[F.col(c).alias(f"_{c}") for c in carried])
        moved = left.join(above, ["file", "up"]).select("file", "node", F.col("_up").alias("up"), F.concat("_key", "key").alias("key"), *[F.coalesce(c, f"_{c}").alias(c) for c in carried], "most")
        # A way longer than there are nodes goes round.
        moved = cut(moved.filter(F.size("key") <= F.col("most")))
        done, left = done.unionByName(moved.filter("up IS NULL")), moved.filter("up IS NOT NULL")
    typed = objects.filter(path_is("Type") & (F.col("value") == "Page")).select("file", F.col("object").alias("node"))
    pages = done.join(typed, ["file", "node"])
    number = F.row_number().over(Window.partitionBy("file").orderBy("key")) - 1
    box = F.coalesce("box", F.array(*map(F.lit, DEFAULT_BOX)))
    return pages.select("file", number.alias("page_no"), F.col("node").alias("object"), box.alias("box"), F.coalesce("rotate", F.lit(0)).alias("rotate"), "resources")


def page_contents(objects: DataFrame, pages: DataFrame) -> DataFrame:
    """file, page_no, content: the streams of a page as one, in order; a page without any has an empty one."""
    roots = objects.filter(path_is() & ~F.col("kind").isin("xref", "error"))
    streams = roots.filter("kind = 'stream'").select("file", F.col("object").alias("target"), "data")
    whole = objects.filter(path_is("Contents") & (F.col("kind") == "ref")).select("file", "object", "target", F.lit(0).alias("i"))
    listed = entries(objects, "Contents").filter((F.size("sub") == 1) & (F.col("kind") == "ref")).select("file", "object", "target", F.get("sub", F.lit(0)).cast("int").alias("i"))
    # A reference to a list has no stream of its own and falls out here.
    parts = whole.unionByName(listed).join(streams, ["file", "target"]).join(pages.select("file", "object", "page_no"), ["file", "object"])
    joined = parts.groupBy("file", "page_no").agg(F.array_sort(F.collect_list(F.struct("i", "data"))).alias("_p"))
    content = F.aggregate("_p", F.lit(b""), lambda done, p: F.concat(done, p["data"], F.lit(b"\n")))
    return pages.select("file", "page_no").join(joined.select("file", "page_no", content.alias("content")), ["file", "page_no"], "left").select("file", "page_no", F.coalesce("content", F.lit(b"")).alias("content"))


def page_elements(contents: DataFrame) -> DataFrame:
    """file, page_no, seq, text, x, y, w, font_size, font of the text that pages show."""
    names = ["text", "x", "y", "w", "font_size", "font"]
    kinds = [pa.string(), *[pa.float64()] * 4, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = ([(i, *e) for i, e in enumerate(text_elements(b.column(2)[r].as_py()))] for r in range(b.num_rows))
            yield from gathered(b.columns[:2], found, ["file", "page_no", "seq", *names], [pa.int32(), *kinds])

    kind = contents.schema["file"].dataType.simpleString()
    return contents.select("file", "page_no", "content").mapInArrow(run, f"file {kind}, page_no int, seq int, text string, x double, y double, w double, font_size double, font string")


def page_sections(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """file, page_no, text: a section for every page, an empty one for a page without text."""
    rows = elements.groupBy("file", "page_no").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("_e"))
    text = F.array_join(F.transform("_e", lambda e: e["text"]), " ")
    return pages.select("file", "page_no").join(rows.select("file", "page_no", text.alias("text")), ["file", "page_no"], "left").select("file", "page_no", F.coalesce("text", F.lit("")).alias("text"))


_OPERATOR = re.compile(rb"\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>|/([^\s()<>\[\]/]*)|([-+]?(?:\d+\.?\d*|\.\d+))|([A-Za-z'\"*]+)", re.S)
_UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def _times(m: tuple, n: tuple) -> tuple:
    """The transform that applies m and then n."""
    a, b, c, d, e, f = m
    g, h, i, j, k, o = n
    return a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + o


def drawn(content: bytes) -> list[tuple]:
    """(name, a, b, c, d, e, f) of every named object that a page draws, with the transform in force; a restore without a save is passed over."""
    now, saved, operands, out = _UNIT, [], [], []
    for m in _OPERATOR.finditer(content):
        if m[3] is None:
            operands.append(m[1].decode("latin-1") if m[1] is not None else float(m[2]) if m[2] is not None else None)
            continue
        if m[3] == b"q":
            saved.append(now)
        elif m[3] == b"Q" and saved:
            now = saved.pop()
        elif m[3] == b"cm" and len(operands) >= 6:
            now = _times(tuple(x if isinstance(x, float) else 0.0 for x in operands[-6:]), now)
        elif m[3] == b"Do" and operands and isinstance(operands[-1], str):
            out.append((operands[-1], *now))
        operands = []
    return out


def drawings(contents: DataFrame) -> DataFrame:
    """file, page_no, seq, name, m (six numbers) of what pages draw by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = ([(i, x[0], list(x[1:])) for i, x in enumerate(drawn(b.column(2)[r].as_py()))] for r in range(b.num_rows))
            yield from gathered(b.columns[:2], found, ["file", "page_no", "seq", "name", "m"], [pa.int32(), pa.string(), pa.list_(pa.float64())])

    kind = contents.schema["file"].dataType.simpleString()
    return contents.select("file", "page_no", "content").mapInArrow(run, f"file {kind}, page_no int, seq int, name string, m array<double>")


def named_resources(objects: DataFrame, holders: DataFrame, kind: str = "XObject") -> DataFrame:
    """holders (file, resources, ...) with name and target of each resource of a kind, also where the dictionary of the kind is elsewhere."""
    at = holders.withColumns({"object": F.col("resources.object"), "_base": F.concat("resources.path", F.array(F.lit(kind)))})
    below = at.join(objects.filter("kind = 'ref'").select("file", "object", "path", "target"), ["file", "object"])
    n = F.size("_base")
    direct = below.filter((F.size("path") == n + 1) & (F.slice("path", F.lit(1), n) == F.col("_base"))).withColumn("name", F.try_element_at("path", F.lit(-1)))
    far = below.filter(F.col("path") == F.col("_base")).drop("object", "path").withColumnRenamed("target", "object")
    far = far.join(objects.filter((F.col("kind") == "ref") & (F.size("path") == 1)).select("file", "object", "path", "target"), ["file", "object"]).withColumn("name", F.get("path", F.lit(0)))
    keep = [*holders.columns, "name", "target"]
    return direct.select(*keep).unionByName(far.select(*keep))


def image_inventory(objects: DataFrame, pages: DataFrame, contents: DataFrame) -> DataFrame:
    """file, page_no, seq, name, x, y, w, h, rotation, width_px, height_px of every time a page draws one of its images."""
    images = objects.filter(path_is("Subtype") & (F.col("value") == "Image")).select("file", F.col("object").alias("target"))
    for name, column in (("Width", "width_px"), ("Height", "height_px")):
        px = scalar(objects, name, "number").select("file", F.col("object").alias("target"), F.col(name).cast("double").cast("int").alias(column))
        images = images.join(px, ["file", "target"], "left").withColumn(column, F.coalesce(column, F.lit(0)))
    held = named_resources(objects, pages.filter("resources IS NOT NULL").select("file", "page_no", "resources")).join(images, ["file", "target"])
    placed = drawings(contents).join(held.drop("resources", "target"), ["file", "page_no", "name"])
    m = F.col("m")
    size = geometry.placement(F.get(m, F.lit(0)), F.get(m, F.lit(1)), F.get(m, F.lit(2)), F.get(m, F.lit(3)))
    return placed.withColumn("_s", size).select("file", "page_no", "seq", "name", F.get(m, F.lit(4)).alias("x"), F.get(m, F.lit(5)).alias("y"), "_s.w", "_s.h", "_s.rotation", "width_px", "height_px")


def annotation_scan(objects: DataFrame, pages: DataFrame) -> DataFrame:
    """file, page_no, place, id, parent_id, mode, author, text, created, state, x, y, w, h, replies of the annotations of all pages.

    An answer names the object it answers; its parent_id is that object's own id, null where that is lost. Replies are
    the distinct ids of those who answer, in the order of pages and places. Boxes have their origin at the top left.
    """
    listed = entries(objects, "Annots").filter((F.size("sub") == 1) & (F.col("kind") == "ref")).select("file", "object", F.get("sub", F.lit(0)).cast("int").alias("place"), F.col("target").alias("a"))
    rows = listed.join(pages.select("file", "object", "page_no", (F.get("box", F.lit(3)) - F.get("box", F.lit(1))).alias("_height")), ["file", "object"]).drop("object")
    # A reference to nothing is no annotation.
    rows = rows.join(objects.filter(path_is() & (F.col("kind") == "dict")).select("file", F.col("object").alias("a")), ["file", "a"])
    for name, column in (("NM", "id"), ("T", "author"), ("Contents", "text"), ("CreationDate", "created"), ("State", "state")):
        rows = rows.join(scalar(objects, name, "string").select("file", F.col("object").alias("a"), F.col(name).alias(column)), ["file", "a"], "left")
    rows = rows.join(scalar(objects, "Subtype", "name").select("file", F.col("object").alias("a"), "Subtype"), ["file", "a"], "left")
    rows = rows.join(numbers(objects, "Rect").select("file", F.col("object").alias("a"), F.when(F.size("Rect") == 4, F.col("Rect")).alias("_r")), ["file", "a"], "left")
    ids = scalar(objects, "NM", "string").select("file", F.col("object").alias("target"), F.col("NM").alias("parent_id"))
    answers = objects.filter(path_is("IRT") & (F.col("kind") == "ref")).select("file", F.col("object").alias("a"), "target").join(ids, ["file", "target"]).drop("target")
    rows = rows.join(answers, ["file", "a"], "left")
    mode = F.lit("AddComment")
    for subtype, named in ANNOTATION_MODES.items():
        mode = F.when(F.col("Subtype") == subtype, named).otherwise(mode)
    r, zero = F.col("_r"), F.lit(0.0)
    rows = rows.select(
        "file", "page_no", "place", "id", "parent_id", mode.alias("mode"), "author", F.coalesce("text", F.lit("")).alias("text"), "created", "state",
        F.coalesce(F.get(r, F.lit(0)), zero).alias("x"), F.coalesce(F.col("_height") - F.get(r, F.lit(3)), zero).alias("y"), F.coalesce(F.get(r, F.lit(2)) - F.get(r, F.lit(0)), zero).alias("w"), F.coalesce(F.get(r, F.lit(3)) - F.get(r, F.lit(1)), zero).alias("h"),
    )
    said = rows.filter("parent_id IS NOT NULL AND id <> ''").groupBy("file", F.col("parent_id").alias("id"), F.col("id").alias("_c")).agg(F.min(F.struct("page_no", "place")).alias("_at"))
    said = said.groupBy("file", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_c"))), lambda s: s["_c"]).alias("replies"))
    return rows.join(said, ["file", "id"], "left").withColumn("replies", F.coalesce("replies", F.array().cast("array<string>")))


def _json_string(text: Column) -> Column:
    """A JSON string with its quotes."""
    return F.regexp_replace(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', "$1")


def _json_number(text: Column) -> Column:
    """A number of the format as one of JSON: no plus sign, no zeros in front, digits on both sides of a point."""
    plain = F.regexp_replace(F.regexp_replace(text, r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
    return F.regexp_replace(F.regexp_replace(plain, r"^(-?)\.", "$10."), r"\.$", "")


def structure_json(objects: DataFrame) -> DataFrame:
    """file, json: all objects as one JSON text, by number; keys sorted, names with their slash, strings after u:.

    Values are written from the deepest level up, one grouping a level; levels are few, as they are nested brackets.
    """
    v = F.col("value")
    leaf = (
        F.when(F.col("kind") == "name", _json_string(F.concat(F.lit("/"), v))).when(F.col("kind") == "string", _json_string(F.concat(F.lit("u:"), v)))
        .when(F.col("kind") == "ref", _json_string(v)).when(F.col("kind") == "number", _json_number(v)).otherwise(v)
    )
    rows = cut(objects.filter("kind NOT IN ('xref', 'error')").select("file", "object", "path", "kind", F.size("path").alias("depth"), leaf.alias("json")))
    deepest = rows.agg(F.max("depth")).first()[0]
    made = rows.filter(F.col("depth") == deepest) if deepest is not None else rows
    for depth in range(deepest or 0, -1, -1):
        # Containers without anything in them have no text yet.
        made = made.withColumn("json", F.coalesce("json", F.when(F.col("kind") == "array", "[]").otherwise("{}")))
        if depth == 0:
            break
        key, place = F.try_element_at("path", F.lit(-1)), F.try_element_at("path", F.lit(-1)).try_cast("int")
        inner = made.select("file", "object", F.slice("path", F.lit(1), F.size("path") - 1).alias("path"), F.struct(place.alias("i"), key.alias("k"), "json").alias("e"))
        whole = inner.groupBy("file", "object", "path").agg(F.collect_list("e").alias("_e"))
        upper = rows.filter(F.col("depth") == depth - 1).join(whole, ["file", "object", "path"], "left")
        items = F.array_join(F.transform(F.array_sort("_e"), lambda e: e["json"]), ",")
        pairs = F.array_join(F.transform(F.array_sort(F.transform("_e", lambda e: F.struct(e["k"].alias("k"), e["json"].alias("json")))), lambda e: F.concat(_json_string(F.concat(F.lit("/"), e["k"])), F.lit(":"), e["json"])), ",")
        text = F.when(F.col("_e").isNull(), F.col("json")).when(F.col("kind") == "array", F.concat(F.lit("["), items, F.lit("]"))).otherwise(F.concat(F.lit("{"), pairs, F.lit("}")))
        made = upper.select("file", "object", "path", "kind", "depth", text.alias("json"))
    body = F.when(F.col("kind") == "stream", F.concat(F.lit('{"stream":{"dict":'), "json", F.lit("}}"))).otherwise(F.concat(F.lit('{"value":'), "json", F.lit("}")))
    name = F.when(F.col("object") == 0, F.lit('"trailer"')).otherwise(F.concat(F.lit('"obj:'), F.col("object").cast("string"), F.lit(' 0 R"')))
    parts = made.groupBy("file").agg(F.array_sort(F.collect_list(F.struct((F.col("object") == 0).alias("last"), "object", F.concat(name, F.lit(":"), body).alias("text")))).alias("_p"))
    return parts.select("file", F.concat(F.lit('{"version":2,"objects":{'), F.array_join(F.transform("_p", lambda p: p["text"]), ","), F.lit("}}")).alias("json"))
