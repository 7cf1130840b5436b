"""Readers: JSON reports and settings, folders of files, and a small parser of page content.

Files are read by Spark (``binaryFile`` or text), never opened on the driver.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.operators import review

#: Defaults of missing keys, and the width of a letter as a share of the font size.
DEFAULT_SCORE = 0.8
PRESET_DEFAULTS = {"name": "", "dpi": 150, "linearized": False, "compressed": True, "pdfA": False, "pdfALevel": "", "batesNumber": False, "batesPrefix": ""}
LETTER_WIDTH = 0.6
SPACE_KERNING = -100
_REPORT = "report struct<jobs: array<struct<validationResult: struct<failedChecks: array<struct<clause: string, ruleId: string, description: string, page: int>>>>>>"


def folder(spark: SparkSession, path: str, pattern: str = "*.{pdf,PDF}") -> DataFrame:
    """Files of one folder, not of those below, in order of their names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(path)
    return files.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length", "modificationTime").orderBy("name")


def detector_lines(df: DataFrame, keys: list[str], json: str) -> DataFrame:
    """Regions of a text-line detector: [{"bbox": [x1, y1, x2, y2], "text_line_score": s}]."""
    rows = df.select(*keys, F.posexplode(F.from_json(json, "array<struct<bbox: array<double>, text_line_score: double>>")).alias("seq", "r"))
    b = F.col("r.bbox")
    out = rows.filter(F.size(b) >= 4).select(
        *keys, "seq", F.lit("Paragraph").alias("type"), b[0].alias("x"), b[1].alias("y"), (b[2] - b[0]).alias("w"), (b[3] - b[1]).alias("h"), F.coalesce("r.text_line_score", F.lit(DEFAULT_SCORE)).alias("confidence")
    )
    return out.filter("w > 0 AND h > 0")


def violations(df: DataFrame, keys: list[str], json: str) -> DataFrame:
    """Failed checks of a validation report; a document without any has one row of nulls."""
    report = F.from_json(json, _REPORT)
    checks = F.get(report["report"]["jobs"], F.lit(0))["validationResult"]["failedChecks"]
    return df.select(*keys, F.explode_outer(checks).alias("c")).select(*keys, "c.*")


def violation_report(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, json): a report's violations as one JSON object, escaped by the writer."""
    v = F.struct("clause", "ruleId", "description", "page")
    some = rows.filter("clause IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(v)).alias("violations"))
    return some.select(*keys, "n", F.to_json(F.struct("violations")).alias("json"))


def presets(df: DataFrame, keys: list[str], json: str) -> DataFrame:
    """Export presets; what a preset leaves out has its default."""
    kinds = {str: "string", int: "int", bool: "boolean"}
    fields = ", ".join(f"{k}: {kinds[type(v)]}" for k, v in PRESET_DEFAULTS.items())
    rows = df.select(*keys, F.explode(F.from_json(json, f"array<struct<{fields}>>")).alias("p"))
    return rows.select(*keys, *[F.coalesce(f"p.{k}", F.lit(v)).alias(k) for k, v in PRESET_DEFAULTS.items()])


def update_manifest(df: DataFrame, keys: list[str], json: str) -> DataFrame:
    """Manifests that name a version, an https address and a digest; others are refused."""
    kind = "version string, releaseDate string, downloadUrl string, sha256 string, releaseNotes string, minVersion string"
    m = df.select(*keys, F.from_json(json, kind).alias("m")).select(*keys, "m.*")
    return m.filter((F.coalesce("version", F.lit("")) != "") & F.lower("downloadUrl").startswith("https://") & (F.trim(F.coalesce("sha256", F.lit(""))) != ""))


def characters(text: Column, font_size: float = 10.0) -> Column:
    """array<struct<i, ch, x, w>>: one entry a character; line ends take no room, so that places stay aligned."""
    chars = F.split(text, "")
    real = F.filter(chars, lambda c: c != "")
    step = font_size * LETTER_WIDTH
    return F.transform(real, lambda c, i: F.struct(i.alias("i"), c.alias("ch"), (i * step).alias("x"), F.when(c.isin("\n", "\r"), 0.0).otherwise(step).alias("w")))


_TOKEN = re.compile(rb"\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s()<>\[\]/]*|[-+]?\d*\.?\d+|[A-Za-z'\"*]+")
_OCTAL = re.compile(rb"\\([0-7]{1,3}|.)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def literal(raw: bytes) -> str:
    """The text of a literal or hexadecimal string token."""
    if raw.startswith(b"<"):
        digits = bytes(c for c in raw[1:-1] if not chr(c).isspace())
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")
    put = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1] < b"8" else _ESCAPES.get(m[1], m[1])
    return _OCTAL.sub(put, raw[1:-1]).decode("latin-1")


def text_elements(content: bytes) -> list[tuple[str, float, float, float, float, str]]:
    """(text, x, y, width, font size, font) of the text shown by a page's content stream.

    Operands stand in the order of the format: a b c d x y Tm, x y Td, font size Tf.
    """
    out, stack = [], []
    x = y = size = leading = 0.0
    font, array = "", None
    for m in _TOKEN.finditer(content):
        t = m[0]
        if t == b"[":
            array = []
        elif t == b"]":
            stack.append(array or [])
            array = None
        elif t[:1] in b"(<":
            (stack if array is None else array).append(literal(t))
        elif t[:1] == b"/":
            stack.append(t[1:].decode("latin-1"))
        elif t[:1] in b"+-.0123456789":
            (stack if array is None else array).append(float(t))
        else:
            op = t.decode("latin-1")
            if op == "Tf" and len(stack) >= 2:
                font, size = str(stack[-2]), float(stack[-1])
            elif op == "Tm" and len(stack) >= 6:
                x, y = float(stack[-2]), float(stack[-1])
            elif op in ("Td", "TD") and len(stack) >= 2:
                x, y = x + float(stack[-2]), y + float(stack[-1])
                leading = -float(stack[-1]) if op == "TD" else leading
            elif op == "T*":
                y -= leading
            elif op in ("Tj", "'", "TJ") and stack:
                if op == "'":
                    y -= leading
                shown = stack[-1]
                if isinstance(shown, list):
                    shown = "".join(s if isinstance(s, str) else " " if s < SPACE_KERNING else "" for s in shown)
                if isinstance(shown, str) and shown:
                    out.append((shown, x, y, len(shown) * size * LETTER_WIDTH, size, font))
            stack = []
    return out


_STREAM = re.compile(rb"<<(?P<dict>(?:[^<>]|<[^<]|>[^>]|<<.*?>>)*?)>>\s*stream\r?\n(?P<data>.*?)\r?\nendstream", re.S)


def page_streams(document: bytes) -> list[bytes]:
    """Content streams that show text, in file order; compressed ones are unpacked, broken ones left out."""
    out = []
    for m in _STREAM.finditer(document):
        data = m["data"]
        if b"FlateDecode" in m["dict"]:
            try:
                data = zlib.decompress(data)
            except zlib.error:
                continue
        if b"BT" in data and b"ET" in data:
            out.append(data)
    return out


_ELEMENT = "path string, page_no int, seq int, text string, x double, y double, w double, font_size double, font string, error string"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Text elements of all documents of a folder; one that cannot be read is a row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _ELEMENT.split(", ")]
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data, rows = raw.as_py(), []
                if not data.startswith(b"%PDF-"):
                    rows.append((p, None, None, None, None, None, None, None, None, "no document header"))
                for page, stream in enumerate(page_streams(data) if not rows else []):
                    rows += [(p, page, i, *e, None) for i, e in enumerate(text_elements(stream))]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], pa.schema([(n, k) for n, k in zip(names, _KINDS, strict=True)]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,PDF}").load(path)
    return files.select("path", "content").mapInArrow(run, _ELEMENT)


_KINDS = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.string()]


def page_sections(elements: DataFrame) -> DataFrame:
    """Nodes: one section a page with its text as one paragraph."""
    rows = elements.filter("error IS NULL").groupBy("path", "page_no").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("_e"))
    return rows.select("path", "page_no", F.lit("Paragraph").alias("kind"), F.array_join(F.transform("_e", lambda e: e["text"]), " ").alias("text"))


def embedded_files(nodes: DataFrame, depth: int = 64) -> DataFrame:
    """(doc_id, name) of the leaves of name trees (doc_id, node, parent, name), to a depth limit."""
    up = F.when(F.col("parent").isNotNull(), F.struct("doc_id", F.col("parent").alias("node")))
    reached = review.thread_depths(nodes.select(F.struct("doc_id", "node").alias("id"), up.alias("parent_id"))).filter(F.col("depth") <= depth)
    return nodes.join(reached.select("id.doc_id", "id.node"), ["doc_id", "node"]).filter("name IS NOT NULL").select("doc_id", "name")


def metadata(df: DataFrame, keys: list[str]) -> DataFrame:
    """Six fields; keywords (an array) are joined by comma and blank."""
    return df.select(*keys, "title", "author", "subject", F.array_join("keywords", ", ").alias("keywords"), "creator", "producer")


def layers(catalogs: DataFrame, objects: DataFrame) -> DataFrame:
    """(doc_id, place, name) of layers: catalogs (doc_id, groups: array of objects) in order, objects (doc_id, object, name).

    A group without a name is passed over; a reference to no object ends the document's list.
    """
    listed = catalogs.select("doc_id", F.posexplode("groups").alias("place", "object"))
    found = listed.join(objects.withColumn("_there", F.lit(1)), ["doc_id", "object"], "left")
    lost = F.max(F.col("_there").isNull()).over(Window.partitionBy("doc_id").orderBy("place"))
    return found.withColumn("_lost", lost).filter("NOT _lost AND name IS NOT NULL").select("doc_id", "place", "name")
