"""Page files as rows of their objects.

One row for each value of each object: ``path`` holds the keys and array places that lead to it, so a
dictionary is the rows below its path. The row whose path is empty is the object itself, and carries the
unpacked bytes of a stream. Object 0 is the trailer. Rows of kind ``xref`` say where the file's own table
puts an object; a file without objects is one row of kind ``error``. What the objects mean (the page tree,
resources, references) is left to joins over these rows.

Objects are found by their marks and not by the file's table, so a broken table loses nothing; of
several objects of one number the last holds. Encrypted files are not decrypted.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import patterns
from foliant.sources.records import literal

_VALUE = re.compile(
    rb"(?:\s|%[^\r\n]*[\r\n])*(?:(?P<dict><<)|(?P<close>>>)|(?P<hex><[0-9A-Fa-f\s]*>)|(?P<name>/[^\s()<>\[\]{}/%]*)|(?P<ref>\d+\s+\d+\s+R(?![A-Za-z0-9]))"
    rb"|(?P<number>[-+]?(?:\d+\.?\d*|\.\d+))|(?P<array>\[)|(?P<end>\])|(?P<string>\()|(?P<word>true|false|null))"
)
_BRACKET = re.compile(rb"\\.|[()]", re.S)
_MARK = re.compile(rb"(?<!\d)(\d{1,9})\s+(\d{1,5})\s+obj(?![A-Za-z])")
_STREAM = re.compile(rb"\s*stream\r?\n")
_TRAILER = re.compile(rb"(?<![A-Za-z])trailer(?=\s*<<)")
_ENTRY = re.compile(rb"(\d{10}) (\d{5}) ([nf])")

FIELDS = "object int, at bigint, path array<string>, kind string, value string, target int, data binary"
_TYPES = [pa.int32(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int32(), pa.binary()]


def _string_end(data: bytes, at: int) -> int:
    depth = 1
    for m in _BRACKET.finditer(data, at):
        depth += {b"(": 1, b")": -1}.get(m[0], 0)
        if not depth:
            return m.end()
    raise ValueError("a string without an end")


def _text(raw: bytes) -> str:
    s = literal(raw)
    return s.encode("latin-1").decode("utf-16", "replace") if s.startswith(("\xfe\xff", "\xff\xfe")) else s


def flat(data: bytes, at: int) -> tuple[list[tuple], int]:
    """Rows (path, kind, value, target) of the value that begins at a place, and where it ends."""
    rows: list[tuple] = []
    inside: list[list] = []  # of each open container: whether it is a dictionary, and the key or place next to be filled
    while True:
        m = _VALUE.match(data, at)
        if m is None:
            raise ValueError(f"no value at {at}")
        kind, token, at = m.lastgroup, m[m.lastgroup], m.end()
        if kind in ("close", "end"):
            if not inside or inside[-1][0] != (kind == "close"):
                raise ValueError(f"a bracket too many at {at}")
            inside.pop()
        elif inside and inside[-1][0] and inside[-1][1] is None:
            if kind != "name":
                raise ValueError(f"no key at {at}")
            inside[-1][1] = token[1:].decode("latin-1")
            continue
        else:
            value = target = None
            if kind == "string":
                begin, at = at - 1, _string_end(data, at)
                value = _text(data[begin:at])
            elif kind == "hex":
                kind, value = "string", _text(token)
            elif kind == "ref":
                value = " ".join(token.decode().split())
                target = int(value.split()[0])
            elif kind not in ("dict", "array"):
                value = token.decode("latin-1").removeprefix("/")
            rows.append(([str(k) for _, k in inside], kind, value, target))
            if kind in ("dict", "array"):
                inside.append([kind == "dict", None if kind == "dict" else 0])
                continue
        if not inside:
            return rows, at
        inside[-1][1] = None if inside[-1][0] else inside[-1][1] + 1


def _unpacked(body: bytes, filters: list[str]) -> bytes:
    if filters != ["FlateDecode"]:
        return body
    try:
        return zlib.decompressobj().decompress(body)
    except zlib.error:
        return body


def _packed_objects(body: bytes, values: dict[tuple, str]) -> Iterator[tuple[int, list[tuple]]]:
    """Objects that stand in a stream of objects."""
    n, first = int(values.get(("N",), 0)), int(values.get(("First",), 0))
    head = [int(x) for x in body[:first].split()[: 2 * n]]
    for number, offset in zip(head[::2], head[1::2], strict=False):
        try:
            yield number, flat(body, first + offset)[0]
        except ValueError:
            continue


def rows_of(data: bytes) -> Iterator[tuple]:
    """(object, at, path, kind, value, target, data) of all objects of a file."""
    found: dict[int, tuple[int, list[tuple], bytes | None]] = {}
    trailer: tuple[int, list[tuple]] | None = None
    at = 0
    while m := _MARK.search(data, at):
        try:
            rows, at = flat(data, m.end())
        except ValueError:
            at = m.end()
            continue
        number, body = int(m[1]), None
        if rows[0][1] == "dict" and (s := _STREAM.match(data, at)):
            values = {tuple(p): v for p, _, v, _ in rows}
            length = values.get(("Length",), "")
            end = s.end() + int(length) if length.isdigit() else -1
            if end < 0 or not data[end : end + 12].lstrip().startswith(b"endstream"):
                end = data.find(b"endstream", s.end())
                end = len(data) if end < 0 else end
            filters = [v for p, v in values.items() if p[:1] == ("Filter",) and v]
            body, at = _unpacked(data[s.end() : end], filters), end
            rows[0] = ([], "stream", None, None)
            kind = values.get(("Type",))
            if kind == "ObjStm":
                for inner, inner_rows in _packed_objects(body, values):
                    found[inner] = (m.start(), inner_rows, None)
            if kind == "XRef" and ("Root",) in values:
                trailer = (m.start(), [([], "dict", None, None), *rows[1:]])
        found[number] = (m.start(), rows, body)
    for m in _TRAILER.finditer(data):
        try:
            rows, _ = flat(data, m.end())
        except ValueError:
            continue
        if any(p == ["Root"] for p, *_ in rows):
            trailer = (m.start(), rows)
    if trailer and found:
        found[0] = (*trailer, None)
    for number, (place, rows, body) in found.items():
        for path, kind, value, target in rows:
            yield number, place, path, kind, value, target, body if not path else None
    if not found:
        yield None, None, [], "error", "no objects", None, None
    yield from _table(data)


def _table(data: bytes) -> Iterator[tuple]:
    """Where the last table of the file puts its objects."""
    starts = re.findall(rb"startxref\s+(\d+)", data)
    head = re.compile(rb"\s*xref\s+").match(data, int(starts[-1])) if starts else None
    at = head.end() if head else len(data)
    while part := re.compile(rb"(\d+) (\d+)\s+").match(data, at):
        number, at = int(part[1]), part.end()
        for i in range(int(part[2])):
            entry = _ENTRY.match(data, at)
            if entry is None:
                return
            at = re.compile(rb"\s*").match(data, entry.end()).end()
            if entry[3] == b"n":
                yield number + i, int(entry[1]), [], "xref", None, None, None


#: Rows of a batch that a worker gives back, and bytes of data in them; a batch for each small file would cost more than the file.
BATCH_ROWS, BATCH_BYTES = 8192, 1 << 24


def gathered(keys: list[pa.Array], found: Iterable[Iterable[tuple]], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of the rows found for each row of keys, with its keys in front: many keys share a batch, and one with many rows has several."""
    owners: list[int] = []
    rows: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*(k.take(pa.array(owners, pa.int64())) for k in keys), *columns], names)

    for r, some in enumerate(found):
        for row in some:
            owners.append(r)
            rows.append(row)
            size += len(row[-1]) if isinstance(row[-1], bytes) else 0
            if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield batch()
                owners, rows, size = [], [], 0
    if rows:
        yield batch()


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by their key to some tasks a core: a small table is one split, however many files are made from it."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def object_rows(files: DataFrame, key: str = "file", content: str = "content") -> DataFrame:
    """key and the rows of all objects of each file; a null content is a file without objects."""
    names = [key, *(f.split()[0] for f in FIELDS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = (rows_of(b.column(1)[r].as_py() or b"") for r in range(b.num_rows))
            yield from gathered(b.columns[:1], found, names, _TYPES)

    return files.select(key, content).mapInArrow(run, f"`{key}` {files.schema[key].dataType.simpleString()}, {FIELDS}")


def read_objects(spark: SparkSession, path: str, pattern: str = "*.{pdf,PDF}") -> DataFrame:
    """The object rows of a folder's files, under their paths; any store that Spark reads will do."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return object_rows(files.select(F.col("path").alias("file"), "content"))


def load_status(objects: DataFrame, key: str = "file") -> DataFrame:
    """key, status, n_objects: ok where the file's table has each object where it is, repaired where not, error without objects."""
    said = F.when(F.col("kind") == "xref", F.col("at"))
    root = F.when((F.size("path") == 0) & (F.col("object") > 0) & ~F.col("kind").isin("xref", "error"), F.col("at"))
    # Dealt by file once: the three groupings below need no other shuffle, and none gathers a file.
    rows = spread(objects.filter(F.size("path") == 0).select(key, "object", root.alias("root"), said.alias("said")), key)
    each = rows.groupBy(key, "object").agg(F.max("root").alias("at"), F.min("said").alias("low"), F.max("said").alias("high"))
    there = F.col("at").isNotNull()
    # Objects in a stream of objects share its place and have no entry of their own.
    places = each.groupBy(key, "at").agg(F.min_by(F.struct("low", "high"), "object").alias("said"), F.count_if(there).alias("n"), F.count("low").alias("listed"))
    right = F.coalesce((F.col("said.low") == F.col("at")) & (F.col("said.high") == F.col("at")), F.col("n") > 1)
    out = places.groupBy(key).agg(
        F.sum("n").alias("n_objects"), F.bool_and(F.when(there, right)).alias("right"), F.sum("listed").alias("listed"), F.coalesce(F.bool_or(~there & (F.col("listed") > 0)), F.lit(False)).alias("lost")
    )
    status = F.when(F.col("n_objects") == 0, "error").when(F.col("right") & (F.col("listed") > 0) & ~F.col("lost"), "ok").otherwise("repaired")
    return out.select(key, status.alias("status"), F.col("n_objects").cast("bigint").alias("n_objects"))


def object_marks(blocks: DataFrame, key: str = "file") -> DataFrame:
    """key, object, at: the marks of objects in a file that is read as blocks (block from 0, data), also over the edges of blocks.

    Every block looks a little way into the next, and counts what begins in it; the last mark of a number holds.
    """
    order = Window.partitionBy(key).orderBy("block")
    text = F.decode("data", "ISO-8859-1")
    begin = F.coalesce(F.sum(F.octet_length("data")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A digit in front would make it another number.
    before = F.coalesce(F.right(F.lag(text).over(order), F.lit(1)), F.lit(" "))
    seen = blocks.select(key, begin.alias("begin"), F.octet_length("data").alias("size"), F.concat(before, text, F.coalesce(F.left(F.lead(text).over(order), F.lit(32)), F.lit(""))).alias("text"))
    spans = seen.select(key, "begin", "size", F.explode(patterns.match_spans(F.col("text"), r"(?<!\d)\d{1,9}\s{1,4}\d{1,5}\s{1,4}obj(?![A-Za-z])")).alias("s"))
    own = spans.filter((F.col("s.start") >= 1) & (F.col("s.start") <= F.col("size")))
    marks = own.select(key, F.regexp_extract("s.match", r"^(\d+)", 1).cast("int").alias("object"), (F.col("begin") + F.col("s.start") - 1).alias("at"))
    return marks.groupBy(key, "object").agg(F.max("at").alias("at"))


def path_is(*keys: str) -> Column:
    return F.col("path") == F.array(*map(F.lit, keys)) if keys else F.size("path") == 0
