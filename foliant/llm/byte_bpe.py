"""Byte-level BPE: encoding with tiktoken from a local rank file, and decoding to raw bytes.

Long texts are cut before they are encoded, only where a white-space character follows a
letter or digit: no match of the pre-splitting pattern crosses such a place and none looks
back over it, so the ids of the parts are the ids of the whole, in bounded memory.

Defined cases: a null text counts as empty and has no ids; strings that look like special
tokens are ordinary text; repeated rows are encoded each; an empty table gives an empty
result; extra columns pass through, and replaced ones are those named here.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from foliant.llm.scratch import small_batches

RANKS = "byte_bpe_multi_50k.tiktoken"
PART_CHARS = 1 << 15


def safe_parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """Parts of at least ``size`` characters each but the last, cut before a blank after a letter or digit."""
    start, n = 0, len(text)
    while n - start > size:
        at = start + size
        while at < n:
            found = [p for p in (text.find(" ", at, at + 4096), text.find("\n", at, at + 4096)) if p >= 0]
            if not found:
                at = min(at + 4096, n)
                continue
            at = min(found)
            if text[at - 1].isalnum():
                break
            at += 1
        if at >= n:
            break
        yield text[start:at]
        start = at
    yield text[start:]


class Codec:
    """One rank file: ids of a text and bytes of ids."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.numbers = [str(i) for i in range(max(ranks.values()) + 1)]

    def parts(self, text: str) -> Iterator[list[int]]:
        for part in safe_parts(text):
            # Lone surrogates, which tiktoken would replace too, cannot come from Parquet.
            yield self.encoding.encode_ordinary(part)

    def encode(self, text: str) -> list[int]:
        return [i for part in self.parts(text) for i in part]

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and the SHA-256 of the ids as text and of the decoded bytes, part by part."""
        n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
        for ids in self.parts(text):
            if ids:
                of_ids.update(("," * bool(n) + ",".join([self.numbers[i] for i in ids])).encode())
                of_bytes.update(self.decode(ids))
                n += len(ids)
        return n, of_ids.hexdigest(), of_bytes.hexdigest()


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One per worker process and file."""
    return Codec(path)


def _ranks(name: str) -> str:
    return name if "/" in name else public_tokenizers.path(name)


def _chunked(b: pa.RecordBatch, column: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about a megabyte of one column, or one row: their results stay small."""
    sizes = np.cumsum([0, *(len(v.as_buffer()) if v.is_valid else 0 for v in b.column(column).cast(pa.large_binary()))])
    first = 0
    while first < b.num_rows:
        last = max(first + 1, int(np.searchsorted(sizes, sizes[first] + limit, side="right")) - 1)
        yield b.slice(first, last - first)
        first = last


def encode(docs: DataFrame, ranks: str = RANKS, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds the ids of every whole text, their number and the SHA-256 of the ids as text."""
    small_batches(docs.sparkSession)
    made = [ids_col, "n_tokens", "ids_sha256"]
    rest = docs.drop(*[c for c in made if c != text_col])
    at = rest.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(_ranks(ranks))
        for whole in batches:
            for b in _chunked(whole, at):
                ids, hashes = [], []
                for t in b.column(at):
                    parts, sha = [], hashlib.sha256()
                    for part in c.parts(t.as_py() or ""):
                        if part:
                            sha.update(("," * bool(parts) + ",".join([c.numbers[i] for i in part])).encode())
                            parts.append(np.array(part, dtype=np.int32))
                    ids.append(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32))
                    hashes.append(sha.hexdigest())
                bounds = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(np.diff(bounds).astype(np.int64)), pa.array(hashes, pa.string())], [*b.schema.names, *made])

    added = T.StructType([T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType())])
    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, *added.fields]))


def decode(df: DataFrame, ranks: str = RANKS, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Adds the raw bytes of the ids; null ids give null."""
    rest = df.drop(bytes_col)
    at = rest.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(_ranks(ranks))
        for whole in batches:
            for first in range(0, whole.num_rows, 64):
                b = whole.slice(first, 64)
                raw = [None if not v.is_valid else c.decode(v.as_py()) for v in b.column(at)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], [*b.schema.names, bytes_col])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(bytes_col, T.BinaryType())]))


def digests(docs: DataFrame, ranks: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: a round trip of every text, without keeping its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(_ranks(ranks))
        for b in batches:
            out = [c.digest(t.as_py() or "") for t in b.column(1)]
            n, of_ids, of_bytes = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: one row for each row of documents."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the token ids of every document, their number and their digest."""
    return encode(docs).select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256")
