"""Embedding whitening by a tiled covariance.

Every entry c of a vector becomes the long x = floor(64 * c) + 1,000,000. The covariance is that
of the distinct x vectors. Pairs of dimensions are dealt into tiles; each block of rows is cut
into column blocks, which meet in a join under (tile, row block), are multiplied and added up
tile by tile. Only sums and tiles, whose number is that of the dimensions squared, reach the
driver, where the covariance is assembled and its eigenvectors are taken.

Column blocks travel as differences from the whole part of the mean, in the smallest integer
type that holds them. With n vectors of sum S, the difference (n*x - S) / n is taken from exact
integers, so entries are centred before they are multiplied and lose nothing to the size of x.

Defined cases: a row whose vector is null, has null or non-finite entries, or entries of 2**40
or beyond in size, takes no part, nor has a vector without entries any components; vectors of
unlike lengths are an error; rows that repeat are one vector of the covariance and a row each
of the result, and null or repeated ids are kept as they are; directions in which the vectors
do not vary (eigenvalues of zero but for rounding) are not components, so equal vectors and
empty tables give an empty result; of equal eigenvalues any orthogonal vectors serve; a
deviation beyond a long is null; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.scratch import Scratch

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Dimensions in a tile's side, and rows in a block.
TILE = 32
BLOCK_ROWS = 4096
#: Entries of this size and beyond are taken for broken.
LARGEST = float(1 << 40)
#: Bytes of tiles that a task adds up before it passes them on, and groups in which tasks' tiles are added first.
HELD_BYTES = 64 << 20
SUM_GROUPS = 64
_LONG = 1 << 62


def integers(rows: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """rows that take part, with x as array<bigint> in place of the vector."""
    v = F.col(vector_col)
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < LARGEST))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("bigint"))
    return rows.filter(v.isNotNull()).filter((F.size(v) > 0) & sound).withColumn(vector_col, x)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _pieces(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, BLOCK_ROWS):
            part = b.slice(at, BLOCK_ROWS)
            yield part, _matrix(part.column(column))


class Mean:
    """The mean of n integer vectors of sum S: S // n and the rest."""

    def __init__(self, n: int, total: list[int]) -> None:
        self.n = n
        self.whole = np.array([s // n for s in total], dtype=np.int64)
        self.rest = np.array([s % n for s in total], dtype=np.int64)

    def part(self, lo: int, hi: int) -> Mean:
        out = object.__new__(Mean)
        out.n, out.whole, out.rest = self.n, self.whole[lo:hi], self.rest[lo:hi]
        return out

    def _fits(self, k: np.ndarray) -> bool:
        return not k.size or (int(np.abs(k).max()) + 1) * self.n < _LONG

    def centred(self, k: np.ndarray) -> np.ndarray:
        """x - S/n from k = x - S//n."""
        k = k.astype(np.int64)
        return (k * self.n - self.rest) / self.n if self._fits(k) else k - self.rest / self.n

    def deviations(self, k: np.ndarray) -> pa.Array:
        """The sum of (n*x - S)**2 over the dimensions, exact, of each row of k = x - S//n."""
        if self._fits(k):
            d = k * self.n - self.rest
            if not d.size or float(np.abs(d).max()) ** 2 * d.shape[1] < _LONG:
                return pa.array((d * d).sum(axis=1), pa.int64())
        exact = ((k.astype(object) * self.n - self.rest.astype(object)) ** 2).sum(axis=1)
        return pa.array([s if s < 1 << 63 else None for s in exact], pa.int64())


def mean(fit: DataFrame) -> Mean:
    """The exact mean of a column of integer vectors of one length, at least one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for _, x in _pieces(batches):
            n += len(x)
            sums = x.sum(axis=0).astype(object)
            total = sums if total is None else total + sums
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array([str(s) for s in total])], ["dim", "n", "total"])

    sums = fit.mapInArrow(run, "dim int, n bigint, total string").groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    rows = sorted(sums.collect())
    return Mean(rows[0]["n"], [int(r["total"]) for r in rows])


def _added(parts: DataFrame) -> list[tuple[int, int, np.ndarray]]:
    """(i, j, sum) of the flat matrices (task, i, j, data) of each tile, first in groups of tasks, then as a whole."""

    def total(key: tuple, table: pa.Table) -> pa.Table:
        data = sum(np.frombuffer(d.as_buffer(), dtype=np.float64) for d in table["data"])
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "j": pa.array([key[1].as_py()], pa.int32()), "data": [data.tobytes()]})

    grouped = parts.groupBy("i", "j", F.pmod("task", F.lit(SUM_GROUPS)).alias("g")).applyInArrow(total, "i int, j int, data binary")
    rows = grouped.groupBy("i", "j").applyInArrow(total, "i int, j int, data binary").toArrow()
    return [(i, j, np.frombuffer(d, dtype=np.float64)) for i, j, d in zip(*(rows[c].to_pylist() for c in ("i", "j", "data")), strict=True)]


def _flush(held: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for (i, j), m in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["task", "i", "j", "data"])
    held.clear()


_TILES = "task int, i int, j int, data binary"


def covariance(fit: DataFrame, m: Mean, scratch: Scratch, tile: int = TILE) -> np.ndarray:
    """The covariance, divisor n, of a column of distinct integer vectors, tile by tile."""
    d = len(m.whole)
    sides = -(-d // tile)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for turn, (_, x) in enumerate(_pieces(batches)):
            k = x - m.whole
            kinds = [np.result_type(np.min_scalar_type(int(c.min())), np.min_scalar_type(-int(c.max()) - 1)) for c in (k[:, i * tile : (i + 1) * tile] for i in range(sides))]
            data = [k[:, i * tile : (i + 1) * tile].astype(t).tobytes() for i, t in enumerate(kinds)]
            block = (task << 32) + turn
            yield pa.RecordBatch.from_arrays([pa.array([block] * sides, pa.int64()), pa.array(range(sides), pa.int32()), pa.array([t.str for t in kinds]), pa.array(data, pa.binary())], ["block", "side", "kind", "data"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}

        def centred(side: int, kind: str, data: bytes) -> np.ndarray:
            at = m.part(side * tile, (side + 1) * tile)
            return at.centred(np.frombuffer(data, dtype=kind).reshape(-1, len(at.whole)))

        for b in batches:
            for r in range(b.num_rows):
                i, j, lk, ld, rk, rd = (b.column(c)[r].as_py() for c in range(6))
                left = centred(i, lk, ld)
                got = left.T @ (left if i == j else centred(j, rk, rd))
                held[i, j] = held[i, j] + got if (i, j) in held else got
                if len(held) * tile * tile * 8 > HELD_BYTES:
                    yield from _flush(held)
        yield from _flush(held)

    blocks = scratch.save(fit.mapInArrow(cut, "block bigint, side int, kind string, data binary"), "blocks")
    own = blocks.selectExpr("side AS i", "side AS j", "kind AS lk", "data AS ld", "CAST(NULL AS string) AS rk", "CAST(NULL AS binary) AS rd")
    left = blocks.filter(F.col("side") < sides - 1).select("block", F.col("side").alias("i"), F.explode(F.sequence(F.col("side") + 1, F.lit(sides - 1))).alias("j"), F.col("kind").alias("lk"), F.col("data").alias("ld"))
    right = blocks.filter("side > 0").select("block", F.explode(F.sequence(F.lit(0), F.col("side") - 1)).alias("i"), F.col("side").alias("j"), F.col("kind").alias("rk"), F.col("data").alias("rd"))
    pairs = left.join(right, ["block", "i", "j"]).select("i", "j", "lk", "ld", "rk", "rd").unionByName(own)
    out = np.zeros((d, d))
    for i, j, data in _added(pairs.mapInArrow(multiply, _TILES)):
        rows, columns = slice(i * tile, (i + 1) * tile), slice(j * tile, (j + 1) * tile)
        out[rows, columns] = data.reshape(out[rows, columns].shape)
        out[columns, rows] = out[rows, columns].T
    scratch.drop(blocks)
    return out / m.n


def _identity_error(fit: DataFrame, m: Mean, project: np.ndarray) -> float:
    """The largest entry, in size, of the measured covariance of the whitened fit list minus the identity."""
    k = project.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for _, x in _pieces(batches):
            # A last column of ones gives the sums of the others.
            w = np.hstack([m.centred(x - m.whole) @ project, np.ones((len(x), 1))])
            held[0, 0] = held.get((0, 0), 0.0) + w.T @ w
        yield from _flush(held)

    ((_, _, data),) = _added(fit.mapInArrow(run, _TILES))
    total = data.reshape(k + 1, k + 1) / m.n
    return float(np.abs(total[:k, :k] - np.outer(total[k, :k], total[k, :k]) - np.eye(k)).max())


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, tile: int = TILE) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error of every row that takes part and every component."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "whitening")
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    x = integers(rows.select(id_col, vector_col), vector_col)
    fit = scratch.save(x.select(vector_col).distinct(), "fit")
    short, long = fit.agg(F.min(F.size(vector_col)), F.max(F.size(vector_col))).first()
    if short is None:
        return spark.createDataFrame([], schema)
    if short != long:
        raise ValueError(f"vectors of {short} to {long} entries: all must have the same number")
    m = mean(fit)
    v = covariance(fit, m, scratch, tile)
    e, vectors = np.linalg.eigh(v)
    e, vectors = e[::-1], vectors[:, ::-1]
    k = min(components, int(np.count_nonzero(e > max(e[0], 0.0) * len(e) * np.finfo(float).eps)))
    if not k:
        return spark.createDataFrame([], schema)
    project = vectors[:, :k] / np.sqrt(e[:k])
    explained = e[:k] / np.trace(v)
    error = _identity_error(fit, m, project)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in _pieces(batches, 1):
            off = values - m.whole
            rows_of = np.repeat(np.arange(len(off)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(rows_of)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(off))),
                    pa.array(np.full(len(rows_of), m.n, dtype=np.int64)),
                    m.deviations(off).take(pa.array(rows_of)),
                    pa.array((m.centred(off) @ project).ravel()),
                    pa.array(np.tile(explained, len(off))),
                    pa.array(np.full(len(rows_of), error)),
                ],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.select(id_col, vector_col).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: up to sixteen rows for each sound row of embeddings."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
