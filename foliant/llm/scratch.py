"""Tables written between the steps of an operator.

They go to the shared folder that the session names in ``spark.checkpoint.dir``, so that
a lost executor costs only the tasks it ran. Only a local session that names none, as in
tests, gets a folder of its own; on a cluster a missing setting is an error.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: What a job shuffled is of no use once its table is written.
_WHILE_SAVING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Bytes of a batch that goes to a Python worker.
BATCH_BYTES = 16 << 20
#: Rows of a few numbers each are bounded by their count alone; weighing every row takes longer than passing it on.
_NARROW = {"spark.sql.execution.arrow.maxBytesPerBatch": str(2**31 - 1)}


def small_batches(spark: SparkSession) -> SparkSession:
    """Bounds batches to Python workers by bytes, as rows of whole texts may be long; holds for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker hands its free memory back: Spark keeps it beside the others for later tasks."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim is not None:
                trim(0)

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/foliant-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """A folder of intermediate Parquet tables; dropped one by one, or all at exit."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        small_batches(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self.clear)

    def save(self, df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
        """Write df now and return it read back, with a cut lineage. narrow: what it passes to Python are rows of a few numbers."""
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        conf = self.spark.conf
        wanted = _WHILE_SAVING | (_NARROW if narrow else {})
        before = {k: conf.get(k, None) for k in wanted}
        for k, v in wanted.items():
            conf.set(k, v)
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._foliant_path = path
        return out

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)

    def drop(self, *frames: DataFrame | None) -> None:
        """Delete tables that nothing reads any more."""
        for df in frames:
            if df is not None and hasattr(df, "_foliant_path"):
                self._delete(df._foliant_path)

    def clear(self) -> None:
        try:
            if self.spark._jsc is not None and self.spark._jsc.sc().isStopped() is False:
                self._delete(self.root)
        except Exception:  # the JVM may be gone at exit
            pass
