"""Files of a watched folder are passed on once they stand still."""

import datetime

import pytest
from pyspark.sql import functions as F

from foliant.streaming import hot_folder

_STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def _at(second):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second)


def _poll(spark, log, second, files):
    """One sighting a file of (name, length, second of its last change)."""
    rows = [(name, length, _at(changed), _at(second)) for name, length, changed in files]
    spark.createDataFrame(rows, hot_folder.SIGHTING).coalesce(1).write.mode("append").parquet(log)


def _run(spark, log, checkpoint, out):
    def take(df, i):
        out.extend((r.path, r.length) for r in df.collect())

    q = hot_folder.run_once(hot_folder.settled(hot_folder.sightings(spark, log), 2.0), take, checkpoint)
    q.awaitTermination(60)
    assert not q.isActive and q.exception() is None


def test_a_growing_file_comes_out_once_after_a_restart_too(rocks, tmp_path):
    log, checkpoint, out = str(tmp_path / "log"), str(tmp_path / "cp"), []
    _poll(rocks, log, 0, [("a", 10, 0), ("still", 5, -9), (None, 1, 0)])
    _poll(rocks, log, 1, [("a", 20, 1), ("still", 5, -9)])
    _run(rocks, log, checkpoint, out)
    assert out == []
    # Every run is a restart from the checkpoint.
    _poll(rocks, log, 2, [("a", 20, 1), ("still", 5, -9)])
    _run(rocks, log, checkpoint, out)
    assert out == [("still", 5)]
    _poll(rocks, log, 3, [("a", 20, 1), ("still", 5, -9), ("empty", 0, 3)])
    _poll(rocks, log, 9, [("a", 20, 1), ("still", 5, -9), ("empty", 0, 3)])
    _run(rocks, log, checkpoint, out)
    assert sorted(out) == [("a", 20), ("empty", 0), ("still", 5)]
    # Written again with the same length: it changed, and comes out once more after it rested.
    _poll(rocks, log, 10, [("a", 20, 10)])
    _poll(rocks, log, 12, [("a", 20, 10)])
    _run(rocks, log, checkpoint, out)
    assert sorted(out) == [("a", 20), ("a", 20), ("empty", 0), ("still", 5)]
    # Two days on only another file is seen; the others are forgotten, and one that comes back is new.
    _poll(rocks, log, 200_000, [("other", 1, 200_000)])
    _run(rocks, log, checkpoint, out)
    _poll(rocks, log, 200_001, [("still", 5, -9)])
    _poll(rocks, log, 200_009, [("still", 5, -9)])
    _run(rocks, log, checkpoint, out)
    assert sorted(out) == [("a", 20), ("a", 20), ("empty", 0), ("still", 5), ("still", 5)]


def test_sightings_of_a_folder(spark, tmp_path):
    folder, log = tmp_path / "in", str(tmp_path / "log")
    folder.mkdir()
    (folder / "a.pdf").write_bytes(b"12345")
    (folder / "b.txt").write_bytes(b"1")
    for _ in range(2):
        hot_folder.sight(spark, str(folder), log)
    seen = spark.read.schema(hot_folder.SIGHTING).parquet(log)
    assert seen.select(F.substring_index("path", "/", -1), "length").collect() == [("a.pdf", 5)] * 2
    assert seen.filter("modified IS NULL OR seen IS NULL").count() == 0
