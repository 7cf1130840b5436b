"""A watched folder: new files become rows, and results are summed up as they come."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Seconds between autosaves.
AUTOSAVE_LEAST, AUTOSAVE_MOST, AUTOSAVE_DEFAULT = 60, 1800, 300
SIGHTING = "path string, length bigint, modified timestamp, seen timestamp"


def autosave_seconds(wanted: int | None) -> int:
    return AUTOSAVE_DEFAULT if wanted is None else max(AUTOSAVE_LEAST, min(wanted, AUTOSAVE_MOST))


def watch_events(spark: SparkSession, path: str, schema: str, files_at_once: int = 16) -> DataFrame:
    """A stream of Parquet files that arrive in a folder; the number taken at once bounds a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def sight(spark: SparkSession, path: str, log: str, pattern: str = "*.{pdf,PDF}") -> None:
    """Appends what a folder holds now to a log of sightings (path, length, modified, seen); no file is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    files.select("path", "length", F.col("modificationTime").alias("modified"), F.current_timestamp().alias("seen")).write.mode("append").parquet(log)


def sightings(spark: SparkSession, log: str, logs_at_once: int = 16) -> DataFrame:
    return watch_events(spark, log, SIGHTING, logs_at_once)


class _Standing(StatefulProcessor):
    """What a file was when it last changed, since when it stands so, when it was last seen, and whether it was passed on."""

    def __init__(self, quiet_ms: int, forget_ms: int):
        self.quiet, self.forget = quiet_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", "length bigint, modified bigint, since bigint, seen bigint, passed boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = self.file.get() if self.file.exists() else None
        out = None
        for r in pd.concat(list(rows)).sort_values(["seen_ms", "modified_ms", "length"]).itertuples():
            if state is None or (r.length, r.modified_ms) != tuple(state[:2]):
                # A sighting from before the last one came late and says nothing new.
                if state is None or r.seen_ms >= state[3]:
                    state = (int(r.length), int(r.modified_ms), int(r.seen_ms), int(r.seen_ms), False)
            else:
                seen = max(int(r.seen_ms), state[3])
                ready = not state[4] and seen - state[2] >= self.quiet
                if ready:
                    out = (key[0], state[0], state[1], seen)
                state = (*state[:3], seen, state[4] or ready)
        self.file.update(state)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(state[3] + self.forget, timerValues.getCurrentWatermarkInMs() + 1))
        if out is not None:
            yield pd.DataFrame([out], columns=["path", "length", "modified_ms", "settled_ms"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # Not seen for so long: the file has left the folder, and one of its name is a new one.
        self.file.clear()
        return iter(())

    def close(self) -> None:
        pass


def settled(seen: DataFrame, quiet_seconds: float = 2.0, forget_seconds: float = 86_400.0) -> DataFrame:
    """(path, length, modified, settled): each file of a stream of sightings, once it was the same for so long.

    A file comes out once for each time that it changes and comes to rest; two sightings at least are needed, so
    that a watcher that stops passes nothing on. State is one row a file and goes by a timer once a file is not seen any
    more while others are: time is that of the sightings, and those later than ``forget_seconds`` are dropped. Restarts go on
    from the checkpoint. Sightings without a path or a time are dropped; the state store must be the RocksDB one.
    """
    ms = lambda c: (F.unix_micros(c) / 1000).cast("bigint")
    rows = seen.filter("path IS NOT NULL AND seen IS NOT NULL").select("path", F.coalesce("length", F.lit(0)).alias("length"), F.coalesce(ms(F.col("modified")), F.lit(0)).alias("modified_ms"), ms(F.col("seen")).alias("seen_ms"), "seen")
    rows = rows.withWatermark("seen", f"{forget_seconds} seconds")
    out = rows.groupBy("path").transformWithStateInPandas(
        _Standing(int(quiet_seconds * 1000), int(forget_seconds * 1000)), "path string, length bigint, modified_ms bigint, settled_ms bigint", outputMode="Append", timeMode="EventTime"
    )
    return out.select("path", "length", F.timestamp_millis("modified_ms").alias("modified"), F.timestamp_millis("settled_ms").alias("settled"))


def windowed_counts(events: DataFrame, ts: str, keys: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window; events later than the watermark are dropped, closed windows leave the state."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there now, batch by batch; the checkpoint makes a restart go on where it ended."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
