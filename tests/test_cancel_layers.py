"""Cancelling by epoch, layer names, glyph advances."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from foliant.functions import geometry
from foliant.sources import records
from foliant.streaming.cancel import Cancellable, Cancelled


def _sleep(batches):
    for b in batches:
        time.sleep(60)
        yield b


def test_cancel_by_epoch(spark):
    lane, seen = Cancellable(spark), []
    slow = lane.hand_in(lambda: spark.range(2).mapInArrow(_sleep, "id bigint").count())
    waiting = lane.hand_in(lambda: spark.range(3).count())

    def run():
        try:
            slow()
        except Cancelled as e:
            seen.append(e)

    thread = threading.Thread(target=run)
    thread.start()
    start = time.time()
    while not spark.sparkContext.statusTracker().getActiveJobsIds() and time.time() < start + 30:
        time.sleep(0.1)
    lane.cancel()
    thread.join(30)
    assert len(seen) == 1 and not thread.is_alive()
    with pytest.raises(Cancelled):
        waiting()
    assert lane.hand_in(lambda: spark.range(3).count())() == 3
    with pytest.raises(ZeroDivisionError):
        lane.hand_in(lambda: 1 // 0)()


def test_layers_end_at_a_lost_reference(spark):
    catalogs = spark.createDataFrame([(1, [7, 8, 9, 5]), (2, [5, 7]), (3, []), (4, None)], "doc_id int, groups array<int>")
    objects = spark.createDataFrame([(1, 7, "plan"), (1, 8, None), (1, 9, "text"), (2, 7, "lost")], "doc_id int, object int, name string")
    assert sorted(tuple(r) for r in records.layers(catalogs, objects).collect()) == [(1, 0, "plan"), (1, 2, "text")]


def test_glyph_advance_and_gap(spark):
    rows = spark.createDataFrame([([65, 32, 99], 10.0), ([], 10.0), ([65], 0.0)], "g array<int>, size double")
    widths = F.create_map(F.lit(65), F.lit(600.0), F.lit(32), F.lit(250.0))
    a = geometry.glyph_advance(F.col("g"), widths, F.col("size"), F.lit(2.0), F.lit(0.0), F.lit(3.0), F.lit(32))
    got = [tuple(r) for r in rows.select(a, geometry.pen_gap(a, F.col("size"), F.lit(2.0))).collect()]
    assert got == [(23.0, -1150.0), (0.0, None), (0.0, None)]
