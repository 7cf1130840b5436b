import datetime

import pytest
from pyspark.sql import functions as F

from foliant.operators import forms, images, pages, review, status
from foliant.sources import records


@pytest.mark.parametrize(("spec", "n", "want"), [("1-3,5,7-9", 10, [0, 1, 2, 4, 6, 7, 8]), ("2", 5, [1]), ("", 5, []), ("1-100", 5, [0, 1, 2, 3, 4]), ("3-1", 5, []), ("a,-,2", 5, [1])])
def test_page_range(spark, spec, n, want):
    df = spark.createDataFrame([(spec, n)], "s string, n int")
    assert df.select(pages.page_range(F.col("s"), F.col("n")).alias("p")).first().p == want


def test_redact_range():
    assert pages.redact_range("1-3, 5", 4) == [0, 1, 2]
    with pytest.raises(ValueError):
        pages.redact_range("all", 4)


def test_rotation_keeps_sign(spark):
    p = spark.createDataFrame([(1, 0, "", 0)], "doc_id long, page_no int, text string, rotation int")
    assert pages.rotate(p, 0, 0, -450).first().rotation == -90


def test_form_round_trip(spark):
    v = spark.createDataFrame([(1, "name", 'O"Neil (x) \\'), (1, "b", "2")], "id long, name string, value string")
    for out, back in ((forms.to_csv, forms.from_csv), (forms.to_fdf, forms.from_fdf)):
        col = "csv" if out is forms.to_csv else "fdf"
        text = out(v, ["id"])
        assert text.select(back(F.col(col)).alias("m")).first().m == {"name": 'O"Neil (x) \\', "b": "2"}


def test_fill_skips_but_locks(spark):
    f = spark.createDataFrame([(1, "a", "text", "old"), (1, "r", "radio", "old"), (1, "c", "checkbox", "false"), (1, "z", "text", "old")], "id long, name string, kind string, value string")
    d = spark.createDataFrame([(1, "a", "new"), (1, "r", "new"), (1, "c", "Yes")], "id long, name string, value string")
    got = {r.name: (r.value, r.read_only) for r in forms.fill(f, d, ["id"]).collect()}
    assert got == {"a": ("new", True), "r": ("old", True), "c": ("true", True), "z": ("old", False)}


def test_threads_and_replies(spark):
    c = spark.createDataFrame([("p", None, "Alice"), ("r", "p", "Bob"), ("o", "gone", "Eve")], "id string, parent_id string, author string")
    assert {r.id: r.shown_parent for r in review.threads(c).collect()} == {"p": None, "r": "p", "o": None}
    assert {r.id: r.replies for r in review.replies(c).collect()}["p"] == ["r"]


def test_dates(spark):
    rows = spark.createDataFrame([("2024-03-01",), ("2024-02-25",), ("2024-01-01",), ("2030-01-01",), ("never",), (None,)], "created string")
    got = [r.v for r in rows.select(review.date_passes(F.col("created"), "Week", datetime.date(2024, 3, 1)).alias("v")).collect()]
    assert got == [True, True, False, True, False, False]


def test_batch_goes_on(spark):
    def work(path):
        if path == "bad":
            raise RuntimeError("no")
        return path

    files = spark.createDataFrame([("good",), ("bad",), ("good2",)], "path string")
    rows = {r.path: (r.ok, r.error) for r in status.run_batch(files, "path", work).collect()}
    assert rows == {"good": (True, None), "bad": (False, "RuntimeError: no"), "good2": (True, None)}


def test_thread_depths_have_no_cap(spark):
    rows = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(150)] + [("r", None), ("s", "r"), ("x", "y"), ("y", "x"), ("z", "x"), ("lost", "gone")]
    got = {r.id: (r.root, r.depth) for r in review.thread_depths(spark.createDataFrame(rows, "id string, parent_id string")).collect()}
    assert got == {f"c{i}": ("c0", i) for i in range(150)} | {"r": ("r", 0), "s": ("r", 1)}


def test_page_content(spark, tmp_path):
    stream = b"BT /F1 12 Tf 1 0 0 1 72 700 Tm (Hello \\(World\\)) Tj 0 -14 Td [(Ke) -20 (rn) -250 (ed)] TJ ET"
    import zlib

    packed = zlib.compress(stream)
    doc = b"%PDF-1.4\n1 0 obj\n<< /Length 9 >>\nstream\n" + stream + b"\nendstream\nendobj\n2 0 obj\n<< /Filter /FlateDecode >>\nstream\n" + packed + b"\nendstream\nendobj"
    (tmp_path / "a.pdf").write_bytes(doc)
    (tmp_path / "b.PDF").write_bytes(b"not one")
    (tmp_path / "c.txt").write_bytes(b"ignored")
    rows = records.documents(spark, str(tmp_path)).orderBy("path", "page_no", "seq").collect()
    assert [(r.text, r.x, r.y) for r in rows if r.page_no == 0] == [("Hello (World)", 72.0, 700.0), ("Kern ed", 72.0, 686.0)]
    assert rows[0].w == pytest.approx(len("Hello (World)") * 12 * 0.6) and rows[0].font == "F1"
    assert {r.page_no for r in rows if r.error is None} == {0, 1}
    assert [r.error for r in rows if r.error] == ["no document header"]
    assert records.page_sections(records.documents(spark, str(tmp_path))).count() == 2
    assert [r.name for r in records.folder(spark, str(tmp_path)).collect()] == ["a.pdf", "b.PDF"]


def test_image_filters():
    import numpy as np

    spot = np.zeros((5, 5), dtype=np.uint8)
    spot[2, 2] = 255
    assert images.median3(spot).max() == 0
    page = np.full((30, 30), 230, dtype=np.uint8)
    page[10:12, 5:25] = 20
    ink = images.adaptive_threshold(page) == 0
    assert ink[10, 15] and not ink[25, 15]
    y, x = np.mgrid[0:60, 0:200]
    tilted = (np.abs((y - 20) - x * np.tan(np.radians(2.0))) < 1) | (np.abs((y - 40) - x * np.tan(np.radians(2.0))) < 1)
    assert images.skew_angle(tilted) == pytest.approx(2.0)
    square = np.array([[0, 0], [9, 0], [9, 9], [0, 9]], dtype=float)
    t = images.homography(square, square + 1)
    assert np.allclose(t @ [3, 4, 1] / (t @ [3, 4, 1])[2], [4, 5, 1])
    ramp = np.tile(np.arange(10.0), (10, 1))
    assert np.allclose(images.warp(ramp, np.eye(3), 10, 10), ramp)


def test_sinks_and_stream(spark, tmp_path):
    from foliant.sources import sinks
    from foliant.streaming import hot_folder

    log = spark.createDataFrame([(1, "2024-01-01T00:00:00", "Error", "a.pdf", -1, "m", "d")], "entry long, timestamp string, severity string, file string, page int, message string, details string")
    sinks.log_csv(log, str(tmp_path / "log"))
    assert {r.value for r in spark.read.text(str(tmp_path / "log")).collect()} == {status.LOG_HEADER, '"2024-01-01T00:00:00","Error","a.pdf",,"m","d"'}
    for i in range(2):
        sinks.append_audit(spark.createDataFrame([(i,)], "n int"), str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 2
    assert not sinks.autosave(log, str(tmp_path / "save"), dirty=False)

    folder = tmp_path / "in"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(str(folder))
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    seen = []
    q = hot_folder.run_once(hot_folder.watch_events(spark, str(folder), schema, 1), lambda df, i: seen.append(df.count()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert len(seen) == 3 and sum(seen) == spark.read.parquet(str(folder)).count()
    assert [hot_folder.autosave_seconds(s) for s in (None, 5, 99999, 120)] == [300, 60, 1800, 120]
    counts = hot_folder.windowed_counts(spark.read.parquet(str(folder)), "ts", ["event_type"], "1 day")
    assert counts.agg(F.sum("n")).first()[0] == sum(seen)
