"""Rectangles of pages reach into forms."""

from foliant.operators import graph, nested
from tests.test_objects import build, rows, stream

TEXT = b"BT /F 10 Tf 1 0 0 1 %d %d Tm (%s) Tj ET "


def files(spark):
    form = lambda content, extra="": stream(content, "/Subtype /Form " + extra)
    parts = {
        1: "<< /Type /Catalog /Pages 2 0 R >>",
        2: "<< /Type /Pages /Kids [3 0 R 4 0 R] /Resources << /XObject << /A 10 0 R /C 12 0 R >> >> >>",
        3: "<< /Type /Page /Contents 5 0 R >>",
        4: "<< /Type /Page /Contents 6 0 R >>",
        5: stream(TEXT % (5, 5, b"plain") + b"q 2 0 0 2 100 100 cm /A Do Q q 1 0 0 1 0 300 cm /A Do Q /C Do"),
        6: stream(b"q 1 0 0 1 50 50 cm /A Do Q"),
        10: form(TEXT % (10, 10, b"outer") + b"q 0 1 -1 0 60 0 cm /B Do Q", "/Resources << /XObject << /B 11 0 R >> >> /BBox [0 0 200 200] "),
        11: form(TEXT % (20, 30, b"inner"), "/Matrix [1 0 0 1 5 0] "),
        12: form(TEXT % (1, 1, b"again") + b"1 0 0 1 1000 0 cm /C Do", "/Resources << /XObject << /C 12 0 R >> >> "),
    }
    o = rows(spark, a=build(parts))
    pages = graph.page_tree(o)
    return o, pages, graph.page_contents(o, pages)


def redacted(spark, *rects, **k):
    o, pages, contents = files(spark)
    out = nested.redact(o, pages, contents, spark.createDataFrame([("a", *r) for r in rects], "file string, page_no int, x double, y double, w double, h double"), **k)
    return sorted((r.page_no, list(r.way), r.text) for r in out["removed"].collect()), sorted((r.page_no, list(r.way), r.canvas, r.n) for r in out["copies"].collect())


def test_a_form_is_redacted_only_where_a_rectangle_reaches_it(spark):
    # On the first page the form stands twice as large from (100, 100) on: its text is at (120, 120).
    removed, copies = redacted(spark, (0, 118.0, 119.0, 5.0, 5.0))
    assert removed == [(0, [0], "outer")] and copies == [(0, [0], 10, 1)]
    assert redacted(spark, (1, 118.0, 119.0, 5.0, 5.0)) == ([], [])


def test_forms_within_forms_and_turned(spark):
    # (20, 30) of the inner form is (25, 30) with its own matrix, (30, 25) turned and moved, (80, 75) on the second page.
    removed, copies = redacted(spark, (1, 79.0, 74.0, 2.0, 2.0))
    assert removed == [(1, [0, 0], "inner")]
    assert copies == [(1, [0], 10, 0), (1, [0, 0], 11, 1)]


def test_depth_ends_a_form_that_draws_itself(spark):
    removed, _ = redacted(spark, (0, 0.0, 0.0, 100_000.0, 2.0), depth=4)
    assert [len(way) for _, way, text in removed if text == "again"] == [1, 2, 3, 4]
    removed, _ = redacted(spark, (0, 0.0, 4.0, 10.0, 2.0), depth=2)
    assert removed == [(0, [], "plain")]
