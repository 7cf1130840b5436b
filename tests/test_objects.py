"""Object rows of small files, and what joins make of them."""

import json
import zlib

import pyarrow as pa
import pytest

from foliant.operators import graph, review
from foliant.sources import objects as O


def build(parts, trailer="<< /Root 1 0 R >>", table=True):
    """A file of objects (number to text or bytes), with a table of their places."""
    out, at = b"%PDF-1.7\n", {}
    for n, body in parts.items():
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + (body if isinstance(body, bytes) else body.encode("latin-1")) + b"\nendobj\n"
    start = len(out)
    if table:
        out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, p) for n, p in at.items())
    return out + f"trailer\n{trailer}\nstartxref\n{start}\n%%EOF\n".encode()


def stream(data, extra=""):
    return f"<< /Length {len(data)} {extra}>>\nstream\n".encode() + data + b"\nendstream"


PAGES = {
    1: "<< /Type /Catalog /Pages 2 0 R >>",
    2: "<< /Type /Pages /Kids [4 0 R 3 0 R 99 0 R] /MediaBox [0 0 200 400] /Rotate 90 /Resources 20 0 R >>",
    3: "<< /Type /Pages /Kids 21 0 R /MediaBox [0 0 300 300] >>",
    4: "<< /Type /Page /Contents 10 0 R >>",
    5: "<< /Type /Page /Contents [11 0 R 12 0 R] /Rotate 0 /Resources << /XObject << /Im 31 0 R >> >> >>",
    6: "<< /Type /Page >>",
    7: "<< /Type /Page /Parent 2 0 R >>",  # no kid of anyone
    10: stream(zlib.compress(b"q 2 0 0 2 10 20 cm q 0 3 -4 0 1 1 cm /Im Do Q /Im Do Q /Im Do Q Q /Form Do /No Do"), "/Filter /FlateDecode "),
    11: stream(b"BT /F1 10 Tf 1 0 0 1 5 "),
    12: stream(b"6 Tm [(He) -50 (llo) -120 (you)] TJ ET\n/Im Do"),
    20: "<< /XObject 22 0 R >>",
    21: "[5 0 R 6 0 R]",
    22: "<< /Im 30 0 R /Form 32 0 R >>",
    30: stream(b"..", "/Subtype /Image /Width 64 /Height 32 "),
    31: stream(b"..", "/Subtype /Image /Width 7 "),
    32: stream(b"..", "/Subtype /Form "),
}


def rows(spark, **files):
    return O.object_rows(spark.createDataFrame([(k, v) for k, v in files.items()], "file string, content binary")).cache()


def test_pages_in_tree_order_with_what_they_inherit(spark):
    o = rows(spark, a=build(PAGES))
    pages = graph.page_tree(o)
    got = [(r.page_no, r.object, r.box, r.rotate, r.resources.object) for r in pages.orderBy("page_no").collect()]
    assert got == [(0, 4, [0, 0, 200, 400], 90, 20), (1, 5, [0, 0, 300, 300], 0, 5), (2, 6, [0, 0, 300, 300], 90, 20)]
    contents = graph.page_contents(o, pages)
    e = graph.page_elements(contents).collect()
    assert [(r.page_no, r.text, r.x, r.y) for r in e] == [(1, "Hello you", 5.0, 6.0)]
    sections = {r.page_no: r.text for r in graph.page_sections(pages, graph.page_elements(contents)).collect()}
    assert sections == {0: "", 1: "Hello you", 2: ""}


def test_images_under_nested_transforms(spark):
    o = rows(spark, a=build(PAGES))
    pages = graph.page_tree(o)
    got = graph.image_inventory(o, pages, graph.page_contents(o, pages)).orderBy("page_no", "seq").collect()
    assert [(r.page_no, r.x, r.y, r.w, r.h, round(r.rotation, 9), r.width_px, r.height_px) for r in got] == [
        (0, 12.0, 22.0, 6.0, 8.0, 90.0, 64, 32), (0, 10.0, 20.0, 2.0, 2.0, 0.0, 64, 32), (0, 0.0, 0.0, 1.0, 1.0, 0.0, 64, 32), (1, 0.0, 0.0, 1.0, 1.0, 0.0, 7, 0),
    ]


def test_deep_trees_cycles_and_lost_trailers(spark):
    n = 300
    deep = {1: "<< /Type /Catalog /Pages 2 0 R >>"} | {i: f"<< /Type /Pages /Kids [{i + 1} 0 R] >>" for i in range(2, n)} | {n: "<< /Type /Page >>"}
    deep[2] = "<< /Type /Pages /Kids [3 0 R] /MediaBox [0 0 1 2] >>"
    ring = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [6 0 R] >>", 3: "<< /Type /Pages /Kids [4 0 R] >>", 4: "<< /Type /Pages /Kids [3 0 R 5 0 R] >>", 5: "<< /Type /Page >>", 6: "<< /Type /Page >>"}
    o = rows(spark, deep=build(deep), ring=build(ring), bare=build(PAGES, trailer="", table=False), none=b"no file at all", null=None)
    got = {}
    for r in graph.page_tree(o).collect():
        got.setdefault(r.file, []).append((r.page_no, r.object, r.box[3]))
    assert got["deep"] == [(0, n, 2.0)] and got["ring"] == [(0, 6, 792.0)] and len(got["bare"]) == 3 and set(got) == {"deep", "ring", "bare"}


def test_status_of_whole_and_broken_files(spark):
    whole = build(PAGES)
    moved = whole.replace(b"%PDF-1.7\n", b"%PDF-1.7\n% more\n")
    o = rows(spark, whole=whole, moved=moved, bare=build(PAGES, table=False), none=b"%PDF-1.4 nothing", null=None)
    assert {r.file: (r.status, r.n_objects) for r in O.load_status(o).collect()} == {"whole": ("ok", 16), "moved": ("repaired", 16), "bare": ("repaired", 16), "none": ("error", 0), "null": ("error", 0)}
    values = lambda f: sorted(str(tuple(r)) for r in o.filter(f"file = '{f}' AND kind <> 'xref'").drop("file", "at").collect())
    assert values("whole") == values("moved") == values("bare")


@pytest.mark.parametrize("size", [7, 50, 100_000])
def test_marks_over_the_edges_of_blocks(spark, size):
    data = build(PAGES)
    blocks = [("a", i, data[at : at + size]) for i, at in enumerate(range(0, len(data), size))]
    got = {r.object: r["at"] for r in O.object_marks(spark.createDataFrame(blocks, "file string, block int, data binary")).collect()}
    assert got == {n: data.index(b"\n%d 0 obj" % n) + 1 for n in PAGES}


def test_objects_in_streams_strings_and_later_versions(spark):
    first, second = b"<< /A (x\\(y\\)\\101) /B 1>> ", b"[ true null <4869> -.5 ]"
    inner = b"41 0 42 %d " % len(first) + first + second
    packed = {40: stream(zlib.compress(inner), "/Type /ObjStm /N 2 /First 11 /Filter /FlateDecode "), 1: "<< /Type /Catalog /V (old) >>"}
    data = build(packed) + build({1: "<< /Type /Catalog /V (new\\)) /K#20 5 /D << /E [] /F << >> >> >>"})
    o = rows(spark, a=data)
    got = {(r.object, tuple(r.path)): (r.kind, r.value) for r in o.filter("kind <> 'xref' AND object > 0").collect()}
    assert got[41, ("A",)] == ("string", "x(y)A") and got[42, ("2",)] == ("string", "Hi") and got[42, ("3",)] == ("number", "-.5") and got[42, ("0",)] == ("word", "true")
    assert got[1, ("V",)] == ("string", "new)") and got[1, ("D", "E")] == ("array", None)
    made = json.loads(graph.structure_json(o).first()["json"])["objects"]
    assert made["obj:1 0 R"]["value"] == {"/Type": "/Catalog", "/V": "u:new)", "/K#20": 5, "/D": {"/E": [], "/F": {}}}
    assert made["obj:42 0 R"]["value"][:3] == [True, None, "u:Hi"] and "dict" in made["obj:40 0 R"]["stream"] and made["trailer"]["value"] == {"/Root": "1 0 R"}


def test_annotations_and_their_answers(spark):
    note = lambda i, more="": f"<< /Subtype /Text /NM (n{i}) /T (who{i}) /Contents (says {i}) /Rect [10 20 30 50] {more}>>"
    parts = {
        1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [3 0 R 4 0 R] /MediaBox [0 0 100 100] >>",
        3: "<< /Type /Page /Annots [10 0 R 11 0 R 98 0 R] >>", 4: "<< /Type /Page /Annots 5 0 R >>", 5: "[12 0 R 13 0 R]",
        10: note(10, "/IRT 11 0 R "), 11: note(11).replace("/Text", "/Highlight"), 12: note(12, "/IRT 11 0 R /State (Accepted) "), 13: note(13, "/IRT 97 0 R ").replace("[10 20 30 50]", "[1 2 3]"),
    }
    o = rows(spark, a=build(parts))
    got = {r.id: r for r in graph.annotation_scan(o, graph.page_tree(o)).collect()}
    assert set(got) == {"n10", "n11", "n12", "n13"}
    assert (got["n11"].mode, got["n11"].replies, got["n11"].parent_id, got["n11"].y, got["n11"].h) == ("Highlight", ["n10", "n12"], None, 50.0, 30.0)
    assert (got["n10"].parent_id, got["n12"].parent_id, got["n12"].page_no, got["n12"].state) == ("n11", "n11", 1, "Accepted")
    assert (got["n13"].parent_id, got["n13"].w, got["n13"].author) == (None, 0.0, "who13")
    shown = review.threads(graph.annotation_scan(o, graph.page_tree(o)).drop("replies"))
    assert {r.id: r.shown_parent for r in shown.collect()} == {"n10": "n11", "n11": None, "n12": "n11", "n13": None}


def test_small_files_share_a_batch_and_large_ones_have_several():
    keys = [pa.array(range(5000), pa.int64())]
    one = list(O.gathered(keys, ([(i, b"x")] for i in range(5000)), ["file", "i", "data"], [pa.int32(), pa.binary()]))
    assert [b.num_rows for b in one] == [5000] and one[0].column(0).to_pylist() == one[0].column(1).to_pylist()
    many = list(O.gathered([pa.array([7])], [[(i, None) for i in range(20_000)]], ["file", "i", "data"], [pa.int32(), pa.binary()]))
    assert len(many) == 3 and sum(b.num_rows for b in many) == 20_000
    assert list(O.gathered(keys, ([] for _ in range(5000)), ["file", "i", "data"], [pa.int32(), pa.binary()])) == []


def test_status_parses_files_once(spark):
    files = spark.createDataFrame([("a", b"%PDF-1.5\n1 0 obj\n[1]\nendobj\n")], "file string, content binary")
    plan = O.load_status(O.object_rows(files))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    # A table that names an object twice does not count it twice.
    rows = [("b", 1, 9, [], "dict", None, None, None), ("b", 1, 9, [], "xref", None, None, None), ("b", 1, 9, [], "xref", None, None, None)]
    twice = spark.createDataFrame(rows, f"file string, {O.FIELDS}")
    assert O.load_status(twice).collect()[0][:] == ("b", "ok", 1)
