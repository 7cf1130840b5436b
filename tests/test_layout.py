import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.functions import geometry
from foliant.operators import diff, documents, layout

_R = "doc_id long, page_no int, detector int, seq int, type string, x double, y double, w double, h double, confidence double"
_W = "doc_id long, page_no int, engine string, seq int, text string, x double, y double, w double, h double, confidence int"


@pytest.mark.parametrize(("a", "b", "want"), [((0, 0, 10, 10), (20, 20, 10, 10), 0), ((0, 0, 10, 10), (0, 0, 10, 10), 1), ((0, 0, 10, 10), (5, 0, 10, 10), 50 / 150), ((0, 0, 0, 0), (0, 0, 10, 10), 0)])
def test_iou(spark, a, b, want):
    box = lambda t: geometry.box(*[F.lit(float(v)) for v in t])
    got = spark.range(1).select(geometry.iou(box(a), box(b)).alias("v")).first().v
    assert got == pytest.approx(want)


def _ensemble(spark, rows):
    df = spark.createDataFrame([(1, 0, *r) for r in rows], _R)
    return layout.reading_order(layout.vote(layout.ensemble_groups(df)), "group_id").orderBy("reading_order").collect()


def test_ensemble(spark):
    box = (0.0, 0.0, 100.0, 50.0)
    agree = _ensemble(spark, [(0, 0, "Table", *box, 0.9), (1, 0, "Table", *box, 0.85)])
    assert [r.type for r in agree] == ["Table"] and agree[0].confidence == pytest.approx(0.875)
    far = (0.0, 200.0, 100.0, 50.0)
    assert len(_ensemble(spark, [(0, 0, "Title", *box, 0.9), (1, 0, "Paragraph", *far, 0.8)])) == 2
    assert [r.type for r in _ensemble(spark, [(0, 0, "Title", *box, 0.9), (1, 0, "Other", *far, 0.1)])] == ["Title"]
    assert [r.type for r in _ensemble(spark, [(0, 0, "Table", *box, 0.95), (1, 0, "Figure", *box, 0.6)])] == ["Table"]
    # Ties go to the earlier type.
    assert [r.type for r in _ensemble(spark, [(0, 0, "Figure", *box, 0.6), (1, 0, "Table", *box, 0.6)])] == ["Table"]


def test_one_detector_keeps_all_in_order(spark):
    rows = [(0, i, "Paragraph", 0.0, float(y), 10.0, 10.0, 0.1) for i, y in enumerate((300, 100, 200))]
    assert [r.y for r in _ensemble(spark, rows)] == [100.0, 200.0, 300.0]


def _rover(spark, rows):
    df = spark.createDataFrame([(1, 0, *r) for r in rows], _W)
    return [(r.text, r.source_engine) for r in layout.rover_merge(df, "A", "B").orderBy("seq").collect()]


def test_rover(spark):
    assert _rover(spark, [("A", 0, "one", 0.0, 0.0, 50.0, 20.0, 60)]) == [("one", "A")]
    assert _rover(spark, [("A", 0, "low", 0.0, 0.0, 50.0, 20.0, 60), ("B", 0, "high", 2.0, 0.0, 50.0, 20.0, 90)]) == [("high", "ROVER")]
    assert _rover(spark, [("A", 0, "same", 0.0, 0.0, 50.0, 20.0, 90), ("B", 0, "other", 2.0, 0.0, 50.0, 20.0, 90)]) == [("same", "ROVER")]
    assert _rover(spark, [("A", 0, "alpha", 0.0, 0.0, 50.0, 20.0, 60), ("B", 0, "beta", 200.0, 0.0, 50.0, 20.0, 90)]) == [("alpha", "A"), ("beta", "B")]
    # A partner is taken once, by the first word that wants it.
    two = [("A", 0, "p", 0.0, 0.0, 50.0, 20.0, 60), ("A", 1, "q", 1.0, 0.0, 50.0, 20.0, 60), ("B", 0, "r", 0.0, 0.0, 50.0, 20.0, 10)]
    assert _rover(spark, two) == [("p", "ROVER"), ("q", "A")]


def _merged_one_by_one(rows):
    """Rows of one page merged in plain Python, word by word."""
    a, b = ([r for r in rows if r[0] == e] for e in "AB")

    def iou(p, q):
        w, h = (min(p[k] + p[k + 2], q[k] + q[k + 2]) - max(p[k], q[k]) for k in (3, 4))
        return w * h / (p[5] * p[6] + q[5] * q[6] - w * h) if w > 0 and h > 0 else 0.0

    free, out = list(range(len(b))), []
    for p in a:
        best = max(free, key=lambda j: (iou(p, b[j]), -j), default=None)
        if best is None or iou(p, b[best]) < 0.5:
            out.append((p[2], "A"))
            continue
        free.remove(best)
        out.append((b[best][2] if b[best][7] > p[7] else p[2], "ROVER"))
    return out + [(b[j][2], "B") for j in free]


def test_rover_chains_as_one_by_one(spark):
    import random

    rnd, pages = random.Random(5), {}
    for page in range(60):
        # Boxes of one size at few places: chains of words that want what an earlier one takes.
        pages[page] = [(e, i, f"{e}{i}", float(rnd.randrange(0, 40)), float(rnd.randrange(0, 3)), 50.0, 20.0, rnd.randrange(100)) for e in "AB" for i in range(rnd.randrange(0, 16))]
    pages[60] = [("A", i, f"A{i}", float(i), 0.0, 50.0, 20.0, 50) for i in range(30)] + [("B", i, f"B{i}", i + 0.5, 0.0, 50.0, 20.0, 60) for i in range(30)]
    df = spark.createDataFrame([(1, page, *r) for page, rows in pages.items() for r in rows], _W)
    got = {page: [] for page in pages}
    for r in layout.rover_merge(df, "A", "B").orderBy("page_no", "seq").collect():
        got[r.page_no].append((r.text, r.source_engine))
    assert got == {page: _merged_one_by_one(rows) for page, rows in pages.items()}
    assert layout.rover_merge(df.limit(0), "A", "B").count() == 0


def test_document_tree(spark):
    words = spark.createDataFrame([(1, 0, 0, "Hello", 10.0, 5.0, 40.0, 12.0, 85), (1, 0, 1, "*World*", 60.0, 5.0, 40.0, 12.0, 85)], "doc_id long, page_no int, seq int, text string, x double, y double, w double, h double, confidence int")
    region = lambda kind: spark.createDataFrame([(1, 0, 0, kind, 0.0, 0.0, 200.0, 20.0)], "doc_id long, page_no int, region_id int, type string, x double, y double, w double, h double")
    text = lambda kind: documents.to_djot(documents.from_layout(words, region(kind))).first().djot
    assert text("Paragraph") == "Hello \\*World\\*\n\n"
    assert text("Title") == "## Hello \\*World\\*\n\n"
    assert text("List") == "- Hello \\*World\\*\n\n"
    assert text("Figure") == "::: figure\nHello \\*World\\*\n:::\n\n"
    assert text("Table").startswith("| Hello \\*World\\* |\n|---|\n")


def _replayed(a, b, script):
    kept_or_new = [t for op, t, _, _ in script if op != "delete"]
    old = [t for op, t, _, _ in script if op != "insert"]
    return kept_or_new == b and old == a


_WORDS = st.lists(st.sampled_from("abc"), max_size=25)


def _as_tuples(pairs):
    return [[tuple(s.values()) for s in script] for script in diff._scripts(pairs).to_pylist()]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(_WORDS, _WORDS), min_size=1, max_size=12))
def test_scripts_together_as_one_by_one(pairs):
    assert _as_tuples(pairs) == [diff.edit_script(a, b) for a, b in pairs]


def test_scripts_beyond_the_rounds_kept(monkeypatch):
    pairs = [(list("abcabba" * 9), list("cbabac" * 9)), ([], []), (["a"], []), ([], ["b", "c"])]
    want = [diff.edit_script(a, b) for a, b in pairs]
    monkeypatch.setattr(diff, "_HISTORY", 50)
    assert diff.edits_together(pairs)[0] is None and _as_tuples(pairs) == want
    monkeypatch.setattr(diff, "_TOKENS", 5)
    assert list(diff._groups(pairs)) == [(0, 1), (1, 4)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=25), st.lists(st.sampled_from("abc"), max_size=25))
def test_edit_script_replays_and_is_shortest(a, b):
    script = diff.edit_script(a, b)
    assert _replayed(a, b, script)
    lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            lcs[i + 1][j + 1] = lcs[i][j] + 1 if x == y else max(lcs[i][j + 1], lcs[i + 1][j])
    assert sum(op == "keep" for op, *_ in script) == lcs[-1][-1]


def test_known_script():
    s = diff.edit_script(list("ABCABBA"), list("CBABAC"))
    assert sum(o != "delete" for o, *_ in s) == 6 and sum(o != "insert" for o, *_ in s) == 7
    assert diff.edit_script(["a"] * 10, ["b"] * 10, limit=3) is None


def test_moves(spark):
    pairs = spark.createDataFrame([(1, "fox the quick", "the quick fox"), (2, "same", "same")], "pair long, text_a string, text_b string")
    script = diff.edit_scripts(pairs, ["pair"])
    assert [(r.token, r["from"], r["to"]) for r in diff.moves(script, ["pair"]).collect()] == [("fox", 0, 2)]
    assert diff.residual(script, ["pair"]).count() == 0
    s = diff.summary(script, ["pair"]).collect()
    assert [(r.pair, r.added, r.removed, r.moved) for r in s] == [(1, 0, 0, 1)]


def test_long_scripts_are_of_words_too(spark):
    a = [f"a{i}" for i in range(450)]
    b = [w + "x" if i % 2 else w for i, w in enumerate(a)]
    pairs = spark.createDataFrame([(1, " ".join(a), " ".join(b))], "pair long, text_a string, text_b string")
    rows = sorted(diff.edit_scripts(pairs, ["pair"]).collect(), key=lambda r: r.pos)
    assert [r.token for r in rows if r.op != "insert"] == a and [r.token for r in rows if r.op != "delete"] == b
    assert diff.summary(diff.edit_scripts(pairs, ["pair"]), ["pair"]).first().added == 225


def test_replay_gives_the_summary_s_growth_without_writing_steps_down(spark):
    pairs = spark.createDataFrame([(1, "a b c d e f", "d e f a b c x x"), (2, "p q", "q"), (3, None, "n e w")], "pair long, text_a string, text_b string")
    script = diff.edit_scripts(pairs, ["pair"])
    rows = {r.pair: (r.old, r.new, r.growth) for r in diff.replayed(script, ["pair"]).collect()}
    assert rows == {1: ("a b c d e f", "d e f a b c x x", 2), 2: ("p q", "q", -1), 3: ("", "n e w", 3)}
    assert {r.pair: r.added - r.removed for r in diff.summary(script, ["pair"]).collect()} == {p: g for p, (_, _, g) in rows.items()}


def test_candidates_of_words_inside_a_cell_are_settled_there(spark):
    """Boxes on and off the borders of cells against all pairs; one window lies where the pairs are made, and the second words are shuffled once."""
    rnd = random.Random(3)
    word = lambda seq: (1, 0, seq, float(rnd.randrange(0, 900)), float(rnd.randrange(0, 500)), float(rnd.choice([0, 30, 50, 200, 430])), float(rnd.choice([12, 100, 300])))
    first, second = [word(i) for i in range(60)] + [(1, 0, 60, 0.0, 0.0, 200.0, 12.0)], [word(i) for i in range(60)] + [(1, 0, 60, 200.0, 0.0, 10.0, 12.0)]
    kinds = "doc_id long, page_no int, seq long, x double, y double, w double, h double"

    def iou(a, b):
        w, h = (min(a[i] + a[i + 2], b[i] + b[i + 2]) - max(a[i], b[i]) for i in (3, 4))
        return w * h / (a[5] * a[6] + b[5] * b[6] - w * h) if w > 0 and h > 0 else 0.0

    want = {}
    for a in first:
        best = max(second, key=lambda b: (iou(a, b), -b[2]))
        if iou(a, best) > 0:
            want[a[2]] = best[2]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = layout.best_candidates(spark.createDataFrame(first, kinds), spark.createDataFrame(second, kinds))
        assert {r.p_seq: r.s_seq for r in out.collect()} == want and len(want) > 30
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    final = plan.split("Initial Plan")[0]
    assert "ReusedExchange" in final
    assert sum("Exchange hashpartitioning" in line and "_gx" not in line for line in final.split("\n")) == 1
