"""Plans that read their input once, and their results against the plain rules."""

import math
import os
import random

import pytest

from foliant.operators import diff, documents, layout, redaction, review


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _nodes_by_rule(words, regions):
    """Nodes from rows in Python, block by block."""
    out = []
    centre = lambda b: (b["y"] + b["h"] * 0.5, b["x"] + b["w"] * 0.5)
    for page in {(r["doc_id"], r["page_no"]) for r in regions}:
        on = lambda rows: [r for r in rows if (r["doc_id"], r["page_no"]) == page]
        band, last, order = 0, None, []
        for r in sorted(on(regions), key=lambda r: (centre(r)[0], r["region_id"])):
            band += last is not None and centre(r)[0] - last > 20
            last = centre(r)[0]
            order.append((band, centre(r)[1], r["region_id"], r))
        for block, (*_, r) in enumerate(sorted(order, key=lambda o: o[:3])):
            kind = layout.BLOCKS[r["type"]][0]
            held = [w for w in on(words) if r["x"] <= w["x"] + w["w"] / 2 <= r["x"] + r["w"] and r["y"] <= w["y"] + w["h"] / 2 <= r["y"] + r["h"]]
            held.sort(key=lambda w: (w["y"], w["x"], w["seq"]))
            line, lines = 0, []
            for i, w in enumerate(held):
                line += i > 0 and w["y"] - held[i - 1]["y"] > max(w["h"], held[i - 1]["h"]) * 0.5
                lines.append((line, w["x"], w["seq"], w))
            held = [w for *_, w in sorted(lines, key=lambda o: o[:3])]
            bands = layout.first_band([w["y"] for w in held], [w["h"] for w in held]) if kind in ("List", "Table") else [0] * len(held)
            for b in sorted(set(bands)) or [0]:
                row = [w for w, at in zip(held, bands, strict=True) if at == b]
                cells = [row]
                if kind == "Table" and row:
                    row.sort(key=lambda w: (w["x"], w["seq"]))
                    mean, cells = sum(w["w"] for w in row) / len(row), [[row[0]]]
                    for left, w in zip(row, row[1:], strict=False):
                        if w["x"] - (left["x"] + left["w"]) > mean * 0.8:
                            cells.append([])
                        cells[-1].append(w)
                out += [(*page, block, b, c, kind, " ".join(w["text"] for w in ws if w["text"] is not None)) for c, ws in enumerate(cells)]
    return sorted(out)


@pytest.mark.parametrize("rows_a_batch", ["3", "10000"])
def test_nodes_by_the_plain_rules_however_batches_are_cut(spark, rows_a_batch):
    rng = random.Random(5)
    words = [
        {"doc_id": d, "page_no": p, "seq": (1 << 55) + i, "text": rng.choice(["a", "bb", "", None, "ccc"]), "x": rng.randrange(60) * 10.0, "y": rng.randrange(80) * 5.0, "w": rng.randrange(1, 6) * 8.0, "h": rng.choice([8.0, 12.0, 30.0])}
        for d in range(3) for p in range(3) for i in range(rng.choice([0, 7, 40]))
    ]
    regions = [{"doc_id": d, "page_no": p, "region_id": i, "type": rng.choice(["Title", "Table", "List", "Footer"]), "x": i % 2 * 300.0, "y": i // 2 * 180.0, "w": 310.0, "h": 200.0} for d in range(3) for p in range(3) for i in range(4)]
    regions.append({"doc_id": 7, "page_no": 0, "region_id": 0, "type": "Table", "x": 0.0, "y": 0.0, "w": 5.0, "h": 5.0})
    w = spark.createDataFrame(words, "doc_id long, page_no int, seq long, text string, x double, y double, w double, h double")
    r = spark.createDataFrame(regions, "doc_id long, page_no int, region_id int, type string, x double, y double, w double, h double")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows_a_batch)
    try:
        got = documents.from_layout(w, r).collect()
    finally:
        spark.conf.set(key, before)
    assert sorted(tuple(row[c] for c in documents.NODE) for row in got) == _nodes_by_rule(words, regions)


def test_words_of_a_layout_are_read_once(spark, tmp_path):
    word = "doc_id long, page_no int, seq long, text string, x double, y double, w double, h double"
    spark.createDataFrame([(1, 0, 0, "a", 1.0, 1.0, 5.0, 5.0)], word).write.parquet(os.path.join(tmp_path, "words"))
    r = spark.createDataFrame([(1, 0, 0, "List", 0.0, 0.0, 9.0, 9.0)], "doc_id long, page_no int, region_id int, type string, x double, y double, w double, h double")
    plan = _plan(documents.from_layout(spark.read.parquet(os.path.join(tmp_path, "words")), r))
    assert plan.count("FileScan parquet") == 1 and "InPandas" not in plan
    # All groupings of a document's nodes under one exchange.
    nodes = spark.createDataFrame([(1, 0, 0, 0, 0, "List", "a")], "doc_id long, page_no int, block int, row_no int, cell_no int, kind string, text string")
    assert _plan(documents.to_djot(nodes)).count("Exchange") == 1


def test_scripts_by_bits_are_those_by_rounds(monkeypatch):
    rng = random.Random(3)
    for turn in range(900):
        # Whole tables, tables in strides, and places of rare tokens made each time.
        monkeypatch.setattr(diff, "_HISTORY", 0 if turn % 3 == 1 else 1 << 26)
        monkeypatch.setattr(diff, "_SHORT", 0 if turn % 3 == 2 else 1 << 14)
        monkeypatch.setattr(diff, "_RARE", 1)
        a, b = ([str(rng.randrange(1 + turn % 5)) for _ in range(rng.randrange(13))] for _ in range(2))
        want = [(op == "insert", x, y) for op, x, y in diff._starts(diff.edit_script(a, b)) if op != "keep"]
        assert diff.edits_by_bits(a, b) == want[::-1]


def test_summary_reads_the_script_once_and_counts_what_moves_leave(spark):
    rng = random.Random(4)
    rows = []
    for pair in range(6):
        for i in range(60):
            op = rng.choice(["keep", "insert", "delete"]) if pair else "keep"
            rows.append((pair or None, i, op, rng.choice(["a", "b", "c", None]), None if op == "insert" else i, None if op == "delete" else i + rng.randrange(2)))
    script = spark.createDataFrame(rows, "pair int, pos int, op string, token string, a int, b int")
    got = diff.summary(script, ["pair"])
    assert _plan(got).count("LocalTableScan") + _plan(got).count("Scan ExistingRDD") == 1
    rest, moved = diff.residual(script, ["pair"]).collect(), diff.moves(script, ["pair"]).collect()
    n = lambda kind, pair: sum(r.pair == pair and (kind == "moved" or r.op == kind) for r in (moved if kind == "moved" else rest))
    assert {r.pair: (r.added, r.removed, r.moved) for r in got.collect()} == {p: (n("insert", p), n("delete", p), n("moved", p)) for p in (None, 1, 2, 3, 4, 5)}


def test_hit_test_tests_each_place_once(spark):
    rng = random.Random(6)
    sizes = [0.0, 1.0, 3.0, 40.0, 1000.0]
    notes = [(1, i, rng.randrange(40) * 1.0, rng.randrange(40) * 1.0, rng.choice(sizes), rng.choice([*sizes, -2.0]), rng.choice([None, [], [(rng.randrange(60) * 1.0, rng.randrange(60) * 1.0)] * 2])) for i in range(60)]
    spots = [(1, i, rng.randrange(-5, 70) * 1.0, rng.randrange(-5, 70) * 1.0) for i in range(80)]
    a = spark.createDataFrame(notes, "page int, idx int, x double, y double, w double, h double, vertices array<struct<x: double, y: double>>")
    p = spark.createDataFrame(spots, "page int, point_id int, px double, py double")
    want = {}
    for _, point, px, py in spots:
        hits = [i for _, i, x, y, w, h, vs in notes if (x <= px <= x + w and y <= py <= y + h) or any(math.hypot(vx - px, vy - py) < 10 for vx, vy in vs or [])]
        if hits:
            want[point] = max(hits)
    assert {r.point_id: r.idx for r in review.hit_test(a, p, ["page"]).collect()} == want
    # A thousand notes in one place for a thousand points in another: one pair, not a million.
    n = spark.range(1000).selectExpr("1 AS page", "id AS idx", "0D AS x", "0D AS y", "9D AS w", "9D AS h", "array(struct(0D AS x, 0D AS y)) AS vertices")
    out = review.hit_test(n, spark.range(1000).selectExpr("1 AS page", "id AS point_id", "5D AS px", "5D AS py"), ["page"])
    assert out.count() == 1000 and out.agg({"idx": "min"}).first()[0] == 999
    assert "_gx" in _plan(review.hit_test(a, p, ["page"]))


def test_words_are_not_sorted_for_the_rectangles_of_their_page(spark):
    e = spark.createDataFrame([(1, 0, 5.0, 5.0, 2.0, 2.0), (1, 1, 50.0, 5.0, 2.0, 2.0)], "doc_id long, page_no int, x double, y double, w double, h double")
    r = spark.createDataFrame([(1, 0, 0.0, 0.0, 9.0, 9.0)], e.schema)
    kept = redaction.untouched(e, r, redaction.baseline_inside("e", "r"))
    assert "ShuffledHashJoin" in _plan(kept) and "Sort" not in _plan(kept)
    assert [row.page_no for row in kept.collect()] == [1]


def test_merge_is_the_same_over_more_partitions(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(1, p, e, i, f"{e}{i}", rng.randrange(12) * 20.0, rng.randrange(2) * 20.0, 30.0, 12.0, rng.randrange(100)) for p in range(2) for e in ("A", "B") for i in range(12)]
    words = spark.createDataFrame(rows, "doc_id long, page_no int, engine string, seq int, text string, x double, y double, w double, h double, confidence int")
    want = sorted(tuple(r) for r in layout.rover_merge(words, "A", "B").collect())
    monkeypatch.setattr(layout, "TASK_ROWS", 5)
    merged = layout.rover_merge(words, "A", "B")
    assert layout.parts_for(words) == 10 and "REPARTITION_BY_NUM" in _plan(merged)
    assert sorted(tuple(r) for r in merged.collect()) == want
