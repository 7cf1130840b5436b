"""Words of two engines merged by packed pages."""

import random

import pytest

from foliant.operators import layout, ocr, rover
from tests.test_layout import _W, _merged_one_by_one


def _page(rng, n):
    """Words in places and heights that meet often, some without a size."""
    word = lambda e, i: (e, i, f"{e}{i}", rng.randrange(30) * rng.choice([5.0, 40.0]), rng.randrange(4) * 6.0, rng.choice([30.0, 50.0, 0.0, 300.0]), rng.choice([12.0, 12.0, 9.0, 60.0]), rng.randrange(100))
    return [word(e, i) for e in "AB" for i in range(rng.randrange(n + 1))]


@pytest.mark.parametrize(("words", "pairs"), [(1, 3), (1 << 16, 1 << 20)])
def test_packed_pages_are_merged_as_word_by_word(spark, monkeypatch, words, pairs):
    # Workers take the limits of their module; small ones are tried in this process.
    rng = random.Random(words)
    pages = {p: _page(rng, rng.choice([1, 5, 40])) for p in range(60)}
    rows = [(1, p, *r) for p, own in pages.items() for r in own]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, _W)
    monkeypatch.setattr(rover, "WORDS", words)
    monkeypatch.setattr(rover, "PAIRS", pairs)
    monkeypatch.setattr(layout, "cut", None)  # nothing is written down on the way
    packed = [b for part in rover.pack(rover.tagged(df, "A", "B").toArrow().to_batches(max_chunksize=50)) for b in part.to_pylist()]
    packed.sort(key=lambda r: (r["doc_id"], r["page_no"]))
    merge = rover._merge(("A", "B"), 0.5, None)
    schema = rover.pa.schema([("doc_id", rover.pa.int64()), ("page_no", rover.pa.int32()), ("data", rover.pa.binary())])
    here = [r for b in merge(iter([rover.pa.RecordBatch.from_pylist(packed, schema)])) for r in b.to_pylist()]
    there = [r.asDict() for r in layout.rover_merge(df, "A", "B").orderBy("page_no", "seq").collect()]
    want = [(p, i, *r) for p, own in pages.items() for i, r in enumerate(_merged_one_by_one(own))]
    for got in (here, there):
        assert [(r["page_no"], r["seq"], r["text"], r["source_engine"]) for r in got] == want


def test_packed_words_are_small(spark):
    rows = [(d, 0, e, i, f"word{i % 90}", i % 12 * 50.0, i // 12 * 20.0, 40.0, 12.0, (i * 13 + d) % 101) for d in range(20) for e in "AB" for i in range(400)]
    batches = rover.tagged(spark.createDataFrame(rows, _W), "A", "B").toArrow().to_batches(max_chunksize=10_000)
    size = sum(len(x) for b in rover.pack(batches) for x in b.column("data").to_pylist())
    assert size < 6 * len(rows)


def test_missing_values_and_equal_seqs(spark):
    rows = [
        (1, 0, "A", None, None, None, 0.0, 50.0, 20.0, None), (1, 0, "B", 0, "b", 0.0, 0.0, 50.0, 20.0, 9), (1, 0, "A", 7, "ü", 0.0, 0.0, 50.0, 20.0, None), (1, 0, "A", 7, "a", 0.0, 0.0, 50.0, 20.0, 3),
        (None, 0, "A", 1, "n", 0.0, 0.0, 50.0, 20.0, 1), (None, 0, "B", 1, "N", 0.0, 0.0, 50.0, 20.0, 5), (1, 0, "C", 1, "other", 0.0, 0.0, 50.0, 20.0, 5),
    ]
    got = layout.rover_merge(spark.createDataFrame(rows, _W), "A", "B").collect()
    assert sorted([(r.doc_id or 0, r.seq, r.text, r.source_engine) for r in got], key=lambda r: r[:2]) == [(0, 0, "n", "A"), (0, 1, "N", "B"), (1, 0, None, "A"), (1, 1, "b", "ROVER"), (1, 2, "ü", "A")]


def test_a_weak_page_is_merged_and_a_sure_one_keeps_its_words(spark, monkeypatch):
    words = spark.createDataFrame([(d, 0, "A", 5, "s", 0.0, 0.0, 5.0, 2.0, c, None) for d, c in ((1, 90), (2, 60), (4, None))], _W + ", error string")
    second = spark.createDataFrame([(d, 0, "B", 6, "t", 0.0, 0.0, 5.0, 2.0, 95, None) for d in (1, 2, 3, 4)], _W + ", error string")
    monkeypatch.setattr(layout, "cut", None)
    got = ocr.combined(words, second, "ConfidenceWeighted", ("A", "B"))
    assert sorted((r.doc_id, r.seq, r.text, r.source_engine) for r in got.collect()) == [(1, 5, "s", "A"), (2, 0, "t", "ROVER"), (4, 5, "s", "A")]
