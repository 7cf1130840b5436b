"""Operators that compare rows: n-gram join, line dedup, neighbours; and the pipeline."""

import random
from collections import defaultdict
from itertools import combinations
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import components, edits, line_dedup, ngram_join, nn_descent, quality_rules, scratch
from foliant.llm.scratch import Scratch
from tests.llm.helpers import DOCS, ODD, SF, Sets, distance, docs, low, shingles


def test_components_of_paths_stars_and_rings(spark):
    rnd = random.Random(0)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    edges += [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(70)] + [(500, 500)]
    sets = Sets({x for e in edges for x in e})
    for a, b in edges:
        sets.join(a, b)
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == {x: sets.root(x) for a, b in edges if a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


# n-gram join


@pytest.mark.parametrize("seed", range(3))
def test_divide_skip_counts(seed):
    rnd = random.Random(seed)
    lists = [sorted(rnd.sample(range(60), rnd.choice([1, 3, 10, 50]))) for _ in range(30)]
    needed = [rnd.randrange(1, 20) for _ in range(60)]
    counts = [sum(i in x for x in lists) for i in range(60)]
    assert sorted(ngram_join.divide_skip(lists, needed)) == [i for i in range(60) if counts[i] >= needed[i]]
    assert ngram_join.divide_skip([], [1]) == []


def _groups(texts, threshold=80):
    sets = [shingles(t) for t in texts]
    own = Sets(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        n = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * n >= threshold * len(sets[i] | sets[j]):
            own.join(i, j)
    return [(len(s), own.root(i)) for i, s in enumerate(sets)]


def _near_copies(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rnd.choice([3, 8, 40, 150]))]
        if rnd.random() < 0.4:
            base += passage
        for _ in range(rnd.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(rnd.randrange(4)):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy) if rnd.random() < 0.8 else "  ".join(copy).upper())
    texts += texts[:4]
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_ngram_join_is_exact(spark, seed):
    texts = _near_copies(seed) + ODD[:6]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs(spark, texts)).collect()}
    assert got == dict(enumerate(_groups(texts)))


def test_ngram_join_on_tables(spark):
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.query(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(texts)
    want = _groups([texts[i] for i in ids])
    assert rows == {i: (n, ids[c]) for i, (n, c) in zip(ids, want, strict=True)}


def test_ngram_join_odd_rows(spark):
    assert ngram_join.ngram_join(docs(spark, [])).count() == 0
    rows = [(None, "a b c d e f", "en", "s", 0), (5, "a b c d e f", "en", "s", 0), (5, "a b c d e f", "en", "s", 0), (None, "x y", "en", "s", 0)]
    d = spark.createDataFrame(rows, DOCS).withColumn("component_id", F.lit("mine"))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(d).collect()]
    assert sorted(got, key=repr) == [(5, 2, 5), (5, 2, 5), (None, 1, None), (None, 2, 5)]
    left = ngram_join.stage(spark, spark.createDataFrame(rows, DOCS), SF)
    assert left.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted((r.doc_id for r in left.collect()), key=repr) == [5, 5, None]


# line dedup


def _norm(line):
    return " ".join("".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in low(line)).split())


def test_edit_distance():
    rnd = random.Random(1)
    for _ in range(300):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randrange(60)))
        b = list(a)
        for _ in range(rnd.randrange(6)):
            b.insert(rnd.randrange(len(b) + 1), rnd.choice("abd"))
        b, most = "".join(b), rnd.randrange(8)
        d = distance(a, b)
        got = line_dedup.edit_distance(a, b, most)
        assert got == d if d <= most else got > most


def test_simhash_matches_definition():
    r = np.random.default_rng(3)
    h = r.integers(0, 2**63, 900).astype(np.uint64) * np.uint64(2)
    bounds = np.array([0, 3, 3, 600, 900])
    got = line_dedup.simhashes(h, bounds)
    for i in range(4):
        part = h[bounds[i] : bounds[i + 1]]
        want = sum(1 << b for b in range(64) if 2 * int(((part >> np.uint64(b)) & np.uint64(1)).sum()) > len(part))
        assert int(got[i]) == want


def test_line_dedup(spark):
    long = "this is a rather long line of words that stands in very many documents of the corpus and says nothing new to anybody"
    texts = [
        f"{long}\nunique line number one is here\n\nshort",
        f"Intro words that are only found here\n{long.upper()}!\nshort",
        f"{long.replace('nothing', 'nothings')}\nlast of all lines in here now",
        None,
        "",
        f"{long}",
    ]
    rows = {r.doc_id: r for r in line_dedup.line_dedup(docs(spark, texts).withColumn("removed", F.lit("x"))).collect()}
    assert rows[0].text == texts[0] and rows[0]._n_lines == 4
    assert rows[1].text == "Intro words that are only found here\nshort" and rows[1]._removed == [1]
    assert rows[3].text is None and rows[4].text == "" and rows[5].text == ""
    assert rows[2]._removed in ([0], [])
    stage = line_dedup.stage(spark, docs(spark, texts), SF)
    assert {r.doc_id: r.n_chars for r in stage.collect()}[1] == len(rows[1].text)
    assert 5 not in {r.doc_id for r in stage.collect()}
    assert line_dedup.line_dedup(docs(spark, [])).count() == 0


def test_line_dedup_on_tables(spark):
    """Exact copies go but for the first; what else goes is near to a line that stays."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    gone = {r.doc_id: set(r.removed_lines) for r in line_dedup.query(spark, sf).collect()}
    places = defaultdict(list)
    for i, t in texts.items():
        for k, x in enumerate(t.split("\n")):
            if len(_norm(x).split()) >= line_dedup.MIN_WORDS:
                places[_norm(x)].append((i, k))
            else:
                assert k not in gone[i]
    stays = {n: [p for p in ps if p[1] not in gone[p[0]]] for n, ps in places.items()}
    for n, ps in places.items():
        assert stays[n] in ([], [min(ps)])
    kept = [n for n, ps in stays.items() if ps]
    near = lambda a, b: distance(a, b) <= max(len(a), len(b)) * 20 // 100
    for n in [n for n, ps in stays.items() if not ps][:5]:
        # A chain of near lines leads to one that stays; most are next to it.
        others = [k for k in places if k != n and abs(len(k) - len(n)) <= 0.2 * max(len(k), len(n)) and len(set(k.split()) & set(n.split())) > 3]
        assert any(near(n, k) for k in others)
    assert kept


def _line_pairs(kept, seed):
    """Lines with a copy each, at least ``kept`` of whose edit similarity is left after words were replaced, added or dropped."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(1, 10)))
    out = []
    while len(out) < 200:
        n = rnd.choice([6, 10, 15, 20, 30])
        a = [word() for _ in range(n)]
        b = list(a)
        for _ in range(rnd.randrange(1, max(n // 8, 1) + 1)):
            at = rnd.randrange(len(b))
            b[at : at + 1] = rnd.choice([[word()], [], [b[at], word()]])
        a, b = " ".join(a), " ".join(b)
        if a != b and len(b.split()) >= line_dedup.MIN_WORDS and 100 * distance(a, b) <= (100 - kept) * max(len(a), len(b)):
            out.append((a, b))
    return out


def test_line_dedup_finds_near_copies(spark):
    """Against the edit similarity of all pairs: nearly all copies with changed words are found, and nothing else goes."""
    pairs = _line_pairs(80, 4)
    rows = {r.doc_id: r._removed for r in line_dedup.line_dedup(docs(spark, [x for p in pairs for x in p])).collect()}
    assert all(rows[i] == [] for i in range(0, 400, 2))
    assert sum(rows[i] == [0] for i in range(1, 400, 2)) >= 190


# neighbours


def _exact(vectors, queries, k):
    x = np.array([v for _, v in vectors], dtype=np.float32).astype(float)
    ids = np.array([i for i, _ in vectors])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = x @ x[list(ids).index(q)]
        order = [i for i in np.lexsort((ids, -np.round(s, 12))) if ids[i] != q][:k]
        out[q] = [int(ids[i]) for i in order]
    return out


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want = _exact([(r.vec_id, r.embedding) for r in rows], [r.vec_id for r in rows if r.vec_id % 50 == 0], 5)
    got = defaultdict(dict)
    for r in nn_descent.query(spark, sf).collect():
        got[r.query_id][r["rank"]] = r.vec_id
    assert set(got) == set(want)
    assert np.mean([len(set(got[q].values()) & set(want[q])) / 5 for q in want]) >= 0.95


def test_neighbours_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, []), (None, [1.0, 1.0]), (9, [1.0, 0.1]), (9, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("mine"))
    out = nn_descent.nearest(df, F.col("vec_id") % 3 == 0, 3)
    got = defaultdict(list)
    for r in out.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, round(r.score, 6)))
    assert got[0] == [(1, 1.0), (2, 1.0), (9, round(1 / np.hypot(1, 0.1), 6))]
    assert [v for v, _ in got[3]] == [9, 0, 1] and set(got) == {0, 3, 9}
    assert nn_descent.nearest(df.limit(0), F.lit(True), 3).count() == 0


# pipeline


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "ngram_jaccard_join", "source_mixing", "byte_bpe"]
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns) and out.count() > 0
    d = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.query(spark, SF).filter("kept").collect()}
    assert {r.doc_id for r in out.select("doc_id").collect()} <= kept
    empty = d.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0
        empty = empty if "text" in empty.columns else d.limit(0)


def test_stages_take_odd_rows(spark):
    d = docs(spark, [*ODD, *_near_copies(1)[:20]])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, SF)
        assert out.count() <= 3 * d.count(), name
        if name != "byte_bpe":
            assert out.columns == d.columns


# added checks


@pytest.mark.parametrize("letters", ["ab", "abcdefghijkl ", "abcdäß漢 "])
def test_batched_distance(letters):
    """Whole batches against the scalar distance, for all bounds and lengths."""
    rnd = random.Random(len(letters))
    a, b, most = [], [], []
    for _ in range(400):
        x = [rnd.choice(letters) for _ in range(rnd.randrange(160))]
        y = list(x)
        for _ in range(rnd.randrange(1 + len(x) // 3)):
            at = rnd.randrange(len(y) + 1)
            y[at : at + rnd.randrange(2)] = [rnd.choice(letters)] * rnd.randrange(2)
        a.append("".join(x))
        b.append("".join(y))
        most.append(rnd.randrange(60))
    got = edits.within(a, b, np.array(most))
    assert got.tolist() == [line_dedup.edit_distance(x, y, k) <= k for x, y, k in zip(a, b, most, strict=True)]
    lines = [(" ".join(x.split()), " ".join(y.split())) for x, y in zip(a, b, strict=True)]
    near = line_dedup.near([x for x, _ in lines], [y for _, y in lines], 80)
    assert near.tolist() == [line_dedup.edit_distance(x, y, k) <= k for x, y in lines for k in [max(len(x), len(y)) * 20 // 100]]


def test_line_dedup_recall_on_tables(spark):
    """Of all pairs of lines on the table with the edit similarity that share three words, at least nine tenths are linked."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    gone = {r.doc_id: set(r.removed_lines) for r in line_dedup.query(spark, sf).collect()}
    first = {}
    for i in sorted(texts):
        for k, x in enumerate(texts[i].split("\n")):
            if len(_norm(x).split()) >= line_dedup.MIN_WORDS:
                first.setdefault(_norm(x), (i, k))
    lines = sorted(first, key=len)
    words = [set(x.split()) for x in lines]
    pairs = [(a, b) for b in range(len(lines)) for a in range(b) if len(words[a] & words[b]) >= 3 and 100 * len(lines[a]) >= 80 * len(lines[b])]
    near = line_dedup.near([lines[a] for a, _ in pairs], [lines[b] for _, b in pairs], 80)
    linked = [first[lines[a]][1] in gone[first[lines[a]][0]] or first[lines[b]][1] in gone[first[lines[b]][0]] for (a, b), yes in zip(pairs, near, strict=True) if yes]
    assert len(linked) > 20 and sum(linked) >= 0.9 * len(linked)


def test_hot_keys_and_shared_keys(spark):
    """A key of a third of all rows meets its partners by broadcast; borders of ranges lose no shared key."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 10).alias("key"), "id")
    counted = rows.groupBy("key").agg(F.count("*").alias("_n"), F.min("id").alias("least"))
    got = components.join_counted(rows, counted, "key")
    assert got.count() == 3000 and got.filter("least <> id").count() == 999
    kept = components.shared_keys(rows).filter("key = 7").count()
    assert kept == 1000
    assert components.shared_keys(rows.limit(0)).count() == 0


def test_tested_pairs_are_left_out_by_one_join(spark, monkeypatch):
    """Rows of one key that link to no leader meet each other once, and the pairs of all rounds are left out at once."""
    plans = []
    save = Scratch.save

    def saved(self, df, name, **more):
        if name == "pairs":
            plans.append(df._jdf.queryExecution().analyzed().toString().count("LeftAnti"))
        return save(self, df, name, **more)

    monkeypatch.setattr(Scratch, "save", saved)
    monkeypatch.setattr(components, "OPEN_PAIRS", 0)
    monkeypatch.setattr(components, "FRUITFUL", 1 << 30)
    rows = spark.range(30).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("id"), F.lit(1).alias("chars"))
    link = lambda pairs: pairs.filter("a % 3 = b % 3 AND abs(a - b) <= 3")
    roots = components.link_groups(rows, ["chars"], lambda left, right: F.lit(True), link, Scratch(spark, "test"), star_rounds=3, few_keys=True)
    assert {r.id: r.root for r in roots.collect()} == {i: i % 3 for i in range(30)}
    assert len(plans) > 2 and plans[-1] == 1


def test_narrow_rows_are_not_weighed(spark):
    """Batches of numbers are bounded by rows while they are written; the bound by bytes holds again after it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    seen = []

    scratch = Scratch(spark, "test")
    before = spark.conf.get(name)
    frame = spark.range(3)
    parquet = type(frame.write).parquet
    try:
        type(frame.write).parquet = lambda w, path, **k: (seen.append(spark.conf.get(name)), parquet(w, path, **k))[1]
        assert scratch.save(frame, "numbers", narrow=True).count() == 3 and scratch.save(frame, "texts").count() == 3
    finally:
        type(frame.write).parquet = parquet
    assert seen == [str(2**31 - 1), before] and spark.conf.get(name) == before


def test_workers_hand_memory_back(monkeypatch):
    """All batches pass, and free memory goes back once, also when a task ends early."""
    trims = []
    monkeypatch.setattr(scratch.ctypes, "CDLL", lambda _: SimpleNamespace(malloc_trim=trims.append))
    assert list(scratch.tidy(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3] and trims == [0]
    early = scratch.tidy(lambda batches: batches)(iter([1, 2]))
    assert next(early) == 1
    early.close()
    assert trims == [0, 0] and line_dedup._occurrences.__name__ == "_occurrences"


def test_vectors_of_unlike_lengths_are_refused(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0, 2.0]), (1, [1.0, 0.0, 2.0, 1.0, 1.0])], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError):
        nn_descent.nearest(df, F.col("vec_id") % 2 == 0, 3)
