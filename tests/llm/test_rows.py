"""Operators that work row by row: quality rules, licences, mixing, BPE, URLs, classifier, token counts."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliant.llm import byte_bpe, license_scans, mixing, quality_classifier, quality_rules, registry, token_counts, url_filters
from foliant.llm import text as X
from tests.llm.helpers import DOCS, ODD, SF, WORD, docs, low
from tests.parity import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(registry.ORACLES) & set(registry.QUERIES)))
def test_sql(spark, con, name):
    compare(registry.QUERIES[name](spark, SF), registry.ORACLES[name], con)


def _all_texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# quality rules


def _base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    tri = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    texts = _all_texts(spark)
    m = {r.doc_id: tuple(r[k] for k in quality_rules.COUNTS) for r in quality_rules.measured(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert m == {i: _base(t) for i, t in texts}
    odd = quality_rules.query.__globals__["judged"](quality_rules.measured(docs(spark, ODD)), quality_rules.fit(np.zeros((0, 8)), np.zeros(0)))
    for r in odd.collect():
        base = _base(ODD[r.doc_id])
        assert tuple(r[k] for k in quality_rules.COUNTS) == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert not (r.base_failed and r.kept)


def test_quality_finds_poor_documents(spark):
    kept = {r.doc_id: (r.kept, r.base_failed) for r in quality_rules.query(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    poor = [kept[r.doc_id][0] for r in labels if r.quality == 0]
    good = [kept[r.doc_id][0] for r in labels if r.quality == 1 and not kept[r.doc_id][1]]
    assert np.mean(poor) < 0.05 and np.mean(good) > 0.95


def test_label_model_recovers_accuracies():
    r = np.random.default_rng(4)
    truth = r.random(20_000) < 0.7
    right = np.array([0.9, 0.8, 0.85, 0.7])
    v = np.where(r.random((20_000, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    v[r.random((20_000, 4)) < 0.2] = -1
    m = quality_rules.fit(v, np.ones(len(v)))
    assert abs(m.prior - 0.7) < 0.03 and np.abs(m.accuracy - right).max() < 0.03
    assert ((m.posterior(v) > 0.5) == truth).mean() > 0.9


def test_quality_keeps_columns_and_empty_tables(spark):
    d = docs(spark, ["good words " * 60, None]).withColumn("kept", F.lit("mine")).withColumn("extra", F.lit(1))
    out = quality_rules.quality_rules(d)
    assert {"extra", "doc_id", "posterior"} <= set(out.columns) and out.columns.count("kept") == 1 and out.count() == 2
    assert quality_rules.quality_rules(docs(spark, [])).count() == 0
    stage = quality_rules.stage(spark, docs(spark, [None, "bad " * 10]), SF)
    assert stage.columns == [c.split()[0] for c in DOCS.split(", ")] and stage.count() == 0


# licence scans


def test_license_odd_rows(spark):
    texts = [*ODD, "GNU  General-Public\nLICENSE then mit license MIT License", "Released under the MIT License.", "K gnu general public license", "licensed under the apache license version"]
    rows = {r.doc_id: r for r in license_scans.license_scan(docs(spark, texts).withColumn("labels", F.lit("x"))).collect()}
    assert (rows[0].n_words, rows[0].labels, rows[0].score, rows[0].first_word) == (0, "", 0.0, None)
    r = rows[8]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (9, 3, 0, 7, "gpl,mit") and r.score == 1.0
    assert rows[9].labels == "mit" and rows[10].base_labels == "gpl"
    # Seven words of eight are below nine tenths, the phrase alone counts.
    assert rows[11].labels == "apache" and rows[11].n_base == 1
    assert license_scans.license_scan(docs(spark, [])).count() == 0
    twice = docs(spark, ["mit license"]).union(docs(spark, ["mit license"]))
    assert [x.labels for x in license_scans.license_scan(twice).collect()] == ["mit", "mit"]


def test_license_join_is_exact(spark):
    rnd = random.Random(5)
    vocabulary = sorted({w for _, t in license_scans.TEMPLATES for w in t.split()})
    texts = []
    for _ in range(60):
        _, t = rnd.choice(license_scans.TEMPLATES)
        words = [w for w in t.split() if rnd.random() < 0.93] + rnd.sample(vocabulary, rnd.randrange(4)) + ["other"] * rnd.randrange(3)
        rnd.shuffle(words)
        texts.append("first line\n" + " ".join(words))
    needs = license_scans._needs(license_scans.TEMPLATES, 80)
    scanned = license_scans.scan_blocks(docs(spark, texts), "doc_id", "text", vocabulary, min(n for _, _, n in needs))
    got = {(r.doc_id, r.template) for r in license_scans.matches(scanned, "doc_id", needs).collect()}
    want = {(i, k) for i, t in enumerate(texts) for k, (_, words, need) in enumerate(needs) for line in t.split("\n") if len(set(line.split()) & set(words)) >= need}
    assert got == want and want


# mixing


def _water(sizes, weights, cap):
    targets, left = {}, dict(sizes)
    budget = sum(sizes.values())
    while left:
        total = sum(weights[s] for s in left)
        over = [s for s in left if budget * weights[s] / total >= cap * sizes[s]]
        if not over:
            return targets | {s: budget * weights[s] / total for s in left}
        for s in over:
            targets[s] = cap * sizes[s]
            budget -= targets[s]
            del left[s]
    return targets


def test_targets_and_taken(spark):
    rnd = random.Random(1)
    sources = [None, "a", "b", "c", "Z", "é"]
    rows = [(i, "w " * rnd.randrange(0, 40), "en", rnd.choices(sources, [1, 1, 1, 8, 2, 1])[0], 0) for i in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    size = Counter()
    for r in rows:
        size[r[3]] += r[1].count("w")
    order = sorted(sources, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    want = _water(size, {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}, 3)
    taken = Counter()
    for r in out:
        assert r._target == pytest.approx(want[r.source]) and r._source_size == size[r.source] and 0 <= r._times <= 3
        taken[r.source] += r._size * r._times
    for s in sources:
        assert abs(taken[s] - want[s]) <= 20
    again = {r.doc_id: r._times for r in mixing.mix(spark.createDataFrame(rows[::-1], DOCS)).collect()}
    assert again == {r.doc_id: r._times for r in out}


def test_mixing_odd_rows(spark):
    assert {(r._size, r._times) for r in mixing.mix(docs(spark, [None, "", " "])).collect()} == {(0, 0)}
    assert mixing.mix(docs(spark, [])).count() == 0
    d = docs(spark, ["a b c"] * 4).withColumn("target", F.lit("x"))
    assert mixing.mix(d).columns[: len(d.columns)] == d.columns
    stage = mixing.stage(spark, docs(spark, [*ODD, "one two"]), SF)
    assert stage.columns == [c.split()[0] for c in DOCS.split(", ")]


# byte-level BPE


def test_bpe_round_trip(spark):
    ranks = byte_bpe.codec(P.path(byte_bpe.RANKS)).encoding
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks._mergeable_ranks, special_tokens={})
    texts = [*ODD, "<|endoftext|>", "a  b\n\n  c" * 20_000, "\U0001f600é " * 9000]
    d = docs(spark, texts)
    back = {r.doc_id: (list(r.ids), bytes(r.decoded)) for r in byte_bpe.decode(byte_bpe.encode(d)).collect()}
    sums = {r.doc_id: r for r in byte_bpe.digests(d).collect()}
    for i, t in enumerate(texts):
        ids = plain.encode_ordinary(t or "")
        assert back[i] == (ids, (t or "").encode())
        assert sums[i].n_tokens == len(ids)
        assert sums[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert sums[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.digests(docs(spark, [])).count() == 0
    clash = byte_bpe.encode(d.withColumn("ids", F.lit("mine")))
    assert clash.columns.count("ids") == 1 and clash.count() == len(texts)


def test_safe_parts_join_up():
    rnd = random.Random(3)
    for _ in range(50):
        t = "".join(rnd.choice(["ab", " ", "  ", "\n", "é", "!", "\u00a0", "9"]) for _ in range(400))
        assert "".join(byte_bpe.safe_parts(t, 16)) == t


# URLs


def test_url_rules(spark):
    urls = {
        None: ("", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "http://Example.COM/en/x?y#z": ("example.com", "/en/x", "example.com/en/", "block"),
        "http://www.example.com/en/x": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "http://a.www.example.com/en/": ("a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"),
        "http://x.net": ("x.net", "", None, "allow"),
        "http://net/fr/": ("net", "/fr/", "net/fr/", "block"),
        "http://x.org/a-porn-b": ("x.org", "/a-porn-b", None, "block"),
        "http://x.org/importporn": ("x.org", "/importporn", None, "allow"),
        "http://x.org/casino/casino": ("x.org", "/casino/casino", None, "allow"),
        "http://x.org/casino?free": ("x.org", "/casino", None, "block"),
        "http://x.com/porn": ("x.com", "/porn", "com/", "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    d = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filters.url_filter(d).collect()}
    assert got == urls
    assert url_filters.url_filter(d.limit(0)).count() == 0


# classifier


def test_ordinal_model_learns_order():
    r = np.random.default_rng(0)
    grade = r.integers(0, 3, 1500)
    rows = [np.unique(np.concatenate([r.integers(1000, 5000, 20), [g], [7] if g == 0 else []]).astype(np.int32)) for g in grade]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    dense = np.zeros((1500, 6))
    m = quality_classifier.fit(np.concatenate(rows), bounds, dense, grade)
    assert (np.diff(m.thresholds) > 0).all()
    score = np.bincount(np.repeat(np.arange(1500), np.diff(bounds)), weights=m.weights[np.concatenate(rows)], minlength=1500)
    p = m.probabilities(score)
    assert (p[:, 0] >= p[:, 1]).all()
    assert ((p > 0.5).sum(axis=1) == grade).mean() > 0.95


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_classifier.train(d, labels.filter("doc_id % 4 <> 1"))
    held = labels.filter("doc_id % 4 = 1").join(quality_classifier.score(d, model), "doc_id")
    share = {r.grade: r.k for r in held.groupBy(quality_classifier.grade_of(F.col("quality"), F.col("toxic")).alias("grade")).agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[2] > 0.97 and share[0] < 0.1 and share[1] < 0.2


def test_classifier_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = docs(spark, ODD)
    model = quality_classifier.train(d, none)
    assert not model.weights.any()
    rows = quality_classifier.score(d.withColumn("kept", F.lit("x")), model).collect()
    assert len(rows) == len(ODD) and all(r.expected_grade == pytest.approx(r.tail_1 + r.tail_2) for r in rows)
    some = spark.createDataFrame([(0, 1, 0), (1, None, 1), (2, None, None), (99, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier.score(d, quality_classifier.train(d, some)).count() == len(ODD)
    assert quality_classifier.score(docs(spark, []), model).count() == 0


def test_classifier_brute_force_repeats_and_long_texts(spark):
    words = ["".join(chr(97 + (i * k) % 26) for k in (1, 3, 7, 11, 17)) + str(i) for i in range(9000)]
    texts = ["Good words, GOOD words!", "", None, "é é é naïve 12ab", " ".join(words)]
    d = docs(spark, texts)
    some = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (3, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(d, some)
    # Repeated rows of an id count once in the sample, in whatever order they come.
    assert np.array_equal(model.weights, quality_classifier.train(d.union(d).repartition(5), some).weights)

    def slot(raw, salt):
        p = X.prefix_hashes(np.frombuffer(raw, dtype=np.uint8))
        return int(X.span_hashes(p, np.array([0]), np.array([len(raw)]), salt)[0] >> np.uint64(64 - quality_classifier.BITS))

    got = {}
    for r in quality_classifier.score(d.union(d), model).collect():
        assert got.setdefault(r.doc_id, r) == r
    for i, t in enumerate(texts):
        raw = re.findall(rb"[0-9a-z\x80-\xff]+", low(t).encode())
        slots = {slot(w, 1) for w in raw} | {slot(w[:k], 100 + k) for w in raw for k in (3, 4, 5) if len(w) > k}
        (c,) = X.chunks(pa.array([t], pa.string()))
        _, _, dense = quality_classifier.chunk_features(c)
        want = sum(float(np.float32(model.weights[s])) for s in slots) + float(dense[0] @ model.dense)
        assert got[i].score == pytest.approx(want, abs=1e-6)
        assert got[i].kept == (got[i].tail_2 >= quality_classifier.KEEP)
    (rows,) = quality_classifier._extract(iter([pa.RecordBatch.from_pydict({"text": texts[4:], "doc_id": [4], "th": [0], "grade": [2]})]))
    # The sample holds every feature of a long text.
    assert set(np.frombuffer(rows.column(3)[0].as_py(), dtype=np.int32).tolist()) == slots


# token counts


def test_counts_at_prefixes():
    t = Tokenizer.from_file(P.path(token_counts.VOCABULARY))
    c = token_counts.PrefixCounter(P.path(token_counts.VOCABULARY), cut=40)
    rnd = random.Random(2)
    texts = ["The quick brown foxes' tail  isn't   red.\n\n\tOk<|endoftext|> 1234 été 漢字 \U0001f600!", "", "aaaa bbbb " * 40]
    texts += ["".join(rnd.choice(["the", "ing", " ", "  ", "\n", "é", "!", "9", "'s"]) for _ in range(120)) for _ in range(10)]
    for text, table in zip(texts, c.batch(texts), strict=True):
        assert table[-1] == (len(text), len(t.encode(text, add_special_tokens=False)))
        for i in range(0, len(text) + 1, 3):
            assert c.at(text, table, i) == len(t.encode(text[:i], add_special_tokens=False))
        best = c.longest_within(text, table, 12)
        assert c.at(text, table, best) <= 12 and (best == len(text) or table[-1][1] > 12)


def test_token_count_rows(spark):
    t = Tokenizer.from_file(P.path(token_counts.VOCABULARY))
    rows = {r.doc_id: r for r in token_counts.prefix_counts(docs(spark, ODD).withColumn("n_tokens", F.lit("x"))).collect()}
    for i, text in enumerate(ODD):
        assert (rows[i].n_bytes, rows[i].n_tokens) == (len((text or "").encode()), len(t.encode(text or "", add_special_tokens=False)))
    assert token_counts.prefix_counts(docs(spark, [])).count() == 0


def test_counts_at_every_prefix(spark):
    """The stored counts are those of the library for every prefix, and answer budgets."""
    t = Tokenizer.from_file(P.path(token_counts.VOCABULARY))
    rnd = random.Random(5)
    texts = ["we're  they'll 'reveal 'll!'re  \n \n x", "a <|endoftext|><|endof", "   ", "x <|endoftext|>  y", None, "it''s '''re"]
    texts += ["".join(rnd.choice(["the", "ing", " ", "  ", "\n", "é", "!", "9", "'s", "'re", "'", "\t", "　", "漢", "<|endoftext|>"]) for _ in range(50)) for _ in range(10)]
    table = token_counts.every_prefix(docs(spark, texts)).withColumn("within", token_counts.longest_prefix(F.col("counts"), 9))
    for r in table.collect():
        text = texts[r.doc_id] or ""
        want = [len(t.encode(text[:k], add_special_tokens=False)) for k in range(len(text) + 1)]
        assert r.counts == want
        assert r.within == max(k for k, n in enumerate(want) if n <= 9)
    assert token_counts.every_prefix(docs(spark, [])).count() == 0


def test_token_counts_of_long_and_repeated_texts(spark):
    t = Tokenizer.from_file(P.path(token_counts.VOCABULARY))
    texts = ["x" * 9000, "漢" * 9000, "word " * 9000, "same text", "same text"]
    got = {r.doc_id: r.n_tokens for r in token_counts.prefix_counts(docs(spark, texts)).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False)) for i, x in enumerate(texts)}


def test_hashes_by_windows(monkeypatch):
    rng = np.random.default_rng(8)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    cuts = np.unique(rng.integers(0, 5000, 300))
    long = np.array([0, 64, 200, 1500, 4900])
    for bounds in (cuts, long, np.array([0, 5000])):
        start, end = bounds[:-1], bounds[1:]
        want = X.span_hashes(X.prefix_hashes(data), start, end, 5)
        monkeypatch.setattr(X, "KEPT_POWERS", 64)
        assert (X.hasher(data)(start, end, 5) == want).all()
        monkeypatch.undo()
    assert len(X.hasher(data)(cuts[:0], cuts[:0])) == 0
