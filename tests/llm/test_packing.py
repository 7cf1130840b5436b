"""Packing: the library's ids, whole and disjoint places, and few sequences."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from foliant.llm import packing
from tests.llm.helpers import ODD, SF, docs

ROUNDS = 200


def _check(histogram, **k):
    plan = packing.pack(histogram, **{"rounds": ROUNDS} | k)
    held = Counter()
    for c, copies in plan.configurations:
        assert sum(c) <= plan.capacity and copies > 0
        for length in c:
            held[length] += copies
    assert held == Counter({length: n for length, n in histogram.items() if n})
    assert plan.sequences >= plan.bound - 1e-6
    return plan


def _value(prices, capacity):
    best = [0.0] * (capacity + 1)
    for at in range(1, capacity + 1):
        best[at] = max([best[at - 1], *(best[at - i] + p for i, p in enumerate(prices[: at + 1]) if i and p > 0)])
    return best[capacity]


def test_knapsack_by_plain_program():
    r = np.random.default_rng(5)
    for capacity, least in ((50, 1), (64, 2), (97, 7), (200, 16)):
        prices = np.where(r.random(capacity + 1) < 0.3, r.random(capacity + 1) * np.arange(capacity + 1), 0.0)
        prices[:least] = 0.0
        c, value = packing.knapsack(prices, capacity, least)
        assert sum(c) <= capacity and sum(prices[i] for i in c) == pytest.approx(value) == pytest.approx(_value(list(prices), capacity))
    assert packing.knapsack(np.zeros(51), 50, 2) == ([], 0.0)


def _least(items, capacity):
    """The fewest sequences, by trying all ways."""
    best = len(items)

    def go(i, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if i == len(items):
            best = len(gaps)
            return
        for k in range(len(gaps)):
            if gaps[k] >= items[i] and gaps[k] not in gaps[:k]:
                gaps[k] -= items[i]
                go(i + 1, gaps)
                gaps[k] += items[i]
        gaps.append(capacity - items[i])
        go(i + 1, gaps)
        gaps.pop()

    go(0, [])
    return best


def test_small_histograms_by_trying_all():
    r = random.Random(2)
    for _ in range(25):
        items = sorted((r.randrange(1, 41) for _ in range(r.randrange(1, 10))), reverse=True)
        assert _check(Counter(items), capacity=40).sequences <= _least(items, 40) + (len(items) > 7)


def test_large_histograms_come_near_the_bound():
    r = np.random.default_rng(4)
    drawn = np.minimum(np.maximum(1, r.lognormal(6.1, 0.9, 50_000)).astype(int), 2048)
    assert (p := _check(Counter(drawn.tolist()))).sequences <= 1.002 * p.bound
    assert (p := _check(Counter(r.integers(1, 2049, 20_000).tolist()), rounds=packing.ROUNDS)).sequences <= 1.005 * p.bound
    assert _check({700: 10**12}).sequences == 5 * 10**11
    assert _check({1025: 1000, 513: 1000, 512: 10, 511: 990}, rounds=1000).sequences <= 1.01 * 1159
    assert _check({}).sequences == 0 and _check({2048: 3, 1: 5}).sequences == 4


def _whole(spark, df, rows, capacity):
    """Every document's pieces in order, the library's ids, and no two pieces in one place."""
    t = Tokenizer.from_file(P.path(packing.VOCABULARY))
    want = Counter()
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, packing.END_ID], dtype="<u4")
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    got = packing.packed(df, capacity=capacity).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in got)
    return len(held), -(-total // capacity)


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROUNDS", ROUNDS)
    df = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    n, least = _whole(spark, df, [(r.doc_id, r.text) for r in df.collect()], packing.CAPACITY)
    assert n <= 1.01 * least + 1


def test_odd_texts(spark):
    texts = [*ODD, "<|endoftext|> in <|endoftext|>", "I'LL don't  \t\t x\n\n\ny 漢字\U0001f600", "word " * 15, "word " * 16, "same"] + ["same"] * 40
    rows = list(enumerate(texts)) + [(None, "no id")] * 3 + [(7, "same")]
    kind = "doc_id long, text string, number long, task string, piece long"
    df = spark.createDataFrame([(i, t, 5, "t", 9) for i, t in rows], kind).repartition(3)
    _whole(spark, df, rows, 16)
    assert packing.packed(df.limit(0)).collect() == []
