"""Phrase collocations against a plain count of all runs of words."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import phrases, sieve
from foliant.llm import text as X
from tests.llm.helpers import SF, low
from tests.parity import compare, connect

KIND = "doc_id long, text string, lang string, phrase string, f long"


def _brute(docs, longest, least, covered, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in cand.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= covered * c[q := p[i : i + m]]}
        best = []
        for p, a in cand.items():
            if p not in gone:
                s, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                best.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def _rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("longest", "share", "size"), [(3, 32, 8 << 20), (3, 10**9, 300), (2, 4, 5000), (4, 1000, 1000)])
def test_random_texts_by_brute_force(spark, longest, share, size):
    r = random.Random(longest)
    vocabulary = ["The", "the", "a", "à", "of", "漢字", "x#", "one", "two", "-"] + [f"w{i}" for i in range(30)]
    weights = [20, 20, 15, 3, 10, 5, 2, 2, 2, 9] + [1] * 30
    docs = []
    for i in range(300):
        words = r.choices(vocabulary, weights, k=r.randrange(0, 80))
        docs.append((r.choice(["en", "de", None, ""]), "".join(w + r.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\r\n", " "]) for w in words)))
    docs += [("en", None), ("de", ""), (None, " .,; \n"), ("en", "the of " * 5000), ("en", "same line here again")] + [("fr", "one two one two one two")] * 6
    # A word that is named as a language, in a language that is named as a word.
    docs += [("es", "en of en of")] * 9 + [("en", "es of es of es of")] * 7
    df = spark.createDataFrame([(i, t, lang, "p", 1) for i, (lang, t) in enumerate(docs)], KIND).repartition(5)
    got = phrases.phrases(df, longest=longest, top=50, shard_bytes=size, dense_share=share)
    assert _rows(got) == _brute(docs, longest, 10, 50, 50)


def test_products_beyond_64_bits(spark):
    n = 6_000_000_000
    kind = "w array<long>, f long, lang string"
    c = spark.createDataFrame([([1, 2], n, None)], kind)
    f = c.unionByName(spark.createDataFrame([([1], n + 1, "en"), ([2], 10**13, "en")], kind))
    assert phrases._scored(c, f).first()["score"] == 10**6 * n * n // ((n + 1) * 10**13)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], KIND)
    assert phrases.phrases(empty).collect() == []
    assert phrases.phrases(spark.createDataFrame([(1, None, "en", "p", 1)], KIND)).collect() == []


def test_query_by_sql(spark):
    compare(phrases.query(spark, SF), phrases.oracle(), connect(SF))


def test_sieve_keeps_its_ids_and_bounds_its_size(spark):
    ids = spark.range(50_000).select(F.xxhash64("id").alias("id"))
    own = ids.toPandas()["id"].to_numpy()
    other = X.mix(np.arange(50_000, dtype=np.uint64)).view(np.int64)
    s = sieve.sieve(ids)
    assert s.test(own).all() and s.test(other).mean() < 0.02
    assert (len(s.words) * 64).bit_length() - 1 == 20
    small = sieve.sieve(ids, most_bits=sieve.PART_BITS)
    assert small.test(own).all() and len(small.words) * 64 == 1 << sieve.PART_BITS


def test_shards_end_where_pieces_end():
    texts = pa.array(["ab cd. ef gh, ij kl", "x y", "no break at all " * 3])
    got = [bytes(d).decode() for d, _ in phrases._shards(texts, 12)]
    assert "".join(got) == "".join(texts.to_pylist()) and got[0] == "ab cd." and got[-1].startswith("no break")
