"""Whitening against the plain covariance of all distinct vectors."""

import math

import numpy as np
import pytest

from foliant.llm import whitening
from tests.llm.helpers import SF

KIND = "vec_id long, embedding array<float>, n long, component string"


def _brute(rows, components=16):
    xs = {}
    for i, v in rows:
        if v and all(c is not None and math.isfinite(c) for c in v):
            xs.setdefault(i, []).append(tuple(math.floor(64 * float(c)) + 1000000 for c in v))
    fit = sorted({x for v in xs.values() for x in v})
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, total, strict=True)] for x in fit])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, v in xs.items():
        for x in v:
            d = [n * a - s for a, s in zip(x, total, strict=True)]
            for c in range(min(components, len(e))):
                out.setdefault((i, c + 1), []).append((n, sum(a * a for a in d), float(np.array(d) / n @ u[:, c] / math.sqrt(e[c])), e[c] / e.sum()))
    return out


def _agree(got, want, components):
    assert sorted(((r.vec_id, r.component) for r in got), key=repr) == sorted((k for k, v in want.items() for _ in v), key=repr)
    signs = {}
    for c in range(1, components + 1):
        mine = max((r for r in got if r.component == c), key=lambda r: abs(r.whitened))
        signs[c] = math.copysign(1, mine.whitened * want[mine.vec_id, c][0][2])
    for r in got:
        n, deviation, whitened, explained = want[r.vec_id, r.component][0]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.whitened == pytest.approx(whitened * signs[r.component], rel=1e-7, abs=1e-8)
        assert r.explained == pytest.approx(explained, rel=1e-9)
        assert r.identity_error < 1e-9


@pytest.mark.parametrize("tile", [5, 32, 100])
def test_tiles_by_brute_force(spark, tile):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = _brute([(r.vec_id, list(r.embedding)) for r in rows.collect()])
    _agree(whitening.whiten(rows, tile=tile).collect(), want, 16)


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=3) * (3, 2, 1)]) for i in range(40)]
    rows += [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 0.0]), (104, []), (105, [1e30, 0.0, 0.0])]
    rows += [(200, rows[0][1])] * 30 + [(None, rows[1][1])]
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], KIND).repartition(3)
    _agree(whitening.whiten(df, tile=2).collect(), _brute([r for r in rows if r[0] != 105]), 3)


def test_ties_empty_and_ragged(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], 1, "a"), (2, [1.0, 2.0], 1, "a")], KIND)
    assert whitening.whiten(one).count() == 0
    assert whitening.whiten(one.limit(0)).count() == 0
    square = [(i, [float(a), float(b)], 1, "a") for i, (a, b) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)])]
    got = whitening.whiten(spark.createDataFrame(square, KIND)).collect()
    assert len(got) == 8 and all(r.explained == pytest.approx(0.5) and r.identity_error < 1e-12 for r in got)
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1.0], 1, "a"), (2, [1.0, 2.0], 1, "a")], KIND))


def test_large_numbers_stay_exact():
    m = whitening.Mean(3, [10**13 * 3 + 1, 5])
    k = np.array([[10**12, 1], [2, 3]])
    want = [sum((3 * int(a) - int(r)) ** 2 for a, r in zip(row, m.rest, strict=True)) for row in k]
    assert m.deviations(k).to_pylist() == [w if w < 1 << 63 else None for w in want]
