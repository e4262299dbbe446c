"""Spectrum slicing and whitening against a plain eigendecomposition and exact integers."""

import math

import numpy as np
import pytest

from tabprep.llm import whitening
from tabprep.llm.spectrum import inertia_below, leading_eigenpairs


def spectra(d):
    return {
        "spread": np.linspace(1, 2, d), "two values": np.r_[np.ones(d // 2), np.zeros(d - d // 2)],
        "graded": 10.0 ** -np.minimum(np.arange(d), 12.0), "triple": np.r_[np.full(min(d, 3), 3.0), np.linspace(0, 1, max(0, d - 3))],
        "indefinite": np.linspace(-1, 1, d), "zero": np.zeros(d),
    }


@pytest.mark.parametrize("d", [1, 2, 3, 9, 40])
@pytest.mark.parametrize("kind", ["spread", "two values", "graded", "triple", "indefinite", "zero"])
def test_leading_eigenpairs(d, kind):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    v = (q * spectra(d)[kind]) @ q.T
    v = (v + v.T) / 2
    true = np.linalg.eigvalsh(v)
    for s in rng.uniform(-1.2, 3.2, 30):
        if np.abs(true - s).min() > 1e-9:
            assert inertia_below(v, s) == (true < s).sum()
    found, k = leading_eigenpairs(v, 8), min(d, 8)
    assert np.allclose(found.values, true[::-1][:k], atol=1e-13) and found.certified.all()
    assert np.abs(found.vectors @ found.vectors.T - np.eye(k)).max() < 1e-12
    assert np.abs(v @ found.vectors.T - found.vectors.T * found.values).max() < 1e-13


def brute(rows, k=8):
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in kept], object)
    n, sums = len(x), x.sum(0)
    centred = np.array([[float(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return kept, n, ((n * x - sums) ** 2).sum(1), centred @ vectors[:, ::-1][:, :k] / np.sqrt(values[::-1][:k]), values[::-1][:k] / values.sum()


@pytest.mark.parametrize("kind", ["float", "double"])
def test_whiten_against_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(300, 12)) * np.linspace(3, 0.2, 12) + 7
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(data)]
    rows += [(900, None), (901, [None] + [1.0] * 11), (902, [float("nan")] + [1.0] * 11), (903, [float("-inf")] * 12), (904, [])]
    rows += [(5, rows[5][1]), (None, rows[6][1])]
    df = spark.createDataFrame([(*r, "x", 1.5) for r in rows], f"vec_id long, embedding array<{kind}>, component string, n double").repartition(5)
    kept, n, deviations, whitened, explained = brute(rows)
    got = whitening.whiten(df).toPandas()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == 8 * n and (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10
    assert got.vec_id.isna().sum() == 8
    for c in range(1, 9):
        part = got[(got.component == c) & got.vec_id.notna()].sort_values(["vec_id", "whitened"])
        want = np.array([(i, w, int(s)) for (i, _), w, s in zip(kept, whitened[:, c - 1], deviations) if i is not None])
        sign = np.sign(part.whitened.iloc[0] * want[np.argsort(want[:, 0], kind="stable")][0, 1])
        want[:, 1] *= sign
        want = want[np.lexsort((want[:, 1], want[:, 0]))]
        assert np.allclose(part.whitened, want[:, 1], atol=1e-9) and np.allclose(part.explained, explained[c - 1], rtol=1e-12)
        assert part.deviation.tolist() == want[:, 2].astype(object).tolist()


def test_whiten_edges(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0  # nothing varies
    two = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [9.0])], schema)).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in sorted(two)] == [(1, 1, 2, 2 * 1024**2), (2, 1, 2, 2 * 1024**2)]
    assert sorted(round(r.whitened, 9) for r in two) == [-1.0, 1.0] and two[0].explained == pytest.approx(1)
    huge = [(i, [1e9 * i, 1.0 * i, 0.0]) for i in range(5)] + [(9, [1e300, 0.0, 0.0])]
    got = whitening.whiten(spark.createDataFrame(huge, schema)).collect()
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in huge[:5]]
    want = [sum((5 * a - s) ** 2 for a, s in zip(row, map(sum, zip(*x)))) for row in x]
    assert {r.vec_id: r.deviation for r in got} == {i: w if w < 2**63 else None for i, w in enumerate(want)}
    assert {r.n for r in got} == {5}
