"""Scaling over rows of pairs against the matrix kernel."""

import math

import numpy as np
import pytest

from parlance.operators import kernels, scaling


def _frames(spark, d, w):
    n = len(d)
    rows = [(i, j, None if math.isnan(d[i, j]) else float(d[i, j]), float(w[i, j])) for i in range(n) for j in range(i + 1, n)]
    return spark.createDataFrame(rows, "a long, b long, d double, w double"), spark.createDataFrame([(i,) for i in range(n)], "item long")


def _places(rows):
    rows = sorted(rows.collect())
    return np.array([(r["x0"], r["x1"]) for r in rows]), rows[0]["stress"]


@pytest.mark.parametrize("n, unknown", [(12, 0.0), (40, 0.2)])
def test_stress_is_the_kernels(spark, n, unknown):
    random = np.random.default_rng(n)
    x = random.standard_normal((n, 6))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    d[np.triu(random.random((n, n)) < unknown, 1)] = np.nan
    d = np.where(np.isnan(d.T), np.nan, np.where(np.isnan(d), np.nan, d))
    w = np.triu(random.uniform(0.2, 1, (n, n)), 1)
    w = w + w.T
    expected, least = kernels.weighted_mds(d, w, steps=5000, tolerance=1e-13)
    found, stress = _places(scaling.stress_map(*_frames(spark, d, w)))
    assert stress == pytest.approx(least, abs=1e-6)
    assert np.allclose(found, expected, atol=0.02)
    gap = np.sqrt(((found[:, None] - found[None]) ** 2).sum(-1))
    known = ~np.isnan(d)
    assert stress == pytest.approx(math.sqrt((w * (d - gap) ** 2)[known].sum() / (w * d**2)[known].sum()), abs=1e-9)


def test_a_plane_comes_back(spark):
    x = np.random.default_rng(5).standard_normal((15, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    found, stress = _places(scaling.stress_map(*_frames(spark, d, np.ones_like(d))))
    assert stress < 1e-4 and np.allclose(np.sqrt(((found[:, None] - found[None]) ** 2).sum(-1)), d, atol=1e-3)


def test_few_items_and_no_pairs(spark, monkeypatch):
    pairs, items = _frames(spark, np.full((4, 4), np.nan), np.ones((4, 4)))
    assert {tuple(r) for r in scaling.stress_map(pairs, items).drop("item").collect()} == {(0.0, 0.0, 0.0)}
    assert scaling.stress_map(pairs, items.limit(2)).count() == 2
    assert scaling.stress_map(pairs.limit(0), items.limit(0)).count() == 0
    same = scaling.stress_map(pairs.selectExpr("a", "b", "0D AS d", "1D AS w"), items).collect()
    assert {(r["x0"], r["x1"], r["stress"]) for r in same} == {(0.0, 0.0, 0.0)}
    monkeypatch.setattr(scaling, "MAX_POINTS", 3)
    with pytest.raises(ValueError, match="at most 3"):
        scaling.stress_map(pairs, items)
