"""Properties of the matrix kernels."""

import math

import numpy as np
import pytest

from parlance.operators import kernels


def test_average_linkage_by_hand():
    d = np.array([[0, 1, 4, 8, 9], [1, 0, 5, 8, 9], [4, 5, 0, 7, 8], [8, 8, 7, 0, 2], [9, 9, 8, 2, 0]], float)
    merges = kernels.average_linkage(d)
    assert [(a, b, round(h, 4)) for a, b, h in merges] == [(0, 1, 1.0), (3, 4, 2.0), (2, 5, 4.5), (6, 7, 8.1667)]
    assert kernels.cut(merges, 5, 3).tolist() == [0, 0, 2, 1, 1]
    assert kernels.cut(merges, 5, 5).tolist() == [0, 0, 0, 1, 1]


def test_blocks_cluster_apart_and_unknown_is_alone():
    r = np.full((7, 7), 0.0)
    r[:3, :3] = r[3:6, 3:6] = 0.9
    r[6] = r[:, 6] = np.nan
    np.fill_diagonal(r, 1.0)
    assert kernels.cluster_by_correlation(r).tolist() == [0, 0, 0, 1, 1, 1, 2]


def test_mds_recovers_a_plane():
    x = np.random.default_rng(1).normal(size=(8, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    y, stress = kernels.weighted_mds(d, np.ones_like(d))
    assert stress < 0.01
    assert np.allclose(np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1)), d, atol=0.05)
    assert np.array_equal(y, kernels.weighted_mds(d, np.ones_like(d))[0])
    d[0, 1] = d[1, 0] = np.nan
    assert np.isfinite(kernels.weighted_mds(d, np.ones_like(d))[0]).all()
    assert kernels.weighted_mds(d[:2, :2], np.ones((2, 2)))[0].tolist() == [[0, 0], [0, 0]]


def test_leaf_order_is_the_best_of_the_tree():
    rng = np.random.default_rng(2)
    x = rng.normal(size=6)
    d = np.abs(x[:, None] - x[None]) + 0.01 * np.abs(rng.normal(size=(6, 6)))
    d = (d + d.T) / 2
    np.fill_diagonal(d, 0)
    merges = kernels.average_linkage(d)
    order = kernels.optimal_leaf_order(merges, d)

    def orders(t):
        if t < 6:
            return [[t]]
        a, b, _ = merges[t - 6]
        return [p for x in orders(a) for y in orders(b) for p in (x + y, y + x, x[::-1] + y, y + x[::-1])]

    assert sorted(order) == list(range(6))
    assert kernels.adjacency_cost(order, d) == pytest.approx(min(kernels.adjacency_cost(o, d) for o in orders(10)))


def test_lead_lag_finds_the_shift():
    rng = np.random.default_rng(0)
    steps = rng.normal(size=62)
    a, b = np.cumsum(steps[2:]), np.cumsum(steps[:-2])
    lag, r, p = kernels.lagged_correlation(a, b)
    assert (lag, p < 0.05) == (2, True) and r > 0.9
    assert kernels.lagged_correlation(np.array([1.0, 2, 3]), np.array([1.0, 2, 3])) is None


def test_distributions():
    assert kernels.normal_cdf(1.96) == pytest.approx(0.975, abs=1e-4)
    assert kernels.t_quantile(0.975, 9) == pytest.approx(2.262157, abs=1e-5)
    assert kernels.fisher([0.05, 0.05]) == pytest.approx(0.017478, abs=1e-5)
    assert kernels.fisher([0.5]) == pytest.approx(0.5)
    assert math.isclose(kernels.two_tailed(2, 0, 1), 0.0455, abs_tol=1e-4)


def test_density_clusters_and_topics():
    close = np.zeros((5, 5), bool)
    close[0, 1] = close[1, 0] = close[1, 2] = close[2, 1] = True
    assert kernels.density_clusters(close, 2).tolist() == [0, 0, 0, -1, -1]
    together = np.array([[9, 8, 8, 0], [8, 9, 8, 0], [8, 8, 9, 0], [0, 0, 0, 9.0]])
    found = kernels.topics(together, np.full(4, 9.0), list("abcd"), ["event", "person", "country", "person"])
    assert [t["members"] for t in found] == [[0, 1, 2]] and found[0]["name"] == "b & c"


def test_silhouette_and_svd():
    d = np.array([[0, 1, 9, 9], [1, 0, 9, 9], [9, 9, 0, 1], [9, 9, 1, 0.0]])
    assert kernels.silhouette(d, np.array([0, 0, 1, 1])) == pytest.approx(8 / 9)
    rng = np.random.default_rng(3)
    m = np.outer([1, 1, 1, -1, -1, -1], [1.0, 2, 3]) + 0.05 * rng.normal(size=(6, 3))
    m[0, 0] = np.nan
    x, _, share = kernels.svd_map(m)
    assert share[0] > 0.9 and len({np.sign(v) for v in x[:3, 0]}) == 1 and np.sign(x[0, 0]) != np.sign(x[3, 0])


def test_axis_correlates_by_strength():
    rng = np.random.default_rng(4)
    axis = rng.normal(size=14)
    m = np.stack([axis, -axis, rng.normal(size=14), np.where(np.arange(14) < 4, axis, np.nan)], 1) + 0.01 * rng.normal(size=(14, 4))
    found = kernels.axis_correlates(m, axis[:, None])
    assert {found[0][1], found[1][1]} == {0, 1} and all(f[1] != 3 for f in found)
