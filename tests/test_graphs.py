import numpy as np
import pytest

from parlance.operators import graphs, kernels


def pairs_of(spark, m, grp="g"):
    n = len(m)
    rows = [(grp, i, j, float(m[i, j])) for i in range(n) for j in range(i + 1, n) if not np.isnan(m[i, j])]
    return spark.createDataFrame(rows, "grp string, a long, b long, d double").repartition(3)


def items_of(spark, n, grp="g"):
    return spark.createDataFrame([(grp, i) for i in range(n)], "grp string, item long")


def distances(n, seed, fill):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) + 3 * rng.integers(0, 4, (n, 1))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) / 8
    d[rng.random(d.shape) > fill] = np.nan
    d = np.triu(d, 1)
    d = d + d.T
    np.fill_diagonal(d, 0)
    return d


def clusters_at(d, height, unknown):
    """Sets of items and heights of merges up to ``height``, by the kernel that merges one pair at a time."""
    n = len(d)
    merges = [m for m in kernels.average_linkage(np.where(np.isnan(d), unknown, d)) if m[2] <= height + 1e-12]
    sets = {i: frozenset([i]) for i in range(n)}
    for k, (a, b, _) in enumerate(merges):
        sets[n + k] = sets.pop(a) | sets.pop(b)
    return set(sets.values()), sorted(round(m[2], 9) for m in merges)


@pytest.mark.parametrize("n,seed,fill,height", [(30, 0, 1.0, 0.3), (40, 1, 0.6, 0.6), (125, 2, 0.8, 0.5)])
def test_average_linkage_is_the_kernels(spark, n, seed, fill, height):
    d = distances(n, seed, fill)
    found, merges = graphs.average_linkage(pairs_of(spark, d), items_of(spark, n), height, 2.0)
    sets = {}
    for r in found.collect():
        sets.setdefault(r["cluster"], set()).add(r["item"])
    want, heights = clusters_at(d, height, 2.0)
    assert {frozenset(s) for s in sets.values()} == want
    assert all(min(s) == name for name, s in sets.items())
    rows = merges.collect()
    assert sorted(round(r["height"], 9) for r in rows) == pytest.approx(heights)
    assert max(r["round"] for r in rows) < len(rows) / 2


def test_ties_and_odd_pairs(spark):
    # a chain of equal distances: 0-1 merge first, then 2-3; their mean is beyond the height
    chain = spark.createDataFrame([("g", 0, 1, 0.2), ("g", 2, 1, 0.2), ("g", 2, 3, 0.2), ("h", 5, 6, None), ("h", 5, 5, 0.0)], "grp string, a long, b long, d double")
    items = spark.createDataFrame([("g", i) for i in range(5)] + [("h", 5), ("h", 6)], "grp string, item long")
    found, _ = graphs.average_linkage(chain, items, 0.5, 2.0)
    assert {(r["grp"], r["item"]): r["cluster"] for r in found.collect()} == {("g", 0): 0, ("g", 1): 0, ("g", 2): 2, ("g", 3): 2, ("g", 4): 4, ("h", 5): 5, ("h", 6): 6}
    found, merges = graphs.average_linkage(chain.where("d < 0"), items, 0.5, 2.0)
    assert found.where("item <> cluster").count() == 0 and merges.count() == 0
    with pytest.raises(ValueError):
        graphs.average_linkage(chain, items, 2.0, 2.0)


def test_quality_is_the_kernels(spark):
    d = distances(30, 4, 0.7)
    found, _ = graphs.average_linkage(pairs_of(spark, d), items_of(spark, 30), 0.5, 1.0)
    labels = np.array([c for _, c in sorted((r["item"], r["cluster"]) for r in found.collect())])
    full = np.where(np.isnan(d), 1.0, d)
    row = graphs.cluster_quality(pairs_of(spark, d), found, 1.0).first()
    assert row["clusters"] == len(set(labels)) and row["silhouette"] == pytest.approx(kernels.silhouette(full, labels))
    within = [1 - full[np.ix_(m, m)][~np.eye(len(m), dtype=bool)].mean() if len(m := np.flatnonzero(labels == k)) > 1 else 1.0 for k in set(labels)]
    assert row["within"] == pytest.approx(np.mean(within))


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_density_clusters_against_the_kernel(spark, least):
    rng = np.random.default_rng(least)
    n = 60
    close = rng.random((n, n)) < 0.025
    close = close | close.T
    pairs = spark.createDataFrame([(i, j) for i in range(n) for j in range(i + 1, n) if close[i, j]] + [(3, 999)], "a long, b long")
    found = {r["item"]: r for r in graphs.density_clusters(pairs, items_of(spark, n).select("item"), least).collect()}
    labels = kernels.density_clusters(close, least)
    core = (close | np.eye(n, dtype=bool)).sum(1) >= least
    names = {k: min(np.flatnonzero((labels == k) & core)) for k in set(labels) - {-1}}
    assert {i: r["cluster"] for i, r in found.items()} == {i: names.get(k, -1) for i, k in enumerate(labels)}
    assert all(found[i]["core"] == core[i] for i in range(n))


def test_components(spark):
    rows = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (4, 4), (3, 1), (3, 1), (None, 1)] + [(100 + i, 101 + i) for i in range(40)]
    found = {r["node"]: r["component"] for r in graphs.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4, **{i: 5 for i in range(5, 10)}, **{100 + i: 100 for i in range(41)}}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0
