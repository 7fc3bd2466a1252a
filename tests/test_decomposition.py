import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import decomposition


def entries(spark, m):
    rows = [(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)]
    return spark.createDataFrame(rows, "i long, j long, v double").repartition(3)


def exact(m, k):
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    return (u * s)[:, :k], s[:k]


@pytest.mark.parametrize("shape,k,fill", [((40, 40), 5, 0.3), ((70, 25), 8, 0.5), ((12, 90), 24, 1.0)])
def test_against_the_exact_decomposition(spark, shape, k, fill):
    rng = np.random.default_rng(k)
    m = rng.normal(size=shape) * (rng.random(shape) < fill)
    if shape[0] == shape[1]:
        m = m + m.T
    found, size = decomposition.truncated_svd(entries(spark, m), k)
    x, s = exact(m, k)
    np.testing.assert_allclose(size, s[: len(size)], rtol=1e-8)
    assert len(size) == min(k, *shape)
    rows = {r["i"]: r["vector"] for r in found.collect()}
    assert set(rows) == set(np.flatnonzero((m != 0).any(1)).tolist())
    ours = np.array([rows.get(i, [0.0] * len(size)) for i in range(shape[0])])
    # up to the signs of columns: products of rows are the exact ones
    np.testing.assert_allclose(ours @ ours.T, x @ x.T, atol=1e-6 * s[0] ** 2)
    assert all(c[np.abs(c).argmax()] > 0 for c in ours.T)


def test_low_rank_equal_values_and_nothing(spark):
    m = np.zeros((6, 6))
    m[0, 1] = m[1, 0] = m[2, 3] = m[3, 2] = 2.0  # four singular values of 2
    found, size = decomposition.truncated_svd(entries(spark, m), 24)
    np.testing.assert_allclose(size, [2.0] * 4)
    rows = {r["i"]: np.array(r["vector"]) for r in found.collect()}
    assert set(rows) == {0, 1, 2, 3}
    assert all(abs(rows[a] @ rows[b] - (4.0 if a == b else 0.0)) < 1e-8 for a in rows for b in rows)
    none, size = decomposition.truncated_svd(spark.createDataFrame([], "i long, j long, v double"), 3)
    assert none.collect() == [] and len(size) == 0
    one, size = decomposition.truncated_svd(spark.createDataFrame([(7, 3, -2.5)], "i long, j long, v double"), 3)
    assert [tuple(r) for r in one.collect()] == [(7, [2.5])] and size.tolist() == [2.5]


def test_reruns_agree(spark):
    m = np.random.default_rng(1).random((30, 30))
    a, b = (sorted((r["i"], tuple(np.round(r["vector"], 8))) for r in decomposition.truncated_svd(entries(spark, m), 3)[0].collect()) for _ in range(2))
    assert a == b


def test_sentiment_vectors_are_those_of_the_centred_matrix(spark):
    rng = np.random.default_rng(5)
    full = rng.normal(size=(20, 6 * 4))
    seen = rng.random(full.shape) < 0.6
    rows = [(j % 6, i, f"week {j // 6}", float(full[i, j]) if seen[i, j] else None) for i in range(20) for j in range(24)]
    cells = spark.createDataFrame(rows, "source_id long, entity_id long, period_start string, mean_moral double")
    found = {r["entity_id"]: r["vector"] for r in decomposition.sentiment_embeddings(cells, 4).collect()}
    means = np.array([full[seen[:, j], j].mean() for j in range(24)])
    x, _ = exact(np.where(seen, full - means, 0.0), 4)
    ours = np.array([found[i] for i in range(20)])
    np.testing.assert_allclose(ours @ ours.T, x @ x.T, atol=1e-7)


def test_cosines(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 2.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0])], "entity_id long, vector array<double>")
    rows = decomposition.vector_cosines(vectors, vectors.where("entity_id IN (1, 3)")).select("query", "entity_id", F.round("cosine", 6).alias("c"))
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 2, 0.707107), (1, 4, -1.0)]
