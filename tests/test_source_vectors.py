import numpy as np

from parlance.operators import source_vectors


def test_coverage_and_profiles(spark):
    rng = np.random.default_rng(0)
    mentions = [(int(s), int(e), float(rng.normal(e % 3 - 1)), None if rng.random() < 0.1 else float(rng.normal())) for s in range(9) for e in rng.choice(60, rng.integers(5, 40), replace=False) for _ in range(2)]
    frame = spark.createDataFrame(mentions, "source_id long, entity_id long, power double, moral double")
    cells = {(r["source_id"], r["entity_id"]): r["value"] for r in source_vectors.vectors(frame).collect()}
    seen = {(s, e) for s, e, *_ in mentions}
    known = {e for e in range(60) if len({s for s, x in seen if x == e}) >= 3}
    busy = {s for s in range(9) if len({e for x, e in seen if x == s and e in known}) >= 10}
    want = {}
    for s, e, p, m in mentions:
        if s in busy and e in known and m is not None:
            want.setdefault((s, e), []).append((p + m) / 2)
    assert set(cells) == set(want) and all(abs(cells[k] - np.mean(v)) < 1e-9 for k, v in want.items())
    sources, entities = sorted({s for s, _ in cells}), sorted({e for _, e in cells})
    m = np.array([[cells.get((s, e), 0.0) for e in entities] for s in sources])
    found = {}
    for r in source_vectors.bias_profiles(spark.createDataFrame([(*k, v) for k, v in cells.items()], "source_id long, entity_id long, value double"), 7).collect():
        found.setdefault(r["source_id"], {})[r["rank"]] = (r["entity_id"], round(r["difference"], 9))
    for i, s in enumerate(sources):
        gap = m[i] - m.mean(0)
        order = sorted(range(len(entities)), key=lambda k: (-round(abs(gap[k]), 9), entities[k]))[:7]
        assert found[s] == {n + 1: (entities[k], round(gap[k], 9)) for n, k in enumerate(order)}


def test_kmeans_over_many_entities(spark):
    rng = np.random.default_rng(1)
    rows = [(s, int(e), float((1 if s < 5 else -1) * (1 if e % 2 else -1) + 0.1 * rng.normal())) for s in range(10) for e in rng.choice(6000, 2500, replace=False)]
    found = dict(tuple(r) for r in source_vectors.kmeans(spark.createDataFrame(rows, "source_id long, entity_id long, value double"), 2).collect())
    assert len({e for _, e, _ in rows}) > 4000 and len(found) == 10
    assert len({found[s] for s in range(5)}) == 1 and len({found[s] for s in range(5, 10)}) == 1 and found[0] != found[9]
    assert source_vectors.kmeans(spark.createDataFrame([], "source_id long, entity_id long, value double"), 2).count() == 0


def test_density_groups(spark):
    rows = [(1, 1, 1.0), (1, 2, 1.0), (2, 1, 2.0), (2, 2, 1.9), (3, 3, 1.0), (4, 3, -1.0), (5, 9, 0.0)]
    found = dict(tuple(r) for r in source_vectors.density_groups(spark.createDataFrame(rows, "source_id long, entity_id long, value double")).collect())
    assert found == {1: 1, 2: 1, 3: -1, 4: -1, 5: -1}
