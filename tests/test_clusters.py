"""Jobs over clusters: weekly, monthly and topics, against plain versions."""

import datetime

import numpy as np
import pytest

from parlance.operators import clustering, kernels


def test_source_clusters_numbers_and_centroids(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(2, 60))
    rows = [(s, e, float((base[0] if s < 4 else base[1] if s < 6 else rng.normal(size=60))[e] + 0.1 * rng.normal())) for s in range(7) for e in range(60)]
    cells = spark.createDataFrame(rows, "source_id long, entity_id long, value double")
    found = {r["source_id"]: r for r in clustering.source_clusters(cells).collect()}
    assert [found[s]["cluster_id"] for s in range(7)] == [0, 0, 0, 0, 1, 1, 2]
    assert [found[s]["members"] for s in range(7)] == [4, 4, 4, 4, 2, 2, 1]
    m = np.array([[v for s, _, v in rows if s == k] for k in range(7)])
    r = np.corrcoef(m)
    mean = [np.mean([r[i, j] for j in range(4) if j != i]) for i in range(4)]
    assert [found[i]["similarity"] for i in range(4)] == pytest.approx(np.round(mean, 4))
    assert [s for s in range(7) if found[s]["is_centroid"]] == [int(np.argmax(mean)), 4, 6] and found[6]["similarity"] == 1.0


def test_weekly_similarity_takes_its_window(spark):
    weeks = [datetime.date(2024, 1, 1) + datetime.timedelta(7 * k) for k in range(6)]
    rows = [(s, e, w, 1.0 * ((e * 7 + s * (w != weeks[0])) % 5), 1) for s in range(3) for e in range(12) for w in weeks] + [(9, 1, weeks[5], None, 1)]
    cells = spark.createDataFrame(rows, "source_id long, entity_id long, period_start date, mean_moral double, n long")
    pairs, clusters = clustering.weekly_similarity(cells, "2024-02-05", weeks=4)
    pairs = sorted(tuple(r) for r in pairs.collect())
    assert [(p[0], p[1], p[3]) for p in pairs] == [(0, 1, 12), (0, 2, 12), (1, 2, 12)]
    values = np.array([[(e * 7 + s) % 5 for e in range(12)] for s in range(3)], float)
    assert [p[2] for p in pairs] == pytest.approx(np.corrcoef(values)[np.triu_indices(3, 1)])
    assert {(p[5], p[6]) for p in pairs} == {(datetime.datetime(2024, 1, 15), datetime.datetime(2024, 2, 11, 23, 59, 59))}
    assert {r["cluster_id"] for r in clusters.collect()} == {"2024-02-05-C0", "2024-02-05-C1", "2024-02-05-C2"}


def test_monthly_clusters_tiers_and_floors(spark):
    rng = np.random.default_rng(3)
    sources, pairs = [], []
    countries = {"large": range(0, 12), "middle": range(20, 27), "sparse": range(30, 36), "small": range(40, 43), "few left": range(50, 58)}
    r = {}
    for country, ids in countries.items():
        sources += [(s, country, 1000 - s) for s in ids]
        for a in ids:
            for b in ids:
                if a < b and not (country == "sparse" and a % 2):
                    r[a, b] = 0.9 if a % 3 == b % 3 else float(rng.uniform(-0.2, 0.3))
    pairs = [(b, a, v, 20) for (a, b), v in r.items()] + [(0, 20, 0.99, 20), (6, 7, None, 3)]
    r.pop((6, 7))
    pairs = [p for p in pairs if p[:2] != (7, 6)]
    frame = spark.createDataFrame(pairs, "a long, b long, r double, common long")
    found, quality = clustering.monthly_clusters(frame, spark.createDataFrame([*sources, (99, None, 5)], "source_id long, country string, articles long"))
    rows = {x["source_id"]: x for x in found.collect()}
    # three sources are too few, eight leave three for the second tier; half of the sparse pairs are known
    assert set(rows) == set(countries["large"]) | set(countries["middle"]) | set(countries["sparse"])
    assert [rows[s]["cluster_level"] for s in countries["large"]] == [1] * 5 + [2] * 7
    for country, ids in (("large", range(5, 12)), ("middle", range(20, 27)), ("sparse", range(30, 36))):
        ids = list(ids)
        m = np.array([[1.0 if a == b else r.get((min(a, b), max(a, b)), 0.0) for b in ids] for a in ids])
        labels = kernels.cut(kernels.average_linkage(1 - m), len(ids), 0.3)
        size = np.bincount(labels)
        labels = np.where(size[labels] < 2, 0, labels)
        ours = [rows[s]["cluster_id"] for s in ids]
        assert [[x == y for y in ours] for x in ours] == [[x == y for y in labels] for x in labels]
        q = {x["country"]: x for x in quality.collect()}[country]
        assert q["clusters"] == len(set(labels)) and q["silhouette"] == pytest.approx(kernels.silhouette(1 - m, labels))
    assert rows[0]["cluster_id"] == "large_tier1_0" and rows[0]["is_centroid"]


@pytest.mark.parametrize("least", [2, 3])
def test_topics_against_a_plain_version(spark, least):
    rng = np.random.default_rng(least)
    mentions = [(a, int(e)) for a in range(60) for e in rng.choice(30, 3) if (e < 10) == (a < 25) or rng.random() < 0.05]
    articles = {}
    for a, e in mentions:
        articles.setdefault(e, set()).add(a)
    busy = sorted(e for e in articles if sum(x == e for _, x in mentions) >= 3)
    together = [(a, b, len(articles[a] & articles[b])) for a in busy for b in busy if a < b and articles[a] & articles[b]]
    share = {(a, b): n / min(len(articles[a]), len(articles[b])) for a, b, n in together}
    close = np.array([[a == b or 1 - share.get((min(a, b), max(a, b)), 0) <= 0.7 for b in busy] for a in busy])
    labels = kernels.density_clusters(close, least)
    core = close.sum(1) >= least
    kinds = ["event", "person", "country", "organization"]
    entities = [(e, f"n{e}", kinds[e % 4], None) for e in range(30)] + [(77, "alias", "person", 3)]
    members, topics = clustering.topic_clusters(
        spark.createDataFrame(together, "a long, b long, together long"), spark.createDataFrame(mentions, "article_id long, entity_id long"),
        spark.createDataFrame(entities, "id long, name string, entity_type string, canonical_id long"), 0.7, least,
    )
    want, named = {}, {}
    for k in set(labels) - {-1}:
        own = [e for e, x in zip(busy, labels, strict=True) if x == k]
        topic = min(e for e, x, c in zip(busy, labels, core, strict=True) if x == k and c)
        want |= {e: topic for e in own}
        best = min((["person", "organization", "country"].index(kinds[e % 4]) if e % 4 else 9) for e in own)
        key = [e for e in own if (["person", "organization", "country"].index(kinds[e % 4]) if e % 4 else 9) == best][:2]
        every = [share.get((a, b), 0.0) for a in own for b in own if a < b]
        named[topic] = (len(own), pytest.approx(np.mean(every) if every else 0.0), " & ".join(f"n{e}" for e in key))
    assert {r["entity_id"]: r["topic"] for r in members.collect()} == want
    assert {r["topic"]: (r["members"], r["coherence"], r["name"]) for r in topics.collect()} == named


def test_a_map_drops_sources_until_all_have_pairs(spark):
    rng = np.random.default_rng(5)
    cells = [(s, e, float(rng.normal())) for s in range(5) for e in range(12)]
    cells += [(5, e, float(rng.normal())) for e in range(8)] + [(5, 60 + e, 1.0) for e in range(9)]  # local coverage does not count
    # 6 and 7 know each other and too few others: 7 goes, then 6
    cells += [(6, e, float(rng.normal())) for e in range(20, 42)] + [(7, e, float(rng.normal())) for e in range(20, 30)] + [(8, e, float(rng.normal())) for e in range(30, 41)]
    countries = [(s, f"c{s % 4}") for s in range(9)]
    cells += [(9, e, 0.5 * e) for e in range(20, 42)]
    frames = spark.createDataFrame(cells, "source_id long, entity_id long, value double"), spark.createDataFrame([*countries, (9, None)], "source_id long, country string")
    kept, pairs = clustering.mappable(*frames)
    assert sorted(r[0] for r in kept.select("source_id").distinct().collect()) == [0, 1, 2, 3, 4]
    assert pairs.count() == 10 and pairs.where("b > 4").count() == 0
    found = clustering.source_map(*frames).collect()
    assert len(found) == 5 and len({r["stress"] for r in found}) == 1
    assert clustering.mappable(*frames, least_pairs=5)[1].count() == 0


def test_fisher_over_layers(spark):
    rows = [(1, "global", None, None, 0.05), (1, "national", "x", None, 0.2), (1, "source", None, 7, 0.01), (1, "source", None, 8, 0.5), (2, "source", None, 7, 0.3), (3, "global", None, None, 0.1)]
    layers = spark.createDataFrame(rows, "entity_id long, layer string, country string, source_id long, p_value double")
    found = clustering.combined_significance(layers, spark.createDataFrame([(7, "x"), (8, "y")], "source_id long, country string"))
    got = {(r["entity_id"], r["source_id"]): (r["layers"], r["p_combined"]) for r in found.collect()}
    want = {(1, 7): [0.05, 0.2, 0.01], (1, 8): [0.05, 0.5], (2, 7): [0.3]}
    assert got == {k: (len(p), pytest.approx(kernels.fisher(p))) for k, p in want.items()}
