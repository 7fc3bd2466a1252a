"""Baselines by id, by name, from the fallback, or none."""

from parlance.operators import entities, lookups, narrative


def test_every_kind_of_baseline(spark):
    frame = lambda rows: spark.createDataFrame(rows, "entity_id long, name string, value double")
    readings = frame([(1, "Aa", 0.1), (2, "Bb", 0.2), (3, "Cc", 0.3), (4, "Dd", 0.4), (5, None, 0.5)])
    baseline = frame([(1, "other", 1.0), (8, "bB", 8.0), (7, "BB", 7.0), (9, None, 9.0)])
    fallback = frame([(2, "Bb", -2.0), (3, "Cc", -3.0)])
    found = {r["entity_id"]: (r["baseline"], r["matched"]) for r in lookups.with_baseline(readings, baseline, fallback).collect()}
    assert found == {1: (1.0, "id"), 2: (7.0, "name"), 3: (-3.0, "fallback"), 4: (None, "none"), 5: (None, "none")}


def test_short_queries_look_at_the_popular_alone(spark):
    own = spark.createDataFrame([(1, "Rex", "person", None), (2, "Renate", "person", None), (3, "Reed", "person", 2), (4, "Rest", "person", None)], "id long, name string, entity_type string, canonical_id long")
    mentions = spark.createDataFrame([(1,)] * 2 + [(2,)] * 3, "entity_id long")
    ids = lambda q: [r["entity_id"] for r in entities.search_box(mentions, own, q, popular=1).collect()]
    assert ids("re") == [2] and ids("ree") == [2] and ids("rest") == [4] and ids("rex") == []


def test_few_mentions_are_limited(spark):
    rows = [(i, 1, c, f"2001-01-0{d}", p) for i, (c, d, p) in enumerate([("a", 1, 1.0), ("a", 3, -1.0), ("a", 3, 2.0), ("b", 2, 1.0), ("b", 2, None), (None, 2, 1.0), ("a", 9, 2.0)])]
    mentions = spark.createDataFrame(rows, "mention_id long, entity_id long, country string, day string, power double").selectExpr("*", "CAST(day AS DATE) AS publish_date")
    found = {r["country"]: r for r in narrative.decayed_by(mentions, 1, "2001-01-05", "country").collect()}
    assert set(found) == {"a", "b"} and found["a"]["latest"] == 2.0 and (found["a"]["copies"], found["b"]["limited"], found["b"]["mean"]) == (8 + 9 + 9, True, None)
    assert abs(found["a"]["mean"] - (8 - 9 + 18) / 26) < 1e-12
    assert narrative.decayed_by(mentions, 1, "2001-01-05", "country", top=5).count() == 1
