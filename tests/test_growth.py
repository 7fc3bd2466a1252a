"""What keeps the work of a query in proportion to its input: plans, tasks and batches that do not grow faster."""

import datetime as dt
import math

import pandas as pd
from pyspark.sql import functions as F

from parlance import fixtures
from parlance.functions import text
from parlance.operators import clustering, entities, rollups, similarity
from parlance.plans import queries
from parlance.sources import readers
from parlance.streaming import leases


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_polls_of_one_window_are_spread_over_its_days_once(spark):
    day = dt.date(2020, 1, 10)
    polls = spark.range(40).select(
        (F.col("id") % 20).alias("poll_id"), F.lit(1).cast("long").alias("entity_id"), F.lit(day).alias("field_start"), F.date_add(F.lit(day), (F.col("id") / 20).cast("int")).alias("field_end"), F.lit(2.0).alias("value_pct")
    )
    mentions = spark.createDataFrame([(1, dt.date(2020, 1, 9), 1.0), (1, dt.date(2020, 1, 9), None), (1, dt.date(2020, 1, 12), 4.0), (1, dt.date(2020, 1, 14), 9.0), (2, day, 5.0)], "entity_id long, publish_date date, moral double")
    got = similarity.poll_readings(polls, mentions, days=1)
    # rows of one poll and value are one reading: the 9th to the 11th, and the 9th to the 12th
    assert sorted(map(tuple, got.select("poll_id", "reading", "n").collect())) == [(k, 2.0, 3) for k in range(20)]
    lines = plan(got).splitlines()
    spread = next(i for i, x in enumerate(lines) if "Generate explode" in x)
    assert "Aggregate" in lines[spread + 1]


def test_neighbours_of_odd_vectors_meet_as_tiles(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    odd = [[1.0, 2.0], [2.0, 4.0], [0.0, 0.0], [-1.0, 2.0], None, [1.0, None], [3.0], [], [1.0, 2.0], [2.0, 1.0], [-1.0, -2.0], [1.0, 2.0, 3.0], [1e-9, 1.0]]
    rows = [(i, v) for i, v in enumerate(odd)] + [(20 + i, [float(i % 7), 1.0 + i % 3]) for i in range(40)] + [(None, [1.0, 2.0]), (20, [5.0, 5.0])]

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return 0.0
        size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b)) / size, 6) + 0.0 if size else 0.0

    def brute(rows, k):
        asked = {i for i, _ in rows if i is not None and i % 3 == 0}
        found = {q: sorted((-cosine(v, w), j) for i, v in rows if i == q for j, w in rows if j not in (q, None))[:k] for q in asked}
        return sorted((q, j, -c + 0.0, r) for q, best in found.items() for r, (c, j) in enumerate(best, 1))

    got = []
    for tile in (7, 1000):
        monkeypatch.setattr(similarity, "TILE", tile)
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        near = similarity.cosine_neighbours(df, df.where("vec_id % 3 = 0").select("vec_id"), k=4, block=5)
        assert sorted(map(tuple, near.collect())) == brute(rows, 4)
        got.append(near)
    # blocks meet tiles, so no row stands for a pair of vectors
    assert "FlatMapCoGroupsInArrow" in plan(got[0])
    df = spark.createDataFrame([(0, [nan, 1.0]), (1, [inf, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    near = similarity.cosine_neighbours(df, df.select("vec_id"), k=2).collect()
    assert sorted((r["query"], r["vec_id"], r["rank"]) for r in near) == [(0, 1, 1), (0, 2, 2), (1, 0, 1), (1, 2, 2), (2, 0, 1), (2, 1, 2), (3, 0, 1), (3, 1, 2)]
    assert all(math.isnan(r["cosine"]) for r in near)


def test_words_of_a_shortlist_go_without_their_text(spark):
    docs = spark.createDataFrame([(1, "The Party was big"), (1, "x art deco a party"), (2, "art decoration, ART DECO"), (None, "a small art deco"), (None, "a party deco art"), (3, None), (4, "")], "doc_id long, text string")
    names = spark.createDataFrame([("Art deco", 5), ("party", 9), ("art", 9), ("", 1), ("big", None)], "name string, mentions long")
    got = entities.shortlist(docs, names)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, "art", 9, 1), (1, "party", 9, 2), (1, "art deco", 5, 3), (1, "big", None, 4), (2, "art", 9, 1), (2, "art deco", 5, 2), (None, "art", 9, 1), (None, "party", 9, 2), (None, "art deco", 5, 3)], key=str
    )
    # of rows alike in id and size, each answers for its own words
    docs = spark.createDataFrame([(1, "a party b"), (1, "par ty ab")], "doc_id long, text string")
    assert [tuple(r) for r in entities.shortlist(docs, spark.createDataFrame([("par", 1), ("party", 1)], "name string, mentions long")).select("name").collect()] == [("par",), ("party",)]
    lines = plan(got).splitlines()
    below = next(i for i, x in enumerate(lines) if "Generate explode" in x)
    assert "lower(text" not in lines[below + 1].split("Project")[-1] or "AS text" not in lines[below + 1]


def test_result_lines_are_parsed_once(spark):
    good = '{"custom_id": "a", "response": {"status_code": 200, "body": {"choices": [{"message": {"content": "{\\"source_country\\": \\"X\\", \\"entities\\": [{\\"entity\\": \\" Y \\", \\"power_score\\": \\"1\\"}, null, {\\"entity\\": \\"\\"}]}"}}]}}}'
    rows = [(good,), (good.replace("200", "500"),), ("no",), (None,), (good.replace("entities", "other"),)]
    mentions, rejects = readers.parse_results(spark.createDataFrame(rows, "value string"))
    assert [(r["article_id"], r["country"], r["name"], r["power"], r["moral"]) for r in mentions.collect()] == [("a", "X", "Y", 1.0, 0.0)]
    assert sorted(r["reason"] for r in rejects.collect()) == ["content is not a result", "failed request", "not a result line", "not a result line"]
    assert plan(mentions).count("from_json(") == 2


def test_leases_reach_their_state_once_a_call():
    calls = []

    class Store:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, what):
            if what.startswith("__"):
                raise AttributeError(what)

            def call(*args):
                calls.append(what)
                return False if what == "exists" else [] if self.name == "history" else None

            return call

    one = leases.Leases("click", "purchase")
    one.handle, one.state, one.history = Store("handle"), Store("state"), Store("history")
    at = pd.date_range("2024-01-01", periods=201, freq="min")
    rows = pd.DataFrame({"ts": at, "event_id": range(201), "event_type": ["click", "purchase"] * 100 + ["click"]})
    (out,) = one.handleInputRows((5,), iter([rows[100:], rows[:100]]), None)
    assert list(out["status"]) == ["completed"] * 100 and list(out["attempts"]) == [1] * 100
    assert sorted(calls) == ["exists", "put", "registerTimer", "update"]


def test_mentions_come_in_as_many_parts_as_their_rows_need(spark, small, monkeypatch):
    def scored():
        t = fixtures.News(spark, small)
        return rollups.article_hotelling_t2(t.mentions, rollups.weekly_moments(t.mentions, "2000-08-01", "2001-08-01"))

    whole = scored()
    assert "RepartitionByExpression" not in plan(whole)
    monkeypatch.setattr(fixtures, "PART_ROWS", 500)
    dealt = scored()
    parts = -(-spark.read.parquet(f"{small}/lineitem.parquet").count() // 500)
    assert parts > 4 and f", {parts}\n" in plan(dealt)
    rows = lambda df: sorted((r["article_id"], round(r["t2"], 6), r["entities"]) for r in df.collect())
    assert rows(dealt) == rows(whole) and whole.count()


def test_pages_reach_a_worker_by_the_hundred(spark):
    pages = [(1, "<title>T</title><article>a <b>b</b></article><time datetime='2024-01-02'>"), (2, None), (3, ""), (4, "<body>x &amp; y<script>z"), (5, "<time>" + "<p>w" * 3)]
    got = spark.createDataFrame(pages, "page_id long, html string").select("page_id", text.html_article("html").alias("h")).select("page_id", "h.title", "h.text", "h.published")
    assert sorted(map(tuple, got.collect())) == [(k, *text.extract_article(html)) for k, html in pages]
    # an Arrow batch has up to ten thousand pages, of any length; a page is read once for its three columns
    assert plan(got).count("BatchEvalPython [") == 1 and "ArrowEvalPython" not in plan(got)


def counted(df):
    """``df``, and a count of the rows that are computed of it."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for rows in batches:
            seen.add(len(rows))
            yield rows

    return df.mapInPandas(run, df.schema), seen


def test_what_pairs_are_made_of_is_computed_once(spark, small):
    edges = [(a, b, 0.9 if a % 2 == b % 2 else 0.1, 20) for a in range(6) for b in range(a)] + [(7, 8, None, 3)]
    pairs, seen = counted(spark.createDataFrame(edges, "a long, b long, r double, common long"))
    sources = spark.createDataFrame([(s, "x", 10 - s) for s in range(6)], "source_id long, country string, articles long")
    found, quality = clustering.monthly_clusters(pairs, sources)
    assert sorted((r["source_id"], r["cluster_id"], r["similarity"]) for r in found.collect()) == [(s, f"x_cluster_{s % 2}", 0.9) for s in range(6)]
    assert [(r["country"], r["clusters"]) for r in quality.collect()] == [("x", 2)]
    assert seen.value == len(edges)
    day = dt.date(2024, 2, 5)
    rows = [(s, e, day, float((e * 7 + s) % 5), 1) for s in range(3) for e in range(12)]
    cells, seen = counted(spark.createDataFrame(rows, "source_id long, entity_id long, period_start date, mean_moral double, n long"))
    stored, clusters = clustering.weekly_similarity(cells, "2024-02-05")
    assert stored.count() == 3 and clusters.count() == 3 and seen.value == len(rows)
    # the queries' pairs are joined from written cells, not from the mentions
    t = fixtures.News(spark, small)
    cells = queries.similarity_cells(t)
    assert "l_orderkey" not in plan(similarity.pearson_pairs(cells)) and sorted(cells.collect()) == sorted(rollups.window_cells(queries.quarter_cells(t), queries.WINDOW).collect())
