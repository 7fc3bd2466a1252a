"""Text functions, sources, sinks and statistics on small rows."""

import json

import pytest

from parlance.functions import stats, text
from parlance.operators import clustering, entities, narrative, rollups
from parlance.sources import readers, writers


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column("v")).first()[0]


@pytest.mark.parametrize("url,article", [
    ("https://x.com/", False), ("https://x.com/world/", False), ("https://x.com/world-cup/", True), ("https://x.com/a/b/", True), ("https://x.com/tag/a", False),
    ("https://x.com/2024/story", True), ("nothing", False), (None, False), ("https://x.com/a?next=/login", False),
])
def test_articles_by_url(spark, url, article):
    assert bool(one(spark, text.looks_like_article, url)) is article


def test_urls(spark):
    assert one(spark, text.registered_domain, "https://feeds.bbci.co.uk/news/rss.xml") == "bbci.co.uk"
    assert one(spark, text.registered_domain, "http://user@www.a.b.example.com:80/x") == "example.com"
    assert one(spark, text.registered_domain, "x") is None
    assert one(spark, text.normalize_url, "https://x.com/a?utm_source=f&id=3&ref=q#top") == "https://x.com/a?id=3"
    assert one(spark, text.normalize_url, "https://x.com/a?fbclid=f") == "https://x.com/a"
    assert one(spark, text.normalize_url, "no url") == "no url"
    assert one(spark, text.string_hash, "hello") == format(99162322, "x")


def test_scores_and_types(spark):
    for value, score in (("1.5", 1.5), ("score: -7", -2.0), ("n/a", 0.0), (None, 0.0), ("", 0.0), ("1.2.3", 0.0)):
        assert one(spark, text.parse_score, value) == score
    for value, kind in (("Person", "person"), ("political leader", "person"), ("tech company", "business"), ("UN agency", "organization"), ("presidential election", "event"), ("idea", "concept"), (None, "concept"), ("political_leader", "person"), ("Identity Group", "organization"), ("criminal_organization", "organization"), ("think tank", "organization"), ("sports star", "concept"), ("central_bank", "business")):
        assert one(spark, text.map_type, value) == kind


@pytest.mark.parametrize("name,kind,out", [
    ("  Apple   Inc. ", "business", "Apple"), ("President Joe Smith", "person", "Joe Smith"), ("European Central Bank (ECB)", "organization", "European Central Bank"), ("usa", "country", "United States"),
    ("Country: France", "country", "France"), ("“Quoted”", None, "Quoted"), ("ﬁne", "concept", "fine"), (None, None, None), ("Inc", "business", "Inc"),
])
def test_names(spark, name, kind, out):
    rows = spark.createDataFrame([(name, kind)], "n string, k string")
    assert rows.select(text.normalize_name("n", "k")).first()[0] == out


def test_name_rules(spark):
    cases = [
        ("Liberal Front (J)", "organization", "Liberal Front (J)"), ("Old Party (SP)", "organization", "Old Party (SP)"), ("Samsung Electronics Co., Ltd", "business", "Samsung Electronics"),
        ("News Corp", "organization", "News Corp"), ("General Mills", "company", "General Mills"), ("Vice President Kim Roe", "", "Kim Roe"), ("Mars Inc", "business", "Mars Inc"),
        ("Left Front (Maoist)", "organization", "Left Front (Maoist)"), ("Northern Alliance (NorA)", "country", "Northern Alliance"), ("Acme, Co", "business", "Acme"), ("Acme Co", "business", "Acme Co"),
        ("Acme Co. Inc., Ltd.", "business", "Acme Co"), ("One Two Co", "business", "One Two"), ("One Two Co", "concept", "One Two Co"), ("Dr. Sir Tom Hill", None, "Tom Hill"), ("Dr. Sir Tom Hill", "country", "Dr. Sir Tom Hill"),
        ("ORG: Fund", "concept", "Fund"), ("Star Trek: Picard", "concept", "Star Trek: Picard"), ("", "person", ""), ("Co., Ltd", "business", "Co"), ("A (BC DE)", "concept", "A (BC DE)"), ("Ärzte (ÄÖ)", "concept", "Ärzte"),
    ]
    rows = spark.createDataFrame([(n, k) for n, k, _ in cases], "n string, k string").coalesce(1)
    assert [r[0] for r in rows.select(text.normalize_name("n", "k")).collect()] == [out for *_, out in cases]


def test_aliases_as_a_table(spark):
    rows = spark.createDataFrame([(1, "Joseph Roe"), (2, "Joe Roe"), (3, None)], "id long, name string")
    table = spark.createDataFrame([("joseph roe", "Joe Roe"), ("JOSEPH ROE", "Joseph R"), (None, "x")], "alias string, canonical string")
    assert {r.id: r.name for r in text.with_aliases(rows, table).collect()} == {1: "Joe Roe", 2: "Joe Roe", 3: None}


def test_merge_by_normalised_names(spark):
    rows = [(1, "Joe Roe", "person"), (2, "President Joe Roe", "person"), (3, "joe roe", "person"), (4, "Tesla, Inc", "business"), (5, "Tesla", "business"), (6, "President", "person")]
    names = spark.createDataFrame(rows, "id long, name string, entity_type string")
    seen = spark.createDataFrame([(1,), (1,), (5,)], "raw_id long")
    assert {r.id: r.merged_into for r in entities.merge_exact(seen, names).collect()} == {1: 1, 2: 1, 3: 1, 4: 5, 5: 5, 6: 6}


def test_fuzzy_review_equals_all_pairs(spark):
    import random
    from difflib import SequenceMatcher

    draw = random.Random(5)
    names = {"alpha", "alpah", "", "ab", "abc", "élan vital", "élan vitale"} | {"ab" + "".join(draw.choice("abcd") for _ in range(draw.randint(0, 14))) for _ in range(150)}
    rows = spark.createDataFrame([(n,) for n in [*names, None, "ALPHA"]], "name string")
    want = {(a, b) for a in names for b in names if a and a < b and a[:2] == b[:2] and SequenceMatcher(None, a, b).ratio() >= 0.85}
    got = [(r.a, r.b) for r in entities.fuzzy_review(rows).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want


def test_linked_groups_equal_components(spark):
    chain = [(i, i + 1, 0.9) for i in range(10, 40)] + [(3, 9, 0.7), (1, 2, 0.5), (2, 40, 0.59)]
    rows = spark.createDataFrame(chain, "a long, b long, cosine double")
    want = {i: 10 for i in range(10, 41)} | {3: 3, 9: 3, 1: -1, 2: -1}
    assert {r.entity_id: r.group_id for r in clustering.entity_groups(rows).collect()} == want
    assert clustering.entity_groups(rows.where("a < 0")).count() == 0


def test_few_readings_stay_as_they_are(spark):
    rows = spark.sql("SELECT 1L AS entity_id, DATE'2024-01-01' + CAST(id AS INT) AS publish_date, CAST(id AS DOUBLE) AS power FROM range(100)")
    few = narrative.tracking(rows.where("power < 5"), 1).collect()
    assert sorted(r.value for r in few) == [0, 1, 2, 3, 4] and {r.mentions for r in few} == {1}
    many = sorted(narrative.tracking(rows, 1).collect())
    assert len(many) == 25 and many[1].value == 2 and many[-1].mentions == 8
    assert narrative.tracking(rows, 2).count() == 0


def test_histogram_where_no_kernel_fits(spark):
    import numpy as np

    scores = {1: [0.5, 0.5, 0.5, 0.5, 0.5, 0.5], 2: [-2.0, 2.0, 0.13]}
    rows = spark.createDataFrame([(1, k, x) for k, xs in scores.items() for x in xs], "entity_id long, source_id long, moral double")
    got = {(r.source_id, r.i): r.density for r in narrative.density(rows, 1, layer="source_id", bins=20).collect()}
    for k, xs in scores.items():
        heights, edges = np.histogram(xs, 20, (-2, 2), density=True)
        want = np.interp(np.arange(121) / 30 - 2, (edges[1:] + edges[:-1]) / 2, heights, 0, 0)
        assert np.allclose([got[k, i] for i in range(3, 118)], want[3:118]) and got[k, 0] == got[k, 120] == 0
    assert narrative.density(rows, 1, layer="source_id").count() == 0


def test_html(spark):
    page = "<html><head><title>A &amp; B</title></head><body><nav>menu</nav><main>x<article><p>One</p> <script>no</script><p>two</p></article></main><time datetime='2024-01-02'></time></body>"
    assert text.extract_article(page) == ("A & B", "One two", "2024-01-02")
    assert text.extract_article(None) == ("", "", None)


def test_html_keeps_long_texts_whole(spark):
    words = "word " * 12_000 + "end"
    page = f"<body><p>{words}</p></body>"
    assert text.extract_article(page)[1] == words and text.extract_article(page, 100)[1] == words[:100]
    assert spark.createDataFrame([(page,)], "h string").select(text.html_article("h").alias("a")).first()["a"]["text"] == words


def test_archetypes_and_bins(spark):
    rows = spark.createDataFrame([(0.1, 0.2), (1.0, 1.0), (1.0, -1.0), (-1.0, 1.0), (-1.0, -1.0), (None, 1.0)], "p double, m double")
    assert [r[0] for r in rows.select(stats.archetype("p", "m")).collect()] == ["neutral", "hero", "villain", "victim", "nuisance", None]
    edges = spark.createDataFrame([(-2.0,), (2.0,), (9.0,), (-1.5,), (0.0,)], "v double")
    assert [r[0] for r in edges.select(stats.score_bin("v")).collect()] == [1, 8, 8, 2, 5]


def test_guarded_r(spark):
    rows = spark.createDataFrame([("flat", float(i), 1.0) for i in range(12)] + [("nine", float(i), float(i)) for i in range(9)] + [("ten", float(i), -float(i)) for i in range(10)] + [("ten", None, 5.0)], "g string, x double, y double")
    found = {r["g"]: r["r"] for r in rows.groupBy("g").agg(stats.guarded_r("x", "y", 10).alias("r")).collect()}
    assert found["flat"] is None and found["nine"] is None and found["ten"] == pytest.approx(-1)


def test_pettitt(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    series = {"shift": np.r_[rng.normal(0.5, 0.15, 30), rng.normal(-1, 0.15, 30)], "noise": rng.normal(size=60), "seven": np.arange(7.0)}
    rows = [(k, i, float(v)) for k, s in series.items() for i, v in enumerate(s)] + [("shift", 100, None)]
    out = {r["k"]: r for r in narrative.pettitt(spark.createDataFrame(rows, "k string, t int, value double"), ("k",), order="t").collect()}
    assert abs(out["shift"]["changepoint"] - 30) <= 2 and out["shift"]["p_value"] < 0.01 and out["noise"]["p_value"] > 0.05 and "seven" not in out


def test_expanding_z_and_islands(spark):
    rows = spark.createDataFrame([(1, f"2024-01-{d:02d}", v) for d, v in ((1, 1.0), (8, 1.2), (15, 0.9), (22, 5.0))], "entity_id int, period_start string, value double")
    rows = rows.withColumn("period_start", rows["period_start"].cast("date"))
    out = rollups.expanding_z(rows).orderBy("period_start").collect()
    assert [r["flagged"] for r in out] == [False, True] or [r["flagged"] for r in out] == [True, True]


def test_results(spark):
    def line(content, status=200):
        return json.dumps({"custom_id": "a1", "response": {"status_code": status, "body": {"choices": [{"message": {"content": content}}]}}})

    good = line(json.dumps({"source_country": "FR", "entities": [{"entity": " X ", "entity_type": "person", "power_score": 1, "moral_score": "-9"}, {"entity": "", "entity_type": "person"}]}))
    mentions, rejects = readers.parse_results(spark.createDataFrame([(good,), (line("not json"),), (line("{}", 500),), ("junk",)], "value string"))
    assert [tuple(r) for r in mentions.collect()] == [("a1", "FR", "X", "person", 1.0, -2.0)]
    assert sorted(r["reason"] for r in rejects.collect()) == ["content is not a result", "failed request", "not a result line"]


def test_catalog_and_toplines(spark, tmp_path):
    feeds = readers.feed_catalog(spark, [{"name": "A", "rss_feeds": ["https://a.com/1", "https://b.a.com/2"]}, {"name": "B", "rss_feeds": []}])
    assert feeds.count() == 2 and [tuple(r) for r in readers.domain_map(feeds).collect()] == [("a.com", "A")]
    (tmp_path / "p.csv").write_text("series,entity_name,field_start,field_end,value_pct,source_url\ns,X,2024-01-01,2024-01-09,41.5,u\n")
    assert readers.read_toplines(spark, str(tmp_path / "p.csv")).first()["value_pct"] == 41.5


def test_writes(spark, tmp_path):
    long = "x" * 500
    rows = spark.createDataFrame([("http://a", "t\x00" * 300, long), ("http://a", "t", long), ("http://b", "t", "short"), (None, "t", long)], "url string, title string, text string")
    good, bad = writers.valid_articles(rows)
    assert good.count() == 2 and sorted(r["reason"] for r in bad.collect()) == ["text", "url"] and good.first()["title"] == "t" * 300
    assert writers.new_rows(good, good.limit(0)).count() == 1 and writers.new_rows(good, good).count() == 0
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in writers.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    path = str(tmp_path / "t")
    writers.replace_partitions(old, path, "k")
    writers.replace_partitions(new, path, "k")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    log, out = writers.remap(old, spark.createDataFrame([("a", "z")], "old string, new string"), "v", "k")
    assert [tuple(r) for r in log.collect()] == [(1, "a", "z")] and sorted(tuple(r) for r in out.collect()) == [(1, "z"), (2, "b")]
    counters = spark.createDataFrame([("a", 2)], "name string, value long")
    assert sorted(tuple(r) for r in writers.increment(counters, "b", 3).collect()) == [("a", 2), ("b", 3)]
    floats = spark.createDataFrame([(1, 0.123456, float("nan"))], "k int, x double, y double")
    assert json.loads(floats.select(writers.rounded_json(floats)).first()[0]) == {"k": 1, "x": 0.1235}
    writers.export_snapshots(floats, str(tmp_path / "s"), "k", ["x"])
    assert spark.read.text(str(tmp_path / "s")).count() == 1
    writers.publish(old, str(tmp_path / "v"), "published")
    assert spark.table("published").count() == 2


def test_states(spark):
    rows = spark.createDataFrame([(1, "failed", 2), (2, "failed", None), (3, "completed", None)], "id int, status string, attempts int")
    assert sorted(tuple(r) for r in writers.requeue(rows).collect()) == [(1, "retired", 3), (2, "unanalyzed", 1), (3, "completed", 0)]


def test_stream_ingest_is_idempotent(spark, tmp_path):
    from parlance.streaming import jobs

    schema = "url string, title string, text string"
    source = str(tmp_path / "in")
    spark.createDataFrame([("http://a", "t", "x" * 600), ("http://b", "t", "no")], schema).write.parquet(source)
    table, rejects = str(tmp_path / "table"), str(tmp_path / "rejects")
    kept = "url string, title string, text string, id string"
    for run in range(2):
        jobs.ingest(spark.readStream.schema(schema).parquet(source), table, rejects, kept, str(tmp_path / f"c{run}")).awaitTermination()
    assert spark.read.parquet(table).count() == 1


def test_neighbours_in_blocks_are_the_same(spark):
    from parlance.operators import similarity

    rows = spark.range(60).selectExpr("id vec_id", "transform(sequence(1, 6), i -> double((id * i * 7) % 11) - 5) embedding")
    queries = rows.where("vec_id % 7 = 0").select("vec_id")
    one = similarity.cosine_neighbours(rows, queries).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, similarity.cosine_neighbours(rows, queries, block=2).collect())) and len(one) == 45


def test_detection(spark):
    rows = spark.createDataFrame([("https://www.bbc.co.uk/x", "T", "b"), ("https://a.example.com/x", "Story | The Daily", "b"), ("https://a.example.com/x", "T", "PARIS (Reuters) - It"), ("https://a.example.com/x", None, None)], "u string, t string, b string")
    from pyspark.sql import functions as F

    known = F.create_map(F.lit("bbc.co.uk"), F.lit("BBC"))
    assert [r[0] for r in rows.select(text.detect_source("u", "t", "b", known)).collect()] == ["BBC", "The Daily", "Reuters", "Example"]
    assert [r[0] for r in rows.select(text.is_news_site("u")).collect()] == [True, False, False, False]


def test_streamed_state_equals_batch(spark, small, tmp_path):
    import math

    from pyspark.sql import functions as F

    from parlance.streaming import jobs

    stats_ = jobs.trailing_stats(jobs.events(spark, small))
    jobs.upsert_to_table(stats_, str(tmp_path / "t"), ["window_end", "event_type"], str(tmp_path / "c"), "trailing").awaitTermination()
    batch = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    want = batch.groupBy(F.window("ts", "7 days", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.end", "event_type", "n")
    assert sorted(tuple(r) for r in spark.table("global_temp.trailing").select("window_end", "event_type", "n").collect()) == sorted(tuple(r) for r in want.collect())
    out = {r["user_id"]: r for r in jobs.run_to_table(jobs.decayed_sums(jobs.events(spark, small)), str(tmp_path / "rows"), str(tmp_path / "d"), "update").collect()}
    rows = batch.select("user_id", "ts", "value").collect()
    user = min(out)
    last = max(r["ts"] for r in rows if r["user_id"] == user)
    weight = sum(math.exp(-(last - r["ts"]).total_seconds() / (14 * 86400)) for r in rows if r["user_id"] == user)
    assert out[user]["weight"] == pytest.approx(weight, rel=1e-6)
