"""More registered queries: type mapping, lookups, baselines, re-sliced series, merge groups, feeds and costs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..fixtures import SQL, TYPES, _sql_case
from ..functions import text as T
from ..operators import entities, ledger, lookups, merging, narrative, publishers, rollups, similarity, source_vectors, tracking
from ..session import shared_dir
from ..sources import versions
from ..streaming import jobs, leases
from .queries import AVGS, COUNTRY, END, ENTITY, ORACLES, QUARTER, SERIES, SOURCE, T2, YEAR, guarded, quarter_cells, query, r, source_series

LABELS = [
    "Person", " political leader ", "political_leader", "Sovereign State", "people", "criminal_organization", "police_officer", "sports team", "Regional Bloc", "trade bloc", "tech company", "central bank",
    "presidential election", "trade war", "city", "geological formation", "think tank", "broadcaster", "currency", "sport", "unknown", "concept", "", "COUNTRY", "identity group", "government agency", "major corporation", "news media",
]
_PARTS = " ".join(f"WHEN regexp_matches(t, '{'|'.join(parts)}') THEN '{kind}'" for parts, kind in [(T.COLLECTIVE, "organization"), *T.TYPES_OF_PARTS])
_KNOWN = " ".join(f"WHEN t = '{label}' THEN '{kind}'" for label, kind in [*((x, x) for x in T.ENTITY_TYPES), *T.TYPES_OF_LABELS.items()])


@query("type_mapping", f"""WITH l AS (SELECT unnest({LABELS}) AS label UNION ALL SELECT DISTINCT p_type FROM part), t AS (SELECT label, replace(lower(trim(label)), ' ', '_') AS t FROM l)
SELECT label, CASE {_KNOWN} {_PARTS} ELSE 'concept' END AS entity_type FROM t""", with_views=False)
def _(t):
    labels = t.spark.createDataFrame([(x,) for x in LABELS], "label string").unionByName(t.table("part").select(F.col("p_type").alias("label")).distinct())
    return labels.select("label", T.map_type("label").alias("entity_type"))


NAMES = [
    ("President Joe Smith", "person"), ("prime minister  Ann Lee", "political_leader"), ("Dr. Sir Tom Hill", None), ("General Mills", "company"), ("“North Sea”. ", "concept"), ("People: Li Na", "person"),
    ("Star Trek: Picard", "concept"), ("Green Party (GP)", "organization"), ("Muslim League (N)", "organization"), ("Old Party (UBT)", "organization"), ("Left Front (Maoist)", "organization"), ("Samsung Electronics Co., Ltd", "business"),
    ("Tesla, Inc", "organization"), ("Nvidia Corporation", "organization"), ("News Corp", "organization"), ("Blue Sky Corp.", "business"), ("Mars, Incorporated", "organization"), ("Mars, Incorporated", "concept"), ("u.s.", "country"), ("EU", None), ("", "person"),
]
_W = {k: "|".join(v).replace(".", r"\.") for k, v in (("titles", sorted(T.TITLES, key=len, reverse=True)), ("categories", T.CATEGORIES), ("endings", T.ENDINGS), ("short", T.SHORT_ENDINGS))}
_S = lambda x: "'" + x.replace("'", "''") + "'"
_ENDINGS = rf"(?:(?:,\s*|\s+)(?:{_W['endings']})\.?|,\s*(?:{_W['short']})\.?)+$"
_GIVEN = ", ".join(f"({_S(n)}, {_S(k) if k is not None else 'NULL'})" for n, k in NAMES)
_ALIASES = " ".join(f"WHEN {_S(a)} THEN {_S(c)}" for a, c in T.ALIASES.items())


@query("name_normalize", rf"""WITH n AS (SELECT p_name AS given, {_sql_case("p_type", TYPES)} AS kind FROM part UNION ALL SELECT * FROM (VALUES {_GIVEN})),
a AS (SELECT given, kind, trim(regexp_replace(translate(given, '’‘“”', '''''""'), '\s+', ' ', 'g'), ' "''.,;:') AS s FROM n),
b AS (SELECT given, kind, regexp_replace(s, '^(?:{_W["categories"]})\s*:\s+', '', 'i') AS s FROM a),
c AS (SELECT given, kind, s, regexp_extract(s, '\(([^()\s]{{2,12}})\)$', 1) AS mark FROM b),
d AS (SELECT given, kind, CASE WHEN length(regexp_replace(mark, '[^A-Z]', '', 'g')) >= 2 AND lower(mark) NOT IN ('ubt', 'sp') THEN regexp_replace(s, '\s*\([^()\s]*\)$', '') ELSE s END AS s FROM c),
e AS (SELECT given, kind, CASE WHEN kind IN ('organization', 'organisation', 'business', 'company', 'political_party') AND lower(s) NOT IN ('mars, incorporated', 'mars inc') THEN
  regexp_replace(regexp_replace(regexp_replace(s, '{_ENDINGS}', '', 'i'), '^(\S+\s.*\S)\s+(?:{_W["short"]})\.?$', '\1', 'i'), '{_ENDINGS}', '', 'i') ELSE s END AS s FROM d),
f AS (SELECT given, kind, CASE WHEN coalesce(kind, '') IN ('', 'person', 'political_leader') THEN regexp_replace(s, '^(?:(?:{_W["titles"]})\.?\s+)+', '', 'i') ELSE s END AS s FROM e)
SELECT given, kind, CASE lower(s) {_ALIASES} ELSE s END AS name FROM f""", with_views=False)
def _(t):
    rows = t.entities.select(F.col("name").alias("given"), F.col("entity_type").alias("kind")).unionByName(t.spark.createDataFrame(NAMES, "given string, kind string"))
    return rows.withColumn("name", T.normalize_name("given", "kind"))


SITES = ["https://www.nytimes.com/2024/a", "http://edition.CNN.com/x", "https://abcnews.go.com/y", "https://example.org/cnn.com", "ftp://m.time.com", "no url", "https://sometimes.com/"]


@query("news_sites", f"""WITH u AS (SELECT url FROM pages UNION ALL SELECT unnest({SITES})), h AS (SELECT url, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) AS h FROM u)
SELECT url, len(list_filter({T.NEWS_DOMAINS}, lambda d: contains(h, d))) > 0 AS news FROM h""", with_views=False)
def _(t):
    urls = t.table("pages").select("url").unionByName(t.spark.createDataFrame([(x,) for x in SITES], "url string"))
    return urls.select("url", T.is_news_site("url").alias("news"))


@query("source_by_name", "d AS (SELECT * FROM sources WHERE source ILIKE '%nation_1%' ORDER BY source_id LIMIT 1) SELECT * FROM d")
def _(t):
    return lookups.source_like(t.sources, "Nation_1")


@query("resolve_names", """n AS (SELECT DISTINCT upper(name) AS name FROM entities UNION SELECT 'nobody'), k AS (SELECT raw_id AS id, count(*) AS k FROM mentions GROUP BY raw_id)
SELECT name, id, coalesce(canonical_id, id) AS entity_id FROM n LEFT JOIN (SELECT lower(name) AS key, id, canonical_id, row_number() OVER (PARTITION BY lower(name) ORDER BY coalesce(k, 0) DESC, id) AS place FROM entities LEFT JOIN k USING (id)) b ON lower(n.name) = b.key AND place = 1""")
def _(t):
    names = t.entities.select(F.upper("name").alias("name")).unionByName(t.spark.createDataFrame([("nobody",)], "name string"))
    return lookups.resolve_names(names, t.mentions, t.entities)


_MEANS = "SELECT entity_id, name, avg(moral) AS value FROM mentions JOIN entities ON id = entity_id WHERE moral IS NOT NULL AND {where} GROUP BY ALL"


@query("baseline_match", f"""a AS ({_MEANS.format(where=f"source_id = {SOURCE}")}), b AS ({_MEANS.format(where=f"country = '{COUNTRY}' AND publish_date BETWEEN DATE '{END}' - 14 AND DATE '{END}'")}), f AS ({_MEANS.format(where=f"publish_date = DATE '{END}'")}),
bn AS (SELECT lower(name) AS key, arg_min(value, entity_id) AS value FROM b GROUP BY lower(name))
SELECT a.entity_id, a.name, {r('a.value')} AS value, {r('coalesce(b.value, bn.value, f.value)')} AS baseline, CASE WHEN b.value IS NOT NULL THEN 'id' WHEN bn.value IS NOT NULL THEN 'name' WHEN f.value IS NOT NULL THEN 'fallback' ELSE 'none' END AS matched
FROM a LEFT JOIN b ON b.entity_id = a.entity_id LEFT JOIN bn ON bn.key = lower(a.name) LEFT JOIN f ON f.entity_id = a.entity_id""")
def _(t):
    names = t.entities.select(F.col("id").alias("entity_id"), "name")
    rows = t.mentions.where("moral IS NOT NULL")
    means = lambda where: rows.where(where).groupBy("entity_id").agg(F.avg("moral").alias("value")).join(names, "entity_id")
    # a country's last two weeks, which lack some entities, else the last day of all countries, which lacks others
    recent = F.col("publish_date").between(F.date_sub(F.lit(END).cast("date"), 14), END)
    return lookups.with_baseline(means(F.col("source_id") == SOURCE), means((F.col("country") == COUNTRY) & recent), means(F.col("publish_date") == END))


_DAILY = "d AS (SELECT {key} AS key, publish_date AS day, avg(moral) AS value, count(*) AS n FROM mentions GROUP BY ALL), w AS (SELECT d.*, days FROM d, (SELECT unnest([7, 30, 90])::INT AS days) WHERE date_diff('day', day, DATE '" + QUARTER + "') BETWEEN 0 AND days - 1)"


@query("resliced_entities", _DAILY.format(key="entity_id") + f" SELECT key, days, {r('sum(value * n) / sum(n) FILTER (WHERE value IS NOT NULL)')} AS value, sum(n)::BIGINT AS n FROM w GROUP BY ALL")
def _(t):
    base = t.mentions.groupBy(F.col("entity_id").alias("key"), F.col("publish_date").alias("day")).agg(F.avg("moral").alias("value"), F.count("*").alias("n"))
    return lookups.resliced(base, QUARTER)


@query("resliced_sources", _DAILY.format(key="source_id") + f" SELECT key, days, {r('avg(value)')} AS value, sum(n)::BIGINT AS n FROM w GROUP BY ALL")
def _(t):
    base = t.mentions.groupBy(F.col("source_id").alias("key"), F.col("publish_date").alias("day")).agg(F.avg("moral").alias("value"), F.count("*").alias("n"))
    return lookups.resliced(base, QUARTER, weighted=False)


@query("compatible_merges", """k AS (SELECT id, name, CASE WHEN entity_type IN ('person', 'concept', 'event') THEN 0 WHEN entity_type IN ('organization', 'business', 'country') THEN 1 END AS grp, count(mention_id) AS k FROM entities LEFT JOIN mentions ON raw_id = id GROUP BY ALL)
SELECT name, grp, arg_max(id, (k, -id)) AS kept, count(*) - 1 AS merged, sum(k)::BIGINT AS mentions FROM k WHERE grp IS NOT NULL GROUP BY name, grp HAVING count(*) > 1""")
def _(t):
    return lookups.merge_groups(t.mentions, t.entities, (("person", "concept", "event"), ("organization", "business", "country")))


for _scope, _where in (("all", "true"), ("global", "source_id IS NULL"), ("source", "source_id IS NOT NULL")):

    @query(f"drift_feed_{_scope}", "SELECT * FROM (" + ORACLES["drift_events"] + f") WHERE {_where} ORDER BY p_value, entity_id, source_id NULLS FIRST LIMIT 20", with_views=False)
    def _(t, scope=_scope):
        return lookups.drift_feed(entities.rounded(narrative.drift_events(quarter_cells(t))), scope)


@query("daily_spend", "SELECT round(coalesce(sum(value), 0), 6) AS spend FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' AND ts <= TIMESTAMP '2024-01-15 18:30:00'", with_views=False)
def _(t):
    return lookups.spend_since_midnight(t.table("events").select(F.col("value").alias("cost"), F.col("ts").alias("submitted_at")), "2024-01-15 18:30:00")


@query("batch_costs", "SELECT source, round(0.5 * (sum(strlen(coalesce(text, ''))) / 4 * 0.05 + count(*) * 1000 * 0.4) / 1000000, 6) AS cost FROM documents GROUP BY source", with_views=False)
def _(t):
    sizes = t.table("documents").groupBy("source").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("b"), F.count("*").alias("n"))
    return sizes.select("source", lookups.batch_cost(F.col("b"), F.col("n"), 0.05, 0.4).alias("cost"))


@query("json_events", "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE coalesce(json_extract_string(props, '$.k'), '') <> '3'", with_views=False)
def _(t):
    k = F.get_json_object("props", "$.k")
    return t.table("events").where(F.coalesce(k, F.lit("")) != "3").select("event_id", "event_type", k.cast("long").alias("k"))


@query("source_top_entities", f"d AS (SELECT entity_id, {AVGS} FROM mentions WHERE source_id = {SOURCE} AND publish_date BETWEEN '{YEAR}' AND '{END}' GROUP BY entity_id) SELECT d.*, name FROM d JOIN entities ON id = entity_id ORDER BY mentions DESC, entity_id LIMIT 20")
def _(t):
    top = entities.trending(t.mentions.where(F.col("source_id") == SOURCE), t.entities, start=YEAR, end=END, limit=20)
    return top.select("entity_id", "mentions", "avg_power", "avg_moral", "name")


@query("corpus_recent", f"""a AS (SELECT count(*) FILTER (WHERE publish_date > DATE '{END}' - 1) AS last_day, count(*) FILTER (WHERE publish_date > DATE '{END}' - 7) AS last_week FROM articles WHERE publish_date <= '{END}'),
s AS (SELECT string_agg(source || '=' || n, ';' ORDER BY n DESC, source) AS top_sources FROM (SELECT source, count(*) AS n FROM articles GROUP BY source ORDER BY n DESC, source LIMIT 5)),
e AS (SELECT string_agg(entity_id || '=' || n, ';' ORDER BY n DESC, entity_id) AS top_entities FROM (SELECT entity_id, count(*) AS n FROM mentions GROUP BY entity_id ORDER BY n DESC, entity_id LIMIT 5)),
l AS (SELECT count(text) AS with_text, round(avg(length(text)), 6) AS avg_length, max(length(text)) AS max_length FROM documents)
SELECT * FROM a, s, e, l""")
def _(t):
    old = t.articles.where(F.col("publish_date") <= END)
    recent = old.agg(*[F.count_if(F.datediff(F.lit(END).cast("date"), "publish_date") < d).alias(n) for n, d in (("last_day", 1), ("last_week", 7))])

    def top(rows, key, name):
        best = rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(5)
        ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(key).alias("key"))))
        return best.agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["key"].cast("string"), F.lit("="), (-x["m"]).cast("string"))), ";").alias(name))

    texts = t.table("documents").agg(F.count("text").alias("with_text"), F.avg(F.length("text")).alias("avg_length"), F.max(F.length("text")).alias("max_length"))
    # tables of one row
    return recent.crossJoin(top(t.articles, "source", "top_sources")).crossJoin(top(t.mentions, "entity_id", "top_entities")).crossJoin(texts)


_SLIDING = ORACLES["tracking_sliding_mean"]


@query("tracking_chart", f"""SELECT publish_date, value, mentions FROM (SELECT *, row_number() OVER (ORDER BY publish_date) - 1 AS i, count(*) OVER () AS n FROM ({_SLIDING})) WHERE i % CASE WHEN n > 30 THEN n // 30 + 1 ELSE 1 END = 0""", with_views=False)
def _(t):
    return narrative.tracking(t.mentions, ENTITY)


@query("kde_source_or_histogram", f"""s AS (SELECT source_id, moral AS x, count(*) OVER w AS n, stddev_samp(moral) OVER w * pow(count(*) OVER w, -0.2) AS h FROM mentions WHERE entity_id = {ENTITY} AND moral IS NOT NULL WINDOW w AS (PARTITION BY source_id)),
k AS (SELECT *, n >= 5 AND coalesce(h, 0) > 1e-9 AS smooth FROM s), g AS (SELECT unnest(range(0, 121))::INT AS i),
v AS (SELECT source_id, n, least(19, floor(round((x + 2) * 5, 9)))::INT AS bin FROM k WHERE NOT smooth), b AS (SELECT source_id, bin, count(*) / any_value(n) / 0.2::DOUBLE AS d FROM v GROUP BY source_id, bin),
f AS (SELECT DISTINCT source_id FROM b), e AS (SELECT f.source_id, m.bin, coalesce(b.d, 0) AS d FROM f CROSS JOIN (SELECT unnest(range(0, 20))::INT AS bin) m LEFT JOIN b ON b.source_id = f.source_id AND b.bin = m.bin)
SELECT source_id, i, {r('sum(exp(-0.5 * ((i / 30::DOUBLE - 2 - x) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi()))')} AS density FROM k, g WHERE smooth GROUP BY source_id, i
UNION ALL SELECT f.source_id, i, {r('CASE WHEN i BETWEEN 3 AND 117 THEN lo.d + (coalesce(hi.d, lo.d) - lo.d) * ((i - 3) % 6) / 6::DOUBLE ELSE 0 END')} AS density
FROM f CROSS JOIN g LEFT JOIN e lo ON lo.source_id = f.source_id AND lo.bin = (i - 3) // 6 AND i >= 3 LEFT JOIN e hi ON hi.source_id = f.source_id AND hi.bin = (i - 3) // 6 + 1 AND i >= 3""")
def _(t):
    return narrative.density(t.mentions, ENTITY, layer="source_id", bins=20)


@query("poll_lead_lag", f"""p AS (SELECT o_orderkey % 40 AS entity_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS lo, max(o_totalprice) AS value_pct FROM orders GROUP BY ALL), sh AS (SELECT unnest(range(-6, 7))::INT AS shift),
dm AS (SELECT entity_id, publish_date, sum(moral) AS s, count(moral) AS k FROM mentions GROUP BY ALL),
rd AS (SELECT p.entity_id, shift, lo, value_pct, sum(s) / nullif(sum(k), 0) AS reading FROM p CROSS JOIN sh JOIN dm ON dm.entity_id = p.entity_id AND publish_date BETWEEN lo - shift * 30 - 30 AND lo - shift * 30 + 7 + 30 GROUP BY ALL),
rk AS (SELECT entity_id, shift, rank() OVER (PARTITION BY entity_id, shift ORDER BY value_pct) + (count(*) OVER (PARTITION BY entity_id, shift, value_pct) - 1) / 2 AS x, rank() OVER (PARTITION BY entity_id, shift ORDER BY reading) + (count(*) OVER (PARTITION BY entity_id, shift, reading) - 1) / 2 AS y FROM rd WHERE reading IS NOT NULL)
SELECT entity_id, shift, {r(guarded('x', 'y', 4))} AS rho, count(*) AS n FROM rk GROUP BY entity_id, shift HAVING count(*) >= 4""")
def _(t):
    # the dearest order of each entity and month is its poll
    month = F.to_date(F.date_trunc("month", "o_orderdate"))
    polls = t.table("orders").groupBy((F.col("o_orderkey") % 40).alias("entity_id"), month.alias("field_start")).agg(F.max("o_totalprice").alias("value_pct"))
    polls = polls.withColumns({"field_end": F.date_add("field_start", 7), "poll_id": F.col("field_start")})
    return similarity.poll_lead_lag(polls, t.mentions)


@query("source_drift_top", f"""SELECT *, round(sum(abs(change)) OVER (), 6) AS total_change FROM (SELECT * FROM ({ORACLES['weekly_drift']}) WHERE source_id = {SOURCE} AND period_start >= DATE '{YEAR}') d
WHERE entity_id IN (SELECT entity_id FROM ({ORACLES['weekly_drift']}) WHERE source_id = {SOURCE} AND period_start >= DATE '{YEAR}' GROUP BY entity_id ORDER BY sum(n) DESC, entity_id LIMIT 20)""", with_views=False)
def _(t):
    # the changes as they are published, to 6 places
    return lookups.source_drift(entities.rounded(rollups.period_drift(quarter_cells(t))), SOURCE, YEAR)


@query("repeated_names", "d AS (SELECT name, count(*) AS members, array_to_string(list(entity_type ORDER BY id), '|') AS types, array_to_string(list(id ORDER BY id), '|') AS ids FROM entities GROUP BY name HAVING count(*) > 1 ORDER BY members DESC, name LIMIT 20) SELECT * FROM d")
def _(t):
    return lookups.repeated_names(t.entities).withColumns({"types": F.array_join("types", "|"), "ids": F.array_join("ids", "|")})


@query("duplication", "n AS (SELECT name, count(*) AS n FROM entities GROUP BY name) SELECT sum(n)::BIGINT AS entities, count(name) AS names, count(*) FILTER (WHERE n > 1) AS repeated, round((sum(n) - count(name)) * 100::DOUBLE / sum(n), 6) AS duplicate_pct FROM n")
def _(t):
    return lookups.duplication(t.entities)


@query("latest_batches", "d AS (SELECT CAST(date_trunc('month', scraped_at) AS DATE) AS batch, max(scraped_at) AS last_attempt, count(*) AS articles FROM articles GROUP BY batch ORDER BY last_attempt DESC, batch LIMIT 5) SELECT * FROM d")
def _(t):
    return lookups.latest_batches(t.articles.withColumn("batch", F.to_date(F.date_trunc("month", "scraped_at"))), "batch", "scraped_at")


@query("synchrony_all", SERIES + f""", pr AS (SELECT a.source_id AS x, b.source_id AS y, {guarded('a.change', 'b.change', 5)} AS r FROM ch a JOIN ch b ON a.period_start = b.period_start AND a.source_id < b.source_id GROUP BY ALL)
SELECT 'all' AS grp, {r('abs(avg(r))')} AS synchrony, count(*) AS pairs FROM pr WHERE r IS NOT NULL HAVING count(*) > 0""")
def _(t):
    # what each group's synchrony is held against
    return narrative.synchrony(source_series(t), t.sources.select("source_id", F.lit("all").alias("grp")), group="grp")


# merges, leases and published tables ----------------------------------------------------------------------------


def _merge_job(t):
    """All parts as canonical entities; every seventh name has a label before it that normalisation takes off."""
    named = F.when(F.col("id") % 7 == 0, F.concat(F.lit("People: "), "name")).otherwise(F.col("name"))
    return merging.merge_entities(t.entities.select("id", named.alias("name"), "entity_type", F.lit(None).cast("long").alias("canonical_id")), t.mentions)


MERGES = """e AS (SELECT id, name AS display, CASE WHEN id % 7 = 0 THEN 'People: ' || name ELSE name END AS name, count(mention_id) AS k FROM entities LEFT JOIN mentions ON raw_id = id GROUP BY ALL),
w AS (SELECT *, first_value(id) OVER (PARTITION BY lower(display) ORDER BY k DESC, id) AS winner, min(CASE WHEN name = display THEN id END) OVER (PARTITION BY lower(display)) AS plain FROM e),
n AS (SELECT *, id = winner AND name <> display AS renamed, count(*) OVER (PARTITION BY name) AS alike FROM w),
p AS (SELECT (SELECT max(id) FROM e) + row_number() OVER (ORDER BY id) AS id, name, id AS canonical_id FROM n WHERE renamed AND plain IS NULL AND alike = 1),
s AS (SELECT plain AS id, name FROM n WHERE renamed AND plain IS NOT NULL)
"""


@query("merge_job_entities", MERGES + """SELECT n.id, CASE WHEN renamed THEN display ELSE coalesce(s.name, n.name) END AS name, CASE WHEN n.id <> winner THEN winner END AS canonical_id FROM n LEFT JOIN s ON s.id = n.id UNION ALL SELECT id, name, canonical_id FROM p""")
def _(t):
    return _merge_job(t).entities.select("id", "name", "canonical_id")


@query("merge_job_undone", """SELECT id, CASE WHEN id % 7 = 0 THEN 'People: ' || name ELSE name END AS name, NULL::BIGINT AS canonical_id FROM entities""")
def _(t):
    done = _merge_job(t)
    return merging.undo(done.entities, done.log).select("id", "name", "canonical_id")


@query("names_by_alias_table", """a AS (SELECT lower(a.name) AS alias, min(c.name) AS canonical FROM entities a JOIN entities c ON c.id = a.canonical_id GROUP BY 1)
SELECT id, coalesce(canonical, name) AS name FROM entities LEFT JOIN a ON alias = lower(name)""")
def _(t):
    # the table of aliases is the tables' own: names of aliases, and of what they stand for
    known = t.entities.select(F.col("id").alias("canonical_id"), F.col("name").alias("canonical"))
    aliases = t.entities.where("canonical_id IS NOT NULL").select("canonical_id", F.col("name").alias("alias")).join(known, "canonical_id")
    return T.with_aliases(t.entities.select("id", "name"), aliases)


@query("stream_lease_attempts")
def _(t):
    place = f"{shared_dir(t.spark)}/lease_attempts_{uuid.uuid4().hex}"
    key = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(key)
    try:
        rows = leases.lease_attempts(jobs.events(leases.with_rocksdb(t.spark), t.sf_dir))
        return jobs.run_to_table(rows, f"{place}/rows", f"{place}/checkpoint")
    finally:
        t.spark.conf.set(key, before)


@query("published_cells", "c AS (SELECT source_id, entity_id, count(*) AS n FROM mentions GROUP BY ALL) SELECT * FROM c")
def _(t):
    root = f"{shared_dir(t.spark)}/cells_{uuid.uuid4().hex}"
    cells = t.mentions.groupBy("source_id", "entity_id").agg(F.count("*").alias("n"))
    for part in (cells.where("n > 1"), cells):
        versions.publish(part, root)
    return versions.read_current(t.spark.newSession(), root)


def _snapshots(t):
    root = f"{shared_dir(t.spark)}/snapshots_{uuid.uuid4().hex}"
    own = t.mentions.select("entity_id", "source_id", "country", "publish_date", "power", "moral")
    stats = [F.avg("power").alias("avg_power"), F.avg("moral").alias("avg_moral"), F.count("*").alias("mentions")]
    kinds = {k: (own.groupBy(key, "publish_date").agg(*stats), key, ["publish_date"]) for k, key in (("entity", "entity_id"), ("source", "source_id"), ("country", "country"))}
    return root, versions.export_all(kinds, root)


@query("snapshot_manifest", " UNION ALL ".join(
    f"SELECT '{k}' AS kind, count(DISTINCT {key}) AS files, count(*) AS rows, 0::BIGINT AS skipped FROM (SELECT DISTINCT {key}, publish_date FROM mentions) WHERE {key} IS NOT NULL" for k, key in (("entity", "entity_id"), ("source", "source_id"), ("country", "country"))))
def _(t):
    return _snapshots(t)[1].drop("checksum")


@query("snapshot_files", f"SELECT country, publish_date, round(avg(power), 4) + 0.0 AS avg_power, round(avg(moral), 4) + 0.0 AS avg_moral, count(*) AS mentions FROM mentions GROUP BY ALL")
def _(t):
    root, _ = _snapshots(t)
    rows = versions.read_snapshots(t.spark, root, "country").select(F.from_json("value", "country string, publish_date date, avg_power double, avg_moral double, mentions long").alias("r"))
    return rows.select("r.*")


# tracks of clusters ---------------------------------------------------------------------------------------------

LINKED = 0.4
TRACKS = SQL.replace("WITH", "WITH RECURSIVE", 1) + f"""c AS (SELECT (publish_date - DATE '{YEAR}') // 30 AS interval, entity_id, source_id, avg((power + moral) / 2) AS value FROM mentions WHERE publish_date >= DATE '{YEAR}' AND publish_date < DATE '{END}' AND power IS NOT NULL AND moral IS NOT NULL GROUP BY ALL),
nm AS (SELECT interval, entity_id, sqrt(sum(value * value)) AS norm FROM c GROUP BY ALL HAVING count(*) >= 3 AND sqrt(sum(value * value)) > 1e-9), u AS (SELECT interval, entity_id, source_id, value / norm AS v FROM c JOIN nm USING (interval, entity_id)),
e AS (SELECT a.interval, a.entity_id AS a, b.entity_id AS b FROM u a JOIN u b ON a.interval = b.interval AND a.source_id = b.source_id AND a.entity_id < b.entity_id GROUP BY ALL HAVING round(sum(a.v * b.v), 9) >= {LINKED}),
w AS (SELECT * FROM e UNION ALL SELECT interval, b, a FROM e), walk AS (SELECT interval, a, a AS node FROM w UNION SELECT walk.interval, walk.a, w.b FROM walk JOIN w ON w.interval = walk.interval AND w.a = node),
cl AS (SELECT interval, a AS entity_id, min(node) AS cluster FROM walk GROUP BY ALL), z AS (SELECT interval, cluster, count(*) AS members FROM cl GROUP BY ALL),
k AS (SELECT x.interval, x.cluster, y.cluster AS next, count(*) AS common FROM cl x JOIN cl y ON y.interval = x.interval + 1 AND y.entity_id = x.entity_id GROUP BY ALL),
o AS (SELECT k.*, round(common / (a.members + b.members - common), 12) AS overlap FROM k JOIN z a ON a.interval = k.interval AND a.cluster = k.cluster JOIN z b ON b.interval = k.interval + 1 AND b.cluster = next),
f AS (SELECT interval, cluster, count(*) AS to_clusters FROM o GROUP BY ALL), g AS (SELECT interval + 1 AS interval, next AS cluster, count(*) AS from_clusters FROM o GROUP BY ALL),
s AS (SELECT interval, cluster, next, common FROM o QUALIFY row_number() OVER (PARTITION BY interval, cluster ORDER BY overlap DESC, next) = 1 INTERSECT SELECT interval, cluster, next, common FROM o QUALIFY row_number() OVER (PARTITION BY interval, next ORDER BY overlap DESC, cluster) = 1),
t AS (SELECT interval, cluster, interval || '/' || cluster AS track FROM z WHERE NOT EXISTS (FROM s WHERE s.interval + 1 = z.interval AND s.next = z.cluster) UNION ALL SELECT t.interval + 1, s.next, track FROM t JOIN s ON s.interval = t.interval AND s.cluster = t.cluster),
r AS (SELECT z.interval, z.cluster, members, track, CASE WHEN s.common IS NULL THEN 'birth' ELSE 'continued' END AS event, coalesce(from_clusters, 0) AS from_clusters, coalesce(to_clusters, 0) AS to_clusters, coalesce(s.common, 0) AS kept
  FROM z JOIN t USING (interval, cluster) LEFT JOIN s ON s.interval + 1 = z.interval AND s.next = z.cluster LEFT JOIN f ON f.interval = z.interval AND f.cluster = z.cluster LEFT JOIN g ON g.interval = z.interval AND g.cluster = z.cluster)
"""


def _tracks(t):
    return tracking.tracks(tracking.interval_clusters(t.mentions, YEAR, END, 30, LINKED))


@query("cluster_tracks", TRACKS + "SELECT * FROM r", with_views=False)
def _(t):
    return _tracks(t)


@query("cluster_lives", TRACKS + """SELECT track, min(interval) AS born, CASE WHEN max(interval) < (SELECT max(interval) FROM r) THEN max(interval) + 1 END AS died, count(*) AS intervals, max(members) AS most, count(*) FILTER (WHERE to_clusters > 1) AS splits, count(*) FILTER (WHERE from_clusters > 1) AS merges FROM r GROUP BY track""", with_views=False)
def _(t):
    return tracking.track_lives(_tracks(t))


# sources as vectors ---------------------------------------------------------------------------------------------

VECTORS = f"""c AS (SELECT source_id, entity_id, avg((power + moral) / 2) AS value FROM mentions WHERE publish_date >= DATE '{YEAR}' AND publish_date < DATE '{END}' GROUP BY ALL), ke AS (SELECT entity_id FROM c GROUP BY entity_id HAVING count(*) >= 3),
cc AS (SELECT * FROM c WHERE entity_id IN (FROM ke)), bs AS (SELECT source_id FROM cc GROUP BY source_id HAVING count(*) >= 10), v AS (SELECT * FROM cc WHERE source_id IN (FROM bs) AND value IS NOT NULL)"""


@query("source_bias_profiles", VECTORS + f""", ss AS (SELECT DISTINCT source_id FROM v), o AS (SELECT entity_id, sum(value) / (SELECT count(*) FROM ss) AS overall FROM v GROUP BY entity_id),
g AS (SELECT source_id, entity_id, coalesce(value, 0) AS value, overall, coalesce(value, 0) - overall AS difference FROM ss CROSS JOIN o LEFT JOIN v USING (source_id, entity_id))
SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY round(abs(difference), 9) DESC, entity_id)::INT AS rank, entity_id, {r('value')} AS value, {r('overall')} AS overall, {r('difference')} AS difference FROM g QUALIFY rank <= 10""")
def _(t):
    return source_vectors.bias_profiles(source_vectors.vectors(t.mentions, YEAR, END))


@query("source_density_groups", SQL.replace("WITH", "WITH RECURSIVE", 1) + VECTORS + """, nm AS (SELECT source_id, sqrt(sum(value * value)) AS norm FROM v GROUP BY source_id HAVING sqrt(sum(value * value)) > 1e-9), u AS (SELECT source_id, entity_id, value / norm AS x FROM v JOIN nm USING (source_id)),
e AS (SELECT a.source_id AS a, b.source_id AS b FROM u a JOIN u b ON a.entity_id = b.entity_id AND a.source_id <> b.source_id GROUP BY ALL HAVING round(sum(a.x * b.x), 9) >= 0.6), walk AS (SELECT a AS id, a AS node FROM e UNION SELECT id, b FROM walk JOIN e ON node = a), k AS (SELECT id, min(node) AS root FROM walk GROUP BY id)
SELECT source_id, coalesce(root, -1)::BIGINT AS group_id FROM (SELECT DISTINCT source_id FROM v) LEFT JOIN k ON id = source_id""", with_views=False)
def _(t):
    return source_vectors.density_groups(source_vectors.vectors(t.mentions, YEAR, END))


# ledgers and limited streams ------------------------------------------------------------------------------------

AS_OF = "2001-07-31 12:00:00"


def _ledger(t):
    """Orders as batches: the remote side lists them all, the ledger has two thirds of them, some with an older state."""
    o = t.table("orders").select(F.col("o_orderkey").cast("string").alias("batch_id"), F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("at"), "o_orderstatus", "o_totalprice")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "in_progress").otherwise("expired")
    remote = o.select("batch_id", status.alias("status"), F.when((status == "completed") & (F.col("o_totalprice") > 100_000), F.concat(F.lit("file-"), "batch_id")).alias("output_file_id"), F.col("at").alias("created_at"))
    known = o.where("k % 3 <> 0").select("batch_id", F.when(F.col("k") % 2 == 0, "validating").otherwise(status).alias("status"), F.lit(None).cast("string").alias("output_file_id"), F.col("at").alias("submitted_at"), (F.col("k") % 5 == 0).alias("collected"), F.lit(None).cast("string").alias("error"))
    return known, remote


RECONCILED = f"""WITH o AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS batch_id, o_orderdate::TIMESTAMP AS day, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'in_progress' ELSE 'expired' END AS status, o_totalprice FROM orders),
b AS (SELECT k, batch_id, day, CASE WHEN k % 3 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'validating' ELSE status END END AS old_status, k % 3 <> 0 AND k % 5 = 0 AS collected, status, CASE WHEN status = 'completed' AND o_totalprice > 100000 THEN 'file-' || batch_id END AS output_file_id FROM o),
x AS (SELECT *, CASE WHEN old_status IS NULL THEN CASE WHEN status = 'in_progress' THEN 'adopt' WHEN day >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR THEN CASE WHEN output_file_id IS NOT NULL THEN 'ingest' ELSE 'resolve' END END
  WHEN NOT collected THEN CASE WHEN status <> 'in_progress' THEN CASE WHEN output_file_id IS NOT NULL THEN 'ingest' ELSE 'resolve' END WHEN status <> old_status THEN 'update' END END AS action FROM b)
"""


@query("batch_transitions", RECONCILED + "SELECT batch_id, action, old_status, status, output_file_id, day AS submitted_at FROM x WHERE action IS NOT NULL", with_views=False)
def _(t):
    return ledger.transitions(*_ledger(t), AS_OF)


@query("batch_ledger", RECONCILED + """SELECT batch_id, CASE WHEN action IS NULL THEN old_status ELSE status END AS status, CASE WHEN action IS NOT NULL THEN output_file_id END AS output_file_id, day AS submitted_at, CASE WHEN action IS NULL THEN collected ELSE action IN ('ingest', 'resolve') END AS collected, CASE WHEN action = 'resolve' THEN status END AS error FROM x WHERE action IS NOT NULL OR old_status IS NOT NULL""", with_views=False)
def _(t):
    known, remote = _ledger(t)
    once = ledger.applied(known, ledger.transitions(known, remote, AS_OF))
    # the same listing again changes nothing
    return ledger.applied(once, ledger.transitions(once, remote, AS_OF))


@query("limited_ingest", "SELECT page_id, url FROM pages WHERE contains(url, '/en/') ORDER BY page_id LIMIT 100", with_views=False)
def _(t):
    place = f"{shared_dir(t.spark)}/limited_{uuid.uuid4().hex}"
    # a pattern, so that a table that is one file and one that is a folder are both read
    pages = t.spark.readStream.schema("page_id long, url string").parquet(f"{t.sf_dir}/page[s].parquet")
    return jobs.ingest_matched(pages, F.contains("url", F.lit("/en/")), "page_id", 100, f"{place}/rows", f"{place}/checkpoint")


# summaries, short searches and comparisons ----------------------------------------------------------------------


@query("historical_sentiment", f"""h AS (SELECT publish_date, power, moral FROM mentions WHERE entity_id = {ENTITY} AND publish_date > DATE '{END}' - 2000 AND publish_date <= DATE '{END}')
SELECT publish_date, {AVGS}, false AS overall FROM h GROUP BY publish_date UNION ALL SELECT NULL, {AVGS}, true FROM h""")
def _(t):
    return entities.history(t.mentions, ENTITY, END, 2000)


@query("short_search", """k AS (SELECT entity_id, count(*) AS k FROM mentions GROUP BY entity_id), top AS (SELECT id FROM entities LEFT JOIN k ON entity_id = id WHERE canonical_id IS NULL ORDER BY coalesce(k, 0) DESC, id LIMIT 1000),
h AS (SELECT coalesce(canonical_id, id) AS entity_id, min(CASE WHEN starts_with(lower(name), 're') THEN 1 WHEN contains(lower(name), ' re') THEN 2 ELSE 3 END) AS tier FROM entities WHERE contains(lower(name), 're') AND coalesce(canonical_id, id) IN (FROM top) GROUP BY ALL)
SELECT entity_id, tier, name, entity_type, coalesce(k, 0) AS mentions FROM h JOIN entities ON id = entity_id LEFT JOIN k USING (entity_id) ORDER BY tier, mentions DESC, name, entity_id LIMIT 15""")
def _(t):
    return entities.search_box(t.mentions, t.entities, "re")


@query("corpus_t2_range", T2 + f" SELECT count(t2) AS measured, {r('min(t2)')} AS min_t2, {r('avg(t2)')} AS avg_t2, {r('max(t2)')} AS max_t2 FROM t2")
def _(t):
    return publishers.t2_range(rollups.article_hotelling_t2(t.mentions, rollups.weekly_moments(t.mentions, YEAR, END)))


_PRUNED, _WHICH = ORACLES["entity_prune_candidates"].rsplit("SELECT id, name, mentions, threshold", 1)


@query("prune_stats", f"""{_PRUNED}, p AS (SELECT id{_WHICH}), c AS (SELECT entity_type, coalesce(mentions, 0) AS k, p.id IS NOT NULL AS goes FROM entities LEFT JOIN s USING (id) LEFT JOIN p USING (id) WHERE canonical_id IS NULL)
SELECT entity_type, count(*) AS entities, count(*) FILTER (WHERE goes) AS prunable, {r('count(*) FILTER (WHERE goes) * 100.0::DOUBLE / count(*)')} AS prunable_pct, {r('avg(k) FILTER (WHERE goes)')} AS avg_prunable, {r('avg(k) FILTER (WHERE NOT goes)')} AS avg_kept FROM c GROUP BY entity_type""", with_views=False)
def _(t):
    metadata = F.when(F.col("id") % 5 == 0, F.to_json(F.struct(F.lit("true").alias("preserve"))))
    candidates = entities.prune_candidates(t.mentions, t.entities.withColumn("metadata", metadata), t.articles.select(F.col("scraped_at").alias("day")), END)
    return entities.prune_stats(candidates, t.mentions, t.entities)


for _key in ("country", "source_id"):

    @query(f"decayed_by_{_key}", f"""d AS (SELECT {_key}, power, publish_date, mention_id, greatest(1, round_even(10 * exp(-date_diff('day', publish_date, DATE '{END}') / 90::DOUBLE), 0))::BIGINT AS copies FROM mentions WHERE entity_id = {ENTITY} AND publish_date <= '{END}' AND power IS NOT NULL AND {_key} IS NOT NULL),
g AS (SELECT {_key}, count(*) AS mentions, arg_max(power, (publish_date, mention_id)) AS latest, sum(copies)::BIGINT AS copies, sum(power * copies) / sum(copies) AS mean, sum(power * power * copies) / sum(copies) AS square FROM d GROUP BY {_key})
SELECT {_key}, mentions, {r('latest')} AS latest, copies, {r('CASE WHEN mentions >= 3 THEN mean END')} AS mean, {r('CASE WHEN mentions >= 3 THEN sqrt(greatest(0, round(square - mean * mean, 12))) END')} AS deviation, mentions < 3 AS limited FROM g{" WHERE mentions >= 3 ORDER BY mentions DESC, source_id LIMIT 10" if _key == "source_id" else ""}""")
    def _(t, key=_key):
        return narrative.decayed_by(t.mentions, ENTITY, END, key, 90.0, top=10 if key == "source_id" else None)
