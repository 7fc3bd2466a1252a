"""More of the registry: scans, identity, event studies and readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities, narrative, publishers, rollups, similarity, studies
from .queries import COUNTRY, END, ENTITY, PAIRS, QUARTER, QUARTERS, RIVAL, SOURCE, WINDOW, WINDOW_CELLS, YEAR, guarded, quarter_cells, query, r, similarity_cells, source_series, SERIES


@query("scan_articles", f"d AS (SELECT article_id, source_id, publish_date, status FROM articles WHERE publish_date >= '{YEAR}' AND status <> 'completed' ORDER BY publish_date DESC, article_id DESC LIMIT 50) SELECT * FROM d")
def _(t):
    return studies.articles(t.articles, True, YEAR).select("article_id", "source_id", "publish_date", "status")


@query("scan_mentions", f"d AS (SELECT mention_id, article_id, {r('power')} AS power FROM mentions WHERE entity_id = {ENTITY} ORDER BY mention_id LIMIT 100) SELECT * FROM d")
def _(t):
    return studies.mentions_of(t.mentions, ENTITY).select("mention_id", "article_id", "power")


@query("scan_sources", "d AS (SELECT * FROM sources) SELECT * FROM d")
def _(t):
    return t.sources


@query("article_lookup", "d AS (SELECT article_id, source, publish_date, scraped_at, status FROM articles WHERE article_id = 100) SELECT * FROM d")
def _(t):
    return t.articles.where("article_id = 100").select("article_id", "source", "publish_date", "scraped_at", "status")


@query("whole_word_entities", r"d AS (SELECT id, name FROM entities WHERE regexp_matches(lower(name), '\bred\b')) SELECT * FROM d")
def _(t):
    return studies.by_pattern(t.entities, "red").select("id", "name")


@query("folded_search", "d AS (SELECT id, name FROM entities WHERE contains(strip_accents(lower(name)), 'ring')) SELECT * FROM d")
def _(t):
    return studies.folded_search(t.entities, "RÍNG").select("id", "name")


@query("names_of_both_types", "d AS (SELECT name FROM entities WHERE entity_type = 'person' INTERSECT SELECT name FROM entities WHERE entity_type = 'country') SELECT * FROM d")
def _(t):
    return studies.names_of_both_types(t.entities, "person", "country")


@query("type_preference", """k AS (SELECT id, name, entity_type, count(mention_id) AS k FROM entities LEFT JOIN mentions ON raw_id = id GROUP BY ALL), w AS (SELECT *, max(k) OVER (PARTITION BY name) AS most FROM k)
SELECT name, arg_min(id, (CASE entity_type WHEN 'person' THEN 1 WHEN 'organization' THEN 2 WHEN 'country' THEN 3 WHEN 'business' THEN 4 WHEN 'event' THEN 5 WHEN 'concept' THEN 6 ELSE 99 END, -k, id)) AS canonical FROM w WHERE k >= 0.2 * most GROUP BY name""")
def _(t):
    return studies.type_preference(t.mentions, t.entities)


@query("sampled_age", """s AS (SELECT DISTINCT scraped_at AS day FROM articles), f AS (SELECT raw_id AS id, min(publish_date) + 1 AS first_seen FROM mentions GROUP BY raw_id)
SELECT id, first_seen, (SELECT count(*) FROM s WHERE day >= first_seen)::INT AS sample_days FROM f""")
def _(t):
    seen = t.mentions.groupBy(F.col("raw_id").alias("id")).agg(F.date_add(F.min("publish_date"), 1).alias("first_seen"))
    return studies.sampled_age(seen, t.articles.select(F.col("scraped_at").alias("day")))


@query("eligible_countries", "d AS (SELECT country, count(*) AS sources FROM sources GROUP BY country HAVING count(*) >= 4) SELECT * FROM d")
def _(t):
    return studies.eligible_countries(t.sources)


@query("top_covered", QUARTERS + f""", d AS (SELECT entity_id, count(DISTINCT source_id) AS sources, count(DISTINCT period_start) AS periods, sum(n)::BIGINT AS mentions FROM cells WHERE period_start BETWEEN '{YEAR}' AND '{END}' GROUP BY entity_id)
SELECT * FROM d ORDER BY sources DESC, periods DESC, mentions DESC, entity_id LIMIT 20""")
def _(t):
    return studies.top_covered(quarter_cells(t), YEAR, END)


@query("weekly_coverage", QUARTERS + ", d AS (SELECT period_start, count(DISTINCT source_id) AS sources, sum(n)::BIGINT AS mentions FROM cells GROUP BY ALL) SELECT * FROM d")
def _(t):
    return rollups.coverage(quarter_cells(t))


@query("country_sources_json", """d AS (SELECT country, '[' || string_agg('{"source_id":' || source_id || ',"source":"' || source || '"}', ',' ORDER BY source_id) || ']' AS sources FROM sources GROUP BY country) SELECT * FROM d""")
def _(t):
    return studies.json_by_country(t.sources)


@query("baseline_overlay", f"""b AS (SELECT entity_id, avg(power) AS base FROM mentions WHERE country = '{COUNTRY}' GROUP BY ALL), o AS (SELECT entity_id, avg(power) AS overlay FROM mentions WHERE source_id = {SOURCE} AND publish_date >= '{QUARTER}' GROUP BY ALL)
SELECT entity_id, {r('base')} AS base, {r('overlay')} AS overlay, CASE WHEN base IS NULL THEN 'unmatched overlay' WHEN overlay IS NULL THEN 'baseline only' ELSE 'both' END AS kind, {r('overlay - base')} AS gap FROM b FULL JOIN o USING (entity_id)""")
def _(t):
    base = t.mentions.where(F.col("country") == COUNTRY).groupBy("entity_id").agg(F.avg("power").alias("base"))
    over = rollups.between(t.mentions.where(F.col("source_id") == SOURCE), QUARTER).groupBy("entity_id").agg(F.avg("power").alias("overlay"))
    return studies.overlay(base, over)


@query("archetype_filter", f"""d AS (SELECT entity_id, count(*) AS mentions, {r('avg(power)')} AS avg_power, {r('avg(moral)')} AS avg_moral FROM mentions WHERE source_id = {SOURCE} GROUP BY entity_id),
a AS (SELECT *, CASE WHEN abs(avg_power) < 0.25 AND abs(avg_moral) < 0.25 THEN 'neutral' WHEN avg_power >= 0 AND avg_moral >= 0 THEN 'hero' WHEN avg_power >= 0 THEN 'villain' WHEN avg_moral >= 0 THEN 'victim' ELSE 'nuisance' END AS archetype FROM d WHERE avg_power IS NOT NULL AND avg_moral IS NOT NULL)
SELECT * FROM a WHERE archetype IN ('hero', 'villain')""")
def _(t):
    return studies.by_archetype(entities.summary(t.mentions.where(F.col("source_id") == SOURCE), "entity_id"), ["hero", "villain"])


@query("residual_series", QUARTERS + f", o AS (SELECT entity_id, period_start, avg(mean_moral) AS overall FROM cells GROUP BY ALL) SELECT entity_id, source_id, period_start, {r('mean_moral - overall')} AS residual FROM cells JOIN o USING (entity_id, period_start)")
def _(t):
    return studies.residuals(quarter_cells(t))


EVENT = "1998-07-01"
STUDY = QUARTERS + f""", s AS (SELECT entity_id AS key, period_start, avg(mean_moral) AS value FROM cells GROUP BY ALL), k AS (SELECT *, period_start >= DATE '{EVENT}' AS post, row_number() OVER (PARTITION BY key, period_start >= DATE '{EVENT}' ORDER BY abs(date_diff('day', DATE '{EVENT}', period_start))) AS rank FROM s),
st AS (SELECT key, avg(value) FILTER (WHERE NOT post) AS before_, avg(value) FILTER (WHERE post) AS after_, count(*) FILTER (WHERE NOT post) AS n_before, count(*) FILTER (WHERE post) AS n_after FROM k WHERE rank <= 3 GROUP BY key HAVING count(*) FILTER (WHERE NOT post) >= 2 AND count(*) FILTER (WHERE post) >= 2)"""


def _study(t):
    return studies.event_study(rollups.entity_series(quarter_cells(t)).withColumnRenamed("entity_id", "key"), EVENT)


@query("event_study", STUDY + f""" SELECT key, {r('before_')} AS "before", {r('after_')} AS "after", n_before, n_after, {r('after_ - before_')} AS change FROM st""")
def _(t):
    return _study(t)


@query("sign_agreement", STUDY + f", o AS (SELECT avg(after_ - before_) AS overall FROM st) SELECT {r('any_value(overall)')} AS overall, {r('avg((sign(after_ - before_) = sign(overall))::INT)')} AS agreement, count(*) AS keys FROM st, o")
def _(t):
    return studies.sign_agreement(_study(t))


def _regions(t):
    return t.sources.select("source_id", F.col("region").alias("grp"))


@query("dividing_lines", WINDOW_CELLS + f""", g AS (SELECT entity_id, region, count(*) AS k, avg(value) AS m, var_pop(value) AS v FROM wcells JOIN sources USING (source_id) GROUP BY ALL HAVING count(*) >= 2),
a AS (SELECT entity_id, count(*) AS groups, sum(k) AS n, sum(k * m) AS t, sum(k * m * m) AS sq, sum(k * v) AS w FROM g GROUP BY entity_id HAVING count(*) >= 2),
f AS (SELECT entity_id, (sq - t * t / n) / (groups - 1) AS b, coalesce(w / nullif(n - groups, 0), 0) AS i FROM a), best AS (SELECT entity_id, b FROM f WHERE round(b / (i + 0.05), 6) >= 3 ORDER BY round(b, 6) DESC, entity_id LIMIT 20)
SELECT entity_id, region AS grp, {r('avg(value)')} AS mean, count(*) AS sources FROM wcells JOIN best USING (entity_id) JOIN sources USING (source_id) GROUP BY ALL""")
def _(t):
    cells = similarity_cells(t)
    return studies.dividing_lines(cells, _regions(t), similarity.dividing_entities(cells, _regions(t)))


@query("distinctive_entities", WINDOW_CELLS + f""", o AS (SELECT entity_id, avg(value) AS overall FROM wcells GROUP BY ALL), g AS (SELECT region AS grp, entity_id, avg(value) AS mean FROM wcells JOIN sources USING (source_id) GROUP BY ALL)
SELECT grp, entity_id, {r('mean')} AS mean, {r('overall')} AS overall, {r('mean - overall')} AS gap, row_number() OVER (PARTITION BY grp ORDER BY round(abs(mean - overall), 6) DESC, entity_id)::INT AS rank FROM g JOIN o USING (entity_id) QUALIFY rank <= 5""")
def _(t):
    return studies.distinctive(similarity_cells(t), _regions(t))


@query("article_source_comparison", PAIRS + f""", own AS (SELECT entity_id, source_id AS own, avg(power) AS reading FROM mentions WHERE article_id = 100 GROUP BY ALL), lk AS (SELECT CASE WHEN a = (SELECT max(own) FROM own) THEN b ELSE a END AS source_id, round(r, 6) AS r FROM pairs WHERE r IS NOT NULL AND (SELECT max(own) FROM own) IN (a, b)),
lk5 AS (SELECT source_id FROM lk ORDER BY r DESC, source_id LIMIT 5), th AS (SELECT entity_id, source_id, avg(power) AS other FROM mentions WHERE publish_date >= '{YEAR}' AND source_id IN (SELECT source_id FROM lk5) GROUP BY ALL)
SELECT entity_id, source_id, {r('reading')} AS reading, {r('other')} AS other, {r('reading - other')} AS difference FROM own JOIN th USING (entity_id)""")
def _(t):
    return studies.article_comparison(t.mentions, similarity.pearson_pairs(similarity_cells(t)), 100, YEAR)


@query("combined_pairs", f"""c AS (SELECT source_id, entity_id, avg((power + moral) / 2) AS v, count(*) AS n FROM mentions WHERE moral IS NOT NULL AND publish_date >= '{WINDOW}' GROUP BY ALL HAVING count(*) >= 2)
SELECT a.source_id AS a, b.source_id AS b, {r(f"coalesce({guarded('a.v', 'b.v', 5)}, 0)")} AS r, count(*) AS common FROM c a JOIN c b ON a.entity_id = b.entity_id AND a.source_id < b.source_id GROUP BY ALL HAVING count(*) >= 5""")
def _(t):
    return studies.combined_pairs(t.mentions, WINDOW)


@query("composite_article_scores", f"""g AS (SELECT entity_id, avg(moral) AS mean, stddev_pop(moral) AS sd FROM mentions WHERE moral IS NOT NULL GROUP BY entity_id HAVING count(*) >= 6), z AS (SELECT article_id, abs(moral - mean) / CASE WHEN sd > 1e-9 THEN sd END AS z FROM mentions JOIN g USING (entity_id) WHERE moral IS NOT NULL)
SELECT article_id, {r('sum(-2 * ln(coalesce(2 / (1 + exp(0.07056 * z * z * z + 1.5976 * z)), 0.5)))')} AS statistic, 2 * count(*) AS df FROM z GROUP BY article_id""")
def _(t):
    return studies.composite_scores(t.mentions, publishers.layers(t.mentions))


@query("popular_entities", "d AS (SELECT entity_id, count(*) AS mentions FROM mentions GROUP BY entity_id ORDER BY mentions DESC, entity_id LIMIT 1000) SELECT d.*, name, entity_type FROM d JOIN entities ON id = entity_id")
def _(t):
    return studies.popular(t.mentions, t.entities)


@query("capped_per_source", "d AS (SELECT source_id, article_id, row_number() OVER (PARTITION BY source_id ORDER BY article_id)::INT AS rank FROM articles QUALIFY rank <= 3) SELECT * FROM d")
def _(t):
    return studies.capped(t.articles.select("source_id", "article_id"), "source_id", "article_id", 3)


@query("reading_history", f"d AS (SELECT article_id, source, publish_date FROM articles WHERE publish_date BETWEEN DATE '{END}' - INTERVAL 1 MONTH AND DATE '{END}' AND contains(lower(source), 'nation_3')) SELECT * FROM d")
def _(t):
    return studies.history(t.articles, END, "nation_3").select("article_id", "source", "publish_date")


@query("source_series", SERIES + f" SELECT source_id, period_start, {r('value')} AS value FROM ss")
def _(t):
    return source_series(t)


@query("contested_countries_daily", f"""d AS (SELECT country, CAST(date_trunc('quarter', publish_date) AS DATE) AS period_start, count(*) AS mentions, {r('avg(moral)')} AS avg_moral FROM mentions WHERE entity_id = {ENTITY} AND country IN ('{COUNTRY}', '{RIVAL}') GROUP BY ALL) SELECT * FROM d""")
def _(t):
    rows = t.mentions.where((F.col("entity_id") == ENTITY) & F.col("country").isin(COUNTRY, RIVAL))
    return rows.groupBy("country", F.to_date(F.date_trunc("quarter", "publish_date")).alias("period_start")).agg(F.count("*").alias("mentions"), F.avg("moral").alias("avg_moral"))


@query("changes_by_source", SERIES + f" SELECT source_id, period_start, {r('change')} AS change FROM ch")
def _(t):
    return narrative.changes(source_series(t), "source_id")
