"""The registry of the library's own queries: each operator with fixed parameters, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import SQL, News
from ..functions import text as T
from ..operators import clustering, decomposition, entities, narrative, publishers, rollups, similarity, source_vectors
from ..operators.entities import rounded
from ..session import materialize, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ENTITY, SOURCE, OTHER, COUNTRY, RIVAL = 7, 12, 37, "NATION_3", "NATION_8"
END, YEAR, QUARTER = "2001-08-01", "2000-08-01", "2001-05-01"
#: Start of the window that similarity works on: four quarters.
WINDOW = "2000-10-01"


def r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def query(name: str, sql: str | None = None, with_views: bool = True):
    """Register a function of News; its floats are rounded to 6 places."""

    def register(f: Callable[[News], DataFrame]) -> Callable[[News], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(News(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = SQL + sql.strip() if with_views else sql
        return f

    return register


AVGS = f"count(*) AS mentions, {r('avg(power)')} AS avg_power, {r('avg(moral)')} AS avg_moral"
CELLS = """cells AS (
  SELECT source_id, entity_id, CAST(date_trunc('{grain}', publish_date) AS DATE) AS period_start, avg(power) AS mean_power, avg(moral) AS mean_moral, count(*) AS n
  FROM mentions WHERE power IS NOT NULL AND moral IS NOT NULL GROUP BY ALL
)"""
QUARTERS = CELLS.format(grain="quarter")
WINDOW_CELLS = QUARTERS + f""", wcells AS (
  SELECT source_id, entity_id, sum(mean_moral * n) / sum(n) AS value, sum(n)::BIGINT AS n FROM cells WHERE period_start >= DATE '{WINDOW}' GROUP BY ALL
)"""


def guarded(x: str, y: str, least: int) -> str:
    """The guarded correlation of the pairs of a group."""
    return f"""CASE WHEN count(*) >= {least} AND stddev_pop({x}) * stddev_pop({y}) > 1e-9
      THEN (avg({x} * {y}) - avg({x}) * avg({y})) / (stddev_pop({x}) * stddev_pop({y})) END"""


PAIRS = WINDOW_CELLS + f""", pairs AS (
  SELECT a.source_id AS a, b.source_id AS b, {guarded('a.value', 'b.value', 10)} AS r, count(*) AS common
  FROM wcells a JOIN wcells b ON a.entity_id = b.entity_id AND a.source_id < b.source_id GROUP BY ALL
)"""


def quarter_cells(t: News) -> DataFrame:
    return rollups.cells(t.mentions, "quarter")


def similarity_cells(t: News) -> DataFrame:
    """The cells of the window, written: pairs read them twice or more, the mentions once."""
    return materialize(rollups.window_cells(quarter_cells(t), WINDOW), "cells")


# rollups and series ---------------------------------------------------------------------------------------------


@query("source_entity_week", CELLS.format(grain="week") + f" SELECT source_id, entity_id, period_start, {r('mean_power')} AS mean_power, {r('mean_moral')} AS mean_moral, n FROM cells")
def _(t):
    return rollups.cells(t.mentions, "week")


@query("window_cells", WINDOW_CELLS + f" SELECT source_id, entity_id, {r('value')} AS value, n FROM wcells")
def _(t):
    return rollups.window_cells(quarter_cells(t), WINDOW)


@query("trending_global", f"""best AS (SELECT entity_id, {AVGS} FROM mentions GROUP BY entity_id ORDER BY mentions DESC, entity_id LIMIT 20)
SELECT entity_id, mentions, avg_power, avg_moral, name, entity_type,
  CASE WHEN abs(avg_power) < 0.25 AND abs(avg_moral) < 0.25 THEN 'neutral' WHEN avg_power >= 0 AND avg_moral >= 0 THEN 'hero' WHEN avg_power >= 0 THEN 'villain' WHEN avg_moral >= 0 THEN 'victim' ELSE 'nuisance' END AS archetype
FROM best JOIN entities ON id = entity_id""")
def _(t):
    from ..functions.stats import archetype

    return rounded(entities.trending(t.mentions, t.entities)).withColumn("archetype", archetype("avg_power", "avg_moral"))


@query("trending_country", f"""best AS (SELECT entity_id, {AVGS} FROM mentions WHERE lower(country) = lower('{COUNTRY}') AND publish_date BETWEEN '{YEAR}' AND '{END}' GROUP BY entity_id ORDER BY mentions DESC, entity_id LIMIT 20)
SELECT best.*, name, entity_type FROM best JOIN entities ON id = entity_id""")
def _(t):
    return entities.trending(t.mentions, t.entities, start=YEAR, end=END, country=COUNTRY)


@query("trending_source_union_global", f"""own AS (SELECT entity_id, {AVGS} FROM mentions WHERE source_id = {SOURCE} GROUP BY entity_id HAVING count(*) >= 3 ORDER BY mentions DESC, entity_id LIMIT 10),
top AS (SELECT entity_id FROM mentions GROUP BY entity_id ORDER BY count(*) DESC, entity_id LIMIT 10),
more AS (SELECT entity_id, {AVGS} FROM mentions WHERE source_id = {SOURCE} AND entity_id IN (SELECT entity_id FROM top) AND entity_id NOT IN (SELECT entity_id FROM own) GROUP BY entity_id HAVING count(*) >= 3),
both_ AS (SELECT *, false AS from_global FROM own UNION ALL SELECT *, true FROM more)
SELECT both_.*, name, entity_type FROM both_ JOIN entities ON id = entity_id""")
def _(t):
    return entities.trending_with_global(t.mentions, t.entities, limit=10, source_id=SOURCE)


@query("entity_list_with_aliases", """k AS (SELECT entity_id, count(*) AS k FROM mentions GROUP BY entity_id),
al AS (SELECT canonical_id, list_sort(list(DISTINCT name)) AS aliases FROM entities WHERE canonical_id IS NOT NULL GROUP BY canonical_id)
SELECT id AS entity_id, name, entity_type, coalesce(k, 0) AS mentions, coalesce(len(aliases), 0)::INT AS n_aliases, array_to_string(aliases, '|') AS aliases
FROM entities LEFT JOIN k ON k.entity_id = id LEFT JOIN al ON al.canonical_id = id WHERE entities.canonical_id IS NULL ORDER BY mentions DESC, id LIMIT 30""")
def _(t):
    return entities.listing(t.mentions, t.entities, 30).withColumn("aliases", F.array_join("aliases", "|"))


@query("entity_detail", f"""s AS (SELECT source_id, source, {AVGS} FROM mentions WHERE entity_id = {ENTITY} GROUP BY ALL)
SELECT *, sum(mentions) OVER ()::BIGINT AS total_mentions, count(*) OVER () AS sources FROM s QUALIFY row_number() OVER (ORDER BY mentions DESC, source_id) <= 10""")
def _(t):
    return entities.detail(t.mentions, ENTITY)


@query("entity_series", f"d AS (SELECT mention_id, publish_date, source, {r('power')} AS power, {r('moral')} AS moral FROM mentions WHERE entity_id = {ENTITY}) SELECT * FROM d")
def _(t):
    return entities.series(t.mentions, ENTITY)


@query("entity_daily", f"d AS (SELECT entity_id, publish_date, {AVGS} FROM mentions WHERE entity_id IN ({ENTITY}, 8) AND publish_date >= '{YEAR}' GROUP BY ALL) SELECT * FROM d")
def _(t):
    return entities.daily(t.mentions, [ENTITY, 8], YEAR)


@query("entity_daily_raw", f"d AS (SELECT raw_id, publish_date, {AVGS} FROM mentions WHERE raw_id IN ({ENTITY}, 47) GROUP BY ALL) SELECT * FROM d")
def _(t):
    return entities.daily(t.mentions, [ENTITY, 47], raw=True)


for _group, _name, _least in (("country", "entity_daily_by_country", 2), ("source", "entity_daily_by_source", 2)):

    @query(_name, f"""d AS (SELECT {_group}, publish_date, count(*) AS mentions, avg(power) AS p, avg(moral) AS m FROM mentions WHERE entity_id = {ENTITY} GROUP BY ALL HAVING count(*) >= {_least})
SELECT {_group}, publish_date, mentions, {r('p')} AS avg_power, {r('m')} AS avg_moral, sum(mentions) OVER (PARTITION BY {_group})::BIGINT AS group_mentions,
  {r(f'avg(p) OVER (PARTITION BY {_group})')} AS mean_of_days_power, {r(f'avg(m) OVER (PARTITION BY {_group})')} AS mean_of_days_moral FROM d""")
    def _(t, group=_group, least=_least):
        return entities.grouped_daily(t.mentions, ENTITY, group, least)


@query("country_top_entities_shrunk", f"""rows_ AS (SELECT * FROM mentions WHERE country = '{COUNTRY}'),
top AS (SELECT entity_id FROM rows_ GROUP BY entity_id HAVING count(*) >= 5 ORDER BY count(*) DESC, entity_id LIMIT 10),
c AS (SELECT entity_id, source_id, publish_date, sum(moral) AS total, count(*) AS n FROM rows_ WHERE moral IS NOT NULL AND entity_id IN (SELECT entity_id FROM top) GROUP BY ALL),
g AS (SELECT *, sum(total) OVER (PARTITION BY entity_id) / sum(n) OVER (PARTITION BY entity_id) AS overall FROM c)
SELECT entity_id, source_id, publish_date, n, {r('total / n')} AS mean, {r('(total + 10 * overall) / (n + 10)')} AS shrunk FROM g""")
def _(t):
    return entities.country_top_shrunk(t.mentions, COUNTRY)


@query("newspaper_top_entities", f"""rows_ AS (SELECT * FROM mentions WHERE source_id = {SOURCE}),
top AS (SELECT entity_id FROM rows_ GROUP BY entity_id HAVING count(*) >= 3 ORDER BY count(*) DESC, entity_id LIMIT 10)
SELECT entity_id, publish_date, {AVGS} FROM rows_ WHERE entity_id IN (SELECT entity_id FROM top) GROUP BY ALL""")
def _(t):
    return entities.source_top_daily(t.mentions, "NATION_2/FURNITURE")


@query("source_detail", f"""b AS (SELECT source_id, entity_id, {AVGS} FROM mentions WHERE source_id = {SOURCE} GROUP BY ALL ORDER BY mentions DESC, entity_id LIMIT 10)
SELECT b.*, (SELECT count(*) FROM articles WHERE source_id = {SOURCE}) AS articles FROM b""")
def _(t):
    return publishers.source_detail(t.articles, t.mentions, SOURCE)


@query("source_sentiment_daily", f"d AS (SELECT publish_date, {AVGS} FROM mentions WHERE source_id = {SOURCE} AND publish_date BETWEEN '{YEAR}' AND '{END}' GROUP BY ALL) SELECT * FROM d")
def _(t):
    return publishers.source_daily(t.mentions, SOURCE, YEAR, END)


@query("available_countries", f"d AS (SELECT country, count(*) AS mentions FROM mentions WHERE entity_id = {ENTITY} AND moral IS NOT NULL GROUP BY country HAVING count(*) >= 5) SELECT * FROM d")
def _(t):
    return entities.available_countries(t.mentions, ENTITY)


@query("global_counts_zero_safe", "d AS (SELECT name, count(mention_id) AS mentions FROM entities LEFT JOIN mentions ON raw_id = id GROUP BY name) SELECT * FROM d")
def _(t):
    return entities.counts_by_name(t.mentions, t.entities)


@query("global_agenda", f"""d AS (SELECT entity_id, count(DISTINCT country) AS countries, count(DISTINCT source_id) AS sources, {AVGS} FROM mentions WHERE publish_date BETWEEN '{QUARTER}' AND '{END}' GROUP BY entity_id)
SELECT *, count(*) FILTER (WHERE countries >= 3) OVER () AS broad_entities, (sum(mentions) FILTER (WHERE countries >= 3) OVER ())::BIGINT AS broad_mentions FROM d
QUALIFY row_number() OVER (ORDER BY countries DESC, mentions DESC, entity_id) <= 20""")
def _(t):
    return publishers.agenda(t.mentions, QUARTER, END)


@query("source_scatter_two_windows", f"""d AS (SELECT source_id, source, country, publish_date >= DATE '{QUARTER}' AS current, {AVGS} FROM mentions WHERE entity_id = {ENTITY} AND publish_date BETWEEN '{YEAR}' AND '{END}' GROUP BY ALL HAVING count(*) >= 3)
SELECT * FROM d""")
def _(t):
    return publishers.scatter(t.mentions, ENTITY, QUARTER, YEAR, END)


@query("active_sources", f"""d AS (SELECT source_id, source, country, count(DISTINCT article_id) AS articles, count(DISTINCT entity_id) AS entities FROM mentions WHERE publish_date BETWEEN '{YEAR}' AND '{END}' GROUP BY ALL HAVING count(DISTINCT article_id) >= 10)
SELECT * FROM d""")
def _(t):
    return publishers.active_sources(t.mentions, YEAR, END)


@query("source_processing_stats", f"""m AS (SELECT DISTINCT article_id FROM mentions), c AS (SELECT source_id, count(*) AS articles, count(*) FILTER (WHERE status = 'completed') AS completed, count(m.article_id) AS analysed FROM articles LEFT JOIN m USING (article_id) GROUP BY source_id)
SELECT s.source_id, s.source, coalesce(articles, 0) AS articles, coalesce(completed, 0) AS completed, coalesce(analysed, 0) AS analysed, {r('coalesce(completed * 100.0::DOUBLE / articles, 0)')} AS completed_pct FROM sources s LEFT JOIN c USING (source_id)""")
def _(t):
    return publishers.processing(t.articles, t.mentions, t.sources)


@query("corpus_stats", f"""a AS (SELECT count(*) AS articles, count(DISTINCT source_id) AS sources, min(publish_date) AS first_date, max(publish_date) AS last_date, count(*) FILTER (WHERE status = 'completed') AS completed,
  count(*) FILTER (WHERE status = 'unanalyzed') AS unanalyzed, count(*) FILTER (WHERE status = 'in_progress') AS in_progress FROM articles), m AS (SELECT {AVGS}, count(DISTINCT entity_id) AS entities FROM mentions) SELECT * FROM a, m""")
def _(t):
    return publishers.corpus_stats(t.articles, t.mentions)


@query("status_audit", """m AS (SELECT DISTINCT article_id FROM mentions)
SELECT status, count(*) AS articles, count(m.article_id) AS with_mentions, count(*) FILTER (WHERE (status = 'completed') <> (m.article_id IS NOT NULL)) AS inconsistent FROM articles LEFT JOIN m USING (article_id) GROUP BY status""")
def _(t):
    return publishers.status_audit(t.articles, t.mentions)


@query("entity_type_stats", f"""k AS (SELECT raw_id, count(*) AS k FROM mentions GROUP BY raw_id)
SELECT entity_type, count(*) AS entities, count(*) FILTER (WHERE k IS NULL) AS unmentioned, {r('avg(coalesce(k, 0)::DOUBLE)')} AS avg_mentions FROM entities LEFT JOIN k ON raw_id = id GROUP BY entity_type""")
def _(t):
    return publishers.type_stats(t.mentions, t.entities)


@query("newspaper_spread", f"""p AS (SELECT entity_id, source_id, avg(moral) AS m, count(*) AS k FROM mentions WHERE moral IS NOT NULL AND publish_date BETWEEN '{YEAR}' AND '{END}' GROUP BY ALL)
SELECT entity_id, count(*) AS sources, {r('max(m) - min(m)')} AS spread, {r('sum(m * k) / sum(k)')} AS mean, max(m) - min(m) >= 0.5 AS divergent FROM p GROUP BY entity_id HAVING count(*) >= 2""")
def _(t):
    return publishers.spread(t.mentions, YEAR, END)


@query("shared_vs_exclusive", f"""p AS (SELECT entity_id, source_id, avg(power) AS m, count(*) AS k FROM mentions WHERE source_id IN (1, {SOURCE}, {OTHER}) GROUP BY ALL)
SELECT entity_id, count(*) AS sources, sum(k)::BIGINT AS mentions, {r('max(m) - min(m)')} AS spread, CASE count(*) WHEN 3 THEN 'shared' WHEN 1 THEN 'exclusive' ELSE 'partial' END AS kind FROM p GROUP BY entity_id""")
def _(t):
    return publishers.shared_and_exclusive(t.mentions, [1, SOURCE, OTHER])


@query("bubble_divergence", f"""p AS (SELECT entity_id, source_id, avg(moral) AS m FROM mentions WHERE moral IS NOT NULL AND source_id IN (1, {SOURCE}, {OTHER}) GROUP BY ALL), mine AS (SELECT entity_id, avg(m) AS mine, count(*) AS sources FROM p GROUP BY entity_id),
base AS (SELECT entity_id, avg(moral) AS everyone FROM mentions WHERE moral IS NOT NULL GROUP BY entity_id)
SELECT entity_id, {r('mine')} AS mine, sources, {r('everyone')} AS everyone, {r('mine - everyone')} AS gap FROM mine JOIN base USING (entity_id) ORDER BY round(abs(mine - everyone), 6) DESC, entity_id LIMIT 12""")
def _(t):
    return publishers.bubble(t.mentions, [1, SOURCE, OTHER])


@query("country_concentration", f"""k AS (SELECT country, entity_id, count(*) AS n FROM mentions GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY n DESC, entity_id) AS rank FROM k)
SELECT country, {r('sum(n) FILTER (WHERE rank <= 5) / sum(n)')} AS share, sum(n)::BIGINT AS mentions FROM w GROUP BY country""")
def _(t):
    return publishers.concentration(t.mentions)


@query("layered_statistics", f"""g AS (SELECT entity_id, country, source_id, grouping(entity_id, country, source_id) AS g, count(*) AS n, avg(moral) AS mean, stddev_pop(moral) AS deviation
  FROM mentions WHERE moral IS NOT NULL GROUP BY GROUPING SETS ((entity_id), (entity_id, country), (entity_id, source_id)))
SELECT entity_id, CASE g WHEN 3 THEN 'global' WHEN 1 THEN 'national' ELSE 'source' END AS layer, country, source_id, n, {r('mean')} AS mean, {r('deviation')} AS deviation FROM g WHERE n >= 6""")
def _(t):
    return publishers.layers(t.mentions)


@query("interval_means", f"""d AS (SELECT source_id, (date_diff('day', DATE '{YEAR}', publish_date) // 30)::BIGINT AS bucket, {AVGS} FROM mentions WHERE entity_id = {ENTITY} AND publish_date >= '{YEAR}' GROUP BY ALL) SELECT * FROM d""")
def _(t):
    return publishers.interval_means(t.mentions, ENTITY, YEAR)


@query("country_month_pivot", f"""d AS (SELECT CAST(date_trunc('month', publish_date) AS DATE) AS period_start, {r(f"avg(power) FILTER (WHERE country = '{COUNTRY}')")} AS "{COUNTRY}", {r(f"avg(power) FILTER (WHERE country = '{RIVAL}')")} AS "{RIVAL}"
  FROM mentions WHERE entity_id = {ENTITY} AND country IN ('{COUNTRY}', '{RIVAL}') GROUP BY ALL) SELECT * FROM d""")
def _(t):
    return publishers.date_pivot(t.mentions, ENTITY, [COUNTRY, RIVAL])


@query("volatile_top_sources", f"""p AS (SELECT entity_id, source_id, avg(moral) AS m, count(*) AS mentions FROM mentions WHERE moral IS NOT NULL AND publish_date BETWEEN '{YEAR}' AND '{END}' GROUP BY ALL)
SELECT entity_id, source_id, {r('m')} AS avg_moral, mentions, row_number() OVER (PARTITION BY entity_id ORDER BY round(abs(m), 6) DESC, source_id)::INT AS rank FROM p QUALIFY rank <= 5""")
def _(t):
    return publishers.volatile_sources(t.mentions, YEAR, END)


# narrative statistics -------------------------------------------------------------------------------------------


@query("archetype_trajectory", QUARTERS + f""", e AS (SELECT entity_id, period_start, {r('avg(mean_power)')} AS power, {r('avg(mean_moral)')} AS moral FROM cells GROUP BY ALL)
SELECT entity_id, period_start, power, moral, (row_number() OVER (PARTITION BY entity_id ORDER BY period_start) - 1)::INT AS window_index,
  CASE WHEN abs(power) < 0.25 AND abs(moral) < 0.25 THEN 'neutral' WHEN power >= 0 AND moral >= 0 THEN 'hero' WHEN power >= 0 THEN 'villain' WHEN moral >= 0 THEN 'victim' ELSE 'nuisance' END AS archetype
FROM e QUALIFY count(*) OVER (PARTITION BY entity_id) >= 3""")
def _(t):
    return narrative.trajectory(quarter_cells(t))


_BIN = "least({bins}, floor((greatest(-2::DOUBLE, least(2::DOUBLE, round({x}, 9))) + 2) * ({bins} / 4::DOUBLE))::INT + 1)"

for _bins in (8, 5):

    @query(f"histogram{_bins}", f"""b AS (SELECT entity_id, {_BIN.format(bins=_bins, x='moral')} AS bin, count(*) AS n FROM mentions WHERE moral IS NOT NULL GROUP BY ALL)
SELECT entity_id, bin, n, {r('n / sum(n) OVER (PARTITION BY entity_id)')} AS share FROM b""")
    def _(t, bins=_bins):
        return narrative.histogram(t.mentions, bins=bins)


@query("contested_jsd", f"""top AS (SELECT entity_id FROM mentions WHERE moral IS NOT NULL GROUP BY entity_id ORDER BY count(*) DESC, entity_id LIMIT 500),
raw AS (SELECT entity_id, country, {_BIN.format(bins=8, x='moral')} AS bin, count(*) AS k FROM mentions WHERE moral IS NOT NULL AND entity_id IN (SELECT entity_id FROM top) GROUP BY ALL),
sized AS (SELECT entity_id, country, sum(k) AS n FROM raw GROUP BY ALL HAVING sum(k) >= 10),
dense AS (SELECT entity_id, country, bin, coalesce(k, 0) / n AS p FROM sized CROSS JOIN (SELECT unnest(range(1, 9))::INT AS bin) LEFT JOIN raw USING (entity_id, country, bin)),
pairs AS (SELECT a.entity_id, a.country AS x, b.country AS y, sum((CASE WHEN a.p > 0 THEN a.p * log2(a.p / ((a.p + b.p) / 2)) ELSE 0 END + CASE WHEN b.p > 0 THEN b.p * log2(b.p / ((a.p + b.p) / 2)) ELSE 0 END) / 2) AS d
  FROM dense a JOIN dense b ON a.entity_id = b.entity_id AND a.bin = b.bin AND a.country < b.country GROUP BY ALL)
SELECT entity_id, {r('max(d)')} AS divergence, count(*) AS pairs FROM pairs GROUP BY entity_id""")
def _(t):
    return narrative.contested(t.mentions)


@query("salience_asymmetry", f"""k AS (SELECT entity_id, count(*) FILTER (WHERE country = '{COUNTRY}') AS a, count(*) FILTER (WHERE country = '{RIVAL}') AS b FROM mentions WHERE country IN ('{COUNTRY}', '{RIVAL}') GROUP BY entity_id),
w AS (SELECT *, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM k)
SELECT entity_id, a, b, {r('log2(((a + 1)::DOUBLE / (ta + 1)) / ((b + 1)::DOUBLE / (tb + 1)))')} AS asymmetry FROM w WHERE a + b >= 10""")
def _(t):
    return narrative.salience(t.mentions, COUNTRY, RIVAL)


MOMENTS = f"""mom AS (SELECT entity_id, avg(power) AS mp, avg(moral) AS mm, var_samp(power) AS vp, var_samp(moral) AS vm, covar_samp(power, moral) AS c, count(*) AS n FROM mentions
  WHERE moral IS NOT NULL AND publish_date BETWEEN '{YEAR}' AND '{END}' GROUP BY entity_id HAVING count(*) >= 5)"""
T2 = MOMENTS + """, per AS (SELECT article_id, entity_id, avg(power) AS p, avg(moral) AS m FROM mentions WHERE moral IS NOT NULL GROUP BY ALL),
t2 AS (SELECT article_id, round(sum(((vm + 1e-6) * (p - mp) ** 2 - 2 * c * (p - mp) * (m - mm) + (vp + 1e-6) * (m - mm) ** 2) / ((vp + 1e-6) * (vm + 1e-6) - c * c)), 6) AS t2, count(*) AS entities
  FROM per JOIN mom USING (entity_id) GROUP BY article_id HAVING count(*) >= 2)"""


@query("weekly_moments", MOMENTS + f" SELECT entity_id, {r('mp')} AS mean_power, {r('mm')} AS mean_moral, {r('vp')} AS var_power, {r('vm')} AS var_moral, {r('c')} AS covariance, n FROM mom")
def _(t):
    return rollups.weekly_moments(t.mentions, YEAR, END)


@query("article_hotelling_t2", T2 + " SELECT article_id, t2 + 0.0 AS t2, entities FROM t2")
def _(t):
    return rollups.article_hotelling_t2(t.mentions, rollups.weekly_moments(t.mentions, YEAR, END))


@query("t2_percent_rank", T2 + f" SELECT article_id, t2 + 0.0 AS t2, entities, {r('percent_rank() OVER (ORDER BY t2) * 100')} AS percentile FROM t2")
def _(t):
    return rollups.t2_percentile(rollups.article_hotelling_t2(t.mentions, rollups.weekly_moments(t.mentions, YEAR, END)))


@query("tracking_sliding_mean", f"""d AS (SELECT publish_date, sum(power) AS s, count(*) AS k FROM mentions WHERE entity_id = {ENTITY} GROUP BY ALL),
w AS (SELECT a.publish_date, sum(b.s) AS s, sum(b.k) AS k FROM d a JOIN d b ON b.publish_date BETWEEN a.publish_date - 7 AND a.publish_date GROUP BY a.publish_date)
SELECT publish_date, {r('s / k')} AS value, k::BIGINT AS mentions FROM w""")
def _(t):
    return narrative.sliding_mean(t.mentions, ENTITY)


@query("global_ci_band", f"""d AS (SELECT publish_date, avg(power) AS mean, stddev_samp(power) AS sd, count(*) AS n FROM mentions WHERE entity_id = {ENTITY} AND source_id <> {SOURCE} GROUP BY ALL HAVING count(*) > 1)
SELECT publish_date, {r('mean')} AS mean, n, {r('mean - 1.96 * sd / sqrt(n)')} AS low, {r('mean + 1.96 * sd / sqrt(n)')} AS high FROM d""")
def _(t):
    return narrative.global_band(t.mentions, ENTITY, SOURCE)


@query("decayed_distribution", f"""d AS (SELECT {r('power')} AS score, greatest(1, round_even(10 * exp(-date_diff('day', publish_date, DATE '{END}') / 90::DOUBLE), 0))::BIGINT AS copies FROM mentions WHERE entity_id = {ENTITY} AND publish_date <= '{END}')
SELECT score, sum(copies)::BIGINT AS copies, count(*) AS mentions FROM d GROUP BY score""")
def _(t):
    return narrative.decayed(t.mentions, ENTITY, END, 90.0)


for _layer in (None, "country"):
    _key, _part = (f"{_layer}, ", f"PARTITION BY {_layer}") if _layer else ("", "")

    @query(f"kde_{_layer or 'global'}", f"""s AS (SELECT {_key}moral AS x, count(*) OVER ({_part}) AS n, stddev_samp(moral) OVER ({_part}) * pow(count(*) OVER ({_part}), -0.2) AS h FROM mentions WHERE entity_id = {ENTITY} AND moral IS NOT NULL),
g AS (SELECT unnest(range(0, 121))::INT AS i)
SELECT {_key}i, {r('sum(exp(-0.5 * ((i / 30::DOUBLE - 2 - x) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi()))')} AS density FROM s, g WHERE n >= 5 AND h > 1e-9 GROUP BY {_key}i""")
    def _(t, layer=_layer):
        return narrative.density(t.mentions, ENTITY, layer=layer)


def pettitt_sql(source: str, keys: str) -> str:
    """Pettitt's test by the definition: signs of all pairs of a series (keys, period_start, value)."""
    same = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in keys.split(", "))
    return f""", ser AS (SELECT {keys}, period_start, round(value, 9) AS value, row_number() OVER (PARTITION BY {keys} ORDER BY period_start) AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM {source} WHERE value IS NOT NULL),
lng AS (SELECT * FROM ser WHERE n >= 8),
step AS (SELECT {', '.join('a.' + k for k in keys.split(', '))}, a.i, a.n, sum(sign(a.value - b.value)) AS v FROM lng a JOIN lng b ON {same} GROUP BY ALL),
us AS (SELECT {keys}, i, n, abs(sum(v) OVER (PARTITION BY {keys} ORDER BY i)) AS u FROM step),
pick AS (SELECT {keys}, n, max(u)::DOUBLE AS k, arg_max(i, (u, -i)) AS i FROM us WHERE i < n GROUP BY ALL),
pet AS (SELECT {', '.join('p.' + k for k in keys.split(', '))}, p.n, p.i::INT AS changepoint, max(s.period_start) FILTER (WHERE s.i = p.i) AS last_before, p.k AS statistic, least(1, 2 * exp(-6 * p.k * p.k / (p.n::DOUBLE ** 3 + p.n::DOUBLE ** 2))) AS p_value,
  avg(s.value) FILTER (WHERE s.i <= p.i) AS mean_before, avg(s.value) FILTER (WHERE s.i > p.i) AS mean_after
  FROM pick p JOIN lng s ON {' AND '.join(f'p.{k} IS NOT DISTINCT FROM s.{k}' for k in keys.split(', '))} GROUP BY ALL)"""


_PET = f"n, changepoint, last_before, {r('statistic')} AS statistic, {r('p_value')} AS p_value, {r('mean_before')} AS mean_before, {r('mean_after')} AS mean_after FROM pet"


@query("pettitt_drift", QUARTERS + ", es AS (SELECT entity_id, period_start, avg(mean_moral) AS value FROM cells GROUP BY ALL)" + pettitt_sql("es", "entity_id") + f" SELECT entity_id, {_PET}")
def _(t):
    return narrative.pettitt(rollups.entity_series(quarter_cells(t)))


@query("drift_events", QUARTERS + """, busy AS (SELECT entity_id FROM cells GROUP BY entity_id HAVING sum(n) >= 10), ov AS (SELECT entity_id, period_start, avg(mean_moral) AS overall FROM cells WHERE entity_id IN (SELECT entity_id FROM busy) GROUP BY ALL),
es AS (SELECT entity_id, NULL::INT AS source_id, period_start, overall AS value FROM ov UNION ALL SELECT entity_id, source_id, period_start, mean_moral - overall FROM cells JOIN ov USING (entity_id, period_start))"""
       + pettitt_sql("es", "entity_id, source_id") + f" SELECT entity_id, source_id, {_PET} WHERE p_value < 0.05")
def _(t):
    return narrative.drift_events(quarter_cells(t))


SERIES = QUARTERS + """, ss AS (SELECT source_id, period_start, sum(mean_moral * n) / sum(n) AS value FROM cells GROUP BY ALL),
ch AS (SELECT a.source_id, a.period_start, a.value - b.value AS change FROM ss a JOIN ss b ON a.source_id = b.source_id AND b.period_start = a.period_start - INTERVAL 3 MONTH)"""


def source_series(t: News) -> DataFrame:
    from ..functions.stats import weighted_mean

    return quarter_cells(t).groupBy("source_id", "period_start").agg(weighted_mean("mean_moral", "n").alias("value"))


LAGS = SERIES + f""", os AS (SELECT period_start, avg(value) AS value FROM ss GROUP BY ALL), oc AS (SELECT a.period_start, a.value - b.value AS overall FROM os a JOIN os b ON b.period_start = a.period_start - INTERVAL 3 MONTH),
lg AS (SELECT source_id, lag, {guarded('change', 'overall', 5)} AS r, count(*) AS n FROM ch CROSS JOIN (SELECT unnest(range(-4, 5))::INT AS lag) JOIN oc ON oc.period_start = ch.period_start + to_months(lag * 3) GROUP BY ALL)"""


@query("lead_lag_table", LAGS + f" SELECT source_id, lag, {r('r')} AS r, n FROM lg WHERE r IS NOT NULL")
def _(t):
    return narrative.lead_lag(source_series(t))


@query("lead_lag_best", LAGS + f" SELECT source_id, arg_max(lag, (round(abs(r), 6), -lag)) AS lag, {r('arg_max(r, (round(abs(r), 6), -lag))')} AS r, arg_max(n, (round(abs(r), 6), -lag)) AS n FROM lg WHERE r IS NOT NULL GROUP BY source_id")
def _(t):
    return narrative.best_lag(narrative.lead_lag(source_series(t)))


@query("synchrony_pairs", SERIES + f""", pr AS (SELECT s.country, a.source_id AS x, b.source_id AS y, {guarded('a.change', 'b.change', 5)} AS r FROM ch a JOIN sources s USING (source_id) JOIN ch b ON a.period_start = b.period_start AND a.source_id < b.source_id
  JOIN sources o ON o.source_id = b.source_id AND o.country = s.country GROUP BY ALL) SELECT country, {r('abs(avg(r))')} AS synchrony, count(*) AS pairs FROM pr WHERE r IS NOT NULL GROUP BY country""")
def _(t):
    return narrative.synchrony(source_series(t), t.sources)


@query("weekly_drift", QUARTERS + f""", s AS (SELECT *, (mean_power + mean_moral) / 2 AS sentiment FROM cells)
SELECT a.source_id, a.entity_id, a.period_start, {r('a.sentiment')} AS sentiment, {r('a.sentiment - b.sentiment')} AS change, a.n FROM s a JOIN s b ON a.source_id = b.source_id AND a.entity_id = b.entity_id AND b.period_start = a.period_start - INTERVAL 3 MONTH""")
def _(t):
    return rollups.period_drift(quarter_cells(t))


@query("editorial_shift_z", QUARTERS + f""", es AS (SELECT entity_id, period_start, avg(mean_moral) AS value FROM cells GROUP BY ALL),
p AS (SELECT a.entity_id, a.period_start, any_value(a.value) AS value, count(*) AS k, avg(b.value) AS m, stddev_pop(b.value) AS sd FROM es a JOIN es b ON a.entity_id = b.entity_id AND b.period_start < a.period_start GROUP BY ALL)
SELECT entity_id, period_start, {r('value')} AS value, {r('CASE WHEN sd > 1e-9 THEN abs(value - m) / sd END')} AS z, coalesce(CASE WHEN sd > 1e-9 THEN abs(value - m) / sd > 2 END, false) AS flagged FROM p WHERE k >= 2""")
def _(t):
    return rollups.expanding_z(rollups.entity_series(quarter_cells(t)))


@query("entity_volatility", f"""m AS (SELECT *, (power + moral) / 2 AS s FROM mentions WHERE moral IS NOT NULL AND publish_date BETWEEN '{YEAR}' AND '{END}'), ps AS (SELECT entity_id, source_id, avg(s) AS a, count(*) AS k FROM m GROUP BY ALL),
d AS (SELECT entity_id, round(coalesce(var_samp(a) FILTER (WHERE k >= 2), 0), 12) AS divergence FROM ps GROUP BY entity_id), e AS (SELECT entity_id, count(*) AS mentions, count(DISTINCT source_id) AS sources, stddev_samp(s) AS deviation FROM m GROUP BY entity_id HAVING count(DISTINCT source_id) >= 5 AND count(*) >= 20)
SELECT entity_id, mentions, sources, {r('deviation')} AS deviation, {r('divergence')} AS divergence, {r('0.6 * divergence + 0.4 * deviation')} AS volatility FROM e JOIN d USING (entity_id)""")
def _(t):
    return rollups.volatility(t.mentions, YEAR, END)


@query("dense_window_islands", CELLS.format(grain="week") + """, cov AS (SELECT period_start, count(DISTINCT source_id) AS sources, sum(n)::BIGINT AS mentions FROM cells GROUP BY ALL),
isl AS (SELECT *, period_start - (7 * row_number() OVER (ORDER BY period_start))::INT AS island FROM cov WHERE sources >= 20) SELECT min(period_start) AS start_week, max(period_start) AS end_week, count(*) AS weeks, sum(mentions)::BIGINT AS mentions FROM isl GROUP BY island""")
def _(t):
    return rollups.dense_windows(rollups.coverage(rollups.cells(t.mentions, "week")))


# similarity -----------------------------------------------------------------------------------------------------


@query("pearson_pairs", PAIRS + f" SELECT a, b, {r('r')} AS r, common FROM pairs")
def _(t):
    return similarity.pearson_pairs(similarity_cells(t))


@query("source_neighbors", PAIRS + f""", e AS (SELECT CASE WHEN a = {SOURCE} THEN b ELSE a END AS b, round(r, 6) + 0.0 AS r, common FROM pairs WHERE {SOURCE} IN (a, b) AND r IS NOT NULL), o AS (SELECT *, row_number() OVER (ORDER BY r DESC, b)::INT AS near, row_number() OVER (ORDER BY r, b)::INT AS far, count(*) OVER () AS al FROM e)
SELECT 'nearest' AS kind, near AS rank, b, r, common FROM o WHERE near <= 5 UNION ALL SELECT 'farthest', far, b, r, common FROM o WHERE far <= 5 AND al > 5""")
def _(t):
    return similarity.neighbours(similarity.pearson_pairs(similarity_cells(t)), SOURCE)


@query("similarity_matrix", PAIRS + f""", w AS (SELECT a, b, r, common, 0.25::DOUBLE + 0.75::DOUBLE * least(1, common / 50::DOUBLE) AS weight FROM pairs)
SELECT a, b, {r('r')} AS r, common, {r('weight')} AS weight FROM w UNION ALL SELECT b, a, {r('r')}, common, {r('weight')} FROM w UNION ALL SELECT source_id, source_id, 1.0::DOUBLE, NULL, 1.0::DOUBLE FROM sources""")
def _(t):
    return similarity.full_matrix(similarity.pearson_pairs(similarity_cells(t)), t.sources)


@query("pair_scatter", WINDOW_CELLS + f""" SELECT entity_id, {r('a.value')} AS value_a, a.n AS n_a, {r('b.value')} AS value_b, b.n AS n_b, least(a.n, b.n) AS coverage FROM wcells a JOIN wcells b USING (entity_id) WHERE a.source_id = {SOURCE} AND b.source_id = {OTHER} ORDER BY coverage DESC, entity_id LIMIT 50""")
def _(t):
    return similarity.pair_scatter(similarity_cells(t), SOURCE, OTHER)


@query("source_vectors", WINDOW_CELLS + ", cv AS (SELECT entity_id FROM wcells GROUP BY entity_id HAVING count(DISTINCT source_id) >= 2) SELECT source_id, entity_id, round(value, 2) + 0.0 AS value, n FROM wcells WHERE entity_id IN (SELECT entity_id FROM cv)")
def _(t):
    return similarity.source_vectors(similarity_cells(t))


@query("dividing_entities", WINDOW_CELLS + f""", g AS (SELECT entity_id, region, count(*) AS k, avg(value) AS m, var_pop(value) AS v FROM wcells JOIN sources USING (source_id) GROUP BY ALL HAVING count(*) >= 2),
a AS (SELECT entity_id, count(*) AS groups, sum(k)::BIGINT AS sources, sum(k * m) AS t, sum(k * m * m) AS sq, sum(k * v) AS w FROM g GROUP BY entity_id HAVING count(*) >= 2),
f AS (SELECT entity_id, groups, sources, (sq - t * t / sources) / (groups - 1) AS between_, coalesce(w / nullif(sources - groups, 0), 0) AS inside FROM a)
SELECT entity_id, groups, sources, {r('between_')} AS "between", {r('inside')} AS inside, {r('between_ / (inside + 0.05)')} AS f FROM f WHERE round(between_ / (inside + 0.05), 6) >= 3""")
def _(t):
    return similarity.dividing_entities(similarity_cells(t), t.sources.select("source_id", F.col("region").alias("grp")))


PPMI = """d AS (SELECT DISTINCT article_id, entity_id FROM mentions WHERE entity_id IN (SELECT entity_id FROM mentions GROUP BY entity_id HAVING count(*) >= 15)),
c AS (SELECT a.entity_id AS a, b.entity_id AS b, count(*) AS together FROM d a JOIN d b ON a.article_id = b.article_id AND a.entity_id < b.entity_id GROUP BY ALL),
m AS (SELECT e, sum(k) AS margin FROM (SELECT a AS e, together AS k FROM c UNION ALL SELECT b, together FROM c) GROUP BY e)"""


@query("ppmi_cooccurrence", PPMI + f" SELECT c.a, c.b, together, {r('greatest(0, log2(together::DOUBLE * (2 * (SELECT sum(together) FROM c)) / (x.margin::DOUBLE * y.margin)))')} AS ppmi FROM c JOIN m x ON x.e = a JOIN m y ON y.e = b")
def _(t):
    return similarity.ppmi(t.mentions)


@query("cosine_neighbors", f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), p AS (SELECT q.vec_id AS query, v.vec_id, {r('coalesce(list_cosine_similarity(q.e, v.e), 0)')} AS cosine FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query, vec_id, cosine, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id)::INT AS rank FROM p QUALIFY rank <= 5""", with_views=False)
def _(t):
    vectors = t.table("embeddings")
    return similarity.cosine_neighbours(vectors, vectors.where(F.col("vec_id") % 50 == 0).select("vec_id"))


@query("similar_articles_jaccard", f"""c AS (SELECT article_id, publish_date, entity_id, avg(power) AS p, avg(moral) AS m FROM mentions WHERE moral IS NOT NULL GROUP BY ALL), own AS (SELECT * FROM c WHERE article_id = 100),
near AS (SELECT c.* FROM c WHERE article_id <> 100 AND publish_date BETWEEN (SELECT max(publish_date) FROM own) - 30 AND (SELECT max(publish_date) FROM own) + 30),
s AS (SELECT near.article_id, count(own.p) AS shared, count(*) AS k, avg(sqrt((near.p - own.p) ** 2 + (near.m - own.m) ** 2)) AS distance FROM near LEFT JOIN own USING (entity_id) GROUP BY near.article_id)
SELECT article_id, shared, {r('shared / ((SELECT count(*) FROM own) + k - shared)')} AS jaccard, {r('distance')} AS distance FROM s WHERE shared > 0 AND shared / ((SELECT count(*) FROM own) + k - shared) >= 0.1""")
def _(t):
    return similarity.similar_articles(t.mentions, 100, days=30, least=0.1)


@query("spearman_ranks", WINDOW_CELLS + f""", k AS (SELECT source_id, value, n::DOUBLE AS n, rank() OVER (PARTITION BY source_id ORDER BY value) + (count(*) OVER (PARTITION BY source_id, value) - 1) / 2 AS rx, rank() OVER (PARTITION BY source_id ORDER BY n) + (count(*) OVER (PARTITION BY source_id, n) - 1) / 2 AS ry FROM wcells)
SELECT source_id, {r(guarded('rx', 'ry', 3))} AS rho, count(*) AS n FROM k GROUP BY source_id""")
def _(t):
    return similarity.spearman(similarity_cells(t).withColumn("value", F.col("value")), "value", "n", ("source_id",))


@query("poll_window_join", f"""polls AS (SELECT o_orderkey AS poll_id, o_orderkey % 40 AS entity_id, CAST(o_orderdate AS DATE) AS lo, o_totalprice AS value_pct FROM orders)
SELECT poll_id, entity_id, {r('value_pct')} AS value_pct, {r('avg(moral)')} AS reading, count(moral) AS n FROM polls JOIN mentions USING (entity_id) WHERE publish_date BETWEEN lo - 30 AND lo + 7 + 30 GROUP BY poll_id, entity_id, value_pct""")
def _(t):
    o = t.table("orders")
    day = F.to_date("o_orderdate")
    polls = o.select(F.col("o_orderkey").alias("poll_id"), (F.col("o_orderkey") % 40).alias("entity_id"), day.alias("field_start"), F.date_add(day, 7).alias("field_end"), F.col("o_totalprice").alias("value_pct"))
    return similarity.poll_readings(polls, t.mentions)


@query("entity_cosine", WINDOW_CELLS + f""", nm AS (SELECT entity_id, sqrt(sum(value * value)) AS norm FROM wcells GROUP BY entity_id HAVING count(*) >= 3 AND sqrt(sum(value * value)) > 1e-9), u AS (SELECT entity_id, source_id, value / norm AS v FROM wcells JOIN nm USING (entity_id))
SELECT a.entity_id AS a, b.entity_id AS b, {r('sum(a.v * b.v)')} AS cosine, count(*) AS common FROM u a JOIN u b ON a.source_id = b.source_id AND a.entity_id < b.entity_id GROUP BY ALL""")
def _(t):
    return similarity.entity_cosine(similarity_cells(t))


# identity and search --------------------------------------------------------------------------------------------


@query("entity_merge_exact", r"""k AS (SELECT id, lower(trim(regexp_replace(name, '\s+', ' ', 'g'))) AS merge_key, count(mention_id) AS mentions FROM entities LEFT JOIN mentions ON raw_id = id GROUP BY id, name)
SELECT id, merge_key, mentions, first_value(id) OVER (PARTITION BY merge_key ORDER BY mentions DESC, id) AS merged_into, count(*) OVER (PARTITION BY merge_key) AS members, sum(mentions) OVER (PARTITION BY merge_key)::BIGINT AS group_mentions FROM k""")
def _(t):
    return entities.merge_exact(t.mentions, t.entities)


@query("duplicate_name_groups", """k AS (SELECT id, name, entity_type, count(mention_id) AS k FROM entities LEFT JOIN mentions ON raw_id = id GROUP BY ALL)
SELECT name, count(DISTINCT entity_type) AS types, sum(k)::BIGINT AS mentions, count(*) AS members, arg_max(id, (k, -id)) AS first_id FROM k GROUP BY name HAVING count(DISTINCT entity_type) > 1 AND sum(k) >= 1""")
def _(t):
    return entities.duplicate_groups(t.mentions, t.entities)


@query("entity_prune_candidates", f"""s AS (SELECT raw_id AS id, count(*) AS mentions, min(publish_date) AS first_seen FROM mentions GROUP BY raw_id), days AS (SELECT DISTINCT scraped_at AS day FROM articles),
e AS (SELECT id, name, coalesce(mentions, 0) AS mentions, coalesce(first_seen, (SELECT min(day) FROM days)) AS since FROM entities LEFT JOIN s USING (id) WHERE canonical_id IS NULL AND id NOT IN (SELECT canonical_id FROM entities WHERE canonical_id IS NOT NULL) AND id % 5 <> 0),
k AS (SELECT *, least(ceil((SELECT count(*) FROM days WHERE day >= since) / 7), 12)::INT AS threshold FROM e)
SELECT id, name, mentions, threshold FROM k WHERE mentions <= threshold AND date_diff('day', since, DATE '{END}') >= 7""")
def _(t):
    # every fifth entity is preserved
    metadata = F.when(F.col("id") % 5 == 0, F.to_json(F.struct(F.lit("true").alias("preserve"))))
    return entities.prune_candidates(t.mentions, t.entities.withColumn("metadata", metadata), t.articles.select(F.col("scraped_at").alias("day")), END)


@query("tiered_search", """h AS (SELECT coalesce(canonical_id, id) AS entity_id, min(CASE WHEN starts_with(lower(name), 're') THEN 1 WHEN contains(lower(name), ' re') THEN 2 WHEN contains(lower(name), 're') THEN 3 END) AS tier FROM entities WHERE contains(lower(name), 're') GROUP BY ALL),
k AS (SELECT entity_id, count(*) AS k FROM mentions GROUP BY entity_id) SELECT entity_id, tier, name, entity_type, coalesce(k, 0) AS mentions FROM h JOIN entities ON id = entity_id LEFT JOIN k USING (entity_id) ORDER BY tier, mentions DESC, name, entity_id LIMIT 15""")
def _(t):
    return entities.search(t.mentions, t.entities, "re")


@query("latest_cluster_per_source", """a AS (SELECT source_id, article_id, publish_date, status FROM articles) SELECT source_id, article_id, publish_date, status FROM a QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY publish_date DESC, article_id DESC) = 1""")
def _(t):
    best = t.articles.groupBy("source_id").agg(F.max(F.struct("publish_date", "article_id", "status")).alias("b"))
    return best.select("source_id", "b.article_id", "b.publish_date", "b.status")


@query("document_shortlist", r"""WITH docs AS (SELECT doc_id, lower(text) AS text, list_distinct(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS ws FROM documents),
nm AS (SELECT lower(text) AS name, item_id AS mentions, regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')[1] AS key FROM benchmark),
h AS (SELECT DISTINCT doc_id, name, mentions FROM (SELECT doc_id, text, unnest(ws) AS key FROM docs) d JOIN nm USING (key) WHERE key <> '' AND contains(d.text, name))
SELECT doc_id, name, mentions, row_number() OVER (PARTITION BY doc_id ORDER BY mentions DESC, name)::INT AS rank FROM h QUALIFY rank <= 30""", with_views=False)
def _(t):
    return entities.shortlist(t.table("documents"), t.table("benchmark").select(F.col("text").alias("name"), F.col("item_id").alias("mentions")))


# pages ----------------------------------------------------------------------------------------------------------


@query("url_filter", r"""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)) AS p FROM pages), d AS (SELECT *, len(list_filter(string_split(p, '/'), lambda x: x <> '')) AS depth FROM p)
SELECT page_id, contains(url, '://') AND depth > 0 AND NOT (ends_with(rtrim(url), '/') AND depth < 2 AND NOT contains(p, '-')) AND NOT regexp_matches(lower(url), '""" + "|".join(T.BLOCKED_PATHS) + """') AS is_article FROM d""", with_views=False)
def _(t):
    return t.table("pages").select("page_id", T.looks_like_article("url").alias("is_article"))


@query("registered_domain", r"""WITH h AS (SELECT page_id, url, regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]*)', 1), '^www\.', '') AS h FROM pages), l AS (SELECT *, string_split(h, '.') AS l FROM h)
SELECT page_id, h AS host, CASE WHEN len(l) < 2 THEN h WHEN len(l) > 2 AND array_to_string(l[-2:], '.') IN (""" + ", ".join(f"'{x}'" for x in T.TWO_LEVEL) + r""") THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain, md5(url) AS article_id FROM l""", with_views=False)
def _(t):
    return t.table("pages").select("page_id", T.host("url").alias("host"), T.registered_domain("url").alias("domain"), T.article_id("url").alias("article_id"))


@query("normalized_urls", "WITH a AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages), b AS (SELECT page_id, regexp_replace(u, '([?&])(?:" + "|".join(T.TRACKING) + r""")=[^&]*(&|$)', '\1', 'g') AS u FROM a)
SELECT page_id, regexp_replace(u, '[?&]$', '') AS url FROM b""", with_views=False)
def _(t):
    return t.table("pages").select("page_id", T.normalize_url("url").alias("url"))


# queries that SQL does not express ----------------------------------------------------------------------------


def _regions(t: News) -> DataFrame:
    return t.sources.select("source_id", F.concat(F.lit("region "), F.col("region")).alias("grp"))


@query("source_clusters")
def _(t):
    return clustering.source_clusters(similarity_cells(t), threshold=0.2)


def _monthly(t: News):
    """Regions are the countries, as the tables have five sources a country and a tier of its own needs eight."""
    sources = t.articles.where(F.col("publish_date") >= WINDOW).groupBy("source_id", F.concat(F.lit("region "), F.col("region")).alias("country")).agg(F.count("*").alias("articles"))
    return clustering.monthly_clusters(similarity.pearson_pairs(similarity_cells(t)), sources, height=0.8)


@query("country_clusters")
def _(t):
    return _monthly(t)[0]


@query("country_cluster_quality")
def _(t):
    return _monthly(t)[1]


def _stored(t: News, rows: DataFrame, name: str, by: str) -> DataFrame:
    """``rows`` after they were stored twice over: a rerun replaces its own partition."""
    import uuid

    from ..sources.writers import replace_partitions

    path = f"{shared_dir(t.spark)}/{name}_{uuid.uuid4().hex}"
    for _ in range(2):
        replace_partitions(rows.withColumn("part", F.col(by).cast("string")), path, "part")
    return t.spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


WEEK = "2001-07-30"
WEEKLY = CELLS.format(grain="week") + f""", wcells AS (
  SELECT source_id, entity_id, sum(mean_moral * n) / sum(n) AS value FROM cells WHERE period_start BETWEEN DATE '{WEEK}' - 7 * 51 AND DATE '{WEEK}' GROUP BY ALL
), pairs AS (
  SELECT a.source_id AS a, b.source_id AS b, {guarded('a.value', 'b.value', 10)} AS r, count(*) AS common
  FROM wcells a JOIN wcells b ON a.entity_id = b.entity_id AND a.source_id < b.source_id GROUP BY ALL
) SELECT a, b, {r('r')} AS r, common, 'pearson_common' AS method, TIMESTAMP '{WEEK}' - INTERVAL 357 DAY AS window_start, TIMESTAMP '{WEEK}' + INTERVAL 7 DAY - INTERVAL 1 SECOND AS window_end FROM pairs WHERE r IS NOT NULL"""


@query("weekly_similarity_pairs", WEEKLY)
def _(t):
    pairs, _ = clustering.weekly_similarity(rollups.cells(t.mentions, "week"), WEEK, weeks=52)
    return _stored(t, pairs, "pairs", "window_end")


@query("weekly_similarity_clusters")
def _(t):
    _, clusters = clustering.weekly_similarity(rollups.cells(t.mentions, "week"), WEEK, weeks=52, threshold=0.2)
    return _stored(t, clusters, "clusters", "assigned_date")


@query("source_map_mds")
def _(t):
    return clustering.source_map(similarity_cells(t), t.sources.select("source_id", "country"))


#: Sources drop out until all have three known pairs; in SQL this is so many rounds, more than the tables take.
_ROUNDS = 8
_CORES = ", ".join(f"k{i + 1} AS (SELECT s FROM (SELECT a AS s FROM mp WHERE r IS NOT NULL AND a IN (FROM k{i}) AND b IN (FROM k{i}) UNION ALL SELECT b FROM mp WHERE r IS NOT NULL AND a IN (FROM k{i}) AND b IN (FROM k{i})) GROUP BY s HAVING count(*) >= 3)" for i in range(_ROUNDS))


@query("mappable_pairs", WINDOW_CELLS + f""", wide AS (SELECT entity_id FROM wcells JOIN sources USING (source_id) GROUP BY entity_id HAVING count(DISTINCT country) >= 3), sh AS (SELECT * FROM wcells WHERE entity_id IN (FROM wide)),
cov AS (SELECT source_id FROM sh GROUP BY source_id HAVING count(*) >= 10), mc AS (SELECT * FROM sh WHERE source_id IN (FROM cov)),
mp AS (SELECT a.source_id AS a, b.source_id AS b, {guarded('a.value', 'b.value', 10)} AS r, count(*) AS common FROM mc a JOIN mc b ON a.entity_id = b.entity_id AND a.source_id < b.source_id GROUP BY ALL),
k0 AS (SELECT source_id AS s FROM cov), {_CORES}
SELECT a, b, {r('r')} AS r, common FROM mp WHERE a IN (FROM k{_ROUNDS}) AND b IN (FROM k{_ROUNDS}) AND (SELECT count(*) FROM k{_ROUNDS}) >= 3""")
def _(t):
    return clustering.mappable(similarity_cells(t), t.sources.select("source_id", "country"))[1]


@query("axis_correlates")
def _(t):
    cells = similarity_cells(t)
    return clustering.axis_anatomy(cells, clustering.source_map(cells, t.sources.select("source_id", "country")))


@query("seriation")
def _(t):
    return clustering.seriation(similarity_cells(t), _regions(t))


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.select("entity_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query("entity_embeddings_svd")
def _(t):
    return _vectors(decomposition.entity_embeddings(similarity.ppmi(t.mentions)))


@query("sentiment_embeddings_svd")
def _(t):
    return _vectors(decomposition.sentiment_embeddings(rollups.cells(t.mentions, "week")))


@query("entity_dbscan", "WITH RECURSIVE c AS (" + ORACLES["entity_cosine"] + """), e AS (SELECT a, b FROM c WHERE cosine >= 0.6 UNION ALL SELECT b, a FROM c WHERE cosine >= 0.6),
reach AS (SELECT a AS id, a AS node FROM e UNION SELECT id, b FROM reach JOIN e ON node = a), g AS (SELECT id, min(node) AS root FROM reach GROUP BY id)
SELECT entity_id, coalesce(root, -1)::BIGINT AS group_id FROM (SELECT a AS entity_id FROM c UNION SELECT b FROM c) LEFT JOIN g ON id = entity_id""", with_views=False)
def _(t):
    return clustering.entity_groups(similarity.entity_cosine(similarity_cells(t)), 0.6)


REACH = 0.95
TOPICS = SQL.replace("WITH", "WITH RECURSIVE", 1) + f"""d AS (SELECT DISTINCT article_id, entity_id FROM mentions WHERE entity_id IN (SELECT entity_id FROM mentions GROUP BY entity_id HAVING count(*) >= 3)),
k AS (SELECT entity_id, count(*) AS k FROM d GROUP BY entity_id), c AS (SELECT a.entity_id AS a, b.entity_id AS b, count(*) AS together FROM d a JOIN d b ON a.article_id = b.article_id AND a.entity_id < b.entity_id GROUP BY ALL),
sh AS (SELECT a, b, together::DOUBLE / least(x.k, y.k) AS share FROM c JOIN k x ON x.entity_id = a JOIN k y ON y.entity_id = b), n AS (SELECT a, b FROM sh WHERE round(1 - share, 12) <= {REACH} UNION ALL SELECT b, a FROM sh WHERE round(1 - share, 12) <= {REACH}),
core AS (SELECT a AS id FROM n GROUP BY a HAVING count(*) + 1 >= 3), walk AS (SELECT id, id AS node FROM core UNION SELECT walk.id, b FROM walk JOIN n ON node = a JOIN core ON core.id = b),
own AS (SELECT id, min(node) AS topic FROM walk GROUP BY id), m AS (SELECT topic, id AS entity_id FROM own UNION ALL SELECT min(topic), a FROM n JOIN own ON own.id = b WHERE a NOT IN (SELECT id FROM core) GROUP BY a)
"""


@query("topic_clusters", TOPICS + "SELECT topic, entity_id FROM m", with_views=False)
def _(t):
    return clustering.topic_clusters(similarity.ppmi(t.mentions, least=3), t.mentions, t.entities, reach=REACH)[0]


@query("topic_names", TOPICS + f""", s AS (SELECT x.topic, sum(share) AS share FROM sh JOIN m x ON x.entity_id = a JOIN m y ON y.entity_id = b AND x.topic = y.topic GROUP BY x.topic),
e AS (SELECT topic, name, entity_id, CASE entity_type WHEN 'person' THEN 1 WHEN 'organization' THEN 2 WHEN 'country' THEN 3 ELSE 4 END AS kind FROM m JOIN entities ON id = entity_id WHERE canonical_id IS NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY topic, kind ORDER BY entity_id) AS i, min(kind) OVER (PARTITION BY topic) AS best FROM e), w AS (SELECT topic, string_agg(name, ' & ' ORDER BY entity_id) AS name FROM f WHERE kind = best AND i <= 2 GROUP BY topic)
SELECT topic, members, {r('coalesce(share, 0) / (members * (members - 1) / 2)')} AS coherence, name FROM (SELECT topic, count(*) AS members FROM m GROUP BY topic) JOIN w USING (topic) LEFT JOIN s USING (topic)""", with_views=False)
def _(t):
    return clustering.topic_clusters(similarity.ppmi(t.mentions, least=3), t.mentions, t.entities, reach=REACH)[1]


@query("source_kmeans")
def _(t):
    return source_vectors.kmeans(source_vectors.vectors(t.mentions, YEAR, END), 5)


@query("lead_lag_permutation")
def _(t):
    return clustering.lead_lag_tests(source_series(t))


@query("layered_normal_significance")
def _(t):
    return clustering.layered_significance(publishers.layers(t.mentions))


@query("layered_fisher")
def _(t):
    return clustering.combined_significance(clustering.layered_significance(publishers.layers(t.mentions)), t.sources)


@query("fuzzy_review_band")
def _(t):
    # the tables' names are far apart, so spellings of some of them come with them
    spellings = t.spark.createDataFrame([(x,) for x in ("small rings", "red widgett", "blue bolts", "hot gears", "small gizmos", "smal gizmo", "hot geear")], "name string")
    return entities.fuzzy_review(t.entities.select(T.normalize_name("name", "entity_type").alias("name")).unionByName(spellings))


@query("html_to_text")
def _(t):
    return t.table("pages").select("page_id", T.html_article("html").alias("h")).select("page_id", "h.title", "h.text", "h.published")


@query("jsonl_ingest", f"""d AS (SELECT CAST(article_id AS VARCHAR) AS article_id, country, CAST(raw_id AS VARCHAR) AS name, 'country' AS entity_type, coalesce(power, 0) AS power, coalesce(moral, 0) AS moral FROM mentions)
SELECT article_id, country, name, entity_type, {r('power')} AS power, {r('moral')} AS moral FROM d""")
def _(t):
    from ..sources.readers import parse_results

    lines = t.mentions.groupBy("article_id").agg(F.first("country").alias("c"), F.collect_list(F.struct(F.col("raw_id").cast("string").alias("entity"), F.lit("country").alias("entity_type"), F.col("power").cast("string").alias("power_score"), F.col("moral").cast("string").alias("moral_score"))).alias("e"))
    content = F.to_json(F.struct(F.col("c").alias("source_country"), F.col("e").alias("entities")))
    body = F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices"))
    line = F.to_json(F.struct(F.col("article_id").cast("string").alias("custom_id"), F.struct(F.lit(200).alias("status_code"), body.alias("body")).alias("response")))
    return parse_results(lines.select(line.alias("value")))[0]


@query("snapshot_export", """d AS (SELECT entity_id, publish_date, avg(power) AS avg_power, avg(moral) AS avg_moral, count(*) AS mentions FROM mentions GROUP BY ALL)
SELECT entity_id, publish_date, round(avg_power, 4) + 0.0 AS avg_power, round(avg_moral, 4) + 0.0 AS avg_moral, mentions FROM d""")
def _(t):
    from ..sources.writers import rounded_json

    # the lines as they are written, read back
    rows = entities.daily(t.mentions)
    lines = rows.select(rounded_json(rows).alias("json")).select(F.from_json("json", rows.schema).alias("r")).select("r.*")
    return lines


def _stream(name: str, build: Callable, mode: str = "append"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        import uuid

        from ..streaming import jobs

        place = f"{shared_dir(spark)}/{name}_{uuid.uuid4().hex}"
        return jobs.run_to_table(build(jobs, jobs.events(spark, sf_dir)), f"{place}/rows", f"{place}/checkpoint", mode)

    QUERIES[name] = run


_stream("stream_tumbling", lambda jobs, e: jobs.windowed(e), "complete")
_stream("stream_weekly", lambda jobs, e: jobs.windowed(e, "7 days", start="4 days"), "complete")
_stream("stream_sliding", lambda jobs, e: jobs.windowed(e, "7 days", "1 day"), "complete")
_stream("stream_sessions", lambda jobs, e: jobs.sessions(e))
_stream("stream_dedup_upsert", lambda jobs, e: jobs.deduplicated(e).select("event_id", "ts", "event_type"))
_stream("stream_lease_timeout", lambda jobs, e: jobs.leases(e))

#: Feeds of a hundred pages each, RSS and Atom in turn; every seventh page's entry has no link.
FEED_PAGES = 100


def _feed_documents(t: News) -> DataFrame:
    """(feed, value): the pages as entries of feed documents."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    link = F.when(F.col("page_id") % 7 != 0, safe(F.coalesce("url", F.lit(""))))
    at = F.timestamp_seconds(1704067200 + F.col("page_id") * 61)
    feed = F.floor(F.col("page_id") / FEED_PAGES)
    rss = F.concat(F.lit("<item><title>page "), "page_id", F.lit("</title>"), F.coalesce(F.concat(F.lit("<link>"), link, F.lit("</link>")), F.lit("")), F.lit("<pubDate>"), F.date_format(at + F.expr("INTERVAL 2 HOURS"), "dd MMM yyyy HH:mm:ss"), F.lit(" +0200</pubDate></item>"))
    atom = F.concat(F.lit("<entry><title>page "), "page_id", F.lit("</title>"), F.coalesce(F.concat(F.lit('<link href="'), link, F.lit('"/>')), F.lit("")), F.lit("<updated>"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z</updated></entry>"))
    entries = t.table("pages").select(feed.alias("feed"), F.when(feed % 2 == 0, rss).otherwise(atom).alias("e"))
    body = entries.groupBy("feed").agg(F.array_join(F.array_sort(F.collect_list("e")), "").alias("b"))  # a hundred at most
    return body.select("feed", F.when(F.col("feed") % 2 == 0, F.concat(F.lit("<rss><channel>"), "b", F.lit("</channel></rss>"))).otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), "b", F.lit("</feed>"))).alias("value"))


@query("feed_entries", f"""SELECT md5(url) AS id, url AS link, 'page ' || page_id AS title, TIMESTAMP '2024-01-01' + to_seconds(page_id * 61) AS published, NULL AS reason, CASE WHEN page_id // {FEED_PAGES} % 2 = 0 THEN 'rss' ELSE 'atom' END AS format FROM (SELECT page_id, trim(url) AS url FROM pages) WHERE page_id % 7 <> 0 AND url <> ''
UNION ALL SELECT NULL, NULL, 'page ' || page_id, TIMESTAMP '2024-01-01' + to_seconds(page_id * 61), 'no link', CASE WHEN page_id // {FEED_PAGES} % 2 = 0 THEN 'rss' ELSE 'atom' END FROM pages WHERE page_id % 7 = 0 OR coalesce(trim(url), '') = ''""", with_views=False)
def _(t):
    import uuid

    from ..streaming import feeds, jobs

    place = f"{shared_dir(t.spark)}/feeds_{uuid.uuid4().hex}"
    _feed_documents(t).write.partitionBy("feed").text(f"{place}/in")
    return jobs.run_to_table(feeds.entries(feeds.feed_files(t.spark, f"{place}/in")), f"{place}/rows", f"{place}/checkpoint").drop("feed", "summary")


_EVENT_WINDOWS = "SELECT {w} AS window_start, {w} + INTERVAL {d} DAY AS window_end, event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM events {j} GROUP BY ALL"
ORACLES["stream_tumbling"] = _EVENT_WINDOWS.format(w="date_trunc('day', ts)", d=1, j="")
ORACLES["stream_weekly"] = _EVENT_WINDOWS.format(w="date_trunc('week', ts)", d=7, j="")
ORACLES["stream_sliding"] = _EVENT_WINDOWS.format(w="date_trunc('day', ts) - to_days(k)", d=7, j="CROSS JOIN (SELECT unnest(range(0, 7))::INT AS k)")
ORACLES["stream_dedup_upsert"] = "SELECT event_id, ts, event_type FROM events"
#: A session is out when the watermark, a day behind the last event, has passed its end.
ORACLES["stream_sessions"] = """WITH f AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM f)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM g GROUP BY user_id, g HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)"""
