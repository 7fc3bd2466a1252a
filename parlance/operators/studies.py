"""Scans, curated subsets and studies: what the other modules do not cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import archetype, guarded_r
from .entities import canonical
from .rollups import PERIOD, between

#: Spellings of a few names that searches treat as one.
PATTERNS = {"us": ["us", "usa", "united states", "america"], "uk": ["uk", "united kingdom", "britain"], "eu": ["eu", "european union"]}


def articles(rows: DataFrame, only_unprocessed: bool = False, since: str | None = None, source_id: int | None = None, order: str = "publish_date", limit: int = 50) -> DataFrame:
    """Articles by date, newest first."""
    rows = between(rows, since)
    rows = rows.where(F.col("status") != "completed") if only_unprocessed else rows
    rows = rows.where(F.col("source_id") == source_id) if source_id is not None else rows
    return rows.orderBy(F.desc(order), F.desc("article_id")).limit(limit)


def mentions_of(rows: DataFrame, entity_id: int | None = None, article_id: int | None = None, limit: int = 100) -> DataFrame:
    rows = rows.where(F.col("entity_id") == entity_id) if entity_id is not None else rows
    rows = rows.where(F.col("article_id") == article_id) if article_id is not None else rows
    return rows.orderBy("mention_id").limit(limit)


def by_pattern(entities: DataFrame, name: str) -> DataFrame:
    """Entities whose names hold one of a name's spellings as whole words."""
    words = PATTERNS.get(name.lower(), [name.lower()])
    return entities.where(F.lower("name").rlike("|".join(rf"\b\Q{w}\E\b" for w in words)))


def folded_search(entities: DataFrame, query: str) -> DataFrame:
    """Names that contain the query whatever case and accents."""
    return entities.where(F.contains(F.collate("name", "UNICODE_CI_AI"), F.collate(F.lit(query), "UNICODE_CI_AI")))


def names_of_both_types(entities: DataFrame, one: str, other: str) -> DataFrame:
    names = lambda kind: entities.where(F.col("entity_type") == kind).select("name")
    return names(one).intersect(names(other))


def type_preference(mentions: DataFrame, entities: DataFrame, order: tuple[str, ...] = ("person", "organization", "country", "business", "event", "concept"), share: float = 0.2) -> DataFrame:
    """The canonical row of each name: the preferred type among those with a fifth of the most mentions."""
    counts = mentions.groupBy(F.col("raw_id").alias("id")).agg(F.count("*").alias("k"))
    rows = entities.join(counts, "id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    most = rows.groupBy("name").agg(F.max("k").alias("most"))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("entity_type")), F.lit(99))
    rows = rows.join(most, "name").where(F.col("k") >= share * F.col("most"))
    return rows.groupBy("name").agg(F.min_by("id", F.struct(rank, -F.col("k"), "id")).alias("canonical"))


def sampled_age(entities_seen: DataFrame, samples: DataFrame) -> DataFrame:
    """Sampled days since each entity was first seen: a prefix count of distinct days, looked up as of the date.

    ``entities_seen`` (id, first_seen), ``samples`` (day). One row for each day in the window, whatever the entities.
    """
    days = samples.select(F.col("day")).distinct()
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("day"))
    left = days.select("day", F.row_number().over(order).alias("days_from"))
    firsts = entities_seen.join(left, entities_seen["first_seen"] == left["day"], "left")
    return firsts.select("id", "first_seen", F.coalesce("days_from", F.lit(0)).alias("sample_days"))


def eligible_countries(sources: DataFrame, least: int = 4) -> DataFrame:
    return sources.groupBy("country").agg(F.count("*").alias("sources")).where(F.col("sources") >= least)


def top_covered(rollup: DataFrame, start: str, end: str, limit: int = 20) -> DataFrame:
    """Entities by distinct sources and periods."""
    rows = between(rollup, start, end, PERIOD).groupBy("entity_id").agg(F.countDistinct("source_id").alias("sources"), F.countDistinct(PERIOD).alias("periods"), F.sum("n").alias("mentions"))
    return rows.orderBy(F.desc("sources"), F.desc("periods"), F.desc("mentions"), "entity_id").limit(limit)


def json_by_country(rows: DataFrame) -> DataFrame:
    """Nested JSON of the sources of each country, in order."""
    made = rows.groupBy("country").agg(F.array_sort(F.collect_list(F.struct("source_id", "source"))).alias("sources"))
    return made.select("country", F.to_json("sources").alias("sources"))


def overlay(base: DataFrame, readings: DataFrame, key: str = "entity_id") -> DataFrame:
    """Baseline rows with their overlay where there is one, and overlay rows without a baseline, told apart."""
    rows = base.join(readings, key, "full_outer")
    kind = F.when(F.col("base").isNull(), "unmatched overlay").when(F.col("overlay").isNull(), "baseline only").otherwise("both")
    return rows.select(key, "base", "overlay", kind.alias("kind"), (F.col("overlay") - F.col("base")).alias("gap"))


def by_archetype(rows: DataFrame, chosen: list[str]) -> DataFrame:
    return rows.withColumn("archetype", archetype(F.round("avg_power", 6), F.round("avg_moral", 6))).where(F.col("archetype").isin(chosen))


def residuals(rollup: DataFrame, dimension: str = "moral") -> DataFrame:
    """Each source's reading less that of all sources in the period."""
    value = F.col(f"mean_{dimension}")
    overall = rollup.groupBy("entity_id", PERIOD).agg(F.avg(value).alias("overall"))
    return rollup.join(overall, ["entity_id", PERIOD]).select("entity_id", "source_id", PERIOD, (value - F.col("overall")).alias("residual"))


def event_study(series: DataFrame, event: str, before: int = 3, after: int = 3) -> DataFrame:
    """Means of the periods before an event and from it on, by key, with enough on either side."""
    at = F.lit(event).cast("date")
    order = Window.partitionBy("key", F.col(PERIOD) < at)
    rows = series.withColumn("post", F.col(PERIOD) >= at)
    rank = F.when(F.col("post"), F.row_number().over(order.orderBy(PERIOD))).otherwise(F.row_number().over(order.orderBy(F.desc(PERIOD))))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("post"), after).otherwise(before))
    out = rows.groupBy("key").agg(F.avg(F.when(~F.col("post"), F.col("value"))).alias("before"), F.avg(F.when(F.col("post"), F.col("value"))).alias("after"), F.count_if(~F.col("post")).alias("n_before"), F.count_if("post").alias("n_after"))
    return out.where("n_before >= 2 AND n_after >= 2").withColumn("change", F.col("after") - F.col("before"))


def sign_agreement(changes: DataFrame) -> DataFrame:
    """Share of keys whose change has the sign of the mean change."""
    overall = changes.agg(F.avg("change").alias("overall"))
    rows = changes.withColumn("one", F.lit(1)).join(overall.withColumn("one", F.lit(1)), "one")
    return rows.groupBy("overall").agg(F.avg((F.signum("change") == F.signum("overall")).cast("double")).alias("agreement"), F.count("*").alias("keys"))


def dividing_lines(cells: DataFrame, groups: DataFrame, dividing: DataFrame, most_groups: int = 6, limit: int = 20) -> DataFrame:
    """Group means of the entities that divide the largest groups most, aligned to the groups."""
    sizes = groups.groupBy("grp").agg(F.count("*").alias("k")).where("k >= 2").orderBy(F.desc("k"), "grp").limit(most_groups)
    best = dividing.orderBy(F.desc(F.round("between", 6)), "entity_id").limit(limit).select("entity_id", "between")
    rows = cells.join(best, "entity_id").join(groups, "source_id").join(sizes.select("grp"), "grp")
    return rows.groupBy("entity_id", "grp").agg(F.avg("value").alias("mean"), F.count("*").alias("sources"))


def distinctive(cells: DataFrame, clusters: DataFrame, k: int = 5) -> DataFrame:
    """Entities whose mean in a cluster is farthest from that of all sources."""
    overall = cells.groupBy("entity_id").agg(F.avg("value").alias("overall"))
    rows = cells.join(clusters, "source_id").groupBy("grp", "entity_id").agg(F.avg("value").alias("mean")).join(overall, "entity_id")
    rows = rows.withColumn("gap", F.col("mean") - F.col("overall"))
    order = Window.partitionBy("grp").orderBy(F.desc(F.round(F.abs("gap"), 6)), "entity_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def article_comparison(mentions: DataFrame, pairs: DataFrame, article_id: int, start: str, k: int = 5) -> DataFrame:
    """An article's entities against the means of the sources most like its own, in the days from ``start`` on."""
    own = mentions.where(F.col("article_id") == article_id).groupBy("entity_id", F.col("source_id").alias("own")).agg(F.avg("power").alias("reading"))
    source = own.select(F.col("own").alias("a")).distinct()
    both = pairs.select("a", "b", "r").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    like = both.where("r IS NOT NULL").join(source, "a", "left_semi").withColumn("r", F.round("r", 6)).orderBy(F.desc("r"), "b").limit(k).select(F.col("b").alias("source_id"))
    theirs = between(mentions, start).join(like, "source_id", "left_semi").join(own.select("entity_id"), "entity_id", "left_semi").groupBy("entity_id", "source_id").agg(F.avg("power").alias("other"))
    return own.join(theirs, "entity_id").select("entity_id", "source_id", "reading", "other", (F.col("reading") - F.col("other")).alias("difference"))


def combined_pairs(mentions: DataFrame, start: str, least: int = 5, least_mentions: int = 2) -> DataFrame:
    """The older similarity: r over entities of the mean of both scores, 0 where it is flat."""
    cells = between(mentions, start).where("moral IS NOT NULL").groupBy("source_id", "entity_id").agg(F.avg((F.col("power") + F.col("moral")) / 2).alias("v"), F.count("*").alias("n"))
    cells = cells.where(F.col("n") >= least_mentions)
    a, b = cells.alias("a"), cells.alias("b")
    pairs = a.join(b, (F.col("a.entity_id") == F.col("b.entity_id")) & (F.col("a.source_id") < F.col("b.source_id")))
    out = pairs.groupBy(F.col("a.source_id").alias("a"), F.col("b.source_id").alias("b")).agg(F.coalesce(guarded_r("a.v", "b.v", least), F.lit(0.0)).alias("r"), F.count("*").alias("common"))
    return out.where(F.col("common") >= least)


def composite_scores(mentions: DataFrame, layers: DataFrame) -> DataFrame:
    """Each article's -2 sum of log p under the global normal model of its entities, with degrees of freedom.

    The tail p of a normal is approximated in closed form (logistic in z), so it stays in SQL.
    """
    model = layers.where("layer = 'global'").select("entity_id", "mean", "deviation")
    z = F.abs(F.try_divide(F.col("moral") - F.col("mean"), F.when(F.col("deviation") > 1e-9, F.col("deviation"))))
    p = 2 / (1 + F.exp(0.07056 * z * z * z + 1.5976 * z))
    rows = mentions.where("moral IS NOT NULL").join(model, "entity_id").withColumn("p", F.coalesce(p, F.lit(0.5)))
    return rows.groupBy("article_id").agg(F.sum(-2 * F.log("p")).alias("statistic"), (2 * F.count("*")).alias("df"))


def popular(mentions: DataFrame, entities: DataFrame, limit: int = 1000) -> DataFrame:
    counts = mentions.groupBy("entity_id").agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "entity_id").limit(limit)
    return counts.join(canonical(entities), "entity_id")


def capped(rows: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """The first ``k`` rows of each key."""
    by = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def history(rows: DataFrame, as_of: str, query: str | None = None, source: str | None = None, span: str = "month", order: str = "newest") -> DataFrame:
    """Read articles by text, source and age (today, week or month before ``as_of``)."""
    day = F.lit(as_of).cast("date")
    start = {"today": day, "week": F.date_sub(day, 7), "month": F.add_months(day, -1)}[span]
    rows = rows.where((F.col("publish_date") >= start) & (F.col("publish_date") <= day))
    rows = rows.where(F.lower("source").contains(query.lower())) if query else rows
    rows = rows.where(F.col("source") == source) if source else rows
    return rows.orderBy(F.desc("publish_date") if order == "newest" else F.col("publish_date"), "article_id")
