"""Readings by source and country: activity, agenda, scatter, spreads and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .entities import readings, summary, top
from .rollups import PERIOD, between, with_totals


def source_detail(articles: DataFrame, mentions: DataFrame, source_id: int, limit: int = 10) -> DataFrame:
    """A source's top entities, with its numbers of articles and mentions beside each."""
    n = articles.where(F.col("source_id") == source_id).groupBy("source_id").agg(F.count("*").alias("articles"))
    rows = mentions.where(F.col("source_id") == source_id)
    best = top(summary(rows, "source_id", "entity_id"), limit)
    return best.join(n, "source_id", "left")


def source_daily(mentions: DataFrame, source_id: int, start: str | None = None, end: str | None = None) -> DataFrame:
    return summary(between(mentions.where(F.col("source_id") == source_id), start, end), "publish_date")


def active_sources(mentions: DataFrame, start: str | None = None, end: str | None = None, least: int = 10) -> DataFrame:
    """Sources with enough analysed articles: distinct articles and entities."""
    rows = between(mentions, start, end).groupBy("source_id", "source", "country").agg(F.countDistinct("article_id").alias("articles"), F.countDistinct("entity_id").alias("entities"))
    return rows.where(F.col("articles") >= least)


def processing(articles: DataFrame, mentions: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles, completed ones, ones with mentions and percentages by source; sources without articles stay."""
    with_mentions = mentions.select("article_id").distinct().withColumn("has", F.lit(1))
    counts = articles.join(with_mentions, "article_id", "left").groupBy("source_id").agg(
        F.count("*").alias("articles"), F.count_if(F.col("status") == "completed").alias("completed"), F.count("has").alias("analysed")
    )
    rows = sources.join(counts, "source_id", "left").na.fill(0, ["articles", "completed", "analysed"])
    return rows.select("source_id", "source", "articles", "completed", "analysed", F.coalesce(F.try_divide(F.col("completed") * 100.0, "articles"), F.lit(0.0)).alias("completed_pct"))


def corpus_stats(articles: DataFrame, mentions: DataFrame) -> DataFrame:
    """One row of corpus totals and status counts."""
    a = articles.agg(
        F.count("*").alias("articles"), F.countDistinct("source_id").alias("sources"), F.min("publish_date").alias("first_date"), F.max("publish_date").alias("last_date"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "unanalyzed", "in_progress")],
    )
    m = mentions.agg(F.count("*").alias("mentions"), F.countDistinct("entity_id").alias("entities"), F.avg("power").alias("avg_power"), F.avg("moral").alias("avg_moral"))
    return a.withColumn("one", F.lit(1)).join(m.withColumn("one", F.lit(1)), "one").drop("one")


def t2_range(t2: DataFrame) -> DataFrame:
    """One row over articles' T2: how many have one, and the least, mean and greatest."""
    return t2.agg(F.count("t2").alias("measured"), F.min("t2").alias("min_t2"), F.avg("t2").alias("avg_t2"), F.max("t2").alias("max_t2"))


def status_audit(articles: DataFrame, mentions: DataFrame) -> DataFrame:
    """Articles whose status and mentions disagree, by status."""
    has = mentions.select("article_id").distinct().withColumn("has", F.lit(True))
    rows = articles.join(has, "article_id", "left").withColumn("has", F.coalesce("has", F.lit(False)))
    return rows.groupBy("status").agg(F.count("*").alias("articles"), F.count_if("has").alias("with_mentions"), F.count_if((F.col("status") == "completed") != F.col("has")).alias("inconsistent"))


def type_stats(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """By entity type: entities, unmentioned ones, mean mentions."""
    counts = mentions.groupBy(F.col("raw_id").alias("id")).agg(F.count("*").alias("k"))
    rows = entities.join(counts, "id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return rows.groupBy("entity_type").agg(F.count("*").alias("entities"), F.sum(F.when(F.col("k") == 0, 1).otherwise(0)).alias("unmentioned"), F.avg(F.col("k").cast("double")).alias("avg_mentions"))


def agenda(mentions: DataFrame, start: str, end: str, broad: int = 3, limit: int = 20) -> DataFrame:
    """Entities by how many countries cover them, with sources, mentions and means; and totals over broad ones."""
    # distinct countries and sources come from one rollup by entity, country and source
    cells = between(mentions, start, end).groupBy("entity_id", "country", "source_id").agg(F.count("*").alias("k"), F.sum("power").alias("p"), F.count("power").alias("np"), F.sum("moral").alias("m"), F.count("moral").alias("nm"))
    rows = cells.groupBy("entity_id").agg(
        F.countDistinct("country").alias("countries"), F.count("*").alias("sources"), F.sum("k").alias("mentions"),
        (F.sum("p") / F.sum("np")).alias("avg_power"), F.try_divide(F.sum("m"), F.sum("nm")).alias("avg_moral"),
    )
    rows = with_totals(rows, broad_entities=F.count_if(F.col("countries") >= broad), broad_mentions=F.sum(F.when(F.col("countries") >= broad, F.col("mentions"))))
    return rows.orderBy(F.desc("countries"), F.desc("mentions"), "entity_id").limit(limit)


def scatter(mentions: DataFrame, entity_id: int, current_from: str, previous_from: str, end: str, least: int = 3) -> DataFrame:
    """Each source's reading of an entity in the current window and the one before."""
    rows = between(mentions.where(F.col("entity_id") == entity_id), previous_from, end)
    current = (F.col("publish_date") >= F.lit(current_from).cast("date")).alias("current")
    return rows.groupBy("source_id", "source", "country", current).agg(*readings()).where(F.col("mentions") >= least)


def spread(mentions: DataFrame, start: str, end: str, gap: float = 0.5, least_sources: int = 2) -> DataFrame:
    """Largest less smallest source mean of each entity; divergent from ``gap`` on."""
    per = between(mentions, start, end).where("moral IS NOT NULL").groupBy("entity_id", "source_id").agg(F.avg("moral").alias("m"), F.count("*").alias("k"))
    rows = per.groupBy("entity_id").agg(F.count("*").alias("sources"), (F.max("m") - F.min("m")).alias("spread"), (F.sum(F.col("m") * F.col("k")) / F.sum("k")).alias("mean"))
    return rows.where(F.col("sources") >= least_sources).withColumn("divergent", F.col("spread") >= gap)


def shared_and_exclusive(mentions: DataFrame, source_ids: list[int]) -> DataFrame:
    """Entities of some sources: by how many they are covered, and the spread of their means."""
    per = mentions.where(F.col("source_id").isin(source_ids)).groupBy("entity_id", "source_id").agg(F.avg("power").alias("m"), F.count("*").alias("k"))
    rows = per.groupBy("entity_id").agg(F.count("*").alias("sources"), F.sum("k").alias("mentions"), (F.max("m") - F.min("m")).alias("spread"))
    kind = F.when(F.col("sources") == len(source_ids), "shared").when(F.col("sources") == 1, "exclusive").otherwise("partial")
    return rows.withColumn("kind", kind)


def bubble(mentions: DataFrame, source_ids: list[int], limit: int = 12) -> DataFrame:
    """Unweighted mean of the chosen sources' means against everyone's, largest gaps first."""
    chosen = mentions.where(F.col("source_id").isin(source_ids) & F.col("moral").isNotNull()).groupBy("entity_id", "source_id").agg(F.avg("moral").alias("m"))
    mine = chosen.groupBy("entity_id").agg(F.avg("m").alias("mine"), F.count("*").alias("sources"))
    base = mentions.where("moral IS NOT NULL").groupBy("entity_id").agg(F.avg("moral").alias("everyone"))
    rows = mine.join(base, "entity_id").withColumn("gap", F.col("mine") - F.col("everyone"))
    return rows.orderBy(F.desc(F.round(F.abs("gap"), 6)), "entity_id").limit(limit)


def concentration(mentions: DataFrame, k: int = 5) -> DataFrame:
    """Share of the ``k`` most mentioned entities in each country's mentions."""
    counts = mentions.groupBy("country", "entity_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("country").orderBy(F.desc("n"), "entity_id")
    rows = counts.withColumn("rank", F.row_number().over(order))
    return rows.groupBy("country").agg((F.sum(F.when(F.col("rank") <= k, F.col("n"))) / F.sum("n")).alias("share"), F.sum("n").alias("mentions"))


def layers(mentions: DataFrame, least: int = 6) -> DataFrame:
    """Global, national and source statistics of each entity in one pass of grouping sets."""
    sets = mentions.where("moral IS NOT NULL").groupingSets([["entity_id"], ["entity_id", "country"], ["entity_id", "source_id"]], "entity_id", "country", "source_id")
    rows = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.avg("moral").alias("mean"), F.stddev_pop("moral").alias("deviation"))
    layer = F.when(F.col("g") == 3, "global").when(F.col("g") == 1, "national").otherwise("source")
    return rows.where(F.col("n") >= least).select("entity_id", layer.alias("layer"), "country", "source_id", "n", "mean", "deviation")


def interval_means(mentions: DataFrame, entity_id: int, start: str, days: int = 30) -> DataFrame:
    """Means by half-open intervals of ``days`` from ``start``, by source."""
    bucket = F.floor(F.datediff("publish_date", F.lit(start).cast("date")) / days).alias("bucket")
    return summary(between(mentions.where(F.col("entity_id") == entity_id), start), "source_id", bucket)


def date_pivot(mentions: DataFrame, entity_id: int, countries: list[str], grain: str = "month") -> DataFrame:
    """A column of mean power for each of the countries, over the union of periods."""
    period = F.to_date(F.date_trunc(grain, "publish_date")).alias(PERIOD)
    rows = mentions.where((F.col("entity_id") == entity_id) & F.col("country").isin(countries))
    return rows.groupBy(period).pivot("country", countries).agg(F.avg("power"))


def volatile_sources(mentions: DataFrame, start: str, end: str, k: int = 5) -> DataFrame:
    """The ``k`` sources of each entity whose means are farthest from zero."""
    per = between(mentions, start, end).where("moral IS NOT NULL").groupBy("entity_id", "source_id").agg(F.avg("moral").alias("avg_moral"), F.count("*").alias("mentions"))
    order = Window.partitionBy("entity_id").orderBy(F.desc(F.round(F.abs("avg_moral"), 6)), "source_id")
    return per.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
