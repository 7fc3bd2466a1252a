"""Lookups by name, re-sliced series, baselines, merge groups, feeds and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rollups import with_totals

#: Types that name the same kind of entity.
COMPATIBLE = (("person", "political_leader"), ("country", "sovereign_state"), ("organization", "company"), ("location", "place"))


def source_like(sources: DataFrame, part: str) -> DataFrame:
    """The first source, by id, whose name holds ``part`` in any case; ``%`` and ``_`` in it are letters."""
    return sources.where(F.contains(F.lower("source"), F.lit(part.lower()))).orderBy("source_id").limit(1)


def resolve_names(names: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, id, entity_id): for each name the most mentioned entity of that spelling in any case, and its canonical one; null if none."""
    counts = mentions.groupBy(F.col("raw_id").alias("id")).agg(F.count("*").alias("k"))
    known = entities.join(counts, "id", "left").groupBy(F.lower("name").alias("key"))
    best = known.agg(F.max_by(F.struct("id", F.coalesce("canonical_id", "id").alias("entity_id")), F.struct(F.coalesce("k", F.lit(0)), -F.col("id"))).alias("best"))
    rows = names.select("name").distinct()
    return rows.join(best, F.lower("name") == F.col("key"), "left").select("name", "best.id", "best.entity_id")


def with_baseline(readings: DataFrame, baseline: DataFrame, fallback: DataFrame) -> DataFrame:
    """``readings`` (entity_id, name, value) with a baseline: by id, else by name in any case, else the entity's fallback; or none.

    ``baseline`` (entity_id, name, value) has one row for each id; of names that repeat the smallest id counts.
    """
    by_id = baseline.select("entity_id", F.col("value").alias("by_id"))
    by_name = baseline.groupBy(F.lower("name").alias("key")).agg(F.min_by("value", "entity_id").alias("by_name"))
    other = fallback.select("entity_id", F.col("value").alias("other"))
    rows = readings.join(by_id, "entity_id", "left").join(by_name, F.lower("name") == F.col("key"), "left").join(other, "entity_id", "left")
    how = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_name").isNotNull(), "name").when(F.col("other").isNotNull(), "fallback").otherwise("none")
    return rows.select("entity_id", "name", "value", F.coalesce("by_id", "by_name", "other").alias("baseline"), how.alias("matched"))


def resliced(base: DataFrame, as_of: str, days: tuple[int, ...] = (7, 30, 90), weighted: bool = True) -> DataFrame:
    """Means of the last ``days`` days of a daily series (key, day, value, n): weighted by mentions, or every day alike. One pass for all windows."""
    rows = base.withColumn("age", F.datediff(F.lit(as_of).cast("date"), "day")).where("age >= 0")
    rows = rows.withColumn("days", F.explode(F.array(*map(F.lit, days)))).where("age < days")
    mean = F.try_divide(F.sum(F.col("value") * F.col("n")), F.sum(F.when(F.col("value").isNotNull(), F.col("n")))) if weighted else F.avg("value")
    return rows.groupBy("key", "days").agg(mean.alias("value"), F.sum("n").alias("n"))


def merge_groups(mentions: DataFrame, entities: DataFrame, groups: tuple[tuple[str, ...], ...] = COMPATIBLE) -> DataFrame:
    """(name, grp, kept, merged, mentions): entities of one name and compatible types; the most mentioned one is kept (smallest id on ties)."""
    pairs = [F.struct(F.lit(i).alias("grp"), F.lit(kind).alias("kind")) for i, kinds in enumerate(groups) for kind in kinds]
    counts = mentions.groupBy(F.col("raw_id").alias("id")).agg(F.count("*").alias("k"))
    rows = entities.join(counts, "id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    rows = rows.withColumn("g", F.explode(F.filter(F.array(*pairs), lambda p: p["kind"] == F.col("entity_type"))))
    found = rows.groupBy("name", F.col("g.grp").alias("grp")).agg(F.max_by("id", F.struct("k", -F.col("id"))).alias("kept"), F.count("*").alias("members"), F.sum("k").alias("mentions"))
    return found.where("members > 1").select("name", "grp", "kept", (F.col("members") - 1).alias("merged"), "mentions")


def drift_feed(events: DataFrame, scope: str = "all", limit: int = 20) -> DataFrame:
    """The changepoints of least p: of ``global`` series, of a ``source`` against them, or ``all``."""
    rows = {"all": events, "global": events.where("source_id IS NULL"), "source": events.where("source_id IS NOT NULL")}[scope]
    return rows.orderBy("p_value", "entity_id", F.col("source_id").asc_nulls_first()).limit(limit)


def entity_drift(events: DataFrame, entity_id: int) -> DataFrame:
    """One entity's changepoints, global and by source."""
    return events.where(F.col("entity_id") == entity_id)


def source_drift(drift: DataFrame, source_id: int, start: str, top: int = 20) -> DataFrame:
    """One source's period changes from ``start`` on, of its ``top`` entities by mentions, with the sum of absolute changes."""
    rows = drift.where((F.col("source_id") == source_id) & (F.col("period_start") >= F.lit(start).cast("date")))
    busy = rows.groupBy("entity_id").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "entity_id").limit(top)
    rows = rows.join(busy.select("entity_id"), "entity_id", "left_semi")
    return with_totals(rows, total_change=F.sum(F.abs("change")))


def repeated_names(entities: DataFrame, limit: int = 20) -> DataFrame:
    """The names of most entities, with their types and ids in order of id."""
    groups = entities.groupBy("name").agg(F.count("*").alias("members"), F.array_sort(F.collect_list(F.struct("id", "entity_type"))).alias("all"))
    rows = groups.where("members > 1").orderBy(F.desc("members"), "name").limit(limit)
    return rows.select("name", "members", F.col("all.entity_type").alias("types"), F.col("all.id").alias("ids"))


def duplication(entities: DataFrame) -> DataFrame:
    """One row: entities, distinct names, names of several entities, and the percentage of entities whose name another one has first."""
    names = entities.groupBy("name").agg(F.count("*").alias("n"))
    totals = names.agg(F.sum("n").alias("entities"), F.count("name").alias("names"), F.count_if(F.col("n") > 1).alias("repeated"))
    return totals.withColumn("duplicate_pct", F.try_divide((F.col("entities") - F.col("names")) * 100.0, "entities"))


def latest_batches(articles: DataFrame, batch: str, attempt: str, limit: int = 5) -> DataFrame:
    """The last batches by their latest attempt, with their articles."""
    rows = articles.where(F.col(batch).isNotNull()).groupBy(batch).agg(F.max(attempt).alias("last_attempt"), F.count("*").alias("articles"))
    return rows.orderBy(F.desc("last_attempt"), batch).limit(limit)


def spend_since_midnight(ledger: DataFrame, as_of: str) -> DataFrame:
    """One row: the sum of (cost, submitted_at) since the midnight before ``as_of``; 0 without any."""
    at = F.lit(as_of).cast("timestamp_ntz")
    own = F.col("submitted_at").cast("timestamp_ntz")
    return ledger.where((own >= F.date_trunc("day", at)) & (own <= at)).agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("spend"))


def batch_cost(input_bytes: Column, n_articles: Column, in_price: float, out_price: float, output_tokens: int = 1000) -> Column:
    """Expected cost of a batch: a token for four bytes read, so many tokens written an article, at half of the prices for a million."""
    return 0.5 * (input_bytes / 4 * in_price + n_articles * output_tokens * out_price) / 1_000_000
