"""Rollups of mentions to source, entity and period cells, and what is read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import r6, weighted_mean

PERIOD = "period_start"


def complete(mentions: DataFrame) -> DataFrame:
    """Mentions with both scores, a date and a source."""
    return mentions.dropna(subset=["power", "moral", "publish_date", "source_id"])


def with_totals(rows: DataFrame, **totals) -> DataFrame:
    """Columns with totals over all rows: one aggregated row joins back, so no task holds them all."""
    one = rows.agg(*[c.alias(name) for name, c in totals.items()]).withColumn("_one", F.lit(1))
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")


def between(rows: DataFrame, start: str | None = None, end: str | None = None, column: str = "publish_date") -> DataFrame:
    """Rows of the inclusive date range; an open end does not filter."""
    if start is not None:
        rows = rows.where(F.col(column) >= F.lit(start).cast("date"))
    return rows if end is None else rows.where(F.col(column) <= F.lit(end).cast("date"))


def cells(mentions: DataFrame, grain: str = "week") -> DataFrame:
    """(source_id, entity_id, period_start): mean_power, mean_moral, n. The one rollup that the statistics build on."""
    period = F.to_date(F.date_trunc(grain, "publish_date")).alias(PERIOD)
    return complete(mentions).groupBy("source_id", "entity_id", period).agg(F.avg("power").alias("mean_power"), F.avg("moral").alias("mean_moral"), F.count("*").alias("n"))


def window_cells(rollup: DataFrame, start: str, end: str | None = None, dimension: str = "moral", keys: tuple[str, ...] = ("source_id", "entity_id")) -> DataFrame:
    """Mention-weighted means over the periods from ``start`` to ``end``."""
    return between(rollup, start, end, PERIOD).groupBy(*keys).agg(weighted_mean(f"mean_{dimension}", "n").alias("value"), F.sum("n").alias("n"))


def weekly_moments(mentions: DataFrame, start: str, end: str, least: int = 5) -> DataFrame:
    """Bivariate moments of each entity's scores: means, variances, covariance, n."""
    rows = complete(between(mentions, start, end))
    out = rows.groupBy("entity_id").agg(
        F.avg("power").alias("mean_power"), F.avg("moral").alias("mean_moral"), F.var_samp("power").alias("var_power"),
        F.var_samp("moral").alias("var_moral"), F.covar_samp("power", "moral").alias("covariance"), F.count("*").alias("n"),
    )
    return out.where(F.col("n") >= least)


def article_hotelling_t2(mentions: DataFrame, moments: DataFrame, ridge: float = 1e-6, least: int = 2) -> DataFrame:
    """Hotelling's T2 of every article with at least ``least`` measured entities.

    Covariances are block diagonal (2x2 for an entity), so the quadratic form is a sum of closed forms.
    """
    dp, dm = F.col("power") - F.col("mean_power"), F.col("moral") - F.col("mean_moral")
    vp, vm, c = F.col("var_power") + ridge, F.col("var_moral") + ridge, F.col("covariance")
    term = F.try_divide(vm * dp * dp - 2 * c * dp * dm + vp * dm * dm, vp * vm - c * c)
    rows = complete(mentions).groupBy("article_id", "entity_id").agg(F.avg("power").alias("power"), F.avg("moral").alias("moral"))
    out = rows.join(moments, "entity_id").groupBy("article_id").agg(F.sum(term).alias("t2"), F.count("*").alias("entities"))
    return out.where(F.col("entities") >= least)


def t2_percentile(scored: DataFrame, parts: int = 128) -> DataFrame:
    """Percent rank of each article's T2 among all.

    Values are parted at approximate quantiles, so equal ones stay together; a rank is the count of all lower
    parts and the rank in its own, and no window holds more than a part.
    """
    rows = scored.withColumn("t2", r6("t2"))
    bounds = rows.agg(F.percentile_approx("t2", [i / parts for i in range(1, parts)], 10_000).alias("bounds"))
    rows = rows.withColumn("one", F.lit(1)).join(bounds.withColumn("one", F.lit(1)), "one")
    part = F.coalesce(F.size(F.filter("bounds", lambda x: x < F.col("t2"))), F.lit(0))
    rows = rows.withColumn("part", part).drop("one", "bounds")
    order = Window.orderBy("part").partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, -1)
    below = rows.groupBy("part").agg(F.count("*").alias("k")).withColumns({"below": F.coalesce(F.sum("k").over(order), F.lit(0)), "all": F.sum("k").over(Window.partitionBy(F.lit(0)))})
    rank = F.rank().over(Window.partitionBy("part").orderBy("t2")) - 1
    rows = rows.withColumn("rank", rank).join(below, "part")
    percentile = F.try_divide((F.col("below") + F.col("rank")) * 100.0, F.col("all") - 1)
    return rows.select("article_id", "t2", "entities", F.coalesce(percentile, F.lit(0.0)).alias("percentile"))


def coverage(rollup: DataFrame) -> DataFrame:
    """Sources and mentions of each period."""
    return rollup.groupBy(PERIOD).agg(F.countDistinct("source_id").alias("sources"), F.sum("n").alias("mentions"))


def dense_windows(weekly_coverage: DataFrame, least_sources: int = 20) -> DataFrame:
    """Runs of consecutive weeks with enough sources (gaps and islands)."""
    rows = weekly_coverage.where(F.col("sources") >= least_sources)
    order = Window.partitionBy(F.lit(0)).orderBy(PERIOD)
    island = F.date_sub(F.col(PERIOD), (F.row_number().over(order) * 7).cast("int"))
    runs = rows.withColumn("island", island).groupBy("island")
    return runs.agg(F.min(PERIOD).alias("start_week"), F.max(PERIOD).alias("end_week"), F.count("*").alias("weeks"), F.sum("mentions").alias("mentions")).drop("island")


def entity_series(rollup: DataFrame, dimension: str = "moral") -> DataFrame:
    """(entity_id, period_start, value): the unweighted mean over sources."""
    return rollup.groupBy("entity_id", PERIOD).agg(F.avg(f"mean_{dimension}").alias("value"))


def period_drift(rollup: DataFrame, months: int = 3) -> DataFrame:
    """Change of each source's combined reading of an entity against the period before, where both exist."""
    now = rollup.select("source_id", "entity_id", PERIOD, ((F.col("mean_power") + F.col("mean_moral")) / 2).alias("sentiment"), "n")
    order = Window.partitionBy("source_id", "entity_id").orderBy(PERIOD)
    rows = now.withColumns({"before": F.lag("sentiment").over(order), "last": F.lag(PERIOD).over(order)})
    rows = rows.where(F.add_months("last", months) == F.col(PERIOD))
    return rows.select("source_id", "entity_id", PERIOD, "sentiment", (F.col("sentiment") - F.col("before")).alias("change"), "n")


def expanding_z(series: DataFrame, keys: tuple[str, ...] = ("entity_id",), value: str = "value", least: int = 2, sensitivity: float = 2.0) -> DataFrame:
    """Each point's distance from the mean of all before it, in their population deviations; flagged beyond ``sensitivity``."""
    past = Window.partitionBy(*keys).orderBy(PERIOD).rowsBetween(Window.unboundedPreceding, -1)
    rows = series.withColumns({"points": F.count(value).over(past), "mean_before": F.avg(value).over(past), "sd_before": F.stddev_pop(value).over(past)})
    z = F.try_divide(F.abs(F.col(value) - F.col("mean_before")), F.when(F.col("sd_before") > 1e-9, F.col("sd_before")))
    rows = rows.where(F.col("points") >= least).withColumn("z", z)
    return rows.select(*keys, PERIOD, value, "z", F.coalesce(F.col("z") > sensitivity, F.lit(False)).alias("flagged"))


def volatility(mentions: DataFrame, start: str, end: str, least_sources: int = 5, least_mentions: int = 20, limit: int = 1000) -> DataFrame:
    """0.6 of the variance of sources' means (two mentions at least) and 0.4 of the deviation of all readings; top by deviation."""
    rows = complete(between(mentions, start, end)).withColumn("s", (F.col("power") + F.col("moral")) / 2)
    per_source = rows.groupBy("entity_id", "source_id").agg(F.count("*").alias("k"), F.avg("s").alias("m"))
    per_entity = rows.groupBy("entity_id").agg(F.count("*").alias("mentions"), F.stddev_samp("s").alias("deviation"))
    # without the noise of the order of sums, so that halves of the sixth place round one way
    divergence = F.round(F.coalesce(F.var_samp(F.when(F.col("k") >= 2, F.col("m"))), F.lit(0.0)), 12)
    out = per_source.groupBy("entity_id").agg(F.count("*").alias("sources"), divergence.alias("divergence"))
    out = per_entity.join(out, "entity_id").select("entity_id", "mentions", "sources", "deviation", "divergence")
    out = out.where((F.col("sources") >= least_sources) & (F.col("mentions") >= least_mentions))
    out = out.orderBy(F.desc(r6("deviation")), "entity_id").limit(limit)
    return out.withColumn("volatility", 0.6 * F.col("divergence") + 0.4 * F.col("deviation"))
