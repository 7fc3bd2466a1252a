"""Statistics of narratives: archetypes, contested entities, salience, changepoints, lead and lag, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import archetype, divergence_term, guarded_r, score_bin
from .rollups import PERIOD, between, with_totals


def trajectory(rollup: DataFrame, least: int = 3, band: float = 0.25) -> DataFrame:
    """Each entity's periods in order with archetypes, where there are enough; means over sources are unweighted."""
    rows = rollup.groupBy("entity_id", PERIOD).agg(F.avg("mean_power").alias("power"), F.avg("mean_moral").alias("moral"))
    rows = rows.where("power IS NOT NULL AND moral IS NOT NULL")
    rows = rows.withColumns({"window_index": F.row_number().over(Window.partitionBy("entity_id").orderBy(PERIOD)) - 1, "points": F.count("*").over(Window.partitionBy("entity_id"))})
    return rows.where(F.col("points") >= least).withColumn("archetype", archetype(F.round("power", 6), F.round("moral", 6), band)).drop("points")


def histogram(mentions: DataFrame, dimension: str = "moral", bins: int = 8, keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """Counts and shares of each score bin that occurs."""
    rows = mentions.where(F.col(dimension).isNotNull()).groupBy(*keys, score_bin(F.round(dimension, 9), bins).alias("bin")).agg(F.count("*").alias("n"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def contested(mentions: DataFrame, dimension: str = "moral", least: int = 10, bins: int = 8, first: int = 500, start: str | None = None, end: str | None = None) -> DataFrame:
    """Largest Jensen-Shannon divergence between two countries' score distributions, for the most mentioned entities."""
    rows = between(mentions, start, end).where(F.col(dimension).isNotNull())
    busiest = rows.groupBy("entity_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_id").limit(first).select("entity_id")
    rows = rows.join(busiest, "entity_id", "left_semi")
    counts = rows.groupBy("entity_id", "country").agg(F.count("*").alias("n"), *[F.count_if(score_bin(F.round(dimension, 9), bins) == b).alias(f"b{b}") for b in range(1, bins + 1)])
    counts = counts.where(F.col("n") >= least)
    a, b = counts.alias("a"), counts.alias("b")
    share = lambda side, k: F.col(f"{side}.b{k}") / F.col(f"{side}.n")
    total = sum((divergence_term(share("a", k), share("b", k)) for k in range(1, bins + 1)), F.lit(0.0))
    pairs = a.join(b, (F.col("a.entity_id") == F.col("b.entity_id")) & (F.col("a.country") < F.col("b.country")))
    pairs = pairs.select(F.col("a.entity_id").alias("entity_id"), total.alias("divergence"))
    return pairs.groupBy("entity_id").agg(F.max("divergence").alias("divergence"), F.count("*").alias("pairs"))


def salience(mentions: DataFrame, country_a: str, country_b: str, least: int = 10) -> DataFrame:
    """log2 ratio of an entity's shares (plus one) of two countries' mentions."""
    rows = mentions.where(F.col("country").isin(country_a, country_b))
    counts = rows.groupBy("entity_id").agg(F.count_if(F.col("country") == country_a).alias("a"), F.count_if(F.col("country") == country_b).alias("b"))
    counts = with_totals(counts, all_a=F.sum("a"), all_b=F.sum("b"))
    ratio = ((F.col("a") + 1) / (F.col("all_a") + 1)) / ((F.col("b") + 1) / (F.col("all_b") + 1))
    return counts.where(F.col("a") + F.col("b") >= least).select("entity_id", "a", "b", F.log2(ratio).alias("asymmetry"))


def pettitt(series: DataFrame, keys: tuple[str, ...] = ("entity_id",), value: str = "value", order: str = PERIOD, least: int = 8) -> DataFrame:
    """Pettitt's changepoint of each series without nulls: index, statistic, p and the means on either side.

    U after t points is the sum of sign(x_i - x_j) over i up to t and j after it. With ranks (ties averaged),
    U_t = 2 * (sum of the first t ranks) - t * (n + 1), so one sort of each series replaces all pairs.
    """
    rows = series.where(F.col(value).isNotNull()).withColumn(value, F.round(value, 9))
    per = Window.partitionBy(*keys)
    rows = rows.withColumns({"n": F.count("*").over(per), "i": F.row_number().over(per.orderBy(order)), "low": F.rank().over(per.orderBy(value)), "same": F.count("*").over(Window.partitionBy(*keys, value))})
    rows = rows.where(F.col("n") >= least).withColumn("rank", F.col("low") + (F.col("same") - 1) / 2)
    so_far = per.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    u = -(2 * F.sum("rank").over(so_far) - F.col("i") * (F.col("n") + 1))
    rows = rows.withColumns({"u": F.abs(u), "head": F.sum(value).over(so_far), "all": F.sum(value).over(per)})
    best = rows.where(F.col("i") < F.col("n")).groupBy(*keys, "n", "all").agg(F.max(F.struct("u", (-F.col("i")).alias("i"), F.col(order).alias("at"), "head")).alias("b"))
    i, k, n = -F.col("b.i"), F.col("b.u"), F.col("n").cast("double")
    return best.select(
        *keys, "n", i.alias("changepoint"), F.col("b.at").alias("last_before"), k.alias("statistic"), F.least(F.lit(1.0), 2 * F.exp(-6 * k * k / (n * n * n + n * n))).alias("p_value"),
        (F.col("b.head") / i).alias("mean_before"), ((F.col("all") - F.col("b.head")) / (F.col("n") - i)).alias("mean_after"),
    )


def drift_events(rollup: DataFrame, dimension: str = "moral", least_mentions: int = 10, significance: float = 0.05, least: int = 8) -> DataFrame:
    """Changepoints of each entity's global series, and of each source's residual from it; source_id null is global."""
    busy = rollup.groupBy("entity_id").agg(F.sum("n").alias("k")).where(F.col("k") >= least_mentions).select("entity_id")
    rows = rollup.join(busy, "entity_id", "left_semi").select("entity_id", "source_id", PERIOD, F.col(f"mean_{dimension}").alias("value"))
    overall = rows.groupBy("entity_id", PERIOD).agg(F.avg("value").alias("overall"))
    residual = rows.join(overall, ["entity_id", PERIOD]).select("entity_id", "source_id", PERIOD, (F.col("value") - F.col("overall")).alias("value"))
    both = overall.select("entity_id", F.lit(None).cast("int").alias("source_id"), PERIOD, F.col("overall").alias("value")).unionByName(residual)
    return pettitt(both, ("entity_id", "source_id"), least=least).where(F.col("p_value") < significance)


def changes(series: DataFrame, key: str, value: str = "value", months: int = 3) -> DataFrame:
    """(key, period_start, change) against the period before; gaps give no change."""
    order = Window.partitionBy(key).orderBy(PERIOD)
    rows = series.withColumns({"before": F.lag(value).over(order), "last": F.lag(PERIOD).over(order)})
    return rows.where(F.add_months("last", months) == F.col(PERIOD)).select(key, PERIOD, (F.col(value) - F.col("before")).alias("change")).where("change IS NOT NULL")


def lead_lag(series: DataFrame, key: str = "source_id", most: int = 4, months: int = 3, least: int = 5) -> DataFrame:
    """r of each series' changes with the mean of all at every lag; positive lags: the series is ahead."""
    own = changes(series, key, months=months)
    overall = changes(series.groupBy(PERIOD).agg(F.avg("value").alias("value")).withColumn("k", F.lit(0)), "k", months=months).select(PERIOD, F.col("change").alias("overall"))
    lags = own.withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn(PERIOD, F.add_months(PERIOD, F.col("lag") * months))
    rows = lags.join(overall, PERIOD).groupBy(key, "lag").agg(guarded_r("change", "overall", least).alias("r"), F.count("*").alias("n"))
    return rows.where("r IS NOT NULL")


def best_lag(table: DataFrame, key: str = "source_id") -> DataFrame:
    """The lag of the largest absolute r, the smallest lag on ties."""
    best = table.groupBy(key).agg(F.max(F.struct(F.abs(F.round("r", 6)).alias("size"), (-F.col("lag")).alias("lag"), "r", "n")).alias("b"))
    return best.select(key, (-F.col("b.lag")).alias("lag"), F.col("b.r").alias("r"), F.col("b.n").alias("n"))


def synchrony(series: DataFrame, groups: DataFrame, key: str = "source_id", group: str = "country", months: int = 3, least: int = 5) -> DataFrame:
    """Absolute mean correlation of the changes of a group's members, over pairs with enough common periods."""
    rows = changes(series, key, months=months).join(groups.select(key, group), key)
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{PERIOD}") == F.col(f"b.{PERIOD}")) & (F.col(f"a.{key}") < F.col(f"b.{key}")))
    pairs = pairs.groupBy(F.col(f"a.{group}").alias(group), F.col(f"a.{key}").alias("x"), F.col(f"b.{key}").alias("y")).agg(guarded_r("a.change", "b.change", least).alias("r"))
    return pairs.where("r IS NOT NULL").groupBy(group).agg(F.abs(F.avg("r")).alias("synchrony"), F.count("*").alias("pairs"))


def sliding_mean(mentions: DataFrame, entity_id: int, days: int = 7, dimension: str = "power") -> DataFrame:
    """Mean over the inclusive range of ``days`` before each day that has readings."""
    daily = mentions.where((F.col("entity_id") == entity_id) & F.col(dimension).isNotNull()).groupBy("publish_date").agg(F.sum(dimension).alias("s"), F.count("*").alias("k"))
    number = F.unix_date("publish_date")
    span = Window.partitionBy(F.lit(0)).orderBy(number).rangeBetween(-days, 0)
    return daily.select("publish_date", (F.sum("s").over(span) / F.sum("k").over(span)).alias("value"), F.sum("k").over(span).alias("mentions"))


def tracking(mentions: DataFrame, entity_id: int, days: int = 7, dimension: str = "power", most: int = 30) -> DataFrame:
    """The sliding mean as a chart shows it: ``days`` readings or fewer come as they are; of over ``most`` points every (n // most + 1)-th, from the first."""
    rows = mentions.where((F.col("entity_id") == entity_id) & F.col(dimension).isNotNull())
    few = F.broadcast(rows.agg((F.count("*") <= days).alias("few")))  # one row
    raw = rows.select("publish_date", F.col(dimension).alias("value"), F.lit(1).cast("long").alias("mentions"))
    points = sliding_mean(mentions, entity_id, days, dimension).crossJoin(few).where("NOT few")
    # a window over days, not mentions
    points = points.withColumns({"i": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("publish_date")) - 1, "n": F.count("*").over(Window.partitionBy(F.lit(0)))})
    step = F.when(F.col("n") > most, F.floor(F.col("n") / most) + 1).otherwise(1)
    return raw.crossJoin(few).where("few").drop("few").unionByName(points.where(F.col("i") % step == 0).drop("few", "i", "n"))


def global_band(mentions: DataFrame, entity_id: int, without_source: int, dimension: str = "power") -> DataFrame:
    """Daily mean of all other sources with a 95 % interval."""
    rows = mentions.where((F.col("entity_id") == entity_id) & (F.col("source_id") != without_source) & F.col(dimension).isNotNull())
    rows = rows.groupBy("publish_date").agg(F.avg(dimension).alias("mean"), F.stddev_samp(dimension).alias("sd"), F.count("*").alias("n")).where("n > 1")
    half = 1.96 * F.col("sd") / F.sqrt(F.col("n").cast("double"))
    return rows.select("publish_date", "mean", "n", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def decayed(mentions: DataFrame, entity_id: int, as_of: str, scale_days: float = 14.0, dimension: str = "power") -> DataFrame:
    """Scores with copies by age: max(1, round(10 * exp(-age / scale))), half to even; the scale is an e-folding time."""
    rows = mentions.where((F.col("entity_id") == entity_id) & F.col(dimension).isNotNull())
    age = F.datediff(F.lit(as_of).cast("date"), "publish_date")
    rows = rows.where(age >= 0).withColumn("copies", F.greatest(F.lit(1), F.bround(10 * F.exp(-age.cast("double") / scale_days), 0)).cast("long"))
    return rows.groupBy(F.round(dimension, 6).alias("score")).agg(F.sum("copies").alias("copies"), F.count("*").alias("mentions"))


def decayed_by(mentions: DataFrame, entity_id: int, as_of: str, key: str, scale_days: float = 14.0, dimension: str = "power", least: int = 3, top: int | None = None) -> DataFrame:
    """By source or country: mentions, the latest score (of one day the greatest mention_id), and the mean and deviation of the ``decayed`` copies.

    A group with fewer than ``least`` mentions is ``limited`` and has no mean. With ``top`` only that many groups of enough
    mentions come, those with the most, by key on a tie.
    """
    rows = mentions.where((F.col("entity_id") == entity_id) & F.col(dimension).isNotNull() & F.col(key).isNotNull())
    age = F.datediff(F.lit(as_of).cast("date"), "publish_date")
    rows = rows.where(age >= 0).withColumn("copies", F.greatest(F.lit(1), F.bround(10 * F.exp(-age.cast("double") / scale_days), 0)).cast("long"))
    value, copies = F.col(dimension), F.col("copies")
    out = rows.groupBy(key).agg(
        F.count("*").alias("mentions"), F.max_by(value, F.struct("publish_date", "mention_id")).alias("latest"),
        F.sum(copies).alias("copies"), F.sum(value * copies).alias("s"), F.sum(value * value * copies).alias("ss"),
    )
    enough = F.col("mentions") >= least
    mean = F.when(enough, F.col("s") / F.col("copies"))
    out = out.select(key, "mentions", "latest", "copies", mean.alias("mean"), F.when(enough, F.sqrt(F.greatest(F.lit(0.0), F.round(F.col("ss") / F.col("copies") - mean * mean, 12)))).alias("deviation"), (~enough).alias("limited"))
    return out if top is None else out.where("NOT limited").orderBy(F.desc("mentions"), key).limit(top)


def density(mentions: DataFrame, entity_id: int, dimension: str = "moral", points: int = 121, layer: str | None = None, least: int = 5, bins: int = 0) -> DataFrame:
    """Gaussian kernel density on a grid over [-2, 2] (Scott's bandwidth), of all or by ``layer``.

    Layers of fewer than ``least`` readings, or of one score, are left out; with ``bins`` they get a histogram of so
    many bins, drawn straight from middle to middle and zero beyond the outer middles.

    Kernels are summed over distinct scores with counts, so the grid meets few rows whatever the mentions.
    """
    keys = [layer] if layer else []
    rows = mentions.where((F.col("entity_id") == entity_id) & F.col(dimension).isNotNull())
    scores = rows.groupBy(*keys, F.col(dimension).alias("x")).agg(F.count("*").alias("k"))
    per = Window.partitionBy(*(keys or [F.lit(0)]))
    n = F.sum("k").over(per)
    scores = scores.withColumns({"n": n, "mean": F.sum(F.col("k") * F.col("x")).over(per) / n, "squares": F.sum(F.col("k") * F.col("x") * F.col("x")).over(per)})
    variance = F.try_divide(F.col("squares") - F.col("n") * F.col("mean") * F.col("mean"), F.col("n") - 1)
    scores = scores.withColumn("h", F.sqrt(F.greatest(F.lit(0.0), variance)) * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    smooth = F.coalesce((F.col("n") >= least) & (F.col("h") > 1e-9), F.lit(False))
    grid = scores.withColumns({"smooth": smooth, "i": F.explode(F.sequence(F.lit(0), F.lit(points - 1)))})
    z = (F.col("i") * (4.0 / (points - 1)) - 2 - F.col("x")) / F.col("h")
    out = grid.where("smooth").groupBy(*keys, "i", "n", "h").agg(F.sum(F.col("k") * F.exp(-0.5 * z * z)).alias("s"))
    out = out.select(*keys, "i", (F.col("s") / (F.col("n") * F.col("h") * F.sqrt(2 * F.pi()))).alias("density"))
    if not bins:
        return out
    # places in bins, counted from the middle of the first one
    place = F.round(F.col("i") * (bins / (points - 1)) - 0.5, 9)
    own = F.least(F.lit(bins - 1), F.floor(F.round((F.col("x") + 2) * (bins / 4), 9)))
    part = F.when(place.between(0, bins - 1), F.greatest(F.lit(0.0), 1 - F.abs(place - own))).otherwise(0.0)
    rest = grid.where("NOT smooth").groupBy(*keys, "i", "n").agg(F.sum(F.col("k") * part).alias("s"))
    return out.unionByName(rest.select(*keys, "i", (F.col("s") / F.col("n") * (bins / 4)).alias("density")))
