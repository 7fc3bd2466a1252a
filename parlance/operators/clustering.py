"""Clusters, maps and orders of sources and entities.

Clusters and maps work on rows of pairs (``graphs``, ``scaling``). Where an order needs a matrix, a group (the sources of
a country) runs as one ``applyInPandas`` task of at most ``MAX_SIDE`` items, so groups run side by side and nothing is computed on
the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import guarded_r, significance
from ..session import materialize
from . import graphs, kernels, scaling
from .similarity import both_ways, pearson_pairs

#: The distance of sources whose correlation is not known.
UNKNOWN = 2.0


def _square(rows: pd.DataFrame) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Items, r and common counts of (a, b, r, common) rows; a row with b null only names an item."""
    items = sorted({int(x) for x in rows["a"]} | {int(x) for x in rows["b"].dropna()})
    if len(items) > kernels.MAX_SIDE:
        raise ValueError(f"{len(items)} items in one matrix; at most {kernels.MAX_SIDE}")
    at = {x: i for i, x in enumerate(items)}
    r, common = np.full((len(items),) * 2, np.nan), np.zeros((len(items),) * 2)
    for a, b, value, n in rows[rows["b"].notna()][["a", "b", "r", "common"]].itertuples(index=False):
        i, j = at[int(a)], at[int(b)]
        r[i, j] = r[j, i] = np.nan if value is None else value
        common[i, j] = common[j, i] = n
    np.fill_diagonal(r, 1.0)
    return items, r, common


def _grouped_pairs(cells: DataFrame, groups: DataFrame | None, least: int) -> DataFrame:
    """Pairs within each group (grp), with a row of its own for every item."""
    pairs = pearson_pairs(cells, least=least)
    items = cells.select(F.col("source_id").alias("a")).distinct()
    if groups is None:
        pairs, items = pairs.withColumn("grp", F.lit("all")), items.withColumn("grp", F.lit("all"))
    else:
        a, b = groups.select(F.col("source_id").alias("a"), "grp"), groups.select(F.col("source_id").alias("b"), F.col("grp").alias("grp_b"))
        pairs = pairs.join(a, "a").join(b, "b").where("grp = grp_b").drop("grp_b")
        items = items.join(a, "a")
    alone = items.select("grp", "a", F.lit(None).cast("bigint").alias("b"), F.lit(None).cast("double").alias("r"), F.lit(0).cast("bigint").alias("common"))
    return pairs.select("grp", F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), "r", "common").unionByName(alone.withColumn("a", F.col("a").cast("bigint")))


def described(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """(grp, source_id, cluster_id, members, is_centroid, similarity) of (grp, item, cluster) and the groups' pairs (grp, a, b, r).

    Clusters are numbered by size, the largest first, then by their smallest member. Similarity is a member's mean known r
    to the rest of its cluster, 1 where there is none; the centroid is the member with the greatest, the first on a tie.
    """
    ways = both_ways(pairs.where("r IS NOT NULL").select("grp", "a", "b", "r")).select("grp", F.col("a").alias("item"), F.col("b").alias("other"), "r")
    inside = ways.join(clusters, ["grp", "item"]).join(clusters.select("grp", F.col("item").alias("other"), F.col("cluster").alias("own")), ["grp", "other"]).where("cluster = own")
    mean = clusters.join(inside.groupBy("grp", "item").agg(F.avg("r").alias("r")), ["grp", "item"], "left")
    mean = mean.withColumn("similarity", F.round(F.coalesce("r", F.lit(1.0)), 4))
    about = mean.groupBy("grp", "cluster").agg(F.count("*").alias("members"), F.max_by("item", F.struct("similarity", -F.col("item"))).alias("centroid"))
    number = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("members"), "cluster")) - 1  # one row a cluster
    rows = mean.join(about.withColumn("cluster_id", number), ["grp", "cluster"])
    return rows.select("grp", F.col("item").alias("source_id"), "cluster_id", F.col("members").cast("int").alias("members"), (F.col("item") == F.col("centroid")).alias("is_centroid"), "similarity")


def source_clusters(cells: DataFrame, groups: DataFrame | None = None, least: int = 10, threshold: float = 0.5) -> DataFrame:
    """Average linkage over significance-weighted r within each group (all sources, or ``groups``: source_id, grp), cut at ``threshold``."""
    rows = materialize(_grouped_pairs(cells, groups, least), "pairs")
    pairs, items = rows.where("b IS NOT NULL"), rows.where("b IS NULL").select("grp", F.col("a").alias("item"))
    near = pairs.select("grp", "a", "b", (1 - F.col("r") * significance("common")).alias("d"))
    clusters, _ = graphs.average_linkage(near, items, 1 - threshold, UNKNOWN)
    return described(clusters, pairs)


def weekly_similarity(cells: DataFrame, last_week: str, weeks: int = 4, value: str = "mean_moral", least: int = 10, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(pairs, clusters) of the week that begins at ``last_week``, over a window of ``weeks`` that ends with it, as they are stored.

    ``cells`` are weekly: source_id, entity_id, period_start, n and ``value``. Pairs have window_start, window_end (the
    week's last second) and the known r to full precision; clusters have assigned_date, a name of the week and number, and
    their size. Both carry what they are replaced by: a pair by window_end, a cluster by assigned_date.
    """
    last = F.lit(last_week).cast("date")
    first = F.date_sub(last, 7 * (weeks - 1))
    within = cells.where(F.col("period_start").between(first, last) & F.col(value).isNotNull())
    merged = within.groupBy("source_id", "entity_id").agg((F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("value"), F.sum("n").alias("n"))
    rows = materialize(_grouped_pairs(materialize(merged, "cells"), None, least), "pairs")
    pairs, items = rows.where("b IS NOT NULL"), rows.where("b IS NULL").select("grp", F.col("a").alias("item"))
    clusters, _ = graphs.average_linkage(pairs.select("grp", "a", "b", (1 - F.col("r") * significance("common")).alias("d")), items, 1 - threshold, UNKNOWN)
    begin, end = first.cast("timestamp"), F.date_add(last, 7).cast("timestamp") - F.make_dt_interval(secs=F.lit(1))
    stored = pairs.where("r IS NOT NULL").select("a", "b", "r", "common", F.lit("pearson_common").alias("method"), begin.alias("window_start"), end.alias("window_end"))
    named = described(clusters, pairs).select(
        "source_id", F.concat(F.lit(f"{last_week}-C"), F.col("cluster_id").cast("string")).alias("cluster_id"), F.lit(1).alias("cluster_level"),
        F.col("similarity").alias("similarity_to_centroid"), last.alias("assigned_date"), "is_centroid", "members",
    )
    return stored, named


def monthly_clusters(pairs: DataFrame, sources: DataFrame, first: int = 5, least: int = 4, height: float = 0.3, smallest: int = 2) -> tuple[DataFrame, DataFrame]:
    """(clusters, quality) of the sources of each country: ``sources`` (source_id, country, articles), ``pairs`` (a, b, r) of stored similarities.

    A country needs ``least`` sources. Where it has more than two over ``first``, its ``first`` with the most articles are
    clusters of their own (tier 1), and the others, if they are ``least`` at least, are clustered (tier 2). At least half
    of the pairs that are clustered must be known, or the country has no clusters; an unknown one is like r = 0. Tier 2 is
    average linkage of 1 - r cut at ``height``; a cluster below ``smallest`` joins the country's largest (the first of
    equal ones). Clusters have country, source_id, cluster_id, cluster_level, similarity and is_centroid as in
    ``described``; quality has country, clusters, silhouette and within, as they are stored.
    """
    by = Window.partitionBy("country")
    ranked = sources.where("country IS NOT NULL").select("country", "source_id", F.row_number().over(by.orderBy(F.desc("articles"), "source_id")).alias("rank"), F.count("*").over(by).alias("n"))
    tier1 = (F.col("n") > first + 2) & (F.col("rank") <= first)
    ranked = ranked.withColumn("tier", F.when(tier1, 1).otherwise(2)).where(F.col("n") >= least)
    left = F.count_if(F.col("tier") == 2).over(by)
    ranked = materialize(ranked.withColumn("left", left).where(F.col("left") >= least), "ranked")
    second = ranked.where("tier = 2").select(F.col("country").alias("grp"), F.col("source_id").alias("item"), "left")
    a, b = (second.select("grp", F.col("item").alias(x), F.col("left").alias(f"left_{x}")) for x in ("a", "b"))
    known = pairs.where("r IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "r").join(a, "a").join(b, ["grp", "b"])
    known = materialize(known.select("grp", "a", "b", "r", "left_a"), "known")  # ``pairs`` may stand for all mentions: they are computed once
    enough = known.groupBy("grp", "left_a").agg(F.count("*").alias("k")).where("k >= left_a * (left_a - 1) / 2 * 0.5").select("grp")
    known = known.join(enough, "grp", "left_semi").select("grp", "a", "b", "r")
    items = second.join(enough, "grp", "left_semi").select("grp", "item")
    near = known.select("grp", "a", "b", (1 - F.col("r")).alias("d"))
    found, _ = graphs.average_linkage(near, items, height, 1.0)
    sizes = found.groupBy("grp", "cluster").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("grp").agg(F.max_by("cluster", F.struct("size", -F.col("cluster"))).alias("largest"))
    moved = found.join(sizes, ["grp", "cluster"]).join(largest, "grp")
    clusters = materialize(moved.select("grp", "item", F.when(F.col("size") < smallest, F.col("largest")).otherwise(F.col("cluster")).alias("cluster")), "clusters")
    name = lambda *parts: F.concat_ws("_", F.col("country"), *parts)
    rows = described(clusters, known).withColumnRenamed("grp", "country")
    rows = rows.select("country", "source_id", name(F.lit("cluster"), F.col("cluster_id").cast("string")).alias("cluster_id"), F.lit(2).alias("cluster_level"), "similarity", "is_centroid")
    alone = ranked.where("tier = 1").join(enough.withColumnRenamed("grp", "country"), "country", "left_semi")
    alone = alone.select("country", "source_id", name(F.lit("tier1"), F.col("source_id").cast("string")).alias("cluster_id"), F.lit(1).alias("cluster_level"), F.lit(1.0).alias("similarity"), F.lit(True).alias("is_centroid"))
    return alone.unionByName(rows), graphs.cluster_quality(near, clusters, 1.0).withColumnRenamed("grp", "country")


def mappable(cells: DataFrame, countries: DataFrame, breadth: int = 3, least: int = 10, least_pairs: int = 3) -> tuple[DataFrame, DataFrame]:
    """(cells, pairs) that a map can place: entities that sources of ``breadth`` countries cover, and sources that then have ``least`` of them and ``least_pairs`` known pairs.

    ``countries`` has source_id and country; a source without one counts for no breadth. A source that is dropped takes its
    pairs along, so the last step is repeated until all that are left have enough; fewer than three sources are none.
    """
    wide = cells.join(countries.where("country IS NOT NULL"), "source_id").groupBy("entity_id").agg(F.count_distinct("country").alias("k")).where(F.col("k") >= breadth).select("entity_id")
    shared = cells.join(wide, "entity_id", "left_semi")
    covered = shared.groupBy("source_id").agg(F.count("*").alias("k")).where(F.col("k") >= least).select("source_id")
    shared = materialize(shared.join(covered, "source_id", "left_semi"), "shared")
    pairs = materialize(pearson_pairs(shared, least=least), "pairs")
    sources = materialize(covered, "sources")
    while True:
        n = sources.count()
        known = both_ways(pairs.where("r IS NOT NULL").select("a", "b")).groupBy("a").agg(F.count("*").alias("k"))
        kept = materialize(known.where(F.col("k") >= least_pairs).select(F.col("a").alias("source_id")), "sources")
        left = kept.count()
        if left < 3:
            return shared.limit(0), pairs.limit(0)
        if left == n:
            return shared.join(kept, "source_id", "left_semi"), pairs
        ends = pairs.join(kept.withColumnRenamed("source_id", "a"), "a", "left_semi")
        pairs = materialize(ends.join(kept.withColumnRenamed("source_id", "b"), "b", "left_semi").select("a", "b", "r", "common"), "pairs")
        sources = kept


def source_map(cells: DataFrame, countries: DataFrame, breadth: int = 3, least: int = 10, least_pairs: int = 3) -> DataFrame:
    """(source_id, x, y, stress): positions of the ``mappable`` sources by weighted multidimensional scaling of 1 - r, over rows of pairs."""
    cells, pairs = mappable(cells, countries, breadth, least, least_pairs)
    items = cells.select(F.col("source_id").cast("long").alias("item")).distinct()
    near = pairs.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), (1 - F.col("r")).alias("d"), F.least(F.lit(1.0), F.col("common") / 50).alias("w"))
    return scaling.stress_map(near, items).toDF("source_id", "x", "y", "stress")


def seriation(cells: DataFrame, groups: DataFrame | None = None, least: int = 10) -> DataFrame:
    """Order of the sources of each group in which neighbours are most alike."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        items, r, common = _square(rows)
        distance = 1 - kernels.weighted_correlation(r, common)
        np.fill_diagonal(distance, 0.0)
        order = kernels.optimal_leaf_order(kernels.average_linkage(distance), distance)
        return pd.DataFrame({"grp": rows["grp"].iloc[0], "position": range(len(order)), "source_id": [items[k] for k in order]})

    return _grouped_pairs(cells, groups, least).groupBy("grp").applyInPandas(run, "grp string, position int, source_id long")


def axis_anatomy(cells: DataFrame, positions: DataFrame, support: int = 15, poles: int = 5, least_r: float = 0.3) -> DataFrame:
    """The entities that best tell the two ends of each map axis apart."""
    axes = positions.select("source_id", F.explode(F.array(F.struct(F.lit(0).alias("axis"), F.col("x").alias("at")), F.struct(F.lit(1).alias("axis"), F.col("y").alias("at")))).alias("p"))
    rows = cells.join(axes, "source_id").groupBy("p.axis", "entity_id").agg(guarded_r("value", "p.at", support).alias("r"), F.count("*").alias("n"))
    rows = rows.where(F.abs("r") >= least_r).withColumn("strength", F.abs(F.atanh(F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), "r")))) * F.sqrt(F.col("n") - 3.0))
    order = Window.partitionBy("axis", F.signum("r")).orderBy(F.desc(F.round("strength", 6)), "entity_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= poles)


def entity_groups(cosines: DataFrame, least: float = 0.6) -> DataFrame:
    """(entity_id, group_id): entities linked by cosine of at least ``least``: DBSCAN with two points a core, so linked components.

    A group's id is its smallest entity; -1 is an entity without a link.
    """
    near = graphs.components(cosines.where((F.col("cosine") >= least) & (F.col("a") != F.col("b"))).select("a", "b"))
    every = cosines.select(F.explode(F.array("a", "b")).alias("entity_id")).distinct()
    rows = every.join(near.withColumnRenamed("node", "entity_id"), "entity_id", "left")
    return rows.select("entity_id", F.coalesce("component", F.lit(-1)).cast("long").alias("group_id"))


#: Types of the entities that name a topic, the best first; any other comes last.
NAMING = ["person", "organization", "country"]


def topic_clusters(counts: DataFrame, mentions: DataFrame, entities: DataFrame, reach: float = 0.7, least: int = 3, mentioned: int = 3) -> tuple[DataFrame, DataFrame]:
    """(members, topics) of entities that share articles: ``counts`` (a, b, together) are the pairs that do, each once, a < b.

    The share of a pair is its articles over those of the entity with fewer; entities at 1 - share <= ``reach`` are
    neighbours, and topics are their density clusters with ``least`` neighbours a core. Only entities with ``mentioned``
    mentions take part. Members have topic (its smallest core) and entity_id; topics have topic, members, coherence (the
    mean share over all pairs of members, 0 for those that never met) and name: its first two persons by id, or else
    organizations, countries, or any.
    """
    # by article first, as the pairs are: rows that come dealt by article stay where they are
    each = mentions.groupBy("entity_id", "article_id").agg(F.count("*").alias("n"))
    sizes = each.groupBy("entity_id").agg(F.count("article_id").alias("k"), F.sum("n").alias("n")).where(F.col("n") >= mentioned)
    sizes = materialize(sizes.select("entity_id", "k"), "sizes")
    shares = counts.join(sizes.toDF("a", "k_a"), "a").join(sizes.toDF("b", "k_b"), "b")
    shares = materialize(shares.select("a", "b", (F.col("together") / F.least("k_a", "k_b")).alias("share")), "shares")
    near = shares.where(F.round(1 - F.col("share"), graphs.PLACES) <= reach).select("a", "b")
    found = graphs.density_clusters(near, sizes.select(F.col("entity_id").alias("item")), least).where("cluster >= 0")
    members = materialize(found.select(F.col("cluster").alias("topic"), F.col("item").alias("entity_id")), "topics")
    inside = shares.join(members.toDF("topic", "a"), "a").join(members.toDF("topic_b", "b"), "b").where("topic = topic_b").groupBy("topic").agg(F.sum("share").alias("share"))
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, NAMING)), F.col("entity_type")), F.lit(0))
    rank = F.when(kind > 0, kind).otherwise(len(NAMING) + 1)
    named = members.join(entities.where("canonical_id IS NULL").select(F.col("id").alias("entity_id"), "name", rank.alias("rank")), "entity_id", "left")
    # the two smallest ids of each type, without gathering a topic
    first = named.groupBy("topic", "rank").agg(F.count("*").alias("n"), F.min(F.struct("entity_id", "name")).alias("one"))
    later = named.join(first.select("topic", "rank", F.col("one.entity_id").alias("first_id")), ["topic", "rank"]).where("entity_id > first_id").groupBy("topic", "rank").agg(F.min(F.struct("entity_id", "name")).alias("two"))
    best = first.join(later, ["topic", "rank"], "left").groupBy("topic").agg(F.sum("n").alias("members"), F.min_by(F.concat_ws(" & ", "one.name", "two.name"), F.coalesce("rank", F.lit(99))).alias("name"))
    every = F.col("members") * (F.col("members") - 1) / 2
    topics = best.join(inside, "topic", "left").select("topic", "members", F.when(every > 0, F.coalesce("share", F.lit(0.0)) / every).otherwise(0.0).alias("coherence"), "name")
    return members, topics


def lead_lag_tests(series: DataFrame, most: int = 4, permutations: int = 1000) -> DataFrame:
    """Best lag, r and permutation p of each source's weekly series against the mean of all."""
    overall = series.groupBy("period_start").agg(F.avg("value").alias("overall"))
    rows = series.join(overall, "period_start")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("period_start")
        found = kernels.lagged_correlation(rows["value"].to_numpy(float), rows["overall"].to_numpy(float), most, permutations)
        return pd.DataFrame([(int(rows["source_id"].iloc[0]), *found)] if found else [], columns=["source_id", "lag", "r", "p_value"])

    return rows.groupBy("source_id").applyInPandas(run, "source_id long, lag int, r double, p_value double")


def layered_significance(layers: DataFrame, value: float = 1.0) -> DataFrame:
    """Percentile and two-tailed p of a reading in each layer's normal model, and t intervals of its mean."""

    def run(batches):
        for rows in batches:
            sd = rows["deviation"].where((rows["n"] > 1) & (rows["deviation"] > 0), 1.0)
            rows["percentile"] = [100 * kernels.normal_cdf((value - m) / s) for m, s in zip(rows["mean"], sd, strict=True)]
            rows["p_value"] = [kernels.two_tailed(value, m, s) for m, s in zip(rows["mean"], sd, strict=True)]
            half = [kernels.t_quantile(0.975, int(n) - 1) * s / np.sqrt(n) for n, s in zip(rows["n"], sd, strict=True)]
            rows["low"], rows["high"] = np.clip(rows["mean"] - half, -2, 2), np.clip(rows["mean"] + half, -2, 2)
            yield rows

    schema = ", ".join(f"{c} {t}" for c, t in layers.dtypes) + ", percentile double, p_value double, low double, high double"
    return layers.mapInPandas(run, schema)


def combined_significance(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(entity_id, source_id, layers, p_combined): Fisher's combined p of a reading over an entity's source, its country and the world.

    ``rows`` are those of ``layered_significance``, ``sources`` has source_id and country. Every source with a layer of its
    own has a row; a country or world that has none counts for nothing. Of k layers the statistic has 2 k degrees of
    freedom, whose tail is exp(-x) times the sum of x ** i / i! below k, x being minus the sum of the logarithms.
    """
    own = rows.where("layer = 'source'").select("entity_id", "source_id", F.col("p_value").alias("p_source")).join(sources.select("source_id", "country"), "source_id", "left")
    nation = rows.where("layer = 'national'").select("entity_id", "country", F.col("p_value").alias("p_nation"))
    world = rows.where("layer = 'global'").select("entity_id", F.col("p_value").alias("p_world"))
    joined = own.join(nation, ["entity_id", "country"], "left").join(world, "entity_id", "left")
    known = F.array_compact(F.array("p_source", "p_nation", "p_world"))
    x = F.aggregate(known, F.lit(0.0), lambda t, p: t - F.log(F.greatest(p, F.lit(1e-300))))
    k = F.size(known)
    terms = F.lit(1.0) + F.when(k > 1, x).otherwise(0.0) + F.when(k > 2, x * x / 2).otherwise(0.0)
    return joined.select("entity_id", "source_id", k.alias("layers"), F.least(F.lit(1.0), F.exp(-x) * terms).alias("p_combined"))
