"""Clusters of entities in successive intervals, and what becomes of them.

Entities are linked within an interval where their vectors over sources are alike; what links reach is a cluster. A cluster
goes on in the next interval as the one it shares most members with, if that one says the same of it. Chains of such
successors are tracks. All intervals are worked on at once: the interval is part of every key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import graphs

#: A node is an interval's number and an id in one long.
SHIFT = 1 << 40


def _node(interval: Column | str, item: Column | str) -> Column:
    return F.col(interval) * SHIFT + F.col(item) if isinstance(interval, str) else interval * SHIFT + item


def interval_clusters(mentions: DataFrame, start: str, end: str, days: int = 30, least: float = 0.6, least_sources: int = 3) -> DataFrame:
    """(interval, entity_id, cluster): clusters of two entities or more, named by their smallest, in intervals of ``days`` from ``start`` on.

    An entity's vector has its mean of both scores (nulls left out) by source, of those with ``least_sources`` sources in the
    interval; missing sources are zero. Two are linked at a cosine of ``least``. Ids are from 0 to SHIFT.
    """
    day = F.datediff("publish_date", F.lit(start).cast("date"))
    rows = mentions.where((F.col("publish_date") >= start) & (F.col("publish_date") < end) & F.col("power").isNotNull() & F.col("moral").isNotNull())
    cells = rows.groupBy(F.floor(day / days).cast("long").alias("interval"), "entity_id", "source_id").agg(F.avg((F.col("power") + F.col("moral")) / 2).alias("value"))
    norms = cells.groupBy("interval", "entity_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"), F.count("*").alias("k"))
    norms = norms.where((F.col("k") >= least_sources) & (F.col("norm") > 1e-9))
    units = materialize(cells.join(norms, ["interval", "entity_id"]).select("interval", "entity_id", "source_id", (F.col("value") / F.col("norm")).alias("v")), "units")
    a, b = units.alias("a"), units.alias("b")
    together = (F.col("a.interval") == F.col("b.interval")) & (F.col("a.source_id") == F.col("b.source_id")) & (F.col("a.entity_id") < F.col("b.entity_id"))
    pairs = a.join(b, together).groupBy(F.col("a.interval").alias("interval"), F.col("a.entity_id").alias("a"), F.col("b.entity_id").alias("b")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("cosine"))
    near = pairs.where(F.round("cosine", 9) >= least)
    found = graphs.components(near.select(_node("interval", "a").alias("a"), _node("interval", "b").alias("b")))
    return found.select(F.floor(F.col("node") / SHIFT).alias("interval"), (F.col("node") % SHIFT).alias("entity_id"), (F.col("component") % SHIFT).alias("cluster"))


def tracks(clusters: DataFrame) -> DataFrame:
    """(interval, cluster, members, track, event, from_clusters, to_clusters, kept) of each cluster of (interval, entity_id, cluster).

    A track is named by its first cluster (``interval/cluster``). Of the clusters of the next interval that share a member,
    the successor is the one with the greatest overlap over union, the smallest name on a tie; it has to choose its
    predecessor alike. ``event`` is ``birth`` for a cluster without a predecessor, ``continued`` otherwise;
    from_clusters and to_clusters count the clusters of the interval before and after with a common member, so that over
    one of them is a merge or a split; ``kept`` are the members shared with the predecessor. An interval without clusters
    ends all tracks. An entity stands in one cluster of an interval.
    """
    clusters = materialize(clusters.select("interval", "entity_id", "cluster").distinct(), "clusters")
    sizes = clusters.groupBy("interval", "cluster").agg(F.count("*").alias("members"))
    later = clusters.select((F.col("interval") - 1).alias("interval"), "entity_id", F.col("cluster").alias("next"))
    shared = clusters.join(later, ["interval", "entity_id"]).groupBy("interval", "cluster", "next").agg(F.count("*").alias("common"))
    sizes_next = sizes.select((F.col("interval") - 1).alias("interval"), F.col("cluster").alias("next"), F.col("members").alias("members_next"))
    shared = shared.join(sizes, ["interval", "cluster"]).join(sizes_next, ["interval", "next"])
    shared = materialize(shared.select("interval", "cluster", "next", "common", F.round(F.col("common") / (F.col("members") + F.col("members_next") - F.col("common")), graphs.PLACES).alias("overlap")), "shared")
    ahead = shared.groupBy("interval", "cluster").agg(F.count("*").alias("to_clusters"), F.max_by("next", F.struct("overlap", -F.col("next"))).alias("best_next"))
    back = shared.groupBy("interval", "next").agg(F.count("*").alias("from_clusters"), F.max_by("cluster", F.struct("overlap", -F.col("cluster"))).alias("best_cluster"))
    mutual = shared.join(ahead, ["interval", "cluster"]).join(back, ["interval", "next"]).where("next = best_next AND cluster = best_cluster").select("interval", "cluster", "next", "common")
    mutual = materialize(mutual, "successors")
    links = mutual.select(_node("interval", "cluster").alias("a"), _node(F.col("interval") + 1, F.col("next")).alias("b"))
    chains = graphs.components(links).withColumnsRenamed({"node": "own", "component": "first"})
    rows = sizes.withColumn("own", _node("interval", "cluster")).join(chains, "own", "left").withColumn("first", F.coalesce("first", "own"))
    before = mutual.select((F.col("interval") + 1).alias("interval"), F.col("next").alias("cluster"), F.col("common").alias("kept"))
    rows = rows.join(before, ["interval", "cluster"], "left").join(ahead.drop("best_next"), ["interval", "cluster"], "left")
    rows = rows.join(back.select((F.col("interval") + 1).alias("interval"), F.col("next").alias("cluster"), "from_clusters"), ["interval", "cluster"], "left")
    name = F.concat_ws("/", F.floor(F.col("first") / SHIFT).cast("string"), (F.col("first") % SHIFT).cast("string"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    event = F.when(F.col("kept").isNull(), "birth").otherwise("continued")
    return rows.select("interval", "cluster", "members", name.alias("track"), event.alias("event"), zero("from_clusters"), zero("to_clusters"), zero("kept"))


def track_lives(tracked: DataFrame) -> DataFrame:
    """(track, born, died, intervals, most, splits, merges) of rows of ``tracks``: died is the first interval without it, null for those that live in the last interval there is."""
    ends = tracked.groupBy("track").agg(F.min("interval").alias("born"), F.max("interval").alias("latest"), F.count("*").alias("intervals"), F.max("members").alias("most"), F.count_if(F.col("to_clusters") > 1).alias("splits"), F.count_if(F.col("from_clusters") > 1).alias("merges"))
    newest = tracked.agg(F.max("interval").alias("newest"))
    rows = ends.crossJoin(F.broadcast(newest))  # one row
    return rows.select("track", "born", F.when(F.col("latest") < F.col("newest"), F.col("latest") + 1).alias("died"), "intervals", "most", "splits", "merges")
