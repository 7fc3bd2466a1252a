"""Clusters over pairs: connected components, density clusters and average linkage, all in joins and sums over pair rows.

Nothing gathers a group: each round relabels what it must and is written to the shared folder, and the round before is
deleted. Rounds are few because many things happen in each: labels double their reach, and all clusters that are each
other's nearest merge at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialize


def both_directions(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) for each node of ``pairs`` (a, b); the component is its smallest node.

    Each round takes the smallest label beside a node, then that label's own label, so paths shorten by more than a
    link a round. Pairs may repeat, stand in either order and link a node with itself; those with a null go.
    """
    links = materialize(both_directions(pairs).where("a IS NOT NULL AND b IS NOT NULL").distinct(), "links")
    labels = materialize(links.groupBy("a").agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        near = links.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        moved = labels.join(near, "a").select("a", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = moved.select(F.col("a").alias("label"), F.col("label").alias("up"))
        moved = materialize(moved.join(up, "label").select("a", "old", F.col("up").alias("label")), "labels")
        discard(labels)
        labels = moved
        if moved.where("label <> old").isEmpty():
            break
    discard(links)
    return labels.select(F.col("a").alias("node"), F.col("label").alias("component"))


def density_clusters(pairs: DataFrame, items: DataFrame, least: int) -> DataFrame:
    """(item, cluster, core) by DBSCAN: ``pairs`` (a, b) are neighbours, each pair once in either order, ``items`` (item) all there are.

    A core has ``least`` neighbours or more, itself included; cores that are neighbours share a cluster, named by its
    smallest core. Another item joins the first of the clusters that have a core beside it; without one it has -1.
    Neighbours that are not among the items do not count.
    """
    known = items.select(F.col("item").alias("a")).distinct()
    near = both_directions(pairs).where("a <> b").distinct().join(known, "a", "left_semi").join(known.select(F.col("a").alias("b")), "b", "left_semi")
    near = materialize(near.select("a", "b"), "near")
    cores = near.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") + 1 >= least).select("a")
    if least <= 1:
        cores = known
    cores = materialize(cores, "cores")
    beside = near.join(cores.select(F.col("a").alias("b")), "b", "left_semi")
    inner = beside.join(cores, "a", "left_semi").unionByName(cores.select("a", F.col("a").alias("b")))
    found = components(inner).select(F.col("node").alias("b"), F.col("component").alias("cluster"))
    border = beside.join(cores, "a", "left_anti").join(found, "b").groupBy("a").agg(F.min("cluster").alias("cluster"))
    labelled = found.select(F.col("b").alias("a"), "cluster", F.lit(True).alias("core")).unionByName(border.select("a", "cluster", F.lit(False).alias("core")))
    return known.join(labelled, "a", "left").select(F.col("a").alias("item"), F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"), F.coalesce("core", F.lit(False)).alias("core"))


#: Places to which distances are compared, so that the order of a sum does not decide a tie.
PLACES = 12


def average_linkage(distances: DataFrame, items: DataFrame, height: float, unknown: float) -> tuple[DataFrame, DataFrame]:
    """Clusters of average linkage cut at ``height``: (grp, item, cluster), and the merges (grp, a, b, height, round) that made them.

    ``distances`` (grp, a, b, d) has each known pair of a group once; pairs without a row, or with a null, are ``unknown``
    apart, which must be beyond ``height``. ``items`` (grp, item) are all there are. A cluster is named by its smallest item.

    The distance of two clusters is the mean over their pairs of items, kept as a sum and a count. In each round all
    clusters that are each other's nearest merge; average linkage is reducible (a merge brings no two clusters nearer
    than the nearer of its parts was), so the merges are those of one at a time. Ties go to the smaller names.
    """
    if unknown <= height:
        raise ValueError("unknown pairs must be further apart than the height of the cut")
    rows = distances.where("a <> b AND d IS NOT NULL").select("grp", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("d").cast("double").alias("total"))
    rows = rows.select("*", F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("size_a"), F.lit(1).cast("long").alias("size_b"))
    rows = materialize(rows, "pairs")
    members = materialize(items.select("grp", "item", F.col("item").alias("cluster")).distinct(), "members")
    history, turn = None, 0
    while True:
        every = F.col("size_a") * F.col("size_b")
        d = F.round((F.col("total") + unknown * (every - F.col("n"))) / every, PLACES)
        near = rows.select("grp", "a", "b", "size_a", "size_b", d.alias("d")).where(F.col("d") <= height + 10.0**-PLACES)
        ends = near.select("grp", F.explode(F.array("a", "b")).alias("end"), F.struct("d", "a", "b", "size_a", "size_b").alias("pair"))
        nearest = ends.groupBy("grp", "end").agg(F.min("pair").alias("pair"))
        merges = nearest.groupBy("grp", "pair").agg(F.count("*").alias("ends")).where("ends = 2")
        merges = materialize(merges.select("grp", "pair.a", "pair.b", F.col("pair.d").alias("height"), (F.col("pair.size_a") + F.col("pair.size_b")).alias("size"), F.lit(turn).alias("round")), "merges")
        if merges.isEmpty():
            break
        history = merges if history is None else history.unionByName(merges)
        # what each merged cluster becomes, and how large
        becomes = merges.select("grp", F.explode(F.array("a", "b")).alias("old"), F.col("a").alias("new"), "size")
        moved = rows
        for end in ("a", "b"):
            to = becomes.select("grp", F.col("old").alias(end), F.col("new").alias("new"), "size")
            moved = moved.join(to, ["grp", end], "left").withColumn(f"size_{end}", F.coalesce("size", f"size_{end}")).withColumn(end, F.coalesce("new", end)).drop("new", "size")
        ordered = [F.col("grp"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "total", "n", F.when(F.col("a") < F.col("b"), F.col("size_a")).otherwise(F.col("size_b")).alias("size_a"), F.when(F.col("a") < F.col("b"), F.col("size_b")).otherwise(F.col("size_a")).alias("size_b")]
        summed = moved.where("a <> b").select(*ordered).groupBy("grp", "a", "b").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("size_a").alias("size_a"), F.max("size_b").alias("size_b"))
        summed = materialize(summed, "pairs")
        named = members.join(becomes.select("grp", F.col("old").alias("cluster"), "new"), ["grp", "cluster"], "left").select("grp", "item", F.coalesce("new", "cluster").alias("cluster"))
        named = materialize(named, "members")
        discard(rows, members)
        rows, members, turn = summed, named, turn + 1
    discard(rows)
    return members, (history if history is not None else merges).select("grp", "a", "b", "height", "round")


def cluster_quality(distances: DataFrame, clusters: DataFrame, unknown: float) -> DataFrame:
    """(grp, clusters, silhouette, within): the mean silhouette over the items of each group, and the mean over its clusters of their mean similarity (1 - distance).

    ``distances`` (grp, a, b, d) and ``clusters`` (grp, item, cluster) as in ``average_linkage``. An item alone in its
    cluster counts 0, and so does a group with one cluster or with none but such; a cluster of one has similarity 1.
    """
    known = distances.where("a <> b AND d IS NOT NULL")
    ways = known.select("grp", F.col("a").alias("item"), F.col("b").alias("other"), "d").unionByName(known.select("grp", F.col("b").alias("item"), F.col("a").alias("other"), "d"))
    sizes = clusters.groupBy("grp", "cluster").agg(F.count("*").alias("size"))
    totals = sizes.groupBy("grp").agg(F.count("*").alias("clusters"), F.sum("size").alias("items"))
    to = ways.join(clusters.select("grp", F.col("item").alias("other"), F.col("cluster").alias("to")), ["grp", "other"])
    sums = to.groupBy("grp", "item", "to").agg(F.sum("d").alias("d"), F.count("*").alias("n"))
    own = clusters.join(sizes, ["grp", "cluster"]).join(totals, "grp")
    seen = own.join(sums, ["grp", "item"], "left").join(sizes.select("grp", F.col("cluster").alias("to"), F.col("size").alias("to_size")), ["grp", "to"], "left")
    inside = F.col("to") == F.col("cluster")
    away = F.when(~inside, (F.col("d") + unknown * (F.col("to_size") - F.col("n"))) / F.col("to_size"))
    near = seen.groupBy("grp", "item", "cluster", "size", "clusters", "items").agg(
        F.sum(F.when(inside, F.col("d"))).alias("d"), F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("n"),
        F.min(away).alias("b"), F.count(F.when(~inside, 1)).alias("met"),
    )
    a = (F.coalesce("d", F.lit(0.0)) + unknown * (F.col("size") - 1 - F.col("n"))) / (F.col("size") - 1)
    # a cluster to which no pair is known is ``unknown`` away
    b = F.when(F.col("met") < F.col("clusters") - 1, F.least(F.coalesce("b", F.lit(unknown)), F.lit(unknown))).otherwise(F.col("b"))
    scored = near.withColumn("a", F.when(F.col("size") > 1, a)).withColumn("b", b)
    value = F.when((F.col("size") > 1) & (F.col("clusters") > 1), F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).otherwise(0.0)
    by_cluster = scored.groupBy("grp", "cluster", "clusters").agg(F.sum(value).alias("value"), F.count("*").alias("n"), F.avg(F.coalesce(1 - F.col("a"), F.lit(1.0))).alias("within"))
    return by_cluster.groupBy("grp").agg(F.max("clusters").alias("clusters"), (F.sum("value") / F.sum("n")).alias("silhouette"), F.avg("within").alias("within"))


def numbered(rows: DataFrame, keys: list, name: str) -> DataFrame:
    """``rows`` with ``position``, from 0 in order of ``keys``: sorted ranges are numbered each, after the counts of those before."""
    place = F.monotonically_increasing_id()  # partition, and the row's place in it
    placed = materialize(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", place), name)
    placed = placed.withColumn("part", F.shiftright("place", 33))
    parts = placed.groupBy("part").agg(F.min("place").alias("begin"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    parts = parts.select("part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("begin")).alias("shift"))
    return placed.join(parts, "part").withColumn("position", F.col("place") + F.col("shift")).drop("place", "part", "shift")
