"""Sources as sparse vectors of mean scores by entity: groups by density and by k-means, and profiles of single sources.

A vector stays rows of (source_id, entity_id, value); what is missing is zero, and is never written out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import graphs


def vectors(mentions: DataFrame, start: str | None = None, end: str | None = None, least_sources: int = 3, least_entities: int = 10) -> DataFrame:
    """(source_id, entity_id, value): means of (power + moral) / 2, of entities that ``least_sources`` sources cover, for sources that then have ``least_entities``.

    Mentions without one of the scores count for coverage, as they are mentions, and a cell of such alone has no row.
    """
    rows = mentions
    if start is not None:
        rows = rows.where(F.col("publish_date") >= start)
    if end is not None:
        rows = rows.where(F.col("publish_date") < end)
    cells = rows.groupBy("source_id", "entity_id").agg(F.avg((F.col("power") + F.col("moral")) / 2).alias("value"))
    known = cells.groupBy("entity_id").agg(F.count("*").alias("k")).where(F.col("k") >= least_sources).select("entity_id")
    cells = cells.join(known, "entity_id", "left_semi")
    busy = cells.groupBy("source_id").agg(F.count("*").alias("k")).where(F.col("k") >= least_entities).select("source_id")
    return cells.join(busy, "source_id", "left_semi").where("value IS NOT NULL")


def cosines(cells: DataFrame) -> DataFrame:
    """(a, b, cosine) of sources a < b that share an entity; all others are at 0."""
    norms = cells.groupBy("source_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm")).where("norm > 1e-9")
    rows = materialize(cells.join(norms, "source_id").select("source_id", "entity_id", (F.col("value") / F.col("norm")).alias("v")), "units")
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.entity_id") == F.col("b.entity_id")) & (F.col("a.source_id") < F.col("b.source_id")))
    return pairs.groupBy(F.col("a.source_id").alias("a"), F.col("b.source_id").alias("b")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("cosine"))


def density_groups(cells: DataFrame, least: float = 0.6) -> DataFrame:
    """(source_id, group_id) by DBSCAN with two a core at a cosine of ``least``; -1 for a source that is like no other."""
    near = cosines(cells).where(F.round("cosine", 9) >= least).select("a", "b")
    found = graphs.density_clusters(near, cells.select(F.col("source_id").alias("item")), 2)
    return found.select(F.col("item").alias("source_id"), F.col("cluster").alias("group_id"))


def kmeans(cells: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """(source_id, cluster_id) by k-means over the sparse vectors; their places are numbers of a written index of entities, so no list of entities is collected."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.linalg import Vectors, VectorUDT

    index = graphs.numbered(cells.select("entity_id").distinct(), [F.col("entity_id")], "index")
    index = materialize(index.select("entity_id", "position"), "index")
    size = index.count()
    if not size:
        return cells.select("source_id", F.lit(0).alias("cluster_id")).limit(0)
    packed = cells.join(index, "entity_id").groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("position", "value"))).alias("v"))  # a source has each entity once
    sparse = F.udf(lambda v: Vectors.sparse(size, [x["position"] for x in v], [x["value"] for x in v]), VectorUDT())
    rows = materialize(packed.select("source_id", sparse("v").alias("features")), "features")
    # a stable order of the rows, so that reruns begin with the same centres
    return KMeans(k=k, seed=seed).fit(rows.orderBy("source_id")).transform(rows).select("source_id", F.col("prediction").alias("cluster_id"))


def bias_profiles(cells: DataFrame, most: int = 10) -> DataFrame:
    """(source_id, rank, entity_id, value, overall, difference): the ``most`` entities in which a source is farthest from the mean of all sources.

    Missing cells are zero on both sides, so what a source never mentions can tell it apart. Of those only the first
    entities by overall size are looked at, as many as the source has and ``most`` more: that many hold ``most`` missing ones.
    Ties go to the smaller entity.
    """
    cells = materialize(cells.select("source_id", "entity_id", "value"), "cells")
    counts = materialize(cells.groupBy("source_id").agg(F.count("*").alias("k")), "counts")
    sources = F.lit(counts.count())
    overall = cells.groupBy("entity_id").agg((F.sum("value") / sources).alias("overall"))
    ranked = graphs.numbered(overall, [F.desc(F.round(F.abs("overall"), 9)), F.col("entity_id")], "overall")
    ranked = materialize(ranked.select("entity_id", "overall", "position"), "ranked")
    own = cells.join(ranked, "entity_id").select("source_id", "entity_id", "value", "overall")
    wide = counts.select("source_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") + most - 1)).alias("position"))
    missing = wide.join(ranked, "position").join(cells.select("source_id", "entity_id"), ["source_id", "entity_id"], "left_anti").select("source_id", "entity_id", F.lit(0.0).alias("value"), "overall")
    rows = own.unionByName(missing).withColumn("difference", F.col("value") - F.col("overall"))
    order = Window.partitionBy("source_id").orderBy(F.desc(F.round(F.abs("difference"), 9)), "entity_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("source_id", "rank", "entity_id", "value", "overall", "difference")
