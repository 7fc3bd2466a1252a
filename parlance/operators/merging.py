"""The merge job: entities of one name become one, with canonical names renamed and every change in a log that can be undone.

Entities are not deleted: a merged one points to its group's winner. The log has a row for each changed cell and each
new row, so undoing it restores the table, whatever was merged into what.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_name
from ..session import materialize
from ..sources.writers import remap
from . import graphs

LOG = ["id", "change", "old", "new"]


@dataclass
class Merged:
    """entities as they are after; log (id, change, old, new) with change merge, repoint, rename or park; mapping (old, new) of the entities that were merged."""

    entities: DataFrame
    log: DataFrame
    mapping: DataFrame

    def apply_to(self, rows: DataFrame, column: str, key: str) -> tuple[DataFrame, DataFrame]:
        """(rows with ``column`` pointing to winners, their own log (key, old, new))."""
        log, out = remap(rows, self.mapping, column, key)
        return out, log


def merge_entities(entities: DataFrame, mentions: DataFrame, accepted: DataFrame | None = None) -> Merged:
    """Merge canonical ``entities`` (id, name, entity_type, canonical_id) whose normalised names are equal in lower case.

    ``accepted`` (a, b) are pairs of ids that a review found to be one thing; chains of them and of equal names are one
    group. The most mentioned of a group (``mentions`` has raw_id) wins, the smallest id on a tie; the others, and what
    pointed to them, point to it. A winner takes its normalised name: if one of its own group has exactly that name, the
    two change names; if anyone else has it (in any case), the winner keeps its name; else the old spelling is parked as
    a new row without mentions that points to the winner, unless a row has it already. Of winners that would take one
    name, the smallest does. Names that normalise to nothing, and nulls, merge with nobody by name. Ids are positive.
    """
    columns = ["id", "name", "entity_type", "canonical_id"]
    counts = mentions.groupBy(F.col("raw_id").alias("id")).agg(F.count("*").alias("mentions"))
    every = entities.select(*columns)
    rows = every.where("canonical_id IS NULL").join(counts, "id", "left").withColumn("mentions", F.coalesce("mentions", F.lit(0)))
    rows = materialize(rows.withColumn("display", F.nullif(normalize_name("name", "entity_type"), F.lit(""))).withColumn("key", F.lower("display")), "canonical")
    if accepted is None:
        groups = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("grp"))
        grouped = rows.join(groups, "key", "left").withColumn("grp", F.coalesce("grp", "id"))
    else:
        # each key's smallest id stands for it, so a frequent name is a star and not all its pairs
        first = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("a"))
        links = rows.join(first, "key").select("a", F.col("id").alias("b"))
        known = rows.select("id")
        sure = accepted.join(known.withColumnRenamed("id", "a"), "a", "left_semi").join(known.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")
        found = graphs.components(links.unionByName(sure)).withColumnsRenamed({"node": "id", "component": "grp"})
        grouped = rows.join(found, "id", "left").withColumn("grp", F.coalesce("grp", "id"))
    winners = grouped.groupBy("grp").agg(F.max_by("id", F.struct("mentions", -F.col("id"))).alias("winner"))
    grouped = materialize(grouped.join(winners, "grp").select("id", "name", "display", "winner"), "grouped")
    mapping = grouped.where("id <> winner").select(F.col("id").alias("old"), F.col("winner").alias("new"))
    text = lambda c: F.col(c).cast("string")
    merged = mapping.select(F.col("old").alias("id"), F.lit("merge").alias("change"), F.lit(None).cast("string").alias("old"), text("new").alias("new"))
    pointing = every.where("canonical_id IS NOT NULL").join(mapping, F.col("canonical_id") == F.col("old"))
    repointed = pointing.select("id", F.lit("repoint").alias("change"), text("canonical_id").alias("old"), text("new").alias("new"))
    # renames: one winner for each wanted name, then who has it now
    wanting = grouped.where("id = winner AND display IS NOT NULL AND name <> display").groupBy(F.lower("display").alias("want")).agg(F.min_by(F.struct("id", "name", "display"), "id").alias("w")).select("want", "w.*")
    holders = every.select(F.lower("name").alias("want"), F.col("id").alias("holder"), F.col("name").alias("held")).join(grouped.select(F.col("id").alias("holder"), "winner"), "holder", "left")
    met = wanting.join(holders.where("holder IS NOT NULL"), "want", "left").where("holder IS NULL OR holder <> id")
    same = (F.col("winner") == F.col("id")) & (F.col("held") == F.col("display"))
    own = wanting.join(
        met.groupBy("id").agg(F.min(F.when(same, F.col("holder"))).alias("swap"), F.count_if(~F.coalesce(F.col("winner") == F.col("id"), F.lit(False)) & F.col("holder").isNotNull()).alias("others")), "id", "left"
    )
    own = materialize(own.where(F.coalesce("others", F.lit(0)) == 0).select("id", "name", "display", "swap"), "renames")
    renamed = own.select("id", F.lit("rename").alias("change"), F.col("name").alias("old"), F.col("display").alias("new"))
    swapped = own.where("swap IS NOT NULL").select(F.col("swap").alias("id"), F.lit("rename").alias("change"), F.col("display").alias("old"), F.col("name").alias("new"))
    spelled = every.select(F.lower("name").alias("low"), "id")
    left_over = own.where("swap IS NULL").withColumn("low", F.lower("name"))
    kept = left_over.join(spelled.withColumnRenamed("id", "holder"), "low").where("holder <> id").select("low").distinct()
    parked = left_over.join(kept, "low", "left_anti").groupBy("low").agg(F.min_by(F.struct("id", "name"), "id").alias("p")).select("p.*")
    top = every.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    parked = graphs.numbered(parked, [F.col("id")], "parked").crossJoin(F.broadcast(top))  # one row
    parked = materialize(parked.select((F.col("top") + F.col("position") + 1).alias("new_id"), "id", "name"), "parked")
    park = parked.select(F.col("new_id").alias("id"), F.lit("park").alias("change"), F.lit(None).cast("string").alias("old"), "name")
    log = materialize(merged.unionByName(repointed).unionByName(renamed).unionByName(swapped).union(park), "log")
    points = log.where(F.col("change").isin("merge", "repoint")).select("id", F.col("new").cast("long").alias("to"))
    names = log.where("change = 'rename'").select("id", F.col("new").alias("called"))
    after = every.join(points, "id", "left").join(names, "id", "left")
    after = after.select("id", F.coalesce("called", "name").alias("name"), "entity_type", F.coalesce("to", "canonical_id").alias("canonical_id"))
    kinds = every.select("id", "entity_type")
    return Merged(after.unionByName(parked.join(kinds, "id").select(F.col("new_id").alias("id"), "name", "entity_type", F.col("id").alias("canonical_id"))), log, mapping)


def undo(entities: DataFrame, log: DataFrame) -> DataFrame:
    """``entities`` (id, name, entity_type, canonical_id) as they were before the changes of ``log``."""
    points = log.where(F.col("change").isin("merge", "repoint")).select("id", F.lit(True).alias("moved"), F.col("old").cast("long").alias("from"))
    names = log.where("change = 'rename'").select("id", F.col("old").alias("called"))
    rows = entities.join(log.where("change = 'park'").select("id"), "id", "left_anti").join(points, "id", "left").join(names, "id", "left")
    return rows.select("id", F.coalesce("called", "name").alias("name"), "entity_type", F.when(F.coalesce("moved", F.lit(False)), F.col("from")).otherwise(F.col("canonical_id")).alias("canonical_id"))
