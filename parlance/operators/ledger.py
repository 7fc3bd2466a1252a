"""The ledger of batch jobs against what the remote side lists: state transitions, each applied once, and the articles they free."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States in which a batch is still under way.
UNDER_WAY = ["validating", "in_progress", "finalizing", "cancelling"]
LEDGER = ["batch_id", "status", "output_file_id", "submitted_at", "collected", "error"]


def transitions(ledger: DataFrame, remote: DataFrame, as_of: str, hours: int = 48) -> DataFrame:
    """(batch_id, action, old_status, status, output_file_id, submitted_at): what must be done so that the ledger agrees with ``remote`` (batch_id, status, output_file_id, created_at).

    The remote side is right. A batch that the ledger lacks is ``adopt``ed while it is under way; if it ended in the last
    ``hours`` before ``as_of`` it is ``ingest``ed where it has an output and was completed, or else ``resolve``d; older
    ones are none of ours. Of a known batch that is not collected a change of state is an ``update``, a completed one is
    ingested, and one that ended otherwise is resolved. Batches that the remote side does not list stay. Of a batch listed
    twice the last page's row by time of creation, then by state, counts. Applied, the same listing gives no transition.
    """
    now = F.lit(as_of).cast("timestamp")
    listed = remote.groupBy("batch_id").agg(F.max(F.struct("created_at", "status", "output_file_id")).alias("r")).where("batch_id IS NOT NULL").select("batch_id", "r.*")
    listed = listed.withColumnsRenamed({"status": "new_status", "output_file_id": "new_output"})
    rows = ledger.join(listed, "batch_id", "full_outer").where("new_status IS NOT NULL")
    known, under_way = F.col("status").isNotNull(), F.col("new_status").isin(UNDER_WAY)
    recent = F.col("created_at") >= now - F.make_dt_interval(hours=F.lit(hours))
    ended = F.when((F.col("new_status") == "completed") & F.col("new_output").isNotNull(), "ingest").otherwise("resolve")
    action = (
        F.when(~known & under_way, "adopt")
        .when(~known & recent, ended)
        .when(known & ~F.coalesce("collected", F.lit(False)) & ~under_way, ended)
        .when(known & ~F.coalesce("collected", F.lit(False)) & (F.col("status") != F.col("new_status")), "update")
    )
    rows = rows.withColumn("action", action).where("action IS NOT NULL")
    return rows.select("batch_id", "action", F.col("status").alias("old_status"), F.col("new_status").alias("status"), F.col("new_output").alias("output_file_id"), F.coalesce("submitted_at", "created_at").alias("submitted_at"))


def applied(ledger: DataFrame, changes: DataFrame) -> DataFrame:
    """The ledger after ``changes``: ingested and resolved batches are collected, the latter with their state as the error."""
    done = F.col("action").isin("ingest", "resolve")
    new = changes.select("batch_id", "status", "output_file_id", "submitted_at", done.alias("collected"), F.when(F.col("action") == "resolve", F.col("status")).alias("error"))
    return new.unionByName(ledger.select(*LEDGER).join(changes.select("batch_id"), "batch_id", "left_anti"))


def free_orphans(articles: DataFrame, ledger: DataFrame, most_attempts: int = 3) -> DataFrame:
    """Articles in progress whose batch is none or is not open in the ledger go back to the queue, or fail after ``most_attempts``; others stay."""
    open_ = ledger.where(~F.coalesce("collected", F.lit(False))).select("batch_id", F.lit(True).alias("open"))
    rows = articles.join(open_, "batch_id", "left")
    orphan = (F.col("status") == "in_progress") & F.col("open").isNull()
    spent = F.coalesce("attempts", F.lit(0)) >= most_attempts
    status = F.when(orphan & spent, "failed").when(orphan, "unanalyzed").otherwise(F.col("status"))
    rows = rows.select(*[c for c in articles.columns if c not in ("status", "batch_id")], status.alias("status"), F.when(~orphan, F.col("batch_id")).alias("batch_id"))
    return rows.select(*articles.columns)
