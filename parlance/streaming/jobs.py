"""Streaming forms of the incremental operators: windows, deduplicated ingest, leases and decayed sums.

Streaming results are provisional under their watermark; the batch rollups stay the source of truth for late data.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.writers import new_rows, table_or_empty, valid_articles

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """The event stream with an event time that watermarks accept."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).option("pathGlobFilter", "events*.parquet").parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(rows: DataFrame, width: str = "1 day", slide: str | None = None, start: str | None = None, late: str = "2 days", key: str = "event_type") -> DataFrame:
    """Counts and means by event-time window; weeks that begin on Monday start at ``4 days``."""
    window = F.window("ts", width, slide or width, start) if start else F.window("ts", width, slide or width)
    out = rows.withWatermark("ts", late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.avg("value").alias("avg_value"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n", F.round("avg_value", 6).alias("avg_value"))


def sessions(rows: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each user."""
    out = rows.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def deduplicated(rows: DataFrame, key: str = "event_id", late: str = "7 days") -> DataFrame:
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def ingest(rows: DataFrame, table: str, rejects: str, schema: str, checkpoint: str):
    """Validated articles appended once each, micro-batch by micro-batch; invalid ones go to ``rejects``.

    A batch that is run again finds its own ids in the table and adds nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        good, bad = valid_articles(batch)
        existing = table_or_empty(batch.sparkSession, table, schema)
        new_rows(good, existing).write.mode("append").parquet(table)
        bad.write.mode("append").parquet(rejects)
        batch.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def leases(rows: DataFrame, hours: int = 6, late: str = "1 hour") -> DataFrame:
    """(user_id, status, at): leases begun by ``click`` and ended by ``purchase``; one that runs out is reset by a timer."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        begun = state.get[0] if state.exists else None
        if state.hasTimedOut:
            out.append((key[0], "reset", pd.Timestamp(begun, unit="ms")))
            state.remove()
        else:
            seen = pd.concat(batches).sort_values(["ts", "event_id"])
            for kind, ts in seen[["event_type", "ts"]].itertuples(index=False):
                now = int(ts.timestamp() * 1000)
                if begun is not None and now - begun > hours * 3_600_000:
                    out.append((key[0], "reset", pd.Timestamp(begun, unit="ms")))
                    begun = None
                if kind == "click" and begun is None:
                    begun = now
                elif kind == "purchase" and begun is not None:
                    out.append((key[0], "completed", ts))
                    begun = None
            if begun is None:
                if state.exists:
                    state.remove()
            else:
                state.update((begun,))
                state.setTimeoutTimestamp(max(begun + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "status", "at"])

    watched = rows.withWatermark("ts", late).groupBy("user_id")
    return watched.applyInPandasWithState(step, "user_id long, status string, at timestamp", "begun long", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is available into Parquet files under ``path``, and return all that it has written there.

    Each micro-batch has a folder of its own, written anew if the batch is run again, so a stream that goes on from its
    checkpoint neither loses nor repeats rows. Of a ``complete`` stream the last batch is the result; otherwise all are.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    rows.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    written = table_or_empty(rows.sparkSession, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", batch long")
    if mode == "complete":
        last = written.agg(F.max("batch")).first()[0]
        written = written.where(F.col("batch") == (-1 if last is None else last))
    return written.select(*rows.columns)


def ingest_matched(rows: DataFrame, matched: Column, order: str, limit: int, path: str, checkpoint: str) -> DataFrame:
    """Take rows of a stream that are ``matched``, at most ``limit`` in all, and return what is taken; of a micro-batch the first by ``order``.

    The count is that of the batches before, which stand in folders of their own, so a batch that is run again takes the
    same rows, and a stream that goes on from its checkpoint neither loses nor repeats one. At the limit it stops reading.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", batch long"
    spark = rows.sparkSession

    def taken() -> DataFrame:
        return table_or_empty(spark, path, schema)

    def write(batch: DataFrame, number: int) -> None:
        left = limit - taken().where(F.col("batch") < number).count()
        batch.where(matched).orderBy(order).limit(max(0, left)).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if taken().where(F.col("batch") <= number).count() >= limit:
            full.append(number)

    full: list[int] = []
    if taken().count() < limit:
        stream = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        while not stream.awaitTermination(1):
            if full:
                stream.stop()
    return taken().select(*rows.columns)


def trailing_stats(rows: DataFrame, width: str = "7 days", slide: str = "1 day", late: str = "14 days", key: str = "event_type") -> DataFrame:
    """Moments of each key over the trailing windows; state older than the watermark is dropped."""
    out = rows.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), key)
    out = out.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance"))
    return out.select(F.col("w.end").alias("window_end"), key, "n", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


def upsert_to_table(rows: DataFrame, root: str, keys: list[str], checkpoint: str, view: str):
    """Micro-batches of updates merged into a table by keys; every batch publishes a whole new version as ``global_temp.view``."""
    from ..sources.writers import upsert

    schema = rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # only the first batch has nothing before it; a version that cannot be read is an error
        before = spark.read.schema(schema).parquet(f"{root}/b-{number - 1}") if number else spark.createDataFrame([], schema)
        upsert(before, batch, keys).write.mode("overwrite").parquet(f"{root}/b-{number}")
        spark.read.schema(schema).parquet(f"{root}/b-{number}").createOrReplaceGlobalTempView(view)

    return rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decayed_sums(rows: DataFrame, scale_days: float = 14.0, late: str = "1 day") -> DataFrame:
    """Exponentially decayed counts and sums of each user, kept in state and emitted with every batch."""
    scale = scale_days * 86_400_000

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, weight, total = state.get if state.exists else (0, 0.0, 0.0)
        seen = pd.concat(batches).sort_values(["ts", "event_id"])
        for ts, value in seen[["ts", "value"]].itertuples(index=False):
            now = int(ts.timestamp() * 1000)
            if now >= at:
                fade = 2.718281828459045 ** ((at - now) / scale) if weight else 0.0
                at, weight, total = now, weight * fade + 1, total * fade + float(value)
            else:  # late: it enters as faded as it would be by now
                fade = 2.718281828459045 ** ((now - at) / scale)
                weight, total = weight + fade, total + fade * float(value)
        state.update((at, weight, total))
        yield pd.DataFrame([(key[0], pd.Timestamp(at, unit="ms"), weight, total)], columns=["user_id", "at", "weight", "total"])

    watched = rows.where("value IS NOT NULL").withWatermark("ts", late).groupBy("user_id")
    return watched.applyInPandasWithState(step, "user_id long, at timestamp, weight double, total double", "at long, weight double, total double", "update", GroupStateTimeout.NoTimeout)
