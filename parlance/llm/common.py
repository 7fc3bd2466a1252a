"""Shared plumbing of the training-data operators: written intermediates, packed rows and connected components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import discard, shared_dir  # noqa: F401  discard is for the operators

#: The six ASCII white-space characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
#: Parts in which the rows of one component look up its smallest value.
SALTS = 16


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, computes once, survives lost executors.

    The shuffle files of the write are dropped when it ends, so they do not add up over an operator's steps.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/parlance-{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    gc.collect()
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def split_words(text) -> Column:
    """The white-space-separated words of a text column, by Spark's own functions; none for null."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def broadcast_if_small(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """``df``, to be broadcast if it has at most ``rows`` rows; beyond, Spark picks the join by sizes.

    For written tables of short rows, whose rows are counted without computing them again.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(df: DataFrame, group: str, keys: list[Column], name: str) -> DataFrame:
    """``df`` with ``position`` (from 0, in order of ``keys`` within each value of ``group``) and ``total``, the group's rows.

    Rows are dealt by ranges of (group, keys), so a group of any size stands in many partitions; each is sorted
    and numbered by itself, and the counts of the ranges before give where it begins. ``group`` must not be null.
    Rows with equal keys are numbered in any order, which stays the same as the numbers are written.
    """
    order = [F.col(group), *keys]
    place = F.monotonically_increasing_id()  # partition, and the row's place in it
    rows = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", place), name)
    rows = rows.withColumn("part", F.shiftright("place", 33))
    parts = rows.groupBy(group, "part").agg(F.min("place").alias("begin"), F.count("*").alias("n"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("begin")).alias("shift"), F.sum("n").over(whole).alias("total"))
    return rows.join(parts, [group, "part"]).withColumn("position", F.col("place") + F.col("shift")).drop("place", "part", "shift")


def release() -> None:
    """Give a worker's freed memory back, so that workers that outlive their task do not hold what it needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow_rows(batches: Iterator[pa.RecordBatch], limit: int, column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of ``column``, a longer single row alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        sizes = np.array(pc.fill_null(pc.binary_length(values), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, base = stop, int(ends[stop - 1])
    release()


def pieces(text: bytes, size: int, gaps: bytes) -> Iterator[bytes]:
    """``text`` in pieces of about ``size`` bytes, cut behind one of the bytes of ``gaps``; without any, longer."""
    start = 0
    while start < len(text):
        stop = start + size
        if stop < len(text):
            cut = max(text.rfind(bytes([g]), start, stop) for g in gaps)
            stop = cut + 1 if cut >= start else min((x for g in gaps if (x := text.find(bytes([g]), stop)) >= 0), default=len(text))
        yield text[start:stop]
        start = stop


def union_find(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index of each one's component, after adding the links ``left[i] -- right[i]`` to those in ``label``."""
    while len(left):
        a, b = label[left], label[right]
        alive = a != b
        if not alive.any():
            break
        left, right, a, b = left[alive], right[alive], a[alive], b[alive]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node that links reach.

    Alternates large-star and small-star steps, each of them joins and aggregations on the node,
    so no component is ever gathered in one task. Each round is written to the shared folder.
    Nodes without an edge are not returned. Null ends are dropped; an empty input gives no rows.
    """
    links = (
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    links = materialize(links, "links")
    if links.isEmpty():
        return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    while True:
        # large star: each neighbour above a node joins the smallest of the node and its neighbours
        both = links.union(links.select(F.col("v"), F.col("u"))).where("u <> v").toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "large")
        discard(links)
        # small star: a node and its smaller neighbours join the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
        links = materialize(small.distinct(), "small")
        discard(large)
        state = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("s"), F.countDistinct("u").alias("d")).first()
        if before == state and state["n"] == state["d"]:
            break
        before = state
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def with_components(nodes: DataFrame, edges: DataFrame, node: str, value: str) -> DataFrame:
    """``nodes`` with ``component_id``: the smallest ``value`` among all rows whose ``node`` links reach.

    ``nodes`` may hold many rows of one ``node``; ``edges`` has columns a and b over ``node`` values.
    """
    found = connected_components(edges).withColumnRenamed("node", node)
    classes = materialize(nodes.groupBy(node).agg(F.min(value).alias("least")).join(found, node, "left"), "classes")
    # what has no link is its own component; rows of a large one meet its smallest value in SALTS parts
    linked = classes.where("component IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64(node), F.lit(SALTS)))
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    places = linked.join(least, ["component", "salt"]).select(node, "component_id")
    places = places.unionByName(classes.where("component IS NULL").select(node, F.col("least").alias("component_id")))
    return nodes.join(materialize(places, "components"), node)
