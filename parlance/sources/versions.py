"""Published tables: versions beside each other, and a pointer that one rename moves.

A version is written, counted and described by a manifest before the pointer names it. So readers, in any session, see the
version before or the one after and never half of one, and a writer that dies leaves the pointer where it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .writers import exists, rounded_json

POINTER = "CURRENT"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    """The file system of a path, by the interface whose rename can replace a file."""
    return spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all: written beside its place, then renamed over it."""
    beside = f"{path}.{uuid.uuid4().hex}"
    place = _path(spark, beside)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    _files(spark, path).rename(place, _path(spark, path), how)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def fingerprint(df: DataFrame) -> list[Column]:
    """Counters that a table's rows give in any order: how many, and a sum and an xor of their hashes (of JSON, so of any type)."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}) if df.columns else F.lit("")
    h = F.xxhash64(row)
    return [F.count("*").alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"), F.coalesce(F.sum(F.pmod(h, F.lit(1 << 31))), F.lit(0)).alias("sum")]


def _versions(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    place = _path(spark, root)
    names = [x.getPath().getName() for x in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)]
    return sorted((int(n.split("-")[1]), n) for n in names if n.startswith("v-"))


def publish(rows: DataFrame, root: str, keep: int = 3) -> dict:
    """Write ``rows`` as the next version under ``root``, point to it, and delete all but the ``keep`` newest; its manifest.

    One writer at a time: of two at once the later rename wins, and both versions are whole. Versions that a dead writer
    left are deleted with the others as they age; the one that the pointer names never is.
    """
    spark = rows.sparkSession
    before = current(spark, root)
    number = 1 + max([0] + [n for n, _ in (_versions(spark, root) if exists(spark, root) else [])])
    name = f"v-{number:08d}-{uuid.uuid4().hex[:8]}"
    rows.write.parquet(f"{root}/{name}")
    written = spark.read.schema(rows.schema).parquet(f"{root}/{name}")
    counters = written.agg(*fingerprint(written)).first().asDict()
    manifest = {"version": number, "path": name, "schema": json.loads(rows.schema.json()), **counters, "previous": before and before["path"]}
    write_text(spark, f"{root}/{name}.json", json.dumps(manifest, sort_keys=True))
    write_text(spark, f"{root}/{POINTER}", json.dumps(manifest, sort_keys=True))
    files = _path(spark, root).getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [n for _, n in _versions(spark, root) if not n.endswith(".json")]
    for old in folders[:-keep]:
        if old != name:
            files.delete(_path(spark, f"{root}/{old}.json"), True)
            files.delete(_path(spark, f"{root}/{old}"), True)
    return manifest


def current(spark: SparkSession, root: str) -> dict | None:
    """The manifest that the pointer names, or None before the first version."""
    return json.loads(read_text(spark, f"{root}/{POINTER}")) if exists(spark, f"{root}/{POINTER}") else None


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The published table."""
    from pyspark.sql.types import StructType

    manifest = current(spark, root)
    if manifest is None:
        raise FileNotFoundError(f"nothing is published under {root}")
    return spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(f"{root}/{manifest['path']}")


def verify(spark: SparkSession, root: str) -> bool:
    """Whether the published rows are those that were counted."""
    manifest, rows = current(spark, root), read_current(spark, root)
    return rows.agg(*fingerprint(rows)).first().asDict() == {k: manifest[k] for k in ("rows", "xor", "sum")}


def export_all(kinds: dict[str, tuple[DataFrame, str, list[str]]], root: str) -> DataFrame:
    """Snapshot files of every kind, and their manifest (kind, files, rows, skipped, checksum), which is written as well.

    ``kinds`` names (rows, key, order): each key becomes a folder ``root/kind/key=...`` with its rows as lines of JSON,
    floats to 4 places, in order. Rows with a null or empty key have no file; they are counted as skipped. Each kind is one pass,
    without a loop over its keys. The manifest is the last file to appear.
    """
    manifest = None
    for kind, (rows, key, order) in kinds.items():
        spark = rows.sparkSession
        lines = rows.select(F.nullif(F.col(key).cast("string"), F.lit("")).alias("key"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], rounded_json(rows).alias("value"))
        by = [f"o{i}" for i in range(len(order))]
        kept = lines.where("key IS NOT NULL").repartition("key").sortWithinPartitions("key", *by).select("key", "value")
        kept.write.mode("overwrite").partitionBy("key").text(f"{root}/{kind}")
        read = read_snapshots(spark, root, kind)
        counted = read.agg(F.count_distinct("key").alias("files"), F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.xxhash64("key", "value")), F.lit(0)).alias("checksum"))
        skipped = rows.agg(F.count_if(F.nullif(F.col(key).cast("string"), F.lit("")).isNull()).alias("skipped"))
        row = counted.crossJoin(skipped).select(F.lit(kind).alias("kind"), "files", "rows", "skipped", "checksum")  # one row each
        manifest = row if manifest is None else manifest.unionByName(row)
    found = [r.asDict() for r in manifest.orderBy("kind").collect()]  # one row a kind
    write_text(spark, f"{root}/manifest.json", json.dumps(found))
    return spark.createDataFrame(found, manifest.schema)


def read_snapshots(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """(key, value) of the snapshot lines of a kind; none where nothing had a key."""
    if not exists(spark, f"{root}/{kind}"):
        return spark.createDataFrame([], "key string, value string")
    # the key is the folder's name, escaped once for the path and once for its address; inferring its type would lose zeros
    name = F.regexp_extract("_metadata.file_path", "/key=([^/]*)/[^/]*$", 1)
    decoded = F.url_decode(F.url_decode(F.replace(name, F.lit("+"), F.lit("%252B"))))
    return spark.read.text(f"{root}/{kind}", recursiveFileLookup=True).select(decoded.alias("key"), "value")
