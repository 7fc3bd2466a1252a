"""Sinks. Tables are Parquet folders; a new state is a projection of the old one, written whole or by partition."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import article_id


def valid_articles(rows: DataFrame, least_chars: int = 500, longest_url: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of scraped rows (url, title, text, ...): ids are md5 of the url, NULs go, titles are cut."""
    clean = lambda c: F.regexp_replace(c, "\x00", "")
    rows = rows.withColumns({"id": article_id("url"), "title": F.substring(clean("title"), 1, 512), "text": clean("text")})
    reason = F.when(F.col("url").isNull() | (F.length("url") > longest_url), "url").when(F.coalesce(F.length("text"), F.lit(0)) < least_chars, "text")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL")


def new_rows(rows: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not there yet, one of each (insert, on conflict do nothing)."""
    return rows.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def upsert(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows, and the old ones that none of them replaces."""
    return rows.unionByName(existing.join(rows.select(*keys).distinct(), keys, "left_anti"))


def retained(rows: DataFrame, column: str, as_of: str, days: int = 14) -> DataFrame:
    """Rows of the last ``days`` before ``as_of``."""
    return rows.where(F.col(column) >= F.date_sub(F.lit(as_of).cast("date"), days))


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Delete the partitions that the rows touch, and write them anew."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def rebuild(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def publish(rows: DataFrame, root: str, view: str) -> str:
    """A new version beside the old ones, then the view switches to it: readers never see half of one."""
    path = f"{root}/v-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    rows.sparkSession.read.parquet(path).createOrReplaceTempView(view)
    return path


def increment(counters: DataFrame, name: str, delta: int) -> DataFrame:
    """Counters (name, value) after adding to one; a new one begins at zero."""
    more = counters.sparkSession.createDataFrame([(name, delta)], "name string, value long")
    return counters.unionByName(more).groupBy("name").agg(F.sum("value").alias("value"))


def remap(rows: DataFrame, mapping: DataFrame, column: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(undo log (key, old, new), remapped rows) by ``mapping`` (old, new)."""
    joined = rows.join(mapping.select(F.col("old").alias(column), "new"), column, "left")
    log = joined.where(F.col("new").isNotNull() & (F.col("new") != F.col(column))).select(key, F.col(column).alias("old"), "new")
    return log, joined.withColumn(column, F.coalesce("new", column)).drop("new").select(*rows.columns)


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the deleted ids."""
    return rows.join(ids.select(key), key, "left_anti")


def rounded_json(rows: DataFrame, places: int = 4):
    """A row as JSON with floats rounded; NaN is left out."""
    fields = [F.round(F.nanvl(F.col(c), F.lit(None).cast("double")), places).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    return F.to_json(F.struct(*fields))


def export_snapshots(rows: DataFrame, path: str, key: str, order: list[str]) -> None:
    """JSON lines by key, in one pass: a folder for each key, rows in order, no loop over keys."""
    lines = rows.withColumn("value", rounded_json(rows)).select(key, *[F.col(c) for c in order if c != key], "value")
    lines.repartition(key).sortWithinPartitions(key, *order).select(key, "value").write.mode("overwrite").partitionBy(key).text(path)


def request_lines(articles: DataFrame, model: str, prompt: str, names: DataFrame | None = None, most: int = 15_000) -> DataFrame:
    """Batch request lines: the prompt, the head of the text and the article's shortlist of known names."""
    rows = articles
    if names is not None:
        short = names.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), ", ").alias("known"))
        rows = rows.join(short, "doc_id", "left")
    else:
        rows = rows.withColumn("known", F.lit(None).cast("string"))
    content = F.concat(F.lit(prompt), F.coalesce(F.concat(F.lit("\nKnown: "), "known"), F.lit("")), F.lit("\n"), F.substring("text", 1, most))
    message = F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))
    body = F.struct(F.lit(model).alias("model"), message.alias("messages"))
    return rows.select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("custom_id"), F.lit("POST").alias("method"), body.alias("body"))).alias("value"))


def requeue(articles: DataFrame, most_attempts: int = 3) -> DataFrame:
    """Failed articles go back to the queue, or retire after ``most_attempts``."""
    attempts = F.coalesce("attempts", F.lit(0)) + 1
    status = F.when(F.col("status") != "failed", F.col("status")).when(attempts >= most_attempts, "retired").otherwise("unanalyzed")
    return articles.withColumns({"status": status, "attempts": F.when(F.col("status") == "failed", attempts).otherwise(F.coalesce("attempts", F.lit(0)))})


def reset_stuck(articles: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Articles in progress for longer than ``hours`` become unanalysed."""
    late = (F.col("status") == "in_progress") & (F.col("last_attempt") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours)))
    return articles.withColumn("status", F.when(late, "unanalyzed").otherwise(F.col("status")))


def queue(articles: DataFrame, limit: int = 50, most_attempts: int = 3, least_chars: int = 500) -> DataFrame:
    """The next articles to analyse."""
    ready = (F.col("status") == "unanalyzed") & (F.length("text") >= least_chars) & (F.coalesce("attempts", F.lit(0)) < most_attempts)
    return articles.where(ready).orderBy("id").limit(limit)


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key."""
    by = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or a folder, in any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not have been written yet; one that is there but cannot be read is an error."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
