"""Sources: model result lines, poll tables, article shards, the feed catalog and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import article_id, map_type, parse_score, registered_domain

RESULT = "source_country string, entities array<struct<entity string, entity_type string, power_score string, moral_score string>>"
LINE = "custom_id string, response struct<status_code int, body struct<choices array<struct<message struct<content string>>>>>"
TOPLINES = "series string, entity_name string, field_start date, field_end date, value_pct double, source_url string"


def parse_results(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(mentions, rejects) of batch result lines: JSON around JSON. A line that does not parse is a reject with its reason."""
    outer = lines.select(F.col(column).alias("line"), F.from_json(F.col(column), LINE).alias("o"))
    content = F.get(F.col("o.response.body.choices"), F.lit(0))["message"]["content"]
    rows = outer.select("line", F.col("o.custom_id").alias("article_id"), F.col("o.response.status_code").alias("status"), F.from_json(content, RESULT).alias("r"))
    reason = (
        F.when(F.col("article_id").isNull(), "not a result line")
        .when(F.coalesce("status", F.lit(0)) != 200, "failed request")
        .when(F.col("r").isNull() | F.col("r.entities").isNull(), "content is not a result")
    )
    rows = rows.withColumn("reason", reason)
    # no filter before the lines are parsed: it would parse each once more for every mention of it; names drop what is null
    entities = F.explode_outer(F.when(F.col("reason").isNull(), F.col("r.entities")))
    good = rows.select("article_id", F.col("r.source_country").alias("country"), entities.alias("e"))
    mentions = good.select(
        "article_id", "country", F.trim("e.entity").alias("name"), map_type("e.entity_type").alias("entity_type"), parse_score("e.power_score").alias("power"), parse_score("e.moral_score").alias("moral")
    )
    return mentions.where("name <> ''"), rows.where("reason IS NOT NULL").select("article_id", "reason", "line")


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_results(spark.read.text(path))


def recover_pairs(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Request and result lines joined on their custom_id; requests without a result keep null."""
    get = lambda rows, name: rows.select(F.get_json_object("value", "$.custom_id").alias("custom_id"), F.col("value").alias(name)).where("custom_id IS NOT NULL")
    return get(inputs, "request").dropDuplicates(["custom_id"]).join(get(outputs, "result").dropDuplicates(["custom_id"]), "custom_id", "left")


def read_toplines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOPLINES).option("header", True).csv(path)


def read_shards(spark: SparkSession, path: str, year: int | None = None, date: str = "date") -> DataFrame:
    """Parquet article shards with md5 ids; a year filters on the date column."""
    rows = spark.read.parquet(path)
    rows = rows if year is None else rows.where(F.year(F.to_date(date)) == year)
    return rows.withColumn("id", article_id("url"))


def feed_catalog(spark: SparkSession, catalog: list[dict]) -> DataFrame:
    """One row for each feed of each source."""
    rows = spark.createDataFrame([(c["name"], c.get("country"), c.get("language"), c.get("rss_feeds", [])) for c in catalog], "name string, country string, language string, feeds array<string>")
    return rows.select("name", "country", "language", F.explode("feeds").alias("feed"))


def domain_map(feeds: DataFrame) -> DataFrame:
    """(domain, name): the source of each registered domain, the first by name where several share one."""
    return feeds.groupBy(registered_domain("feed").alias("domain")).agg(F.min("name").alias("name")).where("domain IS NOT NULL")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)
