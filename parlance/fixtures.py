"""The news tables as DataFrames, derived from the star schema of the test tables.

sources are (nation, segment) pairs, articles are orders, entities are parts (of which ids from 40 on are
aliases), mentions are line items; power and moral are scores in [-2, 2].
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
TYPES = {"STANDARD": "person", "ECONOMY": "organization", "MEDIUM": "country", "PROMO": "event", "LARGE": "concept", "SMALL": "business"}
STATUSES = {"F": "completed", "O": "unanalyzed", "P": "in_progress"}
CANONICAL = 40
#: Line items of a part of the join with their articles, which grouping by article keeps.
PART_ROWS = 2_000_000


def _mapped(column, mapping: dict):
    out = None
    for key, value in mapping.items():
        out = F.when(column == key, value) if out is None else out.when(column == key, value)
    return out


@dataclass(frozen=True)
class News:
    """The tables of one folder; each is a lazy DataFrame, so queries read the columns they use."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def _customers(self) -> DataFrame:
        number = F.col("c_nationkey") * len(SEGMENTS) + _mapped(F.col("c_mktsegment"), {s: i for i, s in enumerate(SEGMENTS)})
        nation = self.table("nation")
        rows = self.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        return rows.select("c_custkey", number.alias("source_id"), F.concat_ws("/", "n_name", "c_mktsegment").alias("source"), F.col("n_name").alias("country"), F.col("n_regionkey").alias("region"))

    @cached_property
    def sources(self) -> DataFrame:
        """source_id, source, country, region."""
        return self._customers.drop("c_custkey").distinct()

    @cached_property
    def articles(self) -> DataFrame:
        """article_id, source_id, source, country, region, publish_date, scraped_at, status."""
        day = F.to_date("o_orderdate")
        status = _mapped(F.col("o_orderstatus"), STATUSES)
        rows = self.table("orders").join(self._customers, F.col("o_custkey") == F.col("c_custkey"))
        return rows.select(F.col("o_orderkey").alias("article_id"), "source_id", "source", "country", "region", day.alias("publish_date"), F.date_add(day, 1).alias("scraped_at"), status.alias("status"))

    @cached_property
    def entities(self) -> DataFrame:
        """id, name, entity_type, canonical_id (null for a canonical entity)."""
        return self.table("part").select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), _mapped(F.col("p_type"), TYPES).alias("entity_type"),
            F.when(F.col("p_partkey") >= CANONICAL, F.col("p_partkey") % CANONICAL).alias("canonical_id"),
        )

    @cached_property
    def mentions(self) -> DataFrame:
        """mention_id, article_id, raw_id, entity_id (canonical), the article's columns, power, moral (may be null)."""
        num = lambda c, k: F.round(F.col(c) * k).cast("double")
        rid = (F.col("l_partkey") % CANONICAL).cast("double")
        moral = num("l_tax", 50) - 2 + (F.col("region").cast("double") - 2) * (rid % 3 - 1) * 0.5
        moral = moral + F.when((F.col("publish_date") >= "1998-07-01") & (rid % 7 == 0), 0.75).otherwise(0.0)
        moral = F.when(F.col("l_quantity") != 1, F.greatest(F.lit(-2.0), F.least(F.lit(2.0), moral)))
        lines, articles = self.table("lineitem"), self.articles
        # as many parts as the rows need, where the session has fewer: a task's sorts and hash tables do not grow
        parts = -(-lines.count() // PART_ROWS)
        if parts > int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            lines, articles = lines.repartition(parts, "l_orderkey"), articles.repartition(parts, "article_id")
        rows = lines.join(articles, F.col("l_orderkey") == F.col("article_id"))
        return rows.select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("mention_id"), "article_id", F.col("l_partkey").alias("raw_id"), (F.col("l_partkey") % CANONICAL).alias("entity_id"),
            "source_id", "source", "country", "region", "publish_date", "status", (num("l_discount", 100) * 0.4 - 2).alias("power"), moral.alias("moral"),
        )


_CASE = "CASE c_mktsegment " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SEGMENTS)) + " END"


def _sql_case(column: str, mapping: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


#: The same tables in SQL, as the head of a query.
SQL = f"""WITH customers AS (
  SELECT c_custkey, c_nationkey * 5 + {_CASE} AS source_id, n_name || '/' || c_mktsegment AS source, n_name AS country, n_regionkey AS region
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), sources AS (SELECT DISTINCT source_id, source, country, region FROM customers),
articles AS (
  SELECT o_orderkey AS article_id, source_id, source, country, region, CAST(o_orderdate AS DATE) AS publish_date, CAST(o_orderdate AS DATE) + 1 AS scraped_at, {_sql_case("o_orderstatus", STATUSES)} AS status
  FROM orders JOIN customers ON o_custkey = c_custkey
), entities AS (
  SELECT p_partkey AS id, p_name AS name, {_sql_case("p_type", TYPES)} AS entity_type, CASE WHEN p_partkey >= {CANONICAL} THEN p_partkey % {CANONICAL} END AS canonical_id FROM part
), mentions AS (
  SELECT l_orderkey * 8 + l_linenumber AS mention_id, article_id, l_partkey AS raw_id, l_partkey % {CANONICAL} AS entity_id, source_id, source, country, region, publish_date, status,
    round(l_discount * 100)::DOUBLE * 0.4::DOUBLE - 2 AS power,
    CASE WHEN l_quantity <> 1 THEN greatest(-2::DOUBLE, least(2::DOUBLE, round(l_tax * 50)::DOUBLE - 2 + (region::DOUBLE - 2) * ((l_partkey % {CANONICAL})::DOUBLE % 3 - 1) * 0.5::DOUBLE
      + CASE WHEN publish_date >= DATE '1998-07-01' AND (l_partkey % {CANONICAL}) % 7 = 0 THEN 0.75::DOUBLE ELSE 0::DOUBLE END)) END AS moral
  FROM lineitem JOIN articles ON l_orderkey = article_id
), """
