"""Similarity of sources, entities, articles and vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.stats import guarded_r, significance
from .rollups import with_totals


def pearson_pairs(cells: DataFrame, key: str = "source_id", item: str = "entity_id", value: str = "value", least: int = 10) -> DataFrame:
    """(a, b, r, common) of all pairs a < b that share an item; r over common items, null if too few or flat."""
    rows = cells.select(key, item, value)
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col(f"a.{item}") == F.col(f"b.{item}")) & (F.col(f"a.{key}") < F.col(f"b.{key}")))
    return pairs.groupBy(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b")).agg(guarded_r(f"a.{value}", f"b.{value}", least).alias("r"), F.count("*").alias("common"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Undirected pairs as rows of either end."""
    turned = {"a": "b", "b": "a"}
    return pairs.union(pairs.select(*[F.col(turned.get(c, c)).alias(c) for c in pairs.columns]))


def neighbours(pairs: DataFrame, key: int, k: int = 5) -> DataFrame:
    """The ``k`` nearest and, where there are more, the ``k`` farthest of one item by r."""
    rows = both_ways(pairs).where((F.col("a") == key) & F.col("r").isNotNull()).withColumn("r", F.round("r", 6))
    everyone = Window.partitionBy("a")
    rows = rows.withColumns({"near": F.row_number().over(everyone.orderBy(F.desc("r"), "b")), "far": F.row_number().over(everyone.orderBy("r", "b")), "all": F.count("*").over(everyone)})
    nearest = rows.where(F.col("near") <= k).select(F.lit("nearest").alias("kind"), F.col("near").alias("rank"), "b", "r", "common")
    farthest = rows.where((F.col("far") <= k) & (F.col("all") > k)).select(F.lit("farthest").alias("kind"), F.col("far").alias("rank"), "b", "r", "common")
    return nearest.unionByName(farthest)


def full_matrix(pairs: DataFrame, order: DataFrame) -> DataFrame:
    """Every known ordered pair and the diagonal, with significance weights; pairs that were never measured are absent."""
    rows = both_ways(pairs).select("a", "b", "r", "common", (0.25 + 0.75 * significance("common")).alias("weight"))
    own = order.select(F.col("source_id").alias("a"), F.col("source_id").alias("b"), F.lit(1.0).alias("r"), F.lit(None).cast("long").alias("common"), F.lit(1.0).alias("weight"))
    return rows.unionByName(own)


def pair_scatter(cells: DataFrame, a: int, b: int, key: str = "source_id", item: str = "entity_id", limit: int = 50) -> DataFrame:
    """Items of both sides with both values, those best covered on the thinner side first."""
    x = cells.where(F.col(key) == a).select(item, F.col("value").alias("value_a"), F.col("n").alias("n_a"))
    y = cells.where(F.col(key) == b).select(item, F.col("value").alias("value_b"), F.col("n").alias("n_b"))
    rows = x.join(y, item).withColumn("coverage", F.least("n_a", "n_b"))
    return rows.orderBy(F.desc("coverage"), item).limit(limit)


def source_vectors(cells: DataFrame, least_sources: int = 2) -> DataFrame:
    """Cells of the entities that enough sources cover, to 2 places."""
    covered = cells.groupBy("entity_id").agg(F.countDistinct("source_id").alias("k")).where(F.col("k") >= least_sources).select("entity_id")
    return cells.join(covered, "entity_id", "left_semi").select("source_id", "entity_id", F.round("value", 2).alias("value"), "n")


def dividing_entities(cells: DataFrame, groups: DataFrame, least_sources: int = 2, least_groups: int = 2, ridge: float = 0.05, least_f: float = 3.0) -> DataFrame:
    """One-way analysis of variance of each entity over groups of sources: by between-group mean square, where F is large."""
    rows = cells.join(groups, "source_id").groupBy("entity_id", "grp").agg(F.count("*").alias("k"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    rows = rows.where(F.col("k") >= least_sources)
    n = F.sum("k")
    sums = rows.groupBy("entity_id").agg(
        F.count("*").alias("groups"), n.alias("sources"), F.sum(F.col("k") * F.col("m")).alias("total"), F.sum(F.col("k") * F.col("m") * F.col("m")).alias("squares"), F.sum(F.col("k") * F.col("v")).alias("within")
    )
    sums = sums.where(F.col("groups") >= least_groups)
    between = (F.col("squares") - F.col("total") * F.col("total") / F.col("sources")) / (F.col("groups") - 1)
    inside = F.try_divide("within", F.col("sources") - F.col("groups"))
    out = sums.select("entity_id", "groups", "sources", between.alias("between"), F.coalesce(inside, F.lit(0.0)).alias("inside"))
    out = out.withColumn("f", F.col("between") / (F.col("inside") + ridge))
    return out.where(F.round("f", 6) >= least_f)


def ppmi(mentions: DataFrame, least: int = 15) -> DataFrame:
    """Positive pointwise mutual information of entities in one article, for entities with enough mentions."""
    busy = mentions.groupBy("entity_id").agg(F.count("*").alias("k")).where(F.col("k") >= least).select("entity_id")
    rows = mentions.select("article_id", "entity_id").distinct().join(busy, "entity_id", "left_semi")
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.article_id") == F.col("b.article_id")) & (F.col("a.entity_id") < F.col("b.entity_id")))
    counts = pairs.groupBy(F.col("a.entity_id").alias("a"), F.col("b.entity_id").alias("b")).agg(F.count("*").alias("together"))
    margins = both_ways(counts).groupBy("a").agg(F.sum("together").alias("margin"))
    rows = counts.join(margins.withColumnRenamed("margin", "margin_a"), "a").join(margins.select(F.col("a").alias("b"), F.col("margin").alias("margin_b")), "b")
    rows = with_totals(rows, total=2 * F.sum("together"))
    pmi = F.log2(F.col("together").cast("double") * F.col("total") / (F.col("margin_a").cast("double") * F.col("margin_b")))
    return rows.select("a", "b", "together", F.greatest(F.lit(0.0), pmi).alias("ppmi"))


def _dot(x, y):
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


#: Vectors of a tile that meets a block of queries, and of a step within it.
TILE, STEP = 16_384, 2048


def _units(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Width: places and rows of the vectors of that width, at length 1 (a zero vector stays zero); null ones are left out."""
    lists = vectors.combine_chunks()
    widths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    out = {}
    for width in set(widths.tolist()) - {0}:
        at = np.flatnonzero(widths == width)
        x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        with np.errstate(invalid="ignore", over="ignore"):
            size = np.sqrt((x * x).sum(axis=1))
            out[width] = at, x / np.where(size == 0, 1.0, size)[:, None]
    return out


def _merged(best: np.ndarray, found: np.ndarray, row: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
    """Put candidates (row, at, value) among the rows' best values, kept with their places in ``found``; of equal ones the first place counts."""
    k = best.shape[1]
    rows = np.unique(row)
    row, at, value = (np.concatenate(x) for x in ((np.repeat(rows, k), row), (found[rows].ravel(), at), (best[rows].ravel(), value)))
    order = np.lexsort((at, -value, row))
    row, at, value = row[order], at[order], value[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    first = rank < k
    best[row[first], rank[first]], found[row[first], rank[first]] = value[first], at[first]


def _nearest(k: int, schema: pa.Schema):
    """A tile of vectors (id, v) and a block of queries (query, q): the ``k`` of the tile that are nearest to each, by cosine to 6 places, then id."""

    def run(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        vectors = vectors.sort_by("id")
        ids, queries = vectors["id"].to_numpy(), asked["query"].to_numpy()
        rows, columns = _units(asked["q"]), _units(vectors["v"])
        best, found = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1)
        begin, step = 0, 128
        while begin < len(ids):
            end = min(begin + step, len(ids))
            cosine = np.zeros((len(queries), end - begin))
            for width in rows.keys() & columns.keys():
                (x, q), (y, v) = rows[width], columns[width]
                m, n = np.searchsorted(y, [begin, end])
                with np.errstate(invalid="ignore"):
                    if len(x) == len(queries) and n - m == end - begin:
                        cosine = q @ v[m:n].T
                    else:
                        cosine[np.ix_(x, y[m:n] - begin)] = q @ v[m:n].T
            cosine[np.isnan(cosine)] = np.inf  # before all others, as where rows are sorted
            # of equal values the smaller id stands already; a greater one differs by 1e-6
            row, at = np.nonzero(cosine > best[:, -1:] + 4e-7)
            other = queries[row] != ids[at + begin]
            row, at = row[other], at[other]
            if len(row):
                _merged(best, found, row, at + begin, np.round(cosine[row, at], 6) + 0.0)
            begin, step = end, STEP
        row, rank = np.nonzero(found >= 0)
        at, value = found[row, rank], best[row, rank]
        return pa.table([asked["query"].take(pa.array(row)), vectors["id"].take(pa.array(at)), pa.array(np.where(np.isinf(value), np.nan, value))], schema=schema)

    return run


def cosine_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", block: int = 2000) -> DataFrame:
    """The ``k`` most similar other vectors of each query; a zero vector is similar to nothing (0).

    ``queries`` is a stated set of ids. They are dealt to blocks and the vectors to tiles, and each block meets each tile
    as two matrices, which leave ``k`` rows of a query: products, not rows, grow with both.
    """
    norm = F.sqrt(_dot(F.col(vector), F.col(vector)))
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.when(norm.isNotNull(), F.col(vector).cast("array<double>")).alias("v"))
    asked = rows.join(queries.select(F.col(key).alias("id")), "id", "left_semi").select(F.col("id").alias("query"), F.col("v").alias("q"))
    blocks, tiles = (max(1, -(-x.count() // size)) for x, size in ((queries, block), (vectors, TILE)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    met = rows.withColumn("tile", dealt("id", tiles)).withColumn("block", every(blocks)).groupBy("tile", "block")
    asked = asked.withColumn("block", dealt("query", blocks)).withColumn("tile", every(tiles)).groupBy("tile", "block")
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("query", kind), T.StructField(key, kind), T.StructField("cosine", T.DoubleType())])
    pairs = met.cogroup(asked).applyInArrow(_nearest(k, to_arrow_schema(schema)), schema)
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), key)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similar_articles(mentions: DataFrame, article_id: int, days: int = 3, least: float = 0.3) -> DataFrame:
    """Articles within ``days`` of one by Jaccard over their entities, with the distance of shared readings, farthest first."""
    cells = mentions.where("moral IS NOT NULL").groupBy("article_id", "publish_date", "entity_id").agg(F.avg("power").alias("p"), F.avg("moral").alias("m"))
    own = cells.where(F.col("article_id") == article_id).select(F.col("publish_date").alias("day"), "entity_id", F.col("p").alias("own_p"), F.col("m").alias("own_m"))
    size = own.agg(F.count("*").alias("own_size"), F.max("day").alias("own_day"))
    span = cells.where(F.col("article_id") != article_id).join(F.broadcast(size), F.col("publish_date").between(F.date_sub("own_day", days), F.date_add("own_day", days)))
    rows = span.join(own.drop("day"), "entity_id", "left")
    gap = F.sqrt(F.pow(F.col("p") - F.col("own_p"), F.lit(2.0)) + F.pow(F.col("m") - F.col("own_m"), F.lit(2.0)))
    out = rows.groupBy("article_id", "own_size").agg(F.count("own_p").alias("shared"), F.count("*").alias("entities"), F.avg(gap).alias("distance"))
    out = out.withColumn("jaccard", F.col("shared") / (F.col("own_size") + F.col("entities") - F.col("shared")))
    return out.where((F.col("shared") > 0) & (F.col("jaccard") >= least)).select("article_id", "shared", "jaccard", "distance").orderBy(F.desc("distance"), "article_id")


def spearman(rows: DataFrame, x: str, y: str, keys: tuple[str, ...] = (), least: int = 3) -> DataFrame:
    """Spearman's rank correlation with average ranks, by ``keys``."""
    rows = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    keys_ = list(keys) or [F.lit(0)]
    rank = lambda c: F.rank().over(Window.partitionBy(*keys_).orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys_, c)) - 1) / 2
    return rows.withColumns({"rank_x": rank(x), "rank_y": rank(y)}).groupBy(*keys).agg(guarded_r("rank_x", "rank_y", least).alias("rho"), F.count("*").alias("n"))


def poll_readings(polls: DataFrame, mentions: DataFrame, days: int = 30) -> DataFrame:
    """Mean readings of each poll's entity from ``days`` before its field start to ``days`` after its end (range join).

    Mentions are summed by entity and day first, and days by window once for all polls of an entity that share it, so what
    is spread over days grows with the windows, not with the polls: entity and day are the key of the join.
    """
    daily = mentions.groupBy("entity_id", "publish_date").agg(F.sum("moral").alias("s"), F.count("moral").alias("n"))
    window = ["entity_id", "field_start", "field_end"]
    asked = polls.where("field_start <= field_end")
    span = F.sequence(F.date_sub("field_start", days), F.date_add("field_end", days))
    rows = asked.select(*window).distinct().withColumn("publish_date", F.explode(span)).join(daily, ["entity_id", "publish_date"])
    sums = rows.groupBy(*window).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    rows = asked.join(sums, window)
    return rows.groupBy("poll_id", "entity_id", "value_pct").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("reading"), F.sum("n").alias("n"))


def poll_lead_lag(polls: DataFrame, mentions: DataFrame, most: int = 6, days: int = 30, least: int = 4) -> DataFrame:
    """(entity_id, shift, rho, n): Spearman's r of polls and readings from windows up to ``most`` months of 30 days earlier (positive: readings lead) or later."""
    moved = polls.withColumn("shift", F.explode(F.sequence(F.lit(-most), F.lit(most))))
    back = F.col("shift") * -30
    moved = moved.withColumns({"field_start": F.date_add("field_start", back), "field_end": F.date_add("field_end", back), "poll_id": F.struct("poll_id", "shift")})
    readings = poll_readings(moved, mentions, days).withColumn("shift", F.col("poll_id.shift"))
    return spearman(readings, "value_pct", "reading", ("entity_id", "shift"), least).where(F.col("n") >= least)


def entity_cosine(cells: DataFrame, least: int = 3) -> DataFrame:
    """Cosine of entities over sources (missing cells are zero), of pairs that share a source."""
    norms = cells.groupBy("entity_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"), F.count("*").alias("k")).where((F.col("k") >= least) & (F.col("norm") > 1e-9))
    rows = cells.join(norms, "entity_id").select("entity_id", "source_id", (F.col("value") / F.col("norm")).alias("value"))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.source_id") == F.col("b.source_id")) & (F.col("a.entity_id") < F.col("b.entity_id")))
    return pairs.groupBy(F.col("a.entity_id").alias("a"), F.col("b.entity_id").alias("b")).agg(F.sum(F.col("a.value") * F.col("b.value")).alias("cosine"), F.count("*").alias("common"))
