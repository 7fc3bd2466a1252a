"""Truncated singular value decomposition of sparse matrices that are rows of (i, j, v).

Subspace iteration: a block of some orthonormal columns, one row of doubles for each i, is multiplied by the matrix and
its transpose until its singular values stand still. A product is a join on the one index and a sum by the other, whose
partial sums are combined before they move; the columns are orthogonalised by the block's Gram matrix, which is a sum
over rows of a few dozen by a few dozen numbers and the only thing that comes to the driver. So neither matrix nor
vectors are ever in one place, and no count of rows or columns is a limit. What the columns are centred by is never
subtracted from the entries (that would fill the matrix): cells that are known are centred, others are zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize

#: Columns beyond those asked for, which make the iteration converge fast; rounds at most; relative change that ends it.
MORE, ROUNDS, TOLERANCE = 24, 200, 1e-10


def _columns(width: int) -> list[str]:
    return [f"x{k}" for k in range(width)]


def _times(entries: DataFrame, block: DataFrame, by: str, to: str, width: int) -> DataFrame:
    """The product of the matrix (or its transpose) and ``block``, whose key is ``by``: rows of (to, x0, ...)."""
    sums = [F.sum(F.col("v") * F.col(x)).alias(x) for x in _columns(width)]
    return entries.join(block, by).groupBy(to).agg(*sums)


def gram(block: DataFrame, width: int) -> np.ndarray:
    """The sum over rows of x x': each partition sends one small matrix, which Spark adds up."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for rows in batches:
            x = rows.to_numpy(float)
            total += x.T @ x
        yield pd.DataFrame({"k": np.arange(width * width), "value": total.ravel()})

    rows = block.select(*_columns(width)).mapInPandas(part, "k int, value double").groupBy("k").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(width * width)
    for r in rows:
        out[r["k"]] = r["value"]
    return out.reshape(width, width)


def _turned(block: DataFrame, key: str, turn: np.ndarray) -> DataFrame:
    """Each row x as x times ``turn``."""
    before, after = _columns(turn.shape[0]), _columns(turn.shape[1])

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = pd.DataFrame(rows[before].to_numpy(float) @ turn, columns=after)
            out.insert(0, key, rows[key].to_numpy())
            yield out

    kind = block.schema[key].dataType.simpleString()
    return block.mapInPandas(product, f"{key} {kind}, " + ", ".join(f"{x} double" for x in after))


def _spectrum(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of the eigenvalues of a Gram matrix, largest first, and its eigenvectors."""
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    return np.sqrt(np.maximum(values[::-1], 0)), vectors[:, ::-1]


def _orthonormal(block: DataFrame, key: str, width: int, name: str) -> tuple[DataFrame, int]:
    """``block`` with orthonormal columns that span the same, written; those that are (nearly) zero go. Twice, as once leaves rounding errors."""
    for k in range(2):
        size, vectors = _spectrum(gram(block, width))
        kept = size > 1e-10 * max(size[0], 1e-300)
        turned = materialize(_turned(block, key, vectors[:, kept] / size[kept]), name)
        if k:
            discard(block)
        block, width = turned, int(kept.sum())
    return block, width


def truncated_svd(entries: DataFrame, components: int, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """(i, vector) for each i with an entry, and the singular values: vectors are U times the singular values.

    ``entries`` (i, j, v) has each cell once; missing cells are zero. At most ``components`` of them, fewer where the
    rank is less. The start is a hash of i, so reruns agree; each column's largest entry is positive. Only subspaces
    of different singular values are determined, so vectors are to be compared by cosines. A matrix without entries, or of
    zeros alone, gives no rows.
    """
    entries = materialize(entries.select("i", "j", F.col("v").cast("double").alias("v")).where("v <> 0"), "entries")
    keys = entries.select("i").distinct()
    n = keys.count()
    if not n:
        return entries.select("i", F.array("v").alias("vector")), np.zeros(0)
    width = min(components + MORE, n)
    start = keys.select("i", *[((F.pmod(F.xxhash64("i", F.lit(seed), F.lit(k)), F.lit(1 << 32)) + 0.5) / (1 << 31) - 1).alias(x) for k, x in enumerate(_columns(width))])
    block, width = _orthonormal(start, "i", width, "start")
    before = None
    for _ in range(ROUNDS):
        across = materialize(_times(entries, block, "i", "j", width), "across")
        size, vectors = _spectrum(gram(across, width))
        few = min(components, int((size > 1e-10 * max(size[0], 1e-300)).sum()))
        still = before is not None and len(before) >= few and np.allclose(size[:few], before[:few], rtol=TOLERANCE, atol=0)
        if still or not few:
            break
        before = size
        moved = materialize(_times(entries, across, "j", "i", width), "moved")
        discard(block, across)
        block, width = _orthonormal(moved, "i", width, "block")
        discard(moved)
    else:
        raise RuntimeError(f"the decomposition did not converge in {ROUNDS} rounds")
    discard(across)
    size, turn = size[:few], vectors[:, :few] * size[:few]
    scaled = materialize(_turned(block, "i", turn), "vectors")
    discard(block, entries)
    # one row for each column: the entry that is largest in size, by the smallest i on a tie
    names = _columns(few)
    tops = scaled.agg(*[F.max_by(F.col(x), F.struct(F.round(F.abs(x), 9), F.hash("i"))).alias(x) for x in names]).first() if few else {}
    signed: list[Column] = [F.col(x) * (-1.0 if tops[x] < 0 else 1.0) for x in names]
    return scaled.select("i", F.array(*signed).alias("vector")), size


def entity_embeddings(ppmi: DataFrame, components: int = 24) -> DataFrame:
    """(entity_id, vector): co-occurrence vectors from the symmetric matrix of ``ppmi`` (a, b, ppmi), each pair once, in any order.

    Entities without a positive value have no vector.
    """
    both = ppmi.select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("ppmi").alias("v"))
    both = both.unionByName(both.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    return truncated_svd(both, components)[0].withColumnRenamed("i", "entity_id")


def sentiment_embeddings(cells: DataFrame, components: int = 24, value: str = "mean_moral") -> DataFrame:
    """(entity_id, vector): vectors of entities from their mean scores by (source, period), centred by each column's mean.

    ``cells`` has source_id, entity_id, period_start and ``value``, whose nulls are cells never observed.
    """
    known = cells.where(F.col(value).isNotNull()).select(F.col("entity_id").alias("i"), F.struct("source_id", "period_start").alias("j"), F.col(value).alias("v"))
    means = known.groupBy("j").agg(F.avg("v").alias("mean"))
    centred = known.join(means, "j").select("i", "j", (F.col("v") - F.col("mean")).alias("v"))
    return truncated_svd(centred, components)[0].withColumnRenamed("i", "entity_id")


def vector_cosines(vectors: DataFrame, of: DataFrame) -> DataFrame:
    """(query, entity_id, cosine) of each entity of ``of`` (entity_id) with every other; ``of`` is a stated set of queries, broadcast by Spark if small."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x))
    unit = vectors.select("entity_id", "vector", norm(F.col("vector")).alias("norm")).where("norm > 1e-12")
    asked = unit.join(of.select("entity_id").distinct(), "entity_id").select(F.col("entity_id").alias("query"), F.col("vector").alias("q"), F.col("norm").alias("q_norm"))
    dot = F.aggregate(F.zip_with("vector", "q", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    return unit.join(asked, F.col("entity_id") != F.col("query")).select("query", "entity_id", (dot / (F.col("norm") * F.col("q_norm"))).alias("cosine"))
