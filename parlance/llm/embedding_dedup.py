"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors of cosine c are sqrt(2 - 2c) apart, so the search is a distance join at that epsilon. Vectors are
rotated to the leading principal dimensions of a bounded sample (any rotation keeps distances, so the sample
affects speed alone), and sorted by the cells of a grid of side epsilon there. The sorted sequence is cut into
chunks. Chunks whose boxes are within epsilon in the leading dimensions meet as pairs, each pair in a task of
its own, which joins the two intervals recursively: boxes further apart than epsilon are skipped, large
intervals are halved, small ones are compared by a matrix product in double precision. Equal vectors are one
class with a count, and only counts and the links of a spanning forest leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, union_find, with_components

#: Rows of the sample that gives the principal dimensions, and how many of these the grid has.
SAMPLE, DIMENSIONS = 4000, 6
CHUNK, SMALL = 8192, 256
#: Slack for rounding where distances only skip pairs; the cosine decides.
SLACK = 1e-6


def unit(vectors: list) -> list[np.ndarray | None]:
    """Each vector scaled to length one, or None where it is null, empty, zero or holds null or non-finite components."""
    out = []
    for v in vectors:
        x = np.array(v, np.float64) if v is not None and None not in v else np.zeros(0)
        if not len(x) or not np.isfinite(x).all() or not x.any():
            out.append(None)
            continue
        x /= np.abs(x).max()
        out.append(x / np.sqrt(x @ x) + 0.0)
    return out


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, class: the unit vector's bytes, or null)."""
    for batch in batches:
        packed = [None if x is None else x.astype("<f8").tobytes() for x in unit(batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["vec_id", "class"])


def _matrix(column, width: int) -> np.ndarray:
    """Rows of bytes as vectors, shorter ones filled up with zeros."""
    values = column.to_pylist()
    return np.frombuffer(b"".join([v.ljust(8 * width, b"\0") for v in values]), "<f8").reshape(len(values), width)


def _join(a: np.ndarray, b: np.ndarray, k: int, epsilon: float, cosine: float, same: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """(offset in a, offset in b, matrix of links) of the interval pairs that may hold links.

    Rows are in rotated coordinates, of which the first ``k`` give the boxes. With ``same`` the intervals are
    one, and each of its pairs of parts comes once.
    """
    work = [(0, len(a), 0, len(b))]
    while work:
        i, j, m, n = work.pop()
        left, right = a[i:j, :k], b[m:n, :k]
        gap = np.maximum(0, np.maximum(left.min(0) - right.max(0), right.min(0) - left.max(0)))
        if math.sqrt(float(gap @ gap)) > epsilon + SLACK:
            continue
        if max(j - i, n - m) <= SMALL:
            hits = a[i:j] @ b[m:n].T >= cosine
            if hits.any():
                yield i, m, hits
        elif same and i == m and j == n:
            half = (i + j) // 2
            work += [(i, half, i, half), (i, half, half, j), (half, j, half, j)]
        elif j - i >= n - m:
            half = (i + j) // 2
            work += [(i, half, m, n), (half, j, m, n)]
        else:
            half = (m + n) // 2
            work += [(i, j, m, half), (i, j, half, n)]


def _compare(k: int, width: int, epsilon: float, cosine: float):
    """Of a pair of chunks: (id, id of a linked one or null, links gained). Vectors of different lengths do not link."""

    def compare(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk").to_numpy()
        order = np.lexsort((table.column("rank").to_numpy(), chunk))
        ids, weight = table.column("id").to_numpy()[order], table.column("weight").to_numpy()[order]
        rows, chunk, length = _matrix(table.column("rotated"), width)[order], chunk[order], table.column("length").to_numpy()[order]
        ragged = length.min() != length.max()
        cut = int(np.searchsorted(chunk, chunk[0], side="right"))
        same = cut == len(rows)
        if same and table.column("first")[0].as_py() != table.column("second")[0].as_py():
            cut, same = len(rows), True  # the other chunk is empty
        base = 0 if same else cut
        gained = np.zeros(len(rows), np.int64)
        label = np.arange(len(rows))
        for i, m, hits in _join(rows[:cut], rows[base:], k, epsilon, cosine, same):
            x, y = np.arange(i, i + hits.shape[0]), np.arange(base + m, base + m + hits.shape[1])
            if ragged:
                hits &= length[x][:, None] == length[y][None, :]
            if same and i == m:
                np.fill_diagonal(hits, False)
                gained[x] += hits @ weight[y]
            else:
                gained[x] += hits @ weight[y]
                gained[y] += hits.T @ weight[x]
            p, q = np.nonzero(hits)
            label = union_find(label, x[p], y[q])
        other = np.flatnonzero(label != np.arange(len(rows)))
        some = np.flatnonzero(gained)
        return pa.table([
            pa.array(np.concatenate([ids[some], ids[other]])),
            pa.array([None] * len(some) + ids[label[other]].tolist(), pa.int64()),
            pa.array(np.concatenate([gained[some], np.zeros(len(other), np.int64)])),
        ], names=["a", "b", "gained"])

    return compare


def _id(seed: int):
    """What stands for a class of equal vectors where only equality matters."""
    return F.xxhash64(F.lit(seed), "class")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Rows with
    equal vectors link with each other; repeated vec_ids count as vectors of their own with one id. Vectors of
    different lengths do not link. No rows give no rows.
    """
    epsilon = math.sqrt(max(0.0, 2 - 2 * cosine))
    given = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("embedding"))
    rows = materialize(given.mapInArrow(_classes, "vec_id long, class binary"), "units")
    # one row for each class of equal vectors; a hash of the class stands for it where only equality matters
    units = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    units = materialize(units, "classes")
    stats = units.agg(F.count("*").alias("n"), F.max(F.octet_length("class")).alias("bytes")).first()
    seed = 0
    while units.select(F.countDistinct(_id(seed))).first()[0] < stats["n"]:  # until no two classes share an id
        seed += 1
    units = units.withColumn("id", _id(seed))
    sample = units.orderBy("id").limit(SAMPLE).select("class").toArrow()
    if not sample.num_rows:
        alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return alone.withColumn("kept", F.lit(True))
    width = stats["bytes"] // 8
    known = _matrix(sample.column(0), width)
    k = min(DIMENSIONS, width)
    centred = known - known.mean(0)
    rotation = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(2), width) @ rotation
                lengths = pa.array([len(v) // 8 for v in batch.column(2).to_pylist()], pa.int64())
                cells = np.floor(x[:, :k] / max(epsilon, 1e-3)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([r.astype("<f8").tobytes() for r in x], pa.binary()), pa.array(cells.tolist(), pa.list_(pa.int64())), pa.array(x[:, :k].tolist(), pa.list_(pa.float64())), lengths],
                    ["id", "weight", "rotated", "cell", "lead", "length"],
                )

    order = ["cell", "id"]
    placed = units.select("id", "weight", "class").mapInArrow(rotate, "id long, weight long, rotated binary, cell array<long>, lead array<double>, length long")
    # the grid order, cut into chunks: ranges by sampling, and consecutive rows in each
    ordered = placed.repartitionByRange(max(1, stats["n"] // (8 * CHUNK)), *order).sortWithinPartitions(*order)
    numbered = ordered.withColumn("n", F.monotonically_increasing_id())
    numbered = numbered.withColumns({"chunk": F.floor(F.col("n") / CHUNK).cast("long"), "rank": F.col("n")}).drop("n", "cell")
    numbered = materialize(numbered, "ordered")
    ends = [f(F.col("lead")[d]).alias(f"{n}{d}") for d in range(k) for n, f in (("lo", F.min), ("hi", F.max))]
    boxes = materialize(numbered.groupBy("chunk").agg(*ends), "boxes")
    # chunks within epsilon in the first dimension share a slab of the grid there
    slabs = F.sequence(F.floor(F.col("lo0") / max(epsilon, 1e-3)), F.floor((F.col("hi0") + epsilon + SLACK) / max(epsilon, 1e-3)))
    spread = boxes.withColumn("slab", F.explode(slabs))
    x, y = spread.alias("x"), spread.alias("y")
    gaps = [F.greatest(F.lit(0.0), F.col(f"x.lo{d}") - F.col(f"y.hi{d}"), F.col(f"y.lo{d}") - F.col(f"x.hi{d}")) for d in range(k)]
    near = sum((g * g for g in gaps), F.lit(0.0)) <= (epsilon + SLACK) ** 2
    pairs = x.join(y, (F.col("x.slab") == F.col("y.slab")) & (F.col("x.chunk") <= F.col("y.chunk")) & near)
    pairs = pairs.select(F.col("x.chunk").alias("first"), F.col("y.chunk").alias("second")).distinct()
    pairs = materialize(pairs, "pairs")
    wanted = pairs.select("first", "second", F.explode(F.array_distinct(F.array("first", "second"))).alias("chunk"))
    sent = numbered.select("chunk", "rank", "id", "weight", "rotated", "length").join(wanted, "chunk")
    found = sent.groupBy("first", "second").applyInArrow(_compare(k, width, epsilon, cosine), "a long, b long, gained long")
    found = materialize(found, "found")
    gained = found.where("gained > 0").groupBy(F.col("a").alias("id")).agg(F.sum("gained").alias("gained"))
    nodes = with_components(units.select("id", "least", "weight"), found.where("b IS NOT NULL").select("a", "b"), "id", "least")
    nodes = nodes.join(gained, "id", "left")
    known_ids = nodes.select("id", "component_id", (F.coalesce("gained", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.withColumn("id", F.when(F.col("class").isNotNull(), _id(seed))).drop("class").join(known_ids, "id", "left")
    lone = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), lone.alias("component_id"), (F.col("vec_id") == lone).alias("kept"))
