"""Multidimensional scaling over rows of pairs.

Pairs stay rows of a written table; what every round needs of the points, their coordinates, is broadcast, as many as
``MAX_POINTS`` allows. A round is one pass over the pairs: partial sums where they are, added up by point. The driver
holds vectors of a number a point, like the coefficients of a regression, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Most points: their coordinates are 4 MB to broadcast, the start's vectors 84 MB on the driver.
MAX_POINTS = 1 << 18
#: Steps of the start's Lanczos iteration, remembered steps of the descent, and passes over the pairs it may take.
START, MEMORY, PASSES = 40, 12, 400


class _Pairs:
    """Pairs (i, j, d, w) of numbered points, and sums over them."""

    def __init__(self, rows: DataFrame, n: int):
        self.rows, self.n, self.spark = rows.persist(), n, rows.sparkSession

    def sums(self, of: Callable, x: np.ndarray) -> tuple[np.ndarray, float]:
        """The sum by point of what ``of`` (x_i, x_j, d, w) says a pair adds to i and to j, and the total of its third value."""
        n, width, shared = self.n, x.shape[1], self.spark.sparkContext.broadcast(x)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, by_point, total, seen = shared.value, np.zeros((n, width)), 0.0, np.zeros(n, bool)
            for batch in batches:
                i, j, d, w = (batch.column(k).to_numpy() for k in range(4))
                to_i, to_j, value = of(at[i], at[j], d, w)
                seen[i] = seen[j] = True
                total += float(value.sum())
                for k in range(width):
                    by_point[:, k] += np.bincount(i, to_i[:, k], n) + np.bincount(j, to_j[:, k], n)
            points = np.flatnonzero(seen)
            columns = [np.append(points, -1), *(np.append(by_point[points, k], total) for k in range(width))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", *(f"s{k}" for k in range(width))])

        names = [f"s{k}" for k in range(width)]
        parts = self.rows.mapInArrow(partial, "i long, " + ", ".join(f"{c} double" for c in names))
        found = parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in names)).toArrow()  # a row a point
        shared.destroy()
        i, s = found.column("i").to_numpy(), np.stack([found.column(c).to_numpy() for c in names], 1)
        out = np.zeros((n, width))
        out[i[i >= 0]] = s[i >= 0]
        return out, float(s[i < 0][0, 0]) if (i < 0).any() else 0.0


def _classical(pairs: _Pairs, typical: float, dimensions: int) -> np.ndarray:
    """Classical scaling of the squared distances, unknown ones being ``typical``, by Lanczos iteration.

    Centred, the matrix is half of typical ** 2 on the diagonal less half of what the known pairs differ from it.
    """
    n = pairs.n

    def product(v: np.ndarray) -> np.ndarray:
        def of(a, b, d, w):
            s = np.where(w > 0, d**2 - typical**2, 0.0)[:, None]
            return s * b, s * a, s[:, 0]

        v = v - v.mean()
        out = typical**2 / 2 * v - pairs.sums(of, v[:, None])[0][:, 0] / 2
        return out - out.mean()

    v = np.random.default_rng(0).standard_normal(n)
    v -= v.mean()
    basis, diagonal, beside = [v / np.linalg.norm(v)], [], []
    for _ in range(min(START, n - 1)):
        u = product(basis[-1])
        diagonal.append(float(u @ basis[-1]))
        for _ in range(2):
            for b in basis:
                u -= (u @ b) * b
        size = float(np.linalg.norm(u))
        values, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1))
        top = slice(None, -dimensions - 1, -1)
        if size < 1e-12 or len(diagonal) >= dimensions and np.all(size * np.abs(vectors[-1, top]) < 1e-6 * max(1e-12, values[-1])):
            break
        beside.append(size)
        basis.append(u / size)
    x = np.stack(basis[: len(diagonal)], 1) @ vectors[:, top] * np.sqrt(np.maximum(values[top], 0))
    return np.pad(x, ((0, 0), (0, dimensions - x.shape[1])))


def _pull(a, b, d, w):
    """The gradient of w (d - |a - b|) ** 2 in a and in b, and its value; points in one place do not pull."""
    line = a - b
    gap = np.sqrt((line**2).sum(1))
    g = (2 * w * (1 - np.divide(d, gap, out=np.ones_like(gap), where=gap > 1e-12)))[:, None] * line
    return g, -g, w * (d - gap) ** 2


def _descend(pairs: _Pairs, x: np.ndarray, weight: np.ndarray, scale: float, tolerance: float) -> tuple[np.ndarray, float]:
    """The least stress from ``x``: steps of a majorisation by each point's own weight, sped up by limited-memory BFGS.

    Such a step, the gradient over 4 times the point's weights, never raises the stress. It stops when two steps in a row
    lower the stress by less than ``tolerance`` of the weighted squares of the distances.
    """
    own = 1 / np.maximum(4 * weight, 1e-12)[:, None]
    g, f = pairs.sums(_pull, x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    passes, small = 1, 0
    while passes < PASSES and small < 2:
        q, kept = g.copy(), []
        for s, y in reversed(steps):
            a = (s * q).sum() / (s * y).sum()
            q -= a * y
            kept.append(a)
        if steps:
            s, y = steps[-1]
            q *= own * ((s * y).sum() / (y * own * y).sum())
        else:
            q *= own
        for (s, y), a in zip(steps, reversed(kept), strict=True):
            q += s * (a - (y * q).sum() / (s * y).sum())
        for t in (1.0, 0.4, 0.1, 0.0):  # at last without what is remembered
            new = x - (t * q if t else own * g)
            new_g, new_f = pairs.sums(_pull, new)
            passes += 1
            if new_f <= f - 1e-4 * t * (g * q).sum():
                break
        if new_f > f:  # rounding alone is left
            break
        if not t:
            steps = []
        small = small + 1 if f - new_f < tolerance * scale else 0
        if ((new - x) * (new_g - g)).sum() > 1e-14 * scale:
            steps = [*steps[1 - MEMORY :], (new - x, new_g - g)]
        x, g, f = new, new_g, new_f
    return x, f


def stress_map(pairs: DataFrame, items: DataFrame, dimensions: int = 2, tolerance: float = 1e-10) -> DataFrame:
    """(item, x0, x1, .., stress) of least stress from a classical start: ``pairs`` (a, b, d, w) once each, ``items`` (item).

    Pairs with d null or w 0 are unknown and have no weight. Positions are centred, on their principal axes, each with its
    farthest item on the positive side; stress is the root of the weighted squared errors over the weighted squares. Fewer
    than three items, or none with a known pair, lie in one place. More than ``MAX_POINTS`` items raise.
    """
    n = items.count()
    if n > MAX_POINTS:
        raise ValueError(f"{n} items on one map; at most {MAX_POINTS}")
    spark = items.sparkSession
    names = np.sort(items.toArrow().column("item").to_numpy())
    x, stress = np.zeros((n, dimensions)), 0.0
    if n >= 3:
        places = spark.createDataFrame(pa.table({"item": names, "i": np.arange(n)}))
        numbered = pairs.where("d IS NOT NULL AND w > 0").join(places.toDF("a", "i"), "a").join(places.toDF("b", "j"), "b")
        rows = materialize(numbered.select("i", "j", F.col("d").cast("double").alias("d"), F.col("w").cast("double").alias("w")), "map_pairs")
        typical, scale = rows.agg(F.avg("d"), F.sum(F.col("w") * F.col("d") * F.col("d"))).first()
        if typical:
            own = _Pairs(rows, n)
            weight = own.sums(lambda a, b, d, w: (w[:, None], w[:, None], w), np.zeros((n, 1)))[0][:, 0]
            x, error = _descend(own, _classical(own, typical, dimensions), weight, scale, tolerance)
            own.rows.unpersist()
            stress = math.sqrt(error / max(1e-12, scale))
            x = x - x.mean(0)
            x = x @ np.linalg.eigh(x.T @ x)[1][:, ::-1]
            x *= np.where(x[np.abs(x).argmax(0), np.arange(dimensions)] < 0, -1, 1)
    return spark.createDataFrame(pa.table({"item": names, **{f"x{k}": x[:, k] for k in range(dimensions)}, "stress": np.full(n, stress)}))
