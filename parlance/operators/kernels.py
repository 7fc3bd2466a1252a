"""Kernels over matrices of at most a few thousand rows: clustering, maps, orders and decompositions.

They take numpy arrays, with NaN for what was never observed. DataFrames reduce the data to such a matrix first;
``MAX_SIDE`` guards what may be gathered.
"""

from __future__ import annotations

import functools
import math
from itertools import combinations

import numpy as np

MAX_SIDE = 4000


def average_linkage(distance: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (a, b, height) of average linkage; clusters are numbered on from the points, the lowest pair wins ties."""
    n = len(distance)
    d = np.where(np.isnan(distance), 2.0, distance).astype(float)
    np.fill_diagonal(d, np.inf)
    name, size, merges = list(range(n)), np.ones(n), []
    for step in range(n - 1):
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        merges.append((min(name[i], name[j]), max(name[i], name[j]), float(d[i, j])))
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        name[i] = n + step
    return merges


def cut(merges: list[tuple[int, int, float]], n: int, height: float) -> np.ndarray:
    """Labels of the clusters below ``height``: the largest cluster is 0; ties by the first member."""
    parent = list(range(2 * n))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, b, h) in enumerate(merges):
        if h <= height + 1e-12:
            parent[find(a)] = parent[find(b)] = n + k
    roots = [find(i) for i in range(n)]
    order = sorted(set(roots), key=lambda r: (-roots.count(r), roots.index(r)))
    return np.array([order.index(r) for r in roots])


def weighted_correlation(r: np.ndarray, common: np.ndarray, full: int = 50) -> np.ndarray:
    return r * np.clip(common / full, 0, 1)


def cluster_by_correlation(r: np.ndarray, threshold: float = 0.5) -> np.ndarray:
    return cut(average_linkage(1 - r), len(r), 1 - threshold)


def weighted_mds(distance: np.ndarray, weights: np.ndarray, dimensions: int = 2, steps: int = 500, tolerance: float = 1e-9) -> tuple[np.ndarray, float]:
    """Coordinates by stress majorisation from a classical start, and stress-1; unknown distances have no weight."""
    n = len(distance)
    if n < 3:
        return np.zeros((n, dimensions)), 0.0
    w = np.where(np.isnan(distance), 0.0, weights).astype(float)
    np.fill_diagonal(w, 0.0)
    known = w > 0
    d = np.where(known, np.nan_to_num(distance), 0.0)
    start = np.where(known, d, d[known].mean() if known.any() else 0.0)
    np.fill_diagonal(start, 0.0)
    centre = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * centre @ (start**2) @ centre)
    x = vectors[:, ::-1][:, :dimensions] * np.sqrt(np.maximum(values[::-1][:dimensions], 0))
    inverse = np.linalg.pinv(np.diag(w.sum(1)) - w)
    last = math.inf
    for _ in range(steps):
        gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        stress = float((w * (d - gap) ** 2).sum() / 2)
        if last - stress < tolerance:
            break
        last = stress
        ratio = np.divide(w * d, gap, out=np.zeros_like(gap), where=gap > 1e-12)
        x = inverse @ ((np.diag(ratio.sum(1)) - ratio) @ x)
    x = x - x.mean(0)
    x = x @ np.linalg.svd(x, full_matrices=False)[2].T
    x *= np.where(x[np.abs(x).argmax(0), np.arange(x.shape[1])] < 0, -1, 1)
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    return x, math.sqrt(float((w * (d - gap) ** 2).sum()) / max(1e-12, float((w * d**2).sum())))


def optimal_leaf_order(merges: list[tuple[int, int, float]], distance: np.ndarray) -> list[int]:
    """Leaves in the order of the tree that has the least sum of neighbours' distances.

    best[t][a, b] is the least cost of subtree t from leaf a at one end to leaf b at the other.
    """
    n = len(distance)
    d = np.where(np.isnan(distance), 2.0, distance)
    if n < 2:
        return list(range(n))
    leaves: dict[int, list[int]] = {i: [i] for i in range(n)}
    best: dict[int, dict[tuple[int, int], tuple[float, int, int]]] = {i: {(i, i): (0.0, i, i)} for i in range(n)}
    children = {}

    def ends(t: int) -> dict[int, list[tuple[int, float]]]:
        out: dict[int, list[tuple[int, float]]] = {}
        for (a, b), (cost, *_) in best[t].items():
            out.setdefault(a, []).append((b, cost))
        return {a: sorted(v, key=lambda x: x[1]) for a, v in out.items()}

    for k, (x, y, _) in enumerate(merges):
        t = n + k
        leaves[t], children[t], best[t] = leaves[x] + leaves[y], (x, y), {}
        left, right = ends(x), ends(y)
        for a, inner_a in left.items():
            for b, inner_b in right.items():
                choice = min(((ca + d[m, p] + cb, m, p) for m, ca in inner_a for p, cb in inner_b), key=lambda c: c[0])
                best[t][a, b] = choice
                best[t][b, a] = (choice[0], choice[2], choice[1])

    def unroll(t: int, a: int, b: int) -> list[int]:
        if t < n:
            return [t]
        x, y = children[t]
        _, m, p = best[t][a, b]
        return unroll(x, a, m) + unroll(y, p, b) if a in leaves[x] else unroll(y, a, m) + unroll(x, p, b)

    top = n + len(merges) - 1
    a, b = min(best[top], key=lambda e: (best[top][e][0], e))
    return unroll(top, a, b)


def density_clusters(close: np.ndarray, least: int = 2) -> np.ndarray:
    """DBSCAN labels from a boolean neighbourhood matrix (a point neighbours itself); -1 is noise."""
    n = len(close)
    close = close | np.eye(n, dtype=bool)
    core = close.sum(1) >= least
    label = np.full(n, -1)
    k = 0
    for i in range(n):
        if core[i] and label[i] < 0:
            work = [i]
            label[i] = k
            while work:
                x = work.pop()
                if core[x]:
                    for y in np.flatnonzero(close[x] & (label < 0)):
                        label[y] = k
                        work.append(int(y))
            k += 1
    return label


def axis_correlates(matrix: np.ndarray, coordinates: np.ndarray, support: int = 10) -> list[tuple[int, int, float, int]]:
    """(axis, column, r, n) of each column's correlation with each axis, strongest first by significance."""
    out = []
    for axis, column in ((a, c) for a in range(coordinates.shape[1]) for c in range(matrix.shape[1])):
        seen = ~np.isnan(matrix[:, column])
        n = int(seen.sum())
        if n >= support:
            x, y = matrix[seen, column], coordinates[seen, axis]
            if x.std() > 1e-9 and y.std() > 1e-9:
                out.append((axis, column, float(np.corrcoef(x, y)[0, 1]), n))
    strength = lambda t: abs(math.atanh(max(-0.999999, min(0.999999, t[2])))) * math.sqrt(max(1, t[3] - 3))
    return sorted(out, key=lambda t: (t[0], -strength(t), t[1]))


def svd_map(matrix: np.ndarray, dimensions: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates, loadings and shares of variance of a matrix centred by its columns' observed means."""
    means = np.where(np.isnan(matrix).all(0), 0.0, np.nanmean(np.where(np.isnan(matrix).all(0), 0.0, matrix), axis=0))
    centred = np.where(np.isnan(matrix), 0.0, matrix - means)
    u, s, v = np.linalg.svd(centred, full_matrices=False)
    total = float((s**2).sum()) or 1.0
    return (u * s)[:, :dimensions], v[:dimensions].T, (s**2 / total)[:dimensions]


def silhouette(distance: np.ndarray, labels: np.ndarray) -> float:
    names = sorted(set(labels.tolist()))
    if len(names) < 2:
        return 0.0
    out = []
    for i in range(len(labels)):
        mean = {k: distance[i, (labels == k) & (np.arange(len(labels)) != i)] for k in names}
        own = mean[labels[i]]
        if not len(own):
            out.append(0.0)
            continue
        a, b = float(own.mean()), min(float(v.mean()) for k, v in mean.items() if k != labels[i] and len(v))
        out.append((b - a) / max(a, b, 1e-12))
    return float(np.mean(out))


def normal_cdf(z: float) -> float:
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def two_tailed(value: float, mean: float, deviation: float) -> float:
    return 2 * (1 - normal_cdf(abs(value - mean) / (deviation or 1.0)))


def fisher(p_values: list[float]) -> float:
    """Combined p of independent tests: the even-df chi-square tail in closed form."""
    x, term, total = -sum(math.log(max(p, 1e-300)) for p in p_values), 1.0, 1.0
    for k in range(1, len(p_values)):
        term *= x / k
        total += term
    return min(1.0, math.exp(-x) * total) if p_values else 1.0


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + top * d), 1 + top / c
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


@functools.cache
def t_quantile(p: float, df: int) -> float:
    """Student's t: bisection on its distribution."""
    cdf = lambda t: 1 - 0.5 * _incomplete_beta(df / 2, 0.5, df / (df + t * t)) if t >= 0 else 0.5 * _incomplete_beta(df / 2, 0.5, df / (df + t * t))
    lo, hi = -1e3, 1e3
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def _lag_table(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """r of ``x`` with every row of ``y`` at each lag; NaN where fewer than five points are common or a side is flat."""
    out = np.full((2 * most + 1, len(y)), np.nan)
    n = len(x)
    for k, lag in enumerate(range(-most, most + 1)):
        p, q = (x[: n - lag], y[:, lag:]) if lag >= 0 else (x[-lag:], y[:, : n + lag])
        ok = (~np.isnan(p) & ~np.isnan(q)).astype(float)
        count = ok.sum(1)
        size = np.maximum(count, 1)
        p, q = np.nan_to_num(p) * ok, np.nan_to_num(q) * ok
        p, q = (p - p.sum(1, keepdims=True) / size[:, None]) * ok, (q - q.sum(1, keepdims=True) / size[:, None]) * ok
        spread = np.sqrt((p * p).sum(1) * (q * q).sum(1))
        fit = (count >= 5) & (spread > 1e-12)
        out[k, fit] = ((p * q).sum(1)[fit]) / spread[fit]
    return out


def lagged_correlation(a: np.ndarray, b: np.ndarray, most: int = 4, permutations: int = 1000, seed: int = 0) -> tuple[int, float, float] | None:
    """(lag, r, p) of the changes of two aligned series; positive: a is ahead. None below five common changes.

    p counts shuffles of b's changes whose best r is as large; of equal ones the first lag is best.
    """
    x, y = np.diff(a), np.diff(b)
    own = _lag_table(x, y[None], most)[:, 0]
    if np.isnan(own).all():
        return None
    k = int(np.nanargmax(np.abs(own)))
    rng = np.random.default_rng(seed)
    shuffled = _lag_table(x, np.stack([rng.permutation(y) for _ in range(permutations)]), most) if permutations else np.zeros((1, 0))
    exceed = int((np.nan_to_num(np.abs(shuffled)).max(0) >= abs(own[k]) - 1e-12).sum())
    return k - most, float(own[k]), (exceed + 1) / (permutations + 1)


def adjacency_cost(order: list[int], distance: np.ndarray) -> float:
    return float(sum(distance[a, b] for a, b in zip(order, order[1:], strict=False)))


def topics(together: np.ndarray, counts: np.ndarray, names: list[str], types: list[str], reach: float = 0.7, least: int = 3) -> list[dict]:
    """Clusters of entities that share articles, with coherence and a name from two key entities."""
    share = together / np.maximum(1.0, np.minimum.outer(counts, counts))
    label = density_clusters(1 - share <= reach, least)
    rank = {"person": 0, "organization": 1, "country": 2}
    out = []
    for k in range(label.max() + 1 if len(label) else 0):
        members = np.flatnonzero(label == k).tolist()
        pairs = [share[i, j] for i, j in combinations(members, 2)]
        key = sorted(members, key=lambda i: (rank.get(types[i], 3), -counts[i], i))[:2]
        out.append({"topic": k, "members": members, "coherence": float(np.mean(pairs)) if pairs else 0.0, "name": " & ".join(names[i] for i in key)})
    return out
