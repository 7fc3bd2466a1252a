import numpy as np

from parlance.operators import tracking


def plain(groups):
    """groups: {interval: [set, ...]} with clusters named by their smallest member."""
    jac = lambda a, b: round(len(a & b) / len(a | b), 12)
    first, out = {}, {}
    for t in sorted(groups):
        for c in groups[t]:
            before = [p for p in groups.get(t - 1, []) if p & c]
            after = [n for n in groups.get(t + 1, []) if n & c]
            came = None
            if before:
                p = max(before, key=lambda p: (jac(p, c), -min(p)))
                if max((n for n in groups[t] if n & p), key=lambda n: (jac(p, n), -min(n))) == c:
                    came = p
            first[t, min(c)] = first[t - 1, min(came)] if came else f"{t}/{min(c)}"
            out[t, min(c)] = (len(c), first[t, min(c)], "continued" if came else "birth", len(before), len(after), len(came & c) if came else 0)
    return out


def check(spark, groups):
    rows = [(t, e, min(c)) for t, cs in groups.items() for c in cs for e in c]
    found = tracking.tracks(spark.createDataFrame(rows, "interval long, entity_id long, cluster long"))
    got = {(r["interval"], r["cluster"]): (r["members"], r["track"], r["event"], r["from_clusters"], r["to_clusters"], r["kept"]) for r in found.collect()}
    assert got == plain(groups)
    return found


def test_splits_merges_births_and_deaths(spark):
    groups = {
        0: [{1, 2, 3, 4}, {10, 11}, {20, 21, 22}],
        1: [{1, 2}, {3, 4}, {10, 11, 20, 21, 22}],  # a split with a tie, a merge
        2: [{3, 4, 5}, {30, 31}],
        4: [{3, 4, 5}],  # after an interval without clusters
    }
    lives = {r["track"]: r for r in tracking.track_lives(check(spark, groups)).collect()}
    assert set(lives) == {"0/1", "0/10", "0/20", "1/3", "2/30", "4/3"}
    assert (lives["0/1"]["died"], lives["0/1"]["splits"]) == (2, 1) and lives["0/20"]["merges"] == 1 and lives["4/3"]["died"] is None
    assert lives["1/3"]["intervals"] == 2 and lives["1/3"]["most"] == 3


def test_random_histories(spark):
    rng = np.random.default_rng(1)
    groups = {}
    labels = rng.integers(0, 6, 40)
    for t in range(8):
        labels = np.where(rng.random(40) < 0.25, rng.integers(0, 8, 40), labels)
        groups[t] = [s for k in range(8) if len(s := set(np.flatnonzero(labels == k).tolist())) > 1]
    check(spark, groups)


def test_interval_clusters_against_plain_cosines(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(3000):
        day, e, s = int(rng.integers(0, 95)), int(rng.integers(0, 12)), int(rng.integers(0, 8))
        base = np.sin(s * (1 + e % 3) + day // 30)
        rows.append((f"2024-01-{1 + day:02d}" if day < 31 else None, day, e, s, float(base + 0.3 * rng.normal()), None if rng.random() < 0.05 else float(base)))
    import datetime

    rows = [(datetime.date(2024, 1, 1) + datetime.timedelta(d), e, s, p, m) for _, d, e, s, p, m in rows]
    found = tracking.interval_clusters(spark.createDataFrame(rows, "publish_date date, entity_id long, source_id long, power double, moral double"), "2024-01-01", "2024-03-31", 30, 0.8)
    want = set()
    for t in range(3):
        cells = {}
        for d, e, s, p, m in rows:
            if (d - datetime.date(2024, 1, 1)).days // 30 == t and m is not None:
                cells.setdefault((e, s), []).append((p + m) / 2)
        v = np.zeros((12, 8))
        for (e, s), x in cells.items():
            v[e, s] = np.mean(x)
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        near = (u @ u.T) >= 0.8
        reach = np.linalg.matrix_power((near | np.eye(12, dtype=bool)).astype(int), 12) > 0
        want |= {(t, e, int(np.flatnonzero(reach[e])[0])) for e in range(12) if reach[e].sum() > 1}
    assert {tuple(r) for r in found.collect()} == want
