import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from parlance.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text, order):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]


def slow(rows, target, buckets=10_000, order=1, percent=10, least=20, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in features(t, order)[1])
    t = Counter(bucket(f) for x in target for f in features(x, order)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (sum(s.values()) + float(buckets)) / ((s[b] + 1.0) * (sum(t.values()) + float(buckets)))))
    out = []
    for i, text in rows:
        n, found = features(text, order)
        weight = sum(gain(bucket(f)) for f in found) // max(1, len(found))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able):
        r.append(k + 1 if k < len(able) * percent // 100 else None)
    return sorted((tuple([*r[:4], r[5] if len(r) > 5 else None]) for r in out), key=repr)


def ours(spark, rows, target, **more):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, `Weight` int, rank string").repartition(5)
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    return sorted((tuple(r) for r in importance.resample(docs, items, **more).collect()), key=repr)


ODD = [None, "", "!?", "one", "Ünïcode ÄÖ straße 日本語 x1y2", "a" * 5000, "A-b_c.d,e\nF\x00g\x7fh", "w " * 3000]


@pytest.mark.parametrize("order,percent,buckets", [(1, 10, 10_000), (3, 50, 97), (2, 100, 65_536)])
def test_against_brute_force(spark, order, percent, buckets):
    rng = np.random.default_rng(order)
    words = [f"word{i}" for i in range(60)] + ["The", "naïve", "of", "42"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(200)] + ODD
    rows = list(enumerate(texts)) + [(5, texts[5]), (5, "another text under this number " * 9), (None, "no number " * 20), (None, "no number " * 20)]
    target = [" ".join(rng.choice(words[:15], 30)) for _ in range(10)] + [None, ""]
    assert ours(spark, rows, target, order=order, percent=percent, buckets=buckets) == slow(rows, target, buckets, order, percent)


def test_empty_sides(spark):
    rows = [(i, "some words of a text " * 6) for i in range(30)]
    assert ours(spark, rows, []) == slow(rows, [])
    assert ours(spark, [], ["a b"]) == []
    assert ours(spark, [(1, None)], [None]) == slow([(1, None)], [None])
    with pytest.raises(ValueError):
        ours(spark, rows, [], buckets=70_000)


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(importance, "PIECE", 50)
    rng = np.random.default_rng(1)
    for order in (1, 3):
        text = "".join(rng.choice(list("abc  ,.é\n-"), 3000)) + "z" * 200 + " end"
        parts = list(importance._features(text.encode(), order))
        n, found = features(text, order)
        assert sum(k for k, _ in parts) == n and Counter(f.decode() for _, p in parts for f in p) == Counter(found)


def test_the_draw_leans_to_the_target(spark):
    rng = np.random.default_rng(2)
    plain, wanted = [f"p{i}" for i in range(50)], [f"t{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choice(wanted if i % 5 == 0 else plain, 30))) for i in range(500)]
    drawn = [r[0] for r in ours(spark, rows, [" ".join(wanted)] * 20) if r[4]]
    assert len(drawn) == 50 and np.mean([i % 5 == 0 for i in drawn]) > 0.95


def test_memory_of_features_is_bounded(monkeypatch):
    monkeypatch.setattr(importance, "REMEMBERED", 3)
    of = importance._Buckets(97)
    assert [of[str(i).encode()] for i in range(20)] == [zlib.crc32(str(i).encode()) % 97 for i in range(20)] and len(of) <= 3
    assert importance.gains(np.array([1, 0]), np.array([0, 3])).tolist() == [math.floor(1000 * math.log(3 / 10)), math.floor(1000 * math.log(12 / 5))]
