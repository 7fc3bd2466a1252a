import itertools

import numpy as np
import pytest
import xxhash

from parlance.llm import common, embedding_dedup, simhash


def components(n, links):
    label = list(range(n))
    for _ in range(n):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_connected_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 200)] + [(7, 7)]
    found = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = sorted({x for e in links if e[0] != e[1] for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    label = components(len(nodes), [(at[a], at[b]) for a, b in links if a != b])
    assert found == {x: nodes[label[at[x]]] for x in nodes}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_fingerprint(text):
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("tile", [4, 2048])
def test_simhash_against_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(50)]
    base = [" ".join(rng.choice(words, 120)) for _ in range(8)]
    texts = [None, "", " \n", "One two", "one TWO", "É a b c d"]
    for b in base:
        for _ in range(8):
            w = b.split()
            for _ in range(rng.integers(0, 3)):
                w[rng.integers(0, len(w))] = "changed"
            texts.append(" ".join(w))
    rows = [(int(i) * 3 % 101, t, "x") for i, t in enumerate(texts)] + [(0, texts[10], "x")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")).collect()
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4]
    label = components(len(rows), links)
    least = {}
    for i, k in enumerate(label):
        least[k] = min(least.get(k, 1 << 60), rows[i][0])
    assert sorted(tuple(r) for r in out) == sorted((rows[i][0], f"{fps[i]:016x}", least[label[i]]) for i in range(len(rows)))


def test_simhash_near_pairs_at_the_limit(spark):
    """What pairs at up to 4 bits connect is connected, and nothing more; the links are those of a forest."""
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(60):
        x = int(rng.integers(0, 1 << 63))
        bits = rng.choice(64, 5, replace=False)
        near = x ^ sum(1 << int(b) for b in bits[:4])
        rows += [x, near, x ^ sum(1 << int(b) for b in bits)]
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in dict.fromkeys(rows)]
    found = {frozenset((r["a"] % (1 << 64), r["b"] % (1 << 64))) for r in simhash.links(spark.createDataFrame(signed, "fp long")).collect()}
    values = [s[0] % (1 << 64) for s in signed]
    at = {v: i for i, v in enumerate(values)}
    true = [(i, j) for i, j in itertools.combinations(range(len(values)), 2) if (values[i] ^ values[j]).bit_count() <= 4]
    assert components(len(values), true) == components(len(values), [tuple(at[x] for x in p) for p in found])


def test_pivots_form_fewer_pairs(spark):
    rng = np.random.default_rng(8)
    keys = np.sort(rng.integers(0, 9, 3000))
    fps = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    fps[::3] = fps[1::3] ^ np.uint64(0b1011)
    a, b, formed = simhash.sweep(keys, fps, simhash.pivots(), 4)
    pairs = [(i, j) for k in range(9) for i, j in itertools.combinations(np.flatnonzero(keys == k).tolist(), 2)]
    true = [(i, j) for i, j in pairs if int(fps[i] ^ fps[j]).bit_count() <= 4]
    at = {int(v): i for i, v in enumerate(fps)}
    assert components(3000, true) == components(3000, [(at[int(x)], at[int(y)]) for x, y in zip(a, b, strict=True)])
    # two rows of random bits are within 4 of each other in a coordinate in 57 % of all pairs
    assert len(true) < formed < 0.57 * len(pairs)


def test_no_documents(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("chunk,small", [(2048, 256), (16, 4)])
def test_embeddings_against_brute_force(spark, chunk, small, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    monkeypatch.setattr(embedding_dedup, "SMALL", small)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([c + 0.25 * rng.normal(size=(12, 16)) for c in centres] + [rng.normal(size=(40, 16))])
    vectors = [v.tolist() for v in x] + [x[0].tolist()] * 5 + [(2 * x[1]).tolist(), None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] * 16]
    vectors += [[1.0] * 8, [3.0] * 8, [1.0] * 8 + [0.0] * 8, [5.0], [-5.0], [2.0]]
    ids = [int(i) for i in rng.permutation(len(vectors))]
    table = spark.createDataFrame(list(zip(ids, vectors, [1] * len(ids), strict=True)), "vec_id long, embedding array<double>, kept int")
    out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(table).collect()}
    valid = [i for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and any(v)]
    unit = {i: np.array(vectors[i]) / np.linalg.norm(vectors[i]) for i in valid}
    links = [(i, j) for i, j in itertools.combinations(valid, 2) if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95]
    label = components(len(vectors), links)
    least = {}
    for i, k in enumerate(label):
        least[k] = min(least.get(k, 1 << 60), ids[i])
    degree = [sum(i in p for p in links) for i in range(len(vectors))]
    assert out == {ids[i]: (degree[i], least[label[i]], ids[i] == least[label[i]]) for i in range(len(vectors))}


def test_no_embeddings(spark):
    schema = "vec_id long, embedding array<float>"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame([(3, None)], schema)).collect()] == [(3, 0, 3, True)]
