import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from parlance.llm import merkle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    fields = [str(x) if x is not None else None for x in (*row[:4], text)]
    return digest("".join("-" if x is None else f"{len(x.encode())}:{x}" for x in fields))


def climb(hashes):
    """The top of a list of hashes, and each one's (left, right) siblings level by level."""
    beside = [[] for _ in hashes]
    at = list(range(len(hashes)))
    while len(hashes) > 1:
        runs = [hashes[i : i + 3] for i in range(0, len(hashes), 3)]
        for k, i in enumerate(at):
            run = runs[i // 3]
            beside[k].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        hashes, at = [digest("".join(r)) for r in runs], [i // 3 for i in at]
    return hashes[0], beside


def slow(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    done = []
    for s in order:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        done.append((own, *climb([leaf(r, r[4]) for r in own])))
    root, above = climb([top for _, top, _ in done])
    out = []
    for (own, top, beside), up in zip(done, above, strict=True):
        for r, path in zip(own, beside, strict=True):
            path = path + up
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            h = leaf(r, r[4].replace("\n", "") if hit and r[4] is not None else r[4])
            for a, b in path:
                h = digest(a + h + b)
            out.append((r[0], leaf(r, r[4]), top, root, digest("".join(a + b for a, b in path)), h, h == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def audit(docs):
    return sorted((tuple(r) for r in merkle.tamper_audit(docs).collect()), key=repr)


@pytest.mark.parametrize("depth", [1, 4])
def test_against_brute_force(spark, monkeypatch, depth):
    # blocks of 3 take many rounds
    monkeypatch.setattr(merkle, "DEPTH", depth)
    monkeypatch.setattr(merkle, "WIDTH", 3**depth)
    rows = [(i, "abcdefgh"[i % 8] if i % 3 else "big", "en", i, f"text {i}\nline\n") for i in range(120)]
    rows += [(None, "big", None, None, None), (None, None, "en", 1, "a\n"), (7, None, "", 0, ""), (500, "é", "x", 3, "one\nä\n"), (501, "", "x", 3, "no line"), (502, "one leaf", None, 5, "\n\n")]
    rows += [(3, "big", "en", 3, "another text\n"), (3, "big", "en", 3, "another text\n"), (-5, "big", "en", 3, "z" * 300_000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", leaf string, grp int").repartition(5)
    assert audit(docs) == slow(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 81, 82])
def test_sizes(spark, n):
    rows = [(i, "s", None, i, f"{i}\n") for i in range(n)]
    assert audit(spark.createDataFrame(rows, SCHEMA)) == (slow(rows) if n else [])


def test_stored_tree_proves_leaves(spark):
    rows = [(i, "ab"[i % 2], "en", i, f"text {i}") for i in range(100)]
    found = merkle.manifest(spark.createDataFrame(rows, SCHEMA), carry={"doc_id": F.col("doc_id")})
    nodes = {(r.grp, r.level, r.position): r for r in found.nodes().collect()}
    assert len(nodes) == 2 * (17 + 6 + 2 + 1) + 1
    assert all(digest(r.preimage) == r.hash for r in nodes.values())
    root = nodes["", 1, 0]
    assert root.preimage == nodes["1a", 4, 0].hash + nodes["1b", 4, 0].hash
    # any leaf folds to the root, and another one in its place does not
    good = found.proofs.select((merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok"), (merkle.fold(F.sha2("leaf", 256), F.col("path")) == F.col("root")).alias("bad"), "root")
    assert {tuple(r) for r in good.collect()} == {(True, False, root.hash)}
