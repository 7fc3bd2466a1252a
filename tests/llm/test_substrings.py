import hashlib

import numpy as np
import pytest

from parlance.llm import substrings


def slow(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    earliest = {}
    for i, b in texts:
        for j in range(len(b) - length + 1):
            w = b[j : j + length]
            earliest[w] = min(earliest.get(w, i), i)
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if earliest[b[j : j + length]] < i:
                gone[j : j + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length,hot", [(16, False), (50, False), (16, True), (50, True)])
def test_against_brute_force(spark, length, hot, monkeypatch):
    if hot:  # most triggers are dealt as hot ones
        monkeypatch.setattr(substrings, "HOT_LEAST", 2)
        monkeypatch.setattr(substrings, "HOT_SHARE", 0)
    rng = np.random.default_rng(length)
    words = ["the", "of", "naïve", "straße", "x", "language", "and", "is", "\n"]
    passages = [" ".join(rng.choice(words, n)) for n in (8, 11, 14, 30, 200)]
    texts = [None, "", "short", "a" * 300, "a" * 120 + "b" + "a" * 120, "é" * 80, "日本語のテキスト" * 9]
    for _ in range(40):
        parts = [" ".join(rng.choice(words, rng.integers(1, 30))) for _ in range(3)]
        parts.insert(1, passages[rng.integers(0, len(passages))])
        texts.append(" ".join(parts))
    texts += texts[8:12]
    ids = rng.permutation(len(texts)).tolist()
    rows = list(zip(ids, texts, strict=True)) + [(ids[8], texts[8]), (ids[9], "other text under the same number " * 4)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_bytes int").repartition(6)
    assert sorted(tuple(r) for r in substrings.remove_repeats(docs, length).collect()) == slow(rows, length)


def test_long_texts_cross_buffers(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BUFFER_BITS", 10)
    monkeypatch.setattr(substrings, "COMBINED", 3000)
    rng = np.random.default_rng(0)
    text = "".join(rng.choice(list("abcd \n"), 5000))
    rows = [(2, text), (1, text[700:2900] + "zz" + text[100:180]), (3, "q" * 40 + text[1000:1060]), (4, text[4990:] + text[:30])]
    # one task, in the driver's own process, so that the settings hold
    trigger = [substrings.phrases(np.frombuffer(t.encode(), np.uint8), np.zeros(len(t), np.int32), 50) for _, t in rows]
    assert all(int(x[3].sum()) == max(0, len(t) - 49) for x, (_, t) in zip(trigger, rows, strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in substrings.remove_repeats(docs).collect()) == slow(rows, 50)


def test_text_and_columns_come_along(spark):
    same = "This sentence is long enough to be a repeated passage of the corpus."
    docs = spark.createDataFrame([(1, same, "en"), (2, "Before. " + same, None), (3, None, "de")], "doc_id long, text string, lang string")
    out = {r["doc_id"]: (r["kept"], r["lang"]) for r in substrings.remove_repeats(docs, with_text=True).collect()}
    assert out == {1: (same, "en"), 2: ("Before. ", None), 3: (None, "de")}


def test_missing_numbers_and_clashing_names(spark):
    same = "This sentence is long enough to be a repeated passage of the corpus."
    docs = spark.createDataFrame([(None, same, 1, 2), (None, same, 1, 2), (5, same, 3, 4), (6, same, 5, 6)], "doc_id long, text string, kept int, g int")
    out = substrings.remove_repeats(docs, with_text=True)
    assert sorted(out.columns) == sorted(["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "g"])
    assert sorted((r["doc_id"] or 0, r["kept"], r["g"]) for r in out.collect()) == [(0, same, 2), (0, same, 2), (5, same, 4), (6, "", 6)]


def test_suffix_ranks():
    rng = np.random.default_rng(2)
    for n, length in [(400, 16), (400, 50), (90, 33), (60, 50)]:
        data = rng.integers(0, 3, n).astype(np.uint8)
        at = range(n - length + 1)
        ranks = substrings.suffix_ranks(data, length)
        parts = sorted({data[i : i + length].tobytes() for i in at})
        order = sorted(at, key=lambda i: ranks[i])
        assert [data[i : i + length].tobytes() for i in order] == sorted(data[i : i + length].tobytes() for i in at)
        assert len({int(ranks[i]) for i in at}) == len(parts)


def test_no_documents(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_groups_are_sparks(spark):
    ids = np.array([0, 1, -1, 1 << 62, -(1 << 63), 12345], np.int64)
    crc = np.array([0, 7, 1 << 31, (1 << 32) - 1, 9, 9], np.uint32)
    rows = spark.createDataFrame([(int(i), int(c)) for i, c in zip(ids, crc, strict=True)], "i long, c long").selectExpr("i", "pmod(xxhash64(i, c), 37) g").collect()
    found = dict(zip(ids.tolist(), substrings.document_group(ids, crc, 37).tolist(), strict=True))
    assert found == {r["i"]: r["g"] for r in rows}
