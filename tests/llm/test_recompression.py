import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from parlance.llm import recompression

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(rows, width):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = True
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def ours(spark, rows, width, parts=6):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_words int, number string").repartition(parts)
    return sorted((tuple(r) for r in recompression.remove_repeated_windows(docs, width).collect()), key=repr)


def corpus(seed, few):
    """Documents of few different words, with shared passages, runs and periods."""
    rng = np.random.default_rng(seed)
    words = np.array(["the", "of", "naïve", "straße", "x", "and", "日本"] if few else [f"w{i}" for i in range(400)])
    passage = lambda n: " ".join(rng.choice(words, n))
    shared = [passage(n) for n in (7, 8, 9, 20, 34, 35, 36, 60, 300)]
    texts = [None, "", " \n ", "one", "a " * 34, "a " * 35, "a " * 36 + "b", "b " + "a " * 200, "a b " * 60, "x a b a b a b c " * 20]
    for _ in range(60):
        parts = [passage(rng.integers(1, 40)) for _ in range(3)]
        for k in rng.integers(0, len(shared), 2):
            parts.insert(rng.integers(0, 4), shared[k])
        texts.append("\t ".join(parts))
    texts += texts[12:15]
    rows = list(zip(rng.permutation(len(texts)).tolist(), texts, strict=True))
    return rows + [rows[20], (rows[21][0], passage(50)), (None, texts[30]), (None, passage(50))]


@pytest.mark.parametrize("width,few", [(8, False), (8, True), (35, False), (35, True)])
def test_against_brute_force(spark, width, few):
    rows = corpus(width, few)
    assert ours(spark, rows, width) == slow(rows, width)


def test_empty_and_bounds(spark):
    assert ours(spark, [], 35) == []
    assert ours(spark, [(1, None)], 35) == slow([(1, None)], 35)
    with pytest.raises(ValueError):
        ours(spark, [], 5)


@pytest.mark.parametrize("width", [8, 35])
def test_equal_windows_have_equal_anchors_anywhere(width):
    """The anchor's place in the window and its key follow from the window's words, whatever stands around and wherever buffers are cut."""
    rng = np.random.default_rng(width)
    for vocabulary in (2, 3, 40, 5000):
        values = rng.integers(0, 1 << 63, vocabulary).astype(np.uint64) * np.uint64(2)
        window = rng.choice(values, 4 * width)
        if vocabulary == 3:
            window[width : 2 * width] = window[0]
        found = []
        for before, after in ((0, 0), (3, 50), (200, 1), (41, 400)):
            whole = np.concatenate([rng.choice(values, before), window, rng.choice(values, after)])
            owner = np.concatenate([np.zeros(before // 2, int), np.ones(len(whole) - before // 2, int)])
            anchor, key = recompression.anchors(whole, owner, width)
            at = slice(before, before + 3 * width)
            found.append((anchor[at] - before, key[at]))
        assert all((a == found[0][0]).all() and (k == found[0][1]).all() for a, k in found)


def test_windows_share_anchors():
    """On prose-like words a phrase holds several windows, and few keys are shared by chance."""
    rng = np.random.default_rng(0)
    names = rng.integers(0, 1 << 63, 5000).astype(np.uint64)[np.minimum(rng.zipf(1.3, 200_000) - 1, 4999)]
    rows = recompression.phrases(names, np.zeros(len(names), int), 35)
    assert rows["count"].astype(int).sum() == len(names) - 34
    assert len(rows) < len(names) / 4
    assert len(np.unique(rows["key"])) > 0.6 * len(rows)


def test_long_text_crosses_buffers(monkeypatch):
    monkeypatch.setattr(recompression, "PIECE", 100)
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abc \n"), 5000)) + "z" * 500
    names = recompression._Names()
    assert recompression.word_names(text.encode(), names).tolist() == [names[w.encode()] for w in WORD.findall(text)]
    n, removed, kept = recompression._kept(text.encode(), None, 35)
    assert (n, removed, kept.decode()) == (len(text.split()), 0, " ".join(text.split()))


def test_parts_of_a_long_document(spark):
    rng = np.random.default_rng(4)
    words = rng.choice([f"w{i}" for i in range(3000)], 300_000).tolist()
    words[250_000:250_100] = words[131_040:131_140]  # across two buffers
    rows = [(1, " ".join(words)), (2, " ".join(words[131_060:131_100]))]
    assert ours(spark, rows, 35) == slow(rows, 35)


def test_text_comes_along(spark):
    rows = [(1, "  " + "a b c d e f g h " * 2 + " end\n"), (2, "kept\twords here"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"]: r["kept"] for r in recompression.remove_repeated_windows(docs, 8, with_text=True).collect()}
    assert kept == {1: "end", 2: "kept words here", 3: ""}
