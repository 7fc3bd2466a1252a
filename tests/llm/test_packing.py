import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parlance.llm import packing
from parlance.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, length string"


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [1]


def check_sequences(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_pieces_and_places(spark, parts):
    texts = ["a b c", None, "", "Don't STOP, the  \t\n naïve café 42 00!", "word " * 300, "x" * 3000, "same text", "same text", "İstanbul ΣΑΣ á ﬁ<|endoftext|>"]
    rows = [(i % 70, texts[i % len(texts)], "x") for i in range(120)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    out = packing.pack(docs, tokenizer_path(), capacity=64).collect()
    expected = []
    for doc_id, text, _ in rows:
        ids = ids_of(text)
        for piece, start in enumerate(range(0, len(ids), 64)):
            part = ids[start : start + 64]
            expected.append((doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(expected)
    n = check_sequences(out, 64)
    assert n <= 1.15 * sum(e[3] for e in expected) / 64 + 2


def test_marks_after_marks_are_one_piece():
    words = ["(foo).", '"foo".', "foo?!", "foo),", '"9233"!!', "x_!", "e\u0301.", "\u0301!", "naïve...", "a\u00b2!", "don't.", "...", "foo!?.", "<|endoftext|>.", "<|ENDOFTEXT|>!"]
    texts = [*words, " ".join(words), "Plain words, and (more). No. 42!"]
    found = packing.WordIds(tokenizer_path())([t.encode() for t in texts])
    assert [[*np.frombuffer(raw, "<u4").tolist(), 1] for raw in found] == [ids_of(t) for t in texts]


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit_holds_everything_once(lengths):
    bins, offsets, fills = packing.best_fit(np.array(lengths, np.int64), 50)
    for b in range(len(fills)):
        own = sorted((int(offsets[i]), lengths[i]) for i in range(len(lengths)) if bins[i] == b)
        assert own[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(own, own[1:], strict=False))
        assert sum(x[1] for x in own) == fills[b] <= 50


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 30)), max_size=15))
def test_merge_uses_every_rank_once(classes):
    patterns = packing.merge_classes([c[0] for c in classes], [c[1] for c in classes], 40)
    used = {}
    for total, copies, members in patterns:
        assert sum(classes[c][0] for c, _ in members) == total <= 40
        for c, first in members:
            for r in range(first, first + copies):
                assert (c, r) not in used
                used[c, r] = True
    assert len(used) == sum(n for _, n in classes)


def _whole(texts):
    ids = packing._word_ids(tokenizer_path())
    return list(ids([t.encode() for t in texts])), [np.array(ids.encode(ids.whole, t), "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("table", ["documents", "conversations", "benchmark"])
def test_ids_are_the_tokenizers_on_whole_tables(spark, small, table):
    found, want = _whole([r["text"] for r in spark.read.parquet(f"{small}/{table}.parquet").select("text").collect() if r["text"]])
    assert found == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abZ19 .,!?*$#%&()[]\"'|<>-_:;/\n\u201d\u2014\u2026\u00b0\u00e9\u0301\u00ad\u00df\u65e5", max_size=40))
def test_ids_are_the_tokenizers_on_runs_of_marks(text):
    found, want = _whole([text])
    assert found == want
