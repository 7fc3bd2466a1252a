import zlib

import corpus_pipeline
from parlance.llm import mixing, simhash, substrings
from tests.llm.test_packing import check_sequences, ids_of
from tests.llm.test_substrings import slow


def test_stages_follow_each_other(spark):
    import random

    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("lan", "ten", "mor", "vis", "que", "der") for b in ("ta", "ri", "os", "en", "ung", "e")]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(30)]
    shared = " ".join(rng.choices(words, k=25))
    rows = [(i, t if i % 5 else f"{t} {shared}", "en" if i % 2 else "de", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[3], "en", "s0", 1), (101, None, "en", "s1", None), (102, "123 456", None, None, 7), (103, texts[4] + " mor", None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], "unused").cache())
    language, deduped, cut, mixed, packed = ([r.asDict() for r in df.collect()] for df in seen[1:])
    assert {r["doc_id"] for r in language} == {i for i, *_ in rows} - {101, 102}
    groups = simhash.near_duplicates(seen[1]).collect()
    assert sorted(r["doc_id"] for r in deduped) == sorted({r["component_id"] for r in groups}) and 100 not in {r["doc_id"] for r in deduped}
    assert sorted(tuple(r) for r in substrings.remove_repeats(seen[2]).collect()) == slow([(r["doc_id"], r["text"]) for r in deduped], 50)
    assert sum(len(r["text"]) for r in cut) < sum(len(r["text"]) for r in deduped) and all(r["n_chars"] == len(r["text"]) for r in cut)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(seen[3]).collect()}
    for doc, n in copies.items():
        assert sum(r["doc_id"] == doc for r in mixed) == n
    check_sequences(packed, 4096)
    assert sum(r["length"] for r in packed) == sum(len(ids_of(r["text"])) for r in mixed)
    assert all(set(r) == set(corpus_pipeline.COLUMNS) for r in [*language, *deduped, *cut, *mixed])


def test_near_duplicates_keep_one_row_of_each_group(spark):
    import random

    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(50)) for _ in range(6)]
    rows = [(None, texts[0], "en", "s", 1), (None, texts[1], "en", "s", 1), (None, texts[1], "de", "s", 1)]  # no doc_id
    rows += [(7, texts[2], "en", "s", 1), (7, texts[3], "en", "s", 1)]  # one doc_id, two texts
    rows += [(3, texts[4], "en", "s", 1), (9, texts[4], "en", "s", 1), (9, texts[5], "en", "s", 1)]  # a copy by the doc_id of a clean text
    rows += [(None, texts[4], "en", "s", 1), (3, texts[4], "en", "r", 1), (3, texts[4], None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    wanted = [(None, texts[0], "en", "s", 1), (None, texts[1], "de", "s", 1), (7, texts[2], "en", "s", 1), (7, texts[3], "en", "s", 1)]
    wanted += [(3, texts[4], None, None, None), (9, texts[5], "en", "s", 1)]
    for parts in (1, 5):
        out = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(parts), "unused").collect()
        assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, wanted))


def test_run_on_a_table(spark, small):
    out = corpus_pipeline.run(spark, small).collect()
    assert out and check_sequences(out, 4096)
    assert all(0 <= r["ids_crc32"] < 1 << 32 and r["length"] <= 4096 for r in out)
    assert zlib.crc32(b"")== 0


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
