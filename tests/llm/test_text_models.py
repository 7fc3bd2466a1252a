import itertools
import json
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import language, mixing, quality_classifier, quality_rules, quotations, url_filter
from parlance.llm.queries import ORACLES, QUERIES, URL_RULES


def oracle(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    found = con.sql(sql)
    return sorted(map(repr, ([dict(zip(found.columns, r, strict=True))[c] for c in sorted(found.columns)] for r in found.fetchall())))


def rows_of(df):
    return sorted(map(repr, ([r[c] for c in sorted(df.columns)] for r in df.collect())))


ODD_TEXTS = [None, "", " \n\t", "one", "word " * 25, "a b c d e f g h " * 6, "x # y $ z *% & | < >" * 8, "line one\nline one\n \nline two\nline one", "é\u00a0ü \x0b mañana\r\n" * 9, "\n".join(f"w{i} v{i} u{i}" for i in range(60))]


def documents(spark):
    rows = [(i, ODD_TEXTS[i % len(ODD_TEXTS)], [None, "en", "de"][i % 3], [None, "a", "b"][i % 2 + (i > 100)], True) for i in range(160)]
    rows += [(i, " ".join(f"t{i * k % 97}x" for k in range(30)), "en", "a", False) for i in range(200, 300)] + [(7, ODD_TEXTS[7], "de", "a", None)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept boolean")


def test_quality_rules_against_sql(spark):
    docs = documents(spark)
    assert rows_of(quality_rules.judge(docs)) == oracle(quality_rules.ORACLE_SQL, documents=docs.toPandas())
    empty = docs.limit(0)
    assert quality_rules.judge(empty).count() == 0


def test_quality_rules_reject_outliers_only(spark):
    rows = [(i, " ".join(f"word{i * k % 89}" for k in range(40)), "en", "a") for i in range(1, 89)] + [(999, " ".join(f"w{k}$$$%%%" for k in range(40)), "en", "a")]
    out = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [k for k, kept in out.items() if not kept] == [999]


def test_quotations_against_sql(spark):
    rows = [
        (1, 0, "user", "Hello there\nHow are you?", 1), (1, 2, "assistant", "> how  are YOU?\nFine.", 1), (1, 5, "user", ">> Hello there\n> Fine.\nGood\n>", 1),
        (1, 5, "user", ">> Hello there\n> Fine.\nGood\n>", 1), (1, 9, None, "> never said\n\nNo", 1), (1, 70, "user", "> > How are you?\r\nlast", 1), (1, 9000, "user", "  > Good\n", 1),
        (2, 0, "user", None, 1), (2, 1, "user", "", 1), (2, None, "user", "> Hello there", 1), (None, 3, "user", "alone", 1), (None, 4, "user", "> alone", 1), (3, 4, "user", "> alone", 1),
        (1, -3, "system", "before all", 1), (1, 9, "a|>b", "see <|user|> and <\\|x|>", 1), (5, 0, "user", "zero", 1), (5, 1, "user", "one", 1), (5, 2, "user", "> zero\ntwo", 1), (5, 3, "user", "three", 1), (5, 4, "user", "> two\nfour", 1), (4, 1, "user", "> same\nsame", 1), (4, 1, "assistant", "same", 1),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position int")
    pandas = table.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})
    linked = quotations.link(table)
    assert rows_of(linked) == oracle(quotations.ORACLE_SQL, conversations=pandas)
    assert {(r["turn"], r["reply_to"], r["link"]) for r in linked.where("conv_id = 1").collect()} >= {(2, 0, "quote"), (5, 2, "quote"), (9, 5, "previous"), (70, 0, "quote"), (-3, None, "none"), (9000, 5, "quote")}
    assert quotations.link(table.limit(0)).count() == 0
    text = {(r["conv_id"], r["part"]): r["text"] for r in quotations.render(linked).collect()}
    assert text[5, 0] == "".join(f"<|user|>\n{x}\n" for x in ("zero", "two", "four", "one", "three"))
    assert "<|a__b|>\nsee <\\|user|> and <\\\\|x|>\n" in text[1, 0]
    assert text[1, 0].startswith("<|system|>\nbefore all\n<|user|>\nHello there\nHow are you?\n<|assistant|>\nFine.\n")


def test_long_conversation_positions(spark):
    turns = spark.range(0, 20000, 3).selectExpr("1L conv_id", "id turn")
    out = quotations.previous_turns(turns).collect()
    assert len(out) == 6667
    assert all(r["position"] == r["turn"] // 3 and r["previous"] == (r["turn"] - 3 if r["turn"] else None) for r in out)


URLS = [None, "", "no scheme", "http://", "http://A.Example.ORG/es/x", "https://example.org/en/12?q=/es/", "https://notexample.org/en/1", "ftp://x.com/fr/y#z", "http://com/de/", "http://com/DE/", "x://org", "x://org/", "http://example.org?x/es/", "http://a.b.com/de//", "http://é.org/ü", "a://b://c.org/es/"]


def test_urls_against_sql_and_join(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*URLS, URLS[4]])], "page_id long, url string, verdict string")
    out = url_filter.judge(pages, URL_RULES)
    assert rows_of(out) == oracle(ORACLES["op8_url_filter"], pages=pages.toPandas())
    joined = url_filter.judge(pages, spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))
    assert rows_of(joined) == rows_of(out)
    assert url_filter.judge(pages.limit(0), URL_RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, []).collect()} == {"allow"}


def test_urls_by_shards_are_judged_alike(spark, monkeypatch):
    rules = [*URL_RULES, ("é.org", "/ü", "block"), ("É.org", "/", "block"), ("b.com", "/de", "allow"), ("a.b.com", "/de/", "allow"), ("b.com", "/de", "block")] + [(f"h{i}.net", "/x" * (i % 4 + 1), "block") for i in range(60)]
    urls = [*URLS, URLS[4], "http://É.org/üß", "http://b.com/de", "x://q.h7.net/x/x/x/xyz", "x://h7.net/X", "x://é.org/ß", "http://A.H3.net/x/x/x/x"]
    pages = spark.createDataFrame([(i % 19, u, 1) for i, u in enumerate(urls * 2)] + [(None, None, 1)], "page_id long, url string, rule int")
    whole = rows_of(url_filter.judge(pages, rules))
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    assert rows_of(url_filter.judge(pages, table)) == whole
    monkeypatch.setattr(url_filter, "SHARD_BYTES", 200)
    monkeypatch.setattr(url_filter, "MET", 3)
    assert rows_of(url_filter.judge(pages, rules)) == rows_of(url_filter.judge(pages, table)) == whole
    assert url_filter.judge(pages.limit(0), table).count() == 0
    for wrong in [("", "/", "allow"), ("x", "y", "allow"), ("x", "/", "deny"), ("x", None, "block")]:
        for size in (200, 1 << 20):
            monkeypatch.setattr(url_filter, "SHARD_BYTES", size)
            for given in ([*rules, wrong], spark.createDataFrame([*rules, wrong], table.schema)):
                with pytest.raises(ValueError, match="not a rule"):
                    url_filter.judge(pages, given)


def test_colliding_digests_are_told_apart(monkeypatch, tmp_path):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda k: len(k) % 3)
    rules = [(h, p, v) for (h, v), p in itertools.product([("a.org", "allow"), ("b.org", "block"), ("cc.org", "allow")], ["/", "/x", "/yz"])]
    path = tmp_path / "digests"
    path.write_bytes(url_filter.DigestArray.build(rules))
    array = url_filter.DigestArray(str(path))
    keys = [(h + p).encode() for h, p, _ in rules]
    assert [array.string(i) for i in array.find(keys)] == keys
    assert [array.verdicts[i] for i in array.find(keys)] == [int(v == "block") for *_, v in rules]
    assert (array.find([b"d.org/", b"a.org/q"]) == -1).all()


def brute_targets(sizes, weights, share, most):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, goal, out = share * sum(sizes.values()), {}, dict.fromkeys(order)
    open_ = list(order)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = [s for s in open_ if level * w[s] > most * sizes[s]]
        if not full:
            goal |= {s: level * w[s] for s in open_}
            break
        for s in full:
            goal[s] = most * sizes[s]
            left -= goal[s]
            open_.remove(s)
    return {s: goal.get(s, 0.0) for s in out}


def test_mixing(spark):
    sizes = {"b": 400, "a": 120, "é": 3000, None: 250, "z": 0, "Z": 900}
    rows, i = [], 0
    for source, n in sizes.items():
        while n > 0:
            k = min(n, 1 + i * 7 % 23)
            rows.append((i, " ".join(["w"] * k), source, "x"))
            n, i = n - k, i + 1
    rows += [(i, None, "z", "x"), (i + 1, " ", "b", "x"), (0, rows[0][1], "b", "x")]
    sizes["b"] += len(rows[0][1].split())
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    for name in ("l", "mean", "shift", "documents", "key", "row", "r", "s", "cuts", "below", "at", "draw", "a.b"):
        docs = docs.withColumn(name, F.lit(1))
    out = mixing.mix(docs)
    assert set(docs.columns) <= set(out.columns)
    found = out.collect()
    assert len(found) == len(rows)
    want = brute_targets(sizes, mixing.WEIGHTS, 1.5, 2)
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["size"] == len((r["text"] or "").split()) and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
    for source, goal in want.items():
        assert abs(sum(r["taken"] for r in found if r["source"] == source) - goal) <= 23
    assert rows_of(mixing.mix(docs.repartition(5))) == rows_of(out)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_language_held_out(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = QUERIES["op3_language_id"](spark, small).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"] and r["lang"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)


def test_language_odd_rows(spark):
    schema = "doc_id long, lang string, text string, score string"
    rows = [(i, "en", "the cat and the dog", "") for i in range(5)] + [(9, "fr", "le chat et le chien", ""), (10, None, "x", ""), (11, "en", None, "")]
    model = language.fit(spark.createDataFrame(rows, schema))
    texts = [(1, "en", None, "a"), (2, None, "", "a"), (3, "fr", "123 ...", "a"), (4, "en", "le chien et le chat", "a"), (4, "en", "le chien et le chat", "a"), (5, "", "the dog " * 50000, "a")]
    out = language.predict(spark.createDataFrame(texts, schema), model).collect()
    assert [r["lang_pred"] for r in sorted(out, key=lambda r: r["doc_id"])] == ["und", "und", "und", "fr", "fr", "en"]
    assert language.fit(spark.createDataFrame([], schema)) is None
    assert {r["lang_pred"] for r in language.predict(spark.createDataFrame(texts, schema), None).collect()} == {"und"}
    assert language.predict(spark.createDataFrame([], schema), model).count() == 0


def test_quality_held_out(spark, small):
    small = small.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    out = QUERIES["op7_quality_classifier"](spark, small).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in out)
    good, bad = ([r["score"] for r in out if r["held_out"] and labels.get(r["doc_id"]) == q] for q in (1, 0))
    if good and bad:
        assert sum(g > b for g in good for b in bad) >= 0.9 * len(good) * len(bad)


def test_quality_features_by_definition():
    """Every feature of whole texts against the definition, block by block."""
    words = [b"fine words of sense ", b"$$ %% ### || ", b"\xff\x00raw ", "\u00e9t\u00e9 ".encode()]
    good, bad = (quality_classifier.dictionary([w * 300 for w in part]) for part in (words[:1], words[1:2]))
    texts = [b"", b"x", words[0] * 40, words[1] * 9 + words[0] * 9, b"".join(words) * 500, bytes(range(128)), bytes(range(129))]
    better, worse = (quality_classifier._compressor(x) for x in (good, bad))
    for row, text in zip(quality_classifier.features(texts, good, bad), texts, strict=True):
        if not text:
            assert not row.any()
            continue
        sizes = lambda b: (len(better.compress(b)), len(worse.compress(b)))
        differences = lambda b: [(sizes(b)[1] - sizes(b)[0]) / n for n in (len(b) + 40, sum(sizes(b)))]
        whole = differences(text)
        blocks = np.array([differences(text[k : k + 128]) for k in range(0, len(text), 128)])
        expected = [whole[0], np.sign(whole[0]) * abs(whole[0]) ** 0.5, whole[1], *(np.quantile(blocks[:, c], p) for c in (0, 1) for p in quality_classifier.POINTS)]
        assert np.allclose(row, expected, atol=1e-12)


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good words here " * 20, 1), (2, "$$ %% " * 40, 1), (3, None, 1), (4, "", 1), (1, "again", 1)], "doc_id long, text string, score int")
    labels = "doc_id long, quality int, toxic int"
    model = quality_classifier.fit(docs, spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (8, 5, 0), (None, 1, 1)], labels))
    out = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, model).collect()}
    assert len(out) == 4 and all(0 <= s <= 1 for s in out.values()) and out[1] > out[2] and out[3] == out[4]
    assert quality_classifier.fit(docs, spark.createDataFrame([], labels)) is None
    assert {r["score"] for r in quality_classifier.score(docs, None).collect()} == {0.5}
    assert quality_classifier.score(docs.limit(0), model).count() == 0


def test_mixing_comes_near_every_target(spark):
    docs = spark.createDataFrame([(i, "w " * (4000 if i % 50 == 0 else 1 + i % 90), f"s{i % 3}") for i in range(1500)], "doc_id long, text string, source string")
    out = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 0.002 * r["target"] for r in out)


def test_quality_learns_from_long_and_repeated_rows(spark):
    rows = [(i, ("fine words of sense " if i % 2 else "$$ %% ### || ") * 4000 + str(i), i % 2) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [rows[0][:2]] * 30, "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] * 2, "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    out = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, model).collect()}
    assert min(out[i] for i, _, q in rows if q) > 0.5 > max(out[i] for i, _, q in rows if not q)
    with pytest.warns(UserWarning, match="no quality model"):
        assert quality_classifier.fit(docs, labels.where("quality = 1")) is None


def test_no_operator_row_is_lost(spark, small):
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    for name in ("op2_quality_rules", "op6_mix_sources", "op5_simhash_duplicates", "op10_remove_repeats"):
        assert QUERIES[name](spark, small).count() == n, name


def test_names():
    numbers = [int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES]
    assert sorted(numbers) == list(range(1, 11)), json.dumps(numbers)


def test_language_fit_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_ROWS", 6)
    seen = []
    fit = language.fit_spectra
    monkeypatch.setattr(language, "fit_spectra", lambda flags, langs: seen.append(langs) or fit(flags, langs))
    rows = [(7, "aa", "one and the same text")] * 500 + [(7, "bb", f"another text {i} xyz") for i in range(300)] + [(i, "cc", f"{i} words qqq") for i in range(300)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, lang string, text string, `Lang_Pred` string")
    model = language.fit(docs)
    assert model.languages == ("aa", "bb", "cc") and seen[0].count("aa") == 1 and len(seen[0]) < 20
    assert language.predict(docs, model).columns == ["doc_id", "lang", "text", "lang_pred", "score"]
    with pytest.raises(ValueError):
        language.fit(spark.createDataFrame([(i, f"l{i}", "text") for i in range(7)], "doc_id long, lang string, text string"))


def test_mixing_with_names_in_other_case(spark):
    docs = spark.createDataFrame([(i, "a b c", "s", 9, 9, 9) for i in range(20)], "doc_id long, text string, source string, `Size` int, `TAKEN` int, `Row` int")
    out = mixing.mix(docs)
    assert sorted(out.columns) == sorted(["doc_id", "text", "source", "Row", *mixing.NEW]) and {r["size"] for r in out.collect()} == {3}


def test_quotes_of_other_conversations_do_not_collide(spark, monkeypatch):
    """Conversations are compared themselves: with a hash of all passages alike, only the same conversation links."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(quotations, "_double", lambda *columns: F.struct(F.lit(1).cast("long").alias("x"), F.length(columns[0]).cast("long").alias("y")))
    rows = [(c, t, "user", text) for c in (1, 2, None) for t, text in enumerate(["hello", "> hello"] if c != 2 else ["other words", "> hello"])]
    got = {(r["conv_id"], r["turn"]): (r["link"], r["n_linked"]) for r in quotations.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {(c, t): ("none", 0) if t == 0 else ("previous", 0) if c == 2 else ("quote", 1) for c in (1, 2, None) for t in (0, 1)}
