"""Quality rules with adaptive thresholds, by Spark's own functions only.

Every document has a few counts. A fixed base rule rejects very short and very repetitive texts. The other
rules have no fixed cutoffs: for each language and source, each measure's distribution is a quantile sketch (a
histogram over buckets of bounded relative error, which merges by adding counts), and a document is rejected
where a measure lies far outside its group's quartiles. Groups with few documents use the merged sketch of
their language, and languages with few documents that of all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, split_words

WINDOW, MIN_WORDS, MAX_REPEATED = 8, 20, 30
#: Documents that a group needs for thresholds of its own, and quartile ranges beyond a quartile that reject.
MIN_GROUP, REACH = 50, 8
#: Measures: numerator, scale, denominator, and whether low values reject too.
MEASURES = {
    "symbols": ("n_symbols", 1000, "n_words", False),
    "echoes": ("n_echoes", 1000, "n_words", False),
    "dup_lines": ("n_dup_lines", 1000, "n_words", False),
    "word_length": ("word_chars", 100, "n_words", True),
}
#: A quartile range counts as at least what one event is in a short document of the group (its first quartile of words),
#: or for a length as this part of the first quartile; so where a measure is nearly always zero the fence follows from
#: the group's own sizes, and one event alone rejects nothing.
PART = 16


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _repeated(hashes: Column) -> Column:
    """Words in windows that occur twice or more, from the windows' hashes in order."""

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def twice(ordered: Column) -> Column:
        same = lambda k, e: F.coalesce(F.get(ordered, k)["h"] == e["h"], F.lit(False))
        hit = F.transform(ordered, lambda e, k: F.when(same(k - 1, e) | same(k + 1, e), e["i"]))
        return _let(F.array_sort(F.array_compact(hit)), covered)

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(ordered, twice))


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` (text, ...) with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_echoes (long).

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text; a null or empty text has zeros. n_lines counts lines
    with a word, n_echoes words equal to the one before. Windows are told apart by a 64-bit hash of their words' 64-bit hashes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn("_words", split_words(text))
    rows = rows.withColumn("n_words", F.size("_words").cast("long"))
    rows = rows.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    rows = rows.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    windows = F.transform(F.sequence(F.lit(1), F.size("_hashes") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_hashes", i, WINDOW)))
    rows = rows.withColumn("_windows", F.when(F.size("_hashes") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("_lines", lines)
    counts = {
        "n_symbols": F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", "")),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": _repeated(F.col("_windows")),
        "n_echoes": F.size(F.filter("_hashes", lambda h, i: (i > 0) & (h == F.get("_hashes", i - 1)))),
    }
    rows = rows.withColumns({k: v.cast("long") for k, v in counts.items()})
    return rows.drop("_words", "_hashes", "_windows", "_lines")


def _bucket(value: Column) -> Column:
    """The value with all but its six leading bits cleared: less by a 32nd at most."""
    cleared = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, cleared), cleared)


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, total, low, high) from a sketch (keys, metric, bucket, n): quartiles and what lies far outside.

    The sketch of the metric ``words`` gives the size of a short document.
    """
    group = Window.partitionBy(*keys, "metric")
    rows = sketch.withColumns({"below": F.sum("n").over(group.orderBy("bucket")), "total": F.sum("n").over(group)})
    quarts = rows.groupBy(*keys, "metric").agg(
        F.max("total").alias("total"),
        F.min(F.when(4 * F.col("below") >= F.col("total"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("below") >= 3 * F.col("total"), F.col("bucket"))).alias("q3"),
    )
    short = F.max(F.when(F.col("metric") == "words", F.greatest("q1", F.lit(1)))).over(Window.partitionBy(*keys))
    least = F.floor(F.when(F.col("metric") == "word_length", F.col("q1") / PART).otherwise(1000 / short))
    reach = REACH * F.greatest(F.col("q3") - F.col("q1"), least)
    return quarts.select(*keys, "metric", "total", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def thresholds(measured: DataFrame) -> DataFrame:
    """One row for each (lang, source) of ``measured``: m_low and m_high for every measure m."""
    values = [F.struct(F.lit(m).alias("metric"), _bucket(F.col(f"m_{m}")).alias("bucket")) for m in MEASURES]
    values.append(F.struct(F.lit("words").alias("metric"), _bucket(F.col("n_words")).alias("bucket")))
    cells = measured.select("lang", "source", F.explode(F.array(*values)).alias("v")).select("lang", "source", "v.metric", "v.bucket")
    sketch = materialize(cells.groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n")), "sketch")
    merged = lambda *keys: sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    own, by_lang, overall = _fences(sketch, ["lang", "source"]), _fences(merged("lang"), ["lang"]), _fences(merged(), [])
    own, by_lang, overall = own.alias("s"), by_lang.alias("l"), overall.alias("o")
    rows = own.join(by_lang, F.col("s.lang").eqNullSafe(F.col("l.lang")) & (F.col("s.metric") == F.col("l.metric")))
    rows = rows.join(overall, F.col("s.metric") == F.col("o.metric"))
    pick = lambda c: F.when(F.col("s.total") >= MIN_GROUP, F.col(f"s.{c}")).when(F.col("l.total") >= MIN_GROUP, F.col(f"l.{c}")).otherwise(F.col(f"o.{c}"))
    rows = rows.select("s.lang", "s.source", "s.metric", pick("low").alias("low"), pick("high").alias("high"))
    return rows.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, F.col(end))).alias(f"{m}_{end}") for m in MEASURES for end in ("low", "high")])


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row of ``docs`` (doc_id, text, lang, source).

    base_failed: fewer than 20 words, or over 30 % of them in repeated windows. kept: neither that nor far
    outside its group. Sketches count the rows that pass the base rule. A null lang or source is a group of
    its own; repeated rows count and are judged each on their own. No rows give no rows.
    """
    rows = measure(docs.select("doc_id", "text", "lang", "source")).drop("text")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    rows = materialize(rows, "measured")
    ratios = {f"m_{m}": F.floor(F.col(a) * scale / F.greatest(F.col(b), F.lit(1))).cast("long") for m, (a, scale, b, *_) in MEASURES.items()}
    rows = rows.withColumns(ratios)
    fences = thresholds(rows.where("not base_failed")).withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    joined = rows.join(fences, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    far = reduce(lambda x, y: x | y, [(F.col(f"m_{m}") > F.col(f"{m}_high")) | (F.col(f"m_{m}") < F.col(f"{m}_low") if low else F.lit(False)) for m, (*_, low) in MEASURES.items()])
    kept = ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_lines", "n_echoes")


ORACLE_SQL = rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM base
), windows AS (
  SELECT rid, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS win
  FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM words)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM windows) WHERE c > 1
), repeated AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range({WINDOW})) AS k) GROUP BY rid
), counted AS (
  SELECT rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_echoes
  FROM words LEFT JOIN repeated USING (rid)
), judged AS (
  SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AS base_failed FROM counted
), values_ AS (
  SELECT rid, lang, source, base_failed, unnest(['symbols', 'echoes', 'dup_lines', 'word_length', 'words']) AS metric,
         unnest([1000 * n_symbols // greatest(n_words, 1), 1000 * n_echoes // greatest(n_words, 1),
                 1000 * n_dup_lines // greatest(n_words, 1), 100 * word_chars // greatest(n_words, 1), n_words]) AS v
  FROM judged
), cells AS (
  SELECT lang, source, metric, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS bucket, count(*) AS n
  FROM values_ WHERE NOT base_failed GROUP BY ALL
), sketches AS (
  SELECT 0 AS level, lang, source, metric, bucket, n FROM cells
  UNION ALL SELECT 1, lang, NULL, metric, bucket, sum(n) FROM cells GROUP BY lang, metric, bucket
  UNION ALL SELECT 2, NULL, NULL, metric, bucket, sum(n) FROM cells GROUP BY metric, bucket
), summed AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM sketches
), quarts AS (
  SELECT level, lang, source, metric, max(total) AS total, min(bucket) FILTER (WHERE 4 * below >= total) AS q1, min(bucket) FILTER (WHERE 4 * below >= 3 * total) AS q3
  FROM summed GROUP BY level, lang, source, metric
), shorts AS (
  SELECT *, max(greatest(q1, 1)) FILTER (WHERE metric = 'words') OVER (PARTITION BY level, lang, source) AS short FROM quarts
), fences AS (
  SELECT *, {REACH} * greatest(q3 - q1, CASE metric WHEN 'word_length' THEN q1 // {PART} ELSE 1000 // short END) AS reach FROM shorts WHERE metric <> 'words'
), far AS (
  SELECT v.rid, bool_or(v.v > f.q3 + f.reach OR (v.metric = 'word_length' AND v.v < f.q1 - f.reach)) AS far
  FROM values_ v
  LEFT JOIN fences s ON s.level = 0 AND s.lang IS NOT DISTINCT FROM v.lang AND s.source IS NOT DISTINCT FROM v.source AND s.metric = v.metric
  LEFT JOIN fences l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM v.lang AND l.metric = v.metric
  JOIN fences f ON f.metric = v.metric AND s.metric IS NOT NULL AND CASE WHEN s.total >= {MIN_GROUP} THEN f.level = 0 AND f.lang IS NOT DISTINCT FROM v.lang AND f.source IS NOT DISTINCT FROM v.source
    WHEN l.total >= {MIN_GROUP} THEN f.level = 1 AND f.lang IS NOT DISTINCT FROM v.lang ELSE f.level = 2 END
  GROUP BY v.rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(far, false) AS kept, n_lines, n_echoes
FROM judged LEFT JOIN far USING (rid)
"""
