"""Importance resampling towards a target distribution by external sorting and counting.

A feature is a run of up to ``order`` words, hashed to one of at most 65,536 buckets. The raw text is read once: each
batch becomes a packed stream of uint16 buckets, one for each feature in the order of the text, with the offsets at
which its documents begin, and is written. Counting is a sort of each stream and a run-length encoding of it, so at most
``buckets`` rows leave a stream, which Spark sums. A bucket's gain is the logarithm of the ratio of its smoothed shares
in the target and in the corpus. The streams are then read again: gains are gathered by bucket, and np.add.reduceat at
the offsets sums them document by document. Gumbel noise from a hash of the id turns the best scores into a sample
without replacement, drawn in proportion to the weights; numbers in order of the score come from sorted ranges.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, discard, materialize, numbered, pieces, release
from .merkle import CRC_TABLE, crc_sql

#: Bytes of text for one stream, and of one piece of a long text.
STREAM_BYTES, PIECE = 4 << 20, 1 << 20
#: Features whose buckets a task remembers.
REMEMBERED = 200_000
#: ASCII bytes that are neither digits nor letters become a space, A-Z lower case; all bytes of other characters stay.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
STREAM = "ids binary, nulls binary, words binary, offsets binary, buckets binary"


class _Buckets(dict):
    """Bucket of a feature's bytes; forgets when full, so a large vocabulary does not grow it."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


#: Bytes at which long texts are cut; none is part of a word.
_GAPS = b" \n\t,."


def _features(text: bytes, order: int) -> Iterator[tuple[int, list[bytes]]]:
    """(words, features) of each piece; a run that crosses two pieces is the later one's."""
    last: list[bytes] = []
    for piece in pieces(text, PIECE, _GAPS):
        words = piece.translate(WORD_BYTES).split()
        found = list(words)
        both = last + words
        for n in range(2, order + 1):
            first = max(0, len(last) - n + 1)
            found += [b" ".join(both[i : i + n]) for i in range(first, len(both) - n + 1)]
        yield len(words), found
        last = both[len(both) - order + 1 :] if order > 1 else []


def streams(docs: DataFrame, key: str, buckets: int, order: int) -> DataFrame:
    """Rows of (ids, nulls, words, offsets, buckets), each the packed arrays of one stream's documents."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Buckets(buckets)
        for batch in arrow_rows(batches, STREAM_BYTES, "text"):
            counts, sizes, parts = [], [], []
            for x in batch.column(1):
                n = size = 0
                for words, found in _features(x.as_buffer().to_pybytes() if x.is_valid else b"", order):
                    parts.append(np.fromiter(map(of.__getitem__, found), np.uint16, len(found)))
                    n, size = n + words, size + len(found)
                counts.append(n)
                sizes.append(size)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            ids = batch.column(0)
            row = [
                np.array(ids.fill_null(0), np.int64), np.array(ids.is_null(), np.bool_), np.array(counts, np.int64), offsets,
                np.concatenate(parts or [np.zeros(0, np.uint16)]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row], ["ids", "nulls", "words", "offsets", "buckets"])
        release()

    return docs.select(F.col(key).cast("long").alias("id"), "text").mapInArrow(pack, STREAM)


def counts(packed: DataFrame, buckets: int) -> np.ndarray:
    """How many features each bucket has, over all streams; at most ``buckets`` rows come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                order = np.sort(np.frombuffer(blob.as_buffer(), np.uint16))
                first = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]])) if len(order) else np.zeros(0, np.int64)
                length = np.diff(np.append(first, len(order)))
                yield pa.RecordBatch.from_arrays([pa.array(order[first].astype(np.int32)), pa.array(length.astype(np.int64))], ["bucket", "n"])

    rows = packed.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares: ((t + 1) (S + B)) / ((s + 1) (T + B)), in doubles."""
    s, t, b = corpus.astype(np.float64), target.astype(np.float64), float(len(corpus))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def weights(packed: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of the gains of each document's features, 0 without any."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, nulls, words, offsets, stream = (np.frombuffer(batch.column(k)[i].as_buffer(), t) for k, t in enumerate((np.int64, np.bool_, np.int64, np.int64, np.uint16)))
                size = np.diff(offsets)
                total = np.zeros(len(size), np.int64)
                some = size > 0
                if some.any():
                    # documents without features take no place in the stream
                    total[some] = np.add.reduceat(gain[stream], offsets[:-1][some])
                weight = np.floor_divide(total, np.maximum(size, 1))
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), pa.array(words), pa.array(size), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])
        release()

    return packed.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of the seed and the key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, order: int = 1, seed: int = 2024, percent: int = 10, least_words: int = 20) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (of the drawn, from 1; null for others).

    Words are runs of ASCII letters and digits and of all other than ASCII characters, A-Z in lower case. ``percent``
    of the documents with at least ``least_words`` words are drawn (rounded down), by highest score, ties to the smaller
    doc_id. A null text has no words, weight 0, and is never drawn; nor does an empty target or corpus fail, as shares are
    smoothed. Rows that repeat a doc_id are documents each, with the same noise; a null doc_id counts as an empty
    one in the noise and as the largest in ties. Other columns have no part. No rows give no rows.
    """
    if not 1 <= buckets <= 1 << 16:
        raise ValueError("buckets must be from 1 to 65536, as streams hold 16 bits")
    packed = materialize(streams(docs, "doc_id", buckets, order), "streams")
    # the items' ids have no part
    wanted = streams(target.select(F.lit(None).cast("long").alias("id"), "text"), "id", buckets, order)
    gain = gains(counts(packed, buckets), counts(wanted, buckets))
    scored = weights(packed, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = materialize(scored, "scores")
    discard(packed)
    able = F.col("n_words") >= least_words
    order_of = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features")]
    ranked = numbered(scored.where(able).withColumn("all", F.lit(0)), "all", order_of, "ranked")
    drawn = F.col("position") < F.floor(F.col("total") * percent / 100)
    ranked = ranked.withColumn("rank", F.when(drawn, F.col("position") + 1))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(rest.select(*columns))


def _gain_sql(buckets: int) -> str:
    return f"floor(1000 * ln((coalesce(t.k, 0)::DOUBLE + 1) * (ss.k + {buckets}::DOUBLE) / ((coalesce(s.k, 0)::DOUBLE + 1) * (tt.k + {buckets}::DOUBLE))))::BIGINT"


_WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH RECURSIVE {CRC_TABLE}, docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce({_WORDS_SQL}, []) AS ws FROM documents),
d AS (SELECT id, unnest(ws) AS w FROM docs), b AS (SELECT unnest({_WORDS_SQL}) AS w FROM benchmark),
names AS (SELECT w, ({crc_sql('w')} % 10000)::INT AS bucket FROM (SELECT w FROM d UNION SELECT w FROM b), crc_table),
s AS (SELECT bucket, count(*) AS k FROM d JOIN names USING (w) GROUP BY bucket), ss AS (SELECT coalesce(sum(k), 0)::DOUBLE AS k FROM s),
t AS (SELECT bucket, count(*) AS k FROM b JOIN names USING (w) GROUP BY bucket), tt AS (SELECT coalesce(sum(k), 0)::DOUBLE AS k FROM t),
g AS (SELECT s.bucket, {_gain_sql(10_000)} AS gain FROM s LEFT JOIN t USING (bucket), ss, tt),
m AS (SELECT id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM d JOIN names USING (w) JOIN g USING (bucket) GROUP BY id),
n AS (SELECT id, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM docs LEFT JOIN m USING (id)),
o AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM n),
r AS (SELECT id, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS able FROM o WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= able * 10 // 100 THEN rank END AS rank FROM o LEFT JOIN r USING (id)
"""
