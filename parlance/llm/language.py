"""Language identification by string kernels: n-gram presence, Nystrom landmarks and kernel ridge regression.

A text's blended spectrum is the set of its character 1-, 2- and 3-grams, hashed to DIMENSIONS buckets. The
kernel of two texts is the number of buckets that both have, over the root of the product of their sizes. The
fit takes a bounded sample: kernels to a few landmark texts give Nystrom features, and a ridge regression on
these, one language against the rest, gives the weights. Landmarks and weights fold into one matrix
(buckets x languages), so scoring is a matrix product of a batch's presence rows with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, release

DIMENSIONS = 1 << 14
#: The fit's bound: sampled rows of each language, and landmarks of all.
SAMPLE, LANDMARKS, RIDGE, SHARPNESS = 400, 192, 1e-3, 4.0
#: Rows of all languages together that the fit takes at most, but one of each language.
MOST_ROWS = 4000
#: Characters of a text that are hashed at once; only memory depends on it.
WINDOW = 1 << 20


def spectrum(text: str) -> np.ndarray:
    """Presence of each bucket, over the whole lower-cased text."""
    flags = np.zeros(DIMENSIONS, np.bool_)
    text = text.lower()
    shift = np.uint32(32 - 14)
    for i in range(0, len(text), WINDOW):
        c = np.frombuffer(text[i : i + WINDOW + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        one = (c + np.uint32(1)) * np.uint32(0x9E3779B1)
        flags[one >> shift] = True
        two = (one[:-1] ^ (c[1:] + np.uint32(7))) * np.uint32(0x85EBCA6B)
        flags[two >> shift] = True
        three = (two[:-1] ^ (c[2:] + np.uint32(13))) * np.uint32(0xC2B2AE35)
        flags[three >> shift] = True
    return flags


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray

    def scores(self, flags: np.ndarray) -> np.ndarray:
        """Of each row of presence flags: a share for each language, summing to 1."""
        rows = flags.astype(np.float32)
        size = np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))
        margins = SHARPNESS * ((rows @ self.weights) / size + self.bias)
        shares = np.exp(margins - margins.max(1, keepdims=True))
        return shares / shares.sum(1, keepdims=True)


def fit_spectra(flags: np.ndarray, langs: list[str]) -> Model:
    """Nystrom kernel ridge regression over presence rows; deterministic in their order."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    root = np.sqrt(np.maximum(flags.sum(1, dtype=np.int64), 1))
    each = max(1, LANDMARKS // len(names))
    marks = np.sort(np.concatenate([np.flatnonzero(y == k)[:each] for k in range(len(names))]))
    landmark = flags[marks] / root[marks, None]
    values, vectors = np.linalg.eigh(landmark @ landmark.T)
    kept = values > 1e-6 * values.max()
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    # by parts: the sample's rows are wide, and wider still as floats
    z = np.concatenate([(flags[i : i + 128] / root[i : i + 128, None]) @ landmark.T for i in range(0, len(flags), 128)]) @ whiten
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = 1 / np.bincount(y, minlength=len(names))[y]  # every language counts alike
    weight /= weight.sum()
    z_mean, t_mean = weight @ z, weight @ target
    zc, tc = z - z_mean, target - t_mean
    w = np.linalg.solve(zc.T @ (weight[:, None] * zc) + RIDGE * np.eye(z.shape[1]), zc.T @ (weight[:, None] * tc))
    return Model(tuple(names), (landmark.T @ (whiten @ w)).astype(np.float32), (t_mean - z_mean @ w).astype(np.float32))


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from (doc_id, lang, text) rows; about ``sample`` rows of each language, by a hash of doc_id and text.

    Of many languages each gives fewer, so that the rows of all are at most about MOST_ROWS; more labels than that
    raise. Equal rows count as one. Rows with a null lang or without a letter teach nothing. None if nothing is left.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    spread = 1 << 40
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id").cast("string"), "text"), F.lit(spread))
    different = rows.groupBy("lang").agg(F.approx_count_distinct(draw, 0.02).alias("n"))
    counts = {r["lang"]: max(1, r["n"]) for r in different.limit(MOST_ROWS + 1).collect()}
    if not counts:
        return None
    if len(counts) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} labels of languages")
    sample = min(sample, max(1, MOST_ROWS // len(counts)))
    limits = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(spread, spread * sample // n))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(d, x, np.packbits(spectrum(t)).tobytes()) for d, x, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if _has_letter(t)]
            yield pa.RecordBatch.from_pylist([dict(zip(("draw", "lang", "bits"), r, strict=True)) for r in out], pa.schema([("draw", pa.int64()), ("lang", pa.string()), ("bits", pa.binary())]))

    taken = rows.where(draw < limits[F.col("lang")]).select(draw.alias("draw"), "lang", "text").mapInArrow(pack, "draw long, lang string, bits binary")
    taken = taken.groupBy("draw", "lang").agg(F.first("bits").alias("bits"))
    found = sorted(taken.collect(), key=lambda r: (r["draw"], r["lang"], bytes(r["bits"])))
    if not found:
        return None
    flags = np.unpackbits(np.frombuffer(b"".join(bytes(r["bits"]) for r in found), np.uint8)).reshape(len(found), DIMENSIONS)
    model = fit_spectra(flags, [r["lang"] for r in found])
    del flags, found
    release()
    return model


def predict(docs: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score in front of nothing else changed; only the text is looked at.

    A null text, or one without a letter, is ``und`` with score 0, and so is everything without a model.
    The row's other columns come through whatever they are called; a clash with the two new names replaces them.
    """
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    index = names.index(text_column)
    kept = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches, 4 << 20, text_column):
            langs = np.full(batch.num_rows, "und", dtype=object)
            scores = np.zeros(batch.num_rows)
            texts = batch.column(index).to_pylist()
            read = [i for i, t in enumerate(texts) if t is not None and _has_letter(t)] if model else []
            for k in range(0, len(read), 128):
                part = read[k : k + 128]
                shares = model.scores(np.stack([spectrum(texts[i]) for i in part]))
                best = shares.argmax(1)
                langs[part] = np.array(model.languages, dtype=object)[best]
                scores[part] = shares[np.arange(len(part)), best]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    return kept.mapInArrow(score, schema)
