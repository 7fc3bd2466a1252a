"""Quality classification by compression: which of two zstandard dictionaries shortens a text more.

One dictionary is built from good and one from bad labelled text. A text is compressed with either, whole and block by
block; the normalised differences of the two compressed sizes, and nothing else, are the signal. A logistic regression
on labelled rows that no dictionary has seen turns them into a probability of the good label.
"""

from __future__ import annotations

import functools
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, discard, materialize

#: The fit's bounds: rows of either label (half for dictionaries, half for calibration), bytes of text that teach a
#: dictionary (whole texts as long as they fit, the first one whatever its size), its bytes, and the compression level.
SAMPLE, TAUGHT_BYTES, DICTIONARY, LEVEL = 3000, 8 << 20, 112_640, 3
#: Bytes of a block; a text's blocks are looked at one by one, so that a bad part of a good text shows, and the points
#: of the order of their differences that are looked at.
BLOCK, POINTS = 128, np.array([0, 0.5, 1])


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    spread: tuple[float, ...]
    coefficients: tuple[float, ...]

    def score(self, features: np.ndarray) -> np.ndarray:
        z = (features - np.array(self.mean)) / np.array(self.spread)
        w = np.array(self.coefficients)
        return 1 / (1 + np.exp(-np.clip(z @ w[1:] + w[0], -30, 30)))


@functools.lru_cache(maxsize=4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, level=LEVEL, write_content_size=False, write_dict_id=False)


def features(texts: list[bytes], good: bytes, bad: bytes) -> np.ndarray:
    """Of each whole text: differences of the compressed sizes, of the text itself and at ``POINTS`` of its blocks' order.

    A difference is normalised twice: by the text's or block's size and by the two compressed sizes. The text's own comes
    as its root too. A text or block of few bytes counts 40 more. An empty text has no difference and is not compressed.
    """
    better, worse = _compressor(good), _compressor(bad)
    out = np.zeros((len(texts), 3 + 2 * len(POINTS)))
    for i, text in enumerate(texts):
        if n := len(text):
            small, other = np.array([(len(better.compress(b)), len(worse.compress(b))) for b in (text[k : k + BLOCK] for k in range(0, n, BLOCK))], np.float64).T
            size = np.full(len(small), float(BLOCK))
            size[-1] = n - BLOCK * (len(small) - 1)
            orders = np.sort([(other - small) / (size + 40), (other - small) / (other + small)], axis=1)
            own, opposite = len(better.compress(text)), len(worse.compress(text))
            gap = (opposite - own) / (n + 40)
            at = POINTS * (len(small) - 1)
            low = at.astype(int)
            high = np.minimum(low + 1, len(small) - 1)
            out[i, :3] = gap, np.sign(gap) * np.sqrt(abs(gap)), (opposite - own) / (opposite + own)
            out[i, 3:] = (orders[:, low] + (orders[:, high] - orders[:, low]) * (at - low)).ravel()
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.03) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the first coefficient is the constant."""
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w += step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary from all of the texts, or where its trainer can't make one as many evenly spaced pieces of them as fit."""
    content = b"\n".join(texts)
    pieces = [content[i : i + 2048] for i in range(0, len(content), 2048)]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces[:: -(-len(content) // DICTIONARY) or 1]) or b"\n" * 8


def fit_features(x: np.ndarray, y: np.ndarray, share: float, good: bytes, bad: bytes) -> Model:
    """Calibration on features of labelled rows; ``share``: of good ones among all labelled rows."""
    weight = np.where(y == 1, share / max(1, int((y == 1).sum())), (1 - share) / max(1, int((y == 0).sum()))) * len(y)
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-9)
    w = _logistic((x - mean) / spread, y, weight)
    return Model(good, bad, tuple(mean), tuple(spread), tuple(w))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality 0 or 1).

    Rows of another quality, and those without a text, teach nothing; texts of any length do. About ``sample`` ids of
    either label are drawn by a hash of doc_id (so few ids join the documents by broadcast), and of their rows the
    first ``sample`` by a hash of doc_id and text; equal rows count once. Half teach the dictionaries, half calibrate,
    which happens where the rows are: only a row's features come to the driver. None, with a warning, unless
    both labels have texts.
    """
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("own_id"), "quality").distinct()
    counts = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    spread = 1 << 40
    draw = F.pmod(F.xxhash64(F.lit("quality"), F.col("own_id").cast("string")), F.lit(spread))
    limit = F.when(F.col("quality") == 1, min(spread, spread * sample // counts.get(1, 1))).otherwise(min(spread, spread * sample // counts.get(0, 1)))
    drawn = rows.where(draw < limit)
    texts = docs.select("doc_id", "text").where(F.octet_length("text") > 0)
    found = texts.join(F.broadcast(drawn), F.col("doc_id") == F.col("own_id"))
    found = materialize(found.select("quality", F.xxhash64(F.lit("row"), F.col("own_id").cast("string"), "text").alias("draw"), "text"), "labelled")
    sizes = found.groupBy("quality", "draw").agg(F.max(F.octet_length("text")).alias("n"))
    taught, rest, half = {}, {}, {}
    for q in (0, 1):
        own = sizes.where(F.col("quality") == q).orderBy("draw").limit(sample).collect()
        half[q] = max(1, len(own) // 2)
        fitting = np.flatnonzero(np.cumsum([r["n"] for r in own[: half[q]]]) <= TAUGHT_BYTES)
        taught[q] = [r["draw"] for r in own[: max(1, len(fitting))]]
        rest[q] = [r["draw"] for r in own[half[q] :]] or taught[q]
    if not taught[0] or not taught[1]:
        warnings.warn("no quality model: some label has no text", stacklevel=2)
        return None
    among = lambda q, draws: (F.col("quality") == q) & F.col("draw").between(draws[0], draws[-1])
    content = {}
    for q in (0, 1):
        own = found.where(among(q, taught[q])).dropDuplicates(["draw"]).orderBy("draw").select("text").toArrow()
        content[q] = dictionary([x.as_buffer().to_pybytes() for x in own.column(0)])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches, 8 << 20, "text"):
            x = features([t.as_buffer().to_pybytes() for t in batch.column(2)], content[1], content[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], ["quality", "draw", "x"])

    seen = found.where(among(0, rest[0]) | among(1, rest[1])).mapInArrow(measured, "quality int, draw long, x array<double>")
    seen = sorted(seen.dropDuplicates(["quality", "draw"]).collect())
    discard(found)
    return fit_features(np.array([r["x"] for r in seen]), np.array([float(r["quality"]) for r in seen]), counts[1] / (counts[0] + counts[1]), content[1], content[0])


def score(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text: 0 to 1, higher if the good label is likelier.

    A null text is empty; an empty one scores as a text whose sizes do not differ. Without a model: 0.5.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches, 8 << 20, "text"):
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(1)]
            out = model.score(features(texts, model.good, model.bad)) if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(of, "doc_id long, score double")
