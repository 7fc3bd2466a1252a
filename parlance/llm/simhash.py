"""Near-duplicates by SimHash fingerprints, searched with pivot distance tables.

A fingerprint's Hamming distances to fixed reference fingerprints (pivots) are its row of the pivot table. Two
fingerprints that differ in at most r bits have rows that differ by at most r in every coordinate (triangle
inequality). Within a group, fingerprints are sorted by their distances to the pivot that spreads the group most,
and only those at most r apart there are paired at all; such a pair with a larger difference in another coordinate
is discarded, and survivors are verified on the bits. On bits of chance pivots part too little to deal out a large
corpus by themselves (two rows differ by at most 4 in one coordinate in about half of all pairs), so the groups come
from an exact cover: of BLOCKS blocks of bits, r changed bits leave BLOCKS - r untouched, so linked fingerprints
agree on that many whole blocks; every choice of them is a key. A key with more than TILE fingerprints is dealt to
tiles of pairs of chunks. Only the links of a spanning forest leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, materialize, union_find, with_components

SEED = 42
PIVOTS = 24
BLOCKS = 6
TILE = 2048
#: Rows that a task compares at once; a key's rows are at most TILE.
SWEPT = 1 << 18


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64-bit SimHash of whole UTF-8 text: A-Z lower-cased, white-space-separated words, XXH64 of word shingles.

    Fewer words than a shingle make one shingle of all; no words give zero.
    """
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        digests = xxhash.xxh64_digest(joined, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-shingle] + 1])
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[i:j], SEED) for i, j in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)])
    n = len(digests) // 8
    bits = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(n, 64)
    counts = sum(bits[i : i + 255].sum(0, dtype=np.uint8).astype(np.int64) for i in range(0, n, 255))
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp long) of (doc_id, text), and the long columns ``carried`` as they are; a null text has no words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches, 8 << 20, "text"):
            values = [fingerprint(x.as_buffer().to_pybytes(), shingle) if x.is_valid else 0 for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *carried])

    schema = "doc_id long, fp long" + "".join(f", {c} long" for c in carried)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried).mapInArrow(of, schema)


def pivots(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False)


def sweep(keys: np.ndarray, fps: np.ndarray, references: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Links (a, b) of a spanning forest among the fingerprints of each key, and how many pairs were formed.

    ``keys`` are sorted.
    """
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(begin, len(keys)))
    fps, sizes = fps[np.repeat(sizes > 1, sizes)], sizes[sizes > 1]  # a key's only fingerprint has no pair
    if not len(fps):
        return fps, fps, 0
    table = np.empty((len(references), len(fps)), np.int8)
    for k, reference in enumerate(references):
        table[k] = np.bitwise_count(fps ^ reference)
    # each group in the order of its most spread coordinate
    begin, group = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    wide = table.astype(np.float32)
    spread = np.add.reduceat(wide * wide, begin, axis=1) - np.add.reduceat(wide, begin, axis=1) ** 2 / sizes
    leading = table[spread.argmax(0)[group], np.arange(len(fps))]
    order = np.lexsort((leading, group))
    fps, table, leading = fps[order], table[:, order], leading[order]
    last = np.repeat(begin + sizes, sizes)
    label = np.arange(len(fps))
    first = label.copy()
    found: list[tuple[np.ndarray, np.ndarray]] = []
    pending = formed = 0
    for step in range(1, int(sizes.max())):
        first = first[first + step < last[first]]
        first = first[leading[first + step] - leading[first] <= bits]  # those behind are further away
        if not len(first):
            break
        formed += len(first)
        i = first
        for coordinate in table:
            i = i[np.abs(coordinate[i] - coordinate[i + step]) <= bits]
        i = i[np.bitwise_count(fps[i] ^ fps[i + step]) <= bits]
        if len(i):
            found.append((i, i + step))
            pending += len(i)
        if pending > 200_000:
            label = union_find(label, *(np.concatenate(x) for x in zip(*found, strict=True)))
            found, pending = [], 0
    if found:
        label = union_find(label, *(np.concatenate(x) for x in zip(*found, strict=True)))
    i = np.flatnonzero(label != np.arange(len(fps)))
    return fps[i], fps[label[i]], formed


def _links_in_groups(bits: int, references: np.ndarray):
    """``sweep`` over rows (key, fp) sorted by key, whole keys at a time, SWEPT rows or one key's at once."""

    def some(parts: list[tuple[np.ndarray, np.ndarray]], whole: bool) -> tuple[pa.RecordBatch, list]:
        keys, fps = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        cut = len(keys) if whole else int(np.searchsorted(keys, keys[-1]))
        a, b, _ = sweep(keys[:cut], fps[:cut].view(np.uint64), references, bits)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"]), [(keys[cut:], fps[cut:])]

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if batch.num_rows:
                parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(k) for k, _ in parts) > SWEPT:
                out, parts = some(parts, False)
                yield out
        if parts:
            yield some(parts, True)[0]

    return links


def links(distinct: DataFrame, bits: int = 4) -> DataFrame:
    """(a, b): links that connect what pairs of the distinct ``fp`` within ``bits`` differing bits connect."""
    edges = np.linspace(0, 64, BLOCKS + 1).round().astype(int)
    masks = [((1 << int(hi - lo)) - 1) << int(lo) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    tables = []
    for t, chosen in enumerate(combinations(masks, BLOCKS - bits)):
        mask = sum(chosen)
        mask = mask - (1 << 64) if mask >> 63 else mask
        tables.append(F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(mask).cast("long"))))
    rows = distinct.select(F.explode(F.array(*tables)).alias("key"), "fp")
    hot = materialize(rows.groupBy("key").count().where(F.col("count") > TILE), "hot")
    run = _links_in_groups(bits, pivots())
    if hot.isEmpty():
        return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")
    cold = rows.join(hot, "key", "left_anti").select("key", "fp")
    # a hot key's fingerprints are dealt to chunks, and every pair of chunks is a key of its own
    chunks = F.ceil(F.col("count") / (TILE // 2)).cast("int")
    tiled = rows.join(hot, "key").withColumn("c", F.pmod(F.xxhash64("fp", F.lit(1)), chunks).cast("int"))
    tiled = tiled.select("key", "fp", "c", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("d"))
    tiled = tiled.select(F.xxhash64("key", F.least("c", "d"), F.greatest("c", "d")).alias("key"), "fp")
    return cold.unionByName(tiled).repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, bits: int = 4, shingle: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach).

    A null or empty text has fingerprint zero and links like any other; repeated rows stay; rows with a null
    doc_id keep it and never give a component its id unless all of its rows have none. No rows give no rows.
    """
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = prints.select("fp").distinct()
    out = with_components(prints, links(distinct, bits), "fp", "doc_id")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: What tells rows apart: doc_id (0 where there is none), whether it is missing, and 128 bits of the text.
ROW_KEYS = ["number", "missing", "high", "low"]


def row_keys() -> list:
    """The columns of ROW_KEYS, from doc_id and text; hashes that make no copy of the text."""
    number = F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("number")
    null = F.col("text").isNull().cast("int")
    return [number, F.col("doc_id").isNull().alias("missing"), F.xxhash64(null, "text").alias("high"), F.xxhash64(F.lit("low"), null, "text").alias("low")]


def first_of_groups(docs: DataFrame, bits: int = 4, shingle: int = 4) -> DataFrame:
    """The ROW_KEYS of each component's first row by doc_id (null last) and hash of the text, also where doc_ids are null or repeat."""
    number, missing, *hashes = row_keys()
    prints = materialize(fingerprints(docs.select("doc_id", "text", *hashes), shingle, ("high", "low")), "fingerprints")
    rows = prints.select("fp", F.struct(missing, number, "high", "low").alias("own"))
    found = with_components(rows, links(prints.select("fp").distinct(), bits), "fp", "own")
    return found.where(F.col("own") == F.col("component_id")).select("own.*").distinct()
