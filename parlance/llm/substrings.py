"""Removal of long repeated substrings by prefix-free parsing of the corpus.

A rolling hash over every TRIGGER-byte window picks trigger positions: a position is one if its hash is the
least in some stretch of ``length`` bytes that holds it. So equal stretches have equal triggers, whatever
surrounds them, and every stretch of ``length`` bytes has exactly one trigger. Stretches that follow each other
and share a trigger make a phrase; the distinct phrases are the dictionary, and documents are sequences of them.

The parse comes first: phrases, told apart by their trigger's and their own hash, are sorted with their documents,
so that the occurrences of one phrase are neighbours and the earliest document leads. Where a phrase stands in an
earlier document, so do all its stretches. What is left is the dictionary, each phrase with its earliest document.
Phrases that share a trigger with others may still share stretches with these (a repeated passage begins or ends
inside). For them the suffix array of the dictionary is built, by prefix doubling over the bytes, ``length`` deep:
its order is the letters' order, and equal stretches are adjacent. Combined with the parse (the phrases' earliest
documents) it gives the corpus order of all stretches, and each class of equal ones its earliest document. A stretch
never reaches beyond its phrase, so the order of what follows a phrase is not needed.

The dictionary is dealt by triggers, so an array covers the phrases that could share a stretch. Triggers that stand
in very many documents (found in a sample, which affects the dealing alone) would make large groups: their phrases
are dealt by their own hash, and what remains of them by single stretches. What moves is a packed record for each
phrase, of which only the earliest of equal ones in a stretch of input leaves its task, the dictionary's bytes, and
the text twice (to find these bytes and to cut).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, materialize, release

#: Bytes of text that are hashed at once, and that are combined before records leave a task.
BUFFER_BITS = 19
COMBINED = 5 << 20
#: Bytes of stored input for each group of documents and each group of triggers.
GROUP_BYTES = 2 << 20

#: Parts into which the dictionary of a group of triggers is dealt once more, as its suffix array takes some 50 times its bytes.
PARTS = 4
#: Documents of the sample that finds hot triggers, and the least number and share of them that such a one stands in.
SAMPLED, HOT_LEAST, HOT_SHARE = 20_000, 50, 0.005

PLACE = np.dtype([("doc", "<i8"), ("variant", "<u4"), ("start", "<u4"), ("count", "u1")])
RECORD = np.dtype([("trigger", "<u4"), ("item", "<u8"), *PLACE.descr])
EDGE_PLACE = np.dtype([("bucket", "<u4"), *PLACE.descr])
#: Kinds of records: phrases, those of hot triggers, places that are repeats, phrases whose bytes are wanted (in both cases).
SENT, SENT_HOT, COVERED, EDGE, EDGE_HOT = range(5)

_random = np.random.default_rng(20)
_BYTE = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = int(_random.integers(0, 1 << 62)) * 4 + 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if 0 not in _powers or len(_powers[0][0]) < n:
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers[0] = tuple(tables)
    return _powers[0]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)


class Hashes:
    """Hashes of the substrings of a buffer: a polynomial over random values of bytes, modulo 2^64, mixed."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.power, inverse = _power_tables(max(n + 1, (1 << BUFFER_BITS) + 4096))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * inverse[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        return _mix((self.sums[ends] - self.sums[starts]) * self.power[starts])


def phrases(data: np.ndarray, docs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of concatenated documents (``docs``: each byte's document): trigger hash, phrase hash, first stretch, stretches."""
    n = len(data)
    trigger = max(4, length // 2 - 1)
    if n < length:
        return tuple(np.zeros(0, np.uint64) for _ in range(2)) + tuple(np.zeros(0, np.int64) for _ in range(2))
    hashes = Hashes(data)
    grams = hashes.of(slice(0, n - trigger + 1), slice(trigger, n + 1))
    low = np.uint64((1 << (BUFFER_BITS + 1)) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width, span = 1, length - trigger + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    places = (least & low).astype(np.int64)
    whole = docs[: n - length + 1] == docs[length - 1 :]
    begin = np.flatnonzero(np.concatenate([[True], (places[1:] != places[:-1]) | (docs[1 : n - length + 1] != docs[: n - length])]) & whole)
    # a phrase ends where the next begins, or where stretches stop being whole
    stop = np.append(begin[1:], n - length + 1)
    cut = np.flatnonzero(~whole)
    if len(cut):
        at = np.searchsorted(cut, begin)
        stop = np.where(at < len(cut), np.minimum(stop, cut[np.minimum(at, len(cut) - 1)]), stop)
    count = stop - begin
    body = hashes.of(begin, begin + count + length - 1) + count.astype(np.uint64)
    return grams[places[begin]], _mix(body), begin, count


def _xxh64(values: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """XXH64 of 64-bit values."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    h = seed + p5 + np.uint64(8)
    h = h ^ (turn(values * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def document_group(doc_ids: np.ndarray, variants: np.ndarray, groups: int) -> np.ndarray:
    """pmod(xxhash64(doc_id, crc32(text)), groups), as Spark has it."""
    first = _xxh64(doc_ids.astype(np.int64).view(np.uint64), np.full(len(doc_ids), 42, np.uint64))
    return (_xxh64(variants.astype(np.uint64), first).view(np.int64) % groups).astype(np.int32)


def _blobs(keys: np.ndarray, rows: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
    """(key, kind, records field by field) for each key."""
    order = np.argsort(keys, kind="stable")
    keys, rows = keys[order], rows[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=False):
        yield int(keys[i]), kind, b"".join(rows[name][i:j].tobytes() for name in rows.dtype.names)


def _records(blobs: list[bytes], dtype: np.dtype) -> np.ndarray:
    out = np.empty(sum(len(b) for b in blobs) // dtype.itemsize, dtype)
    at = 0
    for blob in blobs:
        n, i = len(blob) // dtype.itemsize, 0
        for name in dtype.names:
            size = dtype[name].itemsize
            out[name][at : at + n] = np.frombuffer(blob, dtype[name], n, i)
            i += n * size
        at += n
    return out


def _batch(rows: Iterator[tuple[int, int, bytes]], name: str) -> pa.RecordBatch:
    keys, kinds, blobs = zip(*rows, strict=True) if (rows := list(rows)) else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], [name, "kind", "records"])


def _places(rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), PLACE)
    for name in PLACE.names:
        out[name] = rows[name]
    return out


def _send(trigger: np.ndarray, item: np.ndarray, doc: np.ndarray, variant: np.ndarray, start: np.ndarray, count: np.ndarray, buckets: int, hot: np.ndarray) -> pa.RecordBatch:
    """Records of a task's phrases to the buckets of their triggers; those with an earlier equal one here are settled."""
    order = np.lexsort((doc, item, trigger))
    t, x = trigger[order], item[order]
    first = np.concatenate([[True], (x[1:] != x[:-1]) | (t[1:] != t[:-1])]) if len(order) else np.zeros(0, bool)
    earliest = np.empty(len(order), np.int64)
    earliest[order] = doc[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(order) else 0
    settled = doc > earliest
    warm = np.isin(trigger, hot)
    bucket = (np.where(warm, _mix(trigger ^ item), trigger) % np.uint64(buckets)).astype(np.int64)
    rows = np.empty(len(doc), RECORD)
    rows["trigger"], rows["item"] = (trigger // np.uint64(buckets)) & np.uint64(0xFFFFFFFF), item
    rows["doc"], rows["variant"], rows["start"], rows["count"] = doc, variant, start, count
    cold, warm = ~settled & ~warm, ~settled & warm
    return _batch([*_blobs(bucket[cold], rows[cold], SENT), *_blobs(bucket[warm], rows[warm], SENT_HOT), *_blobs(bucket[settled], _places(rows[settled]), COVERED)], "bucket")


def _settle_phrases(groups: int) -> Callable:
    """Of one bucket's phrases: those with an earlier equal one, and those of the dictionary that may share a stretch."""

    def settle(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        kinds, blobs = table.column("kind").to_pylist(), table.column("records").to_pylist()
        of = lambda kind, dtype: _records([b for k, b in zip(kinds, blobs, strict=True) if k == kind], dtype)
        covered = [of(COVERED, PLACE)]
        edges = {}
        for kind in (SENT, SENT_HOT):
            rows = of(kind, RECORD)
            edges[kind] = np.zeros(0, EDGE_PLACE)
            if kind == SENT and len(rows):
                order = np.argsort(rows["trigger"], kind="stable")
                trigger = rows["trigger"][order]
                same = np.concatenate([[False], trigger[1:] == trigger[:-1], [False]])
                rows = rows[order[same[1:] | same[:-1]]]  # a trigger that stands once has no match
            if not len(rows):
                continue
            rows = rows[np.lexsort((rows["doc"], rows["item"], rows["trigger"]))]
            new_trigger = np.concatenate([[True], rows["trigger"][1:] != rows["trigger"][:-1]])
            new_item = new_trigger | np.concatenate([[True], rows["item"][1:] != rows["item"][:-1]])
            earliest = rows["doc"][np.maximum.accumulate(np.where(new_item, np.arange(len(rows)), 0))]
            late = rows["doc"] > earliest
            covered.append(_places(rows[late]))
            doubtful = ~late
            if kind == SENT:  # here all phrases of the trigger are at hand
                group = np.cumsum(new_trigger) - 1
                least = np.minimum.reduceat(rows["doc"], np.flatnonzero(new_trigger))
                most = np.maximum.reduceat(rows["doc"], np.flatnonzero(new_trigger))
                items = np.add.reduceat(new_item.astype(np.int64), np.flatnonzero(new_trigger))
                doubtful &= (items > 1)[group] & (most > least)[group]
            out = np.empty(int(doubtful.sum()), EDGE_PLACE)
            out["bucket"] = bucket + groups * (rows["trigger"][doubtful] % PARTS)  # phrases of one trigger stay together
            for name in PLACE.names:
                out[name] = rows[name][doubtful]
            edges[kind] = out
        done = np.concatenate(covered)
        to = lambda rows: document_group(rows["doc"], rows["variant"], groups)
        rows_out = [*_blobs(to(done), done, COVERED), *_blobs(to(edges[SENT]), edges[SENT], EDGE), *_blobs(to(edges[SENT_HOT]), edges[SENT_HOT], EDGE_HOT)]
        release()
        return pa.Table.from_batches([_batch(rows_out, "g")])

    return settle


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Each position's rank in the suffix array of ``data`` cut at ``length`` bytes, by prefix doubling; equal stretches rank alike.

    Ranks of positions with fewer than ``length`` bytes behind them mean nothing.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + n]
    rank, depth = np.unique(word, return_inverse=True)[1].astype(np.int64), 8
    while depth < length:
        step = min(depth, length - depth)
        ahead = np.concatenate([rank[step:], np.zeros(min(step, n), np.int64)])
        rank = np.unique(rank * (int(rank.max()) + 1) + ahead, return_inverse=True)[1].astype(np.int64)
        depth += step
    return rank


def _dictionary_order(groups: int, length: int) -> Callable:
    """Of one part of the dictionary: the runs of stretches that start in an earlier document too."""

    def settle(table: pa.Table) -> pa.Table:
        rows = _records(table.column("records").to_pylist(), PLACE)
        data = np.frombuffer(b"".join(table.column("phrases").to_pylist()), np.uint8)
        count = rows["count"].astype(np.int64)
        size = count + (length - 1)
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        owner = np.repeat(np.arange(len(rows)), count)
        rank = suffix_ranks(data, length)[np.repeat(np.cumsum(size) - size, count) + within]
        doc = rows["doc"][owner]
        order = np.lexsort((doc, rank))
        new = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])
        late = np.empty(len(order), bool)
        late[order] = doc[order] > doc[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        # runs of late stretches of one phrase
        begin = late & np.concatenate([[True], ~late[:-1] | (owner[1:] != owner[:-1])])
        end = late & np.concatenate([~late[1:] | (owner[1:] != owner[:-1]), [True]])
        i, j = np.flatnonzero(begin), np.flatnonzero(end)
        out = _places(rows[owner[i]])
        out["start"] += within[i].astype(np.uint32)
        out["count"] = j - i + 1
        release()
        return pa.Table.from_batches([_batch(_blobs(document_group(out["doc"], out["variant"], groups), out, COVERED), "g")])

    return settle


def _texts(values: pa.Array | pa.ChunkedArray) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in values]


def _group_count(docs: DataFrame) -> int:
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 55:  # unknown
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(min(1 << 20, max(8, size // GROUP_BYTES)))


def _hot_triggers(docs: DataFrame, length: int) -> np.ndarray:
    """Hashes of the triggers that stand in a large share of a sample of the documents."""
    total = docs.count()
    if total < HOT_LEAST:
        return np.zeros(0, np.uint64)

    def triggers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches, 1 << BUFFER_BITS, "text"):
            for text in _texts(batch.column(0)):
                data = np.frombuffer(text, np.uint8)
                found = [phrases(data[i : i + (1 << BUFFER_BITS) + length - 1], np.zeros(min(len(data) - i, (1 << BUFFER_BITS) + length - 1), np.int32), length)[0] for i in range(0, max(1, len(data) - length + 1), 1 << BUFFER_BITS)]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).view(np.int64))], ["trigger"])

    sample = docs.select("text").sample(min(1.0, SAMPLED / total), 1)
    counts = sample.mapInArrow(triggers, "trigger long").groupBy("trigger").count()
    least = max(HOT_LEAST, int(HOT_SHARE * min(total, SAMPLED)))
    found = counts.where(F.col("count") >= least).select("trigger").toArrow().column(0).to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def _dealt(ids: list, texts: list[bytes], table: pa.Table, length: int, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, places, bytes) of the wanted phrases of a group's documents; those of hot triggers stretch by stretch."""
    kinds, blobs = table.column("kind").to_pylist(), table.column("records").to_pylist()
    for kind in (EDGE, EDGE_HOT):
        wanted = _records([b for k, b in zip(kinds, blobs, strict=True) if k == kind], EDGE_PLACE)
        for k, rows in _own(ids, texts, wanted):
            text = texts[k]
            if kind == EDGE_HOT:
                count = rows["count"].astype(np.int64)
                single = np.repeat(rows, count)
                single["start"] += (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint32)
                single["count"] = 1
                rows = single[np.unique(single["start"], return_index=True)[1]]
                rows["bucket"] = _stretch_hashes(np.frombuffer(text, np.uint8), rows["start"].astype(np.int64), length) % np.uint64(buckets * PARTS)
            rows = rows[np.argsort(rows["bucket"], kind="stable")]
            starts = np.flatnonzero(np.concatenate([[True], rows["bucket"][1:] != rows["bucket"][:-1]]))
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
                part = _places(rows[i:j])
                ends = part["start"].astype(np.int64) + part["count"] + (length - 1)
                yield int(rows["bucket"][i]), part, b"".join([text[a:b] for a, b in zip(part["start"].tolist(), ends.tolist(), strict=True)])


def remove_repeats(docs: DataFrame, length: int = 50, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_text`` kept (string).

    Of the UTF-8 bytes of every whole text (null: empty), those in a stretch of ``length`` bytes that also
    starts in a document with a smaller doc_id go; stretches overlap, lie within one document, and are judged
    on the input. Rows of equal doc_id never cost each other a byte; repeated rows have equal results. A null
    doc_id is neither smaller nor larger than others: such rows stay whole and cost nobody a byte. Texts shorter than
    ``length`` stay whole. ``kept`` drops bytes of characters that were cut in two. No rows give no rows. With
    ``with_text`` the other columns of ``docs`` come along, but for those that have one of the result's names.
    """
    if not 16 <= length <= 250:
        raise ValueError("length must be from 16 to 250 bytes")
    result = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    extra = [c for c in docs.columns if c.lower() not in (*result, "text")] if with_text else []
    kinds = [docs.schema[c].dataType.simpleString() for c in extra]
    carried = [f"x{i}" for i in range(len(extra))]
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(f"`{c}`").alias(x) for c, x in zip(extra, carried, strict=True)])
    docs = whole.select("doc_id", "text").where("doc_id IS NOT NULL")
    groups = _group_count(whole.select("doc_id", "text"))
    hot = _hot_triggers(docs, length)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        gathered = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if found:
                yield _send(*(np.concatenate(x) for x in zip(*found, strict=True)), groups, hot)
            found.clear()

        def add(ids: np.ndarray, texts: list[bytes]) -> None:
            variants = np.array([zlib.crc32(t) for t in texts], np.uint32)
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            firsts = np.cumsum(sizes) - sizes
            whole = np.frombuffer(b"".join(texts), np.uint8)
            owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
            step = 1 << BUFFER_BITS
            for at in range(0, max(1, len(whole) - length + 1), step):
                part = slice(at, at + step + length - 1)
                trigger, item, start, count = phrases(whole[part], owner[part], length)
                start = start + at
                doc = owner[start]
                found.append((trigger, item, ids[doc], variants[doc], start - firsts[doc], count))

        for batch in arrow_rows(batches, 1 << BUFFER_BITS, "text"):
            texts = _texts(batch.column(1))
            add(batch.column(0).to_numpy(), texts)
            gathered += sum(map(len, texts))
            if gathered > COMBINED:
                yield from flush()
                gathered = 0
        yield from flush()

    # rows of one doc_id are dealt by their texts too
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0))
    group = F.pmod(F.xxhash64("doc_id", crc), F.lit(groups)).cast("int").alias("g")
    records = docs.mapInArrow(parse, "bucket int, kind int, records binary")
    replies = materialize(records.groupBy("bucket").applyInArrow(_settle_phrases(groups), "g int, kind int, records binary"), "phrases")

    def dictionary(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[int, list] = {}
        if left.num_rows and right.num_rows:
            for bucket, rows, content in _dealt(left.column("doc_id").to_pylist(), _texts(left.column("text")), right, length, groups):
                found.setdefault(bucket, []).append((rows, content))
        columns = list(found), [np.concatenate([r for r, _ in x]) for x in found.values()], [b"".join([c for _, c in x]) for x in found.values()]
        packed = [b"".join(rows[name].tobytes() for name in PLACE.names) for rows in columns[1]]
        return pa.table([pa.array(columns[0], pa.int32()), pa.array(packed, pa.binary()), pa.array(columns[2], pa.binary())], names=["bucket", "records", "phrases"])

    asked = docs.select("doc_id", "text", group).groupBy("g").cogroup(replies.where(F.col("kind").isin(EDGE, EDGE_HOT)).groupBy("g"))
    parts = asked.applyInArrow(dictionary, "bucket int, records binary, phrases binary")
    parts = materialize(parts.groupBy("bucket").applyInArrow(_dictionary_order(groups, length), "g int, kind int, records binary"), "stretches")
    covered = replies.where(F.col("kind") == COVERED).union(parts)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts = left.column("doc_id").to_pylist(), _texts(left.column("text"))
        removed, spans, kept = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), list(texts)
        places = _records(right.column("records").to_pylist(), PLACE)
        for k, rows in _own(ids, texts, places):
            change = np.zeros(len(texts[k]) + 1, np.int32)
            start = rows["start"].astype(np.int64)
            np.add.at(change, start, 1)
            np.add.at(change, start + rows["count"] + (length - 1), -1)
            gone = np.cumsum(change[:-1]) > 0
            removed[k] = gone.sum()
            spans[k] = gone[0] + (gone[1:] & ~gone[:-1]).sum()
            kept[k] = np.frombuffer(texts[k], np.uint8)[~gone].tobytes()
        columns = [
            left.column("doc_id"), pa.array(np.fromiter(map(len, texts), np.int64, len(texts))), pa.array(removed), pa.array(spans),
            pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string()),
        ]
        if with_text:
            null = left.column("text").is_null().to_pylist()
            columns.append(pa.array([None if x else t.decode(errors="ignore") for x, t in zip(null, kept, strict=True)], pa.string()))
            columns += [left.column(x) for x in carried]
        release()
        return pa.table(columns, names=[*result, *carried])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text
    schema += "".join(f", {x} {kind}" for x, kind in zip(carried, kinds, strict=True))
    out = whole.withColumn("g", group).groupBy("g").cogroup(covered.groupBy("g")).applyInArrow(cut, schema)
    return out.withColumnsRenamed(dict(zip(carried, extra, strict=True)))


def _stretch_hashes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The hash of each stretch, equal for equal bytes in any text."""
    power, _ = _power_tables((1 << BUFFER_BITS) + 4096)
    total = np.zeros(len(starts), np.uint64)
    for k in range(length):
        total += _BYTE[data[starts + k]] * power[k]
    return _mix(_mix(total))


def _own(ids: list, texts: list[bytes], places: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its places) of the rows that have places; rows of a null doc_id have none."""
    if not len(places):
        return
    places = places[np.lexsort((places["variant"], places["doc"]))]
    new = np.flatnonzero(np.concatenate([[True], (places["doc"][1:] != places["doc"][:-1]) | (places["variant"][1:] != places["variant"][:-1])]))
    owners = {(d, v): (i, j) for d, v, i, j in zip(places["doc"][new].tolist(), places["variant"][new].tolist(), new.tolist(), [*new[1:].tolist(), len(places)], strict=True)}
    for k, doc in enumerate(ids):
        if doc is not None and (span := owners.get((doc, zlib.crc32(texts[k])))):
            yield k, places[span[0] : span[1]]
