"""Removal of repeated word windows by recompression.

Recompression shortens a text in rounds. In each, runs of one symbol and pairs of neighbours (a symbol of the left class,
then one of the right, by a bit of their names) become new symbols, whose names are hashes of what they stand for: so
all tasks give equal things equal names without asking each other. A boundary between symbols that a round leaves
depends on the two symbols beside it alone, so on a known stretch of words around it, which grows by a symbol a round.
Where such a stretch lies inside a window the boundary is sure: every equal window, whatever surrounds it, has the same
boundary between the same symbols at the same place. A window's anchor is, of its sure boundaries of the highest level,
the one with the least key.

Windows that follow each other and share an anchor make a phrase; its key names the two high-level symbols at the
anchor, its body all its words. Three Spark rounds then reveal and verify repeats, each over what the one before left:
bodies (found twice, all windows of a phrase are repeats), keys (a body that stands once needs no more if its key
stands once, which for most of a text that repeats nothing ends the search), and the single windows of bodies that
share a key. The words themselves are read again for the last round and to cut.

All three are dealt by hashes of bodies, keys and windows, none by documents, and what one buffer, bucket or group
holds of a body, a key or a window is settled there and sent on as one notice, so a passage that stands in a third of
all documents sends a record a buffer. Places travel as packed records. Bodies and windows are compared by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, materialize, pieces, release
from .substrings import _batch, _blobs, _group_count, _mix, _power_tables, _records, _texts, document_group

#: Words parsed at once, words whose phrases are combined before records leave a task, words whose names a task remembers.
BUFFER, COMBINED, REMEMBERED = 1 << 17, 1 << 20, 200_000
#: Bytes of text of one batch, and of one piece of a long text.
BATCH_BYTES, PIECE = 1 << 20, 1 << 20
#: Rounds of recompression: after 4 a symbol has some 3 words, and a boundary is sure from some 6 words on each side.
LEVELS = 4

PLACE = np.dtype([("doc", "<i8"), ("variant", "<i8"), ("start", "<u4"), ("count", "u1")])
PHRASE = np.dtype([("body", "<u8"), ("body2", "<u8"), ("key", "<u8"), *PLACE.descr])
KEYED = np.dtype([("key", "<u8"), *PLACE.descr])
WINDOW = np.dtype([("body", "<u8"), ("body2", "<u8"), *PLACE.descr])
#: Kinds of records: single ones, notices that there are several, places that are repeats, phrases whose windows are wanted.
ONE, SEVERAL, COVERED, WANTED = range(4)
#: Further away than any word.
FAR = 1 << 40
_ASCII_SPACE = b" \t\n\x0b\x0c\r"
_SPACE = np.zeros(256, bool)
_SPACE[list(_ASCII_SPACE)] = True


class _Names(dict):
    """The 64-bit name of a word; forgets when full, so a large vocabulary does not grow it."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def word_names(text: bytes, names: _Names) -> np.ndarray:
    parts = [np.fromiter(map(names.__getitem__, words), np.uint64, len(words)) for part in pieces(text, PIECE, _ASCII_SPACE) if (words := part.split())]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


class Bodies:
    """128-bit names of stretches of words: polynomials over two values of each word, modulo 2^64, mixed."""

    def __init__(self, names: np.ndarray):
        self.power, inverse = _power_tables(len(names) + 1)
        self.sums = [np.concatenate([[np.uint64(0)], np.cumsum(v * inverse[: len(names)])]) for v in (_mix(names), _mix(names ^ np.uint64(0x9E3779B97F4A7C15)))]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = (ends - starts).astype(np.uint64)
        first, second = (_mix((s[ends] - s[starts]) * self.power[starts] + size) for s in self.sums)
        return first, second


def _compress(symbols: np.ndarray, gone: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Names of the blocks that are left when the boundaries ``gone`` between symbols go; a block is x^k or x^k y^m."""
    first = np.flatnonzero(np.concatenate([[True], ~gone]))
    last = np.append(first[1:], len(symbols)) - 1
    # where x ends within the block
    turn = last + 1
    change = np.flatnonzero(gone & ~same) + 1
    turn[np.searchsorted(first, change, side="right") - 1] = change
    x, y = symbols[first], symbols[last]
    k, m = (turn - first).astype(np.uint64), (last + 1 - turn).astype(np.uint64)
    named = _mix(_mix(x + k * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (y + (m + np.uint64(1)) * np.uint64(0x165667B19E3779F9)))
    return np.where(first == last, x, named)


def boundaries(names: np.ndarray, owner: np.ndarray, levels: int = LEVELS) -> list[tuple[np.ndarray, ...]]:
    """Of each level from 1: place, first and last word of the sure stretch (one behind) and key of the boundaries that are left."""
    n = len(names)
    border = np.ones(n + 1, bool)
    border[1:n] = owner[1:] != owner[:-1]
    at, symbols = np.arange(n + 1), names
    low, high = at, at
    out = []
    for level in range(1, levels + 1):
        left = (_mix(symbols + np.uint64(level)) >> np.uint64(63)) == 0
        same = symbols[:-1] == symbols[1:]
        edge = border[at[1:-1]]
        gone = (same | (left[:-1] & ~left[1:])) & ~edge
        # a boundary is sure where its neighbours are; that a text begins or ends is not seen from inside
        low = np.concatenate([[-FAR], np.where(edge, -FAR, np.minimum(low[:-2], low[1:-1])), [-FAR]])
        high = np.concatenate([[FAR], np.where(edge, FAR, np.maximum(high[1:-1], high[2:])), [FAR]])
        key = np.concatenate([[np.uint64(0)], _mix(_mix(symbols[:-1]) + symbols[1:] * np.uint64(3) + np.uint64(level)), [np.uint64(0)]])
        stay = np.concatenate([[True], ~gone, [True]])
        symbols = _compress(symbols, gone, same)
        at, low, high, key = at[stay], low[stay], high[stay], key[stay]
        sure = (low >= 0) & (high <= n)
        out.append((at[sure], low[sure], high[sure], key[sure]))
    return out


def _least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first : last + 1] for each pair, from a table of least values over spans of powers of two."""
    span = np.frexp((last - first + 1).astype(float))[1] - 1
    out = np.empty(len(first), values.dtype)
    table = values
    for k in range(int(span.max(initial=-1)) + 1):
        here = span == k
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        out[here] = np.minimum(table[first[here]], table[last[here] - (1 << k) + 1])
    return out


def anchors(names: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The place and the key of each window's anchor; ``owner`` is each word's document. A window that reaches into another document has some anchor too.

    Windows without a sure boundary between compressed symbols (inside a run) are their own anchors, with key 0.
    """
    n = len(names)
    anchor, key = np.arange(n - width + 1), np.zeros(n - width + 1, np.uint64)
    open_ = np.arange(n - width + 1)
    low_bits = np.uint64((1 << 24) - 1)
    for at, low, high, keys in reversed(boundaries(names, owner)):
        first = np.searchsorted(low, open_)
        last = np.searchsorted(high, open_ + width, side="right") - 1
        some = last >= first
        # the least key, and of equal ones the first
        least = _least((_mix(keys) & ~low_bits) | np.arange(len(keys), dtype=np.uint64), first[some], last[some])
        found = (least & low_bits).astype(np.int64)
        anchor[open_[some]], key[open_[some]] = at[found], keys[found]
        open_ = open_[~some]
    return anchor, key


def phrases(names: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Phrases of concatenated documents as PHRASE records; ``doc`` is the document's number, ``start`` the first window's place in ``names``."""
    n = len(names)
    if n < width:
        return np.zeros(0, PHRASE)
    anchor, key = anchors(names, owner, width)
    whole = owner[: n - width + 1] == owner[width - 1 :]
    other = (anchor[1:] != anchor[:-1]) | (key[1:] != key[:-1]) | (owner[1 : n - width + 1] != owner[: n - width]) | ~whole[:-1]
    begin = np.flatnonzero(np.concatenate([[True], other]) & whole)
    end = np.flatnonzero(np.concatenate([other | ~whole[1:], [True]]) & whole)
    out = np.zeros(len(begin), PHRASE)
    out["start"], out["count"], out["doc"] = begin, end - begin + 1, owner[begin]
    out["body"], out["body2"] = Bodies(names).of(begin, end + width)
    # inside a run a window's key is the window
    out["key"] = np.where(key[begin] == 0, out["body"], key[begin])
    return out


def _groups_of(rows: np.ndarray, *fields: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows by the fields, each ordered row's group, and the groups' sizes."""
    order = np.lexsort(tuple(rows[f] for f in fields))
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for f in fields:
        x = rows[f][order]
        new[1:] |= x[1:] != x[:-1]
    group = np.cumsum(new) - 1
    return order, group, np.bincount(group) if len(rows) else np.zeros(0, np.int64)


def _only(rows: np.ndarray, dtype: np.dtype) -> np.ndarray:
    out = np.empty(len(rows), dtype)
    for name in dtype.names:
        out[name] = rows[name]
    return out


def _combined(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of records with bodies: those that stand once, one of each that stands more often, and all places of the latter."""
    order, group, size = _groups_of(rows, "body2", "body")
    rows = rows[order]
    often = (size > 1)[group]
    first = np.concatenate([[True], group[1:] != group[:-1]]) if len(rows) else np.zeros(0, bool)
    return rows[~often], rows[often & first], _only(rows[often], PLACE)


def _read(table: pa.Table, dtype: np.dtype, *kinds: int) -> tuple[np.ndarray, ...]:
    of, blobs = table.column("kind").to_pylist(), table.column("records").to_pylist()
    return tuple(_records([b for k, b in zip(of, blobs, strict=True) if k == kind], dtype) for kind in kinds)


def _to_documents(rows: np.ndarray, kind: int, groups: int) -> Iterator[tuple[int, int, bytes]]:
    return _blobs(document_group(rows["doc"], rows["variant"].view(np.uint64), groups), rows, kind)


def _keys_once(rows: np.ndarray, notices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of records of different bodies: those whose key stands once, and those whose key others have too, here or by a notice."""
    order, group, size = _groups_of(rows, "key")
    rows = rows[order]
    shared = (size > 1)[group] | np.isin(rows["key"], notices)
    return rows[~shared], rows[shared]


def _settle_bodies(groups: int) -> Callable:
    """Of one bucket of phrases: places of bodies that stand twice or more; one place of each body, by its key."""

    def settle(table: pa.Table) -> pa.Table:
        one, several, covered = _read(table, PHRASE, ONE, SEVERAL)[:2] + _read(table, PLACE, COVERED)
        rows = np.concatenate([one, several])
        sent = np.concatenate([np.ones(len(one), bool), np.zeros(len(several), bool)])
        order, group, size = _groups_of(rows, "body2", "body")
        rows, sent = rows[order], sent[order]
        noticed = np.zeros(len(size), bool)
        noticed[group[~sent]] = True
        repeat = ((size > 1) | noticed)[group] & sent
        first = np.concatenate([[True], group[1:] != group[:-1]]) if len(rows) else np.zeros(0, bool)
        bodies = _only(rows[first], KEYED)
        once, shared = _keys_once(bodies, np.zeros(0, np.uint64))
        notices = shared[np.unique(shared["key"], return_index=True)[1]]
        bucket = lambda x: (x["key"] % np.uint64(groups)).astype(np.int64)
        release()
        return pa.Table.from_batches([_batch([
            *_to_documents(np.concatenate([covered, _only(rows[repeat], PLACE)]), COVERED, groups), *_to_documents(_only(shared, PLACE), WANTED, groups),
            *_blobs(bucket(once), once, ONE), *_blobs(bucket(notices), notices, SEVERAL),
        ], "g")])

    return settle


def _settle_keys(groups: int) -> Callable:
    """Of one bucket of keys: the places of bodies whose key another body has too."""

    def settle(table: pa.Table) -> pa.Table:
        once, notices = _read(table, KEYED, ONE, SEVERAL)
        return pa.Table.from_batches([_batch(_to_documents(_only(_keys_once(once, notices["key"])[1], PLACE), WANTED, groups), "g")])

    return settle


def _settle_windows(groups: int) -> Callable:
    """Of one bucket of windows: the places of those that stand twice or more."""

    def settle(table: pa.Table) -> pa.Table:
        one, several, covered = _read(table, WINDOW, ONE, SEVERAL)[:2] + _read(table, PLACE, COVERED)
        rows = np.concatenate([one, several])
        sent = np.concatenate([np.ones(len(one), bool), np.zeros(len(several), bool)])
        order, group, size = _groups_of(rows, "body2", "body")
        noticed = np.zeros(len(size), bool)
        noticed[group[~sent[order]]] = True
        repeat = ((size > 1) | noticed)[group] & sent[order]
        return pa.Table.from_batches([_batch(_to_documents(np.concatenate([covered, _only(rows[order][repeat], PLACE)]), COVERED, groups), "g")])

    return settle


def _own(ids: list[int], variants: list[int], places: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its places) of the rows that have places."""
    if not len(places):
        return
    order, group, size = _groups_of(places, "variant", "doc")
    places, ends = places[order], np.cumsum(size)
    first = ends - size
    owners = {(d, v): (i, j) for d, v, i, j in zip(places["doc"][first].tolist(), places["variant"][first].tolist(), first.tolist(), ends.tolist(), strict=True)}
    for k, who in enumerate(zip(ids, variants, strict=True)):
        if span := owners.get(who):
            yield k, places[span[0] : span[1]]


def _kept(text: bytes, places: np.ndarray | None, width: int) -> tuple[int, int, bytes]:
    """(words, removed words, kept words joined by a space) of a text."""
    data = np.frombuffer(text + b" ", np.uint8)
    space = _SPACE[data]
    begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    change = np.zeros(len(begin) + 1, np.int32)
    if places is not None:
        start = places["start"].astype(np.int64)
        np.add.at(change, start, 1)
        np.add.at(change, start + places["count"] + (width - 1), -1)
    stay = np.cumsum(change[:-1]) <= 0
    # the bytes of kept words and the one behind each
    edges = np.zeros(len(data) + 1, np.int8)
    edges[begin[stay]] = 1
    edges[end[stay] + 1] -= 1
    out = np.where(space, np.uint8(32), data)[np.cumsum(edges[:-1]) > 0].tobytes()
    return len(begin), len(begin) - int(stay.sum()), out[:-1]


def remove_repeated_windows(docs: DataFrame, width: int = 35, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and with ``with_text`` kept (string).

    Words are runs of other than ASCII white space, unchanged. Each word goes that a window of ``width`` words covers
    whose word sequence also starts elsewhere, in any document or in the same one; windows lie within one document and
    are judged on the input. A null or empty text has no words (kept is empty); one of fewer than ``width`` words stays
    whole. Rows that repeat a doc_id, or have none, are documents each, so of two equal rows each is the other's copy.
    Other columns have no part. No rows give no rows.
    """
    if not 8 <= width <= 200:
        raise ValueError("width must be from 8 to 200 words")
    # rows of one number and one text are told apart by nothing, and have equal results
    docs = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("number"), F.xxhash64("text").alias("variant"), "text")
    groups = _group_count(docs.select("text"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _Names()
        found: list[np.ndarray] = []
        gathered = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if found:
                one, several, covered = _combined(np.concatenate(found))
                bucket = lambda x: (x["body"] % np.uint64(groups)).astype(np.int64)
                yield _batch([*_blobs(bucket(one), one, ONE), *_blobs(bucket(several), several, SEVERAL), *_to_documents(covered, COVERED, groups)], "bucket")
            found.clear()

        def add(ids: np.ndarray, variants: np.ndarray, texts: list[bytes]) -> int:
            words = [word_names(t, names) for t in texts]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            firsts = np.cumsum(sizes) - sizes
            everything = np.concatenate(words)
            owner = np.repeat(np.arange(len(words)), sizes)
            for at in range(0, max(1, len(everything) - width + 1), BUFFER):
                part = slice(at, at + BUFFER + width - 1)
                rows = phrases(everything[part], owner[part], width)
                doc = rows["doc"].copy()
                rows["start"] = rows["start"].astype(np.int64) + at - firsts[doc]
                rows["doc"], rows["variant"] = ids[doc], variants[doc]
                found.append(rows)
            return len(everything)

        for batch in arrow_rows(batches, BATCH_BYTES, "text"):
            gathered += add(np.array(batch.column(0)), np.array(batch.column(1)), _texts(batch.column(2)))
            if gathered > COMBINED:
                yield from flush()
                gathered = 0
        yield from flush()
        release()

    packed = "kind int, records binary"
    records = docs.select("number", "variant", "text").mapInArrow(parse, f"bucket int, {packed}")
    bodies = materialize(records.groupBy("bucket").applyInArrow(_settle_bodies(groups), f"g int, {packed}"), "bodies")
    keys = bodies.where(F.col("kind").isin(ONE, SEVERAL)).groupBy("g").applyInArrow(_settle_keys(groups), f"g int, {packed}")
    wanted = bodies.where(F.col("kind") == WANTED).union(keys)

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros(0, WINDOW)]
        names = _Names()
        if left.num_rows and right.num_rows:
            texts = left.column("text")
            for k, rows in _own(left.column("number").to_pylist(), left.column("variant").to_pylist(), *_read(right, PLACE, WANTED)):
                body = Bodies(word_names(_texts(texts.slice(k, 1))[0], names))
                count = rows["count"].astype(np.int64)
                single = np.zeros(count.sum(), WINDOW)
                place = np.repeat(rows["start"].astype(np.int64) - (np.cumsum(count) - count), count) + np.arange(len(single))
                # rows that repeat a document ask once
                place = np.unique(place)
                single = single[: len(place)]
                single["doc"], single["variant"], single["start"], single["count"] = rows["doc"][0], rows["variant"][0], place, 1
                single["body"], single["body2"] = body.of(place, place + width)
                found.append(single)
        one, several, covered = _combined(np.concatenate(found))
        bucket = lambda x: (x["body"] % np.uint64(groups)).astype(np.int64)
        release()
        return pa.Table.from_batches([_batch([*_blobs(bucket(one), one, ONE), *_blobs(bucket(several), several, SEVERAL), *_to_documents(covered, COVERED, groups)], "bucket")])

    group = F.pmod(F.xxhash64("number", "variant"), F.lit(groups)).cast("int").alias("g")
    dealt = docs.select("doc_id", "number", "variant", "text", group)
    asked = dealt.drop("doc_id").groupBy("g").cogroup(wanted.groupBy("g")).applyInArrow(windows, f"bucket int, {packed}")
    single = materialize(asked.groupBy("bucket").applyInArrow(_settle_windows(groups), f"g int, {packed}"), "windows")
    covered = bodies.where(F.col("kind") == COVERED).union(single)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, variants, texts = left.column("number").to_pylist(), left.column("variant").to_pylist(), left.column("text")
        places = dict(_own(ids, variants, *_read(right, PLACE, COVERED)))
        counts, removed, digests, kept = [], [], [], []
        for k in range(len(ids)):
            n, gone, out = _kept(_texts(texts.slice(k, 1))[0], places.get(k), width)
            counts.append(n)
            removed.append(gone)
            digests.append(hashlib.sha256(out).hexdigest())
            if with_text:
                kept.append(out.decode())
        release()
        columns = [left.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())] + [pa.array(kept, pa.string())] * with_text
        return pa.table(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("g").cogroup(covered.groupBy("g")).applyInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
w AS (SELECT id, i, sha256(x) AS x FROM (SELECT id, i, array_to_string(ws[i:i + 34], ' ') AS x FROM d, unnest(range(1, len(ws) - 33)) t(i) WHERE len(ws) >= 35)),
s AS (SELECT id, i FROM w JOIN (SELECT x FROM w GROUP BY x HAVING count(*) > 1) USING (x)),
g AS (SELECT id, list(DISTINCT i + k) AS gone FROM s, range(35) t(k) GROUP BY id),
k AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END AS kept FROM d LEFT JOIN g USING (id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
