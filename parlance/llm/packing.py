"""Best-fit packing of token sequences by hierarchical residual packing.

Every input partition tokenizes its documents, cuts those that are longer than a sequence and packs the pieces
by best fit, largest first. Sequences that are full or nearly so are final. The others are items of the next
round: a node of the merge tree takes the open sequences of ``FAN_IN`` nodes and packs them by best fit again,
up to a single root. Open sequences of one node and one fill are interchangeable, so a node sees them as
counts by fill: at most ``capacity`` rows for a child, whatever the number of documents. The documents' rows
never move through the tree; they are joined with the final places of the open sequences at the end.
"""

from __future__ import annotations

import functools
import math
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, materialize

FAN_IN = 16
#: Free tokens up to which a sequence is final.
NEARLY_FULL = 8
#: A sequence's number: 4 bits of level, 24 of node, 35 of its place in the node.
NODE_BITS, PLACE_BITS = 24, 35
#: Words whose ids a worker remembers; beyond it starts anew.
CACHED_WORDS = 250_000
#: The same for words without the marks that end them.
CACHED_STEMS = 500_000
#: Marks at a word's end that the pre-tokenizer parts from a letter or digit before them, though not from other marks.
TAILS = ".,!*$#%&"
#: Letters whose lower case is one letter too and that no normalization changes.
LATIN = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0134-\u0148\u014a-\u017e]+")
#: A word that no other text runs into and that is one id.
MARK = "0"

PIECES = "row_key long, doc_id long, piece int, start long, length long, ids_crc32 long, leaf long, fill long, place long, offset long, closed boolean"


class WordIds:
    """Ids of texts, by way of their white-space-separated words, each of which is encoded once.

    Valid for a tokenizer that drops white space, whose normalizer and merges do not reach across it, and whose
    pre-tokenizer parts letters from other characters. Words of Latin letters skip the normalizer and the
    pre-tokenizer: for them these only lower the case and spell the bytes. Others take the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for tokenizer in (self.whole, self.letters):
            tokenizer.no_truncation()
            tokenizer.no_padding()
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        spell = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.spelt = {c: "".join(spell[b] for b in chr(c).encode()) for c in range(128, 384)}
        mark = self.encode(self.whole, MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        self.words: dict[bytes, bytes] = {}
        self.stems: dict[str, bytes] = {}

    @staticmethod
    def encode(tokenizer, text: str) -> list[int]:
        return tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def many(self, tokenizer, words: list[str], table: dict[int, str]) -> None:
        """Into ``stems``: many words in one call, parted by MARK; ``table`` spells them for the tokenizer."""
        for i in range(0, len(words), 4000):
            part = words[i : i + 4000]
            text = f" {MARK} ".join([*part, ""])
            ids = np.array(self.encode(tokenizer, text.lower().translate(table) if table else text), dtype="<u4")
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) != len(part):
                raise ValueError("the tokenizer does not keep words apart")
            raw, ends = ids.tobytes(), (4 * ends).tolist()
            self.stems.update(zip(part, [raw[i:j] for i, j in zip([0, *[e + 4 for e in ends]], ends)]))  # noqa: B905  one more begins

    def learn(self, words: list[bytes]) -> None:
        if len(self.words) + len(words) > CACHED_WORDS:
            self.words.clear()
        if len(self.stems) > CACHED_STEMS:
            self.stems.clear()
        texts = b"\n".join(words).decode().split("\n")
        stems = [text.rstrip(TAILS) for text in texts]
        # after anything but a letter or digit, the tail is of one piece with what stands before it
        stems = [s if s[-1:].isascii() and s[-1:].isalnum() or LATIN.fullmatch(s[-1:]) else text for s, text in zip(stems, texts, strict=True)]
        new = set(stems) - self.stems.keys()
        latin = [s for s in new if s.isalpha() and (s.isascii() or LATIN.fullmatch(s))]
        self.many(self.letters, [s for s in latin if s.isascii() and s.islower()], {})
        self.many(self.letters, [s for s in latin if not (s.isascii() and s.islower())], self.spelt)
        new.difference_update(latin)
        new.update(text[len(stem) :] for text, stem in zip(texts, stems, strict=True))
        new -= self.stems.keys()
        for word in [w for w in new if self.mark is None or MARK in w or "<|" in w or not w.isascii()]:
            self.stems[word] = np.array(self.encode(self.whole, word), dtype="<u4").tobytes()
            new.discard(word)
        self.many(self.whole, list(new - {""}), {})
        known, self.stems[""] = self.stems, b""
        self.words.update(zip(words, [known[s] + known[t[len(s) :]] for t, s in zip(texts, stems, strict=True)], strict=True))

    def __call__(self, texts: list[bytes]) -> Iterator[bytes]:
        """Each text's ids, little-endian unsigned 32-bit."""
        # A-Z in lower case at once makes fewer words; not before a combining mark, which may join them, nor where
        # it could make a special token
        split = [(text if b"\xcc" in text or b"\xcd" in text or b"<|" in text else text.lower()).split() for text in texts]
        new: set[bytes] = set()
        for words in split:
            new.update(words)
        missing = new - self.words.keys()
        if missing and len(self.words) + len(missing) > CACHED_WORDS:
            missing = new
        if missing:
            self.learn(list(missing))
        known = self.words
        for words in split:
            yield b"".join([known[w] for w in words])


@functools.cache
def _word_ids(path: str) -> WordIds:
    """One for each Python worker, which keeps it from task to task."""
    return WordIds(path)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each item's bin, its offset there, and the bins' fills: best fit over items from long to short."""
    bins, offsets, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free tokens
    mask = 0  # bit f: a bin with f free tokens is open
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = sizes[i]
        fitting = mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            own = open_bins[free].pop()
            if not open_bins[free]:
                mask ^= 1 << free
        else:
            free, own = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = own, fills[own]
        fills[own] += size
        free -= size
        if free:
            open_bins[free].append(own)
            mask |= 1 << free
    return bins, offsets, np.array(fills, np.int64)


def merge_classes(fills: list[int], counts: list[int], capacity: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Pack ``counts[i]`` items of ``fills[i]`` by best fit, alike items at once.

    Returns patterns (fill, copies, [(class, first rank)]): in each, copy c holds the item of rank first + c of
    every class listed, one after the other.
    """
    patterns: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    frees: list[int] = []
    used = [0] * len(fills)

    def put(free: int, copies: int, members: list[tuple[int, int]]) -> None:
        if copies:
            if free not in patterns:
                patterns[free] = []
                insort(frees, free)
            patterns[free].append((copies, members))

    for i in sorted(range(len(fills)), key=lambda i: (-fills[i], i)):
        size, left = fills[i], counts[i]
        while left:
            at = bisect_left(frees, size)
            if at < len(frees):
                free = frees[at]
                copies, members = patterns[free].pop()
                if not patterns[free]:
                    del patterns[free], frees[at]
                k = min(left, copies)
                put(free - size, k, [*members, (i, used[i])])
                put(free, copies - k, [(c, first + k) for c, first in members])
            else:
                each = min(capacity // size, left)
                k = left // each
                members = [(i, used[i] + j * k) for j in range(each)]
                put(capacity - size * each, k, members)
                k *= each
                used[i] += k
                left -= k
                continue
            used[i] += k
            left -= k
    return [(capacity - free, copies, members) for free in sorted(patterns) for copies, members in patterns[free]]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    capacity: int = 4096,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty and makes a piece of the end id alone. A document with more than ``capacity`` ids is
    cut into pieces of ``capacity``. Repeated rows are packed each on its own. An empty table gives no rows.
    Other columns of ``docs`` are ignored.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _word_ids(tokenizer_path)
        last = np.array([end_id], dtype="<u4").tobytes()
        leaf = TaskContext.get().partitionId()
        rows: list[tuple] = []
        number = 0
        for batch in arrow_rows(batches, 8 << 20, "text"):
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(1)]
            for doc_id, raw in zip(batch.column(0).to_pylist(), ids_of(texts), strict=True):
                raw += last
                for k in range(0, len(raw), 4 * capacity):
                    part = raw[k : k + 4 * capacity]
                    rows.append((number, doc_id, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
                number += 1
        if not rows:
            return
        keys, doc_ids, pieces, starts, lengths, crcs = (list(x) for x in zip(*rows, strict=True))
        bins, offsets, fills = best_fit(np.array(lengths, np.int64), capacity)
        closed = capacity - fills <= NEARLY_FULL
        place = np.arange(len(fills), dtype=np.int64)
        order = np.flatnonzero(~closed)[np.argsort(fills[~closed], kind="stable")]
        if len(order):  # an open one's place is its rank among those of its fill
            _, first, counts = np.unique(fills[order], return_index=True, return_counts=True)
            place[order] = np.arange(len(order)) - np.repeat(first, counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys, pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()),
                pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64()), pa.array(np.full(len(bins), leaf), pa.int64()),
                pa.array(fills[bins]), pa.array(place[bins]), pa.array(offsets), pa.array(closed[bins]),
            ],
            ["row_key", "doc_id", "piece", "start", "length", "ids_crc32", "leaf", "fill", "place", "offset", "closed"],
        )

    pieces = materialize(docs.mapInArrow(leaves, PIECES), "pieces")
    final = pieces.where("closed").select(
        "doc_id", "piece", "start", "length", "ids_crc32", _sequence_number(0, F.col("leaf"), F.col("place")).alias("sequence_id"), "offset"
    )
    places = _tree(pieces, capacity)
    if places is None:
        return final
    opened = pieces.where("not closed").alias("p").join(
        places.alias("t"),
        (F.col("p.leaf") == F.col("t.leaf")) & (F.col("p.fill") == F.col("t.fill")) & (F.col("p.place") >= F.col("t.lo")) & (F.col("p.place") < F.col("t.hi")),
    )
    opened = opened.select(
        "p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32",
        (F.col("t.base") + F.col("p.place") - F.col("t.lo")).alias("sequence_id"), (F.col("p.offset") + F.col("t.delta")).alias("offset"),
    )
    return final.unionByName(opened)


def _sequence_number(level: int, node, place):
    return F.lit(level << (NODE_BITS + PLACE_BITS)) + F.shiftleft(node.cast("long"), PLACE_BITS) + place


def _merger(level: int, root: bool, capacity: int):
    """The best-fit round of one node of the merge tree, over its children's open sequences by fill."""

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        node = int(key[0])
        group = group.sort_values(["fill", "child"], ascending=[False, True])
        child, fill = group["child"].tolist(), group["fill"].tolist()
        place, ranks, out = 0, {}, []
        for total, copies, members in merge_classes(fill, group["n"].tolist(), capacity):
            closed = root or capacity - total <= NEARLY_FULL
            if closed:
                base = (level << (NODE_BITS + PLACE_BITS)) + (node << PLACE_BITS) + place
                place += copies
            else:
                base = ranks.get(total, 0)
                ranks[total] = base + copies
            delta = 0
            for c, first in members:
                out.append((child[c], fill[c], first, first + copies, node, total, base, delta, closed))
                delta += fill[c]
        return pd.DataFrame(out, columns=["child", "fill", "lo", "hi", "node", "total", "base", "delta", "closed"])

    return merge


def _tree(pieces: DataFrame, capacity: int) -> DataFrame | None:
    """Final places of the leaves' open sequences: (leaf, fill, ranks lo to hi) begin at number base, offset delta."""
    # place counts from 0 in every (leaf, fill), so the largest place tells how many there are
    classes = pieces.where("not closed").groupBy(F.col("leaf").alias("child"), "fill").agg((F.max("place") + 1).alias("n"))
    top = pieces.agg(F.max("leaf")).first()[0]
    if top is None or pieces.where("not closed").isEmpty():
        return None
    levels = max(1, math.ceil(math.log(top + 1, FAN_IN) - 1e-9)) if top else 1
    open_at: DataFrame | None = None  # (leaf, fill, lo, hi) are now the open ones (child, own_fill) from rank own_lo
    done: list[DataFrame] = []
    for level in range(1, levels + 1):
        root = level == levels
        moves = classes.groupBy((F.floor(F.col("child") / FAN_IN)).cast("long").alias("node")).applyInPandas(
            _merger(level, root, capacity), "child long, fill long, lo long, hi long, node long, total long, base long, delta long, closed boolean"
        )
        moves = materialize(moves, "moves")
        if open_at is None:
            mapped = moves.select(F.col("child").alias("leaf"), "fill", "lo", "hi", "node", "total", "base", "delta", "closed")
        else:
            o, m = open_at.alias("o"), moves.alias("m")
            # the ranks that an open range and a move have in common
            begin = F.greatest(F.col("o.own_lo"), F.col("m.lo"))
            end = F.least(F.col("o.own_lo") + F.col("o.hi") - F.col("o.lo"), F.col("m.hi"))
            mapped = (
                o.join(m, (F.col("o.child") == F.col("m.child")) & (F.col("o.own_fill") == F.col("m.fill")) & (begin < end))
                .select(
                    "o.leaf", "o.fill", (F.col("o.lo") + begin - F.col("o.own_lo")).alias("lo"), (F.col("o.lo") + end - F.col("o.own_lo")).alias("hi"),
                    "m.node", "m.total", (F.col("m.base") + begin - F.col("m.lo")).alias("base"), (F.col("o.delta") + F.col("m.delta")).alias("delta"), "m.closed",
                )
            )
            mapped = materialize(mapped, "mapped")
        done.append(mapped.where("closed").select("leaf", "fill", "lo", "hi", "base", "delta"))
        open_at = mapped.where("not closed").select("leaf", "fill", "lo", "hi", F.col("node").alias("child"), F.col("total").alias("own_fill"), F.col("base").alias("own_lo"), "delta")
        classes = moves.where("not closed").groupBy(F.col("node").alias("child"), F.col("total").alias("fill")).agg(F.max(F.col("base") + F.col("hi") - F.col("lo")).alias("n"))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out
