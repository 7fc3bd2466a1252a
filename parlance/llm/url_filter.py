"""URL allow and block lists as a sorted array of digests.

A rule is a host and a path: it fits the host and its subdomains where the url's path starts with the rule's.
The 64-bit XXH64 digests of the rules' strings are a sorted array, memory-mapped from a file. A url's candidate
rules are its host's suffixes, each with the prefixes of its path in the lengths that the list's paths have; a
batch's candidates are digested and found by vectorised binary search. A hit counts only if the stored string
is the candidate, so colliding digests (next to each other in the array) change nothing.

A list of at most SHARD_BYTES is one array, which goes to every worker. A longer one is cut into arrays of that size
by a hash of the strings: each candidate goes to the array that would hold it, and finds its place there in the same
way; the url's best hit is joined back. What a rule fits does not depend on the number of arrays.
"""

from __future__ import annotations

import functools
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, discard, materialize

#: Bytes of rules in one array, and candidates that meet it at once where there are several.
SHARD_BYTES, MET = 32 << 20, 400_000
UPPER, LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEADER = np.dtype([("rules", "<u8"), ("lengths", "<u8"), ("strings", "<u8")])
LOWER = bytes.maketrans(UPPER.encode(), LETTERS.encode())


def parts(url: str | None) -> tuple[str, str]:
    """Host and path: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; then up to ``? #``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return host.encode().translate(LOWER).decode(), rest[:end]


class DigestArray:
    """Rules by digest, in one file: header, path lengths, sorted digests, verdicts, string ends, strings."""

    def __init__(self, path: str):
        self.data = data = np.memmap(path, np.uint8, "r")
        head = data[: HEADER.itemsize].view(HEADER)[0]
        at = HEADER.itemsize

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            out = data[at : at + n * np.dtype(dtype).itemsize].view(dtype)
            at += out.nbytes
            return out

        n = int(head["rules"])
        self.lengths = take("<u8", int(head["lengths"])).tolist()
        self.digests, self.ends, self.verdicts = take("<u8", n), take("<u8", n), take("u1", n)
        self.strings = take("u1", int(head["strings"]))

    @staticmethod
    def build(rules: Iterable[tuple[str, str, str]]) -> bytes:
        """The file's bytes for (host, path, ``allow`` or ``block``) rules; of equal ones, block wins."""
        known: dict[bytes, int] = {}
        lengths = set()
        for host, path, verdict in rules:
            if not host or not path or not path.startswith("/") or verdict not in ("allow", "block"):
                raise ValueError(f"not a rule: {host!r} {path!r} {verdict!r}")
            key = host.encode().translate(LOWER) + path.encode()
            known[key] = max(known.get(key, 0), int(verdict == "block"))
            lengths.add(len(path.encode()))
        return DigestArray.of(known, lengths)

    @staticmethod
    def of(known: dict[bytes, int], lengths: Iterable[int] = ()) -> bytes:
        """The file's bytes for strings of rules and whether they block."""
        lengths = sorted(lengths)
        rows = sorted((xxhash.xxh64_intdigest(k), k, v) for k, v in known.items())
        strings = b"".join(k for _, k, _ in rows)
        head = np.array([(len(rows), len(lengths), len(strings))], HEADER)
        return b"".join([
            head.tobytes(), np.array(lengths, "<u8").tobytes(), np.array([d for d, _, _ in rows], "<u8").tobytes(),
            np.cumsum([len(k) for _, k, _ in rows]).astype("<u8").tobytes(), np.array([v for *_, v in rows], "u1").tobytes(), strings,
        ])

    def string(self, i: int) -> bytes:
        return self.strings[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])].tobytes()

    def find(self, candidates: list[bytes]) -> np.ndarray:
        """Each candidate's place, or -1."""
        keys = np.fromiter(map(xxhash.xxh64_intdigest, candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.digests, keys)
        found = np.full(len(keys), -1)
        for c in np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, max(0, len(self.digests) - 1))] == keys) if len(self.digests) else []):
            i = int(at[c])
            while i < len(self.digests) and self.digests[i] == keys[c]:
                if self.string(i) == candidates[c]:
                    found[c] = i
                    break
                i += 1
        return found


def candidates(host: str, path: str, lengths: list[int]) -> list[bytes]:
    """Strings of the rules that could fit, longest first; of equal length, those of the longer host."""
    raw, steps = path.encode(), host.encode().split(b".")
    lengths = [n for n in lengths if n == len(raw) or n < len(raw) and raw[n] & 0xC0 != 0x80]  # not inside a character
    out = []
    for k in range(len(steps)):
        suffix = b".".join(steps[k:])
        out += [(len(suffix) + n, len(suffix), suffix + raw[:n]) for n in lengths if suffix]
    return [x for *_, x in sorted(out, key=lambda x: (-x[0], -x[1]))]


def mapped(content: bytes) -> DigestArray:
    """The array from a file of this worker's machine, which goes when nothing maps it."""
    with tempfile.NamedTemporaryFile(prefix="parlance-digests-") as file:
        file.write(content)
        file.flush()
        return DigestArray(file.name)


@functools.lru_cache(maxsize=4)
def _mapped(content: bytes) -> DigestArray:
    """One for each Python worker, which keeps it from batch to batch."""
    return mapped(content)


JUDGED = "page_id long, host string, path string, rule string, verdict string"


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, host, path, rule (host and path of the longest that fits, or null), verdict of every row.

    ``rules``: (host, path, verdict), of any number; one without a host, with a path that does not begin with ``/``
    or with another verdict than ``allow`` or ``block`` raises ValueError. Of equal rules, block wins; of equally
    long ones that fit, that of the longer host. A url without a fitting rule is allowed. A null url, or one without
    ``://``, has an empty host and path and is allowed. Repeated rows are judged each on its own.
    """
    pages = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"))
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        if sum(len(h or "") + len(p or "") for h, p, _ in rules) <= SHARD_BYTES:
            return _judge(pages, DigestArray.build(rules))
        rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    rules = rules.select("host", "path", "verdict")
    if wrong := rules.where(~_sound()).limit(1).collect():
        raise ValueError(f"not a rule: {wrong[0]['host']!r} {wrong[0]['path']!r} {wrong[0]['verdict']!r}")
    total = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path"))).first()[0] or 0
    if total <= SHARD_BYTES:
        return _judge(pages, DigestArray.build(tuple(r) for r in rules.collect()))
    return _judge_by_shards(pages, rules, -(-2 * total // SHARD_BYTES))


def _sound() -> Column:
    """Whether a row of rules is one."""
    return F.coalesce((F.col("host") != "") & F.col("path").startswith("/") & F.col("verdict").isin("allow", "block"), F.lit(False))


def _judge(pages: DataFrame, content: bytes) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = _mapped(content)
        for batch in arrow_rows(batches, 4 << 20, "url"):
            split = [parts(u) for u in batch.column(1).to_pylist()]
            tried = [candidates(h, p, array.lengths) for h, p in split]
            flat = [x for t in tried for x in t]
            places = array.find(flat)
            rule, verdict, i = [], [], 0
            for t in tried:
                own = places[i : i + len(t)]
                hit = np.flatnonzero(own >= 0)
                rule.append(t[hit[0]].decode() if len(hit) else None)
                verdict.append("block" if len(hit) and array.verdicts[own[hit[0]]] else "allow")
                i += len(t)
            hosts, paths = zip(*split, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(x), pa.string()) for x in (hosts, paths, rule, verdict))], ["page_id", "host", "path", "rule", "verdict"])

    return pages.mapInArrow(of, JUDGED)


def _judge_by_shards(pages: DataFrame, rules: DataFrame, shards: int) -> DataFrame:
    """The same with ``shards`` arrays, each of which meets the candidates that it would hold, MET or so at a time."""
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")
    lengths = sorted(r[0] for r in rules.select(F.octet_length("path")).distinct().collect())
    key = F.concat(F.translate("host", UPPER, LETTERS), F.col("path")).alias("key")
    known = rules.select(key, (F.col("verdict") == "block").alias("blocks")).groupBy("key").agg(F.max("blocks").alias("blocks"))

    def build(table: pa.Table) -> pa.Table:
        content = DigestArray.of({k.encode(): int(b) for k, b in zip(table.column("key").to_pylist(), table.column("blocks").to_pylist(), strict=True)})
        return pa.table([table.column("shard")[:1], pa.array([content], pa.binary())], names=["shard", "content"])

    arrays = materialize(known.select("*", shard).groupBy("shard").applyInArrow(build, "shard int, content binary"), "digests")

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches, 1 << 20, "url"):
            urls = batch.column(0).to_pylist()
            rows = [(u, i, x.decode()) for u in urls for i, x in enumerate(candidates(*parts(u), lengths))]
            yield pa.RecordBatch.from_pylist([dict(zip(("url", "rank", "key"), r, strict=True)) for r in rows], pa.schema([("url", pa.string()), ("rank", pa.int32()), ("key", pa.string())]))

    asked = pages.where("url IS NOT NULL").select("url").distinct().mapInArrow(tried, "url string, rank int, key string")
    asked = materialize(asked.select("*", shard), "candidates")
    salts = 1 + asked.count() // (shards * MET)
    salted = asked.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(salts)).cast("int"))
    spread = arrays.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"url": pa.array([], pa.string()), "rank": pa.array([], pa.int32()), "key": pa.array([], pa.string()), "blocks": pa.array([], pa.bool_())})
        array = mapped(right.column("content")[0].as_py())
        places = array.find([k.encode() for k in left.column("key").to_pylist()])
        hit = np.flatnonzero(places >= 0)
        rows = left.select(["url", "rank", "key"]).take(pa.array(hit))
        return rows.append_column("blocks", pa.array(array.verdicts[places[hit]] > 0))

    hits = salted.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInArrow(probe, "url string, rank int, key string, blocks boolean")
    best = materialize(hits.groupBy("url").agg(F.min(F.struct("rank", "key", "blocks")).alias("best")), "hits")
    discard(arrays, asked)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches, 4 << 20, "url"):
            hosts, paths = zip(*map(parts, batch.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hosts, pa.string()), pa.array(paths, pa.string())], ["page_id", "url", "host", "path"])

    out = pages.mapInArrow(split, "page_id long, url string, host string, path string").join(best, "url", "left")
    return out.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.when(F.col("best.blocks"), "block").otherwise("allow").alias("verdict"))
