"""Leases with attempts: work that is begun, and either completed in time or given back, at most so many times.

State by key in RocksDB: one value (when the open lease began, and how often it ran out) and a list of the times at which
attempts began, which goes out with the row that ends them. A timer in event time ends a lease that nothing else does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOURS, ATTEMPTS = 6, 3
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "user_id long, status string, at timestamp, attempts int, begun array<timestamp>"


class Leases(StatefulProcessor):
    """Of events in order of time: ``begin`` opens a lease if none is open, ``end`` completes it; one that runs out is reset, and after ``attempts`` of these the key is retired, for good."""

    def __init__(self, begin: str, end: str, hours: int = HOURS, attempts: int = ATTEMPTS):
        self.begin, self.end, self.most = begin, end, attempts
        self.span = hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lease", "begun long, failed int")
        self.history = handle.getListState("history", "begun long")

    def _expired(self, key: tuple, begun: int, failed: int, history: list[int]) -> tuple:
        """The row of a lease that ran out; its attempts begin anew only by a completion."""
        return (key[0], "retired" if failed >= self.most else "reset", begun + self.span, failed, history[:])

    def _rows(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        stamp = lambda ms: pd.Timestamp(ms, unit="ms")
        if rows:
            yield pd.DataFrame([(k, s, stamp(t), n, [stamp(b) for b in begun]) for k, s, t, n, begun in rows], columns=["user_id", "status", "at", "attempts", "begun"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # state is read and written once a call, not once an event: every access is a round trip
        stored = self.state.get() if self.state.exists() else None
        begun, failed = opened, _ = stored or (-1, 0)
        history = kept = [b for (b,) in self.history.get()] if stored else []
        out = []
        frames = [x.loc[x["event_type"].isin([self.begin, self.end]), ["ts", "event_id", "event_type"]] for x in rows]
        seen = sorted(zip(*(pd.concat(frames)[c].tolist() for c in ("ts", "event_id", "event_type")), strict=True), key=lambda e: e[:2])
        for ts, _, kind in seen:
            now = int(ts.timestamp() * 1000)
            if begun >= 0 and now - begun > self.span:
                failed += 1
                out.append(self._expired(key, begun, failed, history))
                begun = -1
            if kind == self.begin and begun < 0 and failed < self.most:
                begun = now
                history = [*history, begun]
            elif kind == self.end and begun >= 0:
                out.append((key[0], "completed", now, failed + 1, history))
                history = []
                begun, failed = -1, 0
        if begun != opened:
            if opened >= 0:
                self.handle.deleteTimer(opened + self.span)
            if begun >= 0:
                self.handle.registerTimer(begun + self.span)
        if history != kept:
            if history:
                self.history.put([(b,) for b in history])
            else:
                self.history.clear()
        if (begun, failed) != (-1, 0):
            self.state.update((begun, failed))
        elif stored:
            self.state.clear()
        yield from self._rows(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        begun, failed = self.state.get() if self.state.exists() else (-1, 0)
        # a timer of a lease that has ended meanwhile says nothing
        if begun >= 0 and begun + self.span == expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((-1, failed + 1))
            yield from self._rows([self._expired(key, begun, failed + 1, [b for (b,) in self.history.get()])])

    def close(self) -> None:
        pass


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """The session, with the state store that such processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def lease_attempts(rows: DataFrame, begin: str = "click", end: str = "purchase", hours: int = HOURS, attempts: int = ATTEMPTS, late: str = "1 hour") -> DataFrame:
    """(user_id, status, at, attempts, begun) of a stream (event_id, ts, user_id, event_type): each lease's end, as ``completed``, ``reset`` or ``retired``.

    ``at`` is when it was completed or ran out, ``attempts`` how many there were up to then, ``begun`` when each began.
    A lease still open when the watermark stands before its deadline has no row yet. Needs ``with_rocksdb``.
    """
    # the processor is handed all columns
    watched = rows.select("event_id", "ts", "user_id", "event_type").withWatermark("ts", late).groupBy("user_id")
    return watched.transformWithStateInPandas(Leases(begin, end, hours, attempts), OUTPUT, "append", "EventTime")
