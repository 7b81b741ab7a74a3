"""Streaming forms of the latest report and of the fixed-window quota. They are additions: batch forms give the same rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


def latest_reports(stream: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key so far; write with output mode `complete` or `update`."""
    return stream.groupBy(*key).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in key]), F.struct(*order)).alias("r")).select(*key, "r.*")


def quota_decisions(stream: DataFrame, window: int, limit: int, forget: bool = True) -> DataFrame:
    """event_id, user_id, allowed for each request (event_id, user_id, t); requests of a micro-batch are taken in order of t.

    State is one window and count for each user, dropped after two windows without a request unless forget is False
    (a timeout by the clock keeps a query that should end with its input going).
    """

    def decide(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        opened, used = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        allowed = []
        for t in rows["t"].tolist():
            if opened is None or t >= opened + window:
                opened, used = t, 0
            allowed.append(used < limit)
            used += allowed[-1]
        state.update((opened, used))
        if forget:
            state.setTimeoutDuration(max(1, 2 * window // 1000))
        yield rows[["event_id", "user_id"]].assign(allowed=allowed)

    return stream.groupBy("user_id").applyInPandasWithState(decide, "event_id long, user_id long, allowed boolean", "opened long, used int", "append", "ProcessingTimeTimeout" if forget else "NoTimeout")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Keyed(StatefulProcessor):
    """One value for each key, forgotten by a timer when no request has come for `keep` milliseconds of event time (0: never)."""

    def __init__(self, schema: str, keep: int):
        self.schema, self.keep = schema, keep

    def init(self, handle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.schema)
        self.last = handle.getValueState("last", "ms long")

    def step(self, held: tuple | None, row) -> tuple[tuple | None, tuple]:
        """(what is held after a request, the result's values), from what was held, if anything."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows)).sort_values(["t", "event_id"])
        held, last = (tuple(self.value.get()) if self.value.exists() else None), (self.last.get()[0] if self.last.exists() else None)
        out = []
        for row in batch.itertuples(index=False):
            ms = row.t // 1000
            if self.keep and held is not None and last is not None and ms >= last + self.keep:
                held = None  # its time was over, whether or not the watermark has told so yet
            held, values = self.step(held, row)
            last = ms if last is None else max(last, ms)
            out.append((row.event_id, *values))
        if held is not None:
            self.value.update(held)
            self.last.update((last,))
            if self.keep:
                for at in self.handle.listTimers():
                    self.handle.deleteTimer(at)
                self.handle.registerTimer(last + self.keep)
        yield pd.DataFrame(out, columns=["event_id", *self.names])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.value.clear()
        self.last.clear()
        yield pd.DataFrame(columns=["event_id", *self.names])

    def close(self) -> None:
        pass


class _Replay(_Keyed):
    names = ["fate", "first_id"]

    def step(self, held, row):
        if held is None:
            return (row.content, int(row.event_id)), ("first", row.event_id)
        return held, ("replay" if held[0] == row.content else "conflict", held[1])


class _Transitions(_Keyed):
    names = ["applied", "state"]

    def __init__(self, first: str, rules: dict[str, tuple[tuple[str, ...], str]], keep: int):
        super().__init__("state string", keep)
        self.first, self.rules = first, rules

    def step(self, held, row):
        now = self.first if held is None else held[0]
        expected, after = self.rules.get(row.kind, ((), now))
        applied = now in expected
        return (after if applied else now,), (applied, after if applied else now)


def _watermarked(stream: DataFrame, keep: int, delay: str) -> DataFrame:
    return stream.withColumn("at_", F.timestamp_micros("t")).withWatermark("at_", delay) if keep else stream


def replayed_requests(stream: DataFrame, keep: int = 0, delay: str = "1 hour") -> DataFrame:
    """event_id, fate (`first`, `replay`, or `conflict` where the content differs from the first one's), first_id for each request (key, event_id, t, content).

    The first request of a key stays, across batches and restarts, until none has come for `keep` milliseconds; a key that comes back after that is
    new. Content is text and not null. Requests of a key are taken in order within a batch, and a batch's requests of one key are in memory together. The
    session needs the state store ROCKS.
    """
    mode = "EventTime" if keep else "None"
    return _watermarked(stream, keep, delay).groupBy("key").transformWithStateInPandas(_Replay("content string, first_id long", keep), "event_id long, fate string, first_id long", "Append", mode)


def guarded_requests(stream: DataFrame, first: str, rules: dict[str, tuple[tuple[str, ...], str]], keep: int = 0, delay: str = "1 hour") -> DataFrame:
    """event_id, applied, state for each request (key, event_id, t, kind): it applies only in its expected states, as in states.transitions.

    A key's state is kept and forgotten as in replayed_requests; a key without one is in the state `first`.
    """
    mode = "EventTime" if keep else "None"
    return _watermarked(stream, keep, delay).groupBy("key").transformWithStateInPandas(_Transitions(first, rules, keep), "event_id long, applied boolean, state string", "Append", mode)
