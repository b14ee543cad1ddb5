"""Requests, compactions and continuations as streams with state by key and timers.

Each processor keeps one bounded row of state by key. Results that a further row could still
change wait for it, or for a timer in event time: when the watermark passes the last row by
``wait_ms``, what is known so far is the result, and the key's state is removed, so keys that end
in silence leave nothing behind. Rows that come twice, a replayed batch for instance, change
nothing while the key's state lives. The batch operators ``budget.request_guard``, ``budget.calibrated_loop`` and
``units.continuation_steps`` give the same rows.

Queries with these need the RocksDB state store, see ``state_store``. A key's rows come in
their own order from batch to batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    """Use the state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _ByKey(StatefulProcessor):
    """One row of state by key, and one timer that is moved on with each batch of its rows."""

    state = ""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.state)

    def rows(self, parts: Iterator[pd.DataFrame], order: str) -> list:
        """A batch's rows of a key in order; the timer is set behind the newest."""
        given = pd.concat(list(parts)).sort_values(order, kind="stable")
        newest = int(given["at_ms"].max())
        for old in list(self.handle.listTimers()):
            newest = max(newest, old - self.wait_ms)
            self.handle.deleteTimer(old)
        self.handle.registerTimer(newest + self.wait_ms)
        given = given.astype(object).where(given.notna(), None)
        return list(given.itertuples(index=False))

    def close(self) -> None:
        pass


def _out(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns).convert_dtypes()


class RequestGuard(_ByKey):
    """See ``request_guard``: the round in hand, and whether the request was answered."""

    state = "round long, projected long, generation long, target long, most long, margin long, retries long, asked long, answered boolean"
    fields = ("round", "projected", "generation", "target", "most", "margin", "retries", "asked")
    columns = ["request", "compactions", "projected", "safe", "max_tokens", "exhausted"]

    @staticmethod
    def fits(r: dict) -> bool:
        return max(r["projected"], 0) + max(r["most"], 1) + max(r["margin"], 0) <= max(r["target"], 1)

    @staticmethod
    def answer(request, r: dict, compactions: int) -> tuple:
        safe = max(0, min(max(1, r["most"]), max(0, r["target"]) - max(0, r["projected"]) - max(0, r["margin"])))
        ask = r["asked"] if r["asked"] > 0 else r["most"]
        return request, compactions, r["projected"], safe, min(ask, safe) if safe > 0 else None, safe <= 0

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = self.held.get() if self.held.exists() else None
        last, answered = (dict(zip(self.fields, got[:-1], strict=True)), bool(got[-1])) if got else (None, False)
        out = []
        for row in self.rows(rows, "round"):
            r = {k: int(getattr(row, k)) for k in self.fields}
            if answered or (last and r["round"] <= last["round"]):
                continue
            if last and r["generation"] <= last["generation"]:  # the compaction before this round changed nothing
                out.append(self.answer(key[0], last, last["round"] + 1))
                answered = True
                continue
            last = r
            if self.fits(r) or r["round"] >= r["retries"]:
                out.append(self.answer(key[0], r, r["round"]))
                answered = True
        self.held.update((*(last[k] for k in self.fields), answered))
        if out:
            yield _out(out, self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        got = self.held.get() if self.held.exists() else None
        self.held.clear()
        if got and not got[-1]:
            last = dict(zip(self.fields, got[:-1], strict=True))
            yield _out([self.answer(key[0], last, last["round"])], self.columns)


def _timed(rows: DataFrame, key: str, processor: _ByKey, kind: str, late: str) -> DataFrame:
    marked = rows.withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    return marked.groupBy(key).transformWithStateInPandas(processor, kind, "Append", "EventTime")


def request_guard(rounds: DataFrame, late: str = "1 minute", wait_ms: int = 600_000) -> DataFrame:
    """``budget.request_guard`` of a stream of rounds, which also have a time ``at``."""
    return _timed(rounds, "request", RequestGuard(wait_ms), "request long, compactions long, projected long, safe long, max_tokens long, exhausted boolean", late)


class CalibratedLoop(_ByKey):
    """See ``calibrated_loop``: the attempts so far, and whether the outcome was told."""

    state = "seen long, told boolean"
    columns = ["session", "outcome", "n_attempts"]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen, told = self.held.get() if self.held.exists() else (0, False)
        out = []
        for r in self.rows(rows, "attempt"):
            if told or r.attempt < seen or r.attempt > r.retries:
                continue
            seen, outcome = int(r.attempt) + 1, None
            if r.attempt == 0 and r.before < r.threshold:
                outcome = ("below", 0)
            elif not r.has_range:
                outcome = ("host", int(r.attempt)) if r.attempt else ("nothing", 0)
            elif r.after < r.threshold:
                outcome = ("compacted", seen)
            elif r.attempt >= r.retries:
                outcome = ("host", seen)
            if outcome:
                out.append((key[0], *outcome))
                told = True
        self.held.update((int(seen), bool(told)))
        if out:
            yield _out(out, self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen, told = self.held.get() if self.held.exists() else (0, True)
        self.held.clear()
        if not told and seen:
            yield _out([(key[0], "host", int(seen))], self.columns)


def calibrated_loop(attempts: DataFrame, late: str = "1 minute", wait_ms: int = 600_000) -> DataFrame:
    """``budget.calibrated_loop`` of a stream of attempts, which also have a time ``at``."""
    return _timed(attempts, "session", CalibratedLoop(wait_ms), "session long, outcome string, n_attempts long", late)


class Continuations(_ByKey):
    """See ``continuations``: the newest event seen, the count of the run and the turn counted last."""

    state = "cursor long, n long, turn long"
    columns = ["session", "event_seq", "n", "continues"]

    def __init__(self, wait_ms: int, cap: int):
        super().__init__(wait_ms)
        self.cap = cap

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        cursor, n, turn = self.held.get() if self.held.exists() else (-1, 0, None)
        out = []
        for r in self.rows(rows, "event_seq"):
            if r.event_seq <= cursor:
                continue
            cursor = int(r.event_seq)
            if r.kind != "max-tokens":
                if r.kind != "user" or r.form != "continuation":
                    n, turn = 0, None
                continue
            if n and r.turn is not None and r.turn == turn:
                continue
            n, turn = min(n + 1, self.cap + 1), None if r.turn is None else int(r.turn)
            out.append((key[0], cursor, n, n <= self.cap))
        self.held.update((cursor, n, turn))
        if out:
            yield _out(out, self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield from ()


def continuations(ends: DataFrame, cap: int = 3, late: str = "1 minute", wait_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """``units.continuation_steps`` of a stream of ends and user messages, which also have a time ``at``."""
    return _timed(ends, "session", Continuations(wait_ms, cap), "session long, event_seq long, n long, continues boolean", late)
