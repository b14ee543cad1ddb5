"""Cursors, turn counters, tier memory, history rings and windows as streaming queries.

State is kept by session. Each function takes a streaming frame and returns one; the batch
operators of the same names give the same rows over the whole log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _stateful(df: DataFrame, step, out: str, state: str, mode: str = "append") -> DataFrame:
    return df.groupBy("session").applyInPandasWithState(step, out, state, mode, GroupStateTimeout.NoTimeout)


def _rows(parts: Iterator[pd.DataFrame], order: str = "seq") -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values(order, kind="stable")


def cursor(rows: DataFrame) -> DataFrame:
    """Rows past the last seq seen of their session, once each.

    A session's rows come in order from batch to batch, as its log has them: a row behind the
    cursor was synced before, or belongs to an earlier log, and is not sent again.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -1
        new = _rows(parts)
        new = new[new.seq > last].drop_duplicates("seq")
        if len(new):
            state.update((int(new.seq.max()),))
            yield pd.DataFrame({"session": key[0], "seq": new.seq, "text": new.text})

    return _stateful(rows, step, "session long, seq long, text string", "last long")


def sync_turns(turns: DataFrame, every: int = 5, strict_parity: bool = False) -> DataFrame:
    """Turns at which a session is due: every ``every`` of them, or at once on a goal.

    0 never syncs by count; under strict parity it means every turn.
    """
    step_of = max(1, every) if strict_parity or every else 0

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        due = []
        for seq, goal in _rows(parts)[["seq", "goal"]].itertuples(index=False):
            n += 1
            if goal or (step_of and n >= step_of):
                due.append((key[0], int(seq), "goal" if goal else "count"))
                n = 0
        state.update((n,))
        if due:
            yield pd.DataFrame(due, columns=["session", "seq", "why"])

    return _stateful(turns, step, "session long, seq long, why string", "n long")


def tier_memory(scores: DataFrame, hot: tuple[float, float] = (0.82, 0.70), warm: tuple[float, float] = (0.58, 0.48), trash: float = 0.28) -> DataFrame:
    """Tiers of scored units with hysteresis; a new generation of the surface forgets the old.

    ``scores`` hold (session, seq, generation, unit, score); state is bounded by the units of
    the live generation.
    """

    def place(score: float, before: str | None) -> str:
        if score >= hot[0] or (before == "HOT" and score >= hot[1]):
            return "HOT"
        if score >= warm[0] or (before == "WARM" and score >= warm[1]):
            return "WARM"
        return "COLD" if score >= trash else "TRASH"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        generation, units, tiers = state.get if state.exists else (-1, [], [])
        known, out = dict(zip(units, tiers, strict=True)), []
        for seq, gen, unit, score in _rows(parts)[["seq", "generation", "unit", "score"]].itertuples(index=False):
            if gen != generation:
                generation, known = int(gen), {}
            known[unit] = place(score, known.get(unit))
            out.append((key[0], int(seq), unit, known[unit]))
        state.update((generation, list(known), list(known.values())))
        yield pd.DataFrame(out, columns=["session", "seq", "unit", "tier"])

    return _stateful(scores, step, "session long, seq long, unit string, tier string", "generation long, units array<string>, tiers array<string>")


def history(points: DataFrame, cap: int = 240) -> DataFrame:
    """The ring of a session after each batch: one t twice in a row replaces, the oldest go."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ts, seqs = (list(x) for x in state.get) if state.exists else ([], [])
        for seq, t in _rows(parts)[["seq", "t"]].itertuples(index=False):
            if ts and ts[-1] == t:
                seqs[-1] = int(seq)
            else:
                ts.append(int(t)), seqs.append(int(seq))
        ts, seqs = ts[-cap:], seqs[-cap:]
        state.update((ts, seqs))
        yield pd.DataFrame({"session": [key[0]], "ts": [ts], "seqs": [seqs]})

    return _stateful(points, step, "session long, ts array<long>, seqs array<long>", "ts array<long>, seqs array<long>", "update")


def counts_by_window(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Events and values by type and event-time window; an extension, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("since"), "event_type", "n", "total")


def sessions_by_gap(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Activity sessions that a gap ends; an extension."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("since"), F.col("w.end").alias("until"), "n")


def cached_capabilities(lookups: DataFrame, ttl_ms: int = 15_000) -> DataFrame:
    """Lookups of a route (session), each with the answer that is in force and whether it was fetched anew.

    ``lookups`` hold (session, seq, at_ms, window): what the backend would answer, null if it fails. An
    answer holds for ``ttl_ms``; after that a failed fetch leaves the old one in force, told as stale.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, held = state.get if state.exists else (-1, None)
        out = []
        for seq, now, window in _rows(parts)[["seq", "at_ms", "window"]].itertuples(index=False):
            how = "cached"
            if held is None or now - at >= ttl_ms:
                if pd.isna(window):
                    how = "stale" if held is not None else "none"
                else:
                    at, held, how = int(now), int(window), "fetched"
            out.append((key[0], int(seq), held, how))
        state.update((at, held))
        yield pd.DataFrame(out, columns=["session", "seq", "window", "how"]).astype({"window": "Int64"})

    return _stateful(lookups, step, "session long, seq long, window long, how string", "at long, window long")
