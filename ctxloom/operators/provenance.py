"""Which log rows ledger entries come from: resolution of changed entries, repair of lost sources.

Entries are (batch, file, id, status, raw), a batch being one ledger and its log; log rows are
(batch, seq, text), evidence handles (batch, handle, seq, text). Nothing is bound by guessing:
a quote with a handle must stand in that row, one without must stand in exactly one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxloom.functions.text import collapsed
from ctxloom.operators.ledger import held_once

REF = r"(?im)^\s*[-*]?\s*source_ref\s*[:：]\s*(E\d+)\s*$"
SOURCE = r"(?im)^\s*[-*]?\s*source\s*[:：]\s*(.+)$"
#: Quotes shorter than this bind nothing without a handle, and with one.
LEAST, LEAST_WITH_REF = 12, 2


def _quote(raw: Column) -> Column:
    return collapsed(F.regexp_extract(raw, SOURCE, 1))


def resolved(after: DataFrame, before: DataFrame, rows: DataFrame, refs: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda x: x) -> tuple[DataFrame, DataFrame]:
    """Bindings (batch, seq, entry_id) and failures (batch, entry_id, reason) of entries that changed.

    ``keep`` computes a table once for all that read it (``registry.held``); both results come from one.
    """
    old = before.select("batch", "file", "id", F.col("raw").alias("_old"))
    new = after.join(old, ["batch", "file", "id"], "left").where(~F.col("raw").eqNullSafe(F.col("_old")))
    new = new.select("batch", F.col("id").alias("entry_id"), F.nullif(F.regexp_extract("raw", REF, 1), F.lit("")).alias("ref"), _quote(F.col("raw")).alias("quote"))
    new = keep(new)
    known = refs.select("batch", F.upper("handle").alias("ref"), F.col("seq").alias("ref_seq"), collapsed(F.col("text")).alias("ref_text"), F.lit(True).alias("there"))
    loose = new.where(F.col("ref").isNull() & (F.length("quote") >= LEAST)).select("batch", "quote").distinct()
    out = new.withColumn("ref", F.upper("ref")).join(known, ["batch", "ref"], "left").join(held_once(rows, loose).drop("hit_text"), ["batch", "quote"], "left")
    holds = F.col("ref_seq").isNotNull() & (F.length("quote") >= LEAST_WITH_REF) & F.contains("ref_text", "quote")
    by_ref = F.when(F.coalesce(holds, F.lit(False)), None).when(F.col("there").isNull(), "unknown-ref").when(F.col("ref_seq").isNull(), "unmapped-ref").otherwise("quote-mismatch")
    hits = F.coalesce("hits", F.lit(0))
    by_quote = F.when(F.length("quote") < LEAST, "no-ref").when(hits == 0, "not-found").when(hits > 1, "ambiguous")
    out = out.withColumn("reason", F.when(F.col("ref").isNotNull(), by_ref).otherwise(by_quote))
    out = keep(out.select("batch", F.coalesce("ref_seq", "hit_seq").alias("seq"), "entry_id", "reason"))
    bound = out.where("reason is null").select("batch", "seq", "entry_id").distinct()
    return bound, out.where("reason is not null").select("batch", "entry_id", "reason")


def repaired(after: DataFrame, bound: DataFrame, failed: DataFrame, rows: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """Bindings (batch, seq, entry_id) of ACTIVE entries without one whose stored quote stands in one row.

    What failed in this sync stays failed: looking for it elsewhere would undo the check.
    """
    live = after.where("coalesce(status, 'ACTIVE') = 'ACTIVE'").select("batch", F.col("id").alias("entry_id"), _quote(F.col("raw")).alias("quote")).where(F.length("quote") >= LEAST)
    open_ = live.join(bound.select("batch", "entry_id").distinct(), ["batch", "entry_id"], "left_anti").join(failed.select("batch", "entry_id").distinct(), ["batch", "entry_id"], "left_anti")
    open_ = keep(open_)
    hits = held_once(rows, open_.select("batch", "quote").distinct()).where("hits = 1")
    return open_.join(hits, ["batch", "quote"]).select("batch", F.col("hit_seq").alias("seq"), "entry_id").distinct()
