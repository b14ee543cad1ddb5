"""Pressure, segments, ranking, decisions and plan metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ctxloom.config import Config
from ctxloom.functions import patterns as P
from ctxloom.functions.text import clamped, half_up

LADDER = ["tool-prune", "trash-prune", "cold-compact", "warm-compact", "p1-memory", "reduce-output"]


def zone(soft: Column, hard: Column, config: Config = Config()) -> Column:
    p = config.pressure
    return F.when((hard >= 1) | (soft >= p.emergency), "Z5").when(soft >= p.aggressive, "Z4").when(soft >= p.warm_compact, "Z3").when(soft >= p.cold_compact, "Z2").when(soft >= p.soft_gc, "Z1").otherwise("Z0")


def gauges(window: Column, tokens: Column, expected: Column | None = None, requested: Column | None = None, config: Config = Config()) -> Column:
    """Both pressure gauges and the zone, as a struct; null for a window that isn't positive."""
    w = F.floor(window)
    positive = lambda x: F.when(x > 0, F.floor(x + 0.5).cast("double"))
    expect = F.coalesce(positive(expected) if expected is not None else F.lit(None).cast("double"), clamped(w * 0.05, 2048, 16384))
    ask = F.coalesce(positive(requested) if requested is not None else F.lit(None).cast("double"), expect)
    reserve, margin = F.floor(clamped(w * 0.025, 1024, 6144)), F.floor(clamped(w * config.pressure.safety_ratio, 2048, 8192))
    used = F.greatest(F.lit(0), F.floor(F.coalesce(tokens, F.lit(0)) + 0.5))
    soft, hard = F.try_divide(used + expect + reserve, w), F.try_divide(used + ask + margin, w)
    made = F.struct(
        used.cast("long").alias("input_tokens"), expect.alias("expected_output"), reserve.cast("long").alias("reserve"), margin.cast("long").alias("margin"), half_up(soft, 4).alias("soft"), half_up(hard, 4).alias("hard"), zone(soft, hard, config).alias("zone")
    )
    return F.when(w > 0, made)


def min_reclaim(window: Column, config: Config = Config()) -> Column:
    return F.floor(clamped(window * config.compaction.min_ratio, config.compaction.min_tokens, 8192)).cast("long")


def tier_allowed(zone: Column, tier: Column) -> Column:
    """Whether a zone compacts a tier; both tables are fixed and tiny."""
    allowed = F.create_map(*(x for z, tiers in P.ZONE_TIERS.items() for x in (F.lit(z), F.array(*map(F.lit, tiers)) if tiers else F.array().cast("array<string>"))))
    return F.coalesce(F.array_contains(F.try_element_at(allowed, zone), tier), F.lit(False))


def eligible(zone: Column, tier: Column, grade: Column, in_floor: Column) -> Column:
    return ~grade.isin("P0", "P0_TRANSIENT") & ~in_floor & tier_allowed(zone, tier) & ((grade != "P1") | zone.isin("Z4", "Z5"))


def runs(rows: DataFrame, extra: tuple[Column, ...] = (), config: Config = Config()) -> DataFrame:
    """Maximal runs of eligible units, with their gates, and what lies between them, which never passes.

    Rows hold (session, pos, first_seq, last_seq, tokens, score, protection, eligible, zone,
    min_reclaim); ``extra`` are further aggregates by run.
    """
    run = F.sum((~F.col("eligible")).cast("long")).over(Window.partitionBy("session").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = rows.withColumn("_run", run).groupBy("session", "_run", "eligible").agg(
        F.min("pos").alias("first_pos"),
        F.min_by("first_seq", "pos").alias("first_seq"),
        F.max_by("last_seq", "pos").alias("last_seq"),
        F.count("*").alias("n_units"),
        F.sum("tokens").cast("long").alias("tokens"),
        F.coalesce(F.try_divide(F.sum(F.col("score") * F.col("tokens")), F.sum("tokens")), F.lit(0.0)).alias("_loss"),
        F.bool_or(F.col("protection") == "P1").alias("contains_p1"),
        F.first("zone").alias("zone"),
        F.first("min_reclaim").alias("min_reclaim"),
        *extra,
    )
    out = out.withColumn("under_min", (F.col("tokens") < F.col("min_reclaim")) & (F.col("zone") != "Z5")).withColumn("over_cap", F.col("tokens") > config.compaction.max_tokens)
    passes = F.coalesce(F.col("eligible") & ~F.col("under_min") & ~F.col("over_cap"), F.lit(False))
    return out.withColumns({"loss_density": half_up(F.col("_loss"), 4), "priority": half_up(F.col("tokens") * (1 - F.col("_loss")), 2), "passes": passes}).drop("_loss", "_run")


def segments(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """Maximal runs of eligible units, with their gates; rows as for ``runs``."""
    return runs(rows, config=config).where("eligible").select("session", "first_pos", "first_seq", "last_seq", "n_units", "tokens", "loss_density", "priority", "contains_p1", "under_min", "over_cap", "passes")


def ranked(found: DataFrame) -> DataFrame:
    """Passing segments with their rank in the session."""
    order = Window.partitionBy("session").orderBy(F.desc("priority"), F.desc("tokens"), "first_pos")
    return found.where("passes").withColumn("rank", F.row_number().over(order))


def best(found: DataFrame) -> DataFrame:
    return ranked(found).where("rank = 1").drop("rank")


def metrics(rows: DataFrame) -> DataFrame:
    """By session, the gate that each unit meets first, and score statistics."""
    pinned = F.col("protection").isin("P0", "P0_TRANSIENT")
    at_floor, by_tier = ~pinned & F.col("in_floor"), ~pinned & ~F.col("in_floor") & ~tier_allowed(F.col("zone"), F.col("tier"))
    return rows.groupBy("session").agg(
        F.count("*").alias("n_units"),
        F.sum("tokens").cast("long").alias("tokens"),
        F.count_if(F.col("protection") == "P0").alias("n_p0"),
        F.count_if(F.col("protection") == "P0_TRANSIENT").alias("n_p0_transient"),
        F.count_if(F.col("protection") == "P1").alias("n_p1"),
        F.count_if(pinned).alias("by_p0"),
        F.count_if(at_floor).alias("by_floor"),
        F.count_if(by_tier).alias("by_tier"),
        F.count_if(~pinned & ~at_floor & ~by_tier).alias("candidates"),
        half_up(F.avg("score"), 4).alias("avg_score"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
    )


def decision(zone: Column, has_segment: Column) -> Column:
    return F.when(zone == "Z0", "none").when(zone == "Z1", "fresh-prune").when(has_segment, "compact").otherwise("none")


def after_reclaim(window: Column, tokens: Column, expected: Column, reclaim: Column, config: Config = Config()) -> Column:
    """Planned gauges once ``reclaim`` tokens are gone; the hard one uses the expected output."""
    return gauges(window, F.greatest(F.lit(0), tokens - reclaim), expected, expected, config)
