"""Protection, features, scores and tiers of units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ctxloom.config import Config
from ctxloom.functions import patterns as P
from ctxloom.functions.text import clamped, fingerprint, is_greeting, let, lines, overlap


def protection(kind: Column, text: Column, args: Column, is_open: Column, has_path: Column, active: Column | None = None, cited: Column | None = None, held: Column | None = None, shadowed: Column | None = None) -> Column:
    """(protection, reasons) by rule; ``active`` and ``cited`` are arrays of ledger ids.

    ``active``: ACTIVE entries whose sources the unit holds; ``cited``: ACTIVE ids that its
    text names; ``held``: whether it may be the lost source of an ACTIVE entry; ``shadowed``: the
    nodes that a checkpoint stands for, whose number its reason tells.
    """
    none = F.array().cast("array<string>")
    active, cited = active if active is not None else none, cited if cited is not None else none
    held = held if held is not None else F.lit(False)
    n = F.greatest(F.size(shadowed), F.lit(0)) if shadowed is not None else F.lit(0)
    checkpoint = F.lit("checkpoint") if shadowed is None else F.concat(F.lit("checkpoint of "), n, F.when(n == 1, " node").otherwise(" nodes"))
    by_user, by_model, by_tool = kind == "user", kind == "assistant", kind == "tool-pair"
    p0 = [
        (by_user & text.rlike(P.CONSTRAINT), "user constraint"),
        (by_user & text.rlike(P.CORRECTION), "user correction"),
        (by_user & text.rlike(P.GOAL), "goal"),
        (by_user & text.rlike(P.SAFETY), "safety limit"),
        (by_model & text.rlike(P.GOAL) & text.rlike(P.RESTATED), "restated goal"),
        (F.size(active) > 0, "source of active entry"),
        (F.exists(cited, lambda i: i.rlike("^(DEC|REQ|BLOCK)-")), "names active entry"),
    ]
    p1 = [
        (kind == "checkpoint", checkpoint),
        (by_model & text.rlike(P.DECISION), "decision"),
        (by_model & text.rlike(P.ROOT_CAUSE), "root cause"),
        (by_model & text.rlike(P.VERIFIED), "benchmark result"),
        (by_model & text.rlike(P.KEY_FIX), "key fix"),
        (by_tool & args.rlike(P.CONFIG_PATH) & has_path, "config"),
        (by_tool & text.rlike(P.VERIFIED) & text.rlike(P.EXIT_OK), "benchmark result"),
        (by_tool & text.rlike(P.ROOT_CAUSE), "root cause"),
        (F.exists(cited, lambda i: i.startswith("BENCH-")), "benchmark entry"),
        (held, "unresolved source"),
    ]
    any_of = lambda rules: reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c, _ in rules))
    grade = F.when(is_open, "P0_TRANSIENT").when(any_of(p0), "P0").when(any_of(p1), "P1").otherwise("NORMAL")
    reasons = F.array_distinct(F.array_compact(F.array(*(F.when(c, n) for c, n in p0 + p1))))
    return F.struct(grade.alias("protection"), F.when(is_open, F.array(F.lit("open"))).otherwise(reasons).alias("reasons"))


def content_type(kind: Column, tool: Column, text: Column) -> Column:
    by_name = F.create_map(*(F.lit(x) for pair in P.TOOL_TYPES.items() for x in pair))
    named = F.try_element_at(by_name, F.lower(F.coalesce(tool, F.lit(""))))
    return (
        F.when(kind == "checkpoint", "checkpoint")
        .when(kind == "injected", "injected")
        .when((kind == "user") & is_greeting(text), "greeting")
        .when(kind == "user", "user-request")
        .when(kind == "assistant", "assistant-reasoning")
        .when(named.isNotNull(), named)
        .when(text.rlike(P.GIT_STATUS), "git-status")
        .when(text.rlike(P.GIT_DIFF), "git-diff")
        .when(text.rlike(P.BENCH), "benchmark")
        .when(text.rlike(P.TEST), "test-log")
        .when(text.rlike(P.BUILD) & (F.length(text) > 400), "build-log")
        .otherwise("tool-log")
    )


def of_type(kind: Column, which: int) -> Column:
    """Intrinsic value (0), decay (1) or reconstructibility (2) of a content type; the table is fixed."""
    default = (0.2, P.CONTENT_TYPES["tool-log"][1], 0.3)[which]
    table = F.create_map(*(x for k, v in P.CONTENT_TYPES.items() for x in (F.lit(k), F.lit(v[which]).cast("double"))))
    got = F.try_element_at(table, kind)
    return F.when(F.map_contains_key(table, kind), got).otherwise(F.lit(float(default)))


def recency(turns_after: Column, age_minutes: Column, tau: Column) -> Column:
    turns, minutes = F.greatest(turns_after, F.lit(0)), F.greatest(age_minutes, F.lit(0.0))
    return F.when(tau.isNull(), 1.0).otherwise(0.75 * F.exp(-turns / tau) + 0.25 * F.exp(-minutes / (tau * 30)))


LANES = (("ids", 0.5), ("paths", 0.4), ("symbols", 0.35), ("errors", 0.35), ("models", 0.3))


def relevance(own: Column, asked: Column) -> Column:
    """Share of the asked terms' lanes that a unit's terms meet, each lane once."""
    meets = lambda a, b: F.when(F.size(b) > 0, F.coalesce(F.arrays_overlap(a, b), F.lit(False))).otherwise(False)  # noqa: E731  a lane that isn't asked for isn't made
    score = sum((F.when(meets(own[k], asked[k]), w).otherwise(0.0) for k, w in LANES), F.lit(0.0))
    both = F.array_intersect(own["keywords"], asked["keywords"])
    words = let(both, lambda b: F.when(F.exists(b, lambda k: F.length(k) >= 4), 0.25).when(F.size(b) > 0, 0.1).otherwise(0.0))
    return F.least(F.lit(1.0), score + words)


def dependency(ids: Column, paths: Column, active: Column, cited: Column, state_paths: Column) -> Column:
    upper = F.transform(ids, F.upper)
    low = F.transform(state_paths, F.lower)
    part = lambda a, b, w: F.when(F.coalesce(F.arrays_overlap(a, b), F.lit(False)), w).otherwise(0.0)
    return part(upper, active, 0.5) + part(upper, cited, 0.25) + part(F.transform(paths, F.lower), low, 0.25)


def size_penalty(tokens: Column) -> Column:
    return F.least(F.lit(0.15), 0.02 * F.log2(F.greatest(tokens, F.lit(256)) / 256.0))


#: Long-term value that a reason of a P1 unit lifts it to.
LIFTS = {"decision": 0.98, "benchmark result": 0.85, "benchmark entry": 0.85, "root cause": 0.82, "key fix": 0.8, "config": 0.75, "checkpoint": 0.9}


def intrinsic(kind: Column, grade: Column, reasons: Column) -> Column:
    lifts = F.create_map(*(F.lit(x) for pair in LIFTS.items() for x in pair))
    lifted = F.array_max(F.transform(reasons, lambda r: F.coalesce(F.try_element_at(lifts, F.when(r.startswith("checkpoint"), "checkpoint").otherwise(r)), F.lit(0.0))))
    return F.when(grade == "P1", F.greatest(of_type(kind, 0), F.coalesce(lifted, F.lit(0.0)))).otherwise(of_type(kind, 0))


def with_duplication(units: DataFrame, key: Column, pos: str = "pos", middle: Column | None = None) -> DataFrame:
    """Adds fp, duplication: 1 for a repeated fingerprint, else half the line overlap with
    the last unit of the same key that isn't itself a repeat (none for user and assistant);
    0.8 at least for a read that is neither the first nor the last of its path.

    Lines go through the window as hashes.
    """
    out = units.withColumn("fp", fingerprint("text")).withColumn("_key", key)
    out = out.withColumn("_nth", F.row_number().over(Window.partitionBy("session", "fp").orderBy(pos)))
    repeat = F.col("_nth") > 1
    versions = Window.partitionBy("session", "_key", F.col("_nth") > 1).orderBy(pos)
    hashed = F.array_distinct(F.transform(lines(F.col("text")), lambda x: F.xxhash64(x)))
    out = out.withColumn("_lines", hashed).withColumn("_before", F.lag("_lines").over(versions))
    near = F.when(F.col("kind").isin("user", "assistant") | F.col("_before").isNull(), 0.0).otherwise(0.5 * overlap(F.col("_lines"), F.col("_before")))
    if middle is not None:
        near = F.greatest(near, F.when(middle, 0.8).otherwise(0.0))
    return out.withColumn("duplication", F.when(repeat, 1.0).otherwise(near)).drop("_key", "_nth", "_lines", "_before")


def read_middles(reads: DataFrame) -> DataFrame:
    """Adds middle: of three or more reads of a path, all but the first and the last."""
    by_path = Window.partitionBy("session", "path")
    nth, n = F.row_number().over(by_path.orderBy("pos")), F.count("*").over(by_path)
    return reads.withColumn("_nth", nth).withColumn("_n", n).withColumn("middle", (F.col("_n") >= 3) & (F.col("_nth") > 1) & (F.col("_nth") < F.col("_n"))).drop("_nth", "_n")


def middle_reads(kind: Column, tool: Column, paths: Column, pos: str = "pos") -> Column:
    """Whether a unit is a read that is neither the first nor the last of its path, of three or more."""
    path = F.when((kind == "tool-pair") & (F.lower(F.coalesce(tool, F.lit(""))) == "read"), F.get(paths, 0))
    by_path = Window.partitionBy("session", path)
    nth, n = F.row_number().over(by_path.orderBy(pos)), F.count("*").over(by_path)
    return path.isNotNull() & (n >= 3) & (nth > 1) & (nth < n)


def notes(content_type: Column, value: Column, relevant: Column, recent: Column, turns: Column, minutes: Column, depends: Column, x: Column, duplicate: Column, size: Column) -> Column:
    """Why a unit scores as it does, a line for each feature."""
    tau = of_type(content_type, 1)
    lasts = F.when(tau.isNull(), "∞").otherwise(F.regexp_replace(tau.cast("string"), r"\.0\z", ""))
    two = lambda label, c: F.format_string(label + " %.2f", c)
    return F.array(
        F.concat(two("intrinsic", value), F.lit(" ("), content_type, F.lit(")")),
        two("relevance", relevant),
        F.concat(two("recency", recent), F.format_string(" (age %d turns / %d min, τ=", turns.cast("long"), F.floor(minutes + 0.5)), lasts, F.lit(")")),
        two("dependency", depends),
        two("reconstructibility", x),
        two("duplication", duplicate),
        F.format_string("size penalty %.3f", size),
    )


def unit_score(grade: Column, value: Column, relevant: Column, recent: Column, depends: Column, x: Column, duplicate: Column, size: Column, config: Config = Config()) -> Column:
    s = config.scoring
    base = F.greatest(value, 0.55 * relevant + 0.30 * recent + 0.15 * depends)
    score = clamped(base + 0.10 * depends - s.x_penalty * x - s.duplicate_penalty * duplicate - size, 0, 1)
    return F.when(grade.isin("P0", "P0_TRANSIENT"), 1.0).when(grade == "P1", F.greatest(score, F.lit(0.75))).otherwise(score)


def tier(score: Column, grade: Column, before: Column | None = None, config: Config = Config()) -> Column:
    """Tier of a score; a unit that was HOT or WARM stays so down to the lower threshold."""
    s = config.scoring
    before = before if before is not None else F.lit(None).cast("string")
    return (
        F.when(grade.isin("P0", "P0_TRANSIENT"), "PINNED")
        .when((score >= s.hot_enter) | ((before == "HOT") & (score >= s.hot_leave)), "HOT")
        .when((score >= s.warm_enter) | ((before == "WARM") & (score >= s.warm_leave)), "WARM")
        .when(score >= s.trash_enter, "COLD")
        .otherwise("TRASH")
    )


def census(rows: DataFrame) -> DataFrame:
    """Units and tokens by tier, all five."""
    tiers = rows.sparkSession.createDataFrame([(t,) for t in P.TIERS], "tier string")
    got = rows.groupBy("tier").agg(F.count("*").alias("n_units"), F.sum("tokens").cast("long").alias("tokens"))
    return tiers.join(got, "tier", "left").select("tier", F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))


def tiers_in_force(plans: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(session, first_seq, generation, before): tiers of each session's last plan that still count.

    ``plans`` (session, at, first_seq, tier) and ``surfaces`` (session, at, generation), a row each time
    a surface changed. A plan was made on the generation as of its time, the last change before or at it (0 before
    any); its tiers count while that is the session's present generation. Changes and plans meet in one ordered pass.
    """
    made = plans.groupBy("session", "at").agg(F.collect_list(F.struct("first_seq", "tier")).alias("tiers"))
    line = surfaces.select("session", "at", F.lit(0).alias("kind"), "generation", F.lit(None).cast(made.schema["tiers"].dataType).alias("tiers")).unionByName(made.select("session", "at", F.lit(1).alias("kind"), F.lit(None).cast(surfaces.schema["generation"].dataType).alias("generation"), "tiers"))
    so_far = Window.partitionBy("session").orderBy("at", "kind", "generation").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("session")
    line = line.withColumn("_of", F.coalesce(F.last("generation", ignorenulls=True).over(so_far), F.lit(0)))
    line = line.withColumn("_now", F.max_by("_of", F.struct("at", "kind", "_of")).over(whole)).withColumn("_last", F.max(F.when(F.col("kind") == 1, F.col("at"))).over(whole))
    live = line.where((F.col("kind") == 1) & (F.col("at") == F.col("_last")) & (F.col("_of") == F.col("_now")))
    return live.select("session", F.col("_now").alias("generation"), F.explode("tiers").alias("t")).select("session", "t.first_seq", "generation", F.col("t.tier").alias("before"))
