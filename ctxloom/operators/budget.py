"""Request budgets and checks of route settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ctxloom.operators.spread import spread

MARGIN = 2048


def safe_output(target: Column, tokens: Column, asked: Column, margin: Column) -> Column:
    """Output tokens that still fit; never negative."""
    whole = lambda x, least, default: F.greatest(F.lit(least), F.coalesce(x.cast("long"), F.lit(default)))
    return F.greatest(F.lit(0), F.least(whole(asked, 1, 1), whole(target, 1, 0) - whole(tokens, 0, 0) - whole(margin, 0, 0))).cast("long")


def needs_compaction(target: Column, tokens: Column, asked: Column, margin: Column) -> Column:
    return F.greatest(tokens, F.lit(0)) + F.greatest(asked, F.lit(1)) + F.greatest(margin, F.lit(0)) > F.greatest(target, F.lit(1))


def route_budget(window: Column, adapter_most: Column, target: Column, most: Column, margin: Column) -> Column:
    """Budget of a route: its own settings over what the model can do; 0 means unknown."""
    window, adapter_most = (F.when(c > 0, c) for c in (window, adapter_most))
    return F.struct(
        F.least(F.coalesce(target, window, F.lit(0)), F.coalesce(window, F.lit(2**53))).cast("long").alias("target"),
        F.least(F.coalesce(most, adapter_most, F.lit(1)), F.coalesce(adapter_most, F.lit(2**53))).cast("long").alias("most"),
        F.coalesce(margin, F.lit(MARGIN)).cast("long").alias("margin"),
    )


def route_errors(window: Column, adapter_most: Column, s: dict[str, Column]) -> Column:
    """Fields of a route patch that break a rule, in the order of the rules; null settings are absent.

    ``s``: target, most, margin, threshold, retain_ratio, retain, retries, overflow_retries.
    """
    window, adapter_most = F.when(window > 0, window), F.when(adapter_most > 0, adapter_most)
    hard = F.coalesce(window, F.lit(2**53))
    target = F.least(F.coalesce(s["target"], hard), hard)
    margin = F.coalesce(s["margin"], F.lit(MARGIN))
    retain = F.coalesce(s["retain"], F.when(window.isNotNull() | s["target"].isNotNull(), F.floor(target * s["retain_ratio"])))
    rules = [
        *((s[k] < 0, name) for k, name in (("target", "targetContextTokens"), ("most", "maxOutputTokens"), ("margin", "safetyMarginTokens"), ("retain", "retainTokens"), ("retries", "compactionRetries"), ("overflow_retries", "maxOverflowRetries"))),
        ((s["target"] < 1024) | (s["target"] > hard), "targetContextTokens"),
        ((s["most"] < 1) | (s["most"] > F.coalesce(adapter_most, F.lit(2**53))), "maxOutputTokens"),
        ((margin > hard - 1) | (margin >= target), "safetyMarginTokens"),
        (s["most"] > target - margin, "maxOutputTokens"),
        ((s["threshold"] < 0.05) | (s["threshold"] > 0.99), "thresholdRatio"),
        ((s["retain_ratio"] < 0.01) | (s["retain_ratio"] > 0.98), "retainRatio"),
        (s["retries"] > 10, "compactionRetries"),
        (s["overflow_retries"] > 10, "maxOverflowRetries"),
        (retain >= F.floor(target * s["threshold"]), "retainTokens"),
    ]
    return F.array_distinct(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for c, n in rules))))


def route_policy(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """Settings (route, name, value) with those of exactly one provider and model over the general ones.

    ``base`` holds (name, value); ``overrides`` (route, name, value). Each route that is named gets
    every setting.
    """
    routes = overrides.select("route").distinct().withColumn("_one", F.lit(1))
    every = routes.join(F.broadcast(base.withColumn("_one", F.lit(1))), "_one").drop("_one")  # a setting a row
    own = overrides.select("route", "name", F.col("value").alias("_own"))
    return every.join(own, ["route", "name"], "left").select("route", "name", F.coalesce("_own", "value").alias("value"))


def calibrated_spec(window: Column, threshold: Column, retain_ratio: Column, retain: Column, retries: Column) -> Column:
    """When a route is compacted, what stays, and how often it is tried again."""
    kept = F.coalesce(retain, F.floor(window * retain_ratio))
    return F.struct(F.floor(window * threshold).cast("long").alias("threshold_tokens"), kept.cast("long").alias("retain_tokens"), F.coalesce(retries, F.lit(0)).cast("long").alias("retries"))


def request_guard(rounds: DataFrame) -> DataFrame:
    """What a request may still ask for once its session was compacted as often as it helps.

    ``rounds`` (request, round, projected, generation, target, most, margin, retries, asked): the input as
    measured before the first compaction (round 0) and after each. Compaction goes on while the
    request doesn't fit, up to ``retries`` times, and ends where the surface's generation
    stands still; the input counts as of the last round that changed it. An ``asked`` of 0 asks
    for the route's most.
    """
    order = Window.partitionBy("request").orderBy("round")
    fits = ~needs_compaction(F.col("target"), F.col("projected"), F.col("most"), F.col("margin"))
    stuck = F.coalesce(F.lead("generation").over(order) <= F.col("generation"), F.lit(False))
    open_ = spread(rounds, "request").withColumn("fits", fits).withColumn("_stuck", ~F.col("fits") & (F.col("round") < F.col("retries")) & stuck)
    out = rows_until(open_.withColumn("_end", F.col("fits") | (F.col("round") >= F.col("retries")) | F.col("_stuck")))
    spent = F.when(F.col("_stuck"), F.col("round") + 1).otherwise(F.col("round"))
    safe = safe_output(F.col("target"), F.col("projected"), F.col("most"), F.col("margin"))
    ask = F.when(F.col("asked") > 0, F.col("asked")).otherwise(F.col("most"))
    return out.select("request", spent.cast("long").alias("compactions"), "projected", safe.alias("safe"), F.when(safe > 0, F.least(ask, safe)).cast("long").alias("max_tokens"), (safe <= 0).alias("exhausted"))


def rows_until(rounds: DataFrame) -> DataFrame:
    """The first row by request that ``_end`` marks, else the last."""
    nth = F.row_number().over(Window.partitionBy("request").orderBy(F.desc("_end"), F.when(F.col("_end"), F.col("round")).otherwise(-F.col("round"))))
    return rounds.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def overflow_retries(failures: DataFrame, allowed: Column) -> DataFrame:
    """Failed requests (request, attempt, overflow, shrank) with whether each is tried again.

    Only an overflow is, once the surface shrank, and only as often as its own request allows.
    """
    used = F.count_if(F.col("overflow") & F.col("shrank")).over(Window.partitionBy("request").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1))
    return failures.withColumn("retried", F.col("overflow") & F.col("shrank") & (F.coalesce(used, F.lit(0)) < allowed))


def calibrated_loop(attempts: DataFrame) -> DataFrame:
    """How pressure is met: (session, outcome, n_attempts).

    ``attempts`` (session, attempt, before, after, has_range, threshold, retries): tokens before and after
    each range compaction. Nothing is done below the threshold; a first attempt without a range
    ends it; the first that falls below the threshold succeeds; else the host's own way follows.
    """
    first = F.min_by(F.struct("before", "threshold", "has_range", "retries"), "attempt")
    worked = F.min(F.when(F.col("has_range") & (F.col("after") < F.col("threshold")), F.col("attempt")))
    blocked = F.min(F.when(~F.col("has_range"), F.col("attempt")))
    got = attempts.where("attempt <= retries").groupBy("session").agg(first.alias("f"), worked.alias("worked"), blocked.alias("blocked"), F.count("*").alias("n"))
    good = F.col("worked").isNotNull() & (F.col("blocked").isNull() | (F.col("worked") < F.col("blocked")))
    outcome = F.when(F.col("f.before") < F.col("f.threshold"), "below").when(~F.col("f.has_range"), "nothing").when(good, "compacted").otherwise("host")
    tried = F.when(F.col("outcome").isin("below", "nothing"), 0).when(F.col("outcome") == "compacted", F.col("worked") + 1).otherwise(F.coalesce("blocked", "n"))
    return got.withColumn("outcome", outcome).select("session", "outcome", tried.cast("long").alias("n_attempts"))


def newest(rows: DataFrame, order: str, most: int, by: list[str] = []) -> DataFrame:  # noqa: B006  it is never changed
    """The ``most`` newest rows, of each of ``by`` where given: 32 plans, 128 request budgets."""
    if not by:
        return rows.orderBy(F.desc(order)).limit(most)
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("_nth") <= most).drop("_nth")
