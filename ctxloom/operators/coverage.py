"""Summaries against the facts they must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ctxloom.operators.contains import contained

P0_LEAST, P1_LEAST = 1.0, 0.99
#: What is tried in turn when a summary loses a fact.
RETRIES = ["generate", "retry", "shrink-region", "cancel"]


def covered(facts: DataFrame, summary: Column) -> DataFrame:
    """(region, grade, fact) with whether the fact stands verbatim in the summary or memory."""
    return facts.withColumn("kept", F.coalesce(F.contains(summary, F.col("fact")), F.lit(False)))


def covered_by_parts(facts: DataFrame, parts: DataFrame) -> DataFrame:
    """As ``covered``, for summaries in many parts (region, text): a fact is kept if any part of its region holds it.

    Facts are looked for in the parts, each distinct one once; no summary is put together.
    """
    named = facts.select("fact").distinct().withColumn("quote_id", F.xxhash64("fact"))
    rows = parts.select(F.struct("region", F.monotonically_increasing_id().alias("n")).alias("row_id"), "text")
    hits = contained(rows, named.select("quote_id", F.col("fact").alias("quote"))).select(F.col("row_id.region").alias("region"), "quote_id").distinct()
    out = facts.withColumn("quote_id", F.xxhash64("fact")).join(hits.withColumn("_hit", F.lit(True)), ["region", "quote_id"], "left")
    return out.withColumn("kept", F.coalesce("_hit", F.lit(False))).drop("_hit", "quote_id")


def coverage(checked: DataFrame) -> DataFrame:
    """By region, both shares (1 where there is nothing to keep) and whether the summary passes."""
    share = lambda g: F.coalesce(F.try_divide(F.count_if((F.col("grade") == g) & F.col("kept")), F.count_if(F.col("grade") == g)), F.lit(1.0))
    out = checked.groupBy("region").agg(share("P0").alias("p0_share"), share("P1").alias("p1_share"), F.count_if(~F.col("kept")).alias("n_missing"))
    return out.withColumn("passes", (F.col("p0_share") >= P0_LEAST) & (F.col("p1_share") >= P1_LEAST))


def next_attempt(attempt: Column) -> Column:
    """What follows a failed attempt, counted from 1."""
    return F.when(attempt <= 1, RETRIES[1]).when(attempt == 2, RETRIES[2]).otherwise(RETRIES[3])


def shrunk(rows: DataFrame, share: float = 0.75) -> DataFrame:
    """The newest ``share`` of a region, rounded up."""
    nth, n = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("pos"))), F.count("*").over(Window.partitionBy("region"))
    return rows.withColumn("_nth", nth).withColumn("_n", n).where(F.col("_nth") <= F.ceil(F.col("_n") * share)).drop("_nth", "_n")


def outcomes(attempts: DataFrame) -> DataFrame:
    """How a compaction ends, from its attempts in order (region, attempt, passes).

    Applied with the first attempt that passes, cancelled when three fail, else pending.
    """
    first = F.min(F.when(F.col("passes"), F.col("attempt")))
    out = attempts.where("attempt <= 3").groupBy("region").agg(first.alias("applied_attempt"), F.max("attempt").alias("n_attempts"))
    return out.withColumn("outcome", F.when(F.col("applied_attempt").isNotNull(), "applied").when(F.col("n_attempts") >= 3, "cancelled").otherwise("pending"))
