"""Compaction of a region: its critical facts, the attempts at a summary, and how it ends.

Units are (region, pos, unit_id, session, kind, protection, text, source_event_seqs). What a
generator wrote comes in as a table (region, attempt, summary, ...): this module decides what
each attempt was worth and where the loop stops, for all regions at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxloom.functions.text import exact_facts, persistent_pointer
from ctxloom.operators.contains import held_in
from ctxloom.operators.coverage import P0_LEAST, P1_LEAST, shrunk

#: Spans under so many tokens aren't worth a summary, and unsynced rows wait so long at most.
LEAST_SPAN, DEDUPE_MS = 1024, 120_000


def is_checkpoint() -> Column:
    return (F.col("kind") == "checkpoint") | (F.coalesce(F.size("source_event_seqs"), F.lit(0)) > 0)


def with_facts(rows: DataFrame) -> DataFrame:
    """``rows`` with the exact facts of their texts in place of the texts, so that these are read once."""
    return rows.withColumn("facts", exact_facts(F.coalesce("text", F.lit("")))).drop("text")


def region_facts(units: DataFrame, originals: DataFrame) -> DataFrame:
    """(region, grade, fact): exact facts of protected units, and of what a checkpoint stands for.

    ``originals`` are (session, seq, text) of the log; seqs that it lacks are passed over. Of units
    with a ``late`` flag a fact has it too, true if any unit that it comes from is late. Both tables may come from ``with_facts``.
    """
    units, originals = (x if "facts" in x.columns else x.withColumn("facts", exact_facts(F.coalesce("text", F.lit("")))) for x in (units, originals))
    grade = F.when(F.col("protection").isin("P0", "P0_TRANSIENT"), "P0").when(F.col("protection") == "P1", "P1")
    marks = ["late"] if "late" in units.columns else []
    graded = units.withColumn("grade", grade).where("grade is not null")
    own = graded.select("region", "grade", "facts", *marks)
    shadowed = graded.where(is_checkpoint()).select("region", "grade", "session", F.explode("source_event_seqs").alias("seq"), *marks).join(originals.select("session", "seq", "facts"), ["session", "seq"]).select("region", "grade", "facts", *marks)
    rows = own.unionByName(shadowed).select("region", "grade", F.explode("facts").alias("fact"), *marks)
    return rows.groupBy("region", "grade", "fact").agg(F.bool_or("late").alias("late")) if marks else rows.distinct()


def recovered(units: DataFrame, originals: DataFrame) -> DataFrame:
    """(region, unit_id, n_facts): facts that each checkpoint got back from its originals."""
    rows = units.where(is_checkpoint()).select("region", "unit_id", "session", F.explode("source_event_seqs").alias("seq")).join(originals, ["session", "seq"])
    facts = rows.select("region", "unit_id", F.explode(exact_facts(F.coalesce("text", F.lit("")))).alias("fact")).distinct()
    return facts.groupBy("region", "unit_id").agg(F.count("*").alias("n_facts"))


def _judged(attempts: DataFrame, facts: DataFrame) -> DataFrame:
    """Attempts (region, attempt, memory, summary) with their shares and missing facts.

    ``facts`` are (region, grade, fact, late); an attempt past the second must keep the late ones only.
    Each summary is read once, by the facts of its region; no summary is copied to a row for each fact.
    """
    said = attempts.select(F.col("region").alias("scope"), F.col("attempt").alias("row_id"), F.concat_ws("\n", "summary", "memory").alias("text"))
    hits = held_in(said, facts.select(F.col("region").alias("scope"), F.col("fact").alias("string")))
    hits = hits.select(F.col("scope").alias("region"), F.col("row_id").alias("attempt"), F.col("string").alias("fact"), F.lit(True).alias("kept"))
    asked = attempts.select("region", "attempt").join(facts, "region").where((F.col("attempt") <= 2) | F.col("late"))
    each = asked.join(hits, ["region", "attempt", "fact"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    share = lambda g: F.coalesce(F.try_divide(F.count_if((F.col("grade") == g) & F.col("kept")), F.count_if(F.col("grade") == g)), F.lit(1.0))
    missing = F.array_sort(F.collect_list(F.when(~F.col("kept"), F.col("fact"))))
    found = each.groupBy("region", "attempt").agg(share("P0").alias("p0_share"), share("P1").alias("p1_share"), missing.alias("missing"))
    out = attempts.select("region", "attempt", "summary").join(found, ["region", "attempt"], "left")
    out = out.withColumns({"p0_share": F.coalesce("p0_share", F.lit(1.0)), "p1_share": F.coalesce("p1_share", F.lit(1.0)), "missing": F.coalesce("missing", F.array().cast("array<string>"))})
    return out.withColumn("passes", (F.col("p0_share") >= P0_LEAST) & (F.col("p1_share") >= P1_LEAST))


def compacted(units: DataFrame, originals: DataFrame, attempts: DataFrame, memory: DataFrame | None = None, emergency: DataFrame | None = None) -> DataFrame:
    """How each region's compaction ends: status, attempts, summary, missing facts, units dropped.

    A region with a checkpoint first puts its facts into memory. Attempts one and two are held
    against the whole region, the third against the newest three quarters of it, where there are
    two units or more. The first that keeps all P0 facts and 99 % of the P1 facts is applied; a
    missing summary cancels. When no attempt is left the region stays as it was (cancelled), or,
    in an emergency (regions of ``emergency``), its facts go to memory and the last summary names them
    (degraded).
    """
    smaller = shrunk(units)
    found = region_facts(units.join(smaller.select("region", "unit_id", F.lit(True).alias("late")), ["region", "unit_id"], "left").withColumn("late", F.coalesce("late", F.lit(False))), originals)
    facts = found.select("region", "grade", "fact")
    sizes = units.groupBy("region").agg(F.count("*").alias("n_units"), F.bool_or(is_checkpoint()).alias("synced"))
    kept = smaller.groupBy("region").agg(F.count("*").alias("n_kept"))
    every = facts.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("grade", "fact"))).alias("all"))
    listed = F.transform("all", lambda x: x["fact"])
    standing = sizes.join(kept, "region").join(every, "region", "left")
    if memory is not None:
        standing = standing.join(memory.select("region", F.col("memory").alias("_memory")), "region", "left")
    else:
        standing = standing.withColumn("_memory", F.lit(None).cast("string"))
    standing = standing.withColumn("memory", F.concat_ws("\n", "_memory", F.when(F.col("synced"), persistent_pointer(listed))))
    shrinks = F.col("n_kept") < F.col("n_units")
    given = standing.join(attempts.select("region", "attempt", "summary"), "region").where((F.col("attempt") <= 2) | ((F.col("attempt") == 3) & shrinks)).select("region", "attempt", "summary", "memory")
    judged = _judged(given, found)
    # a summary that was never written ends the loop where it is missing
    said = judged.where("summary is not null")
    first = F.min(F.when(F.col("passes"), F.col("attempt")))
    reached = F.max("attempt")
    last = F.max_by(F.struct("summary", "missing"), "attempt")
    ends = said.groupBy("region").agg(first.alias("applied_at"), reached.alias("reached"), F.count("*").alias("n_said"), F.min_by(F.struct("summary"), F.when(F.col("passes"), F.col("attempt"))).alias("good"), last.alias("last"))
    out = standing.join(ends, "region", "left")
    if emergency is not None:
        out = out.join(emergency.select("region").distinct().withColumn("urgent", F.lit(True)), "region", "left")
    urgent = F.coalesce("urgent", F.lit(False)) if emergency is not None else F.lit(False)
    most = F.when(shrinks, 3).otherwise(2)
    whole = F.coalesce((F.col("n_said") == F.col("reached")) & (F.col("reached") >= most), F.lit(False))
    status = F.when(F.col("applied_at").isNotNull() & (F.col("n_said") >= F.col("applied_at")), "applied").when(whole & urgent, "degraded").otherwise("cancelled")
    tried = F.coalesce(F.when(F.col("status") == "applied", F.col("applied_at")).otherwise(F.col("reached")), F.lit(0)).cast("long")
    out = out.withColumn("status", status).withColumn("attempts", tried)
    summary = F.when(F.col("status") == "applied", F.col("good.summary")).when(F.col("status") == "degraded", F.concat(F.col("last.summary"), F.lit("\n\n"), persistent_pointer(listed)))
    missing = F.when(F.col("status") == "applied", F.array().cast("array<string>")).otherwise(F.coalesce("last.missing", F.array().cast("array<string>")))
    dropped = F.when(F.col("attempts") >= 3, F.col("n_units") - F.col("n_kept")).otherwise(0).cast("long")
    return out.select("region", "status", "attempts", summary.alias("summary"), missing.alias("missing"), dropped.alias("n_dropped"))


def span_tokens(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` (session, start, end; both included) with the tokens inside and whether they are too few.

    A span without bounds is null on both ends and never skipped.
    """
    inside = nodes.select("session", "seq", F.col("tokens").alias("_t"))
    met = spans.join(inside, "session", "left").withColumn("_t", F.when((F.col("seq") >= F.col("start")) & (F.col("seq") <= F.col("end")), F.col("_t")))
    out = met.groupBy("session", "start", "end").agg(F.coalesce(F.sum("_t"), F.lit(0)).cast("long").alias("tokens"))
    return out.withColumn("skipped", F.col("start").isNotNull() & (F.col("tokens") < LEAST_SPAN))


def syncs_before(unsynced: Column, last_ms: Column, now_ms: Column) -> Column:
    """Whether a session is synced before it is compacted: rows are waiting, or the last sync is long past."""
    return (F.coalesce(unsynced, F.lit(0)) > 0) | (now_ms - F.coalesce(last_ms, F.lit(0)) >= DEDUPE_MS)


def prunable_content(blocks: Column) -> Column:
    """Whether a tool result can be rewritten as text: its first result block holds text blocks only.

    ``blocks``: array of (type, content), content as JSON, a string or an array of blocks.
    """
    first = F.get(F.filter(blocks, lambda b: b["type"] == "tool-result"), 0)["content"]
    parts = F.from_json(first, "array<struct<type:string,text:string>>")
    return F.coalesce(F.when(first.startswith("["), F.forall(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull())).otherwise(first.startswith('"')), F.lit(False))
