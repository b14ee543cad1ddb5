"""The context planner, end to end: units, protection, scores, pressure, segments, decision."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ctxloom.config import Config
from ctxloom.functions import text as T
from ctxloom.operators import ledger as L
from ctxloom.operators import prune as R
from ctxloom.operators import retrieval as V
from ctxloom.operators import scoring as S
from ctxloom.operators import segments as G
from ctxloom.operators import units as U
from ctxloom.operators.spread import spread, tasks_for

LANES = ("ids", "paths", "symbols", "errors", "models", "keywords")


@dataclass(frozen=True)
class Memory:
    """What the ledger says: its index (``ledger.index``), source bindings (session, seq, entry_id),
    entries without a source (id, reason), and the text of the state entry."""

    index: DataFrame
    bindings: DataFrame
    unresolved: DataFrame
    state: str = ""

    def ids(self) -> DataFrame:
        """(id, is_active, is_cited): of every entry, and whether an ACTIVE one cites it."""
        cited = L.cited_by_active(self.index).withColumn("is_cited", F.lit(True))
        own = self.index.select("id", (F.col("status") == "ACTIVE").alias("is_active"))
        return own.join(cited, "id", "left").select("id", "is_active", F.coalesce("is_cited", F.lit(False)).alias("is_cited"))

    def evidence_terms(self) -> DataFrame:
        """(id, term) of ACTIVE entries whose source isn't known: words of title and stored quote."""
        quote = F.regexp_extract("raw", r"(?im)^\s*[-*]?\s*source\s*[:：]\s*(.+)$", 1)
        loose = self.index.where("status = 'ACTIVE'").join(self.unresolved.select("id"), "id", "left_semi")
        return loose.select("id", F.explode(T.evidence_terms(F.col("title"), quote)).alias("term"))


def held_units(units: DataFrame, terms: DataFrame) -> DataFrame:
    """(session, pos): units that share two evidence terms of an entry, or one of eight letters."""
    texts = units.select(F.struct("session", "pos").alias("message_id"), "text")
    hits = V.held_terms(texts, terms).join(terms, "term").groupBy("message_id", "id").agg(F.count("*").alias("n"), F.max(F.length("term")).alias("longest"))
    return hits.where("n >= 2 or longest >= 8").select("message_id.session", "message_id.pos").distinct()


def with_memory(units: DataFrame, memory: Memory) -> DataFrame:
    """Adds ``sources`` (ACTIVE entries that a unit is the source of), ``cited`` (ACTIVE ids that
    its text names), ``leans`` (it names one that an ACTIVE entry cites) and ``held``.

    What the ledger says of units is gathered in one grouping and met by them in one join.
    """
    row = lambda **of: [of.get(k, F.lit(None).cast(t)).alias(k) for k, t in (("cited", "string"), ("leans", "boolean"), ("source", "string"), ("held", "boolean"))]
    named = units.select("session", "pos", F.explode(F.transform("own.ids", F.upper)).alias("id")).join(memory.ids(), "id")
    said = named.select("session", "pos", *row(cited=F.when(F.col("is_active"), F.col("id")), leans=F.col("is_cited")))
    live = memory.index.where("coalesce(status, 'ACTIVE') = 'ACTIVE'").select(F.col("id").alias("entry_id"))
    bound = units.select("session", "pos", F.explode("seqs").alias("seq")).join(memory.bindings, ["session", "seq"]).join(live, "entry_id", "left_semi")
    said = said.unionByName(bound.select("session", "pos", *row(source=F.col("entry_id"))))
    said = said.unionByName(held_units(units, memory.evidence_terms()).select("session", "pos", *row(held=F.lit(True))))
    found = said.groupBy("session", "pos").agg(F.array_sort(F.collect_set("cited")).alias("cited"), F.bool_or("leans").alias("leans"), F.array_sort(F.collect_set("source")).alias("sources"), F.bool_or("held").alias("held"))
    out = units.join(found, ["session", "pos"], "left")
    none, no = F.array().cast("array<string>"), F.lit(False)
    return out.withColumns({"cited": F.coalesce("cited", none), "leans": F.coalesce("leans", no), "sources": F.coalesce("sources", none), "held": F.coalesce("held", no)})


def asked_terms(query: Column, state: str) -> Column:
    """Terms of a session's query and of the standing state, lane by lane."""
    own, standing = T.terms(F.coalesce(query, F.lit(""))), T.terms(F.lit(state))
    return F.struct(*(F.array_union(own[k], standing[k]).alias(k) for k in LANES))


def with_asked(units: DataFrame, windows: DataFrame, state: str) -> DataFrame:
    """``windows`` with the terms that each session asks for, computed once a session: of its
    query, or of its last unit that a user wrote, the first 2,000 characters."""
    if "query" in windows.columns:
        return windows.withColumn("asked", asked_terms(F.col("query"), state))
    last = units.where("kind = 'user' and text <> ''").groupBy("session").agg(F.substring(F.max_by("text", "pos"), 1, 2000).alias("_query"))
    return windows.join(last, "session", "left").withColumn("asked", asked_terms(F.col("_query"), state)).drop("_query")


def scored_units(units: DataFrame, windows: DataFrame, now: Column, memory: Memory | None = None, previous: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """Units of every session with all that the plan needs.

    ``units`` are those of ``units.paired``, with ``pos``; ``windows`` (session,
    context_window) is joined by session and may hold requested_output, query (else the last user
    text counts) and generation; ``previous`` (session, first_seq, before) are the tiers of the
    last plan, of the same generation only where it holds one.
    """
    none, no = F.array().cast("array<string>"), F.lit(False)
    has = lambda frame, c: c in frame.columns
    for name, kind in (("tool", "string"), ("tool_args", "string"), ("seqs", "array<long>"), ("source_event_seqs", "array<long>")):
        if not has(units, name):
            units = units.withColumn(name, F.lit(None).cast(kind))
    asked = with_asked(units, windows, memory.state if memory else "")
    tasks = tasks_for(units)  # dealt by session, all windows below share one exchange, and small rows don't end in one task
    out = spread(units, "session", tasks=tasks).join(asked, "session").withColumn("role", F.when(F.col("kind").isin("user", "checkpoint", "injected"), "user").otherwise("other"))
    out = U.with_turns(out).withColumn("own", T.terms(F.col("text")))
    out = with_memory(out, memory) if memory else out.withColumns({"cited": none, "leans": no, "sources": none, "held": no})
    out = spread(out, "session", tasks=tasks) if memory else out
    out = out.withColumn("content_type", S.content_type(F.col("kind"), F.col("tool"), F.col("text")))
    graded = S.protection(F.col("kind"), F.col("text"), F.coalesce("tool_args", F.lit("")), F.col("open"), F.size("own.paths") > 0, F.col("sources"), F.col("cited"), F.col("held"), F.col("source_event_seqs"))
    out = out.withColumn("_p", graded).select("*", "_p.protection", "_p.reasons").drop("_p")
    key = F.coalesce(F.when(F.col("tool").isNotNull() & F.col("tool_args").isNotNull(), T.tool_group_key(F.col("tool"), F.col("tool_args"))), F.col("kind"))
    out = out.withColumn("middle", S.middle_reads(F.col("kind"), F.col("tool"), F.col("own.paths")))
    out = S.with_duplication(out, key, middle=F.col("middle"))
    state_paths = T.terms(F.lit(memory.state if memory else ""))["paths"]
    points = lambda c, w: F.when(c, w).otherwise(0.0)
    depends = points(F.size("cited") > 0, 0.5) + points(F.col("leans"), 0.25) + points(F.coalesce(F.arrays_overlap("own.paths", state_paths), no), 0.25)
    named = F.col("asked").withField("ids", F.array_union("asked.ids", F.transform("cited", F.lower)))
    age = (F.unix_millis(now) - F.unix_millis(F.col("ts").cast("timestamp"))) / 60000.0
    out = out.withColumns({"dependency": depends, "relevance": S.relevance(F.col("own"), named), "recency": S.recency(F.col("turns_after"), age, S.of_type(F.col("content_type"), 1)), "x": S.of_type(F.col("content_type"), 2)})
    out = out.withColumns({"intrinsic": S.intrinsic(F.col("content_type"), F.col("protection"), F.col("reasons")), "size_penalty": S.size_penalty(F.col("tokens"))})
    out = out.withColumn("score", S.unit_score(F.col("protection"), F.col("intrinsic"), F.col("relevance"), F.col("recency"), F.col("dependency"), F.col("x"), F.col("duplication"), F.col("size_penalty"), config))
    out = out.withColumn("notes", S.notes(F.col("content_type"), F.col("intrinsic"), F.col("relevance"), F.col("recency"), F.col("turns_after"), age, F.col("dependency"), F.col("x"), F.col("duplication"), F.col("size_penalty")))
    if previous is not None:
        out = out.join(previous, ["session", "first_seq", *(["generation"] if has(previous, "generation") and has(windows, "generation") else [])], "left")
    else:
        out = out.withColumn("before", F.lit(None).cast("string"))
    out = out.withColumn("tier", S.tier(F.col("score"), F.col("protection"), F.col("before"), config))
    out = U.with_recent_floor(out, U.floor_tokens(F.col("context_window"), config.recent.ratio, config.recent.min_tokens, config.recent.max_tokens))
    used = F.sum("tokens").over(Window.partitionBy("session"))
    ask = F.col("requested_output") if has(windows, "requested_output") else None
    out = out.withColumn("g", G.gauges(F.col("context_window"), used, requested=ask, config=config)).select("*", "g.zone", "g.soft", "g.hard").drop("g")
    out = out.withColumn("min_reclaim", G.min_reclaim(F.col("context_window"), config))
    out = out.withColumn("eligible", F.coalesce(G.eligible(F.col("zone"), F.col("tier"), F.col("protection"), F.col("in_floor")), no))
    return out.drop("asked", "own", "role")


def _prunable(config: Config) -> Column:
    """Units that pruning at Z1 may take: unprotected TRASH outside the floor, or that can be made again."""
    free = ~F.col("in_floor") | (F.lit(config.recent.bypass_x > 0) & (F.col("x") >= config.recent.bypass_x))
    return (F.col("zone") == "Z1") & (F.col("tier") == "TRASH") & (F.col("protection") == "NORMAL") & free


def prune_candidates(scored: DataFrame, config: Config = Config()) -> DataFrame:
    return scored.where(_prunable(config))


def fresh_prune(scored: DataFrame, config: Config = Config()) -> DataFrame:
    """What pruning would do to each unit of a plan: action and tokens given back."""
    return R.planned(scored.withColumn("args", F.coalesce("tool_args", F.lit(""))), F.col("zone"), config)


def plan(scored: DataFrame, config: Config = Config()) -> DataFrame:
    """One row per session: zone, action, the segment it would compact, and unit counts.

    Runs are summed up by session in one pass over the scored units. A session without a usable
    window gets a row that does nothing (degraded).
    """
    found = G.runs(scored, (F.count_if(_prunable(config)).alias("n_prunable"),), config)
    choice = F.struct("first_seq", "last_seq", F.col("tokens").alias("reclaim"), F.col("contains_p1").alias("requires_sync"))
    best = F.max_by(choice, F.when(F.col("passes"), F.struct("priority", "tokens", (-F.col("first_pos")).alias("back"))))
    out = found.groupBy("session").agg(F.first("zone").alias("zone"), F.sum("n_units").alias("n_units"), F.sum("tokens").cast("long").alias("tokens"), F.coalesce(F.sum(F.when(F.col("eligible"), F.col("n_units"))), F.lit(0)).alias("n_eligible"), F.sum("n_prunable").alias("n_prunable"), best.alias("best"))
    out = out.select("session", "zone", "n_units", "tokens", "n_eligible", "n_prunable", "best.*")
    return out.withColumn("degraded", F.col("zone").isNull()).withColumn("action", F.when(F.col("zone").isNull(), "none").otherwise(G.decision(F.col("zone"), F.col("first_seq").isNotNull())))


def history_points(units: DataFrame, plans: DataFrame, shown: int = Config().units_shown) -> DataFrame:
    """(session, zone, action, reclaim, inj, degraded): what a plan leaves in its session's history.

    ``inj`` are the tokens of injected units (session, pos, kind, tokens) among those that a plan shows, its first ``shown``.
    """
    nth = F.row_number().over(Window.partitionBy("session").orderBy("pos"))
    inj = units.withColumn("_nth", nth).where(F.col("_nth") <= shown).groupBy("session").agg(F.coalesce(F.sum(F.when(F.col("kind") == "injected", F.col("tokens"))), F.lit(0)).cast("long").alias("inj"))
    return plans.join(inj, "session", "left").select("session", "zone", "action", F.coalesce("reclaim", F.lit(0)).cast("long").alias("reclaim"), F.coalesce("inj", F.lit(0)).alias("inj"), "degraded")
