"""Sessions to units: pairing, turns and the recent floor.

Messages are (session, pos, seq, role, n_calls, tokens, text, ...): role ``user``,
``assistant`` or ``tool``; rows that project to nothing are left out beforehand. All windows
partition by session first, so one exchange serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ctxloom.functions.text import clamped, priced_message, priced_structure


def so_far():
    """A session's rows up to the present one."""
    return Window.partitionBy("session").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)


#: Text beyond this is not appended to, though the append that crosses it stays whole.
TEXT_CAP = 12000


def placed(messages: DataFrame) -> DataFrame:
    """Adds island (each message that isn't a result begins one) and the unit of every row.

    An assistant message with n calls takes the next n results of its island; surplus
    results are units of their own, and so is every other message.
    """
    is_result = (F.col("role") == "tool").cast("int")
    out = messages.withColumn("island", F.sum(1 - is_result).over(so_far()))
    inside = Window.partitionBy("session", "island").orderBy("pos")
    out = out.withColumn("nth", F.sum(is_result).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    calls = F.max(F.when(F.col("role") != "tool", F.coalesce("n_calls", F.lit(0))).otherwise(0)).over(Window.partitionBy("session", "island"))
    out = out.withColumn("calls", calls).withColumn("orphan", (F.col("role") == "tool") & (F.col("nth") > F.col("calls")))
    head = F.min("pos").over(Window.partitionBy("session", "island"))
    return out.withColumn("unit_pos", F.when(F.col("orphan"), F.col("pos")).otherwise(head))


#: What marks the line of a unit's first call.
CALLS = "\n[tool-calls] "


def paired(messages: DataFrame) -> DataFrame:
    """A row per unit: kind, calls, results, open, tokens, text, seqs, and first and last seq.

    Messages may also hold ``ts``, ``checkpoint`` and ``injected`` (kinds of user messages),
    ``source_event_seqs``, and of an assistant's calls ``tool`` (the first one's name), ``tool_args``
    (all arguments) and ``first_args``; a unit has those of its first message. Units without
    tokens and text are left out. A unit's later messages are dropped here once its text has
    reached the cap, before they are gathered.
    """
    rows = placed(messages)
    has = lambda c: c in messages.columns
    own = F.coalesce("text", F.lit(""))
    head = F.substring(own, 1, TEXT_CAP)
    if has("tool"):
        call = F.concat(head, F.lit(CALLS), F.coalesce("tool", F.lit("")), F.lit(" "), F.coalesce("first_args", F.lit("")))
        head = F.when((F.coalesce("n_calls", F.lit(0)) > 0) & (F.length(head) < TEXT_CAP), call).otherwise(head)
    piece = F.when((F.col("role") == "tool") & ~F.col("orphan"), own).otherwise(head)
    earlier = Window.partitionBy("session", "unit_pos").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_piece", piece).withColumn("_before", F.coalesce(F.sum(F.length("_piece") + 1).over(earlier) - 1, F.lit(0)))
    told = F.when((F.col("role") == "user") & F.col("checkpoint"), "checkpoint") if has("checkpoint") else F.lit(None).cast("string")
    set_in = F.when((F.col("role") == "user") & F.col("injected"), "injected") if has("injected") else F.lit(None).cast("string")
    kind = F.when(F.bool_or("orphan"), "tool-result").when(F.max("calls") > 0, "tool-pair").otherwise(F.min_by(F.coalesce(told, set_in, F.col("role")), "pos"))
    parts = F.sort_array(F.collect_list(F.when(F.col("_before") < TEXT_CAP, F.struct("pos", "_piece"))))
    results = F.count_if((F.col("role") == "tool") & ~F.col("orphan"))
    carried = [F.min_by(c, "pos").alias(c) for c in ("ts", "tool", "tool_args", "source_event_seqs") if has(c)]
    out = rows.groupBy("session", "unit_pos").agg(
        kind.alias("kind"),
        F.when(F.bool_or("orphan"), 0).otherwise(F.max("calls")).cast("long").alias("n_calls"),
        results.alias("n_results"),
        (~F.bool_or("orphan") & (F.max("calls") > results)).alias("open"),
        F.sum(F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"),
        F.min_by("seq", "pos").alias("first_seq"),
        F.max_by("seq", "pos").alias("last_seq"),
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "seq"))), lambda x: x["seq"]).alias("seqs"),
        F.array_join(F.transform(parts, lambda p: p["_piece"]), "\n").alias("text"),
        *carried,
    )
    return out.where("tokens > 0 or text <> '' or kind = 'tool-result'")


def with_turns(rows: DataFrame) -> DataFrame:
    """Adds the user turn of each row and the user turns after it."""
    user = (F.col("role") == "user").cast("long")
    out = rows.withColumn("user_turn", F.sum(user).over(so_far()))
    return out.withColumn("turns_after", F.sum(user).over(Window.partitionBy("session")) - F.col("user_turn"))


def session_prices(surface: DataFrame, events: DataFrame, header: DataFrame) -> DataFrame:
    """(session, tokens): what a request of a session costs, its header and every node of its surface.

    ``events`` hold (session, seq, blocks, json); blocks are null where there is no message, which then
    costs its JSON. Nodes without an event cost nothing. ``header`` is (session, header_tokens).
    """
    price = F.when(F.col("blocks").isNotNull(), priced_message(F.col("blocks"))).otherwise(priced_structure(F.col("json")))
    return session_totals(surface, events.select("session", "seq", price.alias("tokens")), header)


def session_totals(surface: DataFrame, priced: DataFrame, header: DataFrame) -> DataFrame:
    """(session, tokens) from the prices (session, seq, tokens) of the nodes on a surface and a session's header_tokens."""
    nodes = surface.select("session", "seq").join(priced.select("session", "seq", F.col("tokens").alias("_t")), ["session", "seq"], "left")
    sums = nodes.groupBy("session").agg(F.coalesce(F.sum("_t"), F.lit(0)).alias("_t"))
    return sums.join(header, "session", "left").select("session", (F.col("_t") + F.coalesce("header_tokens", F.lit(0))).cast("long").alias("tokens"))


def floor_tokens(window: Column, ratio: float = 0.06, least: int = 2048, most: int = 12288) -> Column:
    return F.floor(clamped(window * ratio, least, most)).cast("long")


def with_recent_floor(units: DataFrame, floor: Column) -> DataFrame:
    """Adds in_floor: the newest units whose tokens reach the floor, the crossing one included.

    Flags compare first seqs, not positions; a floor that is never reached takes all, one of
    0 none.
    """
    newest = Window.partitionBy("session").orderBy(F.desc("pos"))
    out = units.withColumn("_sum", F.sum("tokens").over(newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = Window.partitionBy("session")
    crossing = F.coalesce(F.max_by("first_seq", F.when(F.col("_sum") >= floor, F.col("pos"))).over(whole), F.min_by("first_seq", "pos").over(whole))
    return out.withColumn("in_floor", (floor > 0) & (F.col("first_seq") >= crossing)).drop("_sum")


def calibrated_range(rows: DataFrame, retain: Column) -> DataFrame:
    """By session, the positions to compact: past the system head, up to a balanced cut.

    Rows hold role, calls and results; the newest rows worth ``retain`` tokens stay. A cut
    at a row is balanced when all calls before it have their results.
    """
    newest = Window.partitionBy("session").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("session")
    out = rows.withColumn("_kept", F.sum("tokens").over(newest)).withColumn("_open", F.sum(F.col("calls") - F.col("results")).over(so_far()) - (F.col("calls") - F.col("results")))
    out = out.withColumn("_head", F.coalesce(F.min(F.when(F.col("role") != "system", F.col("pos"))).over(whole), F.max("pos").over(whole) + 1))
    out = out.withColumn("_cut", F.coalesce(F.max(F.when(F.col("_kept") >= retain, F.col("pos"))).over(whole), F.min("pos").over(whole)))
    stop = F.max(F.when((F.col("pos") <= F.col("_cut")) & (F.col("pos") > F.col("_head")) & (F.col("_open") == 0), F.col("pos")))
    return out.groupBy("session").agg(F.min("_head").alias("from_pos"), (stop - 1).alias("to_pos")).where("to_pos is not null")


def in_ring(points: DataFrame, cap: int = 240) -> DataFrame:
    """History by session: of points with one t the last, and of those the newest ``cap``."""
    ordered = Window.partitionBy("session").orderBy("pos")
    kept = points.withColumn("_next", F.lead("t").over(ordered)).where("_next is null or _next <> t").drop("_next")
    return kept.withColumn("_rank", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("pos")))).where(F.col("_rank") <= cap).drop("_rank")


def continuations(ends: DataFrame, cap: int = 3) -> DataFrame:
    """Adds how many cut-off answers in a row a row makes, and whether one more may follow.

    ``ends`` holds (session, pos, kind): only ``max-tokens`` continues, all else starts anew.
    Where it holds ``turn`` and ``event_seq``, an end told twice counts once.
    """
    if "event_seq" in ends.columns:
        nth = F.row_number().over(Window.partitionBy("session", "turn", "event_seq").orderBy("pos"))
        ends = ends.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
    run = F.sum((F.col("kind") != "max-tokens").cast("long")).over(so_far())
    out = ends.withColumn("_run", run)
    inside = Window.partitionBy("session", "_run").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("streak", F.sum((F.col("kind") == "max-tokens").cast("long")).over(inside)).drop("_run")
    return out.withColumn("continues", (F.col("kind") == "max-tokens") & (F.col("streak") <= cap))


def continuation_steps(events: DataFrame, cap: int = 3) -> DataFrame:
    """(session, event_seq, n, continues): answers that were cut off, each with its place in its run.

    ``events`` (session, event_seq, kind, form, turn) are ends of turns and user messages. A run of
    ``max-tokens`` ends is broken by any other end and by a user message, unless that is the
    continuation's own prompt (form ``continuation``). An event told twice counts once, by its
    event_seq; so does a second end of one turn. Past ``cap`` nothing continues and n stays at cap + 1.
    """
    own = Window.partitionBy("session").orderBy("event_seq")
    once = events.groupBy("session", "event_seq").agg(*(F.first(c).alias(c) for c in ("kind", "form", "turn")))
    prompt = (F.col("kind") == "user") & F.coalesce(F.col("form") == "continuation", F.lit(False))
    rows = once.where(~prompt).withColumn("_run", F.sum((F.col("kind") != "max-tokens").cast("long")).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    run = Window.partitionBy("session", "_run").orderBy("event_seq")
    ends = rows.where("kind = 'max-tokens'").withColumn("_again", F.coalesce(F.col("turn") == F.lag("turn").over(run), F.lit(False)))
    counted = ends.where("not _again").withColumn("_n", F.row_number().over(run))
    return counted.select("session", "event_seq", F.least("_n", F.lit(cap + 1)).cast("long").alias("n"), (F.col("_n") <= cap).alias("continues"))
