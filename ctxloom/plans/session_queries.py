"""Queries over sessions: pairing, floors, protection, scores, segments, decisions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ctxloom.functions import patterns as P
from ctxloom.functions import text as T
from ctxloom.operators import budget as B
from ctxloom.operators import compaction as M
from ctxloom.operators import ledger as L
from ctxloom.operators import scoring as S
from ctxloom.operators import segments as G
from ctxloom.operators import units as U
from ctxloom.plans.planner import Memory, plan, scored_units
from ctxloom.plans.registry import held, query, read
from ctxloom.plans.text_queries import FACT_SQL, FP
from ctxloom.sources import adapters as A

six = lambda c: T.half_up(c, 6)
SIX = lambda c: f"CAST(floor(({c}) * 1e6 + 0.5) / 1e6 AS DOUBLE)"

_ISLANDS = f"""{A.EVENT_MESSAGES},
i AS (SELECT *, sum(CASE WHEN role = 'tool' THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY pos) AS island FROM m),
n AS (SELECT *, sum(CASE WHEN role = 'tool' THEN 1 ELSE 0 END) OVER (PARTITION BY session, island ORDER BY pos) AS nth, max(n_calls) OVER (PARTITION BY session, island) AS calls, min(pos) OVER (PARTITION BY session, island) AS head FROM i),
k AS (SELECT *, role = 'tool' AND nth > calls AS orphan FROM n),
p AS (SELECT session, CASE WHEN orphan THEN pos ELSE head END AS unit_pos, bool_or(orphan) AS orphan, CASE WHEN bool_or(orphan) THEN 0 ELSE max(calls) END AS n_calls, count(*) FILTER (role = 'tool' AND NOT orphan) AS n_results, CAST(sum(tokens) AS BIGINT) AS tokens, arg_min(role, pos) AS role, string_agg(text, chr(10) ORDER BY pos) AS text FROM k GROUP BY ALL),
"""
_ISLANDS = _ISLANDS.replace("GROUP BY ALL", "GROUP BY session, CASE WHEN orphan THEN pos ELSE head END")
_UNITS = _ISLANDS + "q AS (SELECT session, unit_pos, CASE WHEN orphan THEN 'tool-result' WHEN n_calls > 0 THEN 'tool-pair' ELSE role END AS kind, CAST(n_calls AS BIGINT) AS n_calls, n_results, NOT orphan AND n_calls > n_results AS open, tokens, text FROM p)"


@query(f"WITH {_UNITS} SELECT * FROM q")
def pair_units(spark, sf_dir):
    """W1 A4."""
    return U.paired(A.event_messages(spark, sf_dir)).drop("first_seq", "last_seq", "seqs", "ts")


@query(f"WITH {_UNITS} SELECT session, count(*) AS n_orphans, CAST(sum(tokens) AS BIGINT) AS tokens FROM q WHERE kind = 'tool-result' GROUP BY session")
def orphan_results(spark, sf_dir):
    """W1 P7."""
    return U.paired(A.event_messages(spark, sf_dir)).where("kind = 'tool-result'").groupBy("session").agg(F.count("*").alias("n_orphans"), F.sum("tokens").alias("tokens"))


@query(f"WITH {_UNITS} SELECT kind, count(*) AS n_units, count(*) FILTER (open) AS n_open, CAST(sum(tokens) AS BIGINT) AS tokens FROM q GROUP BY kind")
def open_units(spark, sf_dir):
    """Pairs still open, by kind."""
    return U.paired(A.event_messages(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n_units"), F.count_if("open").alias("n_open"), F.sum("tokens").alias("tokens"))


@query(f"WITH {A.CONVERSATION_MESSAGES}, t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY pos) AS ut, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session) AS total FROM c) SELECT session, pos, CAST(ut AS BIGINT) AS user_turn, CAST(total - ut AS BIGINT) AS turns_after FROM t")
def user_turns_after(spark, sf_dir):
    """W2."""
    return U.with_turns(A.conversation_messages(spark, sf_dir)).select("session", "pos", "user_turn", "turns_after")


@query("SELECT conv_id, right(string_agg('[' || role || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn), 160000) AS delta FROM conversations WHERE turn >= 2 AND text <> '' GROUP BY conv_id")
def session_message_delta(spark, sf_dir):
    """S2 S3 S6."""
    from ctxloom.sources.sessions import delta_text

    return delta_text(A.conversation_messages(spark, sf_dir), F.lit(2)).select(F.col("session").alias("conv_id"), "delta")


@query("SELECT conv_id, turn, 'E' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS handle FROM conversations WHERE turn >= 1 AND text <> ''")
def delta_handles(spark, sf_dir):
    """W9."""
    from ctxloom.sources.sessions import handles

    return handles(A.conversation_messages(spark, sf_dir), F.lit(1)).select(F.col("session").alias("conv_id"), F.col("pos").alias("turn"), "handle")


@query(
    f"""WITH {A.CONVERSATION_MESSAGES}, s AS (SELECT *, sum(tokens) OVER (PARTITION BY session ORDER BY pos DESC) AS cum FROM c),
x AS (SELECT session, coalesce(max(pos) FILTER (cum >= 300), min(pos)) AS edge FROM s GROUP BY session)
SELECT s.session, s.pos, s.pos >= x.edge AS in_floor FROM s JOIN x ON s.session = x.session"""
)
def recent_floor(spark, sf_dir):
    """W7 (floor of 300 tokens)."""
    return U.with_recent_floor(A.conversation_messages(spark, sf_dir), F.lit(300)).select("session", "pos", "in_floor")


@query("SELECT o_custkey AS session, o_orderkey AS pos, CAST(floor(greatest(2048, least(12288, o_totalprice * 0.06))) AS BIGINT) AS floor_tokens, CAST(floor(greatest(2048, least(8192, o_totalprice * 0.03))) AS BIGINT) AS min_reclaim FROM orders")
def window_floors(spark, sf_dir):
    """a price as a context window."""
    price = F.col("o_totalprice")
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("pos"), U.floor_tokens(price).alias("floor_tokens"), G.min_reclaim(price).alias("min_reclaim"))


@query("WITH r AS (SELECT user_id AS session, event_type || ':' || (value::BIGINT % 5) AS path, event_id AS pos FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY session, path ORDER BY pos) AS k, count(*) OVER (PARTITION BY session, path) AS total FROM r) SELECT session, path, pos, total >= 3 AND k > 1 AND k < total AS middle FROM n".replace("value::BIGINT % 5", "event_id % 3"))
def repeated_read_middles(spark, sf_dir):
    """An event type and a digit of the id as the path read."""
    reads = read(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.expr("concat(event_type, ':', event_id % 3)").alias("path"), F.col("event_id").alias("pos"))
    return S.read_middles(reads)


_GRADED = f"""{A.EVENT_UNITS},
g AS (SELECT *, CASE WHEN open THEN 'P0_TRANSIENT' WHEN kind = 'user' THEN 'P0' WHEN kind = 'assistant' AND text <> 'hello' THEN 'P1' WHEN event_type IN ('error', 'view') THEN 'P1' ELSE 'NORMAL' END AS protection FROM u)"""


@query(f"WITH {_GRADED} SELECT session, pos, protection FROM g")
def protection_lanes(spark, sf_dir):
    """P3 P3a-P3e: every event text is built to hit one rule."""
    return _graded(spark, sf_dir).select("session", "pos", "protection")


def _graded(spark, sf_dir):
    u = A.event_units(spark, sf_dir)
    has_path = F.size(T.found(F.col("text"), P.PATH_UNIX)) > 0
    return u.select("*", S.protection(F.col("kind"), F.col("text"), F.col("text"), F.col("open"), has_path).alias("_p")).select("*", "_p.protection", "_p.reasons").drop("_p")


@query(f"WITH {_GRADED} SELECT protection, count(*) AS n_units, count(DISTINCT session) AS n_sessions FROM g GROUP BY protection")
def protection_census(spark, sf_dir):
    """P3 A2."""
    return _graded(spark, sf_dir).groupBy("protection").agg(F.count("*").alias("n_units"), F.countDistinct("session").alias("n_sessions"))


@query(
    f"""WITH {A.EVENT_UNITS} SELECT session, pos, CASE WHEN kind = 'user' THEN 'user-request' WHEN kind = 'assistant' THEN 'assistant-reasoning'
 WHEN tool = 'read' THEN 'file-read' WHEN tool = 'grep' THEN 'search-result' ELSE 'tool-log' END AS content_type FROM u"""
)
def content_types(spark, sf_dir):
    """P4."""
    return A.event_units(spark, sf_dir).select("session", "pos", S.content_type(F.col("kind"), F.col("tool"), F.col("text")).alias("content_type"))


_TYPED = f"""{A.EVENT_UNITS}, y AS (SELECT *, CASE WHEN kind = 'user' THEN 24 WHEN kind = 'assistant' THEN 16 WHEN tool = 'read' THEN 8 WHEN tool = 'grep' THEN 5 ELSE 3 END AS tau,
 row_number() OVER (PARTITION BY session ORDER BY pos DESC) - 1 AS after, date_diff('second', ts, TIMESTAMP '2024-02-01 00:00:00') / 60.0 AS age FROM u)"""


@query(f"WITH {_TYPED} SELECT session, pos, {SIX('0.75 * exp(-after / tau) + 0.25 * exp(-age / (tau * 30))')} AS recency FROM y")
def recency_scores(spark, sf_dir):
    """F1."""
    u = A.event_units(spark, sf_dir)
    after = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("pos"))) - 1
    age = (F.unix_seconds(F.lit("2024-02-01").cast("timestamp")) - F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp")))) / 60.0
    tau = S.of_type(S.content_type(F.col("kind"), F.col("tool"), F.col("text")), 1)
    return u.select("session", "pos", after.alias("after"), age.alias("age"), tau.alias("tau")).select("session", "pos", six(S.recency(F.col("after"), F.col("age"), F.col("tau"))).alias("recency"))


_ASKED = "nd wh with from benchmark v1.2 E_TIMEOUT /srv/app/config.yaml"


@query(
    r"""WITH k AS (SELECT doc_id, lower(text) AS low, list_distinct(list_transform(regexp_extract_all(text, '[a-zA-Z]{4,}'), lambda s: lower(s))) AS ws FROM documents),
x AS (SELECT doc_id, ' ' || string_agg(t.w, ' ') || ' ' AS q FROM documents, (VALUES ('idiot'), ('licensed'), ('version')) t(w) GROUP BY doc_id)
SELECT doc_id, CASE WHEN len(list_intersect(ws, ['idiot', 'licensed', 'version'])) > 0 THEN 0.25 ELSE 0.0 END
 + CASE WHEN len(list_intersect(list_transform(regexp_extract_all((SELECT d.text FROM documents d WHERE d.doc_id = k.doc_id), '\bv?\d+\.\d+(?:\.\d+)*(?:-[0-9A-Za-z.-]+)?\b'), lambda s: lower(s)), ['2.0', '4.0'])) > 0 THEN 0.3::DOUBLE ELSE 0.0 END AS relevance FROM k"""
)
def relevance_scores(spark, sf_dir):
    """Documents against a request for license versions."""
    none = F.array().cast("array<string>")
    asked = F.struct(none.alias("ids"), none.alias("paths"), none.alias("symbols"), none.alias("errors"), F.array(F.lit("2.0"), F.lit("4.0")).alias("models"), F.array(F.lit("idiot"), F.lit("licensed"), F.lit("version")).alias("keywords"))
    return read(spark, sf_dir, "documents").select("doc_id", S.relevance(T.terms(F.col("text")), asked).alias("relevance"))


@query(f"WITH {A.ORDER_UNITS} SELECT session, pos, {SIX('least(0.15, 0.02 * log2(greatest(tokens, 256) / 256.0))')} AS penalty FROM o")
def size_penalty(spark, sf_dir):
    """F4."""
    return A.order_units(spark, sf_dir).select("session", "pos", six(S.size_penalty(F.col("tokens"))).alias("penalty"))


_SCORE = "greatest(0, least(1, greatest(0.3, 0.55 * score + 0.3 * (1 - score) + 0.15 * 0.25) + 0.1 * 0.25 - 0.22 * 0.9 - 0.18 * CASE WHEN pos % 3 = 0 THEN 1.0 ELSE 0.25 END - least(0.15, 0.02 * log2(greatest(tokens, 256) / 256.0))))"


@query(f"WITH {A.ORDER_UNITS} SELECT session, pos, {SIX(f'''CASE WHEN protection IN ('P0', 'P0_TRANSIENT') THEN 1 WHEN protection = 'P1' THEN greatest(0.75, {_SCORE}) ELSE {_SCORE} END''')} AS score FROM o")
def unit_scores(spark, sf_dir):
    """features given, the score computed."""
    u = A.order_units(spark, sf_dir)
    dup = F.when(F.col("pos") % 3 == 0, 1.0).otherwise(0.25)
    got = S.unit_score(F.col("protection"), F.lit(0.3), F.col("score"), 1 - F.col("score"), F.lit(0.25), F.lit(0.9), dup, S.size_penalty(F.col("tokens")))
    return u.select("session", "pos", six(got).alias("score"))


_TIERED = f"{A.ORDER_UNITS}, t AS (SELECT *, {A.TIER} AS tier FROM o), e AS (SELECT *, {A.ELIGIBLE} AS eligible FROM t)"


def _tiered(spark, sf_dir):
    u = A.order_units(spark, sf_dir)
    out = u.withColumn("tier", S.tier(F.col("score"), F.col("protection"), F.col("before")))
    return out.withColumn("eligible", G.eligible(F.col("zone"), F.col("tier"), F.col("protection"), F.col("in_floor"))).withColumn("min_reclaim", F.lit(2048))


@query(f"WITH {_TIERED} SELECT session, pos, tier FROM t")
def tier_hysteresis(spark, sf_dir):
    """F8 J15."""
    return _tiered(spark, sf_dir).select("session", "pos", "tier")


@query(f"WITH {_TIERED}, n(tier) AS (VALUES ('PINNED'), ('HOT'), ('WARM'), ('COLD'), ('TRASH')) SELECT n.tier, count(t.pos) AS n_units, CAST(coalesce(sum(t.tokens), 0) AS BIGINT) AS tokens FROM n LEFT JOIN t ON n.tier = t.tier GROUP BY n.tier")
def tier_census(spark, sf_dir):
    """A1: units and tokens by tier."""
    return S.census(_tiered(spark, sf_dir))


_PRESSURE = """w AS (SELECT o_custkey AS session, CAST(sum(CAST(floor(o_totalprice / 100) AS BIGINT) % 3000) * 4 AS DOUBLE) AS used FROM orders GROUP BY o_custkey),
a AS (SELECT *, 64000 + (session % 5) * 16000 AS win FROM w),
b AS (SELECT *, greatest(2048, least(16384, win * 0.05)) AS expect, floor(greatest(1024, least(6144, win * 0.025))) AS reserve, floor(greatest(2048, least(8192, win * 0.04))) AS margin FROM a),
d AS (SELECT *, (used + expect + reserve) / win AS soft, (used + expect + margin) / win AS hard FROM b),
z AS (SELECT *, CASE WHEN hard >= 1 OR soft >= 0.94 THEN 'Z5' WHEN soft >= 0.88 THEN 'Z4' WHEN soft >= 0.78 THEN 'Z3' WHEN soft >= 0.68 THEN 'Z2' WHEN soft >= 0.55 THEN 'Z1' ELSE 'Z0' END AS zone FROM d)"""


def _pressure(spark, sf_dir):
    used = A.order_units(spark, sf_dir).groupBy("session").agg((F.sum("tokens") * 4).alias("used")).withColumn("win", 64000 + (F.col("session") % 5) * 16000)
    return used.select("session", "used", "win", G.gauges(F.col("win"), F.col("used")).alias("g"))


@query(f"WITH {_PRESSURE} SELECT session, CAST(floor(soft * 1e4 + 0.5) / 1e4 AS DOUBLE) AS soft, CAST(floor(hard * 1e4 + 0.5) / 1e4 AS DOUBLE) AS hard, zone FROM z")
def pressure_zones(spark, sf_dir):
    """A customer's orders as a context."""
    return _pressure(spark, sf_dir).select("session", "g.soft", "g.hard", "g.zone")


@query(f"WITH {_PRESSURE}, r AS (SELECT *, greatest(0, used - 9000) AS left_over FROM z), s AS (SELECT session, zone AS before, (left_over + expect + reserve) / win AS soft, (left_over + expect + margin) / win AS hard FROM r) SELECT session, before, CASE WHEN hard >= 1 OR soft >= 0.94 THEN 'Z5' WHEN soft >= 0.88 THEN 'Z4' WHEN soft >= 0.78 THEN 'Z3' WHEN soft >= 0.68 THEN 'Z2' WHEN soft >= 0.55 THEN 'Z1' ELSE 'Z0' END AS after FROM s")
def pressure_after_reclaim(spark, sf_dir):
    """V8: 9,000 tokens reclaimed."""
    got = G.after_reclaim(F.col("win"), F.col("used"), F.col("g.expected_output"), F.lit(9000))
    return _pressure(spark, sf_dir).select("session", F.col("g.zone").alias("before"), got.alias("a")).select("session", "before", F.col("a.zone").alias("after"))


_SEGMENTS = (
    _TIERED
    + """, i AS (SELECT *, sum(CASE WHEN eligible THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY pos) AS run FROM e),
s AS (SELECT session, min(pos) AS first_seq, max(pos) AS last_seq, count(*) AS n_units, CAST(sum(tokens) AS BIGINT) AS tokens, CASE WHEN sum(tokens) > 0 THEN sum(score * tokens) / sum(tokens) ELSE 0 END AS loss, bool_or(protection = 'P1') AS contains_p1, any_value(zone) AS zone FROM i WHERE eligible GROUP BY session, run),
v AS (SELECT session, first_seq, last_seq, n_units, tokens, CAST(floor(loss * 1e4 + 0.5) / 1e4 AS DOUBLE) AS loss_density, CAST(floor(tokens * (1 - loss) * 1e2 + 0.5) / 1e2 AS DOUBLE) AS priority, contains_p1, (tokens >= 2048 OR zone = 'Z5') AND tokens <= 65536 AS passes FROM s),
h AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY priority DESC, tokens DESC, first_seq) AS rank FROM v WHERE passes)"""
)


@query(f"WITH {_SEGMENTS} SELECT * FROM v")
def segments(spark, sf_dir):
    """W8 A3 P6."""
    return G.segments(_tiered(spark, sf_dir)).drop("first_pos", "under_min", "over_cap")


@query(f"WITH {_SEGMENTS} SELECT session, first_seq, CAST(rank AS INTEGER) AS rank, priority FROM h")
def ranked_segments(spark, sf_dir):
    """O1."""
    return G.ranked(G.segments(_tiered(spark, sf_dir))).select("session", "first_seq", "rank", "priority")


@query(f"WITH {_SEGMENTS} SELECT session, first_seq, last_seq, tokens FROM h WHERE rank = 1")
def best_segment(spark, sf_dir):
    """O2."""
    return G.best(G.segments(_tiered(spark, sf_dir))).select("session", "first_seq", "last_seq", "tokens")


@query(
    f"""WITH {_TIERED} SELECT session, count(*) AS n_units, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (protection = 'P0') AS n_p0, count(*) FILTER (protection = 'P0_TRANSIENT') AS n_p0_transient, count(*) FILTER (protection = 'P1') AS n_p1,
 count(*) FILTER (tier = 'PINNED') AS by_p0, count(*) FILTER (tier <> 'PINNED' AND in_floor) AS by_floor, count(*) FILTER (tier <> 'PINNED' AND NOT in_floor AND NOT {A.ALLOWED}) AS by_tier, count(*) FILTER (tier <> 'PINNED' AND NOT in_floor AND {A.ALLOWED}) AS candidates,
 CAST(floor(avg(score) * 1e4 + 0.5) / 1e4 AS DOUBLE) AS avg_score, min(score) AS min_score, max(score) AS max_score FROM t GROUP BY session"""
)
def plan_metrics(spark, sf_dir):
    """A2."""
    return G.metrics(_tiered(spark, sf_dir))


@query(f"WITH {_SEGMENTS}, z AS (SELECT DISTINCT session, zone FROM o) SELECT z.session, z.zone, CASE WHEN z.zone = 'Z0' THEN 'none' WHEN z.zone = 'Z1' THEN 'fresh-prune' WHEN h.session IS NOT NULL THEN 'compact' ELSE 'none' END AS action FROM z LEFT JOIN h ON z.session = h.session AND h.rank = 1")
def decisions(spark, sf_dir):
    """V6."""
    rows = _tiered(spark, sf_dir)
    chosen = G.best(G.segments(rows)).select("session", F.lit(True).alias("has"))
    return rows.select("session", "zone").distinct().join(chosen, "session", "left").select("session", "zone", G.decision(F.col("zone"), F.coalesce("has", F.lit(False))).alias("action"))


@query(f"WITH {A.ORDER_UNITS}, k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY pos) AS nth FROM o) SELECT session, pos, CAST(nth AS INTEGER) AS nth FROM k WHERE nth <= 5")
def topk_units(spark, sf_dir):
    """O3: the first five of a session (a plan shows 400)."""
    nth = F.row_number().over(Window.partitionBy("session").orderBy("pos"))
    return A.order_units(spark, sf_dir).select("session", "pos", nth.alias("nth")).where("nth <= 5")


@query(
    f"""WITH {A.EVENT_MESSAGES}, r AS (SELECT session, pos, CASE WHEN pos = 1 THEN 'system' ELSE role END AS role, tokens, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS calls, CASE WHEN role = 'tool' THEN 1 ELSE 0 END AS results FROM m),
w AS (SELECT *, sum(tokens) OVER (PARTITION BY session ORDER BY pos DESC) AS kept, sum(calls - results) OVER (PARTITION BY session ORDER BY pos) - (calls - results) AS bal FROM r),
x AS (SELECT session, coalesce(min(pos) FILTER (role <> 'system'), max(pos) + 1) AS head, coalesce(max(pos) FILTER (kept >= 3000), min(pos)) AS cut FROM w GROUP BY session),
y AS (SELECT w.session, any_value(x.head) AS head, max(w.pos) FILTER (w.pos <= x.cut AND w.pos > x.head AND w.bal = 0) AS stop FROM w JOIN x ON w.session = x.session GROUP BY w.session)
SELECT session, head AS from_pos, stop - 1 AS to_pos FROM y WHERE stop IS NOT NULL"""
)
def calibrated_range(spark, sf_dir):
    """The newest 3,000 tokens stay."""
    m = A.event_messages(spark, sf_dir)
    rows = m.select("session", "pos", F.when(F.col("pos") == 1, "system").otherwise(F.col("role")).alias("role"), "tokens", (F.col("event_type") == "view").cast("long").alias("calls"), (F.col("role") == "tool").cast("long").alias("results"))
    return U.calibrated_range(rows, F.lit(3000))


@query(
    """WITH e AS (SELECT user_id AS session, event_id AS pos, date_diff('hour', TIMESTAMP '2024-01-01', ts) // 12 AS t, value FROM events),
l AS (SELECT *, lead(t) OVER (PARTITION BY session ORDER BY pos) AS nx FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY pos DESC) AS r FROM l WHERE nx IS NULL OR nx <> t)
SELECT session, pos, t FROM k WHERE r <= 12"""
)
def history_ring(spark, sf_dir):
    """W13 T4 (the newest 12 points)."""
    hours = F.floor((F.unix_seconds(F.date_trunc("hour", F.col("ts").cast("timestamp"))) - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))) / 43200)
    points = read(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("pos"), hours.alias("t"))
    return U.in_ring(points, 12)


@query(
    f"""WITH {A.EVENT_MESSAGES}, e AS (SELECT session, pos, CASE WHEN event_type IN ('error', 'view') THEN 'max-tokens' ELSE event_type END AS kind FROM m),
r AS (SELECT *, sum(CASE WHEN kind = 'max-tokens' THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY pos) AS run FROM e),
s AS (SELECT *, sum(CASE WHEN kind = 'max-tokens' THEN 1 ELSE 0 END) OVER (PARTITION BY session, run ORDER BY pos) AS streak FROM r)
SELECT session, pos, kind, CAST(streak AS BIGINT) AS streak, kind = 'max-tokens' AND streak <= 3 AS continues FROM s"""
)
def continuation_runs(spark, sf_dir):
    """W15 T9."""
    m = A.event_messages(spark, sf_dir)
    return U.continuations(m.select("session", "pos", F.when(F.col("event_type").isin("error", "view"), "max-tokens").otherwise(F.col("event_type")).alias("kind")))


_STEPS = """e AS (SELECT user_id AS session, event_id AS event_seq, CASE event_type WHEN 'click' THEN 'user' WHEN 'error' THEN 'max-tokens' WHEN 'view' THEN 'max-tokens' ELSE 'stop' END AS kind,
 CASE WHEN event_type = 'click' AND event_id % 3 <> 0 THEN 'continuation' END AS form, CASE WHEN event_id % 7 <> 0 THEN event_id // 200 END AS turn FROM events)"""


def continuation_events(spark, sf_dir):
    """Events as ends of turns and user messages; every fourth is told twice."""
    e = read(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("event_seq"), F.expr("CASE event_type WHEN 'click' THEN 'user' WHEN 'error' THEN 'max-tokens' WHEN 'view' THEN 'max-tokens' ELSE 'stop' END").alias("kind"), F.expr("CASE WHEN event_type = 'click' AND event_id % 3 <> 0 THEN 'continuation' END").alias("form"), F.expr("CASE WHEN event_id % 7 <> 0 THEN event_id div 200 END").alias("turn"))
    return rows.unionByName(rows.where("event_seq % 4 = 0"))


@query(
    f"""WITH {_STEPS}, r AS (SELECT *, sum(CASE WHEN kind = 'max-tokens' THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY event_seq) AS run FROM e WHERE NOT (kind = 'user' AND form IS NOT DISTINCT FROM 'continuation')),
a AS (SELECT *, lag(turn) OVER (PARTITION BY session, run ORDER BY event_seq) AS before FROM r WHERE kind = 'max-tokens'),
n AS (SELECT *, row_number() OVER (PARTITION BY session, run ORDER BY event_seq) AS n FROM a WHERE coalesce(turn <> before, true))
SELECT session, event_seq, CAST(least(n, 4) AS BIGINT) AS n, n <= 3 AS continues FROM n"""
)
def continuation_steps(spark, sf_dir):
    """Repeats count once, the continuation's own prompts break no run."""
    return U.continuation_steps(continuation_events(spark, sf_dir))


@query("SELECT user_id AS session, count(*) FILTER (event_type = 'purchase') AS compacted, count(*) FILTER (event_type = 'error') AS pruned, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM events GROUP BY user_id")
def executed_counters(spark, sf_dir):
    """A13 A14."""
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("session")).agg(F.count_if(F.col("event_type") == "purchase").alias("compacted"), F.count_if(F.col("event_type") == "error").alias("pruned"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_at"))


@query("WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations) SELECT conv_id, turn FROM n WHERE r <= ceil(0.75 * total)")
def shrink_region(spark, sf_dir):
    """The newest three quarters of a region stay."""
    from ctxloom.operators.coverage import shrunk

    return shrunk(read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("region"), F.col("turn").alias("pos"))).select(F.col("region").alias("conv_id"), F.col("pos").alias("turn"))


#: Units whose texts meet every rule, a ledger of nations, and what the two have to do with each other.
PLANNED_TEXT = """CASE event_type
 WHEN 'click' THEN CASE event_id % 4 WHEN 0 THEN 'Do not change user ' || user_id WHEN 1 THEN 'actually, use plan ' || user_id WHEN 2 THEN 'Goal: keep user ' || user_id ELSE 'backward-compat matters for parser v1.' || (event_id % 9) END
 WHEN 'purchase' THEN CASE event_id % 2 WHEN 0 THEN 'decided to use v1.' || (event_id % 9) || ', see DEC-' || (event_id % 40) ELSE 'fixed the parser in v1.' || (event_id % 9) END
 WHEN 'signup' THEN CASE event_id % 4 WHEN 0 THEN 'all tests pass' WHEN 1 THEN 'hello from berlin office' ELSE 'nothing new about plan ' || event_id END
 WHEN 'error' THEN 'root cause: E_TIMEOUT exit code: 1'
 ELSE CASE WHEN event_id % 3 = 1 THEN 'match line ' || (event_id % 5) || chr(10) || 'other line ' || (event_id % 4) ELSE 'reading /srv/app/config.yaml' END END"""
PLANNED_TOOL = "CASE WHEN event_type IN ('error', 'view') THEN CASE event_id % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'grep' ELSE 'pwsh' END END"
PLANNED_ARGS = """CASE event_type WHEN 'error' THEN 'run' WHEN 'view' THEN CASE WHEN event_id % 3 = 1 THEN 'needle' ELSE '{"path": "/srv/app/config.yaml"}' END END"""
STANDING = "the parser of /srv/app/config.yaml moves to v1.3"
_NATION = "concat('## [DEC-', n_nationkey, '] ', n_name, chr(10), '- status: ', CASE WHEN n_nationkey % 3 = 0 THEN 'SUPERSEDED' ELSE 'ACTIVE' END, CASE WHEN n_nationkey % 4 = 1 THEN concat(chr(10), '- see DEC-', n_nationkey + 2) ELSE '' END, chr(10), '- source: berlin office ', n_nationkey)"


def _memory(spark, sf_dir):
    lines = read(spark, sf_dir, "nation").select(F.lit("DECISIONS.md").alias("file"), (F.col("n_nationkey") * 10).alias("at"), F.posexplode(F.split(F.expr(_NATION), "\n")).alias("i", "text"))
    index = held(L.index(lines.select("file", (F.col("at") + F.col("i")).alias("line_no"), "text")))
    bound = read(spark, sf_dir, "events").where("event_id % 97 = 0").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.concat(F.lit("DEC-"), F.col("event_id") % 25).alias("entry_id"))
    loose = index.where(F.substring_index("id", "-", -1).cast("int") % 5 == 2).select("id", F.lit("unbound").alias("reason"))
    return Memory(index, bound, loose, STANDING)


def _scored(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    made = {"kind": F.expr(A.EVENT_KIND), "text": F.expr(PLANNED_TEXT), "tool": F.expr(PLANNED_TOOL), "tool_args": F.expr(PLANNED_ARGS), "open": F.col("event_id") % 50 == 0, "tokens": 20 + F.col("event_id") % 400}
    key = F.col("event_id")
    units = e.select(F.col("user_id").alias("session"), *(key.alias(k) for k in ("pos", "first_seq", "last_seq")), F.array(key).alias("seqs"), "ts", *(v.alias(k) for k, v in made.items()))
    windows = units.select("session").distinct().withColumn("context_window", F.lit(12000) + (F.col("session") % 7) * 3000)
    return scored_units(units, windows, F.lit("2024-02-01").cast("timestamp"), _memory(spark, sf_dir))


def _list(items: str) -> str:
    return f"list_distinct(list_transform({items}, lambda s: lower(s)))"


_STOP = f"string_split('{P.KEYWORD_STOP}', ' ')"
_BARE = r"list_transform(regexp_extract_all(t, '\b[A-Za-z_$][A-Za-z0-9_$]{2,}(?:[.-][A-Za-z0-9_$]+)*\b'), lambda s: regexp_replace(s, '^[.-]+|[.-]+$', '', 'g'))"
_LANES = {
    "ids": _list(r"regexp_extract_all(t, '\b(?:REQ|DEC|TECH|BENCH|TASK|BLOCK|CMP|CONFLICT|STATE)-\d+\b')"),
    "paths": _list(r"regexp_extract_all(t, '(?:/[A-Za-z0-9_.@-]+){2,}')"),
    "symbols": _list(f"list_filter({_BARE}, lambda s: length(s) >= 3 AND NOT list_contains({_STOP}, lower(s)) AND (regexp_matches(s, '[A-Z0-9_-]') OR (regexp_matches(s, '^[a-z][a-z0-9]*$') AND length(s) >= 5)))"),
    "errors": _list(r"regexp_extract_all(t, '\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b|\b[A-Z][A-Z0-9]{4,}\b') || regexp_extract_all(t, '\b[45]\d{2}\b') || regexp_extract_all(t, ':(\d{2,5})\b', 1)"),
    "models": _list(r"list_filter(regexp_extract_all(t, '\b[a-z][a-z0-9]*(?:-[a-z0-9]+)+\b'), lambda s: regexp_matches(s, '\d')) || regexp_extract_all(t, '\bv?\d+\.\d+(?:\.\d+)*(?:-[0-9A-Za-z.-]+)?\b')"),
    "keywords": f"list_filter({_list(r"regexp_extract_all(t, '[a-zA-Z]{4,}')")}, lambda s: NOT list_contains({_STOP}, s))",
}
_OF = ", ".join(f"{v} AS {k}" for k, v in _LANES.items())
_FP_T = FP.replace("lower(text)", "lower(t)")
_TAU = "CASE type WHEN 'user-request' THEN 24 WHEN 'assistant-reasoning' THEN 16 WHEN 'file-read' THEN 8 WHEN 'search-result' THEN 5 ELSE 3 END"
_X = "CASE type WHEN 'user-request' THEN 0.0 WHEN 'assistant-reasoning' THEN 0.3 WHEN 'file-read' THEN 0.95 ELSE 0.9 END::DOUBLE"
_RAW = "greatest(0, least(1, greatest(intrinsic, 0.55 * relevance + 0.3 * recency + 0.15 * dependency) + 0.1 * dependency - 0.22 * x - 0.18 * duplication - penalty))"

_PLANNED = f"""led AS (SELECT 'DEC-' || n_nationkey AS id, n_nationkey AS k, n_nationkey % 3 <> 0 AS act FROM nation),
acts AS (SELECT list(id) AS ids FROM led WHERE act), cits AS (SELECT list('DEC-' || (k + 2)) AS ids FROM led WHERE act AND k % 4 = 1 AND k + 2 < 25),
u AS (SELECT user_id AS session, event_id AS pos, {A.EVENT_KIND} AS kind, {PLANNED_TEXT} AS t, {PLANNED_TOOL} AS tool, {PLANNED_ARGS} AS args, event_id % 50 = 0 AS open, 20 + event_id % 400 AS tokens, event_type, 12000 + (user_id % 7) * 3000 AS win,
  event_id % 97 = 0 AND (event_id % 25) % 3 <> 0 AS source, (epoch_ms(TIMESTAMP '2024-02-01 00:00:00') - epoch_ms(ts)) / 60000.0 AS age FROM events),
lane AS (SELECT *, {_OF}, {_FP_T} AS fp FROM u),
st AS (SELECT {_OF} FROM (SELECT '{STANDING}' AS t)),
lastq AS (SELECT session, arg_max(t, pos) AS t FROM u WHERE kind = 'user' GROUP BY session),
asked AS (SELECT session, {_OF} FROM (SELECT s.session, coalesce(q.t, '') AS t FROM (SELECT DISTINCT session FROM u) s LEFT JOIN lastq q ON s.session = q.session)),
f AS (SELECT l.*, list_filter(list_transform(l.ids, lambda s: upper(s)), lambda s: list_contains(acts.ids, s)) AS cited, len(list_filter(l.ids, lambda s: list_contains(cits.ids, upper(s)))) > 0 AS leans,
  contains(lower(t), 'berlin') AND contains(lower(t), 'office') AS held, list_concat(a.ids, st.ids) AS qi, list_concat(a.paths, st.paths) AS qp, list_concat(a.symbols, st.symbols) AS qs, list_concat(a.errors, st.errors) AS qe, list_concat(a.models, st.models) AS qm, list_concat(a.keywords, st.keywords) AS qk, st.paths AS sp,
  count(*) FILTER (kind = 'user') OVER (PARTITION BY l.session) - count(*) FILTER (kind = 'user') OVER (PARTITION BY l.session ORDER BY pos) AS after,
  row_number() OVER (PARTITION BY l.session, fp ORDER BY pos) AS nth, coalesce(tool || ':' || args, kind) AS grp FROM lane l JOIN asked a ON l.session = a.session, st, acts, cits),
g AS (SELECT *, CASE WHEN open THEN 'P0_TRANSIENT' WHEN kind = 'user' OR source OR len(cited) > 0 THEN 'P0' WHEN held OR event_type = 'purchase' OR t = 'all tests pass' OR event_type = 'error' OR (event_type = 'view' AND event_id3 <> 1) THEN 'P1' ELSE 'NORMAL' END AS protection,
  CASE WHEN kind = 'user' THEN 'user-request' WHEN kind = 'assistant' THEN 'assistant-reasoning' WHEN tool = 'read' THEN 'file-read' WHEN tool = 'grep' THEN 'search-result' ELSE 'tool-log' END AS type,
  string_split(t, chr(10)) AS ls FROM (SELECT *, pos % 3 AS event_id3 FROM f)),
h AS (SELECT *, lag(list_distinct(ls)) OVER (PARTITION BY session, grp, nth > 1 ORDER BY pos) AS prev,
  CASE WHEN kind = 'tool-pair' AND tool = 'read' AND len(paths) > 0 THEN count(*) OVER (PARTITION BY session, CASE WHEN kind = 'tool-pair' AND tool = 'read' THEN paths[1] END) END AS reads,
  row_number() OVER (PARTITION BY session, CASE WHEN kind = 'tool-pair' AND tool = 'read' THEN paths[1] END ORDER BY pos) AS read FROM g),
d AS (SELECT *, CASE WHEN nth > 1 THEN 1.0 ELSE greatest(CASE WHEN kind <> 'tool-pair' OR prev IS NULL THEN 0.0 ELSE 0.5 * len(list_intersect(list_distinct(ls), prev)) / len(list_distinct(list_concat(ls, prev))) END, CASE WHEN reads >= 3 AND read > 1 AND read < reads THEN 0.8 ELSE 0.0 END) END::DOUBLE AS duplication,
  least(1.0, CASE WHEN list_has_any(ids, list_concat(qi, list_transform(cited, lambda s: lower(s)))) THEN 0.5 ELSE 0 END + CASE WHEN list_has_any(paths, qp) THEN 0.4 ELSE 0 END + CASE WHEN list_has_any(symbols, qs) THEN 0.35 ELSE 0 END + CASE WHEN list_has_any(errors, qe) THEN 0.35 ELSE 0 END + CASE WHEN list_has_any(models, qm) THEN 0.3 ELSE 0 END + CASE WHEN list_has_any(keywords, qk) THEN 0.25 ELSE 0 END)::DOUBLE AS relevance,
  (CASE WHEN len(cited) > 0 THEN 0.5 ELSE 0 END + CASE WHEN leans THEN 0.25 ELSE 0 END + CASE WHEN list_has_any(paths, sp) THEN 0.25 ELSE 0 END)::DOUBLE AS dependency,
  0.75::DOUBLE * exp(-after / ({_TAU})::DOUBLE) + 0.25::DOUBLE * exp(-age::DOUBLE / (({_TAU}) * 30)) AS recency, {_X} AS x, least(0.15, 0.02 * log2(greatest(tokens, 256) / 256.0)) AS penalty,
  greatest(CASE type WHEN 'user-request' THEN 0.35 WHEN 'assistant-reasoning' THEN 0.55 WHEN 'tool-log' THEN 0.15 ELSE 0.3 END, CASE WHEN protection <> 'P1' THEN 0 WHEN event_type = 'purchase' AND pos % 2 = 0 THEN 0.98 WHEN t = 'all tests pass' THEN 0.85 WHEN event_type = 'error' THEN 0.82 WHEN event_type = 'purchase' THEN 0.8 WHEN event_type = 'view' AND event_id3 <> 1 THEN 0.75 ELSE 0 END)::DOUBLE AS intrinsic FROM h),
sc AS (SELECT *, CASE WHEN protection IN ('P0', 'P0_TRANSIENT') THEN 1.0 WHEN protection = 'P1' THEN greatest(0.75, {_RAW}) ELSE {_RAW} END::DOUBLE AS score, sum(tokens) OVER (PARTITION BY session ORDER BY pos DESC) AS cum, sum(tokens) OVER (PARTITION BY session) AS used FROM d),
fl AS (SELECT *, CASE WHEN protection IN ('P0', 'P0_TRANSIENT') THEN 'PINNED' WHEN score >= 0.82 THEN 'HOT' WHEN score >= 0.58 THEN 'WARM' WHEN score >= 0.28 THEN 'COLD' ELSE 'TRASH' END AS tier,
  pos >= coalesce(max(pos) FILTER (cum >= greatest(2048, least(12288, floor(win * 0.06)))) OVER (PARTITION BY session), min(pos) OVER (PARTITION BY session)) AS in_floor,
  (used + greatest(2048, least(16384, win * 0.05)) + floor(greatest(1024, least(6144, win * 0.025)))) / win AS soft, (used + greatest(2048, least(16384, win * 0.05)) + floor(greatest(2048, least(8192, win * 0.04)))) / win AS hard, floor(greatest(2048, least(8192, win * 0.03))) AS least_back FROM sc),
zo AS (SELECT *, CASE WHEN hard >= 1 OR soft >= 0.94 THEN 'Z5' WHEN soft >= 0.88 THEN 'Z4' WHEN soft >= 0.78 THEN 'Z3' WHEN soft >= 0.68 THEN 'Z2' WHEN soft >= 0.55 THEN 'Z1' ELSE 'Z0' END AS zone FROM fl),
el AS (SELECT *, {A.ELIGIBLE} AS eligible FROM zo)"""


@query(f"WITH {_PLANNED} SELECT session, pos, protection, tier, {SIX('score')} AS score, {SIX('relevance')} AS relevance, {SIX('duplication')} AS duplication, dependency, {SIX('recency')} AS recency, in_floor, zone, eligible FROM el")
def planned_units(spark, sf_dir):
    """V7 U1 P3f P3g P3h J3 J4 J5 F1-F8 W2-W7: units of a plan with ledger, query and tools."""
    got = _scored(spark, sf_dir)
    return got.select("session", "pos", "protection", "tier", six(F.col("score")).alias("score"), six(F.col("relevance")).alias("relevance"), six(F.col("duplication")).alias("duplication"), "dependency", six(F.col("recency")).alias("recency"), "in_floor", "zone", "eligible")


@query(
    f"""WITH {_PLANNED}, i AS (SELECT *, sum(CASE WHEN eligible THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY pos) AS run FROM el),
s AS (SELECT session, min(pos) AS first_seq, max(pos) AS last_seq, CAST(sum(tokens) AS BIGINT) AS tokens, CASE WHEN sum(tokens) > 0 THEN sum(score * tokens) / sum(tokens) ELSE 0 END AS loss, bool_or(protection = 'P1') AS p1, any_value(zone) AS zone, any_value(least_back) AS least_back FROM i WHERE eligible GROUP BY session, run),
v AS (SELECT *, floor(tokens * (1 - loss) * 1e2 + 0.5) / 1e2 AS priority FROM s WHERE (tokens >= least_back OR zone = 'Z5') AND tokens <= 65536),
r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY priority DESC, tokens DESC, first_seq) AS rank FROM v),
b AS (SELECT session, any_value(zone) AS zone, count(*) AS n_units, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (eligible) AS n_eligible, count(*) FILTER (zone = 'Z1' AND tier = 'TRASH' AND protection = 'NORMAL' AND (NOT in_floor OR x >= 0.8)) AS n_prunable FROM el GROUP BY session)
SELECT b.*, r.first_seq, r.last_seq, r.tokens AS reclaim, r.p1 AS requires_sync, false AS degraded, CASE WHEN b.zone = 'Z0' THEN 'none' WHEN b.zone = 'Z1' THEN 'fresh-prune' WHEN r.session IS NOT NULL THEN 'compact' ELSE 'none' END AS action FROM b LEFT JOIN r ON b.session = r.session AND r.rank = 1"""
)
def planner(spark, sf_dir):
    """The whole plan over the event sessions."""
    return plan(_scored(spark, sf_dir))


@query(f"WITH {_PLANNED}, k AS (SELECT *, 'E' || pos AS unit FROM el) SELECT session, pos, len(cited) AS n_cited, leans, source, held FROM k WHERE len(cited) > 0 OR leans OR source OR held")
def memory_lanes(spark, sf_dir):
    """What the ledger has to do with each unit."""
    got = _scored(spark, sf_dir).where((F.size("cited") > 0) | F.col("leans") | (F.size("sources") > 0) | F.col("held"))
    return got.select("session", "pos", F.size("cited").cast("long").alias("n_cited"), "leans", (F.size("sources") > 0).alias("source"), "held")


@query("SELECT conv_id AS session, min(turn) AS \"start\", max(turn) AS \"end\", CAST(sum(20 * length(text)) FILTER (turn > 0) AS BIGINT) AS tokens, coalesce(sum(20 * length(text)) FILTER (turn > 0), 0) < 1024 AS skipped FROM (SELECT *, greatest(turn, 1) AS t FROM conversations WHERE turn > 0) GROUP BY conv_id")
def manual_spans(spark, sf_dir):
    """Whether all but a conversation's first turn is worth compacting."""
    nodes = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), (20 * F.length("text")).cast("long").alias("tokens"))
    spans = nodes.where("seq > 0").groupBy("session").agg(F.min("seq").alias("start"), F.max("seq").alias("end"))
    return M.span_tokens(nodes, spans)


_REGION = """r AS (SELECT doc_id % 40 AS region, doc_id AS pos, text, CASE doc_id % 3 WHEN 0 THEN 'P0' WHEN 1 THEN 'P1' ELSE 'NORMAL' END AS protection, doc_id % 7 = 0 AS checkpoint FROM documents),
i AS (SELECT item_id AS seq, text || ' took ' || (item_id * 3 + 11) || '.5 ms' AS text FROM benchmark),
o AS (SELECT region, protection, text FROM r WHERE protection <> 'NORMAL' UNION ALL SELECT r.region, r.protection, i.text FROM r JOIN i ON r.checkpoint AND r.protection <> 'NORMAL' AND i.seq = r.pos % 40)"""


def _regions(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    cp = F.col("doc_id") % 7 == 0
    units = d.select(
        (F.col("doc_id") % 40).alias("region"), F.col("doc_id").alias("pos"), F.col("doc_id").alias("unit_id"), F.lit(1).alias("session"), F.when(cp, "checkpoint").otherwise("tool-pair").alias("kind"), F.expr("CASE doc_id % 3 WHEN 0 THEN 'P0' WHEN 1 THEN 'P1' ELSE 'NORMAL' END").alias("protection"),
        "text", F.when(cp, F.array(F.col("doc_id") % 40)).alias("source_event_seqs"),
    )
    items = read(spark, sf_dir, "benchmark").select(F.lit(1).alias("session"), F.col("item_id").alias("seq"), F.concat("text", F.lit(" took "), F.col("item_id") * 3 + 11, F.lit(".5 ms")).alias("text"))
    return units, items


@query(f"WITH {_REGION}, f AS (SELECT DISTINCT region, protection AS grade, unnest({FACT_SQL}) AS fact FROM o) SELECT region, grade, count(*) AS n_facts, min(fact) AS first_fact, max(fact) AS last_fact FROM f GROUP BY region, grade")
def region_facts(spark, sf_dir):
    """Exact facts of a region, those that a checkpoint stands for among them."""
    return M.region_facts(*_regions(spark, sf_dir)).groupBy("region", "grade").agg(F.count("*").alias("n_facts"), F.min("fact").alias("first_fact"), F.max("fact").alias("last_fact"))


@query(
    f"""WITH {_REGION}, nn AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY pos DESC) AS back, count(*) OVER (PARTITION BY region) AS n FROM r WHERE NOT checkpoint OR region % 5 = 0),
f AS (SELECT DISTINCT region, protection AS grade, unnest({FACT_SQL}) AS fact FROM nn WHERE protection <> 'NORMAL'),
l AS (SELECT DISTINCT region, protection AS grade, unnest({FACT_SQL}) AS fact FROM nn WHERE protection <> 'NORMAL' AND back <= ceil(0.75 * n)),
z AS (SELECT region, max(n) AS n, max(n) - CAST(ceil(0.75 * max(n)) AS BIGINT) AS cut, bool_or(checkpoint) AS synced FROM nn GROUP BY region),
w AS (SELECT z.region, z.n, z.cut, z.synced, list(f.fact ORDER BY f.grade, f.fact) FILTER (f.fact IS NOT NULL) AS facts FROM z LEFT JOIN f ON z.region = f.region GROUP BY ALL),
y AS (SELECT w.*, region % 4 AS k, (SELECT count(*) FROM f WHERE f.region = w.region) AS n_all, (SELECT count(*) FROM l WHERE l.region = w.region) AS n_late FROM w)
SELECT region, CASE WHEN synced OR n_all = 0 OR k IN (0, 1) OR (cut > 0 AND n_late = 0) THEN 'applied' WHEN region % 8 = 3 THEN 'degraded' ELSE 'cancelled' END AS status,
 CASE WHEN synced OR n_all = 0 OR k = 0 THEN 1 WHEN k = 1 THEN 2 WHEN cut > 0 THEN 3 ELSE 2 END::BIGINT AS attempts, CASE WHEN NOT (synced OR n_all = 0 OR k IN (0, 1)) AND cut > 0 THEN cut ELSE 0 END::BIGINT AS n_dropped FROM y""".replace("GROUP BY ALL", "GROUP BY z.region, z.n, z.cut, z.synced")
)
def compaction_outcomes(spark, sf_dir):
    """V2 V3: a quarter of the regions keeps its facts at once, one when it is told what it lost, the others never.

    Every fifth region holds checkpoints, so its facts and those of the originals are in memory first.
    """
    units, items = _regions(spark, sf_dir)
    units, items = held(M.with_facts(units.where("kind <> 'checkpoint' or region % 5 = 0"))), M.with_facts(items)
    facts = M.region_facts(units, items).groupBy("region").agg(F.array_join(F.collect_set("fact"), " ").alias("all"))
    region = units.select("region").distinct().join(facts, "region", "left").withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    k = F.col("region") % 4
    good = (k == 0) | ((k == 1) & (F.col("attempt") >= 2))
    attempts = region.select("region", "attempt", F.when(good, F.concat(F.lit("kept: "), F.coalesce("all", F.lit("")))).otherwise("kept nothing of it").alias("summary"))
    return M.compacted(units, items, attempts, emergency=region.where("region % 8 = 3")).select("region", "status", "attempts", "n_dropped")


_ROUNDS = "SELECT o_orderkey AS request, i AS round, CAST(floor(o_totalprice) AS BIGINT) - i * (o_orderkey % 5) * 20000 AS projected, CASE WHEN o_orderkey % 5 = 4 AND i >= 2 THEN 1 ELSE i END AS generation, 200016 AS target, 1000 + o_orderkey AS most, 2048 AS margin, o_orderkey % 4 AS retries, o_orderkey % 3 * 700 AS asked FROM orders, range(4) t(i)"


@query(
    f"""WITH r AS ({_ROUNDS}), s AS (SELECT *, NOT (greatest(projected, 0) + greatest(most, 1) + margin > target) AS fits, coalesce(lead(generation) OVER (PARTITION BY request ORDER BY round) <= generation, false) AS stuck FROM r),
e AS (SELECT *, NOT fits AND round < retries AND stuck AS halted FROM s), f AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY round) AS n FROM e WHERE fits OR round >= retries OR halted),
g AS (SELECT *, greatest(0, least(greatest(most, 1), target - greatest(projected, 0) - margin)) AS safe FROM f WHERE n = 1)
SELECT request, CAST(round + CASE WHEN halted THEN 1 ELSE 0 END AS BIGINT) AS compactions, projected, CAST(safe AS BIGINT) AS safe, CAST(CASE WHEN safe > 0 THEN least(CASE WHEN asked > 0 THEN asked ELSE most END, safe) END AS BIGINT) AS max_tokens, safe <= 0 AS exhausted FROM g"""
)
def request_guard(spark, sf_dir):
    """Orders as requests, each compacted up to three times."""
    o = read(spark, sf_dir, "orders").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<long>")))
    k, i = F.col("o_orderkey"), F.col("round")
    rounds = o.select(k.alias("request"), "round", (F.floor("o_totalprice") - i * (k % 5) * 20000).alias("projected"), F.when((k % 5 == 4) & (i >= 2), 1).otherwise(i).alias("generation"), F.lit(200016).alias("target"), (k + 1000).alias("most"), F.lit(2048).alias("margin"), (k % 4).alias("retries"), (k % 3 * 700).alias("asked"))
    return B.request_guard(rounds)


@query(
    """WITH a AS (SELECT o_custkey AS session, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS attempt, CAST(floor(o_totalprice) AS BIGINT) AS before, CAST(floor(o_totalprice * 0.6) AS BIGINT) AS after, o_orderkey % 11 <> 0 AS has_range FROM orders), b AS (SELECT * FROM a WHERE attempt <= 2),
g AS (SELECT session, arg_min(before, attempt) AS b0, arg_min(has_range, attempt) AS r0, min(attempt) FILTER (has_range AND after < 90000) AS worked, min(attempt) FILTER (NOT has_range) AS blocked, count(*) AS n FROM b GROUP BY session),
o AS (SELECT *, CASE WHEN b0 < 90000 THEN 'below' WHEN NOT r0 THEN 'nothing' WHEN worked IS NOT NULL AND (blocked IS NULL OR worked < blocked) THEN 'compacted' ELSE 'host' END AS outcome FROM g)
SELECT session, outcome, CAST(CASE WHEN outcome IN ('below', 'nothing') THEN 0 WHEN outcome = 'compacted' THEN worked + 1 ELSE coalesce(blocked, n) END AS BIGINT) AS n_attempts FROM o"""
)
def calibrated_loop(spark, sf_dir):
    """A customer's orders as attempts to fall below a threshold."""
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    a = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), nth.cast("long").alias("attempt"), F.floor("o_totalprice").alias("before"), F.floor(F.col("o_totalprice") * 0.6).alias("after"), (F.col("o_orderkey") % 11 != 0).alias("has_range"), F.lit(90000).alias("threshold"), F.lit(2).alias("retries"))
    return B.calibrated_loop(a)
