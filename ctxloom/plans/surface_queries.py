"""Queries over nested blocks, prices of whole sessions, landed surfaces, router pages and plans over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxloom.api import executed
from ctxloom.api import route_settings as settings_of
from ctxloom.functions import text as T
from ctxloom.operators import ledger as L
from ctxloom.operators import prune as R
from ctxloom.operators import scoring as S
from ctxloom.operators import segments as G
from ctxloom.operators import units as U
from ctxloom.plans.planner import history_points as points_of
from ctxloom.plans.registry import held, query, read
from ctxloom.plans.session_queries import _SEGMENTS, _tiered
from ctxloom.plans.text_queries import FP
from ctxloom.sources import adapters as A
from ctxloom.sources import blocks as B

#: Turns as messages whose blocks nest one to 31 deep; what is innermost is a text, or blocks one of which no rule knows.
_CONTENT = """repeat('[{{"type":"text","text":"step"}},{{"type":"tool-result","content":', 1 + (conv_id + turn) % 31) || CASE turn % 3 WHEN 0 THEN '"in the [end]"' ELSE '[{{"type":"text","text":' || {text} || '}},{{"type":"image","url":"u' || turn || '"}}]' END || repeat('}}]', 1 + (conv_id + turn) % 31)"""
_UNNESTED = f"""RECURSIVE j AS (SELECT conv_id, turn, {_CONTENT.format(text="CAST(to_json(coalesce(text, '')) AS VARCHAR)")} AS c FROM conversations),
t0 AS (SELECT conv_id, turn, from_json(c, '["JSON"]') AS items FROM j),
b(conv_id, turn, path, code, blk) AS (SELECT conv_id, turn, [i], false, blk FROM (SELECT conv_id, turn, unnest(items) AS blk, generate_subscripts(items, 1) AS i FROM t0)
 UNION ALL SELECT conv_id, turn, list_append(path, i), code, x FROM (SELECT conv_id, turn, path, code OR json_extract_string(blk, '$.type') = 'tool-result' AS code, unnest(from_json(json_extract(blk, '$.content'), '["JSON"]')) AS x, generate_subscripts(from_json(json_extract(blk, '$.content'), '["JSON"]'), 1) AS i FROM b WHERE json_type(blk, '$.content') = 'ARRAY'))"""


def _nested(spark, sf_dir):
    said = F.expr("substr(to_json(struct(coalesce(text, '') as text)), 9, length(to_json(struct(coalesce(text, '') as text))) - 9)")
    rows = read(spark, sf_dir, "conversations").withColumn("said", said)
    return rows.select("conv_id", "turn", F.expr(_CONTENT.format(text="said")).alias("content"))


@query(
    f"""WITH {_UNNESTED}, s AS (SELECT *, coalesce(json_extract_string(blk, '$.text'), CASE WHEN json_type(blk, '$.content') = 'VARCHAR' THEN json_extract_string(blk, '$.content') END) AS said FROM b)
SELECT conv_id, turn, max(len(path)) AS depth, string_agg(said, chr(10) ORDER BY path) FILTER (said <> '') AS text FROM s GROUP BY conv_id, turn"""
)
def nested_texts(spark, sf_dir):
    """Blocks nested up to 31 deep, as text."""
    found = B.exploded(_nested(spark, sf_dir), ["conv_id", "turn"])
    depth = found.groupBy("conv_id", "turn").agg(F.max(F.size("path")).cast("long").alias("depth"))
    return B.texts(found, ["conv_id", "turn"]).join(depth, ["conv_id", "turn"])


_BLOCK_PRICE = """CASE json_extract_string(blk, '$.type') WHEN 'text' THEN ceil(length(json_extract_string(blk, '$.text')) / CASE WHEN code THEN 1.8::DOUBLE ELSE 4 END)
 WHEN 'tool-result' THEN CASE WHEN json_type(blk, '$.content') = 'VARCHAR' THEN ceil(length(json_extract_string(blk, '$.content')) / 1.8::DOUBLE) + 4 ELSE 0 END ELSE ceil(length(CAST(blk AS VARCHAR)) / 4.0::DOUBLE) END + 4"""


@query(
    f"""WITH {_UNNESTED}, p AS (SELECT conv_id, turn, sum({_BLOCK_PRICE}) + 4 AS tokens FROM b GROUP BY conv_id, turn),
n AS (SELECT c.conv_id, CASE WHEN c.turn % 7 = 6 THEN 0 WHEN c.turn % 5 = 4 THEN ceil(length('{{"n":' || c.turn || '}}') / 4.0) + 4 ELSE p.tokens END AS tokens FROM conversations c LEFT JOIN p ON c.conv_id = p.conv_id AND c.turn = p.turn)
SELECT conv_id AS session, CAST(sum(tokens) + ceil(length('you help in ' || conv_id) / 4.0) + 4 + CASE WHEN conv_id % 2 = 0 THEN ceil(length('[{{"name":"read"}}]') / 4.0) + 4 ELSE 0 END AS BIGINT) AS tokens FROM n GROUP BY conv_id"""
)
def priced_sessions(spark, sf_dir):
    """Sessions by their nested blocks, events without a message, missing events and the header."""
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"))
    message = (F.col("seq") % 7 != 6) & (F.col("seq") % 5 != 4)
    said = _nested(spark, sf_dir).withColumnsRenamed({"conv_id": "session", "turn": "seq"}).where(message)
    other = turns.where((F.col("seq") % 7 != 6) & (F.col("seq") % 5 == 4))
    priced = B.prices(B.exploded(said, ["session", "seq"]), ["session", "seq"]).unionByName(other.select("session", "seq", T.priced_structure(F.concat(F.lit('{"n":'), "seq", F.lit("}"))).alias("tokens")))
    tools = F.when(F.col("session") % 2 == 0, '[{"name":"read"}]').otherwise("[]")
    header = turns.select("session").distinct().select("session", T.priced_header(F.concat(F.lit("you help in "), "session"), tools).alias("header_tokens"))
    return U.session_totals(turns, priced, header)


# A surface of search results, one or two nodes a unit, pruned by a plan and landed

_CLEAN = r"list_filter(list_transform(string_split_regex({t}, '\r?\n'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '')"


def _reduced_sql(name: str, source: str, text: str) -> str:
    """``name``: the rows of ``source`` (key, ...) with ``made``, their text as the search reducer has it, and ``fp``."""
    lines = _CLEAN.format(t=text)
    return f"""{name}0 AS (SELECT *, {FP.replace('lower(text)', f'lower({text})')} AS fp, {lines} AS ls, len(string_split_regex({text}, '\\r?\\n')) AS n_lines FROM {source}),
{name}1 AS (SELECT key, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM {name}0),
{name}2 AS (SELECT key, arg_min(line, i) AS line, min(i) AS i FROM {name}1 GROUP BY key, lower(line)),
{name}3 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY i) AS nth FROM {name}2),
{name}4 AS (SELECT key, count(*) AS n, string_agg(chr(10) || '  ' || line, '' ORDER BY i) FILTER (nth <= 200) AS body FROM {name}3 GROUP BY key),
{name} AS (SELECT r.*, CASE WHEN n_lines < 32 AND length({text}) < 1600 THEN {text} ELSE 'Matches (' || coalesce(l.n, 0) || CASE WHEN len(ls) > coalesce(l.n, 0) THEN ', ' || (len(ls) - l.n) || ' duplicates dropped' ELSE '' END || '):' || coalesce(l.body, '') || CASE WHEN l.n > 200 THEN chr(10) || '  … ' || (l.n - 200) || ' more' ELSE '' END
 || chr(10) || 'raw: ' || fp || ' (' || n_lines || ' lines, reconstructible)' END AS made FROM {name}0 r LEFT JOIN {name}4 l ON r.key = l.key)"""


_LANDED = f"""n AS (SELECT lang AS session, doc_id AS seq, doc_id AS key, doc_id - CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END AS unit, coalesce(text, '') AS t, doc_id % 9 <> 4 AS textual FROM documents),
w AS (SELECT session, unit, unit AS pos, session || '|' || unit AS key, string_agg(t, chr(10) ORDER BY seq) AS t, unit % 10 = 0 AS in_floor, unit % 8 <> 0 AS inside FROM n GROUP BY session, unit),
{_reduced_sql('u', 'w', 't')},
{_reduced_sql('m', 'n', 't')},
a AS (SELECT *, inside AND row_number() OVER (PARTITION BY session, fp, inside ORDER BY pos) > 1 AS again FROM u),
c AS (SELECT *, CASE WHEN inside AND again AND NOT in_floor THEN 'drop' WHEN inside AND length(made) < length(t) THEN 'reduce' END AS action FROM a),
x AS (SELECT m.session, m.seq, c.pos, CASE c.action WHEN 'drop' THEN '[pruned: duplicate tool result — raw: ' || c.fp || ' (reconstructible)]' ELSE m.made END AS new, m.t, c.action, m.seq % 5 AS meter FROM m JOIN c ON m.session = c.session AND m.unit = c.unit WHERE c.action IS NOT NULL AND m.textual),
l AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY pos, seq) AS k FROM x WHERE length(new) < length(t)),
e AS (SELECT session, max(seq) AS last FROM n GROUP BY session),
d AS (SELECT l.*, e.last + 2 * k AS new_seq, CASE WHEN meter = 0 THEN ceil(length(t) / 4.0) ELSE floor(length(t) / 3) END::DOUBLE AS price FROM l JOIN e ON l.session = e.session)"""


def _landed(spark, sf_dir):
    key = F.col("doc_id")
    nodes = read(spark, sf_dir, "documents").select(F.col("lang").alias("session"), key.alias("seq"), (key - (key % 4 == 1).cast("long")).alias("unit"), F.lit("tool").alias("role"), F.coalesce("text", F.lit("")).alias("whole"), F.when(key % 9 != 4, F.coalesce("text", F.lit(""))).alias("text"))
    parts = F.sort_array(F.collect_list(F.struct("seq", "whole")))
    units = nodes.groupBy("session", "unit").agg(parts.alias("parts"))
    pos = F.col("unit")
    units = units.select(
        "session", pos.alias("pos"), F.lit("tool-pair").alias("kind"), F.lit(False).alias("open"), F.lit("grep").alias("tool"), F.lit("").alias("args"), F.array_join(F.transform("parts", lambda p: p["whole"]), "\n").alias("text"),
        F.transform("parts", lambda p: p["seq"]).alias("result_seqs"), F.lit("NORMAL").alias("protection"), F.when(pos % 8 == 0, "COLD").otherwise("TRASH").alias("tier"), (pos % 10 == 0).alias("in_floor"), F.lit(0.9).alias("x"),
    )
    actions = R.planned(units.withColumn("raw", T.fingerprint(F.col("text"))), F.lit("Z2")).select("session", "pos", "action", "tool", "args", "raw", "result_seqs")
    last = nodes.groupBy("session").agg(F.max("seq").alias("last_seq"))
    meter = F.when(F.col("seq") % 5 != 0, F.floor(F.length("text") / 3).cast("double"))
    prunes = held(R.node_prunes(nodes, actions))  # reduced once, for their numbers and for what lands
    return R.landing(nodes, prunes, last, meter)


@query(f"WITH {_LANDED} SELECT n.session, n.seq AS was, coalesce(d.new_seq, n.seq) AS seq, length(coalesce(d.new, n.t)) AS chars, CASE WHEN n.textual THEN sha1(coalesce(d.new, n.t)) END AS text_sha1, d.new IS NOT NULL AS replaced FROM n LEFT JOIN d ON n.session = d.session AND n.seq = d.seq")
def landed_surface(spark, sf_dir):
    """A plan's actions met with the result nodes on a surface, and the surface after they landed."""
    after = _landed(spark, sf_dir)[1]
    replaced = F.col("source_event_seqs").isNotNull()
    return after.select("session", F.when(replaced, F.get("source_event_seqs", 0)).otherwise(F.col("seq")).alias("was"), "seq", F.length(F.coalesce("text", "whole")).cast("long").alias("chars"), F.sha1("text").alias("text_sha1"), replaced.alias("replaced"))


@query(f"WITH {_LANDED} SELECT session, new_seq - 1 AS seq, 'compaction/prune' AS type, seq AS shadowed, price AS tokens FROM d UNION ALL SELECT session, new_seq, 'tool/result', seq, NULL FROM d")
def landed_events(spark, sf_dir):
    """What landing appends to the log: a price before each replacement, in plan order."""
    return _landed(spark, sf_dir)[0].select("session", "seq", "type", F.get("shadowed_seqs", 0).alias("shadowed"), F.col("shadowed_tokens").alias("tokens"))


# Router pages

_FILE_OF = "CASE o_orderkey % 5 WHEN 0 THEN 'PROJECT.md' WHEN 1 THEN 'DECISIONS.md' WHEN 2 THEN 'TECH.md' WHEN 3 THEN 'CONFLICTS.md' ELSE 'STATE.md' END"
_ID_OF = "CASE o_orderkey % 5 WHEN 0 THEN 'REQ-' || o_orderkey WHEN 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'NOTE-' ELSE 'DEC-' END || o_orderkey WHEN 2 THEN 'TECH-' || o_orderkey WHEN 3 THEN 'CONFLICT-' || o_orderkey ELSE 'STATE-CURRENT' END"
_STATUS_OF = "CASE o_orderstatus WHEN 'F' THEN 'ACTIVE' WHEN 'O' THEN NULL ELSE 'RESOLVED' END"


def _page_sql() -> str:
    rows = []
    for name, purpose, p in L.PAGE:
        if p is None:
            rows.append(f"'| {name} | {purpose} | ' || coalesce(h.n, 0) || ' |'")
            continue
        n = f"coalesce(max(r.n) FILTER (r.file = '{name}'), 0)"
        said = f"least({n}, 1)" if p == "STATE-CURRENT" else n
        rows.append(f"'| {name} | {purpose} | ' || {said} || ' (' || coalesce(max(r.ids) FILTER (r.file = '{name}'), '') || CASE WHEN {n} > 8 THEN ' (+' || ({n} - 8) || ' more)' ELSE '' END || ') |'")
    body = " || chr(10) || ".join(["'# INDEX — memory router'", "'| File | Purpose | Entries |'", "'|---|---|---|'", *rows, "'- Last sync: customer ' || p.project", "'- Active conflicts: ' || coalesce(any_value(c.n), 0)"])
    return f"""WITH e AS (SELECT o_custkey AS project, o_orderkey AS place, {_FILE_OF} AS file, {_ID_OF} AS id, {_STATUS_OF} AS status FROM orders),
o AS (SELECT *, row_number() OVER (PARTITION BY project, file ORDER BY place) AS nth FROM e WHERE id NOT LIKE 'NOTE-%'),
r AS (SELECT project, file, count(*) AS n, string_agg(id, ', ' ORDER BY place) FILTER (nth <= 8) AS ids FROM o GROUP BY project, file),
h AS (SELECT o_custkey AS project, count(*) AS n FROM orders WHERE o_orderkey % 4 = 0 GROUP BY o_custkey),
c AS (SELECT project, count(*) AS n FROM e WHERE file = 'CONFLICTS.md' AND coalesce(status, 'ACTIVE') = 'ACTIVE' GROUP BY project),
p AS (SELECT DISTINCT o_custkey AS project FROM orders)
SELECT p.project, {body.replace("coalesce(h.n, 0)", "coalesce(any_value(h.n), 0)")} AS page FROM p LEFT JOIN r ON p.project = r.project LEFT JOIN h ON p.project = h.project LEFT JOIN c ON p.project = c.project GROUP BY p.project"""


@query(_page_sql())
def router_pages(spark, sf_dir):
    """A customer's orders as a ledger, with conflicts that are still open and lines of history."""
    o = read(spark, sf_dir, "orders")
    entries = o.select(F.col("o_custkey").alias("project"), F.expr(_FILE_OF).alias("file"), F.col("o_orderkey").alias("place"), F.expr(_ID_OF).alias("id"), F.expr(_STATUS_OF).alias("status"))
    history = o.select(F.col("o_custkey").alias("project"), F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("- ["), "o_orderkey", F.lit("] applied 1"))).otherwise("free text").alias("text"))
    projects = o.select(F.col("o_custkey").alias("project")).distinct().withColumn("note", F.concat(F.lit("customer "), "project"))
    return L.router_page(entries, history, projects)


# Plans over time


@query(
    """WITH o AS (SELECT o_custkey AS session, o_orderkey AS k, o_orderdate AS day, CASE o_orderstatus WHEN 'F' THEN 'HOT' WHEN 'O' THEN 'WARM' ELSE 'COLD' END AS tier FROM orders),
g AS (SELECT session, max(day) AS changed, count(*) AS generation FROM o WHERE k % 4 = 0 GROUP BY session), l AS (SELECT session, max(day) AS last FROM o WHERE k % 4 <> 0 GROUP BY session)
SELECT o.session, k AS first_seq, coalesce(g.generation, 0) AS generation, tier AS before FROM o JOIN l ON o.session = l.session AND o.day = l.last LEFT JOIN g ON o.session = g.session WHERE k % 4 <> 0 AND (g.changed IS NULL OR g.changed <= l.last)"""
)
def tiers_in_force(spark, sf_dir):
    """Orders as plans or, every fourth, as changes of the surface, which void the plans before them."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("at"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'HOT' WHEN 'O' THEN 'WARM' ELSE 'COLD' END").alias("tier"))
    changes = o.where("k % 4 = 0")
    nth = F.row_number().over(S.Window.partitionBy("session").orderBy("at", "k")).cast("long")
    surfaces = changes.select("session", "at", nth.alias("generation"))
    return S.tiers_in_force(o.where("k % 4 <> 0").select("session", "at", F.col("k").alias("first_seq"), "tier"), surfaces)


@query(
    f"""WITH {_SEGMENTS}, zo AS (SELECT session, any_value(zone) AS zone FROM o GROUP BY session),
ij AS (SELECT session, sum(tokens) AS inj FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY pos) AS nth FROM o) WHERE nth <= 6 AND pos % 3 = 0 GROUP BY session)
SELECT zo.session, zo.zone, CASE WHEN zo.zone = 'Z0' THEN 'none' WHEN zo.zone = 'Z1' THEN 'fresh-prune' WHEN h.session IS NOT NULL THEN 'compact' ELSE 'none' END AS action, CAST(coalesce(h.tokens, 0) AS BIGINT) AS reclaim, CAST(coalesce(ij.inj, 0) AS BIGINT) AS inj, false AS degraded
FROM zo LEFT JOIN h ON zo.session = h.session AND h.rank = 1 LEFT JOIN ij ON zo.session = ij.session"""
)
def history_points(spark, sf_dir):
    """What plans leave in the history, with the injected tokens among the first six units."""
    rows = _tiered(spark, sf_dir)
    best = G.best(G.segments(rows)).select("session", F.col("tokens").alias("reclaim"))
    plans = rows.select("session", "zone").distinct().join(best, "session", "left")
    plans = plans.withColumn("action", G.decision(F.col("zone"), F.col("reclaim").isNotNull())).withColumn("degraded", F.lit(False))
    units = A.order_units(spark, sf_dir).select("session", "pos", "tokens", F.when(F.col("pos") % 3 == 0, "injected").otherwise("user").alias("kind"))
    return points_of(units, plans, 6)


@query(
    """WITH d AS (SELECT user_id AS session, CASE event_type WHEN 'purchase' THEN 'prune' WHEN 'error' THEN 'official' END AS kind, event_id % 3 AS n, ts FROM events WHERE event_type IN ('purchase', 'error')),
k AS (SELECT DISTINCT session, unnest(['prune', 'semantic', 'official']) AS kind FROM d)
SELECT k.session, k.kind, CAST(coalesce(sum(d.n), 0) AS BIGINT) AS n, strftime(max(d.ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM k LEFT JOIN d ON k.session = d.session AND k.kind = d.kind GROUP BY k.session, k.kind"""
)
def executed_by_kind(spark, sf_dir):
    """What was carried out of plans, by kind, with kinds that never were."""
    e = read(spark, sf_dir, "events").where("event_type in ('purchase', 'error')")
    done = e.select(F.col("user_id").alias("session"), F.when(F.col("event_type") == "purchase", "prune").otherwise("official").alias("kind"), (F.col("event_id") % 3).alias("n"), F.col("ts").alias("at"))
    return executed(done).withColumn("last_at", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss"))


@query(
    """WITH c AS (SELECT p_partkey AS route, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 8000 + p_size * 1000 END AS w, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 500 + p_size * 10 END AS m, p_partkey % 5 = 0 AS stale FROM part WHERE p_partkey % 7 <> 0),
r AS (SELECT p_partkey AS route, CASE WHEN p_size > 10 THEN p_size * 900 END AS target, CASE WHEN p_size > 20 THEN p_size * 30 END AS most, CASE WHEN p_size > 30 THEN p_size END AS margin FROM part WHERE p_partkey % 2 = 0),
b AS (SELECT coalesce(c.route, r.route) AS route, coalesce(w, 0) AS w, coalesce(m, 0) AS m, coalesce(stale, false) AS stale, target, most, margin FROM c FULL JOIN r ON c.route = r.route)
SELECT route, w AS "window", m AS max_tokens, stale, CAST(CASE WHEN w > 0 THEN least(coalesce(target, w), w) ELSE coalesce(target, 0) END AS BIGINT) AS target, CAST(CASE WHEN m > 0 THEN least(coalesce(most, m), m) ELSE coalesce(most, 1) END AS BIGINT) AS most, CAST(coalesce(margin, 2048) AS BIGINT) AS margin,
 concat_ws('|', CASE WHEN target IS NOT NULL THEN 'target' END, CASE WHEN most IS NOT NULL THEN 'most' END, CASE WHEN margin IS NOT NULL THEN 'margin' END) AS configured FROM b"""
)
def route_settings(spark, sf_dir):
    """Parts as routes, with what their models can do and what was configured."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("route"), F.col("p_size").cast("long").alias("s"))
    k, s = F.col("route"), F.col("s")
    able = p.where(k % 7 != 0).select("route", F.when(k % 4 == 0, 0).otherwise(8000 + s * 1000).alias("window"), F.when(k % 3 == 0, 0).otherwise(500 + s * 10).alias("max_tokens"), (k % 5 == 0).alias("stale"))
    routes = p.where(k % 2 == 0).select("route", F.when(s > 10, s * 900).alias("target"), F.when(s > 20, s * 30).alias("most"), F.when(s > 30, s).alias("margin"))
    return settings_of(routes, able).withColumn("configured", F.array_join("configured", "|"))


# Reducers of tool results

#: The i-th of 48 lines of a document's made output.
_LINE = """CASE (doc_id * 31 + i * 17) % 13 WHEN 0 THEN 'ERROR: code E' || (i % 3) WHEN 1 THEN 'warning: slow step ' || (i % 2) WHEN 2 THEN 'exit code: ' || ((doc_id + i) % 4) WHEN 3 THEN (i % 9) || ' passed' WHEN 4 THEN '✔ case ' || (i % 4)
 WHEN 5 THEN 'FAIL at step ' || i WHEN 6 THEN '@@ -' || i || ',3 +' || (i % 5) || ',3 @@' WHEN 7 THEN '+function f' || (i % 6) || '() {' WHEN 8 THEN '-const c' || i || ' = 1' WHEN 9 THEN 'export class K' || (i % 7)
 WHEN 10 THEN 'diff --git a/x' || i || ' b/x' WHEN 11 THEN 'at run (x.js:1:' || i || ')' ELSE 'some words of ' || n_chars || CASE WHEN i % 2 = 0 THEN '' ELSE ' Again' END END"""
_TOOL = "CASE doc_id % 5 WHEN 0 THEN 'pwsh' WHEN 1 THEN 'pytest' WHEN 2 THEN 'git_diff' WHEN 3 THEN 'read' ELSE 'make' END"
_ARGS = """'{"path": "/srv/app/m' || doc_id || '.py"}'"""


def _reducer_sql() -> str:
    like = lambda p, v="ls": f"list_filter({v}, lambda x: regexp_matches(x, '{p}'))"
    indent = lambda v: f"list_transform({v}, lambda x: '  ' || x)"
    unique = lambda v: f"list_filter({v}, lambda x, i: list_position(list_transform({v}, lambda y: lower(y)), lower(x)) = i)"
    last = lambda p, label: f"CASE WHEN len(regexp_extract_all(t, '{p}', 1)) > 0 THEN ['{label}' || regexp_extract_all(t, '{p}', 1)[-1]] ELSE [] END"
    plain = lambda title, v: f"CASE WHEN len({v}) > 0 THEN ['{title}'] || {indent(v)} ELSE [] END"

    def block(title: str, name: str, most: int, note: str = "") -> str:
        more = f" || CASE WHEN len({name}) > len({name}_u) THEN ', ' || (len({name}) - len({name}_u)) || ' {note}' ELSE '' END" if note else ""
        return f"CASE WHEN len({name}_u) > 0 THEN ['{title} (' || len({name}_u){more} || '):'] || {indent(f'{name}_u[1:{most}]')} ELSE [] END"

    lists = {
        "err": like("(?i)error|exception|fatal|panic|traceback|segmentation|cannot |no such "), "warn": like("(?i)warning|warn:"), "other": like("(?i)error|exception|fatal|traceback"),
        "good": f"list_filter(ls, lambda x: regexp_matches(x, '(?i)✔|✓|\\bpass(ed|ing)?\\b|ok\\b') AND NOT regexp_matches(x, '(?i)failing|failed'))",
        "hunks": like("^@@"), "names": "list_transform(" + like(r"^[+-]\s*(?:export\s+)?(?:function|class|const|let|def|type|interface|public|private)\b") + r", lambda x: regexp_replace(x, '^[+-]\s*', ''))",
        "syms": like("export (?:default )?(?:async )?(?:function|class|const|let|type|interface)|^(?:function|class|def|const) [A-Za-z_$]"),
    }
    fails = r"list_filter(range(1, len(ls) + 1), lambda k: regexp_matches(ls[k], '(?i)✖|✗|\bfail(ed|ure)?\b|Error:') AND NOT regexp_matches(ls[k], '(?i)\b\d+\s+(?:passing|passed|skipped|pending|failing|failed)\b'))[1]"
    number = lambda w: rf"regexp_extract_all(t, '(?i)\b(\d+)\s+(?:{w})\b', 1)[-1]"
    counts = "list_filter([" + ", ".join(f"'{n}: ' || CAST({number(w)} AS BIGINT)" for n, w in (("passed", "passing|passed"), ("failed", "failing|failed"), ("skipped", "skipped|pending"))) + "], lambda x: x IS NOT NULL)"
    exit_code = last(r"(?i)\bexit\s*code\s*:?\s*(\d+)", "Exit Code: ")
    kinds = {
        "pwsh": [exit_code, block("Primary Errors", "err", 8, "duplicated"), block("Warnings", "warn", 4), plain("Last lines:", "tail")],
        "pytest": [f"CASE WHEN len({counts}) > 0 THEN ['Results: ' || array_to_string({counts}, ', ')] ELSE [] END", exit_code, plain("First failure:", "fail[1:3]"), "CASE WHEN origin IS NOT NULL THEN ['  stack origin: ' || origin] ELSE [] END", block("Success cases", "good", 12, "duplicated dropped")],
        "git_diff": [f"CASE WHEN len({like('^diff --git ')}) > 0 THEN [len({like('^diff --git ')}) || ' files changed'] ELSE [] END", rf"['line counts: +' || len(list_filter(ls, lambda x: regexp_matches(x, '^\+') AND NOT regexp_matches(x, '^\+\+\+'))) || ' -' || len(list_filter(ls, lambda x: regexp_matches(x, '^-') AND NOT regexp_matches(x, '^---')))]", block("Hunks", "hunks", 12, "duplicated"), block("Symbols", "names", 12)],
        "read": ["['path: ' || regexp_extract(args, '/[A-Za-z0-9_./-]+'), 'hash: ' || fp]", block("Symbols", "syms", 12), "['range: lines 1-' || len(ls) || ' (preview)']", indent("ls[1:3]")],
        "make": [exit_code, block("Primary Errors", "other", 8), "['Head:']", indent("ls[1:3]"), f"CASE WHEN len(tail) > 3 THEN {plain('Last lines:', 'tail')} ELSE [] END"],
    }
    cases = " ".join(f"WHEN '{k}' THEN " + " || ".join(v) for k, v in kinds.items())
    made = ", ".join(f"{v} AS {k}" for k, v in lists.items())
    ones = ", ".join(f"{unique(k)} AS {k}_u" for k in lists)
    return f"""WITH a AS (SELECT doc_id, {_TOOL} AS tool, {_ARGS} AS args, list_transform(range(1, 49), lambda i: {_LINE}) AS ls FROM documents),
b AS (SELECT *, array_to_string(ls, chr(10)) AS t FROM a), c AS (SELECT *, {FP.replace("lower(text)", "lower(t)")} AS fp, ls[41:48] AS tail, {fails} AS f0, {made} FROM b),
d AS (SELECT *, CASE WHEN f0 IS NULL THEN [] ELSE ls[f0:f0 + 5] END AS fail, {ones} FROM c),
e AS (SELECT *, {like(r'at |Error:|File "|\.js:\d+:\d+|\.py:\d+|\.ts:\d+', 'fail')}[1] AS origin FROM d)
SELECT doc_id, tool, array_to_string((CASE tool {cases} END) || ['raw: ' || fp || ' (48 lines, reconstructible)'], chr(10)) AS reduced FROM e"""


@query(_reducer_sql())
def reduced_results(spark, sf_dir):
    """A made output of each document as its tool's reducer has it."""
    docs = read(spark, sf_dir, "documents")
    text = F.expr(f"array_join(transform(sequence(1L, 48L), i -> {_LINE}), chr(10))")
    made = docs.select("doc_id", F.expr(_TOOL).alias("tool"), F.expr(_ARGS).alias("args"), text.alias("text"))
    return R.reduced(made).select("doc_id", "tool", "reduced")
