"""Nested blocks, node-level pruning and landing, router pages, and tiers by generation."""

import json
import random

from pyspark.sql import functions as F

from ctxloom.operators import ledger as L
from ctxloom.operators import prune as R
from ctxloom.operators import scoring as S
from ctxloom.plans.planner import history_points
from ctxloom.sources import blocks as B
from ctxloom.sources import sessions as E


def plain_text(content):
    """What blocks say, by recursion."""
    out = []
    for b in content:
        inner = b.get("content")
        if b.get("type") == "tool-call":
            continue
        if b.get("type") in ("text", "reasoning"):
            said = b.get("text") or ""
        elif isinstance(inner, list) and all(isinstance(x, dict) for x in inner):
            said = plain_text(inner)
        elif inner is not None:
            said = inner if isinstance(inner, str) else json.dumps(inner, separators=(",", ":"))
        else:
            said = b.get("text") or ""
        if said:
            out.append(said)
    return "\n".join(out)


def made(rng, depth):
    out = []
    for _ in range(rng.randrange(0 if depth < 3 else 1, 4)):
        kind = rng.choice(["text", "reasoning", "tool-call", "tool-result", "image", "tool-result"])
        b = {"type": kind}
        if kind in ("text", "reasoning"):
            b["text"] = rng.choice(["", "a b", "[1]", "é\n{", "x" * 30])
        elif kind == "tool-call":
            b |= {"name": "read", "arguments": "{}"}
        else:
            b["content"] = made(rng, depth - 1) if depth and rng.random() < 0.7 else rng.choice(["", "[not blocks", '[{"a":1}]', "ok"])
        out.append(b)
    return out


def test_blocks_of_any_depth(spark):
    rng = random.Random(2)
    deep = [{"type": "text", "text": "end"}]
    for i in range(40):
        deep = [{"type": "text", "text": f"l{i}"}, {"type": "tool-result", "content": deep}]
    contents = [deep, *(made(rng, rng.randrange(7)) for _ in range(60)), []]
    rows = [(i, json.dumps(c)) for i, c in enumerate(contents)] + [(900, "plain [text"), (901, '["a", 1]'), (902, None)]
    found = B.exploded(spark.createDataFrame(rows, "k long, content string").repartition(3), ["k"])
    got = {r.k: r.text for r in B.texts(found, ["k"]).collect()}
    want = {i: plain_text(c) for i, c in enumerate(contents) if c} | {900: "plain [text", 901: '["a", 1]'}
    assert got == want
    assert found.where("k = 0").agg(F.max(F.size("path"))).first()[0] == 41
    as_blocks = {r.k: r.said for r in E.with_blocks(spark.createDataFrame(rows, "k long, content string"), ["k"]).select("k", E.block_text(F.col("blocks")).alias("said")).collect()}
    assert {k: v for k, v in as_blocks.items() if v} == {k: v for k, v in want.items() if v}


def test_prices_of_nested_blocks(spark):
    units = lambda s, rate: -(-len(s) * 10 // int(rate * 10))
    content = [{"type": "text", "text": "abcde"}, {"type": "tool-call", "name": "read", "arguments": "{}"}, {"type": "tool-result", "content": [{"type": "text", "text": "abcde"}, {"type": "tool-result", "content": [{"type": "text", "text": "xyz"}]}]}, {"type": "image", "content": [{"type": "text", "text": "alt"}]}]
    want = units("abcde", 4) + 4 + units("read", 4) + units("{}", 1.8) + 4 + 4 + units("abcde", 1.8) + 4 + 4 + units("xyz", 1.8) + 4 + units(json.dumps(content[3], separators=(",", ":")), 4) + 4 + 4
    got = B.prices(B.exploded(spark.createDataFrame([(1, json.dumps(content))], "k long, content string"), ["k"]), ["k"])
    assert [tuple(r) for r in got.collect()] == [(1, want)]


def test_nodes_are_pruned_by_their_own_text(spark):
    long = "\n".join(f"hit {i % 5}" for i in range(400))
    nodes = [(1, 10, "assistant", "call"), (1, 11, "tool", long), (1, 12, "tool", "short"), (1, 13, "tool", None), (1, 14, "tool", long), (2, 11, "tool", "x" * 200)]
    surface = spark.createDataFrame(nodes, "session long, seq long, role string, text string")
    acts = [(1, 1, "reduce", "grep", "", "f1", [10, 11, 12, 13, 99]), (1, 2, "drop", "grep", "", "f2", [11, 12, 14]), (1, 3, "drop", "grep", "", "f3", [14]), (2, 1, "none", "grep", "", "f4", [11]), (2, 2, "drop", "grep", "", "f5", [11])]
    actions = spark.createDataFrame(acts, "session long, pos long, action string, tool string, args string, raw string, result_seqs array<long>")
    pruned = R.node_prunes(surface, actions)
    got = {(r.session, r.seq): (r.pos, r.action, r.new) for r in pruned.collect()}
    reduced = R.reduced(spark.createDataFrame([(1, "grep", "", long)], "k long, tool string, args string, text string")).first()["reduced"]
    assert got == {(1, 11): (1, "reduce", reduced), (1, 14): (2, "drop", R.STUB % "f2"), (2, 11): (2, "drop", R.STUB % "f5")}
    last = spark.createDataFrame([(1, 14), (2, 11)], "session long, last_seq long")
    events, after = R.landing(surface, pruned, last, F.when(F.col("seq") == 11, F.lit(7.0)))
    told = sorted((r.session, r.seq, r.type, r.shadowed_seqs, r.shadowed_tokens) for r in events.collect())
    flat = float(-(-len(long) // 4))
    assert told == [(1, 15, "compaction/prune", [11], 7.0), (1, 16, "tool/result", [11], None), (1, 17, "compaction/prune", [14], flat), (1, 18, "tool/result", [14], None), (2, 12, "compaction/prune", [11], 7.0), (2, 13, "tool/result", [11], None)]
    left = {(r.session, r.seq): (r.text, r.source_event_seqs) for r in after.collect()}
    assert left == {(1, 10): ("call", None), (1, 16): (reduced, [11]), (1, 12): ("short", None), (1, 13): (None, None), (1, 18): (R.STUB % "f2", [14]), (2, 13): (R.STUB % "f5", [11])}
    nothing, same = R.landing(surface, R.node_prunes(surface, actions.limit(0)), last, F.lit(1.0))
    assert nothing.count() == 0 and same.count() == len(nodes)


def test_router_page(spark):
    found = [("p", "DECISIONS.md", i, f"DEC-{i:03d}", "ACTIVE") for i in range(10, 20)] + [("p", "DECISIONS.md", 1, "NOTE-1", "ACTIVE"), ("p", "CONFLICTS.md", 1, "CONFLICT-001", None), ("p", "CONFLICTS.md", 2, "CONFLICT-002", "RESOLVED"), ("p", "STATE.md", 1, "STATE-CURRENT", None), ("p", "STATE.md", 9, "STATE-CURRENT", None)]
    entries = spark.createDataFrame(found, "project string, file string, place long, id string, status string")
    history = spark.createDataFrame([("p", "- [1] a"), ("p", "free"), ("p", "- [2] b")], "project string, text string")
    pages = {r.project: r.page.split("\n") for r in L.router_page(entries, history, spark.createDataFrame([("p", "now"), ("empty", None)], "project string, note string")).collect()}
    assert pages["p"][4:] == ["| STATE.md | What holds now | 1 (STATE-CURRENT, STATE-CURRENT) |", f"| DECISIONS.md | Decisions and why | 10 ({', '.join(f'DEC-{i:03d}' for i in range(10, 18))} (+2 more)) |", "| TECH.md | Technical facts | 0 () |", "| HISTORY.md | Log of syncs, append-only | 2 |", "| CONFLICTS.md | Open contradictions | 2 (CONFLICT-001, CONFLICT-002) |", "- Last sync: now", "- Active conflicts: 1"]
    assert pages["empty"][-3:] == ["| CONFLICTS.md | Open contradictions | 0 () |", "- Last sync: ", "- Active conflicts: 0"]


def test_tiers_of_another_generation_are_void(spark):
    plans = spark.createDataFrame([(1, 1, 10, "HOT"), (1, 5, 10, "WARM"), (1, 5, 11, "COLD"), (2, 5, 20, "HOT"), (3, 5, 30, "HOT"), (4, 5, 40, "HOT")], "session long, at long, first_seq long, tier string")
    surfaces = spark.createDataFrame([(1, 2, 1), (2, 6, 1), (3, 5, 4), (5, 1, 1), (4, 6, 2), (4, 7, 0)], "session long, at long, generation long")
    got = sorted(tuple(r) for r in S.tiers_in_force(plans, surfaces).collect())
    assert got == [(1, 10, 1, "WARM"), (1, 11, 1, "COLD"), (3, 30, 4, "HOT"), (4, 40, 0, "HOT")]


def test_injected_tokens_of_a_plan(spark):
    units = spark.createDataFrame([(1, p, "injected" if p % 2 else "user", 10 + p) for p in range(6)], "session long, pos long, kind string, tokens long")
    plans = spark.createDataFrame([(1, "Z2", "compact", 500, False), (2, None, "none", None, True)], "session long, zone string, action string, reclaim long, degraded boolean")
    assert sorted(map(tuple, history_points(units, plans, 4).collect()), key=str) == [(1, "Z2", "compact", 500, 24, False), (2, None, "none", 0, 0, True)]


def test_checkpoints_tell_what_they_stand_for(spark):
    rows = spark.createDataFrame([("checkpoint", [1, 2, 3]), ("checkpoint", [4]), ("checkpoint", None), ("user", None)], "kind string, seqs array<long>")
    none = F.lit("")
    p = S.protection(F.col("kind"), none, none, F.lit(False), F.lit(False), shadowed=F.col("seqs"))
    got = [tuple(r) for r in rows.select(p.alias("p"), S.intrinsic(F.lit("checkpoint"), F.col("p.protection"), F.col("p.reasons")).alias("i")).select("p.protection", "p.reasons", "i").collect()]
    assert [x[:2] for x in got] == [("P1", ["checkpoint of 3 nodes"]), ("P1", ["checkpoint of 1 node"]), ("P1", ["checkpoint of 0 nodes"]), ("NORMAL", [])]
    assert got[0][2] == 0.9


def test_views(spark, tmp_path):
    from ctxloom import api
    from ctxloom.sources import ledger_files as L

    folder = str(tmp_path / "ledger")
    L.ensured(spark, folder)
    (tmp_path / "ledger" / "STATE.md").write_text("# STATE\nmine")
    L.ensured(spark, folder)
    names = {p.name for p in (tmp_path / "ledger").iterdir() if not p.name.endswith(".crc")}
    assert len(names) == 8 and (tmp_path / "ledger" / ".gitignore").read_text() == "*\n" and (tmp_path / "ledger" / "STATE.md").read_text() == "# STATE\nmine"
    L.ensured(spark, folder, tracked=True)
    assert not (tmp_path / "ledger" / ".gitignore").exists()
    (tmp_path / "ledger" / "DECISIONS.md").write_text("# D\n\n## [DEC-001] t\n- status: ACTIVE\n- fact\n")
    points = spark.createDataFrame([(1, p, p // 2) for p in range(600)], "session long, pos long, t long")
    done = spark.createDataFrame([(1, "prune", 2, 5), (1, "prune", 1, 9)], "session long, kind string, n long, at long")
    routes = spark.createDataFrame([("a/b", 9000, None, None), ("c/d", 500, 10, 7)], "route string, target long, most long, margin long")
    able = spark.createDataFrame([("a/b", 8000, 0, True)], "route string, window long, max_tokens long, stale boolean")
    budgets = spark.createDataFrame([(1, k) for k in range(9)], "session long, at long")
    api.publish_state(points, done, routes, able, budgets, api.MemoryLedger(spark, folder))
    assert spark.table("plan_history").count() == 240
    assert sorted(map(tuple, spark.table("plan_executed").collect())) == [(1, "official", 0, None), (1, "prune", 3, 9), (1, "semantic", 0, None)]
    assert sorted(map(tuple, spark.table("route_settings").collect())) == [("a/b", 8000, 0, True, 8000, 1, 2048, ["target"]), ("c/d", 0, 0, False, 500, 10, 7, ["target", "most", "margin"])]
    assert sorted(r["at"] for r in spark.table("request_budgets").collect()) == [5, 6, 7, 8]
    assert [tuple(r) for r in spark.table("provenance").collect()] == [("DEC-001", "unbound")]
