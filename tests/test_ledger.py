from pyspark.sql import functions as F

from ctxloom.operators import budget as B
from ctxloom.operators import coverage as C
from ctxloom.operators import ledger as L
from ctxloom.operators import prune as R
from ctxloom.operators import retrieval as V

TEXT = """# DECISIONS

## [DEC-001] Use parser
- confidence: 0.9
- status: ACTIVE
- speed is 52.31 tok/s
- source: "52.31 tok/s"

## [DEC-002] Old way
- status: SUPERSEDED
- see DEC-001
## notes
loose line DEC-001
""".splitlines()


def lines(spark):
    return spark.createDataFrame([("DECISIONS.md", i, t) for i, t in enumerate(TEXT)], "file string, line_no long, text string")


def test_entries_and_search(spark):
    got = {r.id: r for r in L.entries(lines(spark)).collect()}
    assert got["DEC-001"].facts == ["speed is 52.31 tok/s"] and got["DEC-001"].confidence == 0.9 and got["DEC-002"].status == "SUPERSEDED"
    assert [r.entry_id for r in L.search(lines(spark), "tok/s SPEED").collect()] == ["DEC-001"]
    assert L.search(lines(spark), "  ").count() == 0
    assert L.citations(L.index(lines(spark))).collect() == [("DEC-002", "DEC-001")]


REPLACEMENT = ("DECISION", "newer", "now 62.31 tok/s\n\n second ", 2.0, "e1", "now 62.31 tok/s")
OPS = "batch long, idx long, op string, kind string, title string, body string, target_id string, confidence double, source_ref string, source_quote string, grp string, topic string, resolution string, replacement struct<kind:string,title:string,body:string,confidence:double,source_ref:string,source_quote:string>"


def ops(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (14 - len(r))) for r in rows], OPS)


def judged(spark, rows, found, log=(), refs=()):
    log = spark.createDataFrame([(1, s, t) for s, t in log], "batch long, seq long, text string")
    refs = spark.createDataFrame([(1, h, s, t) for h, s, t in refs], "batch long, handle string, seq long, text string")
    return L.atomic(L.validated(L.evidence(L.normalized(ops(spark, rows)), log, refs), found)).persist()


def test_operations(spark):
    rows = ops(
        spark,
        [
            (1, 0, "add", "DEC", "new", "now 62.31 tok/s", None, None, "E1", "now 62.31 tok/s", None),
            (1, 1, "ADD", "DEC", "bad", "now 99.99 tok/s", None, 7.0, "E1", "now 62.31 tok/s", None),
            (1, 2, "SUPERSEDE", None, None, "", "DEC-001", None, "", "", "T", None, None, REPLACEMENT),
            (1, 3, "SUPERSEDE", None, None, "", "DEC-404", None, "", "", "T", None, None, REPLACEMENT),
            (1, 4, "AMEND", None, None, "x", "DEC-001", None, "E9", "quote", None),
            (1, 5, "ADD", "DEC", "loose", "said twice here", None, None, "", "said twice here", None),
        ],
    )
    log = spark.createDataFrame([(1, 1, "we are now 62.31 tok/s"), (1, 2, "he said twice here"), (1, 3, "she said twice here")], "batch long, seq long, text string")
    refs = spark.createDataFrame([(1, "E1", 1, "we are now 62.31 tok/s")], "batch long, handle string, seq long, text string")
    found = L.entries(lines(spark))
    checked = L.atomic(L.validated(L.evidence(L.normalized(rows), log, refs), found)).persist()
    assert {r.idx: r.reason for r in checked.collect()} == {0: None, 1: "MUTATION_WITHOUT_EVIDENCE", 2: "GROUP_REJECTED", 3: "TARGET_NOT_FOUND", 4: "UNKNOWN_REF", 5: "AMBIGUOUS_EVIDENCE"}
    made = L.minted(checked, lines(spark)).persist()
    assert [r.new_id for r in made.where("new_id is not null").collect()] == ["DEC-003"]
    after = L.applied(found, made)
    assert {r.id for r in after.collect()} == {"DEC-001", "DEC-002", "DEC-003"}
    assert {tuple(r) for r in L.integrity(found, after).collect()} == {("STATE-CURRENT", "STATE_MISSING"), ("DEC-002", "SUPERSEDED")}


def test_what_operations_need(spark):
    found = L.entries(lines(spark))
    said = "we are now 62.31 tok/s"
    rows = [
        (1, 0, "add", " technical ", "t", "now 62.31 tok/s", None, None, "e1", "now 62.31 tok/s", None),
        (1, 1, "ADD", "BENCH", "t", "b", None, None, "E1", "now 62.31 tok/s", None),
        (1, 2, "ADD", "DEC", "t", " ", None, None, "E1", "now 62.31 tok/s", None),
        (1, 3, "AMEND", None, "", "x", "DEC-002", None, "E1", "now 62.31 tok/s", None),
        (1, 4, "noop", None, None, None, None, None, "E1", "never said", None),
        (1, 5, "NOOP", None, None, None, None, None, None, None, None),
        (1, 6, "resolve-conflict", None, None, None, "DEC-001", None, "E1", "now 62.31 tok/s", None, None, "settled"),
        (1, 7, "CONFLICT", None, None, "both", None, None, "E1", "now 62.31 tok/s", None, "", None),
        (1, 8, "SUPERSEDE", None, None, None, "DEC-001", None, None, None, None, None, None, ("CONFLICT", "t", "b", None, "E1", "now 62.31 tok/s")),
        (1, 9, "SUPERSEDE", None, None, None, "DEC-001", None, None, None, None, None, None, ("DEC", "t", "b", None, None, None)),
        (1, 10, "AMEND", None, "", "now 52.31 tok/s and 62.31 tok/s", "DEC-001", None, "E1", "we are now", None),
        (1, 11, "update state", None, "", "free text 99", None, None, None, None, None),
        (1, 12, "ADD", "DEC", "t", "b", None, None, "X1", "now 62.31 tok/s", None),
    ]
    got = {r.idx: r for r in judged(spark, rows, found, [(1, said)], [("E1", 1, said)]).collect()}
    assert {k: r.reason for k, r in got.items()} == {0: None, 1: "BAD_OPERATION", 2: "BAD_OPERATION", 3: "TARGET_NOT_ACTIVE", 4: "QUOTE_MISMATCH", 5: None, 6: None, 7: "BAD_OPERATION", 8: "BAD_OPERATION", 9: "NO_EVIDENCE", 10: None, 11: None, 12: "BAD_REF"}
    assert got[0].kind == "TECH" and got[0].evidence_seq == 1 and got[3].detail == "DEC-002 is SUPERSEDED"


def test_operations_change_the_ledger(spark):
    found = L.entries(lines(spark))
    said = "we are now 62.31 tok/s"
    quote = ("E1", "now 62.31 tok/s", None)
    rows = [
        (1, 0, "AMEND", None, "Use the parser", "first\n\n  second ", "DEC-001", None, *quote),
        (1, 1, "SUPERSEDE", None, None, None, "DEC-001", None, None, None, None, None, None, REPLACEMENT),
        (1, 2, "SUPERSEDE", None, None, None, "DEC-001", None, None, None, None, None, None, REPLACEMENT),
        (1, 3, "CONFLICT", None, None, "a\nb", None, 0.4, *quote, "which", None),
        (1, 4, "UPDATE_STATE", None, "", "one\n\ntwo", None, None, None, None, None),
        (1, 5, "ADD", "REQ", "need", "it", None, None, *quote),
    ]
    made = L.minted(judged(spark, rows, found, [(1, said)], [("E1", 1, said)]), lines(spark)).persist()
    after = {r.id: r for r in L.applied(found, made).collect()}
    assert set(after) == {"DEC-001", "DEC-002", "DEC-003", "DEC-004", "CONFLICT-001", "REQ-001", "STATE-CURRENT"}
    old = after["DEC-001"]
    assert (old.status, old.replacement, old.title, old.facts, old.source) == ("SUPERSEDED", "DEC-004", "Use the parser", ["first", "second"], "now 62.31 tok/s")
    new = after["DEC-003"]
    assert (new.status, new.confidence, new.file, new.facts) == ("ACTIVE", 1.0, "DECISIONS.md", ["now 62.31 tok/s", "second"])
    assert (after["CONFLICT-001"].status, after["CONFLICT-001"].title, after["CONFLICT-001"].confidence) == ("ACTIVE", "which", 0.4)
    assert (after["STATE-CURRENT"].title, after["STATE-CURRENT"].verbatim) == ("Current state", "one\n\ntwo")
    text = {r.id: r.markdown for r in L.rendered(L.applied(found, made)).collect()}
    assert text["STATE-CURRENT"] == "## [STATE-CURRENT] Current state\none\n\ntwo"
    assert text["DEC-003"] == "## [DEC-003] newer\n- confidence: 1\n- status: ACTIVE\n- now 62.31 tok/s\n- second\n- source: now 62.31 tok/s"


def test_removed_entries_come_back(spark):
    found = L.entries(lines(spark))
    after = L.restored(found, found.where("id = 'DEC-002'").withColumn("facts", F.array().cast("array<string>")))
    assert {r.id for r in after.collect()} == {"DEC-001", "DEC-002", "STATE-CURRENT"}
    named = L.restored(found, found.where("id = 'DEC-002'"))  # it still cites the one that is gone
    assert {r.id for r in named.collect()} == {"DEC-002", "STATE-CURRENT"}


def test_quotes_of_few_words_and_many_rows(spark):
    rows = spark.createDataFrame([(1, s, f"row {s} has longword{s} inside") for s in range(30)] + [(2, 1, "longword7 elsewhere")], "batch long, seq long, text string")
    asked = ["has longword7 inside", "longword7", "row 1", "has longword", "not there at all"]
    got = {r.quote: (r.hits, r.hit_seq) for r in L.held_once(rows, spark.createDataFrame([(1, q) for q in asked], "batch long, quote string")).collect()}
    want = {q: [s for s in range(30) if q in f"row {s} has longword{s} inside"] for q in asked}
    assert got == {q: (len(w), min(w)) for q, w in want.items() if w}


def test_containment_without_a_broadcast(spark):
    from ctxloom.operators.contains import contained

    rows = spark.createDataFrame([(i, f"alpha beta{i % 3} gamma delta {i}") for i in range(40)], "row_id long, text string")
    quotes = spark.createDataFrame([(1, "beta1 gamma delta"), (2, "ta2 gamma d"), (3, "delta 7"), (4, "eta0"), (5, "none of it")], "quote_id long, quote string")
    pairs = lambda n: sorted(map(tuple, contained(rows, quotes, n).collect()))
    assert pairs(0) == pairs(1 << 20) and pairs(0)


def test_provenance(spark):
    from ctxloom.operators import provenance as W

    entry = lambda i, *more: (1, "DECISIONS.md", i, "ACTIVE", "\n".join([f"## [{i}] t", *more]))
    after = [entry("DEC-1", "- source_ref: E1", "- source: the quick fox"), entry("DEC-2", "- source_ref: E1", "- source: not in it"), entry("DEC-3", "- source_ref: E9", "- source: the quick fox"), entry("DEC-4", "- source: the quick fox jumps"), entry("DEC-5", "- source: a sentence said twice"), entry("DEC-6", "- source: never said by anyone"), entry("DEC-7", "- source: short"), entry("DEC-8", "- source: jumps over the LAZY   dog"), entry("DEC-9", "- source_ref: E2", "- source: ok")]
    kind = "batch long, file string, id string, status string, raw string"
    log = spark.createDataFrame([(1, 10, "The quick fox jumps"), (1, 11, "a sentence said twice"), (1, 12, "a sentence said twice!"), (1, 13, "he jumps over the lazy dog")], "batch long, seq long, text string")
    refs = spark.createDataFrame([(1, "E1", 10, "The quick fox jumps"), (1, "E2", None, "ok")], "batch long, handle string, seq long, text string")
    before = spark.createDataFrame([after[7]], kind)
    bound, failed = W.resolved(spark.createDataFrame(after, kind), before, log, refs)
    assert {(r.seq, r.entry_id) for r in bound.collect()} == {(10, "DEC-1"), (10, "DEC-4")}
    assert {r.entry_id: r.reason for r in failed.collect()} == {"DEC-2": "quote-mismatch", "DEC-3": "unknown-ref", "DEC-5": "ambiguous", "DEC-6": "not-found", "DEC-7": "no-ref", "DEC-9": "unmapped-ref"}
    assert [(r.seq, r.entry_id) for r in W.repaired(spark.createDataFrame(after, kind), bound, failed, log).collect()] == [(13, "DEC-8")]


def test_compaction(spark):
    from ctxloom.operators import compaction as M

    unit = lambda r, p, grade, text, kind="tool-pair", seqs=None: (r, p, p, 1, kind, grade, text, seqs)
    fact = "took {}.5 ms"
    units = [unit("good", 1, "P0", fact.format(1)), unit("retry", 1, "P0", fact.format(2)), unit("cancel", 1, "P0", fact.format(3)), unit("urgent", 1, "P1", fact.format(4)), unit("silent", 1, "P0", fact.format(5)), unit("cp", 1, "P1", "old", "checkpoint", [7, 99]), unit("free", 1, "NORMAL", fact.format(6))]
    units += [unit("shrink", p, "P0" if p == 1 else "NORMAL", fact.format(9)) for p in range(1, 5)]
    kind = "region string, pos long, unit_id long, session long, kind string, protection string, text string, source_event_seqs array<long>"
    said = lambda r, *texts: [(r, i + 1, t) for i, t in enumerate(texts)]
    attempts = said("good", "1.5 ms 1.5") + said("retry", "no", "it is 2.5 ms") + said("cancel", "no", "no") + said("urgent", "no", "last") + said("silent", None, "5.5 ms") + said("cp", "nothing") + said("free", "x") + said("shrink", "no", "no", "still no")
    frame, originals = spark.createDataFrame(units, kind), spark.createDataFrame([(1, 7, "exit code 3 after 8.5 ms")], "session long, seq long, text string")
    urgent = spark.createDataFrame([("urgent",)], "region string")
    got = {r.region: r for r in M.compacted(frame, originals, spark.createDataFrame(attempts, "region string, attempt int, summary string"), emergency=urgent).collect()}
    assert {k: (r.status, r.attempts, r.n_dropped) for k, r in got.items()} == {"good": ("applied", 1, 0), "retry": ("applied", 2, 0), "cancel": ("cancelled", 2, 0), "urgent": ("degraded", 2, 0), "silent": ("cancelled", 2, 0), "cp": ("applied", 1, 0), "free": ("applied", 1, 0), "shrink": ("applied", 3, 1)}
    assert got["silent"].status == "cancelled" and got["silent"].summary is None
    assert got["urgent"].summary.startswith("last\n\nPersistent details:\n") and "4.5" in got["urgent"].summary
    assert {(r.unit_id, r.n_facts) for r in M.recovered(frame, originals).collect()} and got["cp"].missing == []
    spans = spark.createDataFrame([(1, 2, 4), (2, 1, 1), (3, None, None)], "session long, start long, end long")
    nodes = spark.createDataFrame([(1, s, 400) for s in range(6)] + [(2, 1, 5)], "session long, seq long, tokens long")
    assert {r.session: (r.tokens, r.skipped) for r in M.span_tokens(nodes, spans).collect()} == {1: (1200, False), 2: (5, True), 3: (0, False)}


def test_context_is_cut_at_a_line(spark):
    found = spark.createDataFrame([("DECISIONS.md", i, f"DEC-{i:03d}", f"title {i}", "ACTIVE", f"## [DEC-{i:03d}] title {i}\n- fact {i}") for i in range(20)], "file string, place long, id string, title string, status string, raw string")
    said = spark.createDataFrame([(1, "C2", "x"), (2, "C5", "x"), (3, "C0", "x")], "message_id long, class string, text string")
    got = {r.message_id: r.context for r in V.render_context(said, found, F.lit("\n".join(f"state line {i} " + "y" * 60 for i in range(90))), F.lit("the router")).collect()}
    assert got[1].endswith(V.MARKER) and "state line 0 " in got[1] and "state line 89" not in got[1] and got[3] == ""
    lines = got[1].removesuffix(V.MARKER).split("\n")
    assert all(x.endswith("y" * 60) for x in lines if x.startswith("state line"))
    assert "### Router\nthe router" in got[2] and "DEC-007" not in got[2] and got[2].index("DEC-008") < got[2].index("DEC-019")


def test_ids_are_cited_whole(spark):
    vocab = spark.createDataFrame([("DEC-001", True), ("kvcache", False), ("fp", False)], "term string, is_id boolean")
    said = spark.createDataFrame([(1, "dec-001, DEC-0012 and xDEC-001"), (2, "DEC-0011"), (3, "the KVCaches of dec-001-x"), (4, None)], "message_id long, text string")
    assert {r.message_id: (r.n_terms, r.n_ids) for r in V.term_hits(said, vocab).collect()} == {1: (0, 1), 2: (0, 0), 3: (1, 1), 4: (0, 0)}


def test_prices_of_replaced_nodes(spark):
    got = spark.createDataFrame([(5.0, None, 10), (float("nan"), 7.0, 10), (-1.0, None, 10)], "m double, f double, n long").select(R.shadow_price(F.col("m"), F.col("f"), F.col("n")).alias("p")).collect()
    assert [r.p for r in got] == [5.0, 7.0, 3.0]


def test_ledger_by_its_tools(spark, tmp_path):
    import pytest

    from ctxloom.api import MemoryLedger

    (tmp_path / "DECISIONS.md").write_text("\n".join(TEXT))
    (tmp_path / ".provenance.json").write_text('{"sessions":{"s":{"4":["DEC-001"]}},"unresolved":{}}')
    ledger = MemoryLedger(spark, str(tmp_path))
    assert [r.entry_id for r in ledger.search("tok/s speed").collect()] == ["DEC-001"] and ledger.read("DECISIONS.md", "DEC-002").count() == 3
    assert {r.id for r in ledger.provenance().collect()} == {"STATE-CURRENT"}
    with pytest.raises(LookupError):
        ledger.read("NOPE.md")
    with pytest.raises(LookupError):
        ledger.read("DECISIONS.md", "DEC-404")
    said = "we are now 62.31 tok/s"
    log, refs = spark.createDataFrame([(1, 1, said)], "batch long, seq long, text string"), spark.createDataFrame([(1, "E1", 1, said)], "batch long, handle string, seq long, text string")
    planned = ledger.plan_ops(ops(spark, [(1, 0, "ADD", "DEC", "new", "now 62.31 tok/s", None, None, "E1", "now 62.31 tok/s", None)]), log, refs)
    (changed,) = ledger.apply_ops(planned).collect()
    assert changed.file == "DECISIONS.md" and changed.content.startswith("# DECISIONS\n\n## [DEC-001] Use parser\n") and changed.content.rstrip().endswith("- source: now 62.31 tok/s")
    assert ledger.status().count() == 7 and ledger.memory().state == ""


def test_coverage_boundary(spark):
    rows = [("r", "P1", f"f{i:03d}") for i in range(100)]
    facts = spark.createDataFrame(rows, "region string, grade string, fact string")
    summary = " ".join(f for _, _, f in rows[1:])
    row = C.coverage(C.covered(facts, F.lit(summary))).first()
    assert row.p0_share == 1.0 and row.p1_share == 0.99 and row.passes and row.n_missing == 1


def test_outcomes(spark):
    rows = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, False), ("b", 2, False), ("b", 3, False), ("c", 1, False)], "region string, attempt int, passes boolean")
    assert {r.region: r.outcome for r in C.outcomes(rows).collect()} == {"a": "applied", "b": "cancelled", "c": "pending"}


def test_safe_output(spark):
    row = spark.range(1).select(B.safe_output(F.lit(200016), F.lit(134481), F.lit(65536), F.lit(2048)).alias("a"), B.safe_output(F.lit(10), F.lit(50), F.lit(5), F.lit(2)).alias("b")).first()
    assert tuple(row) == (63487, 0)


def test_greedy_fill_passes_over_what_does_not_fit(spark):
    blocks = spark.createDataFrame([(1, 0, "a" * 40), (1, 1, "b" * 400), (1, 2, "c" * 40)], "message_id long, at int, block string")
    row = V.budgeted(blocks, F.lit(25)).first()
    assert row.n_blocks == 2 and row.context == "a" * 40 + "\n\n" + "c" * 40


def test_memory_classes(spark):
    said = [("give me a handoff", 0, 0, "C5"), ("compare", 0, 2, "C5"), ("the goal is speed", 0, 0, "C4"), ("where are we", 0, 0, "C2"), ("thanks!", 0, 0, "C1"), ("why x", 1, 0, "C3"), ("unrelated words here", 0, 0, "C0")]
    df = spark.createDataFrame(said, "t string, n int, i int, want string")
    assert all(r.got == r.want for r in df.select("want", V.memory_class(F.col("t"), F.col("n"), F.col("i")).alias("got")).collect())


def test_reducers(spark):
    log = "\n".join(["$ run", *["ok line"] * 40, "Error: boom", "error: BOOM", "exit code: 2"])
    rows = [(1, 1, "pwsh", "", log), (1, 2, "grep", "", "\n".join(["a:1", "A:1", "b:2"] * 20)), (1, 3, "read", "/srv/x.py", "short")]
    got = {r.pos: r for r in R.reduced(spark.createDataFrame(rows, "session long, pos long, tool string, args string, text string")).collect()}
    assert "Exit Code: 2" in got[1].reduced and "Primary Errors (1, 1 duplicated):" in got[1].reduced and got[1].shrank
    assert got[2].reduced.startswith("Matches (2, 58 duplicates dropped):\n  a:1\n  b:2\nraw: ") and got[3].reduced == "short" and not got[3].shrank


def test_prune_keeps_the_first_and_the_floor(spark):
    rows = [(1, p, "tool-pair", False, "grep", "", "same text", "NORMAL", "TRASH", p == 3, 0.9) for p in (1, 2, 3)]
    df = spark.createDataFrame(rows, "session long, pos long, kind string, open boolean, tool string, args string, text string, protection string, tier string, in_floor boolean, x double")
    assert [r.action for r in R.planned(df, F.lit("Z2")).orderBy("pos").collect()] == ["none", "drop", "none"]
    assert [r.action for r in R.planned(df, F.lit("Z0")).orderBy("pos").collect()] == ["none", "none", "none"]


def test_retries_and_policies(spark):
    rows = spark.createDataFrame([("a", 1, True, True), ("a", 2, True, True), ("b", 1, False, True), ("c", 1, True, False)], "request string, attempt int, overflow boolean, shrank boolean")
    assert {(r.request, r.attempt): r.retried for r in B.overflow_retries(rows, F.lit(1)).collect()} == {("a", 1): True, ("a", 2): False, ("b", 1): False, ("c", 1): False}
    base, own = spark.createDataFrame([("target", 10), ("margin", 2)], "name string, value long"), spark.createDataFrame([("p/m", "target", 7)], "route string, name string, value long")
    assert {(r.name, r.value) for r in B.route_policy(base, own).collect()} == {("target", 7), ("margin", 2)}
    plans = spark.createDataFrame([(s, t) for s in (1, 2) for t in range(5)], "session long, at long")
    assert {r.at for r in B.newest(plans, "at", 2, ["session"]).collect()} == {3, 4} and B.newest(plans, "at", 3).count() == 3
    spec = spark.range(1).select(B.calibrated_spec(F.lit(1000), F.lit(0.8), F.lit(0.25), F.lit(None).cast("long"), F.lit(2)).alias("s")).first().s
    assert tuple(spec) == (800, 250, 2)


def test_every_operation_is_applied_or_rejected(spark):
    import random

    rng = random.Random(4)
    said = "we are now 62.31 tok/s"
    kinds = ["ADD", "AMEND", "SUPERSEDE", "CONFLICT", "UPDATE_STATE", "NOOP", "RESOLVE_CONFLICT", "odd"]
    rows = [(1, i, rng.choice(kinds), rng.choice(["DEC", "REQ", "x"]), "t", rng.choice(["now 62.31 tok/s", "now 1.5 ms", ""]), rng.choice(["DEC-001", "DEC-002", "DEC-9"]), None, rng.choice(["E1", "E2", None]), rng.choice(["now 62.31 tok/s", "never", None]), rng.choice([None, "T1", "T2"]), "topic", "done", REPLACEMENT) for i in range(60)]
    found = L.entries(lines(spark))
    made = L.minted(judged(spark, rows, found, [(1, said)], [("E1", 1, said)]), lines(spark)).persist()
    got = made.collect()
    assert sorted(r.idx for r in got) == list(range(60))
    assert all((r.new_id is not None) == (r.reason is None and r.op in ("ADD", "SUPERSEDE", "CONFLICT")) for r in got)
    groups = {r.grp for r in got if r.reason not in (None, "GROUP_REJECTED") and r.grp}
    assert all(r.reason is not None for r in got if r.grp in groups)
    ids = [r.new_id for r in got if r.new_id]
    assert len(ids) == len(set(ids)) and not {"DEC-001", "DEC-002"} & set(ids)


def test_containment_every_way(spark):
    """Automata in slices, equi-joins, and scopes dealt to many tasks agree with plain search."""
    import random

    from ctxloom.operators import contains as C

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé0") for _ in range(rng.randrange(1, 4)))
    texts = [(i % 3, i, " ".join(word() for _ in range(rng.randrange(0, 9))) or None) for i in range(90)] + [(0, 90, ""), (2, 91, "a" * 2000)]
    strings = sorted({rng.choice(["a", "0 a", "é", "b a", " ", "ab", "aab", "bé0a"]) for _ in range(9)} | {" ".join(word() for _ in range(n)) for n in (1, 2, 3, 4) for _ in range(6)})
    rows = spark.createDataFrame(texts, "scope long, seq long, text string").repartition(3)
    want = {(i, s) for _, i, t in texts for s in strings if s in (t or "")}
    named = spark.createDataFrame([(s,) for s in [*strings, "", None]], "string string")
    flat = rows.select(F.struct("scope", "seq").alias("row_id"), "text")
    for size, slices in ((1 << 20, 8), (9, 200), (0, 1)):
        got = [(r.row_id.seq, r.string) for r in C.held(flat, named, size, slices).collect()]
        assert len(got) == len(set(got)) and set(got) == want, size
    asked = spark.createDataFrame([(k, s) for k in (0, 1, 7) for s in strings], "scope long, string string")
    low = rows.withColumn("low", F.coalesce("text", F.lit("")))
    once = {(k, s): sorted(i for j, i, t in texts if j == k and s in (t or "")) for k in (0, 1, 7) for s in strings}
    for scope_bytes, slice_bytes in ((1 << 20, 1 << 20), (50, 1 << 20), (50, 10)):
        got = {(r.scope, r.string): (r.hits, r.hit_seq, r.hit_text) for r in C.held_once(low, asked, scope_bytes, slice_bytes).collect()}
        known = {i: t for _, i, t in texts}
        assert got == {k: (len(w), w[0], known[w[0]]) for k, w in once.items() if w}
    for slice_bytes in (1 << 20, 10):
        got = [(r.scope, r.row_id, r.string) for r in C.held_in(rows.withColumnRenamed("seq", "row_id"), asked, slice_bytes).collect()]
        assert sorted(got) == sorted((k, i, s) for (k, s), w in once.items() for i in w)
