"""Steps whose cost must grow no faster than their input: what their plans may not hold, and their results."""

import os

import pytest
from pyspark.sql import functions as F

from ctxloom.functions import text as T
from ctxloom.plans import ledger_queries, registry, session_queries, surface_queries, text_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
driver = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


def plan_of(df, capsys):
    df.sparkSession.conf.set("spark.sql.maxPlanStringLength", "100000000")
    capsys.readouterr()
    df.explain("extended")
    return capsys.readouterr().out.split("== Optimized Logical Plan ==")[1]


@driver
def test_lanes_append_to_no_array(spark, capsys):
    """first spellings by sorting; an array copied for each value made long texts quadratic."""
    got = spark.createDataFrame([(["b", "A", "a", "B", "c", "A"],), ([],), (None,)], "v array<string>").select(T.spelled_once(F.col("v")).alias("v")).collect()
    assert [r.v for r in got] == [["b", "A", "c"], [], None]
    assert "array_append" not in plan_of(registry.QUERIES["extracted_lanes"](spark, SF), capsys)


@driver
def test_landed_nodes_are_numbered_by_block(spark, capsys):
    """no window holds all pruned nodes of a session, which may be a few languages."""
    import re

    assert not re.search(r"windowspecdefinition\(session#\d+L?, pos#", plan_of(registry.QUERIES["landed_events"](spark, SF), capsys))


@driver
def test_landed_surface_appends_to_no_array(spark, capsys):
    """unique lines of both reducers, that of units and that of nodes."""
    assert "array_append" not in plan_of(registry.QUERIES["landed_surface"](spark, SF), capsys)


@driver
def test_symbols_are_judged_by_a_set(spark, capsys):
    """distinct symbols against a set of stop words, not each occurrence against a list."""
    got = spark.createDataFrame([("foo_Bar the alpha foo_Bar a$b_c ab.cd-ef x.9 Values return",)], "t string").select(T.symbols(F.col("t")).alias("s")).first().s
    assert got == ["foo_Bar", "alpha", "a$b_c"]
    assert "array_contains" not in plan_of(registry.QUERIES["extract_symbols"](spark, SF), capsys)


@driver
def test_reducers_are_linear(spark, capsys):
    """F8: no array is copied for each line of a tool result."""
    from ctxloom.operators import prune as R

    got = spark.createDataFrame([(["x", "Y", "X", "y", "z"],)], "v array<string>").select(R.unique_lines(F.col("v")).alias("u")).first().u
    assert (got.kept, got.dropped) == (["x", "Y", "z"], 2)
    assert "array_append" not in plan_of(registry.QUERIES["prune_actions"](spark, SF), capsys)


@driver
def test_drops_need_no_reducer(spark, capsys):
    """who asks for duplicates only doesn't reduce all other texts."""
    assert "Matches (" not in plan_of(registry.QUERIES["prune_drops"](spark, SF), capsys)


@driver
def test_lanes_not_asked_for_are_not_made(spark, capsys):
    """a request without symbols extracts none; before, all lanes of each text were made."""
    from ctxloom.functions import patterns as P

    assert P.SYMBOL not in plan_of(registry.QUERIES["relevance_scores"](spark, SF), capsys)


@driver
def test_ledger_lines_are_dealt_by_their_number(spark, capsys):
    """tasks grow in number with the lines, not in size."""
    from ctxloom.operators.spread import spread, tasks_for

    assert tasks_for(spark.range(100), each=5) == 20 and spread(spark.range(100), "id", tasks=20).rdd.getNumPartitions() == 20
    assert tasks_for(spark.range(3)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "Repartition" in plan_of(registry.QUERIES["ledger_index"](spark, SF), capsys)


@driver
def test_entries_are_dealt_by_their_number(spark, capsys):
    """entries share the step."""
    assert "Repartition" in plan_of(registry.QUERIES["evidence_term_counts"](spark, SF), capsys)


def test_one_call_searches_many_scopes():
    """small scopes are searched by the bucket, each by its own strings."""
    import pyarrow as pa

    from ctxloom.operators.contains import _counted

    texts = pa.table({"scope": [1, 2, 1, 3], "seq": [5, 6, 4, 7], "text": ["A b", "b", "a B", "x"], "low": ["a b", "b", "a b", "x"]})
    got = _counted((), texts, pa.table({"scope": [1, 2, 2, 4], "string": ["a", "a", "b", "x"]})).to_pylist()
    assert got == [{"scope": 1, "string": "a", "hits": 2, "hit_seq": 4, "hit_text": "a B"}, {"scope": 2, "string": "b", "hits": 1, "hit_seq": 6, "hit_text": "b"}]


@driver
def test_operations_are_normalised_once(spark, capsys):
    """what judges and numbers operations reads them normalised."""
    assert "resolve conflict" not in plan_of(ledger_queries._proved(spark, SF), capsys)


@driver
@pytest.mark.parametrize("name", ["integrity_issues", "restored_entries"])
def test_altered_ledgers_are_parsed_once(spark, capsys, name):
    """Both sides of a comparison come from one parse."""
    assert "posexplode" not in plan_of(registry.QUERIES[name](spark, SF), capsys)


@driver
@pytest.mark.parametrize("name", ["mutation_guard", "request_guard"])
def test_guards_deal_their_rows(spark, capsys, name):
    """a small file's rows to all tasks, rounds to as many tasks as they need."""
    assert "Repartition" in plan_of(registry.QUERIES[name](spark, SF), capsys)


@driver
def test_regions_are_read_once(spark, capsys):
    """facts of a region's texts are found once for all attempts."""
    assert "documents.parquet" not in plan_of(registry.QUERIES["compaction_outcomes"](spark, SF), capsys) and "n_chars" not in plan_of(registry.QUERIES["compaction_outcomes"](spark, SF), capsys)


@driver
def test_claims_are_made_once(spark, capsys):
    """the quotes that operations offer are collapsed once, for sizes, search and verdicts; no handles, no join with them."""
    plan = plan_of(ledger_queries._proved(spark, SF), capsys)
    assert "Generate explode" not in plan and "ref_text" not in plan


@driver
def test_pruned_nodes_are_reduced_once(spark, capsys):
    """what lands and how it is numbered read the same reduced nodes."""
    assert "Matches (" not in plan_of(registry.QUERIES["landed_surface"](spark, SF), capsys)


def test_bullets_by_name(spark):
    """a line's name is read once; what its pattern refuses stays a fact, the last of a name holds."""
    from ctxloom.operators import ledger as L

    texts = ["## [DEC-1] A title ", "- Status: old", " - STATUS:new\t", "- status: two words", "- confidence: .5", "- confidence: high", "- source: ", "- source:", "-no bullet", "- plain: x", "", "- resolution: a\u0085b"]
    lines = spark.createDataFrame([("D.md", i, t) for i, t in enumerate(texts)], "file string, line_no long, text string")
    got = L.entries(lines).first()
    assert (got.title, got.status, got.confidence, got.source, got.resolution) == ("A title", "NEW", 0.5, "", None)
    assert got.facts == ["status: two words", "confidence: high", "-no bullet", "plain: x", "resolution: a\u0085b"] and got.raw == "\n".join(texts)




@driver
def test_an_entrys_lines_are_gathered_once(spark, capsys):
    """one list an entry instead of a buffer for each of its fields."""
    assert "max_by" not in plan_of(registry.QUERIES["evidence_term_counts"](spark, SF), capsys)


@driver
@pytest.mark.parametrize("name", ["integrity_issues", "restored_entries"])
def test_no_raw_text_is_held(spark, capsys, name):
    """Neither side's whole text is written for a comparison of fields."""
    assert "raw#" not in plan_of(registry.QUERIES[name](spark, SF), capsys)


@driver
def test_atoms_read_a_text_once(spark, capsys):
    """a text is collapsed once for all patterns, not for each of them."""
    plan = plan_of(registry.QUERIES["mutation_guard"](spark, SF), capsys)
    assert plan.count("lower(") <= 6  # three texts, in the optimized and the physical plan
    got = spark.createDataFrame([("see http://a.b/c and /srv/x.y, 12.5 ms v1.2 `npm run` err 7",), ("nothing",), (None,)], "t string").select(T.exact_atoms(F.col("t")).alias("a")).collect()
    assert [r.a for r in got] == [["http://a.b/c", "//a.b/c", "/srv/x.y", "12.5 ms", "12.5", "v1.2", "v1", "2", "7", "err 7", "`npm run`", "npm run"], [], None]


@driver
def test_planned_units_are_dealt_by_session(spark, capsys):
    """one exchange by session for all windows of a plan, in as many tasks as its units need."""
    assert "RepartitionByExpression [session" in plan_of(registry.QUERIES["planner"](spark, SF), capsys)


@driver
def test_symbols_are_found_once_in_dealt_texts(spark, capsys):
    """a file of one row group is read by one task, and a filter on the symbols found them there a second time."""
    plan = plan_of(registry.QUERIES["extract_symbols"](spark, SF), capsys).split("== Physical Plan ==")[0]
    assert plan.count("regexp_extract_all(") == 1
    assert plan.index("regexp_extract_all(") < plan.index("RepartitionByExpression [doc_id") < plan.index("Relation [")


@driver
def test_pruned_texts_are_dealt_and_fingerprinted_once(spark, capsys):
    """F8: reducers run in dealt texts, and their pointer names the fingerprint that duplicates are found by."""
    plan = plan_of(registry.QUERIES["prune_actions"](spark, SF), capsys).split("== Physical Plan ==")[0]
    assert plan.count("sha1(") == 1
    assert plan.index("sha1(") < plan.index("RepartitionByExpression [doc_id") < plan.index("Relation [")


@driver
def test_drops_are_fingerprinted_in_dealt_texts(spark, capsys):
    """a file of one row group was fingerprinted by one task."""
    plan = plan_of(registry.QUERIES["prune_drops"](spark, SF), capsys).split("== Physical Plan ==")[0]
    assert plan.index("sha1(") < plan.index("RepartitionByExpression [doc_id") < plan.index("Relation [")


@driver
def test_operations_are_judged_once(spark, capsys):
    """groups by a window; a join with the groups that lost judged all operations twice. A batch or group that is null isn't shared."""
    from ctxloom.operators import ledger as L

    rows = [(1, 1, "g", "X"), (1, 2, "g", None), (1, 3, None, "X"), (1, 4, None, None), (2, 1, "g", None), (None, 1, "g", "X"), (None, 2, "g", None)]
    made = spark.createDataFrame(rows, "batch long, idx long, grp string, reason string")
    for tasks in (None, 3):
        got = {(r.batch, r.idx): r.reason for r in L.atomic(made, tasks).collect()}
        assert got == {(1, 1): "X", (1, 2): "GROUP_REJECTED", (1, 3): "X", (1, 4): None, (2, 1): None, (None, 1): "X", (None, 2): None}
    plan = plan_of(L.atomic(made, 3), capsys)
    assert "Join" not in plan


@driver
def test_verdicts_carry_only_what_is_read(spark):
    """titles, bodies and evidence of all operations were held for their numbers."""
    judged = ledger_queries._judged(spark, SF, only=["batch", "idx", "grp", "reason"])
    assert judged.columns == ["batch", "idx", "grp", "reason"]


@driver
def test_lost_entries_are_met_in_tasks_that_grow_in_number(spark, capsys):
    """What is left and what it names met in the session's number of partitions, however many entries there were."""
    from ctxloom.operators import ledger as L

    rows = [(f"DEC-{i}", "d", i, f"see DEC-{i - 1} and DEC-{i - 1}") for i in range(1, 9)]
    made = spark.createDataFrame(rows, "id string, file string, place long, source string").selectExpr("*", "'' AS title", "array('x') AS facts", "'' AS replacement", "'' AS resolution", "'' AS verbatim")
    after = made.where("id not in ('DEC-2', 'DEC-5', 'DEC-8')")
    assert [r.id for r in L.lost(made, after, 7).collect()] == ["DEC-8"]
    plan = plan_of(L.lost(made, after, 7), capsys).split("== Physical Plan ==")[1]
    assert plan.count(", 7), ") == plan.count("Exchange hashpartitioning") == 2


@driver
@pytest.mark.parametrize("name", ["evidence_term_counts", "ledger_index"])
def test_orders_are_dealt_before_their_lines(spark, capsys, name):
    """the scan's tasks sorted five rows an order for the exchange by file, in memory that grew with their split."""
    plan = plan_of(registry.QUERIES[name](spark, SF), capsys).split("== Physical Plan ==")
    assert plan[0].index("Generate posexplode") < plan[0].index("RepartitionByExpression [file") < plan[0].index("Relation [")
    assert plan[1].count("Exchange hashpartitioning(file") == 1


@driver
def test_dealt_lines_are_the_ledgers(spark):
    """the same lines and entries, dealt before or after they are made."""
    from ctxloom.operators import ledger as L
    from ctxloom.sources import adapters as A

    lines, (dealt, tasks) = A.ledger_lines(spark, SF), A.dealt_lines(spark, SF)
    assert dealt.rdd.getNumPartitions() == tasks and sorted(lines.collect()) == sorted(dealt.collect())
    assert sorted(L.entries(lines).collect(), key=str) == sorted(L.entries(dealt, tasks).collect(), key=str)
    assert sorted(L.index(lines).collect(), key=str) == sorted(L.index(dealt, tasks).collect(), key=str)


@driver
@pytest.mark.parametrize("name", ["integrity_issues", "restored_entries"])
def test_altered_ledgers_come_from_dealt_orders(spark, capsys, monkeypatch, name):
    """what is parsed for both sides was dealt by file line by line."""
    monkeypatch.setattr(ledger_queries, "held", lambda rows: rows)
    plan = plan_of(registry.QUERIES[name](spark, SF), capsys).split("== Physical Plan ==")[0]
    assert plan.index("Generate posexplode") < plan.index("RepartitionByExpression [file") < plan.index("Relation [")
