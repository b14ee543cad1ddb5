from ctxloom.operators import commit as K
from ctxloom.sources import ledger_files as L


def test_sidecars_are_read_tolerantly(spark):
    raw = spark.createDataFrame([('{"sessions":{"a":{"1":["DEC-1","DEC-2"],"x":["DEC-3"]}},"unresolved":{"DEC-9":{"at":"t"}}}',), ("broken",), (None,)], "json string")
    assert sorted(map(tuple, L.bindings(raw).collect())) == [("a", 1, "DEC-1"), ("a", 1, "DEC-2")]
    assert [tuple(r) for r in L.unresolved(raw).collect()] == [("DEC-9", "unbound", "t")]
    state = spark.createDataFrame([('{"sessions":{"a":{"turns":3,"lastSyncedSeq":7}},"revision":4}',), ("{",)], "json string")
    assert [tuple(r) for r in L.sync_state(state).collect()] == [("a", 3, 7, 0, 4)]


def test_first_balanced_object():
    assert L.first_object('so {not json} then {"a": "}{", "b": {"c": 1}} tail') == '{"a": "}{", "b": {"c": 1}}'
    assert L.first_object("none") is None and L.first_object(None) is None


def test_ledger_folder(spark, tmp_path):
    (tmp_path / "STATE.md").write_text("# STATE\nnow")
    got = {r.file: r.content for r in L.ledger_files(spark, str(tmp_path)).collect()}
    assert len(got) == 7 and got["STATE.md"] == "# STATE\nnow" and got["TECH.md"].startswith("# TECH\n")
    assert {r.file for r in L.seeded(spark, str(tmp_path)).collect()} == set(L.TEMPLATES) - {"STATE.md"}


def test_commit_is_idempotent_and_counts_on(spark, tmp_path):
    files = spark.createDataFrame([("STATE.md", "new")], "file string, content string")
    lines = spark.createDataFrame([(1, "- [1] applied 1")], "batch long, line string")
    folder = str(tmp_path / "ledger")
    assert K.commit(spark, folder, 1, lambda _: (files, lines)) == 1
    assert K.commit(spark, folder, 1, lambda _: (files, lines)) == 1
    assert K.commit(spark, folder, 2, lambda _: (files, lines)) == 2
    same = spark.createDataFrame([("STATE.md", "new"), ("TECH.md", "x")], "file string, content string")
    assert [r.file for r in K.changed(files, same).collect()] == ["TECH.md"]
    assert {(r.revision, r.batch, r.line) for r in K.committed(spark, folder).collect()} == {(1, 1, "- [1] applied 1"), (2, 2, None)}


def test_of_two_writers_one_is_first(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    files, lines = spark.createDataFrame([("A", "x")], "file string, content string"), spark.createDataFrame([(9, "- [9]")], "batch long, line string")

    def slow(base):
        if base == 0:
            assert K.commit(spark, folder, 8, lambda _: (files, lines)) == 1  # another writer, meanwhile
        return files, lines

    assert K.commit(spark, folder, 9, slow) == 2 and K.revision(spark, folder) == 2
    assert not K._claim(spark, folder, 2, 7, [])


def test_logs_are_read_with_what_is_nested_in_them(spark, tmp_path):
    import json

    from ctxloom.sources import sessions as S

    events = [
        {"type": "user/message", "seq": 1, "time": 1000, "data": {"role": "user", "content": [{"type": "text", "text": "hi"}, {"type": "image", "content": [{"type": "text", "text": "alt"}]}]}},
        {"type": "assistant/message", "seq": 2, "time": 2000, "data": {"message": {"role": "assistant", "content": [{"type": "reasoning", "text": "hm"}, {"type": "tool-call", "name": "read", "arguments": "{}"}]}}},
        {"type": "tool/result", "seq": 3, "time": 3000, "data": {"message": {"role": "tool", "content": [{"type": "tool-result", "content": [{"type": "text", "text": "a"}, {"type": "tool-result", "content": "b"}]}]}}},
        {"type": "user/message", "seq": 4, "time": 4000, "data": {"role": "user", "content": "<system-reminder> x"}, "sourceEventSeqs": None},
        {"type": "user/message", "seq": 5, "time": 5000, "data": {"role": "user", "content": [{"type": "text", "text": "sum"}]}, "sourceEventSeqs": [1, 2]},
        {"type": "turn/end", "seq": 6, "time": 6000, "data": {}},
    ]
    (tmp_path / "s1.jsonl").write_text("\n".join([*map(json.dumps, events), "broken"]))
    log = S.read_log(spark, str(tmp_path))
    got = {r.seq: r for r in S.messages(S.resolved(log, "s1")).collect()}
    assert {k: r.text for k, r in got.items()} == {1: "hi\nalt", 2: "hm", 3: "a\nb", 4: "<system-reminder> x", 5: "sum"}
    assert got[2].tool == "read" and got[2].n_calls == 1 and got[4].injected and got[5].checkpoint and not got[1].injected
    try:
        S.resolved(log, "s2")
    except LookupError:
        return
    raise AssertionError("another session was taken")
