"""A commit is seen whole or not at all, whatever fails and whoever else writes."""

import os
import threading

import pytest

from ctxloom.operators import commit as K


class Crash(Exception):
    pass


def made(spark, batch, text):
    return spark.createDataFrame([("A.md", text), (f"{batch}.md", text)], "file string, content string"), spark.createDataFrame([(batch, f"- [{batch}] applied 1"), (batch + 1, "another's")], "batch long, line string")


def state(spark, folder):
    now = K.current(spark, folder)
    return K.revision(spark, folder), sorted((r.revision, r.batch, r.line) for r in K.committed(spark, folder).collect()), sorted(map(tuple, now.collect())) if now else []


def crash(*_, **__):
    raise Crash


@pytest.mark.parametrize("step", ["plan", "lines", "_claim", "_staged", "_named", "after"])
def test_a_crash_leaves_the_state_before_or_after(spark, tmp_path, monkeypatch, step):
    folder = str(tmp_path)
    assert K.commit(spark, folder, 1, lambda _: made(spark, 1, "one")) == 1
    before = state(spark, folder)
    plan = lambda _: made(spark, 2, "two")
    if step == "plan":
        plan = crash
    elif step == "lines":  # the files are written, the lines never come
        plan = lambda _: (made(spark, 2, "two")[0], made(spark, 2, "two")[1].drop("line"))
    elif step == "after":  # the record has its name, its writer dies before it tells
        named = K._named
        monkeypatch.setattr(K, "_named", lambda *a: (named(*a), crash())[0])
    else:
        monkeypatch.setattr(K, step, crash)
    with pytest.raises(Exception):  # noqa: B017
        K.commit(spark, folder, 2, plan)
    monkeypatch.undo()
    seen = state(spark, folder)
    assert (seen == before) == (step != "after")
    assert K.commit(spark, folder, 2, lambda _: made(spark, 2, "two")) == 2  # the batch is retried
    assert K.commit(spark, folder, 2, crash) == 2
    after = state(spark, folder)
    assert after == (2, [(1, 1, "- [1] applied 1"), (2, 2, "- [2] applied 1")], [("1.md", "one"), ("2.md", "two"), ("A.md", "two")])
    K.vacuum(spark, folder, -1)
    assert state(spark, folder) == after and len(os.listdir(f"{folder}/files")) == 2
    assert not [x for x in os.listdir(f"{folder}/commits") if x.startswith(".staged")]


def test_of_two_writers_one_is_first(spark, tmp_path, monkeypatch):
    """Both stage the same revision before either is named; none is lost and none is applied twice."""
    folder, gate, named = str(tmp_path), threading.Barrier(2), K._named
    calls, results = [], {}

    def together(*args):
        calls.append(args)
        if len(calls) <= 2:
            gate.wait(60)
        return named(*args)

    monkeypatch.setattr(K, "_named", together)

    def write(batch):
        results[batch] = K.commit(spark, folder, batch, lambda _: made(spark, batch, f"text {batch}"))

    writers = [threading.Thread(target=write, args=(b,)) for b in (5, 6)]
    for w in writers:
        w.start()
    for w in writers:
        w.join(120)
    assert sorted(results.values()) == [1, 2]
    last = max(results, key=results.get)
    assert state(spark, folder) == (2, sorted((r, b, f"- [{b}] applied 1") for b, r in results.items()), sorted([("A.md", f"text {last}"), ("5.md", "text 5"), ("6.md", "text 6")]))


def test_one_batch_by_two_writers(spark, tmp_path):
    """The slower of two writers of one batch finds it done and changes nothing."""
    folder, plans = str(tmp_path), []

    def slow(base):
        plans.append(base)
        if base == 0:
            assert K.commit(spark, folder, 7, lambda _: made(spark, 7, "fast")) == 1
        return made(spark, 7, "slow")

    assert K.commit(spark, folder, 7, slow) == 1 and plans == [0]
    assert state(spark, folder) == (1, [(1, 7, "- [7] applied 1")], [("7.md", "fast"), ("A.md", "fast")])


def test_a_torn_record_uses_up_its_number(spark, tmp_path):
    folder = str(tmp_path)
    K.commit(spark, folder, 1, lambda _: made(spark, 1, "one"))
    for number, text in ((2, ""), (3, '{"batch": 2, "fi')):
        (tmp_path / "commits" / f"r{number:08d}").write_text(text)
    assert K.commit(spark, folder, 2, lambda _: made(spark, 2, "two")) == 4
    assert state(spark, folder)[1] == [(1, 1, "- [1] applied 1"), (4, 2, "- [2] applied 1")]


def test_a_file_system_with_renames(spark, tmp_path):
    """By another scheme than the local one, records are renamed without overwriting."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("fs.viewfs.mounttable.ledger.link./l", f"file://{tmp_path}")
    folder = "viewfs://ledger/l/led"
    assert K.commit(spark, folder, 1, lambda _: made(spark, 1, "one")) == 1
    assert not K._claim(spark, folder, 1, 9, [])
    assert K.commit(spark, folder, 2, lambda _: made(spark, 2, "two")) == 2
    assert state(spark, folder)[0] == 2 and state(spark, folder)[2][-1] == ("A.md", "two")
