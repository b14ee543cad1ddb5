"""Operators against plain scans where a shortcut could leave results out."""

import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ctxloom.llm import chat, decontaminate, licenses, quality, repeats, toxicity, urls
from ctxloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


def changed(rng, words, places):
    return [f"x{rng.randrange(10**9)}" if i in places else w for i, w in enumerate(words)]


@pytest.mark.parametrize("size", [5, 6, 7, 8, 9, 11, 12, 13, 16, 24, 40])
def test_decontamination_misses_no_segment(size):
    """All that a scan of every diagonal accepts, with random and periodic substitutions."""
    rng = random.Random(size)
    items = [[f"w{rng.randrange(60)}" for _ in range(size)] for _ in range(4)]
    spots = [{i} for i in range(size)] + [set(range(k, size, n)) for n in range(3, 9) for k in range(n)]
    spots += [{i for i in range(size) if rng.random() < share} for share in (0.1, 0.15, 0.2, 0.3) for _ in range(60)]
    docs = []
    for places in spots:
        item = rng.choice(items)
        docs.append([f"w{rng.randrange(60)}" for _ in range(rng.randrange(8))] + changed(rng, item, places) + [f"w{rng.randrange(60)}" for _ in range(rng.randrange(8))])
        docs[-1] = docs[-1][rng.choice([0, 0, 1, 3]) :]
    items += [["too", "short"], []]
    known = decontaminate.Benchmark([" ".join(x) for x in items])
    words, counts = decontaminate._words(pa.array([" ".join(x) for x in docs] + ["", None]))
    ends = np.cumsum(counts)
    own = [words[a:b] for a, b in zip(ends - counts, ends, strict=True)]
    want = {(d, i, *best) for d in range(len(own)) for i in range(len(items)) if (best := best_overlap(own[d].tolist(), known.items[i].tolist()))}
    assert set(known.found(words, counts)) == want and len(want) > size


def best_overlap(text, item):
    """By every diagonal and every segment on it: most words, then the earliest."""
    best = None
    for k in range(1 - len(item), len(text)):
        score = start = matched = 0
        top = (0, 0, 0)
        for j in range(max(0, -k), min(len(item), len(text) - k)):
            if score <= 0:
                score, start, matched = 0, j, 0
            same = text[k + j] == item[j]
            score, matched = score + (1 if same else -2), matched + same
            if score > top[0]:
                top = (score, matched, start, j + 1)
        if top[0]:
            _, matched, a, b = top
            if best is None or (matched, -(k + a)) > (best[0], -best[1]):
                best = (matched, k + a, k + b)
    return best if best and best[0] >= min(decontaminate.LEAST, decontaminate.SHARE * len(item)) else None


@pytest.mark.parametrize("period", [1, 2, 5])
def test_repetitive_texts(period):
    """Long texts of few words against an item of the same, soon and as every diagonal has it."""
    names = [f"p{k}" for k in range(period)]
    text, item = [names[k % period] for k in range(300)], [names[k % period] for k in range(24)]
    words, counts = decontaminate._words(pa.array([" ".join(text), " ".join(["x", *item, "y"])]))
    known = decontaminate.Benchmark([" ".join(item)])
    own = [words[:300].tolist(), words[300:].tolist()]
    assert sorted(known.found(words, counts)) == [(d, 0, *best_overlap(own[d], known.items[0].tolist())) for d in (0, 1)]
    words, counts = decontaminate._words(pa.array([" ".join(names[k % period] for k in range(200_000))]))
    began = time.monotonic()
    ((_, _, matched, start, _),) = known.found(words, counts)
    assert matched == 24 and start == 0 and time.monotonic() - began < 10


def license_rows(text, templates=None):
    return [x[1:] for x in licenses.Scanner(templates or licenses.TEMPLATES).rows(pa.array([text]))]


@pytest.mark.parametrize("name", ["MIT", "Apache-2.0-notice", "GPL-3.0-header", "CC-BY-4.0-notice"])
@pytest.mark.parametrize("between", [0, 1, 20])
@pytest.mark.parametrize("kinds", ["ne", "ee", "nen", "nnn", "enenenee", "e" * 30])
def test_each_copy_of_a_license_is_a_row(name, between, kinds):
    """Exact (e) and near (n) copies in a row."""
    rng = random.Random(between)
    template = licenses.WORD.findall(licenses.TEMPLATES[name].lower())
    text, starts = [], []
    for kind in kinds:
        text += [f"y{rng.randrange(10**9)}" for _ in range(between)]
        starts.append(len(text))
        text += changed(rng, template, {rng.randrange(1, len(template) - 1)} if kind == "n" else set())
    got = sorted(license_rows(" ".join(text), {name: licenses.TEMPLATES[name]}), key=lambda r: r[3])
    assert [r[3] for r in got] == starts
    assert [r[4] - r[3] for r in got] == [len(template)] * len(kinds)
    assert all(r[1] >= len(template) - (kind == "n") * 4 for r, kind in zip(got, kinds, strict=True))


def test_license_needs_no_run():
    """Each one-word change of a short template, and a word put in at every place, as plain alignment has them."""
    for name, text in licenses.TEMPLATES.items():
        template = licenses.WORD.findall(text.lower())
        sides = ["before"] * 9, ["after"] * 9
        texts = [[*template[:i], "other", *template[i + 1 :]] for i in range(len(template))] if len(template) < 20 else []
        texts += [[x for w in template for x in (w, "put", "in")[:n]] for n in (2, 3)]
        for words in texts:
            matched = len(licenses.align(words, template))
            got = license_rows(" ".join([*sides[0], *words, *sides[1]]), {name: text})
            assert len(got) == (matched >= licenses.LEAST * len(template)), (name, words)
            assert not got or got[0][1] == matched


def test_each_text_is_one_license():
    """Every template yields its own row and no other, notices that resemble each other too."""
    known = licenses.all_templates()
    scanner = licenses.Scanner(known)
    assert {"GPL-3.0", "Apache-2.0", "BSD-3-Clause"} <= set(known)
    for name, text in known.items():
        ((_, found, matched, size, *_),) = scanner.rows(pa.array(["before it " + text + " after it"]))
        assert (found, matched) == (name, size) or size > 500
        assert found == name


def test_overlapping_regions():
    given = [("a", 10, 10, 0, 10), ("b", 12, 15, 5, 20), ("c", 3, 3, 20, 23), ("d", 3, 4, 21, 25), ("e", 2, 2, 9, 11), ("f", 1, 1, 0, 1)]
    assert licenses.best(given) == [("f", 1, 1, 0, 1), ("b", 12, 15, 5, 20), ("c", 3, 3, 20, 23)]


def test_regions_miss_no_window():
    rng = random.Random(8)
    template = [rng.choice("abcdef") for _ in range(9)]
    scanner = licenses.Scanner({"T": " ".join(template)})
    texts = [[rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(90))] for _ in range(300)]
    words, counts = licenses._hashes(pa.array([" ".join(x) for x in texts]))
    spans = scanner.spans(words, counts)
    missing = {w: template.count(w) for w in template}
    for d, text in enumerate(texts):
        want = [b for b in range(len(text)) if text[b] in missing and sum(min(n, text[b : b + 36].count(w)) for w, n in missing.items()) >= 7.2]
        assert all(any(lo <= b and min(b + 36, len(text)) <= hi for _, lo, hi in spans.get(d, [])) for b in want)
        assert all(lo in want for _, lo, _ in spans.get(d, []))


def test_addresses_have_no_domains_above_them(spark):
    listed = spark.createDataFrame([("0.5", "block"), ("5", "block"), ("10.0.0.7", "block"), ("[::1]", "watch")], "pattern string, verdict string").withColumn("listed_at", F.lit("2024-01-05").cast("timestamp"))
    asked = [(1, "http://10.0.0.5/x"), (2, "http://10.0.0.7:80"), (3, "http://[::1]:8080/"), (4, "http://a.0.5/")]
    captures = spark.createDataFrame(asked, "page_id long, url string").withColumn("fetched_at", F.lit("2030-02-01").cast("timestamp"))
    assert {r.page_id: r.verdict for r in urls.judged(captures, listed).collect()} == {1: "unlisted", 2: "block", 3: "watch", 4: "block"}


def test_url_list_entry_of_one_label(spark):
    listed = spark.createDataFrame([("zip", "block"), ("ok.zip", "allow")], "pattern string, verdict string").withColumn("listed_at", F.lit("2024-01-05").cast("timestamp"))
    asked = [(1, "http://a.b.zip/x"), (2, "http://a.ok.zip"), (3, "http://zip.org"), (4, "http://azip"), (5, "http://zip/")]
    captures = spark.createDataFrame(asked, "page_id long, url string").withColumn("fetched_at", F.lit("2024-02-01").cast("timestamp"))
    got = {r.page_id: r.verdict for r in urls.judged(captures, listed).collect()}
    assert got == {1: "block", 2: "allow", 3: "unlisted", 4: "unlisted", 5: "block"}


@needs_tables
def test_quality_rejects_what_labels_call_bad(spark):
    """Labels measure only: at least half of the bad that passes the base rules goes, 3 % of the good at most."""
    got = quality.quality_report(spark.read.parquet(f"{SF}/documents.parquet")).where("not base_failed").select("doc_id", "kept")
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("quality", "kept").collect()
    bad, good = [r.kept for r in rows if r.quality == 0], [r.kept for r in rows if r.quality == 1]
    assert len(bad) > 20 and bad.count(False) >= 0.5 * len(bad) and good.count(False) <= 0.03 * len(good)


@needs_tables
def test_quality_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    small = SF.replace("0.01", "0.001")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    cursor = con.execute(ORACLES["op3_quality_rules"])
    names = [c[0] for c in cursor.description]
    got = QUERIES["op3_quality_rules"](spark, small).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(cursor.fetchall())


def test_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "you idiot", "a", "b", 2.0, True), (2, "Released under the MIT License.", "c", "d", 3.0, None)], "doc_id long, text string, spans string, mark string, score double, predicted boolean")
    marks = spark.createDataFrame([(k, k % 2, "x") for k in range(40)], "doc_id long, toxic int, text string")
    assert toxicity.scored(docs, toxicity.learned(docs, marks)).columns == ["doc_id", "score", "predicted", "spans"]
    assert [r.license for r in licenses.scan(docs).collect()] == ["MIT-notice"]
    turns = spark.createDataFrame([(1, 0, "user", "q", "t", 5, "l"), (1, 1, "assistant", "a", "t", 5, "l")], "conv_id long, turn long, role string, text string, tree string, node long, leaf string")
    assert chat.transcripts(turns).count() == 1
    captures = spark.createDataFrame([(1, "http://a.b/", "p", "v", "h", 3)], "page_id long, url string, pattern string, verdict string, host string, in_month int").withColumn("fetched_at", F.lit("2024-02-01").cast("timestamp"))
    entries = spark.createDataFrame([("b", "block", "x", 1)], "pattern string, verdict string, host string, page_id int").withColumn("listed_at", F.lit("2024-01-05").cast("timestamp"))
    assert [r.verdict for r in urls.judged(captures, entries).collect()] == ["block"]


def test_very_long_and_empty_texts():
    rng = random.Random(1)
    words = [f"w{rng.randrange(5000)}" for _ in range(200_000)]
    words[150_000:150_000] = licenses.TEMPLATES["MIT"].split()
    long = " ".join(words)
    texts = pa.array([long, "", None, " \n\t", "x"])
    assert [(r[0], r[1]) for r in licenses.Scanner(licenses.TEMPLATES).rows(texts)] == [(0, "MIT")]
    model = toxicity.fit(["bad idiot here", "a fine day"] * 60, [1, 0] * 60)
    score, chance, counts = toxicity.score(model, texts)
    assert len(score) == 5 and counts.tolist() == [len(words), 0, 0, 0, 1] and len(chance) == len(words) + 1
    known = decontaminate.Benchmark([" ".join(words[100_000:100_040])])
    assert [(d, m) for d, _, m, _, _ in known.found(*decontaminate._words(texts))] == [(0, 40)]
    data = np.frombuffer(long.encode(), np.uint8)
    assert sum(int(e - s) + 1 for s, e in zip(*repeats.anchors(data, np.array([0, len(data)]))[3:], strict=True)) == len(data) - repeats.LENGTH + 1
