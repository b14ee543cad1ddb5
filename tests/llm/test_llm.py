"""Every operator against brute force, with nulls, ties, repeats, empty tables and odd columns."""

import collections
import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ctxloom.llm import chat, decontaminate, jaccard, licenses, packing, quality, repeats, token_files, toxicity, urls
from ctxloom.llm.shared import fresh_path
from ctxloom.llm.tokens import PieceTokenizer
from ctxloom.llm.words import shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, class string, spans string, _doc string"


def corpus():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(400)] + ["é", "ñandú", "the", "of", "A"]
    passage = " ".join(rng.choice(vocab) for _ in range(70))
    texts = []
    for _ in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randint(1, 120))]
        texts.append(re.sub(r"(\w{4}) ", r"\1. ", " ".join(words)) if rng.random() < 0.5 else "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)))
    base = texts[5] + " " + passage
    texts += [base, base, base.replace(" ", "  ", 1), base + " extra", passage + "\n" + texts[7], texts[9] + passage, " lead", "tail ", "", None, "x", "\n\n", "a\tb c", "\x01 odd", "word " * 300, "<turn |>", "é" * 150, "é" * 150]
    rows = [(i, t, "en", "s", len(t or ""), i, "c", "q", "z") for i, t in enumerate(texts)]
    return [*rows, rows[60], (None, texts[3], None, None, None, None, None, None, None), (61, "another text under one id", "en", "s", 1, 1, "c", "q", "z")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def mark(text):
    """The hash of a text as Spark has it."""
    return (xxhash.xxh64_intdigest((text or "").encode(), 42) + 2**63) % 2**64 - 2**63


def by_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, mark(r[1])))


def vocabulary(name):
    return pytest.importorskip("public_tokenizers").path(name)


@functools.cache
def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


def plain_ids(name, text):
    return library(name).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_equal_the_library(name):
    texts = [r[1] for r in corpus()] + ["don't, STOP.", "İstanbul ΣΑΣ.", "éa b", "1,234.5 x", "<|endoftext|> y", "a<|startoftext|>b and <|endoftext|>.", "<|ENDOFTEXT|> z", "a \n b", "tab\t x", "Ünïcode, wörds.", "abc$$$ don't.. a'. x's!! 12). (so) it's' v1.2.3, a-b- c'\n$$$ %% x%%\n%% end!?", "e\u0301. a\u0301$ <\u0338 x<\u0338! \u0301", "日本語。日本語, ½! ²? Ⅷ.", "a_b_ __init__. #tag# @me@", "\n".join(["$$$ x", "$$$"] * 3)]
    texts += [" ".join(rng.choice(parts) for _ in range(12)) for rng in [random.Random(5)] for parts in [["a", "B'", "'s", "it's", "3", "3.", "x$", "$", "''", "é", "é!", "-", "a-", "\u0301", "x\u0301.", "ʼ", "'LL", "'ll'"]] for _ in range(300)]
    flat, lens = PieceTokenizer(vocabulary(name)).encode(pa.array(texts, pa.string()))
    ends = np.cumsum(lens)
    assert [t for t, e, n in zip(texts, ends, lens, strict=True) if flat[e - n : e].tolist() != plain_ids(name, t)] == []


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=1500), st.integers(0, 40))
def test_token_files_round_trip(ids, cut):
    ids = np.array(ids, np.uint32) % np.uint32(max(1, 1 << cut) if cut < 32 else 2**32 - 1)
    ends = np.array(sorted({len(ids), len(ids) // 2}), np.int64)
    back = token_files.TokenFile(token_files.encode_file(np.arange(len(ends)), np.zeros(len(ends), bool), ends, ids))
    assert back.ids().tolist() == ids.tolist() and back.ids(3, 700).tolist() == ids[3:700].tolist() and back.ends.tolist() == ends.tolist()


def test_token_files(spark, docs, empty):
    name = "byte_bpe_50k.json"
    one_id = [(k % 2 or None, f"text {k % 7}") for k in range(60)]
    for frame, rows in ((docs, corpus()), (empty, []), (spark.createDataFrame(one_id, "doc_id long, text string").repartition(3), one_id)):
        path = fresh_path(spark, "t")
        got = token_files.read_token_files(token_files.write_token_files(frame, path, vocabulary(name), 2, shard_ids=500), path).orderBy("start").collect()
        start, want = 0, []
        for r in by_order(rows):
            ids = np.array([*plain_ids(name, r[1]), 2], "<u4")
            want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        assert [tuple(r) for r in got] == want


def test_quality_measures(docs, empty):
    got = collections.Counter(tuple(r[:6]) + (r.base_failed,) for r in quality.quality_report(docs).collect())
    want = collections.Counter()
    for r in corpus():
        text = r[1] or ""
        words, seen, again = WORD.findall(text), set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        held = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        want[(r[0], len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(held), len(words) < 10 or 100 * len(held) > 20 * len(words))] += 1
    assert got == want and quality.quality_report(empty).count() == 0
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_expectation_maximisation_finds_the_good_rules():
    rng, votes = random.Random(1), collections.Counter()
    for _ in range(4000):
        good = rng.random() < 0.7
        votes[tuple(0 if rng.random() < 0.2 else (1 if good == (rng.random() < a) else -1) for a in (0.95, 0.9, 0.6))] += 1
    prior, right = quality.fit(list(votes.items()))
    assert abs(prior - 0.7) < 0.1 and right[0][0] > 0.85 and right[2][0] < 0.8
    always = {(*k, 1): v for k, v in votes.items()}  # a rule that votes good on everything says nothing
    prior, right = quality.fit(list(always.items()))
    (_, moves) = quality.weights(prior, right)
    assert abs(moves[3][0]) < 0.05 and abs(prior - 0.7) < 0.1
    assert quality.posterior((1, 1, 1, 1), prior, right) > 0.9 > 0.2 > quality.posterior((-1, -1, -1, 1), prior, right)


def test_packing(spark, docs, empty):
    name = "word_bpe_49k.json"
    sequences = packing.pack(docs, vocabulary(name), 1, capacity=64, open_windows=3, least_cut=4)
    got = packing.pieces(sequences).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in got:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 64
    once = [r for r in corpus() if sum(x[0] == r[0] for x in corpus()) == 1]
    for r in once:
        ids, at = np.array([*plain_ids(name, r[1]), 1], "<u4"), 0
        for p in sorted(by_doc[r[0]], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert sum(p.length for p in got) == sum(len(plain_ids(name, r[1])) + 1 for r in corpus())
    assert sum(1 for ps in by_sequence.values() if sum(p.length for p in ps) < 60) <= 1
    assert packing.pieces(packing.pack(empty, vocabulary(name), 1)).count() == 0


def test_chat(spark):
    odd = "\\### Assistant: </turn> ok <turn x> \\l\\\\g\n"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", odd), (1, 1, "assistant", odd), (2, 5, "assistant", None), (None, 1, "a|>b", "x"), (3, None, None, ""), (4, 0, "user", odd), (4, 1, "assistant", "é" * 50)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.transcripts(frame)
    got = {r.conv_id: r for r in made.select("conv_id", chat.parsed(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0))
        assert [(t.role, t.text) for t in got[k].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert got[k].loss == "".join(r[3] or "" for r in own if r[2] == "assistant")
    assert chat.transcripts(frame.where("false")).count() == 0


def test_reply_trees(spark):
    rows = [("t", 1, None, 1.0), ("t", 2, 1, 1.0), ("t", 3, 1, 5.0), ("t", 4, 2, 1.0), ("t", 5, 4, 9.0), ("u", 1, 99, 0.0), ("v", 1, 2, 0.0), ("v", 2, 1, 0.0)]
    edges = spark.createDataFrame(rows, "tree string, node long, parent long, score double")
    found = collections.defaultdict(list)
    for r in chat.paths(edges).collect():
        found[(r.tree, r.leaf)].append((r.up, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in found.items()} == {("t", 3): [3, 1], ("t", 5): [5, 4, 2, 1], ("u", 1): [1]}
    best = chat.rank(chat.paths(edges), edges).where("tree = 't'")
    assert {r.leaf for r in best.collect()} == {5}


def brute_links(rows):
    sets = []
    for r in rows:
        words = WORD.findall((r[1] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                up[top(i)] = top(j)
    least = collections.defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)].append(r[0])
    return collections.Counter((r[0], len(s), (min(least[top(i)], default=None) if s else r[0])) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


def near_copies():
    rng, rows = random.Random(8), corpus()
    base = [f"w{rng.randint(0, 3000)}" for _ in range(150)]
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"n{rng.randint(0, 10**6)}"
        rows.append((1000 + i, " ".join(words[: rng.randint(110, 150)]), "en", "s", 1, 1, "c", "q", "z"))
    return rows


def test_jaccard_join(spark, empty):
    rows = near_copies()
    got = jaccard.linked(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_links(rows)
    assert jaccard.linked(empty).count() == 0


def test_keep_one(spark, docs):
    kept = jaccard.keep_one(docs)
    want = brute_links(corpus())
    groups = {c for (_, n, c) in want if n}
    lone = sum(k for (_, n, _), k in want.items() if not n)
    assert kept.columns == docs.columns and kept.count() == len(groups) + lone


def test_keep_one_of_repeated_rows(spark):
    long = "one two three four five six seven"
    rows = [(1, "", "a"), (1, "", "a"), (None, None, "b"), (None, None, "b"), (2, long, "y"), (2, long, "x"), (2, long, "x"), (3, long, "a"), (None, long, "n"), (4, "other words in this one here", "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _mark string")
    want = [(1, "", "a")] * 2 + [(None, None, "b")] * 2 + [(2, long, "x"), (4, "other words in this one here", "z")]
    assert collections.Counter(map(tuple, jaccard.keep_one(frame).collect())) == collections.Counter(want)
    wordless = frame.where("text is null or text = ''")
    assert jaccard.keep_one(wordless).count() == 4


def test_prefix_shares_what_it_must():
    rng = random.Random(2)
    rare = np.zeros(1 << jaccard.SKETCH_BITS, np.uint8)
    a = np.sort(np.array([rng.getrandbits(64) for _ in range(100)], np.uint64))
    b = np.sort(np.concatenate([a[14:], np.array([rng.getrandbits(64) for _ in range(10)], np.uint64)]))
    (pa_, la), (pb, lb) = jaccard.prefix(a, rare, 1.0), jaccard.prefix(b, rare, 1.0)
    assert len(np.intersect1d(pa_, pb)) >= min(la, lb)


def test_shingles_of_short_texts():
    one, two, none, blank = shingles(pa.array(["a b c", "a b d", "", None]))
    assert len(one) == len(two) == 1 and one[0] != two[0] and not len(none) and not len(blank)


def brute_repeats(rows):
    seen, out = set(), collections.Counter()
    for r in by_order(rows):
        data = (r[1] or "").encode()
        held = bytearray(len(data))
        for i in range(len(data) - 99):
            window = data[i : i + 100]
            if window in seen:
                held[i : i + 100] = b"\1" * 100
            seen.add(window)
        runs = len(re.findall(rb"\x01+", bytes(held)))
        out[(r[0], len(data), sum(held), runs, hashlib.sha256(bytes(x for x, h in zip(data, held, strict=True) if not h)).hexdigest())] += 1
    return out


def test_repeats(spark, docs, empty):
    rows = corpus()
    got = repeats.repeat_report(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert collections.Counter(map(tuple, got.collect())) == brute_repeats(rows)
    assert repeats.repeat_report(empty).count() == 0
    left = repeats.without_repeats(docs)
    assert left.columns == docs.columns and left.agg(F.sum(F.length("text"))).first()[0] < docs.agg(F.sum(F.length("text"))).first()[0]


def test_a_passage_in_every_document(spark):
    """Frequent anchors and equal surroundings, in one task and over many, with ties at the edges."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(120):
        edge = rng.choice(["same edge ", "", word() + " "])
        rows.append((rng.choice([i, i, i, None, 7]), f"{word()} {word()} {edge}{passage[rng.choice([0, 0, 40]) :]}{edge}{word()}" + (" again " + passage if i % 9 == 0 else "")))
    for parts in (1, 7):
        got = repeats.repeat_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts))
        assert collections.Counter(map(tuple, got.collect())) == brute_repeats(rows)


def test_numbered():
    nth, several = repeats._numbered(np.array([5, 3, 5, 5, 3, 9]))
    assert nth.tolist() == [0, 0, 1, 2, 1, 0] and several.tolist() == [5]
    assert [len(x) for x in repeats._numbered(np.zeros(0, np.int64))] == [0, 0]


def test_anchors_of_long_texts_come_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 105, 5000).astype(np.uint8)
    whole = {(g, a) for _, g, a, _, _ in zip(*repeats.anchors(data, np.array([0, 5000])), strict=True)}
    monkeypatch.setattr(repeats, "STEP", 700)
    pieces = repeats.anchors(data, np.array([0, 5000]))
    assert {(g, a) for _, g, a, _, _ in zip(*pieces, strict=True)} == whole
    assert sum(e - s + 1 for s, e in zip(pieces[3], pieces[4], strict=True)) == 5000 - 99


def test_leaks(spark, docs, empty):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    swapped = item.replace("five", "FIFTH").replace("ten ", "x ")
    rows = [(1, "bla " + item + " bla"), (2, swapped.upper()), (3, "one two three four five six unlike"), (4, None), (5, "short item of six words here, yes"), (6, "so TINY!"), (None, item)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "short item of six words here"), (9, None), (10, "tiny")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_matched for r in decontaminate.leaks(frame, bench).collect()}
    assert got == {(1, 7): 16, (2, 7): 14, (5, 8): 6, (None, 7): 16, (6, 10): 1}
    assert {r.doc_id for r in decontaminate.without_leaks(frame, bench).collect()} == {3, 4, 6}
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(docs, bench.where("false")).count() == 0
    assert decontaminate.without_leaks(docs, bench).columns == docs.columns


def test_each_row_is_judged_by_its_own_text(spark):
    item = " ".join(f"w{k}" for k in range(15))
    rows = [(None, item), (None, "clean"), (5, "x " + item), (5, "clean too"), (None, None)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.without_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter([rows[1], rows[3], rows[4]])


def test_leaks_in_slices(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 60)
    items = [" ".join(f"i{k}w{j}" for j in range(15)) for k in range(5)]
    frame = spark.createDataFrame([(k, "pre " + t) for k, t in enumerate(items)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, bench).collect()} == {(k, k) for k in range(5)}


def test_toxicity_on_held_out_documents(spark):
    rng, rows, labels = random.Random(4), [], []
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    for i in range(600):
        text, bad = [rng.choice(words) for _ in range(rng.randint(20, 90))], i % 4 == 0
        for _ in range(3 if bad else 0):
            text[rng.randrange(len(text))] = rng.choice(["scum", "idiot", "trash."]) if i % 8 else "zzz" + rng.choice("abcdefgh") * 2
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    frame, marks = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(frame, toxicity.learned(frame, marks)).collect()}
    held = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == t for i, t in held) >= 0.97 * len(held)
    assert got[900].predicted == got[901].predicted == 0 and all(0 <= r.score <= 1 for r in got.values())
    i, text = next((i, t) for i, t in rows if i % 8 and i % 4 == 0 and got[i].spans)
    assert any(w in text[got[i].spans[0].start : got[i].spans[0].end] for w in ("scum", "idiot", "trash"))
    none = toxicity.learned(frame, marks.where("false"))
    assert {r.score for r in toxicity.scored(frame, none).collect()} == {0.0}


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    emit, moves, n = rng.normal(size=(toxicity.CHAIN, 1)), rng.normal(size=(2, 2)), 6
    chance, _ = toxicity.marginals(emit, np.array([n]), moves)
    emit[n:] = 0
    total, hot = 0.0, np.zeros(n)
    for code in range(2**n):
        y = [code >> t & 1 for t in range(n)]
        w = np.exp(sum(emit[t, 0] * y[t] for t in range(n)) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += w
        hot += w * np.array(y)
    assert np.allclose(chance[:n, 0], hot / total)


def test_a_text_is_one_chain(monkeypatch):
    """Stretches give what the whole text gives, expected moves too."""
    rng, counts = np.random.default_rng(2), np.array([0, 3, 23, 4, 40, 1])
    values, moves = rng.normal(size=int(counts.sum())) * 2, rng.normal(size=(2, 2))

    def at(length):
        monkeypatch.setattr(toxicity, "CHAIN", length)
        emit, lengths, rank, spot = toxicity.chained(values, counts)
        chance, expected = toxicity.marginals(emit, lengths, moves, rank)
        return chance.reshape(-1)[spot], expected

    (whole, all_moves), (cut, cut_moves) = at(64), at(4)
    assert np.allclose(whole, cut) and np.allclose(all_moves, cut_moves) and np.isclose(all_moves.sum(), np.maximum(counts - 1, 0).sum())


@pytest.mark.parametrize("lead", ["", "\u00a0", " \u2003", "\x1c ", "é "])
def test_spans_name_the_words_that_count(lead):
    text = lead + "calm words idiot here\u00a0now\x85 idiot end"
    _, words, counts = toxicity.split(pa.array([text]))
    codes, _, _ = toxicity.split(pa.array([text]))
    hot = np.array([words[c] == "idiot" for c in codes], float)
    assert [text[s["start"] : s["end"]] for s in toxicity.spans(text, hot)] == ["idiot", "idiot"] and counts.sum() == len(hot)


def test_licenses(spark, docs):
    mit = licenses.TEMPLATES["MIT"]
    changed = mit.replace("copies of the Software", "copies of the Thing").replace("free of charge, ", "")
    rows = [(1, "intro\n" + changed + "\nend"), (2, "Released under the MIT License. x " * 3), (3, None), (4, "permission is hereby given"), (None, "licensed under cc by nc 4 0")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    names = collections.Counter((r.doc_id, r.license) for r in got)
    assert names[(1, "MIT")] == 1 and names[(None, "CC-BY-NC-4.0-notice")] == 1 and not any(r.doc_id in (3, 4) for r in got)
    assert (2, "MIT-notice") in names and licenses.scan(docs).count() == 0


@given(st.lists(st.integers(0, 30), max_size=40))
@settings(max_examples=60, deadline=None)
def test_patience(values):
    values = list(dict.fromkeys(values))
    got = [values[i] for i in licenses.rising(values)]
    best = [1] * len(values)
    for i in range(len(values)):
        best[i] = 1 + max((best[j] for j in range(i) if values[j] < values[i]), default=0)
    assert got == sorted(got) and len(got) == max(best, default=0)


def test_url_list_join(spark):
    at = lambda d: f"2024-01-{d:02d} 00:00:00"
    entries = spark.createDataFrame([("spam.org", "block", at(5)), ("spam.org", None, at(20)), ("ok.spam.org", "allow", at(10)), (None, "block", at(1)), ("x.org", "a", at(3)), ("x.org", "b", at(3))], "pattern string, verdict string, listed_at string").withColumn("listed_at", F.to_timestamp("listed_at"))
    asked = [(1, "http://www.spam.org/x", at(4)), (2, "http://u:p@www.SPAM.org:80/x", at(5)), (3, "https://ok.spam.org", at(12)), (4, "https://ok.spam.org?q", at(7)), (5, "http://spam.org", at(21)), (6, None, at(7)), (7, "nonsense", at(7)), (8, "http://spam.org", None), (9, "http://notspam.org", at(8)), (10, "http://x.org", at(3)), (2, "http://u:p@www.SPAM.org:80/x", at(5))]
    captures = spark.createDataFrame(asked, "page_id long, url string, at string").withColumn("fetched_at", F.to_timestamp("at"))
    got = collections.Counter((r.page_id, r.verdict) for r in urls.judged(captures, entries).collect())
    want = {1: "unlisted", 2: "block", 3: "allow", 4: "block", 5: "unlisted", 6: "unlisted", 7: "unlisted", 8: "unlisted", 9: "unlisted", 10: "b"}
    assert got == collections.Counter([*want.items(), (2, "block")])
    assert urls.judged(captures.where("false"), entries).count() == 0
    assert {r.verdict for r in urls.judged(captures, entries.where("false")).collect()} == {"unlisted"}


def test_pipeline(spark, tmp_path):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    rows = [r for r in near_copies() if r[0] is not None]
    spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(WORD.findall(rows[20][1])[:40]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        left.append(docs.count())
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert left == sorted(left, reverse=True) and left[0] > left[1] > left[2]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in got} == {r.doc_id for r in docs.collect()}
