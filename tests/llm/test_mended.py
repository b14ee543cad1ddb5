"""Links between sets of unlike sizes, and ids of letters that come apart when normalised."""

import random
import re

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from ctxloom.llm import jaccard
from ctxloom.llm.tokens import MARKS, PieceTokenizer


def edited(seed):
    """Texts of few words in edited copies, so that sets of unlike sizes are near 0.75."""
    rng = random.Random(seed)
    out = []
    for _ in range(40):
        base = [f"s{seed}w{rng.randrange(30)}" for _ in range(rng.randrange(3, 201))]
        out.append(base)
        for _ in range(rng.randrange(7)):
            copy = list(base)
            for _ in range(rng.randrange(1, 6)):
                at, kind = rng.randrange(len(copy) + 1), rng.randrange(3)
                if kind == 0 and len(copy) > 1:
                    del copy[min(at, len(copy) - 1)]
                elif kind == 1 and at < len(copy):
                    copy[at] = f"s{seed}w{rng.randrange(30)}"
                else:
                    copy.insert(at, f"s{seed}w{rng.randrange(30)}")
            out.append(copy)
    return out


def plain_sets(texts):
    return [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)]) for w in texts]


def plain_components(sets, first):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 175 * len(a & sets[j]) >= 75 * (len(a) + len(sets[j])):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [first + find(i) for i in range(len(sets))]


def test_no_link_is_lost(spark):
    rows, want = [], {}
    for seed in (3, *range(100, 120)):
        texts = edited(seed)
        for i, c in enumerate(plain_components(plain_sets(texts), len(rows))):
            want[len(rows) + i] = c
        rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) < len(want)


@pytest.mark.parametrize("seed", range(3))
def test_bounds_hold_for_every_prefix_length(spark, seed):
    """Whatever l two linked sets take, no pair is thrown out by its sizes and shared prefix shingles."""
    rng = random.Random(seed)
    rows = []
    for base in range(60):
        sets = [s for s in plain_sets(edited(1000 * seed + base)[:12]) if len(s) > 1]
        order = {g: rng.random() for g in {g for s in sets for g in s}}
        chosen = []
        for s in sets:
            a = -(-3 * len(s) // 4)
            take = rng.randint(1, min(4, a))
            ahead = sorted(s, key=order.get)[: len(s) - a + take]
            chosen.append((len(s), take, a, frozenset(ahead), int(order[ahead[-1]] * 2**62)))
        for i, (n, k, a, p, e) in enumerate(chosen):
            for j, (m, q, b, r, f) in enumerate(chosen):
                if i != j and 175 * len(sets[i] & sets[j]) >= 75 * (n + m):
                    seen = lambda own, x: sum(any(g in chosen[y][3] for y in range(len(chosen)) if y != x) for g in own)  # noqa: E731, B023
                    rows.append((n, k, m, q, len(p & r), a - k + seen(p, i), b - q + seen(r, j), e, f))
    pairs = spark.createDataFrame(rows, "n int, l int, m int, k int, common int, most int, most_b int, end long, end_b long")
    assert len(rows) > 100 and pairs.where(~jaccard._likely()).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k", "byte_bpe_50k"])
def test_every_letter_before_a_mark(name):
    path = f"/opt/tokenizers/{name}.json"
    own = PieceTokenizer(path)
    points = pa.array([chr(c) for c in (*range(0x80, 0xD800), *range(0xE000, 0x30000))])
    letters = points.filter(pc.match_substring_regex(points, r"[\pL\pN\pM]$")).to_pylist()
    apart = [c for c in letters if own.tokenizer.normalizer and re.search(r"[^\w]$|[̀-ͯऀ-࿿]$", own.tokenizer.normalizer.normalize_str(c))]
    texts = [f"a{c}{MARKS[i % len(MARKS)]} {c}" for i, c in enumerate(letters)] + [f"xy {c}{m} TAKS{c}{m}{m}" for c in apart[:300] for m in MARKS] + ["TAKSİ."]
    flat, lens = own.encode(pa.array(texts))
    at = 0
    for text, n, e in zip(texts, lens.tolist(), own.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert flat[at : at + n].tolist() == e.ids, text
        at += n
