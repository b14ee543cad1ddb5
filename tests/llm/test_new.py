"""Operators 11 to 13 against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxloom.llm import merkle, middle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, form string, leaf string, path string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_manifest(rows):
    """Rows (doc_id, text, lang, source, n_chars) to their manifest, node by node."""
    name = lambda r: (r[2] is not None, (r[2] or "").encode())
    leaf = lambda r, text: h(*(field(x) for x in (r[0], r[3], r[2], r[4], text)))
    groups = {}
    for r in rows:
        groups.setdefault(name(r), []).append((leaf(r, r[1]), r))

    def climb(nodes):
        """The last node, and by leaf its path of (left, right) siblings."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
            for path, i in zip(paths, at, strict=True):
                run = runs[i // 8]
                path.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
            nodes, at = [h(*run) for run in runs], [i // 8 for i in at]
        return nodes[0], paths

    def kept(item):
        return (item[1][0] is not None, item[1][0] or 0, item[0])

    subs = []
    for key in sorted(groups):
        nodes = sorted(groups[key], key=kept)
        subs.append((*climb([x for x, _ in nodes]), nodes))
    root, tops = climb([s for s, _, _ in subs])
    out = []
    for (sub, paths, nodes), top in zip(subs, tops, strict=True):
        for path, (own, r) in zip(paths, nodes, strict=True):
            cur = leaf(r, re.sub("[A-Z]", lambda m: m.group().lower(), r[1])) if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else own
            for left, right in path + top:
                cur = h(left, cur, right)
            out.append((r[0], own, sub, root, h(*(x for step in path + top for x in step)), cur, cur == root))
    return out


def manifest_rows(rng, n, langs):
    rows = [(rng.choice([None, *range(n)]), rng.choice([None, "", "Aé b", "plain", "X" * rng.randrange(9)]), rng.choice(langs), rng.choice([None, "s"]), rng.choice([None, 3])) for _ in range(n)]
    return rows + rows[: n // 5]


def manifest_of(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "f", "l", "p") for r in rows], SCHEMA).repartition(3)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return merkle.manifest(docs, tampered, paths=True)


def ordered(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize(("n", "langs"), [(1, ["en"]), (7, [None]), (40, [None, "en", "de", ""]), (300, [f"l{k}" for k in range(90)]), (9000, ["en"] * 9 + ["z", None])])
def test_manifest(spark, n, langs):
    rows = manifest_rows(random.Random(n), n, langs)
    got = manifest_of(spark, rows).collect()
    assert ordered((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got) == ordered(plain_manifest(rows))
    for r in got:  # the path leads from the leaf to the root
        cur = r.leaf
        for step in r.path:
            cur = h(step.left, cur, step.right)
        assert cur == r.root


def test_manifest_of_nothing(spark):
    assert manifest_of(spark, []).count() == 0


def test_chunks():
    rng = random.Random(1)
    for _ in range(200):
        texts = ["".join(rng.choice("ab\n") for _ in range(rng.randrange(40))) for _ in range(rng.randrange(1, 9))]
        data, bounds = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        for size in (1, 2, 3, 7, 64):
            chunks = middle.Chunks(data, bounds, size)
            for i, text in enumerate(texts):
                lines = re.findall(r"[^\n]*\n|[^\n]+", text)
                assert chunks.n[i] == len(lines)
                assert [chunks.place(i, k) for k in range(len(lines) + 1)] == [len("".join(lines[:k])) for k in range(len(lines) + 1)]


def plain_middle(doc_id, text, rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, len(lines), "plain", None, None, text
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < spm:
        return doc_id, len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate", [100, 60, 0])
def test_fill_in_middle(spark, rate):
    rng = random.Random(rate)
    texts = ["", None, "\n", "\n\n", "x", "é\nñ\n", "a<P>b", "<S>", "a\nb<M>\n", "<P\n>S<\n<<", "\r\n\x85x y\n", ("line é %d\n" * 40_000) % tuple(range(40_000))]
    texts += ["".join(rng.choice("aé\n<>PSM") for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(i, t, "en", "s", 1, 7, "f", "l", "p") for i, t in enumerate(texts)]
    rows += [rows[5], (None, "a\nb\nc", None, None, None, None, None, None, None)]
    made = middle.transformed(spark.createDataFrame(rows, SCHEMA).repartition(3), rate=rate)
    got = made.withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    assert ordered(tuple(r)[:-1] for r in got) == ordered(plain_middle(r[0], r[1], rate) for r in rows)
    assert ordered((r.doc_id, r.back) for r in got) == ordered((r[0], r[1] or "") for r in rows)


def test_fill_in_middle_of_nothing(spark):
    assert middle.transformed(spark.createDataFrame([], SCHEMA)).count() == 0
