"""Personal data in whole texts: fixed patterns, and spans by a character tagger.

Patterns find well-formed addresses and numbers. A bidirectional LSTM with a conditional random
field (``tagger``) adds what they miss: numbers that run into each other, such as two cards or a telephone
number and an address in a row, and other spellings (no plus sign, ``[at]``, ``[.]``, dots between
groups). It is trained on the driver from labelled spans: those that the patterns find in at most
``SAMPLE`` documents (the ones of the least hashed doc_id with a digit or an @, of at most ``LONGEST``
characters), in their own surroundings and, respelled by rule, in those of others. That
is the one bounded sample here; every text is searched whole.

Windows of 96 characters overlap by half. Each kind of span has a digit, an @ or a bracketed "at", so
windows without one hold none and aren't run. A window's tag marginals are added to those of the
windows that overlap it, weighted by nearness to the window's middle, and one best legal path over
each stretch of touching windows settles the document's spans, however long. A span of the tagger
stays if it has its kind's digits (Luhn's sum for cards, four parts to 255) and no pattern's
span overlaps it.

Nulls: a null text is empty, a null doc_id is kept and counts as -1 in the sample, of several texts under one id the least is learned from. Repeated rows have equal
results. An empty table gives no row; without any span in the sample the tagger learns from made
ones only. Other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.llm.tagger import WINDOW, Tagger, best_paths, codes
from ctxloom.llm.tokens import steps

#: The kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
SAMPLE, LONGEST, MADE, EPOCHS, BATCH, RATE = 400, 20_000, 4000, 7, 128, 0.03
STRIDE, AT_ONCE = WINDOW // 2, 512
TRIGGER = re.compile(r"[0-9@]|[\[({] ?(?:at|AT) ?[\])}]")
TAGS = 1 + 2 * len(KINDS)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Runs are taken whole (possessive, never begun inside), so time is linear in a text.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _is_ip(parts: list[str]) -> bool:
    return len(parts) == 4 and all(p.isdigit() and len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts)


def _is_card(number: str) -> bool:
    return 12 <= len(number) <= 19 and luhn(number)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses that don't overlap, found from each @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of all matches that pass their kind's test, sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _is_ip(m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if _is_card(digits(m.group()))]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return sorted(out)


def fits(kind: int, said: str) -> bool:
    """Whether a tagged string has what its kind must have."""
    number = digits(said)
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+ ?(?:@|[\[({] ?(?:at|AT) ?[\])}]) ?[A-Za-z0-9-]+(?: ?(?:\.|[\[({] ?(?:dot|DOT|\.) ?[\])}]| dot ) ?[A-Za-z0-9-]+)+", said))
    if kind == 1:
        return _is_ip(re.split(r" ?(?:\.|[\[({]\.[\])}]) ?", said))
    if kind == 2:
        return _is_card(number) and re.fullmatch(r"[0-9](?:[ .-]{0,2}[0-9])+", said) is not None
    return 9 <= len(number) <= 15 and re.fullmatch(r"[+(0-9][ ().0-9/-]+[0-9]", said) is not None and re.search(r"[ ().+/-]", said) is not None


# --- labelled windows -------------------------------------------------------------------------


def _made(rng: random.Random, kind: int, known: list[list[str]]) -> str:
    """A span of ``kind``: one of the sample's as it is or respelled, or a made one."""
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("aeiounrstlmdc") for _ in range(rng.randrange(2, 9)))
    said = rng.choice(known[kind]) if known[kind] and rng.random() < 0.6 else None
    if kind == 0:
        said = said or f"{word()}{rng.choice(['.', '_', '-', ''])}{rng.choice([word(), number(2)])}@{word()}{rng.choice(['', number(1)])}.{rng.choice(['com', 'org', 'net', 'de', 'example.com', 'co.uk'])}"
        if rng.random() < 0.35:
            at, dot = rng.choice([(" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", "."), ("(at)", "(dot)"), (" {at} ", " {dot} "), (" @ ", "."), ("@", " dot "), ("[AT]", "[DOT]"), ("@", "[.]")])
            local, _, host = said.partition("@")
            said = local + at + host.replace(".", dot)
    elif kind == 1:
        said = said or ".".join(str(rng.randrange(256)) for _ in range(4))
        if rng.random() < 0.25:
            said = rng.choice([said.replace(".", "[.]"), said.replace(".", "(.)"), "[.]".join(said.rsplit(".", 1))])
    elif kind == 2:
        said = digits(said) if said else number(rng.choice([13, 15, 16, 16, 16, 16, 19]))
        if rng.random() < 0.4:
            said = rng.choice([" ", "-", ".", "  "]).join(said[i : i + 4] for i in range(0, len(said), 4))
    else:
        if not said or rng.random() < 0.5:
            a, b, c = number(3), number(3), number(4)
            said = rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{number(2)} {number(2)} {b} {c}", f"1-{a}-{b}-{c}", f"+1-{a}-{b}-{c}", f"00{number(2)} {a} {b}{c}", f"+1 {a} {b} {c}"])
    return said


def _other(rng: random.Random) -> str:
    """A string with digits or an @ that is no personal data."""
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    drawn = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    return rng.choice(
        [
            f'token = "{drawn("0123456789abcdef", 40)}"', drawn("0123456789abcdef", rng.choice([8, 16, 32, 64])), "AKIA" + drawn("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), f"Version {number(1)}.{number(1)}.", f"v{number(1)}.{number(2)}.{number(1)}", f"{number(1)}.{number(1)}.",
            f"20{number(2)}-{number(2)}-{number(2)}", f"{number(2)}:{number(2)}:{number(2)}", f"{number(2)}/{number(2)}/20{number(2)}", f"{number(1)},{number(3)}.{number(2)}", f"${number(3)}", f"{number(2)}%", f"19{number(2)}-20{number(2)}", f"#{number(5)}", f"@{drawn('abcdefgh', 6)}",
            f"{drawn('abcdefgh', 4)}@{drawn('abcdefgh', 4)}", number(rng.randrange(1, 10)), f"id={number(8)}", f"({number(4)})", f"{number(2)} x {number(2)}", f"http://{drawn('abcdefgh', 5)}.org/{number(4)}", f"{number(3)}-{number(3)}", "(at) the end", "[at] noon",
        ]
    )


def _tagged(pieces: list[tuple[str, int | None]]) -> tuple[str, np.ndarray]:
    text, tags = "".join(p for p, _ in pieces), []
    for p, kind in pieces:
        tags += [0] * len(p) if kind is None else [1 + 2 * kind] + [2 + 2 * kind] * (len(p) - 1)
    return text, np.array(tags, np.int64)


def examples(texts: list[str], made: int = MADE, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes and tags of labelled windows, by (window, place)."""
    rng, known, quiet = random.Random(seed), [[] for _ in KINDS], []
    letters, tags = [], []

    def add(text: str, gold: np.ndarray, a: int) -> None:
        piece = codes(text[a : a + WINDOW]) if a < len(text) else np.zeros(0, np.uint8)
        letters.append(np.pad(piece, (0, WINDOW - len(piece))))
        tags.append(np.pad(gold[a : a + WINDOW], (0, WINDOW - len(piece))))

    for text in texts:
        spans = [s for s in patterns(text) if s[2] - s[0] < WINDOW]
        last = 0
        for start, kind, end in spans:
            if start < last:  # one span in another is told neither way
                continue
            last = end
            known[kind].append(text[start:end])
            around = text[max(0, start - 40) : start] + "\n" + text[end : end + 40]
            if not TRIGGER.search(around):
                gold, a = np.zeros(len(text), np.int64), max(0, start - rng.randrange(40))
                gold[start : end] = 2 + 2 * kind
                gold[start] -= 1
                if not TRIGGER.search(text[end : a + WINDOW]):
                    add(text, gold, a)
        calm = [m.span() for m in re.finditer(r"[^0-9@\[({+]{24,}", text)]
        quiet += [text[a : min(b, a + 160)] for a, b in calm[:4]]
    letters, tags = letters[: made // 2], tags[: made // 2]
    quiet = [q for q in quiet if not TRIGGER.search(q)] or ["some words of no meaning stand here, and others. " * 3]

    def calm_text(n: int) -> str:
        said = rng.choice(quiet)
        a = rng.randrange(max(1, len(said) - n))
        return said[a : a + n]

    for _ in range(made):
        pieces: list[tuple[str, int | None]] = [(calm_text(rng.randrange(1, 60)), None), (rng.choice([" ", " ", " ", "\n", "(", '"', ": "]), None)]
        for _ in range(rng.choice([1, 1, 1, 2, 2, 3])):
            kind = rng.choice([0, 1, 2, 3, None])
            pieces.append((_other(rng), None) if kind is None else (_made(rng, kind, known), kind))
            pieces.append((rng.choice([" ", " ", " ", ", ", "\n", ". ", "!! ", "### ", "; ", f" {calm_text(rng.randrange(1, 20))} "]), None))
        pieces.append((calm_text(90), None))
        text, gold = _tagged(pieces)
        add(text, gold, rng.choice([0, 0, rng.randrange(40)]))
    return np.stack(letters), np.stack(tags)


def trained(texts: list[str], made: int = MADE, epochs: int = EPOCHS) -> Tagger:
    tagger = Tagger.fresh(TAGS, seed=5)
    tagger.fit(*examples(texts, made), epochs=epochs, batch=BATCH, rate=RATE)
    return tagger


def learned(docs: DataFrame) -> Tagger:
    """Trained on the sample of ``docs``."""
    held = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]") & (F.length("text") <= LONGEST))
    picked = held.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = held.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).collect()  # SAMPLE rows at most
    rows.sort(key=lambda r: r["doc_id"])
    return trained([r["text"] for r in rows])


# --- search -----------------------------------------------------------------------------------

_LEGAL = np.zeros((TAGS, TAGS))
_START = np.zeros(TAGS)
for _k in range(len(KINDS)):
    _LEGAL[:, 2 + 2 * _k] = -1e9
    _LEGAL[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = 0
    _START[2 + 2 * _k] = -1e9
_NEAR = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(np.float32)[:, None]


def windows(text: str) -> np.ndarray:
    """Numbers of the windows of ``text`` that hold a trigger; the one of number k begins at k * STRIDE."""
    spots = np.array([m.start() for m in TRIGGER.finditer(text)], np.int64) // STRIDE
    return np.unique(np.concatenate([np.maximum(spots - 1, 0), spots]))


def _settle(tagger: Tagger, letters: dict[int, np.ndarray], owner: np.ndarray, number: np.ndarray, found: list[list[tuple[int, int, int]]]) -> None:
    """Decode the windows of whole stretches and put the spans of each best path into ``found``."""
    head = np.concatenate([[True], (owner[1:] != owner[:-1]) | (number[1:] > number[:-1] + 1)])
    heads = np.flatnonzero(head)
    counts = np.diff(np.append(heads, len(owner)))
    sizes = (counts - 1) * STRIDE + WINDOW
    bases = np.cumsum(sizes) - sizes
    at = np.repeat(bases, counts) + (number - np.repeat(number[heads], counts)) * STRIDE
    score, weight = np.zeros((int(sizes.sum()), TAGS), np.float32), np.zeros((int(sizes.sum()), 1), np.float32)
    for a in range(0, len(owner), AT_ONCE):
        some = range(a, min(a + AT_ONCE, len(owner)))
        cut = np.zeros((len(some), WINDOW), np.uint8)
        for row, i in enumerate(some):
            piece = letters[owner[i]][number[i] * STRIDE : number[i] * STRIDE + WINDOW]
            cut[row, : len(piece)] = piece
        chance = tagger.chances(tagger.emissions(np.ascontiguousarray(cut.T)))[0].transpose(1, 0, 2) * _NEAR
        for odd in (0, 1):  # every second window of a text overlaps no other
            rows = np.flatnonzero(number[a : a + AT_ONCE] % 2 == odd)
            spots = (at[a : a + AT_ONCE][rows, None] + np.arange(WINDOW)).ravel()
            score[spots] += chance[rows].reshape(-1, TAGS)
            weight[spots] += np.tile(_NEAR, (len(rows), 1))
    score = np.log(score / weight + np.float32(1e-6))
    paths = best_paths([score[b : b + n] for b, n in zip(bases, sizes, strict=True)], _LEGAL, _START)
    for h, path in zip(heads, paths, strict=True):
        own, shift = found[owner[h]], int(number[h]) * STRIDE
        for start in np.flatnonzero(path % 2 == 1).tolist():
            end = start + 1
            while end < len(path) and path[end] == path[start] + 1:
                end += 1
            own.append((start + shift, int(path[start]) // 2, end + shift))


def tagged(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """By text, the tagger's (start, rank of kind, end), settled over all its windows."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    places = [windows(t) for t in texts]
    owner, number = np.repeat(np.arange(len(texts)), [len(p) for p in places]), np.concatenate([*places, np.zeros(0, np.int64)])
    a = 0
    while a < len(owner):
        b = min(len(owner), a + AT_ONCE)
        while b < len(owner) and owner[b] == owner[b - 1] and number[b] == number[b - 1] + 1:  # no stretch is cut
            b += 1
        _settle(tagger, {int(i): codes(texts[i]) for i in np.unique(owner[a:b])}, owner[a:b], number[a:b], found)
        a = b
    return found


def found(tagger: Tagger, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """By text, the patterns' spans, and all spans; both sorted by start and kind."""
    out = []
    for text, guessed in zip(texts, tagged(tagger, texts), strict=True):
        base = patterns(text)
        taken, more = [(a, b) for a, _, b in base], []
        for start, kind, end in guessed:
            said = text[start:end]
            left = said.lstrip(" \n.,;:!?'\"" + (")" if kind == 3 else "()[]{}"))
            said, start = left.rstrip(" \n.,;:!?'\"([{}])"), start + len(said) - len(left)
            end = start + len(said)
            if said and fits(kind, said) and all(end <= a or b <= start for a, b in taken):
                more.append((start, kind, end))
                taken.append((start, end))
        out.append((base, sorted(base + more)))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SPANS = "array<struct<kind:string,start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """A row per document: doc_id, base (the patterns' spans), spans (all), in code points, end exclusive."""
    held = docs.sparkSession.sparkContext.broadcast(tagger.weights)  # some tens of thousands of numbers, whatever the corpus

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tagger(held.value)
        for batch in batches:
            for some in steps(batch):
                texts = pc.fill_null(some["text"], "")
                base: list = [[]] * len(texts)
                spans: list = [[]] * len(texts)
                at = np.flatnonzero(pc.match_substring_regex(texts, TRIGGER.pattern).to_numpy(zero_copy_only=False))
                for i, (b, s) in zip(at.tolist(), found(own, texts.take(pa.array(at)).to_pylist()), strict=True):
                    base[i], spans[i] = ([{"kind": KINDS[k], "start": x, "end": y} for x, k, y in v] for v in (b, s))
                yield pa.RecordBatch.from_arrays([some["doc_id"], pa.array(base, _SPANS), pa.array(spans, _SPANS)], ["doc_id", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(search, f"doc_id long, base {SPANS}, spans {SPANS}")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = scan(docs, learned(docs))
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"))
