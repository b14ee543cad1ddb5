"""Toxic spans by a linear-chain conditional random field.

A word's features are itself and its first three to six and last three letters, hashed to
``2 ** WEIGHT_BITS`` weights; a text is one chain, computed in stretches of ``CHAIN`` words
with the messages carried over their borders. Word labels for fitting come from document
labels: of the features that almost only toxic documents have (by ``PURITY`` and a
log-likelihood gain), those that together explain each of them ``COVER`` times are taken
greedily, and a toxic document's words with one of these are labelled. The model is fitted on
the driver on at most ``SAMPLE`` documents of a label, those with the least hashed doc_id,
less those over ``LONGEST`` characters: the one bounded sample here. Every text is scored
whole. Forward-backward marginals give the offending spans, and a document's score is a
logistic function of the largest marginal and of the sum of those over a half.

doc_id decides only which rows may be learned from. Nulls: a null text is empty, a null label
is none, a null doc_id is never learned from nor held out. Repeated rows are scored alike; of
several texts under one labelled id the least is learned from.
Without labels of both kinds every score is the share of toxic labels, or 0. An empty table
gives no row. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.llm.tokens import steps

WEIGHT_BITS, CHAIN, SAMPLE, FOLDS = 18, 64, {1: 1200, 0: 2400}, 5
LEAST_GAIN, PURITY, COVER, ROUNDS, DECAY = 10.0, 0.97, 3, 40, 1e-4
EDGES = ".,;:!?\"'()[]\u00a0"
LONGEST = 20_000


def features(word: str) -> list[int]:
    """Places of a word's weights; longer words have more."""
    ends = [f"={word}", *(f"{n}{word[:n]}" for n in (3, 4, 5, 6) if len(word) >= n), f"-{word[-3:]}"]
    return [zlib.crc32(x.encode()) & ((1 << WEIGHT_BITS) - 1) for x in ends]


def split(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Word codes, the words they stand for, and the number of words by text."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    counts = lists.value_lengths().to_numpy().astype(np.int64)
    words = lists.flatten()
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    if not full.all():
        owner = np.repeat(np.arange(len(counts)), counts)[full]
        words, counts = words.filter(pa.array(full)), np.bincount(owner, minlength=len(counts))
    coded = words.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), pc.utf8_trim(coded.dictionary, characters=EDGES).to_pylist(), counts


@dataclass
class Model:
    """Weights of label 1 over label 0, log transition scores, and the document logistic."""

    weights: np.ndarray
    moves: np.ndarray
    logistic: np.ndarray
    base: float | None = None


def chained(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values as (CHAIN, stretches), their lengths and numbers in their texts, each value's place."""
    pieces = -(-counts // CHAIN)
    rank = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(np.cumsum(pieces) - pieces, counts)
    within = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
    chain, step = start + within // CHAIN, within % CHAIN
    n = int(pieces.sum())
    out = np.zeros((CHAIN, n))
    out[step, chain] = values
    return out, np.bincount(chain, minlength=n), rank, step * n + chain


def borders(odds: np.ndarray, lengths: np.ndarray, rank: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Messages that come into each stretch from the one before it and from the one behind it."""
    n = len(rank)
    came, comes = np.ones((2, n)), np.ones((2, n))
    if not rank.any():
        return came, comes
    through = np.where(rank > 0, move[:, :, None], np.eye(2)[:, :, None])  # by label before and last label
    through[:, 1] *= odds[0]
    for t in range(1, len(odds)):
        live = np.flatnonzero(lengths > t)
        held = through[:, :, live]
        one = held[:, 0, None] * move[0, :, None] + held[:, 1, None] * move[1, :, None]
        one[:, 1] *= odds[t, live]
        through[:, :, live] = one / one.sum(axis=(0, 1))
    order = np.argsort(rank, kind="stable")
    by_rank = np.split(order, np.cumsum(np.bincount(rank))[:-1])
    for here in by_rank[1:]:
        x = came[0, here - 1] * through[0][:, here - 1] + came[1, here - 1] * through[1][:, here - 1]
        came[:, here] = x / x.sum(axis=0)
    for here in by_rank[:0:-1]:
        x = through[:, 0, here] * comes[0, here] + through[:, 1, here] * comes[1, here]
        comes[:, here - 1] = x / x.sum(axis=0)
    return came, comes


def marginals(emit: np.ndarray, lengths: np.ndarray, moves: np.ndarray, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Chance of label 1 at every step, and expected counts of the four moves.

    A stretch of rank k > 0 goes on where the stretch before it ends.
    """
    steps_, n = emit.shape
    rank = np.zeros(n, np.int64) if rank is None else rank
    odds, move = np.exp(np.clip(emit, -30, 30)), np.exp(moves)
    came, comes = borders(odds, lengths, rank, move)
    ahead, back = np.empty((steps_, 2, n)), np.repeat(comes[None], steps_, axis=0)
    ahead[0] = np.where(rank > 0, move.T @ came, 1.0)
    ahead[0, 1] *= odds[0]
    ahead[0] /= ahead[0].sum(axis=0)
    for t in range(1, steps_):
        a = move.T @ ahead[t - 1]
        a[1] *= odds[t]
        ahead[t] = a / a.sum(axis=0)
    for t in range(steps_ - 2, -1, -1):
        b = back[t + 1].copy()
        b[1] *= odds[t + 1]
        b = move @ b
        back[t] = np.where(lengths > t + 1, b / b.sum(axis=0), comes)
    both = ahead * back
    chance = both[:, 1] / both.sum(axis=1)
    expected = np.zeros((2, 2))
    for t in range(1, steps_):
        b = back[t].copy()
        b[1] *= odds[t]
        joint = ahead[t - 1][:, None, :] * move[:, :, None] * b[None]
        expected += (joint / joint.sum(axis=(0, 1)))[:, :, lengths > t].sum(axis=2)
    if rank.any():
        b = back[0].copy()
        b[1] *= odds[0]
        joint = came[:, None, :] * move[:, :, None] * b[None]
        expected += (joint / joint.sum(axis=(0, 1)))[:, :, rank > 0].sum(axis=2)
    return chance, expected


def _table(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Flat feature places of words, and how many each has."""
    rows = [features(w) for w in words]
    lens = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter((x for r in rows for x in r), np.int64, int(lens.sum())), lens


def _by_word(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    ends = np.cumsum(lens)
    return total[ends] - total[ends - lens]


def _summary(chance: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """By text: logit of the largest marginal, and log of the sum of those over a half."""
    out = np.zeros((len(counts), 2))
    out[:, 0] = -12
    full = counts > 0
    starts = (np.cumsum(counts) - counts)[full]
    if len(starts):
        most = np.clip(np.maximum.reduceat(chance, starts), 6e-6, 1 - 6e-6)
        out[full, 0] = np.log(most / (1 - most))
        out[full, 1] = np.log1p(np.add.reduceat(np.where(chance >= 0.5, chance, 0), starts))
    return out


def fit(texts: list[str], toxic: list[int]) -> Model:
    """A model of labelled texts."""
    size = 1 << WEIGHT_BITS
    toxic = np.array(toxic, np.int64)
    if not len(toxic) or toxic.min() == toxic.max():
        return Model(np.zeros(size), np.zeros((2, 2)), np.zeros(3), float(toxic.mean()) if len(toxic) else 0.0)
    codes, words, counts = split(pa.array(texts, pa.string()))
    places, lens = _table(words)
    owner = np.repeat(np.arange(len(words)), lens)
    doc = np.repeat(np.arange(len(counts)), counts)
    pairs = np.unique(np.stack([doc, codes]), axis=1)
    first = np.cumsum(lens) - lens
    held, bad = {}, None
    for label in (1, 0):  # distinct (document, feature) of a label; clean ones only as far as toxic ones have them
        d, w = pairs[:, toxic[pairs[0]] == label]
        at = places[np.repeat(first[w] - (np.cumsum(lens[w]) - lens[w]), lens[w]) + np.arange(int(lens[w].sum()))]
        of = np.repeat(d, lens[w])
        if bad is not None:
            also = bad[at] > 0
            at, of = at[also], of[also]
        held[label] = np.unique(of * size + at)
        bad = np.bincount(held[1] % size, minlength=size)
    clean = np.bincount(held[0] % size, minlength=size)
    expected = (bad + clean) * (toxic == 1).mean()
    gain = bad * np.log(np.maximum(bad, 1) / np.maximum(expected, 1e-9)) + clean * np.log(np.maximum(clean, 1) / np.maximum(bad + clean - expected, 1e-9))
    pure = (gain >= LEAST_GAIN) & (bad / (toxic == 1).sum() >= PURITY * (bad / (toxic == 1).sum() + clean / (toxic == 0).sum()))
    at, of = held[1] % size, held[1] // size
    at, of = at[pure[at]], of[pure[at]]
    need = np.where(toxic == 1, COVER, 0)
    lead = np.zeros(size, bool)
    while len(at):  # the feature that explains most toxic documents not yet explained COVER times
        gain = np.bincount(at, weights=need[of] > 0, minlength=size)
        best = int(np.argmax(gain))
        if gain[best] < max(3, 0.005 * (toxic == 1).sum()):
            break
        lead[best] = True
        need[of[at == best]] -= 1
        at, of = at[at != best], of[at != best]
    gold = (np.bincount(owner, weights=lead[places], minlength=len(words)) > 0)[codes] & (toxic[doc] == 1)

    weights, moves = np.zeros(size), np.zeros((2, 2))
    speed, move_speed = np.full(size, 1e-6), np.full((2, 2), 1e-6)
    _, lengths, rank, spot = chained(gold.astype(float), counts)
    within = doc[1:] == doc[:-1]
    seen_moves = np.bincount(2 * gold[:-1][within] + gold[1:][within], minlength=4).reshape(2, 2).astype(float)
    gold_words = np.bincount(codes, weights=gold, minlength=len(words))
    for _ in range(ROUNDS):
        emit = chained(_by_word(weights[places], lens)[codes], counts)[0]
        chance, expected = marginals(emit, lengths, moves, rank)
        gap = gold_words - np.bincount(codes, weights=chance.reshape(-1)[spot], minlength=len(words))
        slope = np.bincount(places, weights=gap[owner], minlength=size) - DECAY * len(codes) * weights * 1e-2
        speed += slope**2
        weights += 0.5 * slope / np.sqrt(speed)
        slope = seen_moves - expected
        move_speed += slope**2
        moves += 0.2 * slope / np.sqrt(move_speed)
    chance = marginals(chained(_by_word(weights[places], lens)[codes], counts)[0], lengths, moves, rank)[0].reshape(-1)[spot]
    known = np.column_stack([np.ones(len(counts)), _summary(chance, counts)])
    logistic = np.zeros(3)
    for _ in range(30):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(known @ logistic, -30, 30)))
        bend = known.T @ (known * (p * (1 - p))[:, None]) + 0.05 * np.eye(3)
        logistic += np.linalg.solve(bend, known.T @ (toxic - p) - 0.05 * logistic)
    return Model(weights, moves, logistic)


def score(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score by text, marginals of all words, and the number of words by text."""
    codes, words, counts = split(texts)
    if model.base is not None or not len(codes):
        flat = np.full(len(counts), model.base if model.base is not None else 1 / (1 + np.exp(-np.clip(model.logistic @ [1, -12, 0], -30, 30))))
        return flat, np.zeros(len(codes)), counts
    places, lens = _table(words)
    emit, lengths, rank, spot = chained(_by_word(model.weights[places], lens)[codes], counts)
    chance = marginals(emit, lengths, model.moves, rank)[0].reshape(-1)[spot]
    rows = np.column_stack([np.ones(len(counts)), _summary(chance, counts)])
    return 1 / (1 + np.exp(-np.clip(rows @ model.logistic, -30, 30))), chance, counts


def spans(text: str, chance: np.ndarray) -> list[dict]:
    """Character spans of runs of words with a marginal of a half or more."""
    out: list[dict] = []
    for (a, b), p in zip((m.span() for m in re.finditer(r"[^ \t-\r]+", text)), chance.tolist(), strict=True):
        if p < 0.5:
            run = False
            continue
        if out and run:
            out[-1]["end"] = b
        else:
            out.append({"start": a, "end": b})
        run = True
    return out


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """Fitted on the sample of labelled rows outside fold 0."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 0)).distinct()
    picked = [usable.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE[k]) for k in (0, 1)]
    short = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= LONGEST)
    rows = short.join(F.broadcast(picked[0].union(picked[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows = sorted((r["doc_id"], r["text"], r["toxic"]) for r in rows)
    return fit([r[1] for r in rows], [r[2] for r in rows])


SCORED = "doc_id long, score double, predicted int, spans array<struct<start:long,end:long>>"


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """A row per document: doc_id, score, predicted, and the offending character spans."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.moves, model.logistic, model.base))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for batch in batches:
            for some in steps(batch, limit=2 << 20):
                values, chance, counts = score(own, some["text"])
                ends = np.cumsum(counts)
                hot = np.zeros(len(counts), bool)
                hot[np.repeat(np.arange(len(counts)), counts)[chance >= 0.5]] = True
                found = [spans(some["text"][i].as_py(), chance[ends[i] - counts[i] : ends[i]]) if h else [] for i, h in enumerate(hot)]
                yield pa.RecordBatch.from_arrays([some["doc_id"], pa.array(values), pa.array((values >= 0.5).astype(np.int32)), pa.array(found, kind)], ["doc_id", "score", "predicted", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, SCORED)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
