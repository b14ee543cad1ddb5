"""Benchmark decontamination by spaced seeds.

Words are lower-cased runs of letters and digits. Each mask leaves some words of a window out;
a benchmark item and a document that agree on a mask's words agree on its hash, whatever
stands at the places left out. Every hit names a diagonal (place in the document less place
in the item); along it the best segment, one for a match and minus two for a substitution,
must match at least ``LEAST`` words, or ``SHARE`` of an item that is short; an item under five
words must match whole.

The masks miss none of these segments: in a best segment every prefix scores above zero, so
its first ``WEIGHT`` matches lie in one of few ways (``masks``), and each way is a mask. Items
of less than ``WEIGHT`` necessary matches have masks of that many. Texts that repeat a few
words hit an item on nearly every diagonal: these are then compared word by word, in steps.

The benchmark side goes to the executors in slices of at most ``SLICE_BYTES`` of text, one
scan of the documents for each, so memory is bounded whatever its size.

Nulls: a null text has no words; null ids are kept. Repeated rows give one result row by
(doc_id, item_id), that of the best match, of equal ones the first in the text. Empty tables
give no row. ``without_leaks`` judges each row by its own text, whatever other rows have its
id; a few words say nothing about a leak, so items under ``SHORTEST`` words remove no
document there. Other columns pass through it whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.llm.tokens import steps
from ctxloom.llm.words import mix, word_hashes

WEIGHT, LEAST, SHARE, SHORTEST = 7, 12, 0.8, 5
#: Seeds of a slice take some 80 bytes for each byte of its text. Word pairs compared at once.
SLICE_BYTES, BITS, STEP = 1 << 20, 20, 1 << 20
_PLACES = np.random.default_rng(30).integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)
_OTHER = np.array([not chr(i).isalnum() if i < 128 else False for i in range(256)])


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(pc.utf8_lower(texts.fill_null("")), fold=False, separator=_OTHER)


def masks(weight: int) -> list[str]:
    """Every way in which the first ``weight`` matches of a best segment can lie."""
    out, todo = [], ["1"]
    while todo:
        mask = todo.pop()
        if mask.count("1") == weight:
            out.append(mask)
            continue
        todo.append(mask + "1")
        if mask.count("1") > 2 * (mask.count("0") + 1):
            todo.append(mask + "0")
    return sorted(out)


def _needed(size: int) -> int:
    return math.ceil(min(LEAST, SHARE * size))


def _seeds(words: np.ndarray, mask: str, at: np.ndarray | None = None) -> np.ndarray:
    """The hash of the window that begins at each word, or at those of ``at``."""
    n = max(len(words) - len(mask) + 1, 0) if at is None else len(at)
    out = np.full(n, len(mask) + 16 * int(mask, 2), np.uint64)
    for k, used in enumerate(mask):
        if used == "1" and n:
            out += (words[k : k + n] if at is None else words[at + k]) * _PLACES[k]
    return mix(out)


def _bits(seeds: np.ndarray) -> np.ndarray:
    return (seeds >> np.uint64(64 - BITS)).astype(np.int64)


class Benchmark:
    """Sorted seeds of a slice of items, with a bit map in front."""

    #: All masks of items of three words or more begin so, since a best segment does.
    HEAD = "111"

    def __init__(self, texts: list[str]):
        words, counts = _words(pa.array(texts, pa.string()))
        ends = np.cumsum(counts)
        starts = ends - counts
        self.items = [words[a:b] for a, b in zip(starts, ends, strict=True)]
        weights = np.array([min(WEIGHT, _needed(n)) for n in counts.tolist()], np.int64)
        owner = np.repeat(np.arange(len(counts)), counts)
        within = np.arange(len(words)) - starts[owner]
        self.heads, self.tables = np.zeros(1 << BITS, bool), []
        for weight in np.unique(weights[weights > 0]).tolist():
            for mask in masks(weight):
                whole = np.flatnonzero((weights[owner] == weight) & (within + len(mask) <= counts[owner]))
                if not len(whole):
                    continue
                if weight >= len(self.HEAD):
                    self.heads[_bits(_seeds(words, self.HEAD, whole))] = True
                seeds = _seeds(words, mask, whole)
                order = np.lexsort((owner[whole], seeds))
                seeds, whole = seeds[order], whole[order]
                bits = np.zeros(1 << BITS, bool)
                bits[_bits(seeds)] = True
                # a row by seed and item; its places in the item lie behind one another
                first = np.flatnonzero(np.concatenate([[True], (seeds[1:] != seeds[:-1]) | (owner[whole[1:]] != owner[whole[:-1]])]))
                times = np.diff(np.concatenate([first, [len(seeds)]]))
                self.tables.append((mask, seeds[first], owner[whole[first]], first, times, within[whole].astype(np.int32), bits))

    def hits(self, words: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """By mask: document, its word, item, and where the item's words that hit are listed."""
        ends = np.cumsum(counts)
        heads = np.flatnonzero(self.heads[_bits(_seeds(words, self.HEAD))])
        for mask, seeds, items, first, times, places, bits in self.tables:
            at = heads if mask.startswith(self.HEAD) else np.arange(len(words))
            at = at[ends[np.searchsorted(ends, at, "right")] - at >= len(mask)]
            own = _seeds(words, mask, at)
            some = bits[_bits(own)]
            at, own = at[some], own[some]
            lo, hi = np.searchsorted(seeds, own, "left"), np.searchsorted(seeds, own, "right")
            n = hi - lo
            row = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            at = np.repeat(at, n)
            doc = np.searchsorted(ends, at, "right")
            yield doc, at - (ends - counts)[doc], items[row], first[row], times[row], places

    def found(self, words: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, words that match, their span) of each leak, the best by both.

        Where an item's words repeat so often that a document has more hits than words, all
        its diagonals are tried and none is listed.
        """
        n_items = max(len(self.items), 1)
        dense, listed = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
        for doc, at, item, first, times, places in self.hits(words, counts):
            pairs, pair = np.unique(doc * n_items + item, return_inverse=True)
            many = np.bincount(pair, times, len(pairs)) > np.maximum(counts[pairs // n_items], 1)
            dense.append(pairs[many])
            few = ~many[pair]
            key, at, first, times = pairs[pair[few]], at[few], first[few], times[few]
            place = places[np.repeat(first - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
            listed.append(np.unique(np.stack([np.repeat(key, times), np.repeat(at, times) - place], axis=1), axis=0))
        whole = np.unique(np.concatenate(dense))
        some = np.unique(np.concatenate(listed), axis=0)
        some = some[~np.isin(some[:, 0], whole)]
        ends, out = np.cumsum(counts), []
        own = lambda doc: words[ends[doc] - counts[doc] : ends[doc]]
        for pair, diagonals in (*((p, None) for p in whole.tolist()), *((int(x[0, 0]), x[:, 1]) for x in np.split(some, np.flatnonzero(np.diff(some[:, 0])) + 1) if len(x))):
            doc, item = divmod(pair, n_items)
            if best := overlap(own(doc), self.items[item], diagonals):
                out.append((doc, item, *best))
        return out


def overlap(words: np.ndarray, item: np.ndarray, diagonals: np.ndarray | None = None) -> tuple[int, int, int] | None:
    """Words that match, and their span, of the best segment on the diagonals (all, if None are given)."""
    size, best = len(item), None
    n = size + len(words) - 1 if diagonals is None else len(diagonals)
    step = max(1, STEP // size)
    for k in range(0, n, step):
        shift = np.arange(1 - size + k, 1 - size + min(k + step, n)) if diagonals is None else diagonals[k : k + step]
        at = shift[:, None] + np.arange(size)
        same = (words[np.clip(at, 0, len(words) - 1)] == item) & (at >= 0) & (at < len(words))
        total = np.concatenate([np.zeros((len(shift), 1), np.int64), np.cumsum(np.where(same, 1, -2), axis=1)], axis=1)
        least = np.minimum.accumulate(total, axis=1)
        row = np.arange(len(shift))
        end = np.argmax(total - least, axis=1)
        lows = (total == least[row, end][:, None]) & (np.arange(size + 1) <= end[:, None])
        start = size - np.argmax(lows[:, ::-1], axis=1)
        so_far = np.concatenate([np.zeros((len(shift), 1), np.int64), np.cumsum(same, axis=1)], axis=1)
        matched = so_far[row, end] - so_far[row, start]
        top = max(range(len(shift)), key=lambda i: (matched[i], -(shift[i] + start[i]))) if len(shift) < 64 else int(np.lexsort((shift + start, -matched))[0])
        one = (int(matched[top]), int(shift[top] + start[top]), int(shift[top] + end[top]))
        if best is None or (one[0], -one[1]) > (best[0], -best[1]):
            best = one
    return best if best and best[0] >= min(LEAST, SHARE * size) else None


FOUND = "doc_id long, mark long, item int, matched int, start int, end int"


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Leaks by document: doc_id, mark (hash of its text), item_id, item_words, matched, start, end."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-size // SLICE_BYTES))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    out = None
    for k in range(slices):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == k).collect() if slices > 1 else items.collect()
        held = spark.sparkContext.broadcast([r["text"] for r in rows])

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            known = Benchmark(held.value)
            for batch in batches:
                for some in steps(batch):
                    if rows := known.found(*_words(some["text"])):
                        doc, *rest = zip(*rows, strict=True)
                        take = pa.array(doc)
                        yield pa.RecordBatch.from_arrays([some["doc_id"].take(take), some["mark"].take(take), *(pa.array(x, pa.int32()) for x in rest)], ["doc_id", "mark", "item", "matched", "start", "end"])

        sizes = _words(pa.array(held.value, pa.string()))[1].tolist()
        names = spark.createDataFrame([(i, r["item_id"], n) for i, (r, n) in enumerate(zip(rows, sizes, strict=True))], "item int, item_id long, item_words long")
        one = texts.mapInArrow(scan, FOUND).join(F.broadcast(names), "item")
        out = one if out is None else out.unionByName(one)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_matched, item_words, start_word, end_word) of each leaked item."""
    best = _found(docs, benchmark).groupBy("doc_id", "item_id", "item_words").agg(F.max(F.struct("matched", (-F.col("start")).alias("back"), "end")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.matched").cast("long").alias("n_matched"), "item_words", (-F.col("best.back")).cast("long").alias("start_word"), F.col("best.end").cast("long").alias("end_word"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` less those that hold a benchmark item of ``shortest`` words or more, all columns as they were."""
    found = _found(docs, benchmark).where(F.col("item_words") >= shortest).select(F.col("doc_id").alias("_leak"), F.col("mark").alias("_of")).distinct()
    whole = docs.select(F.struct("*").alias("_doc"))
    same = F.col("_doc.doc_id").cast("long").eqNullSafe(F.col("_leak")) & (F.xxhash64("_doc.text") == F.col("_of"))
    return whole.join(found, same, "left_anti").select("_doc.*")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
