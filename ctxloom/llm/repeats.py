"""Removal of repeated byte strings: every byte that an earlier copy of a 100-byte string covers.

Sorting every suffix (external induced sorting with disk-backed queues) needs more disk than
the corpus budget allows and a queue step for each byte, see the README; so suffixes are
sampled. In each 100-byte window the least hashed ``GRAM``-byte string is its anchor; equal
windows have equal anchors at equal places, so a window can only repeat within the group of
its anchor. Anchors that occur once are dropped after one shuffle of short rows; for the
others the bytes around them are brought together by anchor, ordered by document, and every
window that an earlier row of the group has is a repeat. All positions are judged, on the
input as it was.

An anchor or a passage may stand in a third of all documents, so tasks combine what they
have before it is dealt out: of an anchor that a task has met twice, further rows are known to be
shared and go to any task; of equal bytes around an anchor only those of the first document
are compared with other tasks', the others repeat it as a whole.

Order is (doc_id, hash of text, offset), a null doc_id first; of equal texts all but the
first are repeats as a whole, repeated rows too. A null text is empty, texts under 100 bytes
lose nothing. An empty table gives no row. Other columns pass through ``without_repeats``
whatever their names. Hashes have 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ctxloom.llm.shared import drop_table, free_shuffles, table
from ctxloom.llm.tokens import steps
from ctxloom.llm.words import inverse_powers, mix, prefix_sums, raw

LENGTH, GRAM = 100, 32
#: Window starts per step of a long text; positions within a step take 24 bits.
STEP = 4 << 20
#: Frequent anchors and passages that a task remembers, and tasks that their rows are dealt to.
REMEMBERED, PARTS = 100_000, 1024


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text index, hash, offset and farthest and nearest window start of every anchor."""
    out = []
    first = 0
    while first < len(bounds) - 1:  # texts of a step, or one long text in pieces
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + STEP, "right")) - 1)
        for at in range(int(bounds[first]), int(bounds[last]), STEP) if last == first + 1 else [int(bounds[first])]:
            to = min(int(bounds[last]), at + STEP + LENGTH - 1) if last == first + 1 else int(bounds[last])
            if to - at >= LENGTH:
                out.append(_anchors(data[at:to], at, np.clip(bounds[first : last + 1], at, to), first))
        first = last
    return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(5))


def _anchors(data: np.ndarray, base: int, bounds: np.ndarray, first: int) -> tuple[np.ndarray, ...]:
    sums = prefix_sums(data)
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * inverse_powers(len(data))[: len(data) - GRAM + 1])
    low = np.uint64((1 << 24) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    size, want = 1, LENGTH - GRAM + 1
    while size * 2 <= want:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: len(least) - (want - size)], least[want - size :])
    local = bounds - base
    lens = np.maximum(np.diff(local) - LENGTH + 1, 0)
    if not lens.any():
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    text = np.repeat(np.arange(len(lens)), lens)
    start = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens) + local[text]
    at = (least[start] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    end = np.concatenate([new[1:], [len(at)]]) - 1
    spot = at[new]
    return first + text[new], grams[spot].view(np.int64), spot + base, start[new] + base, start[end] + base


def _scan_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, mark, at, before, after, part): windows of the anchor start ``after`` to ``before`` bytes ahead of it.

    ``part`` is -1 for the rows that tell tasks of each other's anchors.
    """
    schema = pa.schema([("gram", pa.int64()), ("mark", pa.int64()), ("at", pa.int32()), ("before", pa.int16()), ("after", pa.int16()), ("part", pa.int16())])
    seen: set[int] = set()
    frequent = np.zeros(0, np.int64)
    for batch in batches:
        marks = batch["mark"].to_pylist()
        new = [m not in seen and not seen.add(m) for m in marks]
        for some in steps(batch.filter(pa.array(new, pa.bool_()))):
            data, bounds = raw(some["text"])
            text, gram, at, start, end = anchors(data, bounds)
            nth, several = _numbered(gram)
            told = np.isin(gram, frequent)
            part = np.where(told | (nth >= 2), (at * 31 + text) % PARTS, -1).astype(np.int16)
            if len(frequent) < REMEMBERED:
                frequent = np.union1d(frequent, several)
            yield pa.RecordBatch.from_arrays([pa.array(gram), some["mark"].take(pa.array(text)), pa.array((at - bounds[text]).astype(np.int32)), pa.array((at - start).astype(np.int16)), pa.array((at - end).astype(np.int16)), pa.array(part)], schema=schema)


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key's number among its equals, from 0, and the keys that there are three of."""
    order = np.argsort(keys, kind="stable")
    held = keys[order]
    new = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate([new, [len(keys)]]))
    nth = np.empty(len(keys), np.int64)
    nth[order] = np.arange(len(keys)) - np.repeat(new, times)
    return nth, held[new[times >= 3]]


CONTEXTS = pa.schema([("gram", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("start", pa.int32()), ("before", pa.int16()), ("size", pa.int16()), ("part", pa.int16()), ("bytes", pa.binary())])


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From texts and their repeated anchors, the bytes that the anchors' windows cover.

    Where the task has met the same bytes around the anchor in an earlier place, the row is a
    repeat as a whole: it has a ``part`` and no bytes.
    """
    firsts: dict[int, tuple] = {}
    for batch in batches:
        for some in steps(batch):
            data, bounds = raw(some["text"])
            rows = np.repeat(np.arange(some.num_rows), some["spots"].value_lengths().to_numpy())
            spots = some["spots"].flatten()
            gram, at, before, after = (spots.field(i).to_numpy() for i in range(4))
            start, size = at - before, before - after + LENGTH
            ends = np.cumsum(size.astype(np.int64))
            source = np.repeat(bounds[rows] + start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
            doc_id, mark = some["doc_id"].take(pa.array(rows)), some["mark"].take(pa.array(rows))
            part = np.full(len(size), -1, np.int16)
            later = _later(gram, before, data, bounds[rows] + start, size, doc_id, mark, start, firsts)
            part[later] = ((start + rows * 31) % PARTS)[later]
            kept = np.where(part < 0, size, 0)
            limits = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
            cut = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(limits), pa.py_buffer(data[source[np.repeat(part < 0, size)]])])
            yield pa.RecordBatch.from_arrays([pa.array(gram), doc_id, mark, pa.array(start.astype(np.int32)), pa.array(before.astype(np.int16)), pa.array(size.astype(np.int16)), pa.array(part), cut], schema=CONTEXTS)


def _later(gram: np.ndarray, before: np.ndarray, data: np.ndarray, at: np.ndarray, size: np.ndarray, doc_id: pa.Array, mark: pa.Array, start: np.ndarray, firsts: dict[int, tuple]) -> np.ndarray:
    """Rows whose bytes around the anchor an earlier place has, among these and those of ``firsts``."""
    if not len(gram):
        return np.zeros(0, np.int64)
    sums = prefix_sums(data)
    own = (sums[at + size] - sums[at]) * inverse_powers(len(data) + 1)[at]
    key = mix(mix(own) ^ (gram.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + before.astype(np.uint64) * np.uint64(1 << 16) + size.astype(np.uint64))).view(np.int64)
    known = doc_id.is_valid().to_numpy(zero_copy_only=False)
    ids, marks = doc_id.fill_null(0).to_numpy(), mark.to_numpy()
    order = np.lexsort((start, marks, ids, known, key))
    held = key[order]
    new = np.concatenate([[True], held[1:] != held[:-1]])
    edges = np.flatnonzero(new)
    times = np.diff(np.concatenate([edges, [len(held)]]))
    first = order[np.repeat(edges, times)]
    same = (start[order] == start[first]) & (marks[order] == marks[first]) & (ids[order] == ids[first]) & (known[order] == known[first])
    out = ~same  # a row that comes twice is no repeat of itself
    for k, n in zip(edges.tolist(), times.tolist(), strict=True):
        if n < 2 and held[k] not in firsts:
            continue
        row = order[k]
        place = (bool(known[row]), int(ids[row]), int(marks[row]), int(start[row]))
        best = firsts.get(int(held[k]))
        if best is not None and best < place:
            out[k] = True
        elif len(firsts) < REMEMBERED or best is not None:
            firsts[int(held[k])] = place
    return order[out]


def _find_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of windows that an earlier row of the same gram has; rows come by gram, in order.

    Rows with a part are repeats as they are.
    """
    last, known, place_of = None, np.zeros(0, np.uint64), None
    names = ["doc_id", "mark", "start", "end"]
    for batch in batches:
        whole = pc.greater_equal(batch["part"], 0)
        if (done := batch.filter(whole)).num_rows:
            start = done["start"].cast(pa.int64())
            yield pa.RecordBatch.from_arrays([done["doc_id"], done["mark"], start, pc.add(start, done["size"].cast(pa.int64()))], names)
        for some in steps(batch.filter(pc.invert(whole)), "bytes", 1 << 20):
            # Rows of equal documents under one id come twice, one after the other.
            keys = list(zip(*(some[c].to_pylist() for c in ("gram", "doc_id", "mark", "start")), strict=True))
            fresh_rows = [k != before for k, before in zip(keys, [place_of, *keys[:-1]], strict=True)]
            place_of = keys[-1]
            if not all(fresh_rows):
                some = some.filter(pa.array(fresh_rows))
                if not some.num_rows:
                    continue
            gram, before = some["gram"].to_numpy(), some["before"].to_numpy().astype(np.int64)
            data, bounds = raw(some["bytes"])
            windows = np.diff(bounds) - LENGTH + 1
            row = np.repeat(np.arange(len(windows)), windows)
            step = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            at = bounds[row] + step
            sums = prefix_sums(data)
            own = (sums[at + LENGTH] - sums[at]) * inverse_powers(len(data) + 1)[at]
            place = (before[row] - step).astype(np.uint64)
            key = mix(mix(own) ^ (gram[row].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place))
            order = np.argsort(key, kind="stable")
            again = np.zeros(len(key), bool)
            again[order[1:]] = key[order[1:]] == key[order[:-1]]
            if last is not None and gram[0] == last:
                head = row < int(np.searchsorted(gram != last, True)) if (gram != last).any() else np.ones(len(row), bool)
                again[head] |= np.isin(key[head], known)
            tail = gram[row] == gram[-1]
            fresh = np.unique(key[tail & ~again])
            known = np.concatenate([known, fresh]) if last == gram[-1] else fresh
            last = gram[-1]
            edge = np.concatenate([[True], row[1:] != row[:-1]])
            begins = np.flatnonzero(again & (edge | ~np.concatenate([[False], again[:-1]])))
            stops = np.flatnonzero(again & (np.concatenate([edge[1:], [True]]) | ~np.concatenate([again[1:], [False]])))
            offset = some["start"].to_numpy().astype(np.int64)
            take = pa.array(row[begins])
            yield pa.RecordBatch.from_arrays([some["doc_id"].take(take), some["mark"].take(take), pa.array(offset[row[begins]] + step[begins]), pa.array(offset[row[stops]] + step[stops] + LENGTH)], names)


def merged(spans: list[dict], size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the spans cover."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], min(s["end"], size)) for s in spans or []):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif a < b:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _key(docs: DataFrame, keep: list[F.Column]) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"), *keep)


def with_spans(docs: DataFrame, keep: list[F.Column]) -> DataFrame:
    """``docs`` as (doc_id, mark, text, *keep, spans): the repeated spans of each row's bytes."""
    texts, plain = _key(docs, keep), _key(docs, [])
    slim = table(plain.select("doc_id", "mark", F.octet_length("text").alias("size")), "texts")
    firsts = slim.groupBy("mark").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")).alias("first"))

    by_gram = Window.partitionBy("gram", "part")
    spot = F.struct("mark", "at")
    found = plain.select("mark", "text").mapInArrow(_scan_anchors, "gram long, mark long, at int, before short, after short, part short")
    shared = found.select("*", F.min(spot).over(by_gram).alias("lo"), F.max(spot).over(by_gram).alias("hi")).where("part >= 0 or lo <> hi")
    shared = table(shared.dropDuplicates(["gram", "part", "mark", "at", "before"]).select("gram", "mark", "at", "before", "after"), "anchors")
    free_shuffles(docs.sparkSession)
    owners = firsts.select("mark", "first.doc_id")
    spots = shared.join(owners, "mark").groupBy("doc_id", "mark").agg(F.collect_set(F.struct("gram", "at", "before", "after")).alias("spots"))
    given = plain.join(spots.withColumnRenamed("doc_id", "id").withColumnRenamed("mark", "of"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("of"))).select("doc_id", "mark", "text", "spots")
    contexts = given.mapInArrow(_cut_contexts, "gram long, doc_id long, mark long, start int, before short, size short, part short, bytes binary")
    ordered = contexts.repartition("gram", "part").sortWithinPartitions("gram", "part", "doc_id", "mark", "start")
    spans = ordered.mapInArrow(_find_repeats, "doc_id long, mark long, start long, end long")

    copies = slim.join(firsts, "mark").where((F.col("size") >= LENGTH) & ~F.col("doc_id").eqNullSafe(F.col("first.doc_id"))).select("doc_id", "mark", F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("end"))
    spans = table(spans.union(copies.distinct()), "spans").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    drop_table(shared)
    free_shuffles(docs.sparkSession)
    out = texts.join(spans.withColumnRenamed("doc_id", "id").withColumnRenamed("mark", "of"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("of")), "left").drop("id", "of")
    if slim.groupBy("doc_id", "mark").count().where("count > 1").take(1):
        later = F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy("mark")) > 1
        whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("end")))
        out = out.withColumn("later", later).withColumn("spans", F.when(F.col("later") & (F.octet_length("text") >= LENGTH), whole).otherwise(F.col("spans"))).drop("later")
    drop_table(slim)
    return out


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the sha256 of the bytes that stay."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        for batch in batches:
            rows = []
            for text, spans in zip(batch["text"].cast(pa.binary()), batch["spans"].to_pylist(), strict=True):
                data = text.as_py()
                runs = merged(spans, len(data))
                edges = [0, *(x for run in runs for x in run), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names)

    found = with_spans(docs, []).select("doc_id", "text", "spans")
    return found.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` less the repeated bytes, whole characters only; documents left without a word go.

    ``n_chars``, where there is one, is counted again.
    """
    schema = T.StructType([T.StructField("doc", docs.schema), T.StructField("text", T.StringType()), T.StructField("cut", T.BooleanType())])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cut = [], []
            for text, spans in zip(batch["text"].cast(pa.binary()), batch["spans"].to_pylist(), strict=True):
                data = text.as_py()
                runs = merged(spans, len(data))
                edges = [0]
                for a, b in runs:  # a character that is partly covered stays
                    while a < b and data[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                        b -= 1
                    edges += [a, b]
                edges.append(len(data))
                texts.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode())
                cut.append(bool(runs))
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(texts, pa.string()), pa.array(cut, pa.bool_())], ["doc", "text", "cut"])

    out = with_spans(docs, [F.struct(*docs.columns).alias("doc")]).select("doc", "text", "spans").mapInArrow(strip, schema)
    out = out.where(~F.col("cut") | F.col("text").rlike(r"[^ \t-\r]"))
    new = {"text": F.when(F.col("cut"), F.col("text")).otherwise(F.col("doc.text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("cut"), F.length("text").cast(kind)).otherwise(F.col("doc.n_chars"))
    return out.select(*(new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
