"""Bounded-space online packing of token sequences.

Each partition keeps at most ``open_windows`` windows of ``capacity`` ids. A document longer
than a window fills whole windows first; what is left goes best-fit into the open window
with the least room that holds it. When none does, the fullest window is emitted, topped up
with a cut of the document if its room is at least ``least_cut`` ids. At the end a partition
merges its open windows into full ones and one leftover; leftovers of all partitions are
then merged in rounds of ``GROUP``, so no task ever holds more than ``GROUP`` windows.

Nulls: a null text is empty, and still one piece (its end id); a null doc_id is kept.
Repeated doc_ids are packed as separate documents. An empty table gives no row.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.llm.shared import table
from ctxloom.llm.tokens import steps, tokenizer

GROUP = 1024
PIECE = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("offset", pa.int64()), ("doc_tokens", pa.int64())])
ROW = pa.schema([("sequence_id", pa.int64()), ("part", pa.int64()), ("leftover", pa.bool_()), ("ids", pa.list_(pa.int32())), ("pieces", pa.list_(PIECE))])
SCHEMA = "sequence_id long, part long, leftover boolean, ids array<int>, pieces array<struct<doc_id:long,start:long,length:long,offset:long,doc_tokens:long>>"


class Packer:
    """Windows are lists of (ids, doc_id, start, doc_tokens); ``ready`` gathers the emitted ones."""

    def __init__(self, capacity: int = 2048, open_windows: int = 64, least_cut: int = 16):
        self.capacity, self.most, self.least_cut = capacity, open_windows, least_cut
        self.room: list[tuple[int, int]] = []  # (free ids, window), ascending
        self.windows: dict[int, list] = {}
        self.made, self.ready = 0, []

    def _put(self, window: int, free: int, piece: tuple) -> None:
        self.windows[window].append(piece)
        if free := free - len(piece[0]):
            insort(self.room, (free, window))
        else:
            self.ready.append(self.windows.pop(window))

    def add(self, ids: np.ndarray, doc_id: int | None, start: int = 0, doc_tokens: int | None = None) -> None:
        total = len(ids) if doc_tokens is None else doc_tokens
        while len(ids) >= self.capacity:
            self.ready.append([(ids[: self.capacity], doc_id, start, total)])
            ids, start = ids[self.capacity :], start + self.capacity
        if not len(ids):
            return
        ids = ids.copy()
        if (at := bisect_left(self.room, (len(ids), -1))) < len(self.room):
            free, window = self.room.pop(at)
            return self._put(window, free, (ids, doc_id, start, total))
        if len(self.room) >= self.most:
            free, window = self.room.pop(0)
            if free >= self.least_cut:
                self.windows[window].append((ids[:free], doc_id, start, total))
                ids, start = ids[free:], start + free
            self.ready.append(self.windows.pop(window))
            return self.add(ids, doc_id, start, total)
        self.made += 1
        self.windows[self.made] = []
        self._put(self.made, self.capacity, (ids, doc_id, start, total))

    def merged(self) -> list | None:
        """Ends the partition: full windows go to ``ready``, the one that isn't is returned."""
        pieces = [p for _, w in self.room for p in self.windows[w]]
        self.room, self.windows = [], {}
        return fill(pieces, self.capacity, self.ready)


def fill(pieces: list, capacity: int, ready: list) -> list | None:
    """Pieces one after another into full windows; returns the last if it isn't full."""
    window, used = [], 0
    for ids, doc_id, start, total in pieces:
        while len(ids):
            head = ids[: capacity - used]
            window.append((head, doc_id, start, total))
            ids, start, used = ids[len(head) :], start + len(head), used + len(head)
            if used == capacity:
                ready.append(window)
                window, used = [], 0
    return window or None


def _rows(windows: list, first_id: int, part: int, leftover: bool) -> pa.RecordBatch:
    lens = [sum(len(p[0]) for p in w) for w in windows]
    flat = [p for w in windows for p in w]
    ids = np.concatenate([p[0] for p in flat]).astype(np.int32)
    sizes = np.array([len(p[0]) for p in flat], np.int64)
    ends = np.cumsum(sizes)
    window_starts = np.repeat(np.cumsum(lens) - lens, [len(w) for w in windows])
    pieces = pa.StructArray.from_arrays(
        [pa.array([p[1] for p in flat], pa.int64()), pa.array([p[2] for p in flat], pa.int64()), pa.array(sizes), pa.array(ends - sizes - window_starts), pa.array([p[3] for p in flat], pa.int64())], fields=list(PIECE)
    )
    bounds = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(first_id + np.arange(len(windows), dtype=np.int64)),
            pa.array(np.full(len(windows), part, np.int64)),
            pa.array([leftover] * len(windows)),
            pa.ListArray.from_arrays(bounds(lens), pa.array(ids)),
            pa.ListArray.from_arrays(bounds([len(w) for w in windows]), pieces),
        ],
        schema=ROW,
    )


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 2048, open_windows: int = 64, least_cut: int = 16) -> DataFrame:
    """Sequences of ``docs`` (doc_id, text): sequence_id, ids, and the pieces they hold."""

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, coder, packer, made = TaskContext.get().partitionId(), tokenizer(vocabulary), Packer(capacity, open_windows, least_cut), 0
        for batch in batches:
            for some in steps(batch):
                ids, lens = coder.encode(some["text"])
                ids, lens = np.insert(ids, np.cumsum(lens), end_id), lens + 1
                ends = np.cumsum(lens)
                for doc_id, a, b in zip(some["doc_id"].to_pylist(), (ends - lens).tolist(), ends.tolist(), strict=True):
                    packer.add(ids[a:b], doc_id)
                if packer.ready:
                    yield _rows(packer.ready, (part << 32) + made, part, False)
                    made, packer.ready = made + len(packer.ready), []
        last = packer.merged()
        if packer.ready:
            yield _rows(packer.ready, (part << 32) + made, part, False)
            made += len(packer.ready)
        if last:
            yield _rows([last], (part << 32) + made, part, True)

    def merge_pass(level: int):
        def merge(key: tuple, rows: pa.Table) -> pa.Table:
            group, ready, pieces = key[0].as_py(), [], []
            rows = rows.sort_by("sequence_id")
            for ids, held in zip(rows["ids"], rows["pieces"], strict=True):
                ids = ids.values.to_numpy()
                pieces += [(ids[p["offset"] : p["offset"] + p["length"]], p["doc_id"], p["start"], p["doc_tokens"]) for p in held.as_py()]
            last = fill(pieces, capacity, ready)
            first = (level << 59) + (group << 32)
            out = ([_rows(ready, first, group, False)] if ready else []) + ([_rows([last], first + len(ready), group, True)] if last else [])
            return pa.Table.from_batches(out, schema=ROW)

        return merge

    found = table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(first_pass, SCHEMA), "packed")
    done, left, level = [found.where("not leftover")], found.where("leftover"), 1
    while (n := left.count()) > 1:
        merged = table(left.groupBy(F.floor(F.col("part") / GROUP).alias("group")).applyInArrow(merge_pass(level), SCHEMA), "merged")
        done.append(merged.where("not leftover"))
        left, level = merged.where("leftover"), level + 1
        if n <= GROUP and left.count() <= 1:
            break
    out = left
    for one in done:
        out = out.unionByName(one)
    return out.select("sequence_id", "ids", "pieces")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces(sequences: DataFrame) -> DataFrame:
    """A row per piece, with the crc32 of its ids as read from its sequence."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.ascontiguousarray(batch["ids"].flatten().to_numpy(), "<i4")
            lens = batch["ids"].value_lengths().to_numpy()
            counts = batch["pieces"].value_lengths().to_numpy()
            flat = batch["pieces"].flatten()
            columns = dict(zip((f.name for f in PIECE), flat.flatten(), strict=True))
            at = np.repeat(np.cumsum(lens) - lens, counts) + columns["offset"].to_numpy()
            crcs = [zlib.crc32(ids[a:b].data) for a, b in zip(at.tolist(), (at + columns["length"].to_numpy()).tolist(), strict=True)]
            columns |= {"ids_crc32": pa.array(crcs, pa.int64()), "sequence_id": pa.array(np.repeat(batch["sequence_id"].to_numpy(), counts))}
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return sequences.mapInArrow(read, PIECES)


def packed_pieces(docs: DataFrame) -> DataFrame:
    """Production parameters: windows of 2048 ids, end id 1. Other columns of ``docs`` are ignored.

    Pieces are written here, so that a worker reads few whole sequences at once.
    """
    import public_tokenizers

    found = pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return table(pieces(found), "pieces")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))
