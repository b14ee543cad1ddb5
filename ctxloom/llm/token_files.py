"""Token-ID files of patched frame-of-reference blocks.

Layout of one file, little-endian: ``MAGIC``, then for each block its packed words and its
exceptions, then the tail: block starts (uint64), minima (uint32), exception counts
(uint32), widths (uint8), document ids (int64), null flags (uint8), document ends (uint64),
and a footer of counts. A block holds ``BLOCK`` ids: the block minimum is subtracted, the
rest is packed at the width that ``PERCENTILE`` per cent of the block fit in, and the high
parts of the others go to the exception list as (position, value) pairs. The index of block
starts gives any id range without reading what lies before it.

Nulls: a null text is an empty text; a null doc_id is kept and sorts first. Repeated doc_ids
stay separate documents, ordered by the hash of their text (equal texts in any order), so an
id that many rows share is dealt to many tasks. An empty table gives no file and no row. Other
columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ctxloom.llm.shared import fresh_path, table
from ctxloom.llm.tokens import steps, tokenizer

BLOCK, PERCENTILE = 512, 95
#: A file is closed at the first document end past so many ids.
SHARD_IDS = 4_000_000
#: Tasks of a block of prefix sums, and most tasks that read files.
SUM_BLOCK, READ_TASKS = 4096, 8192
MAGIC = b"PFORIDS1"
FOOTER = "<QQQQ"


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(rows, BLOCK) values under 2**width to (rows, BLOCK * width / 64) words."""
    lanes = values.reshape(-1, 64).astype(np.uint64)
    words = np.zeros((len(lanes), max(width, 1)), np.uint64)
    for i in range(64 if width else 0):
        at, shift = divmod(i * width, 64)
        words[:, at] |= lanes[:, i] << np.uint64(shift)
        if shift + width > 64:
            words[:, at + 1] |= lanes[:, i] >> np.uint64(64 - shift)
    return words[:, :width].reshape(len(values), -1)


def _unpack(words: np.ndarray, width: int, rows: int) -> np.ndarray:
    """The inverse of ``_pack``."""
    if not width:
        return np.zeros((rows, BLOCK), np.uint64)
    words, mask = words.reshape(-1, width), np.uint64((1 << width) - 1)
    lanes = np.empty((len(words), 64), np.uint64)
    for i in range(64):
        at, shift = divmod(i * width, 64)
        lanes[:, i] = words[:, at] >> np.uint64(shift)
        if shift + width > 64:
            lanes[:, i] |= words[:, at + 1] << np.uint64(64 - shift)
    return (lanes & mask).reshape(rows, BLOCK)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bit lengths."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def encode_file(doc_ids: np.ndarray, nulls: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> bytes:
    """Bytes of one file; ``ends`` are the documents' ends among ``ids``."""
    n_blocks = -(-len(ids) // BLOCK)
    padded = np.empty(n_blocks * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    padded[len(ids) :] = ids[-1] if len(ids) else 0
    blocks = padded.reshape(n_blocks, BLOCK)
    mins = blocks.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    rest = blocks - mins[:, None]
    keep = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    widths = _bits(np.partition(rest, keep, axis=1)[:, keep]) if n_blocks else np.zeros(0, np.int64)
    high = rest.astype(np.uint64) >> widths[:, None].astype(np.uint64)
    row, at = np.nonzero(high)
    counts = np.bincount(row, minlength=n_blocks)
    exceptions = np.empty(len(row), np.dtype([("at", "<u2"), ("high", "<u4")]))
    exceptions["at"], exceptions["high"] = at, high[row, at]
    sizes = widths * (BLOCK // 8) + counts * exceptions.itemsize
    starts = len(MAGIC) + np.cumsum(sizes) - sizes
    body = np.zeros(int(sizes.sum()), np.uint8)
    for width in np.unique(widths):
        these = np.nonzero(widths == width)[0]
        if width:
            low = rest[these].astype(np.uint64) & np.uint64((1 << int(width)) - 1)
            packed = _pack(low, int(width)).astype("<u8").view(np.uint8).reshape(len(these), -1)
            body[(starts[these] - len(MAGIC))[:, None] + np.arange(packed.shape[1])] = packed
    if len(row):
        raw = exceptions.view(np.uint8).reshape(len(row), -1)
        rank = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        to = starts[row] - len(MAGIC) + widths[row] * (BLOCK // 8) + rank * exceptions.itemsize
        body[to[:, None] + np.arange(exceptions.itemsize)] = raw
    tail = [starts.astype("<u8"), mins.astype("<u4"), counts.astype("<u4"), widths.astype("u1"), doc_ids.astype("<i8"), nulls.astype("u1"), ends.astype("<u8")]
    footer = struct.pack(FOOTER, n_blocks, len(ids), len(doc_ids), len(MAGIC) + len(body))
    return b"".join([MAGIC, body.tobytes(), *(x.tobytes() for x in tail), footer])


class TokenFile:
    """Reads a file's bytes; ``ids(start, stop)`` decodes only the blocks that range needs."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token-ID file")
        size = struct.calcsize(FOOTER)
        n_blocks, self.n_ids, n_docs, at = struct.unpack(FOOTER, data[-size:])
        self.data, fields = data, []
        for kind, count in (("<u8", n_blocks), ("<u4", n_blocks), ("<u4", n_blocks), ("u1", n_blocks), ("<i8", n_docs), ("u1", n_docs), ("<u8", n_docs)):
            fields.append(np.frombuffer(data, kind, count, at))
            at += fields[-1].nbytes
        self.starts, self.mins, self.counts, self.widths, self.doc_ids, nulls, ends = fields
        self.nulls, self.ends = nulls.astype(bool), ends.astype(np.int64)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, -(-stop // BLOCK)
        out = np.zeros((last - first, BLOCK), np.uint64)
        raw = np.frombuffer(self.data, np.uint8)
        starts, widths = self.starts[first:last].astype(np.int64), self.widths[first:last].astype(np.int64)
        for width in np.unique(widths):
            these = np.nonzero(widths == width)[0]
            if width:
                packed = raw[starts[these][:, None] + np.arange(int(width) * BLOCK // 8)]
                out[these] = _unpack(packed.reshape(-1).view("<u8"), int(width), len(these))
        counts = self.counts[first:last].astype(np.int64)
        if counts.any():
            kind = np.dtype([("at", "<u2"), ("high", "<u4")])
            row = np.repeat(np.arange(last - first), counts)
            rank = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            at = starts[row] + widths[row] * (BLOCK // 8) + rank * kind.itemsize
            found = np.ascontiguousarray(raw[at[:, None] + np.arange(kind.itemsize)]).reshape(-1).view(kind)
            out[row, found["at"]] |= found["high"].astype(np.uint64) << widths[row].astype(np.uint64)
        out += self.mins[first:last, None]
        return out.reshape(-1)[start - first * BLOCK : stop - first * BLOCK].astype(np.uint32)


MANIFEST = "part int, shard int, file string, n_docs long, n_ids long, n_bytes long"


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int | None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order to files under ``path``.

    Returns the manifest, a written table with a row per file; files of failed or repeated
    attempts are in no manifest and so are never read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        part, coder = TaskContext.get().partitionId(), tokenizer(vocabulary)
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        shard, held = 0, []

        def flush() -> pa.RecordBatch:
            nonlocal shard, held
            doc_ids, nulls, lens, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            data = encode_file(doc_ids, nulls, np.cumsum(lens), ids)
            name = f"{part:06d}-{shard:04d}-{uuid.uuid4().hex}.pfor"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(data)
            row = pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "file": name, "n_docs": len(lens), "n_ids": len(ids), "n_bytes": len(data)}], schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))
            shard, held = shard + 1, []
            return row

        for batch in batches:
            for some in steps(batch):
                ids, lens = coder.encode(some["text"])
                if end_id is not None:
                    ids, lens = np.insert(ids, np.cumsum(lens), end_id), lens + 1
                keys = some["doc_id"]
                held.append((keys.fill_null(0).to_numpy(), keys.is_null().to_numpy(zero_copy_only=False), lens, ids))
                if sum(len(x[3]) for x in held) >= shard_ids:
                    yield flush()
        if held:
            yield flush()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = texts.select("*", F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("salt"))
    ordered = keyed.repartitionByRange("doc_id", "mark", "salt").sortWithinPartitions("doc_id", "mark", "text")
    return table(ordered.select("doc_id", "text").mapInArrow(write, MANIFEST), "manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """``manifest`` with the ids before each file: sums inside a task, a block of tasks, and over blocks."""
    block = F.floor(F.col("part") / SUM_BLOCK).alias("block")
    parts = manifest.groupBy("part", block).agg(F.sum("n_ids").alias("ids"))
    blocks = parts.groupBy("block").agg(F.sum("ids").alias("ids"))
    earlier = lambda value, window: F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(value)
    blocks = blocks.select("block", earlier("ids", Window.orderBy("block")).alias("before_block"))
    parts = parts.select("part", "block", earlier("ids", Window.partitionBy("block").orderBy("part")).alias("before_part"))
    files = manifest.select("*", earlier("n_ids", Window.partitionBy("part").orderBy("shard")).alias("before_file"))
    placed = files.join(parts, "part").join(F.broadcast(blocks), "block")
    return placed.select(*manifest.columns, (F.col("before_block") + F.col("before_part") + F.col("before_file")).alias("start"))


DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_files(manifest: DataFrame, path: str) -> DataFrame:
    """A row per document: its id, the ids before it, its number of ids and their crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_stream(f"{root}/{row['file']}") as data:
                    found = TokenFile(data.read())
                ids, ends = found.ids().astype("<u4"), found.ends
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                crcs = [zlib.crc32(ids[a:b].data) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.doc_ids, mask=found.nulls), pa.array(row["start"] + starts), pa.array(ends - starts), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    files = with_starts(manifest).select("file", "n_bytes", "start")
    return files.repartition(max(1, min(manifest.count(), READ_TASKS)), "file").mapInArrow(read, DIGEST)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` to token-ID files and back; see the module for nulls and ties."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = fresh_path(spark, "token-files")
    manifest = write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(manifest, path)
