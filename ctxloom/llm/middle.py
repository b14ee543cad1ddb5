"""Fill-in-the-middle transformation of whole texts, cut between lines.

A text of n lines is cut after two hashed numbers of lines into prefix, middle and suffix, and
written as prefix, suffix, middle (psm) or suffix, prefix, middle (spm) behind sentinels. The
cut places are found by overlapping chunks: every text's bytes are cut into chunks of ``CHUNK``, each
sees one byte before its own, and a byte behind a newline begins a line, which two adjacent
bytes decide. Chunks count their lines independently of each other; prefix sums by text then tell
which chunk owns each of the two ranks, and only the owning chunks are read again.

A row needs no other row, so nothing is shuffled. Nulls: a null text is empty, a null doc_id is
hashed as an empty number. An empty text is plain and has no line. Repeated rows have equal
outputs; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.llm.tokens import steps
from ctxloom.llm.words import raw

CHUNK = 4096
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_NEWLINE = 10
_ROWS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])


class Chunks:
    """Counts of line starts by chunk of every text, and where the line of a rank begins."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, chunk: int = CHUNK):
        self.data, self.bounds = data, bounds
        sizes = np.diff(bounds)
        pieces = -(-sizes // chunk)
        self.first = np.cumsum(pieces) - pieces
        text = np.repeat(np.arange(len(sizes)), pieces)
        self.starts = bounds[text] + (np.arange(len(text)) - self.first[text]) * chunk
        self.ends = np.minimum(self.starts + chunk, bounds[text + 1])
        heads = np.zeros(len(text), np.int64)
        heads[self.first[sizes > 0]] = 1
        #: Bytes just behind a newline, by chunk; the first byte of a text begins a line anyway.
        behind = np.concatenate([[False], data[:-1] == _NEWLINE])
        behind[bounds[:-1][sizes > 0]] = False
        counts = heads + (np.add.reduceat(behind, self.starts, dtype=np.int64) if len(text) else 0)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.n = self.before[self.first + pieces] - self.before[self.first]

    def place(self, text: int, rank: int) -> int:
        """Byte in the text at which its line of ``rank`` begins; its end for a rank of n."""
        if rank >= self.n[text]:
            return int(self.bounds[text + 1] - self.bounds[text])
        if not rank:
            return 0
        wanted = self.before[self.first[text]] + rank
        owner = int(np.searchsorted(self.before, wanted, "right")) - 1
        a, b, inside = int(self.starts[owner]), int(self.ends[owner]), wanted - int(self.before[owner])
        head = owner == self.first[text]
        seen = np.flatnonzero(self.data[a - (not head) : b - 1] == _NEWLINE)  # with the byte before the chunk
        return int(a + seen[inside - head] + head - self.bounds[text])


def draws(seed: int, doc_id: int | None) -> tuple[int, ...]:
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:16])


def _scan(seed: int, rate: int, spm: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in steps(batch):
                ids, data, bounds = some["doc_id"].to_pylist(), *raw(some["text"])
                chunks, whole = Chunks(data, bounds), data.tobytes()
                marked = pc.match_substring_regex(pc.fill_null(some["text"], ""), "<[PSM]>").to_pylist()
                forms, before, middles, outputs = [], [], [], []
                for i, (doc_id, held) in enumerate(zip(ids, marked, strict=True)):
                    h1, h2, h3, h4 = draws(seed, doc_id)
                    text, lines = whole[bounds[i] : bounds[i + 1]], int(chunks.n[i]) + 1
                    if not text or held or h3 % 100 >= rate:
                        forms.append("plain"), before.append(None), middles.append(None), outputs.append(text.decode())
                        continue
                    a, b = (chunks.place(i, rank) for rank in sorted((h1 % lines, h2 % lines)))
                    prefix, middle, suffix = text[:a].decode(), text[a:b].decode(), text[b:].decode()
                    forms.append("spm" if h4 % 100 < spm else "psm"), before.append(len(prefix)), middles.append(len(middle))
                    one, two = PREFIX + prefix, SUFFIX + suffix
                    outputs.append((two + one if forms[-1] == "spm" else one + two) + MIDDLE + middle)
                cols = [ids, chunks.n, forms, before, middles, outputs]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ROWS.types, strict=True)], schema=_ROWS)

    return scan


def transformed(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """A row per document: doc_id, n lines, form, prefix_chars, middle_chars, output.

    ``rate`` percent of the documents are transformed, ``spm`` percent of these suffix first.
    """
    kind = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(_scan(seed, rate, spm), kind)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from; no sentinel can end inside another or in a text."""
    prefix = F.when(form == "psm", F.substring_index(F.substr(output, F.lit(1 + len(PREFIX))), SUFFIX, 1)).otherwise(F.substring_index(F.substring_index(output, MIDDLE, 1), PREFIX, -1))
    suffix = F.when(form == "psm", F.substring_index(F.substring_index(output, MIDDLE, 1), SUFFIX, -1)).otherwise(F.substring_index(F.substr(output, F.lit(1 + len(SUFFIX))), PREFIX, 1))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, F.substring_index(output, MIDDLE, -1), suffix))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transformed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS h FROM documents),
d AS (SELECT doc_id, text, u, len(u) AS n, ('0x' || substr(h, 1, 8))::UBIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::UBIGINT % (len(u) + 1) AS b, ('0x' || substr(h, 17, 8))::UBIGINT % 100 AS r, ('0x' || substr(h, 25, 8))::UBIGINT % 100 AS s FROM t),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r >= 100 THEN 'plain' WHEN s < 50 THEN 'spm' ELSE 'psm' END AS form,
 array_to_string(u[1:least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(u[greatest(a, b) + 1:], '') AS suffix FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM f
"""
