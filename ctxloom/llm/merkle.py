"""Merkle manifest of a documents table: one root, a proof for each row, and proofs folded anew.

A row's leaf is the hex SHA-256 of its columns, each as its byte count, ``:`` and value, or
``-`` where null. Rows ascend by doc_id within their lang; runs of ``FANOUT`` nodes become
their hash, level by level, until one is left, the lang's subroot; the subroots, by lang, make
the root in the same way.

Places come from one range sort: a row's place in its lang is its place in its partition plus
the rows that earlier partitions have of that lang. ``FANOUT ** DEPTH`` consecutive leaves are an
aligned block, one task's numpy matrix of 64-byte digests: a level reshapes it by the fanout
and hashes its rows, and a node's siblings are at places that follow from its own by index
arithmetic. Blocks of a lang, however many, never meet in a task: their roots are the leaves
of a next, 4096 times smaller round of the same steps. On the way down a block takes
the path of its root by a join on unique keys and appends it to the paths in the block.

Nulls: any column may be null, a null lang is a group of its own that comes first, a null
doc_id comes first in its lang. Rows that repeat are leaves of their own; equal doc_ids go by leaf. An
empty table gives no row. Other columns are ignored. Very long texts are hashed where they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ctxloom.llm.shared import drop_table, table

#: Nodes of a run, and levels of a block: 4096 leaves, 256 KB of digests.
FANOUT, DEPTH, WIDTH = 8, 4, 64
BLOCK = FANOUT**DEPTH
KEY = ["none", "name"]
_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])
_PATH = "path array<struct<left:string,right:string>>"
_NODES = pa.schema([("none", pa.bool_()), ("name", pa.string()), ("block", pa.int64()), ("path", pa.list_(_STEP)), ("subroot", pa.string()), ("root", pa.string())])


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    said = (c.cast("string") for c in (doc_id, source, lang, n_chars, text))
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in said)), 256)


def leaves(docs: DataFrame, claimed: Column | None = None) -> DataFrame:
    """(none, name, doc_id, leaf, claim): a claim is the leaf with ``claimed`` for a text, null where that is null."""
    own = [docs[c] for c in ("doc_id", "source", "lang", "n_chars")]
    claim = F.lit(None).cast("string") if claimed is None else F.when(claimed.isNotNull(), leaf(*own, claimed))
    return docs.select(docs["lang"].isNull().alias("none"), F.coalesce(docs["lang"], F.lit("")).alias("name"), docs["doc_id"].cast("long").alias("doc_id"), leaf(*own, docs["text"]).alias("leaf"), claim.alias("claim"))


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with their place from 0 in their KEY by ``order``, and the rows of their KEY."""
    cut = rows.repartitionByRange(F.col("none").desc(), "name", *order).sortWithinPartitions(F.col("none").desc(), "name", *order)
    cut = table(cut.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "places")
    parts = cut.groupBy("part", *KEY).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    key = Window.partitionBy(*KEY)
    parts = parts.withColumn("before", F.sum("n").over(key.orderBy("part")) - F.col("n")).withColumn("total", F.sum("n").over(key)).drop("n")
    return cut.join(parts, ["part", *KEY]).withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("part", "at", "first", "before")


def hashed(rows: np.ndarray, last: int) -> np.ndarray:
    """Digests of the rows of a byte matrix, of the last row only its first ``last`` bytes."""
    flat, wide, n = rows.tobytes(), rows.shape[1], len(rows)
    ends = [*range(wide, n * wide, wide), (n - 1) * wide + last]
    return np.frombuffer("".join(hashlib.sha256(flat[i * wide : e]).hexdigest() for i, e in enumerate(ends)).encode(), np.uint8).reshape(n, WIDTH)


def levels(nodes: np.ndarray, total: int) -> list[np.ndarray]:
    """Digest matrices of an aligned block's levels; ``total`` nodes are in its whole group."""
    out = [nodes]
    while len(out) <= DEPTH and total > 1:
        rows = out[-1]
        missing = -len(rows) % FANOUT
        full = np.concatenate([rows, np.zeros((missing, WIDTH), np.uint8)]).reshape(-1, FANOUT * WIDTH)
        out.append(hashed(full, (FANOUT - missing) * WIDTH))
        total = -(-total // FANOUT)
    return out


def runs(level: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By node: the digests of its run, its slot there, and the run's size."""
    start = node // FANOUT * FANOUT
    at = start[:, None] + np.arange(FANOUT)
    return level[np.minimum(at, len(level) - 1)], node - start, np.minimum(FANOUT, len(level) - start)


def _text(digests: np.ndarray) -> str:
    return digests.tobytes().decode()


def _packed(key: tuple, rows: pa.Table) -> pa.Table:
    """One row of a block: what it holds in order, and its root."""
    rows = rows.sort_by("pos")
    total = rows["total"][0].as_py()
    nodes = np.frombuffer("".join(rows["leaf"].to_pylist()).encode(), np.uint8).reshape(-1, WIDTH)
    own = {"none": [key[0].as_py()], "name": [key[1].as_py()], "block": pa.array([key[2].as_py()], pa.int64()), "total": pa.array([total], pa.int64())}
    lists = {k: pa.array([rows[k].to_pylist()], pa.list_(t)) for k, t in (("doc_id", pa.int64()), ("claim", pa.string()))}
    return pa.table({**own, **lists, "nodes": pa.array([nodes.tobytes()], pa.binary()), "top": [_text(levels(nodes, total)[-1][0])]})


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """Packed blocks of each round. ``nodes``: KEY, pos, total, leaf, doc_id, claim."""
    kind = "none boolean, name string, block long, total long, doc_id array<long>, claim array<string>, nodes binary, top string"
    out = []
    while True:
        out.append(table(nodes.groupBy(*KEY, F.floor(F.col("pos") / BLOCK).alias("block")).applyInArrow(_packed, kind), "blocks"))
        blocks = F.ceil(F.col("total") / BLOCK)
        nodes = out[-1].where(blocks > 1).select(*KEY, F.col("block").alias("pos"), blocks.alias("total"), F.col("top").alias("leaf"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("claim"))
        if not nodes.take(1):
            return out


def tops(packed: list[DataFrame]) -> DataFrame:
    """(KEY, top) of every group: the root of the round in which it is a single block."""
    single = [p.where(F.col("total") <= BLOCK).select(*KEY, "top") for p in packed]
    out = single[0]
    for more in single[1:]:
        out = out.unionByName(more)
    return out


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path of every node of a block, from the node to the group's end."""
    for batch in batches:
        for row in batch.to_pylist():
            nodes = np.frombuffer(row["nodes"], np.uint8).reshape(-1, WIDTH)
            n, made = len(nodes), levels(nodes, row["total"])
            paths, node = [[] for _ in range(n)], np.arange(n)
            for level in made[:-1]:
                own, slots, sizes = runs(level, node)
                for i, (slot, size) in enumerate(zip(slots.tolist(), sizes.tolist(), strict=True)):
                    paths[i].append({"left": _text(own[i, :slot]), "right": _text(own[i, slot + 1 : size])})
                node = node // FANOUT
            rest = row["path"]
            cols = [[row["none"]] * n, [row["name"]] * n, range(row["block"] * BLOCK, row["block"] * BLOCK + n), [p + rest for p in paths], [row["subroot"]] * n, [row["root"]] * n]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _NODES.types, strict=True)], schema=_NODES)


def _proofs(schema: pa.Schema):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _proved(row, schema)

    return scan


def _proved(row: dict, schema: pa.Schema) -> pa.RecordBatch:
    """A row per leaf of a block: its proof's digest, and its claim (or itself) folded to a root."""
    nodes = np.frombuffer(row["nodes"], np.uint8).reshape(-1, WIDTH)
    n, made, node = len(nodes), levels(nodes, row["total"]), np.arange(len(nodes))
    said = nodes.copy()
    for i, claim in enumerate(row["claim"]):
        if claim is not None:
            said[i] = np.frombuffer(claim.encode(), np.uint8)
    proof, steps = [hashlib.sha256() for _ in range(n)], [[] for _ in range(n)] if "path" in schema.names else None
    for level in made[:-1]:
        own, slots, sizes = runs(level, node)
        others = np.arange(FANOUT - 1) + (np.arange(FANOUT - 1) >= slots[:, None])
        siblings = own[np.arange(n)[:, None], others].reshape(n, -1)
        for held, line, size in zip(proof, siblings, sizes.tolist(), strict=True):
            held.update(line[: (size - 1) * WIDTH])
        if steps is not None:
            for i, (slot, size) in enumerate(zip(slots.tolist(), sizes.tolist(), strict=True)):
                steps[i].append({"left": _text(own[i, :slot]), "right": _text(own[i, slot + 1 : size])})
        own[np.arange(n), slots] = said
        lines = own.reshape(n, -1)
        said = np.frombuffer("".join(hashlib.sha256(line[: size * WIDTH]).hexdigest() for line, size in zip(lines, sizes.tolist(), strict=True)).encode(), np.uint8).reshape(n, WIDTH)
        node = node // FANOUT
    rest = "".join(s["left"] + s["right"] for s in row["path"]).encode()
    folded = []
    for held, digest in zip(proof, said, strict=True):
        held.update(rest)
        one = _text(digest)
        for s in row["path"]:
            one = hashlib.sha256((s["left"] + one + s["right"]).encode()).hexdigest()
        folded.append(one)
    cols = {
        "doc_id": row["doc_id"], "lang": [None if row["none"] else row["name"]] * n, "leaf": [_text(x) for x in nodes], "subroot": [row["subroot"]] * n, "root": [row["root"]] * n,
        "proof_sha256": [h.hexdigest() for h in proof], "folded_root": folded, "verified": [f == row["root"] for f in folded], "path": steps and [s + row["path"] for s in steps],
    }
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)


def _down(packed: list[DataFrame], ends: DataFrame) -> DataFrame:
    """Blocks of the first round, each with its path, subroot and root. ``ends``: KEY, path, subroot, root."""
    below = None
    for p in reversed(packed):
        single = F.col("total") <= BLOCK
        here = p.where(single).join(ends, KEY).unionByName(p.where(~single).join(below, [*KEY, "block"])) if below is not None else p.join(ends, KEY)
        if p is not packed[0]:
            below = table(here.mapInArrow(_paths, f"none boolean, name string, block long, {_PATH}, subroot string, root string"), "paths")
    return here


def manifest(docs: DataFrame, claimed: Column | None = None, paths: bool = False) -> DataFrame:
    """A row per document: doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``folded_root`` comes from the leaf that a document has with ``claimed`` for a text (its own
    leaf where that is null or not given) and the siblings on its path; ``verified`` says
    whether it is the root. ``paths`` adds the path itself: by level, what is left and right of it.
    """
    rows = table(leaves(docs, claimed).withColumn("tie", F.monotonically_increasing_id()), "leaves")
    packed = rounds(placed(rows, [F.col("doc_id"), F.col("leaf"), F.col("tie")]))
    drop_table(rows)
    langs = tops(packed).select(*(F.col(k).alias(f"lang_{k}") for k in KEY), F.col("top").alias("subroot"))
    one = langs.select(F.lit(False).alias("none"), F.lit("").alias("name"), "*", F.col("subroot").alias("leaf"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("claim"))
    order = table(placed(one, [F.col("lang_none").desc(), F.col("lang_name")]), "subroots")
    whole = rounds(order.drop("lang_none", "lang_name", "subroot"))
    ends = tops(whole).select(*KEY, F.lit(None).cast("array<struct<left:string,right:string>>").alias("path"), F.lit("").alias("subroot"), F.col("top").alias("root"))
    ends = ends.withColumn("path", F.coalesce("path", F.array().cast("array<struct<left:string,right:string>>")))
    above = _down(whole, ends).mapInArrow(_paths, f"none boolean, name string, block long, {_PATH}, subroot string, root string")
    ends = above.select(F.col("block").alias("pos"), "path", "root").join(order.select("pos", "lang_none", "lang_name", "subroot"), "pos")
    ends = table(ends.select(F.col("lang_none").alias("none"), F.col("lang_name").alias("name"), "path", "subroot", "root"), "ends")
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("lang", "leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_()), *([("path", pa.list_(_STEP))] if paths else [])])
    kind = "doc_id long, lang string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (f", {_PATH}" if paths else "")
    out = table(_down(packed, ends).mapInArrow(_proofs(schema), kind), "proofs")
    for done in (*packed, *whole, order):
        drop_table(done)
    return out


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folded = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, folded)
    return manifest(docs, tampered).drop("lang")


def _sql(lang_levels: int = 7, top_levels: int = 4) -> str:
    """The manifest level by level, enough of them for 8 ** 7 rows of a lang and 8 ** 4 langs."""
    fields = lambda text: "||".join(f"coalesce(strlen({c}::VARCHAR)||':'||{c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda s, x: list_reduce([xor(s, x)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"
    out = [
        f"d AS (SELECT doc_id, lang, sha256({fields('text')}) AS leaf, CASE WHEN {crc} % 3 = 0 THEN sha256({fields(lower)}) END AS claim FROM documents)",
        "l0 AS (SELECT doc_id, lang, leaf, coalesce(claim, leaf) AS cur0, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS total FROM d)",
        "n0 AS (SELECT lang, pos, total, leaf AS h FROM l0)",
    ]

    def climb(n: str, by: str, k: int) -> list[str]:
        up = f"SELECT {by}, pos // 8 AS pos, string_agg(h, '' ORDER BY pos) AS s, any_value((total + 7) // 8) AS total FROM {n}{k} WHERE total > 1 GROUP BY {by}, pos // 8"
        return [f"{n}r{k} AS ({up})", f"{n}{k + 1} AS (SELECT {by}, pos, total, sha256(s) AS h FROM {n}r{k} UNION ALL SELECT {by}, pos, total, h FROM {n}{k} WHERE total = 1)"]

    for k in range(lang_levels):
        out += climb("n", "lang", k)
    out += [f"t AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS total FROM n{lang_levels})", "m0 AS (SELECT 0 AS one, pos, total, subroot AS h FROM t)"]
    for k in range(top_levels):
        out += climb("m", "one", k)
    step = "CASE WHEN r.s IS NULL THEN {cur} ELSE sha256(substr(r.s, 1, 64 * ({pos} % 8)) || {cur} || substr(r.s, 64 * ({pos} % 8) + 65)) END"
    said = "coalesce(substr(r.s, 1, 64 * ({pos} % 8)) || substr(r.s, 64 * ({pos} % 8) + 65), '')"
    out.append("p0 AS (SELECT l0.doc_id, l0.lang, l0.leaf, l0.pos, l0.cur0 AS cur, '' AS proof, t.subroot, t.pos AS at FROM l0 JOIN t ON l0.lang IS NOT DISTINCT FROM t.lang)")
    for k in range(lang_levels + top_levels):
        below, j = k < lang_levels, k if k < lang_levels else k - lang_levels
        pos = f"(p.{'pos' if below else 'at'} // {8**j})"
        on = f"r.pos = p.pos // {8 ** (j + 1)} AND r.lang IS NOT DISTINCT FROM p.lang" if below else f"r.pos = p.at // {8 ** (j + 1)}"
        out.append(f"p{k + 1} AS (SELECT p.doc_id, p.lang, p.leaf, p.pos, {step.format(cur='p.cur', pos=pos)} AS cur, p.proof || {said.format(pos=pos)} AS proof, p.subroot, p.at FROM p{k} p LEFT JOIN {'n' if below else 'm'}r{j} r ON {on})")
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, (SELECT h FROM m{top_levels}) AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = (SELECT h FROM m{top_levels}) AS verified FROM p{lang_levels + top_levels}"


OP13_SQL = _sql()
