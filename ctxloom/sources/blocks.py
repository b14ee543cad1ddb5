"""Content blocks nested in each other to any depth, level by level.

A message's content is JSON: a text, or an array of blocks, whose ``content`` may be a text or an
array of blocks again. Each level is one pass over the blocks of the level before that hold others; the
passes end where the data ends. VARIANT values tell a text that looks like an array from an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxloom.functions.text import BLOCK_OVERHEAD, MESSAGE_OVERHEAD, text_units
from ctxloom.plans.registry import held

_OWN = ("type", "text", "name", "arguments")


def array_of(value: Column) -> Column:
    """The array of blocks that a value is, null for any other value."""
    items = value.try_cast("array<variant>")
    return F.when(F.forall(items, lambda b: F.schema_of_variant(b).startswith("OBJECT")), items)


def _fields(frame: DataFrame, keys: list[str], path: Column, block: Column, code: Column) -> DataFrame:
    own = [F.try_variant_get(block, f"$.{k}", "string").alias(k) for k in _OWN]
    inner = F.try_variant_get(block, "$.content", "variant")
    rows = frame.select(*keys, path.alias("path"), code.alias("code"), *own, inner.alias("_content"), F.to_json(block).alias("json"))
    return rows.withColumn("_inner", array_of(F.col("_content"))).withColumn("content", F.when(F.col("_inner").isNull(), F.col("_content").try_cast("string"))).drop("_content")


def exploded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, code, type, text, name, arguments, content, json, nests) of every block at every depth.

    ``rows`` are (keys, content); content that is no array of blocks is one text block. ``path`` are
    the places from the outermost array inwards, ``code`` says that a block is inside a tool's result, ``nests``
    that it holds other blocks, its content else is a text or null. Null content has no block.
    """
    parsed = rows.select(*keys, "content", F.try_parse_json("content").alias("_v"))
    parsed = parsed.withColumn("_items", array_of(F.col("_v")))
    whole = parsed.where("_items is null and content is not null").select(
        *keys, F.array(F.lit(0)).alias("path"), F.lit(False).alias("code"), F.lit("text").alias("type"), F.col("content").alias("text"), *(F.lit(None).cast("string").alias(k) for k in ("name", "arguments", "content", "json")), F.lit(False).alias("nests")
    )
    first = parsed.where("_items is not null").select(*keys, F.posexplode("_items").alias("_i", "_b"))
    level = _fields(first, keys, F.array("_i"), F.col("_b"), F.lit(False))
    out = whole
    while True:
        level = held(level)
        out = out.unionByName(level.withColumn("nests", F.col("_inner").isNotNull()).drop("_inner"))
        deeper = level.where("_inner is not null").select(*keys, "path", (F.col("code") | F.coalesce(F.col("type") == "tool-result", F.lit(False))).alias("code"), F.posexplode("_inner").alias("_i", "_b"))
        if not level.where("size(_inner) > 0").take(1):
            return out
        level = _fields(deeper, keys, F.concat("path", F.array("_i")), F.col("_b"), F.col("code"))


def texts(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): what the blocks of ``exploded`` say, by line in their order; calls and empty texts are not part of it."""
    own = F.when(F.col("type").isin("text", "reasoning"), F.col("text")).when(F.col("nests"), F.lit(None)).otherwise(F.coalesce("content", "text"))
    call = F.coalesce(F.col("type") == "tool-call", F.lit(False))
    said = F.collect_list(F.when(~call & (F.length(own) > 0), F.struct("path", own.alias("own"))))
    return blocks.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(said), lambda x: x["own"]), "\n").alias("text"))


def prices(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tokens): the calibrated price of a message by the blocks of ``exploded``, each with its overhead.

    Texts inside a tool's result cost as code; blocks of other types cost their JSON, whatever they hold.
    """
    said = lambda c, rate: F.ceil(text_units(F.coalesce(c, F.lit(""))) / rate)
    known = F.col("type").isin("text", "reasoning", "tool-call", "tool-result")
    own = (
        F.when(F.col("type").isin("text", "reasoning"), said(F.col("text"), F.when(F.col("code"), 1.8).otherwise(4.0)))
        .when(F.col("type") == "tool-call", said(F.col("name"), 4.0) + said(F.col("arguments"), 1.8))
        .when(F.col("type") == "tool-result", said(F.col("content"), 1.8) + F.when(F.coalesce(F.length("content"), F.lit(0)) > 0, BLOCK_OVERHEAD).otherwise(0))
        .otherwise(said(F.col("json"), 4.0))
    )
    # What is inside a block that costs its JSON is in that JSON.
    closed = F.collect_list(F.when(~F.coalesce(known, F.lit(False)) & F.col("nests"), F.col("path")))
    shut = blocks.groupBy(*keys).agg(closed.alias("_closed")).where("size(_closed) > 0")
    rows = blocks.join(shut, keys, "left") if keys else blocks
    inside = F.exists("_closed", lambda p: (F.size(p) < F.size("path")) & (F.slice("path", F.lit(1), F.size(p)) == p))
    rows = rows.where(~F.coalesce(inside, F.lit(False)))
    return rows.groupBy(*keys).agg((F.sum(own + BLOCK_OVERHEAD) + MESSAGE_OVERHEAD).cast("long").alias("tokens"))


def flat(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, blocks): the outermost blocks of ``exploded`` with what is nested in each already brought to text, as a log's events hold them."""
    top = [*keys, "_top"]
    marked = blocks.withColumn("_top", F.get("path", 0))
    said = texts(marked.where("size(path) > 1"), top).withColumnRenamed("text", "_said")
    own = marked.where("size(path) = 1").join(said, top, "left")
    one = F.struct("_top", F.struct(*_OWN, F.when(F.col("nests"), F.coalesce("_said", F.lit(""))).otherwise(F.col("content")).alias("content")).alias("b"))
    return own.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["b"]).alias("blocks"))
