"""Session logs: projection of events to messages, deltas from a cursor, evidence handles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ctxloom.functions import patterns as P
from ctxloom.functions.text import trim
from ctxloom.sources import blocks

#: A message's blocks, what is nested in them already brought to text.
BLOCK = "struct<type:string,text:string,name:string,arguments:string,content:string>"
EVENTS = f"session string, seq long, ts timestamp, type string, role string, blocks array<{BLOCK}>, source struct<kind:string,form:string,plugin:string>, source_event_seqs array<long>"
DELTA_CAP = 160000


def block_text(held: Column) -> Column:
    """Texts of text, reasoning, result and other blocks by line; calls and empty ones are not part of it."""
    said = F.transform(F.filter(held, lambda b: b["type"] != "tool-call"), lambda b: F.when(b["type"] == "tool-result", b["content"]).when(b["type"].isin("text", "reasoning"), b["text"]).otherwise(F.coalesce(b["content"], b["text"])))
    return F.array_join(F.filter(said, lambda t: F.coalesce(F.length(t), F.lit(0)) > 0), "\n")


#: Blocks inside blocks are brought to text in one expression down to this depth, deeper ones level by level.
DEPTH = 4


def flat_blocks(content: Column, depth: int = DEPTH) -> Column:
    """The ``blocks`` of a message's content: plain text, or JSON blocks whose content nests ``depth`` deep."""
    said = lambda b, k: F.try_variant_get(b, f"$.{k}", "string")

    def text_of(value: Column, left: int) -> Column:
        if not left:
            return value.try_cast("string")
        part = lambda b: F.coalesce(F.when(said(b, "type").isin("text", "reasoning"), said(b, "text")), text_of(F.try_variant_get(b, "$.content", "variant"), left - 1), said(b, "text"))
        items = blocks.array_of(value)
        return F.when(items.isNotNull(), F.array_join(F.filter(F.transform(items, part), lambda t: F.coalesce(F.length(t), F.lit(0)) > 0), "\n")).otherwise(value.try_cast("string"))

    one = lambda b: F.struct(*(said(b, k).alias(k) for k in ("type", "text", "name", "arguments")), text_of(F.try_variant_get(b, "$.content", "variant"), depth).alias("content"))
    items = blocks.array_of(F.try_parse_json(content))
    whole = F.struct(F.lit("text").alias("type"), content.alias("text"), *(F.lit(None).cast("string").alias(k) for k in ("name", "arguments", "content")))
    return F.when(items.isNotNull(), F.transform(items, one)).when(content.isNotNull(), F.array(whole))


RAW = "type string, seq long, time long, data struct<role:string,content:string,source:struct<kind:string,form:string,plugin:string>,sourceEventSeqs:array<long>,message:struct<role:string,content:string,source:struct<kind:string,form:string,plugin:string>>>, source struct<kind:string,form:string,plugin:string>, sourceEventSeqs array<long>"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of session logs in JSON lines, ``path``/<session>.jsonl; broken lines are left out."""
    raw = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl\z", 1).alias("session"), F.from_json("value", RAW).alias("e")).where("e.type is not null")
    content = F.coalesce("e.data.message.content", "e.data.content")
    log = raw.select(
        "session", "e.seq", F.timestamp_millis("e.time").alias("ts"), "e.type", F.coalesce("e.data.message.role", "e.data.role").alias("role"), content.alias("content"),
        F.coalesce("e.data.message.source", "e.data.source", "e.source").alias("source"), F.coalesce("e.sourceEventSeqs", "e.data.sourceEventSeqs").alias("source_event_seqs"),
    )
    return with_blocks(log, ["session", "seq"])


def with_blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with their ``content`` as ``blocks``, whatever is nested in it; ``keys`` name a row.

    One that may nest deeper than ``DEPTH`` (it spells ``"content"`` more often) is unfolded level by level.
    """
    deep = F.coalesce(F.regexp_count("content", F.lit('"content"')) > DEPTH, F.lit(False))
    shallow = rows.where(~deep).withColumn("blocks", flat_blocks(F.col("content"))).drop("content")
    rest = rows.where(deep)
    if not rest.take(1):
        return shallow
    found = blocks.flat(blocks.exploded(rest.select(*keys, "content"), keys), keys)
    return shallow.unionByName(rest.drop("content").join(found, keys, "left").withColumn("blocks", F.coalesce("blocks", F.array().cast(f"array<{BLOCK}>"))))


def resolved(events: DataFrame, session: str) -> DataFrame:
    """The log of one session by its exact id, never another's; an error if there is none."""
    found = events.where(F.col("session") == session)
    if not found.take(1):
        raise LookupError(f"no session {session}")
    return found


def calls(held: Column) -> Column:
    return F.transform(F.filter(held, lambda b: b["type"] == "tool-call"), lambda b: F.struct(b["name"].alias("name"), b["arguments"].alias("arguments")))


def messages(events: DataFrame) -> DataFrame:
    """Events of the three message types with role, text, calls and what they are; others go."""
    role = F.when(F.col("type") == "user/message", "user").when(F.col("type") == "assistant/message", "assistant").when(F.col("type") == "tool/result", "tool")
    compaction = (F.col("source.kind") == "compaction") | ((F.col("source.kind") == "plugin") & (F.col("source.form") == "compaction"))
    checkpoint = F.coalesce((role == "user") & ((F.size("source_event_seqs") > 0) | compaction), F.lit(False))
    framed = trim(block_text(F.col("blocks"))).rlike(P.FRAMING)
    injected = (role == "user") & ~checkpoint & (F.coalesce(F.col("source.kind") != "user", F.lit(False)) | F.coalesce(framed, F.lit(False)))
    first = F.get(calls(F.col("blocks")), 0)
    return events.where(role.isNotNull()).select(
        "session", "seq", "ts", role.alias("role"), block_text(F.col("blocks")).alias("text"), F.greatest(F.size(calls(F.col("blocks"))), F.lit(0)).alias("n_calls"), first["name"].alias("tool"), F.array_join(F.transform(calls(F.col("blocks")), lambda c: c["arguments"]), "\n").alias("tool_args"), checkpoint.alias("checkpoint"), injected.alias("injected"), "source_event_seqs"
    )


def on_surface(surface: DataFrame, found: DataFrame, prices: DataFrame) -> DataFrame:
    """Messages at their surface positions with their prices; missing nodes go, missing prices are 0."""
    out = surface.select("session", "pos", "seq").join(found, ["session", "seq"]).join(prices.select("session", "seq", F.col("tokens").alias("_tokens")), ["session", "seq"], "left")
    return out.withColumn("tokens", F.coalesce("_tokens", F.lit(0)).cast("long")).drop("_tokens")


def delta(rows: DataFrame, cursor: Column) -> DataFrame:
    return rows.where((F.col("pos") >= cursor) & (F.col("text") != ""))


def delta_text(rows: DataFrame, cursor: Column) -> DataFrame:
    """By session, the messages from a cursor on, each under its role; the last 160,000 characters."""
    said = F.struct("pos", F.concat(F.lit("["), F.col("role"), F.lit("]\n"), F.col("text")).alias("said"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(said)), lambda x: x["said"]), "\n\n")
    return delta(rows, cursor).groupBy("session").agg(F.right(joined, F.lit(DELTA_CAP)).alias("delta"))


def handles(rows: DataFrame, cursor: Column) -> DataFrame:
    """Evidence handles E1, E2, ... of the rows from a cursor on."""
    nth = F.row_number().over(Window.partitionBy("session").orderBy("pos"))
    return delta(rows, cursor).withColumn("handle", F.concat(F.lit("E"), nth))
