"""Driver tables as session logs, units and ledgers, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ctxloom.operators.spread import ROWS, spread, tasks_for
from ctxloom.operators.units import with_recent_floor


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages: a user's events are a session."""
    role = F.expr("CASE event_type WHEN 'click' THEN 'user' WHEN 'view' THEN 'assistant' WHEN 'signup' THEN 'assistant' ELSE 'tool' END")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return _read(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"), pos.alias("pos"), F.col("event_id").alias("seq"), role.alias("role"), F.expr("CASE WHEN event_type = 'view' THEN 1 + event_id % 2 ELSE 0 END").alias("n_calls"), F.expr("10 + event_id % 400").alias("tokens"), F.col("event_type").alias("text"), "ts", "event_type", "value"
    )


EVENT_MESSAGES = """m AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_id AS seq,
 CASE event_type WHEN 'click' THEN 'user' WHEN 'view' THEN 'assistant' WHEN 'signup' THEN 'assistant' ELSE 'tool' END AS role,
 CASE WHEN event_type = 'view' THEN 1 + event_id % 2 ELSE 0 END AS n_calls, 10 + event_id % 400 AS tokens, event_type AS text, ts, event_type, value FROM events)"""

#: Text of a unit by event, hitting one rule each.
EVENT_TEXT = """CASE event_type
 WHEN 'click' THEN CASE event_id % 4 WHEN 0 THEN 'Do not change user ' || user_id WHEN 1 THEN 'actually, use plan ' || user_id WHEN 2 THEN 'Goal: keep user ' || user_id ELSE 'backward-compat matters for user ' || user_id END
 WHEN 'purchase' THEN CASE event_id % 2 WHEN 0 THEN 'decided to use v1.' || event_id ELSE 'fixed the parser in v1.' || event_id END
 WHEN 'signup' THEN CASE event_id % 2 WHEN 0 THEN 'all tests pass' ELSE 'hello' END
 WHEN 'error' THEN 'root cause: E_TIMEOUT exit code: 1'
 ELSE 'reading /srv/app/config.yaml' END"""
EVENT_KIND = "CASE event_type WHEN 'click' THEN 'user' WHEN 'purchase' THEN 'assistant' WHEN 'signup' THEN 'assistant' ELSE 'tool-pair' END"


def event_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as units with telling texts."""
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("pos"), F.expr(EVENT_KIND).alias("kind"), F.expr(EVENT_TEXT).alias("text"), (F.col("event_id") % 50 == 0).alias("open"), F.expr("CASE event_id % 5 WHEN 0 THEN 'read' WHEN 1 THEN 'grep' WHEN 2 THEN 'pwsh' ELSE NULL END").alias("tool"), "ts", "value", "event_type")


EVENT_UNITS = f"u AS (SELECT user_id AS session, event_id AS pos, {EVENT_KIND} AS kind, {EVENT_TEXT} AS text, event_id % 50 = 0 AS open, CASE event_id % 5 WHEN 0 THEN 'read' WHEN 1 THEN 'grep' WHEN 2 THEN 'pwsh' ELSE NULL END AS tool, ts, value, event_type FROM events)"

_ORDER = {
    "tokens": "CAST(floor(o_totalprice / 100) AS BIGINT) % 3000",
    "score": "((o_orderkey * 37) % 1000) / 1000.0",
    "protection": "CASE WHEN o_orderkey % 17 = 0 THEN 'P0' WHEN o_orderkey % 29 = 0 THEN 'P0_TRANSIENT' WHEN o_orderkey % 11 = 0 THEN 'P1' ELSE 'NORMAL' END",
    "before": "CASE o_orderstatus WHEN 'F' THEN 'HOT' WHEN 'O' THEN 'WARM' ELSE NULL END",
}


#: Tokens of a session that are too new to touch.
FLOOR = 3000


def order_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scored units: a customer is a session, its newest orders are in the floor."""
    made = [F.expr(v.replace("1000.0", "1000D")).alias(k) for k, v in _ORDER.items()]
    return _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").alias("first_seq"), F.col("o_orderkey").alias("last_seq"), *made, F.expr("concat('Z', o_custkey % 6)").alias("zone")).transform(with_recent_floor, F.lit(FLOOR))


ORDER_UNITS = (
    "o0 AS (SELECT o_custkey AS session, o_orderkey AS pos, " + ", ".join(f"{v.replace('1000.0', '1000.0::DOUBLE')} AS {k}" for k, v in _ORDER.items()) + ", 'Z' || (o_custkey % 6) AS zone FROM orders),\n"
    "o1 AS (SELECT *, sum(tokens) OVER (PARTITION BY session ORDER BY pos DESC) AS cum FROM o0),\n"
    f"o AS (SELECT * EXCLUDE (cum), pos >= coalesce(max(pos) FILTER (cum >= {FLOOR}) OVER (PARTITION BY session), min(pos) OVER (PARTITION BY session)) AS in_floor FROM o1)"
)

TIER = "CASE WHEN protection IN ('P0', 'P0_TRANSIENT') THEN 'PINNED' WHEN score >= 0.82 OR (before = 'HOT' AND score >= 0.70) THEN 'HOT' WHEN score >= 0.58 OR (before = 'WARM' AND score >= 0.48) THEN 'WARM' WHEN score >= 0.28 THEN 'COLD' ELSE 'TRASH' END"
ALLOWED = "((zone IN ('Z2', 'Z3', 'Z4', 'Z5') AND tier IN ('TRASH', 'COLD')) OR (zone IN ('Z3', 'Z4', 'Z5') AND tier = 'WARM') OR (zone = 'Z5' AND tier = 'HOT'))"
ELIGIBLE = f"(protection NOT IN ('P0', 'P0_TRANSIENT') AND NOT in_floor AND {ALLOWED} AND (protection <> 'P1' OR zone IN ('Z4', 'Z5')))"


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ctxloom.functions.text import flat_tokens

    return _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), F.col("turn").alias("first_seq"), "role", "text", flat_tokens(F.col("text")).alias("tokens"))


CONVERSATION_MESSAGES = "c AS (SELECT conv_id AS session, turn AS pos, role, text, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM conversations)"


_LINES = [
    "concat('## [DEC-', o_orderkey, '] ', o_orderpriority)",
    "concat('- confidence: 0.', o_orderkey % 10)",
    "concat('- status: ', CASE o_orderstatus WHEN 'F' THEN 'ACTIVE' WHEN 'O' THEN 'SUPERSEDED' ELSE 'STALE' END)",
    "concat('- see DEC-', o_orderkey - 1)",
    "concat('- source: total ', CAST(floor(o_totalprice) AS BIGINT), ' for order ', o_orderkey)",
]


def ledger_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as decision entries of five lines; a file for each two hundred orders."""
    return _lines_of(_of_files(spark, sf_dir))


def dealt_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """``ledger_lines`` dealt by file, and to how many tasks.

    Orders are dealt, then written out as lines: what a task of the scan sorts for the exchange is a row an order, not
    five that are as wide, and no line is made to be counted.
    """
    orders = _of_files(spark, sf_dir)
    tasks = tasks_for(orders, ROWS // len(_LINES))
    return _lines_of(spread(orders, "file", tasks=tasks)), tasks


def _of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select(F.expr("concat('DECISIONS-', o_orderkey div 200)").alias("file"), "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")


def _lines_of(orders: DataFrame) -> DataFrame:
    made = orders.select("file", "o_orderkey", F.posexplode(F.array(*(F.expr(x) for x in _LINES))).alias("i", "text"))
    return made.select("file", (F.col("o_orderkey") * 5 + F.col("i")).alias("line_no"), "text")


LEDGER = """l AS (SELECT 'DECISIONS-' || (o_orderkey // 200) AS file, o_orderkey * 5 AS place, 'DEC-' || o_orderkey AS id, o_orderkey AS key, o_orderpriority AS title, CAST('0.' || (o_orderkey % 10) AS DOUBLE) AS confidence,
 CASE o_orderstatus WHEN 'F' THEN 'ACTIVE' WHEN 'O' THEN 'SUPERSEDED' ELSE 'STALE' END AS status, 'see DEC-' || (o_orderkey - 1) AS fact, 'total ' || CAST(floor(o_totalprice) AS BIGINT) || ' for order ' || o_orderkey AS source, o_totalprice, o_custkey FROM orders)"""

_OP = "CASE o_orderkey % 8 WHEN 0 THEN 'add' WHEN 1 THEN 'Supersede' WHEN 2 THEN 'AMEND' WHEN 3 THEN 'conflict' WHEN 4 THEN 'resolve conflict' WHEN 5 THEN 'noop' WHEN 6 THEN 'explode' ELSE 'update-state' END"
_BODY = "CASE WHEN o_orderkey % 8 = 7 THEN concat('state at ', o_orderkey, chr(10), 'next') WHEN o_orderkey % 5 = 0 THEN concat('limit ', o_orderkey, '77 ms') WHEN o_orderkey % 5 = 1 THEN concat('about order ', o_orderkey) ELSE 'no numbers here' END"
_QUOTE = "concat('total ', CAST(floor(o_totalprice) AS BIGINT), ' for order ', o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '9' ELSE '' END)"


def ledger_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as operations of all kinds on the ledger entry before them; every ninth quote is wrong."""
    key, op = F.col("o_orderkey"), F.col("o_orderkey") % 8
    of = lambda *kinds: op.isin(*kinds)
    said = F.expr(_QUOTE)
    kind = F.when(key % 16 == 1, "Requirement").otherwise("decision")
    instead = F.struct(kind.alias("kind"), F.concat(F.lit("instead "), key).alias("title"), F.expr(_BODY).alias("body"), F.lit(0.95).alias("confidence"), F.lit("").alias("source_ref"), said.alias("source_quote"))
    return _read(spark, sf_dir, "orders").select(
        F.expr("o_orderkey div 100").alias("batch"), key.alias("idx"), F.expr(_OP).alias("op"), F.lit(" Decision").alias("kind"), F.concat(F.lit("order "), key).alias("title"), F.expr(_BODY).alias("body"),
        F.concat(F.lit("DEC-"), key - 1).alias("target_id"), F.concat(F.lit("topic "), key).alias("topic"), F.concat(F.lit("settled "), key).alias("resolution"), F.lit(None).cast("double").alias("confidence"), F.lit("").alias("source_ref"),
        F.when(~of(1, 7), said).alias("source_quote"), F.when(key % 3 == 0, F.expr("concat('TX-', o_orderkey div 10)")).alias("grp"), F.when(of(1), instead).alias("replacement"),
    )


def ledger_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log rows that quotes stand in."""
    return _read(spark, sf_dir, "orders").select(F.expr("o_orderkey div 100").alias("batch"), F.col("o_orderkey").alias("seq"), F.expr("concat('we saw total ', CAST(floor(o_totalprice) AS BIGINT), ' for order ', o_orderkey, ' today')").alias("text"))


#: Benchmark items as ledger entries of three files.
ITEMS = """i AS (SELECT CASE item_id % 3 WHEN 0 THEN 'DECISIONS.md' WHEN 1 THEN 'TECH.md' ELSE 'PROJECT.md' END AS file, item_id AS place,
 CASE item_id % 3 WHEN 0 THEN 'DEC-' WHEN 1 THEN 'TECH-' ELSE 'REQ-' END || lpad(CAST(item_id AS VARCHAR), 3, '0') AS id, array_to_string(string_split(text, ' ')[1:3], ' ') AS title,
 CASE WHEN item_id % 5 = 4 THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS status, text AS body FROM benchmark),
x AS (SELECT *, '## [' || id || '] ' || title || chr(10) || '- status: ' || status || chr(10) || '- ' || body AS raw FROM i)"""


def item_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _read(spark, sf_dir, "benchmark").select(
        F.expr("CASE item_id % 3 WHEN 0 THEN 'DECISIONS.md' WHEN 1 THEN 'TECH.md' ELSE 'PROJECT.md' END").alias("file"), F.col("item_id").alias("place"), F.expr("concat(CASE item_id % 3 WHEN 0 THEN 'DEC-' WHEN 1 THEN 'TECH-' ELSE 'REQ-' END, lpad(cast(item_id as string), 3, '0'))").alias("id"),
        F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("title"), F.expr("CASE WHEN item_id % 5 = 4 THEN 'SUPERSEDED' ELSE 'ACTIVE' END").alias("status"), F.col("text").alias("body"),
    )
    return i.withColumn("raw", F.concat(F.lit("## ["), "id", F.lit("] "), "title", F.lit("\n- status: "), "status", F.lit("\n- "), "body"))
