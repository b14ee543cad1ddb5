from pyspark.sql import functions as F

from ctxloom.functions import patterns as P
from ctxloom.functions import text as T


def one(spark, value, expr, **more):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


def test_fingerprint_ignores_volatile_parts(spark):
    a = one(spark, "Done at 2026-01-02T03:04:05Z  req-id=abc ptr 0xff", T.fingerprint)
    assert a == one(spark, "done AT 2025-11-12t13:14:15.5 reqid: zz ptr 0x1a", T.fingerprint)
    assert len(a) == 16 and a != one(spark, "failed at noon", T.fingerprint)


def test_lines_and_overlap(spark):
    assert one(spark, " a \r\n\n b\n", T.lines) == ["a", "b"]
    row = spark.range(1).select(T.overlap(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))).alias("x"), T.overlap(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("y"), T.overlap(F.array(F.lit("a")), F.array().cast("array<string>")).alias("z")).first()
    assert (row.x, row.y, row.z) == (0.5, 1.0, 0.0)


def test_term_lanes_use_ascii_boundaries(spark):
    t = one(spark, "see DEC-12, STATE-CURRENT and ./lib/a.js, /srv/app/x.yaml, v1.2.3-rc., qwen-3b at :8080 éBUILD_FAILED 404", T.terms)
    assert t.ids == ["dec-12"] and "/srv/app/x.yaml" in t.paths and "./lib/a.js" in t.paths
    assert "v1.2.3-rc" in t.versions and "qwen-3b" in t.models
    assert {"build_failed", "404", "8080"} <= set(t.errors)


def test_exact_facts_and_atoms(spark):
    facts = one(spark, "took 52.31 tok/s, exit code 3, `npm run x`, 10.0.0.1", T.exact_facts)
    assert {"52.31 tok/s", "exit code 3", "npm run x", "10.0.0.1"} <= set(facts)
    assert "52.31 tok/s" in one(spark, "At 52.31  tok/s", T.exact_atoms)


def test_greeting(spark):
    assert one(spark, " Hello ", T.is_greeting) and one(spark, "继续", T.is_greeting)
    assert not one(spark, "hello v2", T.is_greeting) and not one(spark, "explain", T.is_greeting)


def test_prices(spark):
    assert one(spark, "abcde", T.estimated_tokens) == 2 and one(spark, "中文ab", T.estimated_tokens) == 3
    assert one(spark, "a" * 18, lambda t: T.calibrated_tokens(t, F.lit(True))) == 14


def test_symbols_end_at_word_letters(spark):
    assert one(spark, "Foo$$$ bar_baz the whale x9", T.symbols) == ["Foo", "bar_baz", "whale"]


def test_half_up(spark):
    assert spark.range(1).select(T.half_up(F.lit(1.005), 2).alias("x")).first().x == 1.0


def test_route_key_parity(spark):
    df = spark.createDataFrame([("openrouter", "tiny"), ("mistral", "small"), ("a/b", "c")], "p string, m string")
    assert [r.x for r in df.select(T.route_key(F.col("p"), F.col("m")).alias("x")).collect()] == ["openrouter/tiny", "mistral/small", ""]
    assert [r.x for r in df.select(T.route_key(F.col("p"), F.col("m"), True).alias("x")).collect()] == ["openrouter/tiny", "", ""]


def test_content_type_table():
    assert len(P.CONTENT_TYPES) == 23 and P.CONTENT_TYPES["hard-constraint"][1] is None


def test_first_spelling_wins(spark):
    row = spark.range(1).select(T.spelled_once(F.array(*map(F.lit, ["B", "a", "b", "A", "c"]))).alias("x"), T.extracted(F.lit("see DEC-1 dec-1 `make it` 3 MS at 10.0.0.1:8080, gpt-4o")).alias("e")).first()
    assert row.x == ["B", "a", "c"] and row.e.commands == ["`make it`"] and row.e.ports == ["8080"] and row.e.ips == ["10.0.0.1"] and row.e.models == ["dec-1", "gpt-4o"] and "3 MS" in row.e.numbers and row.e.ids == ["DEC-1"]


def test_pointers_and_what_a_viewer_shows(spark):
    row = spark.range(1).select(T.persistent_pointer(F.array(F.lit("b"), F.lit("a"), F.lit("b"), F.lit(""))).alias("p"), T.persistent_pointer(F.array().cast("array<string>")).alias("q"), T.shown(F.lit("x" * 50), 40).alias("s"), T.share(F.lit(0.1234)).alias("h"), T.bytes_shown(F.lit(1536)).alias("b")).first()
    assert tuple(row) == ("Persistent details:\nb\na", "", "x" * 40 + "\n… (10 more characters)", "12.3%", "1.5 KB")


def test_whole_numbers_only(spark):
    df = spark.createDataFrame([("12",), ("1.5",), ("9007199254740993",), ("-1",), ("x",), (" 7 ",), (None,)], "t string")
    assert [r.n for r in df.select(T.positive_integer(F.col("t")).alias("n")).collect()] == [12, None, None, None, None, 7, None]


def test_overflow_messages(spark):
    said = ["context length exceeded", "maximum context length is 5", "request exceeds its context", "context of any length", "prompt is too long", None]
    df = spark.createDataFrame([(s,) for s in said], "t string")
    assert [r.o for r in df.select(T.is_overflow_message(F.col("t")).alias("o")).collect()] == [True, True, True, False, False, False]


def test_message_prices(spark):
    blocks = [("text", "a" * 9, None, None, None), ("tool-call", None, "read", "x" * 18, None), ("tool-result", None, None, None, "y" * 18), ("tool-result", None, None, None, None)]
    df = spark.createDataFrame([(blocks,)], "b array<struct<type:string,text:string,name:string,arguments:string,content:string>>")
    assert df.select(T.priced_message(F.col("b")).alias("n")).first().n == (3 + 4) + (1 + 10 + 4) + (10 + 4 + 4) + 4 + 4
    wide = spark.createDataFrame([("漢字，",)], "t string").select(T.text_units(F.col("t")).alias("n")).first().n
    assert wide == 8
