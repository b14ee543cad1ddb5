import random

from pyspark.sql import functions as F

from ctxloom.operators import scoring as S
from ctxloom.operators import segments as G
from ctxloom.operators import units as U

MESSAGES = "session long, pos long, seq long, role string, n_calls int, tokens long, text string"


def test_pairing_by_count(spark):
    rows = [(1, 1, 1, "user", 0, 5, "hi"), (1, 2, 2, "assistant", 2, 5, "run"), (1, 3, 3, "tool", 0, 5, "a"), (1, 4, 4, "tool", 0, 5, "b"), (1, 5, 5, "tool", 0, 5, "c"), (1, 6, 6, "assistant", 1, 5, "go"), (1, 7, 7, "user", 0, 5, "stop")]
    got = {r.unit_pos: r for r in U.paired(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert got[2].kind == "tool-pair" and not got[2].open and got[2].tokens == 15 and got[2].text == "run\na\nb"
    assert got[5].kind == "tool-result" and got[6].open and got[7].kind == "user"


def test_pairing_matches_a_sequential_model(spark):
    rng, rows = random.Random(5), []
    for s in range(20):
        for p in range(40):
            role = rng.choice(["user", "assistant", "tool", "tool"])
            rows.append((s, p, p, role, rng.randint(0, 3) if role == "assistant" else 0, rng.randint(0, 50), "x"))
    want = {}
    for s, p, _, role, calls, tokens, _ in rows:
        if p == 0:
            live = None
        if role == "tool" and live and live[2] < live[1]:
            live[2] += 1
            want[live[0]] = (want[live[0]][0], want[live[0]][1] + tokens, live[2] < live[1])
            continue
        if role == "tool":
            want[(s, p)] = ("tool-result", tokens, False)
        else:
            live = [(s, p), calls, 0]
            want[(s, p)] = ("tool-pair" if calls else role, tokens, calls > 0)
    got = {(r.session, r.unit_pos): (r.kind, r.tokens, r.open) for r in U.paired(spark.createDataFrame(rows, MESSAGES).repartition(3)).collect()}
    assert got == want


def test_recent_floor_takes_the_crossing_unit(spark):
    df = spark.createDataFrame([(1, p, p, 10) for p in range(5)], "session long, pos long, first_seq long, tokens long")
    flags = lambda n: [r.in_floor for r in U.with_recent_floor(df, F.lit(n)).orderBy("pos").collect()]
    assert flags(25) == [False, False, True, True, True] and all(flags(1000)) and not any(flags(0))


def test_score_floor_and_pin(spark):
    cell = lambda g: S.unit_score(F.lit(g), F.lit(0.1), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(0.1))
    row = spark.range(1).select(cell("P0").alias("a"), cell("P1").alias("b"), cell("NORMAL").alias("c")).first()
    assert tuple(row) == (1.0, 0.75, 0.0)


def test_hysteresis_holds_down_to_the_lower_threshold(spark):
    df = spark.createDataFrame([(0.75, "HOT"), (0.75, None), (0.5, "WARM"), (0.5, "HOT"), (0.1, "HOT")], "s double, b string")
    assert [r.t for r in df.select(S.tier(F.col("s"), F.lit("NORMAL"), F.col("b")).alias("t")).collect()] == ["HOT", "WARM", "WARM", "COLD", "TRASH"]


def test_zones(spark):
    df = spark.createDataFrame([(0.54, 0.9), (0.55, 0.9), (0.68, 0.9), (0.78, 0.9), (0.88, 0.9), (0.94, 0.9), (0.1, 1.0)], "soft double, hard double")
    assert [r.z for r in df.select(G.zone(F.col("soft"), F.col("hard")).alias("z")).collect()] == ["Z0", "Z1", "Z2", "Z3", "Z4", "Z5", "Z5"]


def test_gauges_without_a_window_are_null(spark):
    assert spark.range(1).select(G.gauges(F.lit(0), F.lit(10)).alias("g")).first().g is None


def test_duplicates_compare_with_the_last_that_is_no_repeat(spark):
    rows = [(1, 1, "tool-pair", "a\nb"), (1, 2, "tool-pair", "a\nb"), (1, 3, "tool-pair", "a\nc"), (1, 4, "user", "a\nd")]
    got = S.with_duplication(spark.createDataFrame(rows, "session long, pos long, kind string, text string"), F.lit("k")).orderBy("pos").collect()
    assert [r.duplication for r in got] == [0.0, 1.0, 0.5 / 3, 0.0]


def test_operators_do_not_depend_on_partitioning(spark):
    rows = [(s, p, p, 100 * p % 700, p % 10 / 10, "NORMAL", p % 3 > 0, "Z5", 10) for s in range(3) for p in range(30)]
    df = spark.createDataFrame(rows, "session long, pos long, first_seq long, tokens long, score double, protection string, eligible boolean, zone string, min_reclaim long").withColumn("last_seq", F.col("first_seq"))
    assert sorted(G.segments(df.repartition(7)).collect()) == sorted(G.segments(df.coalesce(1)).collect())
