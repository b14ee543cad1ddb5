"""Streams with timers give the rows of their batch forms, whatever is replayed."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ctxloom.operators import budget as B
from ctxloom.operators import units as U
from ctxloom.streaming import requests as R


@pytest.fixture(autouse=True)
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    R.state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, folder, batches, schema, transform, name):
    """A file a micro-batch; two rows of another key at the end move the watermark past all timers."""
    os.makedirs(folder)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds("at")).coalesce(1).write.parquet(f"{folder}/b{i:03d}")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/b000").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    q = transform(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}-state").outputMode("append").start()
    q.processAllAvailable()
    progress = q.lastProgress
    q.stop()
    return [tuple(r) for r in spark.table(name).collect()], progress


def dealt(rng, by_key, n):
    """Rows of every key in its order over n batches, later ones with a batch's rows again."""
    out = [[] for _ in range(n)]
    for rows in by_key.values():
        at = sorted(rng.randrange(n) for _ in rows)
        for i, row in zip(at, rows, strict=True):
            out[i].append(row)
    for i in range(1, n):
        if rng.random() < 0.5:
            out[i] = out[i] + out[i - 1]
    for k, b in enumerate(out):
        rng.shuffle(b)
        b[:] = [(*r, 100 + 10 * k) for r in b]
    return [b for b in out if b]


def test_request_guard(spark, tmp_path):
    rng = random.Random(4)
    by_key = {}
    for request in range(40):
        retries, generation, rows = rng.randrange(4), 0, []
        for i in range(rng.randrange(1, 5)):
            rows.append((request, i, rng.choice([1000, 900, 700, 2000]) - 150 * i, generation, 1000, 200, 50, retries, rng.choice([0, 30])))
            generation += rng.choice([0, 1, 1])
        by_key[request] = rows
    schema = "request long, round long, projected long, generation long, target long, most long, margin long, retries long, asked long"
    want = sorted(map(tuple, B.request_guard(spark.createDataFrame([r for v in by_key.values() for r in v], schema)).collect()))
    batches = dealt(rng, by_key, 4)
    end = [(999, i, 1, i, 10, 1, 1, 9, 0, 10**6 + 10**5 * i) for i in range(2)]
    got, progress = run(spark, str(tmp_path / "guard"), [*batches, [end[0]], [end[1]]], schema + ", at long", lambda d: R.request_guard(d, "1 second", 60_000), "guard")
    assert sorted(r for r in got if r[0] != 999) == want
    assert progress.stateOperators[0].numRowsTotal <= 2  # what is done is forgotten


def test_calibrated_loop(spark, tmp_path):
    rng = random.Random(6)
    by_key = {}
    for session in range(40):
        retries = rng.randrange(3)
        by_key[session] = [(session, i, rng.choice([80, 120, 200]), rng.choice([90, 150, 150]), rng.random() < 0.8, 100, retries) for i in range(rng.randrange(1, 5))]
    schema = "session long, attempt long, before long, after long, has_range boolean, threshold long, retries long"
    want = sorted(map(tuple, B.calibrated_loop(spark.createDataFrame([r for v in by_key.values() for r in v], schema)).collect()))
    end = [(999, i, 200, 150, True, 100, 9, 10**6 + 10**5 * i) for i in range(2)]
    got, _ = run(spark, str(tmp_path / "loop"), [*dealt(rng, by_key, 4), [end[0]], [end[1]]], schema + ", at long", lambda d: R.calibrated_loop(d, "1 second", 60_000), "loop")
    assert sorted(r for r in got if r[0] != 999) == want


def test_continuations(spark, tmp_path):
    rng = random.Random(8)
    by_key = {}
    for session in range(25):
        rows, turn = [], 0
        for seq in range(rng.randrange(1, 20)):
            turn += rng.choice([0, 1, 1])
            kind = rng.choice(["max-tokens"] * 5 + ["user", "stop"])
            rows.append((session, seq, kind, rng.choice([None, "continuation"]) if kind == "user" else None, rng.choice([turn, turn, None])))
        by_key[session] = rows
    schema = "session long, event_seq long, kind string, form string, turn long"
    everything = [r for v in by_key.values() for r in v]
    want = sorted(map(tuple, U.continuation_steps(spark.createDataFrame(everything + everything[::3], schema)).collect()))
    got, _ = run(spark, str(tmp_path / "ends"), dealt(rng, by_key, 4), schema + ", at long", lambda d: R.continuations(d, 3, "1 second"), "ends")
    assert sorted(got) == want and any(n == 4 for _, _, n, _ in want)
