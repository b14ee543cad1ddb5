import os

from pyspark.sql import functions as F

from ctxloom.operators import units as U
from ctxloom.streaming import state


def run(spark, tmp_path, batches, schema, transform, name, mode="append"):
    path = str(tmp_path / name)
    os.makedirs(path)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/b{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    q = transform(stream).writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_cursor_never_goes_back(spark, tmp_path):
    got = run(spark, tmp_path, [[(1, 1, "a"), (1, 2, "b")], [(1, 2, "b"), (1, 3, "c")]], "session long, seq long, text string", state.cursor, "cursor")
    assert sorted(r.seq for r in got.collect()) == [1, 2, 3]


def test_history_ring_equals_the_batch_operator(spark, tmp_path):
    rows = [(1, s, t) for s, t in enumerate([5, 5, 6, 7, 7, 8, 9])]
    got = run(spark, tmp_path, [rows], "session long, seq long, t long", lambda d: state.history(d, 3), "ring", "update").collect()
    batch = U.in_ring(spark.createDataFrame(rows, "session long, pos long, t long"), 3)
    assert got[-1].seqs == [r.pos for r in batch.orderBy("pos").collect()]


def test_watermarked_counts(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{i}:00", "click", 1.0) for i in range(8)] + [("2024-01-01 03:00:00", "click", 1.0)]
    frame = lambda d: state.counts_by_window(d.withColumn("ts", F.to_timestamp("ts")))
    got = run(spark, tmp_path, [rows, [("2024-01-01 03:01:00", "click", 1.0)]], "ts string, event_type string, value double", frame, "windows").collect()
    assert sum(r.n for r in got) == 8


def test_capabilities_are_held_for_a_while(spark, tmp_path):
    rows = [[(1, 1, 0, 100), (1, 2, 5_000, 200)], [(1, 3, 15_000, None), (1, 4, 16_000, 300), (2, 1, 0, None)]]
    got = run(spark, tmp_path, rows, "session long, seq long, at_ms long, window long", state.cached_capabilities, "caps")
    assert {(r.session, r.seq): (r.window, r.how) for r in got.collect()} == {(1, 1): (100, "fetched"), (1, 2): (100, "cached"), (1, 3): (100, "stale"), (1, 4): (300, "fetched"), (2, 1): (None, "none")}
