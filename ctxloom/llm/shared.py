"""Shared-folder helpers: every intermediate table lives where all executors can read it."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Bounds of what a Python worker gets at once and of the rows that a Parquet reader holds.
BATCH_BYTES, READER_ROWS = 3 << 20, 1024
_BOUNDS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES), "spark.sql.parquet.columnarReaderBatchSize": str(READER_ROWS)}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is made in local mode only (there driver
    and tasks are one process); on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        found = spark.sparkContext.getCheckpointDir()
        if found is None:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="ctxloom-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path under the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/ctxloom/{tag}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside hand rows to Python workers by bytes, not only by number."""
    before = {k: spark.conf.get(k, None) for k in _BOUNDS}
    for k, v in _BOUNDS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def table(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and reread it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    with bounded_batches(spark):
        df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now.

    It does so when the driver collects what refers to them, which else may be long after the
    disk is full. What a job leaves behind takes two rounds: its plan, then what the plan held.
    """
    gc.collect()
    for _ in range(2):
        spark.sparkContext._jvm.java.lang.System.gc()
        time.sleep(0.2)


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a frame made by ``table`` once nothing needs them any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
