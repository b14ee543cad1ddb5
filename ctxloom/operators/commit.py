"""Sinks of a ledger sync: changed files, then the commit row with its audit lines.

A commit is written in three steps: its files into a folder of its own, its record under a
name that no reader looks at, and then that record is given the name of its revision. The last step
alone makes it visible; it fails if the name is taken, so of two writers one is first, and a crash
at any step leaves the state before or after, never between. The batch is planned once more on a
fresh base when another writer was first, and only once.

The last step is a hard link on local file systems, whose rename would overwrite, and a rename
without overwriting on all others, where it is one atomic step (HDFS and what behaves like it; not plain
object stores). A record that can't be read, as a writer without these steps may leave one, uses up its number and counts
for nothing: its batch may be applied again under the next. What crashed writers leave behind is
removed by ``vacuum``.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "batch long, files string, lines array<string>"


class RevisionConflict(RuntimeError):
    """Another commit came first, twice."""


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose content isn't what it was; the others stay byte for byte."""
    old = before.select("file", F.col("content").alias("_old"))
    return after.join(old, "file", "left").where(~F.col("content").eqNullSafe(F.col("_old"))).drop("_old")


def audit_line(ops: DataFrame) -> DataFrame:
    """(batch, line): what was applied, and what was rejected for which reason."""
    told = F.array_join(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.concat_ws(" ", F.concat(F.lit("#"), F.col("idx")), "reason")))), ", ")
    got = ops.groupBy("batch").agg(F.count_if(F.col("reason").isNull()).alias("n"), told.alias("told"))
    return got.select("batch", F.concat(F.lit("- ["), "batch", F.lit("] applied "), "n", F.when(F.col("told") != "", F.concat(F.lit("; rejected "), "told")).otherwise("")).alias("line"))


def revision(spark: SparkSession, folder: str) -> int:
    """The newest revision under a folder; 0 for none."""
    return max((int(n[1:]) for n in _names(spark, folder)), default=0)


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, folder: str) -> list:
    path, fs = _path(spark, folder)
    return list(fs.listStatus(path)) if fs.exists(path) else []


def _names(spark: SparkSession, folder: str) -> list[str]:
    return [n for s in _listed(spark, f"{folder}/commits") if (n := s.getPath().getName())[:1] == "r" and n[1:].isdigit()]


def _staged(spark: SparkSession, folder: str, record: dict) -> str:
    """Write a record under a hidden name, whole, and return that name."""
    name = f"{folder}/commits/.staged-{uuid.uuid4().hex}"
    path, fs = _path(spark, name)
    out = fs.create(path, False)
    out.write(bytearray(json.dumps(record).encode()))
    out.close()
    return name


def _named(spark: SparkSession, staged: str, name: str) -> bool:
    """Give a staged record its name in one step; false if the name is taken."""
    source, fs = _path(spark, staged)
    target, _ = _path(spark, name)
    if fs.getUri().getScheme() == "file":
        local = lambda p: fs.makeQualified(p).toUri().getPath()
        try:
            os.link(local(source), local(target))
        except FileExistsError:
            return False
        return True
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(source, target, options)
    except Exception as error:  # the file system's own kind of "exists"
        if fs.exists(target) and fs.exists(source):
            return False
        raise error
    return True


def _claim(spark: SparkSession, folder: str, new: int, batch: int, lines: list[str], files: str | None = None) -> bool:
    """Make a revision visible, whole or not at all; false if it is there already."""
    staged = _staged(spark, folder, {"batch": batch, "files": files, "lines": lines})
    won = _named(spark, staged, f"{folder}/commits/r{new:08d}")
    path, fs = _path(spark, staged)
    fs.delete(path, False)
    return won


def records(spark: SparkSession, folder: str) -> DataFrame:
    """(revision, batch, files, lines) of all commits that can be read; ``files`` is the folder under ``files``."""
    if not _names(spark, folder):
        return spark.createDataFrame([], f"revision long, {RECORD}")
    read = spark.read.text(f"{folder}/commits/r*", wholetext=True)
    return read.select(F.regexp_extract(F.input_file_name(), r"r(\d+)\z", 1).cast("long").alias("revision"), F.from_json("value", RECORD).alias("c")).where("c.batch is not null").select("revision", "c.*")


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """(revision, batch, line): what each commit did, a row for each audit line."""
    return records(spark, folder).select("revision", "batch", F.explode_outer("lines").alias("line"))


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """(file, content) as of the newest commit: of each file what the last commit that changed it wrote."""
    done = [(r["revision"], r["files"]) for r in records(spark, folder).where("files is not null").select("revision", "files").collect()]  # a row a commit
    if not done:
        return None
    named = spark.createDataFrame(done, "revision long, _folder string")
    read = spark.read.parquet(*(f"{folder}/files/{name}" for _, name in done)).withColumn("_folder", F.regexp_extract(F.input_file_name(), r"/files/([^/]+)/", 1))
    return read.join(F.broadcast(named), "_folder").groupBy("file").agg(F.max_by("content", "revision").alias("content"))


def vacuum(spark: SparkSession, folder: str, older_ms: int = 24 * 3600 * 1000) -> int:
    """Remove what crashed or beaten writers left: staged records and folders of files that no commit names, of that age."""
    import time

    used = {r["files"] for r in records(spark, folder).select("files").collect()}
    gone = 0
    for s in [*_listed(spark, f"{folder}/commits"), *_listed(spark, f"{folder}/files")]:
        name = s.getPath().getName()
        loose = name.startswith(".staged-") or ("/files/" in s.getPath().toString() and name not in used)
        if loose and s.getModificationTime() < time.time() * 1000 - older_ms:
            s.getPath().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(s.getPath(), True)
            gone += 1
    return gone


def commit(spark: SparkSession, folder: str, batch: int, plan: Callable[[int], tuple[DataFrame, DataFrame]]) -> int:
    """Write what ``plan(revision)`` returns (changed files, audit lines); returns the new revision.

    A batch that was committed already is left alone, so a stream may repeat it. Audit lines
    are a line by batch.
    """
    for _ in range(2):
        base = revision(spark, folder)
        if base and (done := records(spark, folder).where(F.col("batch") == batch).agg(F.max("revision")).first()[0]):
            return done
        files, lines = plan(base)
        name = f"b{batch}-{uuid.uuid4().hex}"  # no other writer's, even of the same batch
        files.write.parquet(f"{folder}/files/{name}")
        told = [r["line"] for r in lines.where(F.col("batch") == batch).select("line").collect()]
        if _claim(spark, folder, base + 1, batch, told, name):
            return base + 1
    raise RevisionConflict(folder)
