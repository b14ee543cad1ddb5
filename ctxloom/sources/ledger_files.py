"""Ledger folders and their JSON sidecars as frames, tolerant of what is missing or broken."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files of a ledger with what stands for one that is missing.
TEMPLATES = {
    "INDEX.md": "# INDEX\n\n> Rebuilt at every sync.\n",
    "PROJECT.md": "# PROJECT\n\n<!-- Entries: ## [REQ-NNN] Title, then bullets. -->\n",
    "STATE.md": "# STATE\n\n## [STATE-CURRENT] (no sync yet)\n",
    "DECISIONS.md": "# DECISIONS\n\n<!-- Entries: ## [DEC-NNN] Title, then bullets. -->\n",
    "TECH.md": "# TECH\n\n<!-- Entries: ## [TECH-NNN] Title, then bullets. -->\n",
    "HISTORY.md": "# HISTORY\n\n<!-- One line for each sync. -->\n",
    "CONFLICTS.md": "# CONFLICTS\n\n<!-- Entries: ## [CONFLICT-NNN] Title, then bullets. -->\n",
}


def ledger_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, content, size, modified) of all seven files; a missing one has its template."""
    names = spark.createDataFrame(list(TEMPLATES.items()), "file string, template string")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    found = found.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return names.join(found, "file", "left").select("file", F.coalesce("content", "template").alias("content"), F.coalesce("size", F.lit(0)).alias("size"), "modified")


def seeded(spark: SparkSession, folder: str) -> DataFrame:
    """(file, content) of the files that a folder lacks, as they would be made."""
    there = ledger_files(spark, folder).where("modified is not null").select("file")
    return spark.createDataFrame(list(TEMPLATES.items()), "file string, content string").join(there, "file", "left_anti")


#: Keeps a ledger out of version control.
IGNORE = "*\n"


def ensured(spark: SparkSession, folder: str, tracked: bool = False) -> None:
    """Make a ledger's folder and the files that it lacks; what is there stays as it is.

    Unless version control is to track it, a missing .gitignore is made too; if it is, one is removed.
    Seven small files of fixed texts are all that the driver writes; each is made only if no other was first.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(conf)
    fs.mkdirs(path)
    fs.setWriteChecksum(False)  # people edit these files, so no checksum may stand beside them
    ignore = jvm.org.apache.hadoop.fs.Path(f"{folder}/.gitignore")
    if tracked:
        fs.delete(ignore, False)
    for name, text in {**TEMPLATES, **({} if tracked else {".gitignore": IGNORE})}.items():
        at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if not fs.exists(at):
            out = fs.create(at, False)
            out.write(bytearray(text.encode()))
            out.close()
    fs.setWriteChecksum(True)


def status(files: DataFrame, found: DataFrame) -> DataFrame:
    """(file, size, modified, n_conflicts): a folder at a glance; conflicts are ACTIVE ones."""
    open_ = found.where("file = 'CONFLICTS.md' and coalesce(status, 'ACTIVE') = 'ACTIVE'").agg(F.count("*").alias("n_conflicts"))
    return files.select("file", "size", "modified").withColumn("_one", F.lit(1)).join(F.broadcast(open_.withColumn("_one", F.lit(1))), "_one").drop("_one")  # one row


def ledger_lines(files: DataFrame, history: bool = False) -> DataFrame:
    """(file, line_no, text); the index leaves HISTORY out."""
    kept = files if history else files.where("file <> 'HISTORY.md'")
    return kept.select("file", F.posexplode(F.split("content", r"\r?\n")).alias("line_no", "text")).withColumn("line_no", F.col("line_no").cast("long"))


SIDECAR = "struct<sessions:map<string,map<string,array<string>>>,unresolved:map<string,struct<reason:string,at:string>>>"
STATE = "struct<sessions:map<string,struct<turns:long,lastSyncedSeq:long,lastSyncMs:long,lastSource:string>>,revision:long>"


def sidecar(spark: SparkSession, name: str) -> DataFrame:
    """(json): a sidecar as one row, none where it is absent. Spark's readers pass over names with a leading dot."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(name)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return spark.createDataFrame([], "json string")
    data = fs.open(path)
    try:
        return spark.createDataFrame([(jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8"),)], "json string")
    finally:
        data.close()


def bindings(raw: DataFrame) -> DataFrame:
    """(session, seq, entry_id) of provenance JSON; broken JSON gives nothing."""
    sessions = raw.select(F.explode(F.from_json("json", SIDECAR)["sessions"]).alias("session", "seqs"))
    return sessions.select("session", F.explode("seqs").alias("seq", "ids")).select("session", F.col("seq").try_cast("long").alias("seq"), F.explode("ids").alias("entry_id")).where("seq is not null")


def unresolved(raw: DataFrame) -> DataFrame:
    """(entry_id, reason, at) of provenance JSON."""
    return raw.select(F.explode(F.from_json("json", SIDECAR)["unresolved"]).alias("entry_id", "x")).select("entry_id", F.coalesce("x.reason", F.lit("unbound")).alias("reason"), "x.at")


def sync_state(raw: DataFrame) -> DataFrame:
    """(session, turns, last_seq, last_ms, revision); broken JSON gives nothing."""
    read = raw.select(F.from_json("json", STATE).alias("s"))
    return read.select(F.explode("s.sessions").alias("session", "x"), F.coalesce("s.revision", F.lit(0)).alias("revision")).select(
        "session", F.coalesce("x.turns", F.lit(0)).alias("turns"), F.coalesce("x.lastSyncedSeq", F.lit(-1)).alias("last_seq"), F.coalesce("x.lastSyncMs", F.lit(0)).alias("last_ms"), "revision"
    )


def first_object(text: str | None) -> str | None:
    """The first balanced JSON object in a text, aware of strings and escapes."""
    decoder = json.JSONDecoder()
    at = (text or "").find("{")
    while at >= 0:
        try:
            _, end = decoder.raw_decode(text, at)
            return text[at:end]
        except ValueError:
            at = text.find("{", at + 1)
    return None


def first_objects(text: Column) -> Column:
    """``first_object`` over a column, in Arrow batches: no built-in function finds balance."""
    import pandas as pd

    @F.pandas_udf("string")
    def find(values: pd.Series) -> pd.Series:
        return values.map(first_object)

    return find(text)
