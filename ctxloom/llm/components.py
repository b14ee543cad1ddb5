"""Connected components by alternating stars, every round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.llm.shared import drop_table, table


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both(edges)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return near.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    out = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on ``edges`` (a, b); the root is the least node reachable."""
    edges, before = table(edges.select("a", "b").where("a <> b").distinct(), "edges"), None
    while True:
        mark = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return table(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots), "components")
        before, after = mark, table(_small_star(_large_star(edges)), "edges")
        drop_table(edges)
        edges = after
