"""Repeated keys, without a window that a hot key would fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks that the rows of one key are dealt to.
SALTS = 16


def marked_repeats(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """(order, is_repeat): whether a row's key stands in one of a lower ``order``.

    The key is computed once and dealt by key and salt; both the search for keys that repeat and
    the rows that are marked read that exchange. It is never null, so no filter that only one
    of the two needs keeps Spark from sharing it; rows without a key repeat each other.
    """
    keyed = rows.select(order, F.coalesce(key, F.lit("")).alias("_key")).repartition("_key", F.pmod(F.hash(order), F.lit(SALTS)))
    several = keyed.groupBy("_key").agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return keyed.join(several, "_key", "left").select(order, F.coalesce(F.col(order) > F.col("_first"), F.lit(False)).alias("is_repeat"))
