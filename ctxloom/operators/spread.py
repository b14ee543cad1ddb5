"""Rows dealt to as many tasks as they need, so that no task's sorts grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that one task is meant to sort.
ROWS = 1 << 18
#: Texts that one task is meant to read.
TEXTS = 1 << 12


def tasks_for(rows: DataFrame, each: int = ROWS) -> int:
    """Tasks that hold about ``each`` of ``rows``, and no fewer than the session deals to; the rows are counted first."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // each))


def spread(rows: DataFrame, *by: str, tasks: int | None = None) -> DataFrame:
    """``rows`` dealt by the columns ``by``, or evenly; windows and groupings by them need no other exchange."""
    return rows.repartition(tasks or tasks_for(rows), *by)


def spread_texts(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` dealt by their key before patterns read their texts: a task of a scan takes whole row groups, and a file may be one."""
    return spread(rows, *by, tasks=tasks_for(rows, TEXTS))
