"""Rows dealt over as many tasks as their number asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a task at most, on average.
TASK_ROWS = 100_000


def tasks_for(rows: DataFrame, task_rows: int = TASK_ROWS) -> int:
    """How many tasks rows need, and no fewer than a shuffle has; a count of a Parquet table reads no column."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows.count() // task_rows))


def spread(rows: DataFrame, *by: str, n: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Rows by their keys ``by`` (by chance without any), whatever files they lie in: a small file of many rows is one task
    otherwise, and a shuffle of a fixed width has tasks that grow with the rows."""
    return rows.repartition(tasks_for(rows, task_rows) if n is None else n, *by)
