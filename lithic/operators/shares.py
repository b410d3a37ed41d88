"""How many tasks rows are dealt over, so that a task's share stays the same however many there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows of a task, about.
ROWS = 2_000_000


def at_least(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks(spark: SparkSession, rows: int, most: int | None = None) -> int:
    """So many that none has more than about ``most`` of the rows, ROWS if none is named; no fewer than any shuffle has."""
    return max(at_least(spark), -(-rows // (most or ROWS)))


def tasks_of(rows: DataFrame, most: int | None = None) -> int:
    """:func:`tasks` of rows, which are counted."""
    return tasks(rows.sparkSession, rows.count(), most)
