"""Tables of one key dealt and sorted alike, so that they meet without a shuffle.

A table is written once into buckets of its key's hash, a file each, in the key's order. Tables of as many buckets
join, and group by the key, bucket by bucket: Spark reads both sides where they lie.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lithic.sources import workspace


def put(rows: DataFrame, key: str, buckets: int, name: str = "bucketed") -> DataFrame:
    """rows as such a table, in the shared folder. The number of buckets decides what it meets without a shuffle: size it by
    the largest table of the key, about 128 MB a bucket."""
    spark = rows.sparkSession
    table = f"lithic_{name}_{uuid.uuid4().hex}"
    # the files' order counts for joins where a bucket is one file
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    rows.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", workspace.folder(spark, name)).saveAsTable(table)
    return spark.table(table)


def drop(spark: SparkSession, table: DataFrame) -> None:
    """Forget a table; its files go with the work folder."""
    for name in (t.name for t in spark.catalog.listTables() if t.name.startswith("lithic_")):
        if spark.table(name).sameSemantics(table):
            spark.sql(f"DROP TABLE {name}")


def meet(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join of two such tables, by merging their buckets."""
    return left.hint("merge").join(right, key, how)
