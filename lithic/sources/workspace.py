"""A shared folder for what a query writes and reads again."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def top(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of this machine only where the setting is absent, as in tests."""
    return (spark.sparkContext.getConf().get("spark.checkpoint.dir") or os.path.join(tempfile.gettempdir(), "lithic-work")).rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder there."""
    return f"{top(spark)}/{name}-{uuid.uuid4().hex}"


def lasting(spark: SparkSession, name: str, *of: str) -> str:
    """The folder there of what ``of`` describes, the same in every session."""
    return f"{top(spark)}/{name}-{hashlib.sha256(chr(0).join(of).encode()).hexdigest()[:32]}"


def fingerprint(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of change of all files at a path: another one as soon as a file is another."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, each = [], files.listFiles(there, True)
    while each.hasNext():
        one = each.next()
        found.append(f"{one.getPath().getName()} {one.getLen()} {one.getModificationTime()}")
    return "\n".join(sorted(found))


def cut(rows: DataFrame) -> DataFrame:
    """rows behind a checkpoint, which outlives lost executors."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(top(rows.sparkSession))
    return rows.checkpoint(eager=True)
