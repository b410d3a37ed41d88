"""What the operators of this subpackage share: table reading, shared-folder checkpoints and
the walk over key-sorted Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a folder of this machine only where
    the setting is absent, as in tests on ``local[*]``."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"lithic-{uuid.uuid4().hex}"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint, which outlives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_HELD: dict[str, Callable[[], None]] = {}


def alone(owner: str, release: Callable[[], None] | None = None) -> None:
    """Said by an operator's code in a Python worker: what other operators left there, which Spark uses again,
    is released; ``release`` does the same for this one's tables later."""
    for name in [n for n in _HELD if n != owner]:
        _HELD.pop(name)()
    if release is not None:
        _HELD[owner] = release


#: A key is heavy if it holds more than this share of all rows; so there are fewer heavy keys than SHARES.
SHARES = 1024


def spread_join(rows: DataFrame, small: DataFrame, key: str, heavy: list, how: str = "inner") -> DataFrame:
    """Join of rows with small, where each key stands once; no key is null. The rows of the heavy keys, fewer than
    SHARES, stay where they are and get their part of small by broadcast; all others meet by shuffle."""
    if not heavy:
        return rows.join(small, key, how)
    inside = F.col(key).isin(heavy)
    return rows.where(~inside).join(small.where(~inside), key, how).unionByName(rows.where(inside).join(F.broadcast(small.where(inside)), key, how))


def heavy_keys(counts: DataFrame, key: str, n: str) -> list:
    """The keys that hold over one SHARES-th of the rows; counts has (key, n) once per key, no null key."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counts.where(F.col(n) * SHARES > F.lit(total)).select(key).collect()]


def sorted_groups(batches: Iterable[pa.RecordBatch], key: str, others: list[str], whole_rows: int = 65536) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Turn batches of one key-sorted partition into (keys, columns) numpy blocks that never cut
    a key in two: a block is at least ``whole_rows`` rows unless the partition ends."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in (key, *others)])
        rows += batch.num_rows
        if rows < whole_rows:
            continue
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        last = int(np.searchsorted(columns[0], columns[0][-1], side="left"))
        if last:
            yield columns[0][:last], [c[:last] for c in columns[1:]]
            held, rows = [[c[last:] for c in columns]], len(columns[0]) - last
        else:
            held = [columns]
            whole_rows = max(whole_rows, 2 * rows)
    if rows:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        yield columns[0], columns[1:]
