"""Folds over a key's rows in order, for verdicts that depend on the verdicts before."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string


def fold(rows: DataFrame, key: str, order: list[str], reads: list[str], step: Callable, out: str) -> DataFrame:
    """rows with a column ``out`` ("name type"), which step(state, values read) gives together with the next state;
    a key starts with the state None. Times are read as microseconds. One task holds one row of one key at a
    time, so a key of any number of rows fits, but its rows go through one task."""
    schema = StructType([*rows.schema.fields, *_parse_datatype_string(out).fields])

    def read(column: pa.Array) -> list:
        return column.cast(pa.timestamp("us")).cast(pa.int64()).to_pylist() if pa.types.is_timestamp(column.type) else column.to_pylist()

    def run(batches):
        last, state = object(), None
        for batch in batches:
            found = []
            for k, *values in zip(*(read(batch.column(c)) for c in (key, *reads)), strict=True):
                if k != last:
                    last, state = k, None
                state, verdict = step(state, values)
                found.append(verdict)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, out.split()[0]])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
