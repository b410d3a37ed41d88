"""The first rows of each key by an order, as an aggregate: every task keeps a bounded heap for each key, and heaps are merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a task gathers before it cuts them to heaps, and rows in heaps that it holds before it sends them on.
GATHERED, HELD = 100_000, 400_000


def first_of_each(rows: DataFrame, keys: list[str], order: list[tuple[str, bool]], most: int, tasks: int | None = None, once: bool = False) -> DataFrame:
    """(keys, first): up to ``most`` structs of the order's columns, in that order; of each (column, ascending). Nulls come last.

    A key on all rows costs each task ``most`` rows, whatever it read: nothing is sorted or windowed over a whole key.
    The columns that order have to tell rows apart, or which of equal ones stays is open; with ``once`` equal rows count as one.
    Heaps meet in ``tasks`` tasks, if so many are named.
    """
    names = [name for name, _ in order]
    rows = rows.select(*keys, *names)

    def heaps(batches):
        import pandas as pd
        import pyarrow as pa

        kept: list[pd.DataFrame] = []

        def cut() -> pd.DataFrame:
            whole = pd.concat(kept, ignore_index=True)
            whole = (whole.drop_duplicates() if once else whole).sort_values(names, ascending=[up for _, up in order], kind="stable", na_position="last")
            return whole.groupby(keys, sort=False, dropna=False).head(most)

        for batch in batches:
            # columns stay Arrow's, so that nothing changes its type
            kept.append(batch.to_pandas(types_mapper=pd.ArrowDtype))
            if sum(map(len, kept)) > GATHERED + (len(kept[0]) if len(kept) > 1 else 0):
                kept = [cut()]
                if len(kept[0]) > HELD:
                    yield pa.RecordBatch.from_pandas(kept.pop(), schema=batch.schema, preserve_index=False)
        if kept:
            yield pa.RecordBatch.from_pandas(cut(), schema=batch.schema, preserve_index=False)

    def before(a: Column, b: Column) -> Column:
        rule = F.lit(0)
        for name, up in reversed(order):
            x, y = a[name], b[name]
            less = (x < y) if up else (x > y)
            more = (x > y) if up else (x < y)
            rule = F.when(x.isNull() & y.isNull(), rule).when(x.isNull(), 1).when(y.isNull(), -1).when(less, -1).when(more, 1).otherwise(rule)
        return rule

    found = rows.mapInArrow(heaps, rows.schema)
    found = found if tasks is None else found.repartition(tasks, *keys)
    all_of = (F.collect_set if once else F.collect_list)(F.struct(*names))
    return found.groupBy(*keys).agg(F.slice(F.array_sort(all_of, before), 1, most).alias("first"))
