"""Orders of hot keys gone through by many tasks.

A fold whose verdicts depend on those before is a path: each row points to the one at which the state changes
next, by a rule that needs no state before it. The pointers come from a search for the first row at or after a
value, over ranges of values that tasks share evenly however the keys lie; the path from a key's first row comes from
tasks that follow pointers inside ranges of nodes, and pointers of doubling length between these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithic.operators import shares
from lithic.sources import workspace

#: Rows of a key from which on it is hot, and the share of all rows from which on it is, so hot keys are fewer than SHARES.
HOT, SHARES = 1_000_000, 1_024
#: The key of rows of hot keys: text, and never null.
KEY = "key_"


def parted(rows: DataFrame, key: str, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of other keys, rows of hot keys with KEY); None if no key is hot."""
    keyed = rows.withColumn(KEY, F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("null")))
    counts = keyed.groupBy(KEY).agg(F.count("*").alias("n"))
    heavy = counts.where(F.col("n") > hot).orderBy(F.desc("n")).limit(SHARES)
    total = counts.agg(F.sum("n")).first()[0] or 0 if (found := heavy.collect()) else 0
    names = [r[KEY] for r in found if r["n"] * SHARES > total]
    if not names:
        return rows, None
    return keyed.where(~F.col(KEY).isin(names)).drop(KEY), keyed.where(F.col(KEY).isin(names))


def micros(rows: DataFrame, at: str) -> Column:
    """A time as microseconds; a number as it is."""
    return F.unix_micros(F.col(at).cast("timestamp")) if dict(rows.dtypes)[at].startswith("timestamp") else F.col(at).cast("long")


def _ranged(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows dealt by ranges of an order, with the number of their range, cut there so that it stays."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return workspace.cut(rows.repartitionByRange(tasks, *order).withColumn("range_", F.spark_partition_id()))


def placed(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with ``place``, from 0 in their key's order: places within a range, and a range's rows counted up."""
    ranged = _ranged(rows, [F.col(key), *map(F.col, order)])
    before = Window.partitionBy(key).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(key, "range_").agg(F.count("*").alias("n")).withColumn("before_", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy(key, "range_").orderBy(*order)) - 1
    # sizes has a row for each range and hot key in it: no more than ranges and SHARES together
    return ranged.withColumn("inside_", inside).join(F.broadcast(sizes), [key, "range_"]).withColumn("place", F.col("inside_") + F.col("before_")).drop("inside_", "before_", "range_")


def following(nodes: DataFrame, probes: DataFrame, key: str, at: str, keep: dict[str, Column], order: list[str] | None = None) -> DataFrame:
    """probes with what ``keep`` says of the first node of their key whose ``at`` is not below theirs, null where there is
    none; of nodes with one ``at`` the first by ``order``."""
    more = order or []
    tie = F.struct(F.lit(0), *more) if more else F.struct(F.lit(0))
    kind = nodes.select(F.struct(*[c.alias(n) for n, c in keep.items()]).alias("n")).schema["n"].dataType
    asked = probes.select(F.struct("*").alias("p")).schema["p"].dataType
    ties = nodes.select(tie.alias("t")).schema["t"].dataType
    both = nodes.select(key, at, tie.alias("tie_"), F.struct(*[c.alias(n) for n, c in keep.items()]).alias("node_"), F.lit(None).cast(asked).alias("probe_"))
    both = both.unionByName(probes.select(key, at, F.lit(None).cast(ties).alias("tie_"), F.lit(None).cast(kind).alias("node_"), F.struct("*").alias("probe_")))
    # from high to low: a probe comes behind the nodes of its own value, of which the last seen is the first by order
    way = [F.desc(key), F.desc(at), F.desc_nulls_last("tie_")]
    ranged = _ranged(both, way)
    seen = F.last("node_", ignorenulls=True).over(Window.partitionBy(key, "range_").orderBy(*way).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lowest = ranged.where("node_ is not null").groupBy(key, "range_").agg(F.min_by("node_", F.struct(at, "tie_")).alias("edge_"))
    ranges = ranged.select(key, "range_").distinct().join(lowest, [key, "range_"], "left")
    before = F.last("edge_", ignorenulls=True).over(Window.partitionBy(key).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))
    carried = ranges.withColumn("carried_", before).select(key, "range_", "carried_")
    found = ranged.withColumn("seen_", seen).where("probe_ is not null").join(F.broadcast(carried), [key, "range_"])
    return found.select("probe_.*", *[F.coalesce("seen_", "carried_")[n].alias(n) for n in keep])


def _grouped(batches, key: str):
    """(key, table) of each key of a partition that is sorted by it."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held = list(batches)
    rows = pa.Table.from_batches(held) if held else None
    for name in pc.unique(rows.column(key)) if rows is not None else ():
        yield name.as_py(), rows.filter(pc.equal(rows.column(key), name))


def _steps(rows):
    """(nodes, next ones, the next one's row or -1 if it is none of the range's) of a range's edges, by node."""
    import numpy as np

    nodes, after = (rows.column(c).to_numpy() for c in ("node", "next"))
    by = np.argsort(nodes, kind="stable")
    nodes, after = nodes[by], after[by]
    at = np.minimum(np.searchsorted(nodes, after), len(nodes) - 1)
    return nodes, after, np.where(nodes[at] == after, at, -1), by


def _left(key: str):
    """Of each node of a range the first behind it, along the edges, that the range has no edge from."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for name, rows in _grouped(batches, key):
            nodes, after, row, _ = _steps(rows)
            last = np.where(row < 0, np.arange(len(nodes)), row)
            while (last[last] != last).any():
                last = last[last]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(nodes), rows.schema.field(key).type), pa.array(nodes), pa.array(after[last])], [key, "node", "next"])

    return run


def _walked(key: str):
    """The nodes of a range on the paths from those that are marked."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for name, rows in _grouped(batches, key):
            nodes, _, row, by = _steps(rows)
            seen = np.zeros(len(nodes), dtype=bool)
            for at in np.flatnonzero(np.asarray(rows.column("in_").is_valid())[by]):
                while at >= 0 and not seen[at]:
                    seen[at] = True
                    at = row[at]
            yield pa.RecordBatch.from_arrays([pa.array([name] * int(seen.sum()), rows.schema.field(key).type), pa.array(nodes[seen])], [key, "node"])

    return run


def path(edges: DataFrame, roots: DataFrame, key: str = KEY) -> DataFrame:
    """(key, node) of all nodes on the paths from roots (key, node) along edges (key, node, next), which lead to larger nodes and of
    which a node has one. A range of nodes is one task's: it says where each node's path leaves the range. Only nodes at
    which paths enter a range are then gone through by doubling, and each range is walked from those that are reached."""
    kind = roots.select(key).schema[key].dataType.simpleString()
    known = edges.where("next is not null").select(key, F.col("node").cast("long"), F.col("next").cast("long"))
    tasks = shares.tasks_of(known)
    ranged = workspace.cut(known.repartitionByRange(tasks, key, "node").sortWithinPartitions(key, "node"))
    left = workspace.cut(ranged.mapInArrow(_left(key), f"{key} {kind}, node long, next long"))
    starts = roots.select(key, F.col("node").cast("long"))
    enters = left.select(key, F.col("next").alias("node")).unionByName(starts).distinct()
    reached = _doubled(left.join(enters, [key, "node"], "left_semi"), starts, key)
    # a node for each range and path into it
    marked = ranged.join(F.broadcast(reached.withColumn("in_", F.lit(True))), [key, "node"], "left")
    return workspace.cut(marked.mapInArrow(_walked(key), f"{key} {kind}, node long").unionByName(reached).distinct())


def _doubled(edges: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """The nodes on the paths from roots: after each round twice as many steps are known, so rounds are the logarithm of the
    longest path."""
    reached = workspace.cut(roots.select(key, "node"))
    jumps = workspace.cut(edges.where("next is not null").select(key, "node", "next"))
    while True:
        more = workspace.cut(reached.join(jumps, [key, "node"]).select(key, F.col("next").alias("node")))
        if more.isEmpty():
            return reached
        reached = workspace.cut(reached.unionByName(more))
        jumps = workspace.cut(jumps.join(jumps.select(key, F.col("node").alias("next"), F.col("next").alias("far")), [key, "next"]).select(key, "node", F.col("far").alias("next")))
