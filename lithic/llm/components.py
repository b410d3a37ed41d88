"""Connected components of a distributed edge list.

Every task first contracts its own edges with a union-find, so that a dense group leaves a task
as a star and never as all of its pairs; alternating large-star and small-star rounds
(Kiveris et al., 2014) then join the stars. Neither edges nor labels come to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, heavy_keys, spread_join


class Forest:
    """Union-find over integers; the root of a set is its smallest member."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        above = self.above
        top = x
        while (up := above.get(top, top)) != top:
            top = up
        while x != top:
            above[x], x = top, above.get(x, x)
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.above[max(a, b)] = min(a, b)

    def star(self) -> tuple[np.ndarray, np.ndarray]:
        nodes = list(self.above)
        return np.array(nodes, dtype=np.int64), np.array([self.root(x) for x in nodes], dtype=np.int64)


def contract(batches):
    """Arrow map over (a, b) edges of one task: its spanning stars."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            forest.join(a, b)
    a, b = forest.star()
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _rounds(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star; edges (a, b) always have a > b. A star's centre, which may have most
    of the edges, gives its least neighbour to them by broadcast."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
    large = spread_join(both, least.drop("n"), "a", heavy_keys(least, "a", "n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
    return small.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that an edge (a, b) names; root is the smallest node reached.

    Nulls and loops are no links; repeated edges count once. No edges: no rows. Every round but the last
    lowers some end of an edge, so the rounds, about the logarithm of the longest chain, come to an end.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut(edges.mapInArrow(contract, "a long, b long").distinct())
    digest = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == digest or not now[0]:
            break
        digest = now
        edges = cut(_rounds(edges))
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
