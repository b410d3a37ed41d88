"""Steps whose cost or memory grew faster than their input."""

from __future__ import annotations

import pyarrow as pa

from lithic.functions import text as T
from lithic.registry import QUERIES


def test_full_join_forms_no_pairs_of_customers_and_suppliers(spark, tmp_path):
    spark.createDataFrame([(1, "A"), (2, "B"), (3, "A"), (4, None)], "n_nationkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame([(k, 1 + k % 3) for k in range(6)] + [(2, 3)], "c_custkey int, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(k, k % 4) for k in range(8)], "s_suppkey int, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    got = QUERIES["rel_join_full"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == [("A", 4, 4), ("B", 2, 2), (None, 0, 2)]
    lines = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in lines if "c_custkey" in x and "s_suppkey" in x]
    full = next(k for k, x in enumerate(lines) if "FullOuter" in x)
    assert "Aggregate" in lines[full + 1] or "Aggregate" in lines[full + 2]


def test_rows_become_python_objects_by_slices():
    taken = []

    class Column:
        def __init__(self, n):
            self.n = n

        def __len__(self):
            return self.n

        def slice(self, at, most):
            return Column(min(most, self.n - at))

        def to_pylist(self):
            taken.append(self.n)
            return [1] * self.n

    found = T.by_slices(lambda x: x + 1, [Column(1000)], pa.int64())
    assert found.to_pylist() == [2] * 1000 and max(taken) == T.SLICE
    assert T.by_slices(lambda x: x, [pa.array([], pa.int64())], pa.int64()).to_pylist() == []
