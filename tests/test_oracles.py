"""Every core query with a SQL twin gives the twin's rows."""

from __future__ import annotations

import os

import duckdb
import pytest

from lithic.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def twin(small):
    con = duckdb.connect()
    for name in sorted(os.listdir(small)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{small}/{name}')")
    return con


def rows(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    show = lambda x: "null" if str(x) in ("None", "nan", "<NA>", "NaT") else f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(show(x) for x in r) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, twin, small, name):
    got = QUERIES[name](spark, small).toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    want = twin.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
