"""Folds of hot keys by many tasks give what the fold in one task gives."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lithic.operators import quota, scans, versions


def events(seed: int, n: int, keys: int, span: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(rng.randrange(keys) if keys > 1 else 0, k, rng.randrange(span), rng.random() < 0.55) for k in range(n)]
    return rows + [(None, n + 1, 5, True), (None, n + 2, 6, True)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "host long, i long, s long, bad boolean").withColumn("at", F.timestamp_seconds("s"))


@pytest.mark.parametrize(("seed", "n", "keys", "span"), [(1, 500, 1, 200_000), (2, 500, 3, 60_000), (3, 300, 1, 300)])
def test_ttl(spark, seed, n, keys, span):
    rows = frame(spark, events(seed, n, keys, span))
    one = sorted(r["i"] for r in versions.seen_within(rows, "host", "at", 6, "i").collect())
    many = sorted(r["i"] for r in versions.seen_within(rows, "host", "at", 6, "i", hot=1).collect())
    assert one == many


@pytest.mark.parametrize(("seed", "n", "keys", "span"), [(1, 500, 1, 20_000), (2, 500, 3, 3_000), (3, 300, 1, 100)])
def test_breaker(spark, seed, n, keys, span):
    rows = frame(spark, events(seed, n, keys, span))
    tell = lambda hot: sorted((r["i"], r["allowed"]) for r in quota.breaker(rows, "host", "at", "i", "bad", 3, 600, hot).collect())
    assert tell(10**9) == tell(1)


def test_following_and_place(spark):
    rng = random.Random(5)
    nodes = [("a" if rng.random() < 0.8 else "b", rng.randrange(200), k) for k in range(300)]
    probes = [(rng.choice("abc"), rng.randrange(-5, 210), k) for k in range(300)]
    n, p = spark.createDataFrame(nodes, "key_ string, x long, id long"), spark.createDataFrame(probes, "key_ string, x long, q long")
    got = {r["q"]: r["id"] for r in scans.following(n, p, "key_", "x", {"id": F.col("id")}, ["id"]).collect()}
    want = {q: min(((x, i) for h, x, i in nodes if h == k and x >= at), default=(0, None))[1] for k, at, q in probes}
    assert got == want
    order = {(r["key_"], r["place"]): r["id"] for r in scans.placed(n, "key_", ["x", "id"]).collect()}
    assert order == {(k, j): i for k in "ab" for j, (_, i) in enumerate(sorted((x, i) for h, x, i in nodes if h == k))}


def test_a_hot_key_is_spread(spark):
    """One key has all rows: the search deals them evenly, as its values lie."""
    rows = spark.range(20_000).select(F.lit("k").alias("key_"), F.col("id").alias("x"))
    sizes = [r[0] for r in scans._ranged(rows, [F.desc("key_"), F.desc("x")]).groupBy("range_").count().select("count").collect()]
    assert len(sizes) == 4 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]


def test_a_path_is_walked_inside_ranges(spark, monkeypatch):
    """Doubling goes over the nodes at which paths enter a range alone, not over all edges."""
    edges = [("a", x, x + 3) for x in range(0, 3_000)] + [("b", x, x + 1) for x in range(500)] + [("c", 9, None)]
    rows, doubled = spark.createDataFrame(edges, "key_ string, node long, next long"), []
    plain = scans._doubled
    monkeypatch.setattr(scans, "_doubled", lambda e, r, k: doubled.append(e.count()) or plain(e, r, k))
    roots = spark.createDataFrame([("a", 1), ("b", 4), ("c", 9), ("d", 2)], "key_ string, node long")
    got = sorted(map(tuple, scans.path(rows, roots).collect()))
    assert got == [*(("a", x) for x in range(1, 3_003, 3)), *(("b", x) for x in range(4, 501)), ("c", 9), ("d", 2)]
    assert doubled[0] < 40
