"""First rows of each key by bounded heaps, and co-occurrence of entities on pages of any size."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lithic.operators import graph, heaps


def test_first_of_each(spark, monkeypatch):
    monkeypatch.setattr(heaps, "GATHERED", 50)
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, *range(30)]), k) for k in range(3_000)]
    frame = spark.createDataFrame(rows, "k string, n long, id long").repartition(6)
    got = {r["k"]: [tuple(x) for x in r["first"]] for r in heaps.first_of_each(frame, ["k"], [("n", False), ("id", True)], 7).collect()}
    want = {key: sorted(((n, i) for k, n, i in rows if k == key), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))[:7] for key in ("hot", "a", None)}
    assert got == want
    assert heaps.first_of_each(frame.limit(0), ["k"], [("n", False)], 3).count() == 0


def test_no_window_over_a_hot_entity(spark):
    mentions = spark.createDataFrame([("p", "e", 1)], "page string, entity string, at long")
    for rows in (graph.related(mentions, "page", "entity"), graph.newest_pages(mentions, "page", "entity", "at")):
        assert "Window" not in rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [512, 4])
def test_related_counts_every_pair(spark, block):
    rng = random.Random(block)
    rows = [(f"p{k % 9}", f"e{rng.randrange(40):02}") for k in range(250)] + [("big", f"e{k:02}") for k in range(40)] + [(None, "x"), ("p1", None)]
    shared: Counter = Counter()
    for page in {p for p, _ in rows if p}:
        held = {e for p, e in rows if p == page and e}
        shared.update((a, b) for a in held for b in held if a != b)
    want = sorted((a, *x) for a in {a for a, _ in shared} for x in [(o, -n, k) for k, (n, o) in enumerate(sorted((-n, o) for (x, o), n in shared.items() if x == a)[:10], 1)])
    got = graph.related(spark.createDataFrame(rows, "page string, entity string"), "page", "entity", 10, block).select("entity", "other", F.col("shared"), "place").collect()
    assert sorted(map(tuple, got)) == sorted((a, o, n, k) for a, o, n, k in want)
