"""The entity graph's queries deal their rows over more tasks as these grow."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lithic.operators import graph, shares


def widths(rows) -> list[int]:
    return [int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\)", rows._jdf.queryExecution().executedPlan().toString())]


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(shares, "ROWS", 100)
    mentions = spark.range(3_000).select((F.col("id") % 500).alias("page"), (F.col("id") % 77).alias("entity"), F.col("id").alias("at"))
    formed = 500 * 6 * 6
    assert {30, formed // 100} == set(widths(graph.related(mentions, "page", "entity")))
    assert set(widths(graph.newest_pages(mentions, "page", "entity", "at"))) == {30}


def test_a_mention_that_comes_again_counts_once(spark):
    mentions = spark.createDataFrame([("p", "e", 1), ("p", "e", 1), ("q", "e", 1), ("p", "e", 2)] * 40, "page string, entity string, at long").repartition(5)
    assert [r["pages"] for r in graph.newest_pages(mentions, "page", "entity", "at", 3).collect()] == [["p", "p", "q"]]
