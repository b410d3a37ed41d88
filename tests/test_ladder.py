"""Calls up a ladder of providers: who is asked, how often, and whose answer counts; distributions and gauges."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lithic.operators import ladder, models, quota


def test_escalation_asks_the_router(spark):
    asked = {name: spark.sparkContext.accumulator(0) for name in "abc"}

    def provider(name: str, sure: float):
        def ask(task: str, text: str) -> str:
            asked[name].add(1)
            if text == "broken":
                raise models.ProviderError("refused")
            return json.dumps({"text": name, "confidence": 0.9 if text == "easy" else sure})

        return ask

    calls = spark.createDataFrame([(1, "easy", 10, True), (2, "hard", 10, True), (3, "broken", 10, True), (4, "easy", 990, True), (5, "easy", 10**7, True), (6, "hard", 10, False)], "call_id long, text string, estimate long, interactive boolean")
    quotas = spark.createDataFrame([("a", 30, 100, 1_000, 1_000), ("b", 100, 100, 10_000, 10_000), ("c", 100, 100, 10_000, 10_000)], "provider string, remaining long, limit long, tokens_left long, token_limit long")
    rows = {r["call_id"]: r for r in ladder.escalate(calls, {"a": provider("a", 0.3), "b": provider("b", 0.4), "c": provider("c", 0.2)}, quotas, "summarize", "text", floor=0.6, escalations=2).collect()}
    assert (rows[1]["provider"], rows[1]["tried"], rows[1]["error"]) == ("a", ["a"], None)
    assert (rows[2]["provider"], rows[2]["confidence"], rows[2]["tried"]) == ("b", 0.4, ["a", "b", "c"])  # the surest of three poor ones
    assert (rows[3]["value"], rows[3]["error"], rows[3]["tried"]) == (None, "failed", ["a", "b", "c"])
    assert rows[4]["tried"] == ["b"]  # the first has too few tokens left
    assert (rows[5]["tried"], rows[5]["error"]) == ([], "quota")
    assert rows[6]["tried"][0] in ("a", "b")
    assert sum(n.value for n in asked.values()) == sum(len(r["tried"]) for r in rows.values())  # no answer was asked for twice


def test_distribution_and_gauges(spark):
    rows = spark.createDataFrame([("s", 0.1), ("s", 0.5), ("s", 0.9), ("s", None), ("t", 2.0)], "k string, v double")
    got = sorted(((r["k"], r["below"], r["n"], round(r["share"], 3)) for r in quota.distribution(rows, ["k"], "v", [0.5, 0.8]).collect()), key=str)
    assert got == [("s", 0.5, 1, 0.333), ("s", 0.8, 1, 0.333), ("s", None, 1, 0.333), ("t", None, 1, 1.0)]
    log = spark.createDataFrame([("p", "2024-01-01 10:00:30", 5), ("p", "2024-01-01 10:00:59", 5), ("p", "2024-01-01 09:00:00", 50), ("p", "2023-12-31 10:00:00", 9)], "provider string, t string, tokens long").withColumn("at", F.to_timestamp("t"))
    limits = spark.createDataFrame([("p", "minute", 3, 100), ("p", "day", 5, 55), ("q", "day", 5, 5)], "provider string, window string, requests long, tokens long")
    left = {(r[0], r[1]): (r[2], r[3]) for r in quota.gauges(log, "provider", "at", "tokens", limits, F.to_timestamp(F.lit("2024-01-01 10:00:40"))).collect()}
    assert left == {("p", "minute"): (2, 95), ("p", "day"): (3, 0), ("q", "day"): (5, 5)}
