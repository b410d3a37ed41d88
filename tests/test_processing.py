"""The processing chain asks a model once for each page and step, in one pass over the pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithic.operators import models, processing


def counted(spark):
    calls = {task: spark.sparkContext.accumulator(0) for task in ("detect", "summarize", "classify", "entities")}

    def provider(task: str, text: str) -> str:
        calls[task].add(1)
        if "quota" in text:
            raise models.ProviderError("out of quota", window="minute")
        return models.offline(task, text)

    return provider, calls


def test_one_call_a_page_and_step(spark, tmp_path):
    rows = [(k, f"zxq vbn page{k} Jane Doe{' quota' if k == 3 else ''} a{k}@example.org", k == 4) for k in range(20)] + [(20, "  ", False), (21, None, False)]
    spark.createDataFrame(rows, "url long, text string, done boolean").write.parquet(str(tmp_path / "p"))
    provider, calls = counted(spark)
    docs = spark.read.parquet(str(tmp_path / "p"))
    out = processing.chain(docs, {"entities": processing.named_entities(provider), "language": processing.language(provider), "category": processing.category(provider), "summary": processing.summary(provider)})
    got = {r["url"]: r for r in out.collect()}
    assert {task: n.value for task, n in calls.items()} == dict.fromkeys(calls, 19)  # not the empty ones, not the one that is done
    assert got[3]["entities_status"] == "waiting" and got[3]["entities"] is None and got[4]["summary_status"] == "unchanged" and got[20]["category_status"] == got[21]["language_status"] == "skipped"
    assert [(e["type"], e["display"]) for e in got[0]["entities"]] == [("email", "a0@example.org"), ("person", "Jane Doe")]


def test_one_scan_before_the_entities(spark, tmp_path):
    spark.createDataFrame([(1, "text", False)], "url long, text string, done boolean").write.parquet(str(tmp_path / "p"))
    provider, _ = counted(spark)
    out = processing.chain(spark.read.parquet(str(tmp_path / "p")), {"language": processing.language(provider), "category": processing.category(provider), "summary": processing.summary(provider)})
    plan = out.select(F.col("summary"), "category", "category_status", "language", "language_status", "summary_status")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and plan.count("ArrowEvalPython") <= 3
