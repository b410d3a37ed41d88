"""Joins without a shuffle: tables in buckets, and keys that a bit array knows to be new."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithic.operators import bloom, search
from lithic.sources import buckets


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_meet_without_a_shuffle(spark):
    pages = spark.range(500).select(F.concat(F.lit("u"), (F.col("id") % 300).cast("string")).alias("url"), F.col("id").alias("page"))
    versions = spark.range(400).select(F.concat(F.lit("u"), (F.col("id") % 350).cast("string")).alias("url"), F.col("id").alias("version"))
    points = spark.range(100).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.col("id").alias("point"))
    a, b, c = (buckets.put(x, "url", 8) for x in (pages, versions, points))
    joined = buckets.meet(buckets.meet(a, b, "url"), c, "url", "left")
    counted = joined.groupBy("url").agg(F.count("*").alias("n"), F.count("point").alias("points"))
    assert "Exchange" not in plan(counted) and plan(counted).count("SortMergeJoin") == 2 and "Bucketed: true" in plan(counted)
    want = pages.join(versions, "url").join(points, "url", "left").groupBy("url").agg(F.count("*").alias("n"), F.count("point").alias("points"))
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, want.collect()))
    buckets.drop(spark, c)
    assert len([t for t in spark.catalog.listTables() if t.name.startswith("lithic_")]) == 2
    buckets.drop(spark, a), buckets.drop(spark, b)


def test_unseen_equals_an_anti_join_and_shuffles_little(spark):
    seen = spark.range(0, 3_000).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"))
    rows = spark.range(2_500, 9_000).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), "id").unionByName(spark.createDataFrame([(None, 1), ("u1", 2), ("u1", 3)], "url string, id long"))
    got = bloom.unseen(rows, seen, "url").collect()
    assert sorted(r["id"] for r in got) == sorted(r["id"] for r in rows.join(seen, "url", "left_anti").collect())
    maybe, new = bloom.of_keys(seen, "url").split(rows, "url")
    passed = maybe.join(seen, "url", "left_anti").count()
    assert passed / 6_000 < 0.01 and maybe.count() + new.count() == rows.count()  # a false positive in a hundred at most
    assert new.join(seen, "url", "left_semi").count() == 0
    assert bloom.unseen(rows, seen.limit(0), "url").count() == rows.count() and bloom.unseen(rows.limit(0), seen, "url").count() == 0


def test_fragments_by_covers(spark):
    def of(text, query, **kind):
        return spark.createDataFrame([(text,)], "t string").select(search.fragments(F.col("t"), query, **kind)).first()[0]

    words = [f"w{k}" for k in range(100)]
    words[10] = words[50] = "red"
    words[54], words[90] = "Blue,", "red"
    text = " ".join(words)
    bold = lambda part: " ".join(f"<b>{w}</b>" if w in ("red", "Blue,") else w for w in part)
    # the cover with both words, stretched by seven and eight; then the first of the others, in text order
    assert of(text, "red or blue", most=20, least=10) == bold(words[1:21]) + " ... " + bold(words[43:63])
    assert of(text, "red or blue", most=20, least=10, count=1, marked=False) == " ".join(words[43:63])
    ended = " ".join([*["a"] * 5, "red", *["b"] * 12, "end.", *["c"] * 40])
    assert of(ended, "red", most=30, least=10, count=1).endswith("end.")  # cut behind a sentence
    assert of(ended, "red", most=30, least=25, count=1).endswith(" c") and len(of(ended, "red", most=30, least=25, count=1).split()) == 30
    assert of("a b c", "zzz") == "a b c" and of("", "red") == "" and of("  ", "red") == "" and of("red", "red") == "<b>red</b>"
