"""The segmented full-text index: equal ranks after changes, one index for all sessions, and ranges left out."""

from __future__ import annotations

import random

import pytest

from lithic.operators import fulltext, search
from lithic.sources.snapshots import Store

QUERIES = ["red", "red or blue", "red blue", '"red blue" or green -pink', "red -blue", "-red", "absent", "absent red", "rare"]


def texts(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["red", "blue", "green", "pink", *(f"w{k}" for k in range(30))]
    rows = [(k, " ".join(rng.choice(words) for _ in range(int(3 * 1.7 ** rng.randint(0, 8))))) for k in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "red " * 300), (n + 3, "Rare red")]


def found(index, query, few=10**9, k=15):
    rows, read, total = search.best(index, query, k, few)
    return [(r[0], round(r[1], 9)) for r in rows.collect()], read, total


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = spark.createDataFrame(texts(400, 1), "id long, t string")
    return fulltext.build(docs, "id", "t", str(tmp_path_factory.mktemp("text")))


@pytest.mark.parametrize("query", QUERIES)
def test_bounds_change_no_result(index, query):
    whole, _, total = found(index, query)
    some, read, _ = found(index, query, few=0)
    assert some == whole and read <= total


def test_ranges_are_left_out(index):
    _, read, total = found(index, "red or blue", few=0, k=5)
    assert 0 < read < total / 2
    _, read, _ = found(index, "rare", few=0)
    assert read == 1  # of all other ranges none has the word
    assert found(index, "absent", few=0)[:2] == ([], 0)


def test_only_its_buckets_are_read(index):
    plan = index.postings(["red"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1]


def test_refresh_and_merge_equal_a_new_index(spark, tmp_path):
    before, after = dict(texts(120, 2)), dict(texts(120, 2))
    for k in (3, 5, 7):
        after[k] += " red red green"
    del after[11], after[12]
    after[500] = "red blue"
    frame = lambda rows: spark.createDataFrame(sorted(rows.items()), "id long, t string")
    store = Store(spark, str(tmp_path / "s"))
    store.run(lambda c: fulltext.refresh(c, frame(before), "id", "t"))
    old = fulltext.Index(store.snapshot(), "id")
    store.run(lambda c: fulltext.refresh(c, frame(after), "id", "t"))
    now = fulltext.Index(store.snapshot(), "id")
    assert sorted(r["id"] for r in now.at.table("docs").where("segment = 1").collect()) == [3, 5, 7, 500]
    store.run(lambda c: fulltext.merge(c, "id"))
    merged = fulltext.Index(store.snapshot(), "id")
    assert len(now.segments) == 2 and len(merged.segments) == 1
    fresh = fulltext.build(frame(after), "id", "t", str(tmp_path / "fresh"))
    stale = fulltext.build(frame(before), "id", "t", str(tmp_path / "stale"))
    for query in QUERIES[1:5:2]:
        want = found(fresh, query)[0]
        assert found(now, query)[0] == found(merged, query)[0] == found(now, query, few=0)[0] == want
        assert found(old, query)[0] == found(stale, query)[0]  # an old snapshot stays as it was
    rows = lambda i: sorted((r["id"], r["lexeme"], tuple(r["places"]), r["n"]) for r in i.all_postings().collect())
    assert rows(now) == rows(merged) == rows(fresh)


def test_sessions_share_an_index_and_notice_changes(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame([(1, "red"), (2, "blue")], "id long, t string").coalesce(1).write.parquet(path)
    first = fulltext.of_path(spark.read.parquet(path), "id", "t", path)
    again = fulltext.of_path(spark.read.parquet(path), "id", "t", path)
    assert first.at.version == again.at.version == 1
    spark.createDataFrame([(3, "red")], "id long, t string").coalesce(1).write.mode("append").parquet(path)
    later = fulltext.of_path(spark.read.parquet(path), "id", "t", path)
    assert later.at.version == 2 and [s["docs"] for s in later.segments] == [2, 1]
    assert sorted(r[0] for r in search.found_in(later, "red").collect()) == [1, 3]


def test_a_phrase_behind_many_places_is_found(spark, tmp_path):
    far = "of x " * 300 + "the y " * 300 + "of the"
    docs = spark.createDataFrame([(1, far), (2, "the x of " * 300)], "id long, t string")
    index = fulltext.build(docs, "id", "t", str(tmp_path / "far"))
    rows = search.found_in(index, '"of the"').collect()
    assert sorted(r["id"] for r in rows) == [1, 2]
    assert [r[0] for r in search.found_in(index, '"y of the"').collect()] == [1]
    most = sum(1 / (j * j) for j in range(1, fulltext.MOST_PLACES + 1)) * search.WEIGHT / search.ALL_PLACES
    assert all(abs(search.best(index, w, 1)[0].collect()[0]["rank"] - most) < 1e-9 for w in ("of", "the"))


def test_a_segment_has_a_file_of_blocks_for_each_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fulltext, "FILE_CHARS", 20)
    rows = [(k, " ".join(f"w{k * 7 % 50 + j}" for j in range(30))) for k in range(200)]
    index = fulltext.build(spark.createDataFrame(rows, "id long, t string"), "id", "t", str(tmp_path / "b"))
    files = list((tmp_path / "b" / "data" / "blocks").rglob("*.parquet"))
    assert len(files) == len({f.parent for f in files}) <= index.segments[0]["buckets"]
