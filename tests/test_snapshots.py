"""Snapshot commits, the vector index that lives in them, and what several writers and sessions see."""

from __future__ import annotations

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithic.operators import ingest, vectors
from lithic.sources.snapshots import Conflict, Store, listing


def numbers(spark, *n):
    return spark.createDataFrame([(x,) for x in n], "n long").coalesce(1)


def held(snapshot, name="t"):
    return sorted(r[0] for r in snapshot.table(name).collect())


def test_commits_are_atomic_and_readers_keep_their_snapshot(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.snapshot().version == 0 and store.snapshot().tables == {}
    store.run(lambda c: (c.append("t", numbers(spark, 1)), c.append("u", numbers(spark, 10))))
    old = store.snapshot()
    store.run(lambda c: (c.append("t", numbers(spark, 2)), c.replace("u", numbers(spark, 20))))
    new = store.snapshot()
    assert (held(old), held(old, "u")) == ([1], [10]) and (held(new), held(new, "u")) == ([1, 2], [20])
    assert held(store.snapshot(1)) == [1] and new.version == 2
    killed = store.begin()
    killed.append("t", numbers(spark, 99))
    assert held(store.snapshot()) == [1, 2]
    assert store.vacuum(keep=1, age_hours=0) == 2  # the killed writer's part and the replaced one
    assert held(store.snapshot()) == [1, 2] and store.versions() == [2]
    assert len(listing(spark, f"{store.folder}/data/t")) == 2


def test_conflicts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.run(lambda c: c.append("t", numbers(spark, 1)))
    a, b, blind, other = (store.begin() for _ in range(4))
    for change, n in ((a, 2), (b, 3)):
        change.read("t")
        change.append("t", numbers(spark, n))
    blind.append("t", numbers(spark, 4))  # appends without reading: no conflict
    other.read("u") if "u" in other.base.tables else other.has("u")
    other.append("u", numbers(spark, 5))
    a.commit()
    with pytest.raises(Conflict):
        b.commit()
    blind.commit()
    other.commit()
    assert held(store.snapshot()) == [1, 2, 4] and held(store.snapshot(), "u") == [5]
    late = store.begin()
    late.replace("t", numbers(spark, 6))
    store.run(lambda c: c.append("t", numbers(spark, 7)))
    with pytest.raises(Conflict):
        late.commit()


def test_writers_at_once_and_repeated_batches(spark, tmp_path):
    store, gone = Store(spark, str(tmp_path / "s")), []

    def work(n):
        try:
            store.run(lambda c: c.append("t", numbers(spark, n)), attempts=20)
        except Exception as wrong:  # noqa: BLE001
            gone.append(wrong)

    threads = [threading.Thread(target=work, args=(n,)) for n in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not gone and held(store.snapshot()) == list(range(6)) and store.snapshot().version == 6
    for token in (0, 0, 1, 0, 1):
        store.run(lambda c: c.append("t", numbers(spark, 100 + token)), writer="stream", token=token)  # noqa: B023
    assert held(store.snapshot()) == [*range(6), 100, 101]


def test_ingest_changes_page_archive_and_status_together(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    batch = lambda *rows: spark.createDataFrame(list(rows), "url string, content string, seq long")
    store.run(lambda c: ingest.arrive(c, batch(("a", "1", 0), ("a", "2", 1), ("b", "1", 0), (None, "x", 0), ("c", None, 0))))
    store.run(lambda c: ingest.arrive(c, batch(("a", "2", 0), ("b", "2", 0))))
    outcome = spark.createDataFrame([("a", "2", "processed", 1), ("b", "1", "processed", 1)], "url string, content string, status string, seq long")
    store.run(lambda c: ingest.settle(c, outcome))
    assert sorted(map(tuple, ingest.state(store.snapshot()).collect())) == [("a", 1, "2", "processed", 0), ("b", 2, "2", "pending", 1)]
    assert sorted(map(tuple, ingest.state(store.snapshot(1)).collect())) == [("a", 1, "2", "pending", 0), ("b", 1, "1", "pending", 0)]


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(12, size=600)] + 0.2 * rng.normal(size=(600, 16))).round(4)
    return x


def test_vector_index(spark, tmp_path, clustered):
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(clustered)] + [(600, None, 0), (601, [0.0] * 16, 0), (602, [1.0] * 3, 0), (603, [float("nan")] * 16, 0)]
    points = spark.createDataFrame(rows, "id long, v array<double>, kind long")
    folder = str(tmp_path / "ix")
    index = vectors.of_path(points, "id", "v", 16, spark, folder)
    assert vectors.of_path(points.limit(0), "id", "v", 16, spark, folder).at.version == index.at.version == 1  # another session finds it built
    assert index.points([]).count() == 600
    unit = clustered / np.sqrt((clustered**2).sum(1))[:, None]
    asked = points.where("id % 50 = 0 AND id < 600").select(F.col("id").alias("query_id"), "v")
    wanted = {(q, int(k)) for q in range(0, 600, 50) for k in np.argsort(-(unit @ unit[q]), kind="stable")[:20]}
    exact = {(r[0], r[1]) for r in vectors.exact_all(points, "id", "v", asked, "query_id", 16, 20).collect()}
    assert exact == wanted
    found = vectors.search_all(index, asked, "query_id", "v", 20)
    got = {(r["query_id"], r["id"]) for r in found.collect()}
    assert len(got & wanted) >= 0.9 * len(wanted) and index.share < 1
    assert vectors.recall(found, spark.createDataFrame(sorted(wanted), "query_id long, id long"), ["query_id", "id"]) >= 0.9
    one = vectors.search_one(index, clustered[7].tolist(), 5)
    assert one.first()["id"] == 7 and abs(one.first()["score"] - 1) < 1e-9
    text = one._jdf.queryExecution().executedPlan().toString()
    assert text.count("PartitionFilters: [cell#") == 2 and "embedding" not in text  # only the probed cells' files are opened
    assert {r["id"] % 3 for r in vectors.search_one(index, clustered[7].tolist(), 5, where="kind = 1").collect()} == {1}
    with pytest.raises(ValueError):
        vectors.of_path(points, "id", "v", 6, spark, str(tmp_path / "other"))


def test_vector_index_follows_deletions_and_additions(spark, tmp_path, clustered):
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(clustered[:200])], "id long, v array<double>")
    store = Store(spark, str(tmp_path / "ix"))
    store.run(lambda c: vectors.create(c, points, "id", "v", 16, cells=6))
    before = vectors.Index.open(store, "id", "v")
    store.run(lambda c: vectors.delete(c, points.where("id = 7 OR id = 9"), "id"))
    gone = vectors.Index.open(store, "id", "v")
    assert vectors.search_one(before, clustered[7].tolist(), 1).first()["id"] == 7
    assert vectors.search_one(gone, clustered[7].tolist(), 1).first()["id"] != 7 and gone.points([]).count() == 198
    store.run(lambda c: vectors.add(c, points.where("id = 7"), "id", "v", gone.cells, gone.books))
    back = vectors.Index.open(store, "id", "v")
    assert vectors.search_one(back, clustered[7].tolist(), 1).first()["id"] == 7
    store.run(lambda c: vectors.compact(c, back))
    small = vectors.Index.open(store, "id", "v")
    assert small.points([]).count() == 199 and small.at.table("gone").count() == 0 and small.at.table("points").count() == 199
    assert vectors.search_one(small, clustered[7].tolist(), 1).first()["id"] == 7


def test_vector_search_keeps_a_blocks_best_alone(spark, tmp_path, clustered, monkeypatch):
    """What a query's cells send on is its best of each block, however many cells it probes; blocks do not change what is found."""
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(clustered)], "id long, v array<double>")
    index = vectors.of_path(points, "id", "v", 16, spark, str(tmp_path / "ix"))
    asked = points.where("id % 5 = 0").select(F.col("id").alias("query_id"), "v")
    sent, tasks = [], vectors.shares.tasks
    monkeypatch.setattr(vectors.shares, "tasks", lambda spark, rows, most=None: sent.append(rows) or tasks(spark, rows, most))
    search = lambda: sorted((r["query_id"], r["rank"], r["id"]) for r in vectors.search_all(index, asked, "query_id", "v", 3, 1.0, 4).collect())
    whole = search()
    assert sent == [120 * 12] and len(whole) == 360 and len(index.cells) > 12
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 4 * 16 * 50)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 40)
    assert search() == whole and 120 * 12 * 12 <= sent[-1] <= 120 * 12 * 24
    blocks, n = vectors.dealt({0: 5, 1: 5, 2: 25, 3: 1}, 10)
    assert (blocks, n) == ({0: [0], 1: [0], 2: [1, 2, 3], 3: [3]}, 4)
