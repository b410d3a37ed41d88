"""The incremental graph equals a rebuild after every batch."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lithic.operators import graph, graphstore
from lithic.sources.snapshots import Store

SCHEMA = "url string, version long, ai_status string, entities array<struct<type:string,key:string,display:string,confidence:double>>"


def batches(seed):
    rng, version = random.Random(seed), 0
    for _ in range(3):
        rows = []
        for _ in range(12):
            version += 1
            keys = rng.sample(range(6), rng.randint(0, 4))
            rows.append((f"http://h{rng.randrange(2)}/{rng.randrange(5)}", version - rng.choice([0, 0, 9]), rng.choice(["processed"] * 4 + ["pending"]), [("person", str(k), f"D{k}-{version}", 0.9) for k in keys]))
        yield rows


def state(rows):
    return sorted(map(tuple, rows.collect()))


def test_equals_a_rebuild_after_every_batch(spark, tmp_path):
    store, seen = Store(spark, str(tmp_path / "g")), {}
    for number, rows in enumerate(batches(4)):
        rows = [r for r in {(r[0], r[1]): r for r in rows}.values() if (r[0], r[1]) not in seen]
        seen |= {(r[0], r[1]): r for r in rows}
        for _ in range(2):
            store.run(lambda c: graphstore.update(c, spark.createDataFrame(rows, SCHEMA)), writer="g", token=number)  # noqa: B023
        if number == 1:
            store.run(graphstore.compact)
        now = store.snapshot()
        mentions, entities, hosts = graph.rebuild(spark.createDataFrame(list(seen.values()), SCHEMA))
        assert state(graphstore.mentions(now).select(mentions.columns)) == state(mentions)
        assert state(graphstore.entities(now).select(entities.columns)) == state(entities)
        assert state(graphstore.hosts(now).select(hosts.columns)) == state(hosts)
        shared = graph.related(mentions.withColumn("e", F.concat_ws(" ", "type", "key")), "url", "e", 100).where("e < other").select("e", "other", "shared")
        pairs = graphstore.cooccurring(now).select(F.concat_ws(" ", "type", "key"), F.concat_ws(" ", "other_type", "other_key"), "shared")
        assert state(pairs) == state(shared)
    assert store.snapshot().version == 4


def test_a_batch_counts_on_from_what_is_known(spark, tmp_path, monkeypatch):
    """Mentions of untouched pages are read for an entity that lost the mention it shows, and for no other."""
    store, read = Store(spark, str(tmp_path / "g")), []
    page = lambda url, version, *keys: (url, version, "processed", [("person", k, f"{k}{version}", c) for k, c in keys])
    many = [page("http://h/1", 1, ("a", 0.9), ("b", 0.9)), page("http://h/2", 2, ("a", 0.5), ("a", 0.7), (None, 0.9)), page("http://i/3", 3, ("b", 0.9)), page(None, 9, ("a", 0.9))]
    shown = graphstore._shown
    monkeypatch.setattr(graphstore, "_shown", lambda pages, *of: read.append(pages.count()) or shown(pages, *of))

    def take(*rows):
        read.clear()
        store.run(lambda c: graphstore.update(c, spark.createDataFrame(rows, SCHEMA)))
        return {(r.key, r.display, r.pages) for r in graphstore.entities(store.snapshot()).collect()}, max(read)

    assert take(*many) == ({("a", "a2", 2), ("b", "b3", 2), (None, "None2", 1)}, 3)
    assert take(page("http://h/1", 4, ("a", 0.9))) == ({("a", "a4", 2), ("b", "b3", 1), (None, "None2", 1)}, 1)
    assert take(page("http://h/1", 5), page("http://i/4", 1, ("b", 0.9))) == ({("a", "a2", 1), ("b", "b3", 2), (None, "None2", 1)}, 4)
    assert take(page("http://i/3", 6), page("http://h/2", 7)) == ({("b", "b1", 1)}, 4)
    assert state(graphstore.hosts(store.snapshot())) == [("i", 1)]
