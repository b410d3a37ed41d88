"""Stateful streams written to files: what they keep, and that they go on after a restart."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lithic.streaming import streams


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    start = dt.datetime(2024, 1, 1)
    lines = [f'{{"url": "{url}", "html": "p", "fetched_at": "{(start + dt.timedelta(hours=h)).isoformat()}Z"}}' for url, h in rows]
    (folder / name).write_text("\n".join([*lines, "broken"]))


def hours(rows):
    return sorted((r["url"], round((r["fetched_at"].replace(tzinfo=None) - dt.datetime(2024, 1, 1)).total_seconds() / 3600, 2)) for r in rows.collect())


def test_filter_restarts_and_forgets(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    read = lambda: streams.distinct_pages(streams.read_events(spark, str(source)), 6)
    put(source, "a.txt", [("http://h/a#x", 0), ("http://h/a", 5.9), ("http://h/a", 6.5), ("http://h/b", 1), ("http://h/b", 1)])
    streams.drain(read(), out, state)
    assert hours(streams.written(spark, out)) == [("http://h/a", 6.5), ("http://h/a#x", 0), ("http://h/b", 1)]
    put(source, "b.txt", [("http://h/a", 12), ("http://h/a", 12.5), ("http://h/b", 7.2), ("http://h/c", 40)])
    streams.drain(read(), out, state)  # a restart on the same checkpoint knows what was kept
    want = [("http://h/a", 6.5), ("http://h/a", 12.5), ("http://h/a#x", 0), ("http://h/b", 1), ("http://h/b", 7.2), ("http://h/c", 40)]
    assert hours(streams.written(spark, out)) == want
    put(source, "c.txt", [("http://h/b", 41)])
    streams.drain(read(), out, state)
    assert hours(streams.written(spark, out)) == sorted([*want, ("http://h/b", 41)])


def test_newest_rises_only(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    read = lambda: streams.newest_versions(streams.read_events(spark, str(source)), "url", "fetched_at")
    put(source, "a.txt", [("a", 3), ("a", 1), ("b", 2)])
    streams.drain(read(), out, state, deliveries=2, mode="update")
    put(source, "b.txt", [("a", 2), ("b", 5), ("c", 0)])
    streams.drain(read(), out, state, mode="update")
    assert hours(streams.latest(spark, out, ["url"])) == [("a", 3), ("b", 5), ("c", 0)]
    assert sorted(r["url"] for r in spark.read.parquet(out).where("batch = 1").collect()) == ["b", "c"]


def test_usage_updates(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    read = lambda: streams.minute_usage(streams.read_events(spark, str(source)), "fetched_at", ["url"])
    put(source, "a.txt", [("a", 0), ("a", 0.001), ("b", 0)])
    streams.drain(read(), out, state, mode="update")
    put(source, "b.txt", [("a", 0.002), ("a", 1)])
    streams.drain(read(), out, state, mode="update")
    rows = streams.latest(spark, out, ["window", "url"]).select("url", F.hour("window.start").alias("h"), "requests").collect()
    assert sorted(map(tuple, rows)) == [("a", 0, 3), ("a", 1, 1), ("b", 0, 1)]


def test_liveness(spark, tmp_path):
    put(tmp_path / "in", "a.txt", [("a", k) for k in range(9)])
    query = streams.read_events(spark, str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "live")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert streams.liveness(query) == {"active": False, "batch": 0, "rows": 10}


def test_newest_is_an_aggregate_and_an_equal_version_gives_none(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    read = lambda: streams.newest_versions(streams.read_events(spark, str(source)), "url", "fetched_at")
    source.mkdir()
    assert "TransformWithState" not in read()._jdf.queryExecution().logical().toString()
    for name, rows in (("a.txt", [("a", 3), ("b", 1)]), ("b.txt", [("a", 3), ("b", 1.5)]), ("c.txt", [("a", 3), ("b", 1.5)])):
        put(source, name, rows)
        streams.drain(read(), out, state, mode="update")
    assert [sorted(r["url"] for r in spark.read.parquet(out).where(f"batch = {k}").collect()) for k in (0, 1)] == [["a", "b"], ["b"]]
    assert spark.read.parquet(out).where("batch > 1").count() == 0


def test_filter_makes_no_frame_for_a_key_and_keeps_an_untimed_event(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    read = lambda: streams.distinct_pages(streams.read_events(spark, str(source)), 6)
    put(source, "a.txt", [("http://h/a", 3), ("http://h/a", 1), ("http://h/b", 2)])
    (source / "b.txt").write_text('{"url": "http://h/c", "html": "p"}\n{"url": "http://h/c", "html": "p"}\n')
    assert "InPandas" not in read()._jdf.queryExecution().analyzed().toString()
    streams.drain(read(), out, state)
    assert sorted((r["url"], r["fetched_at"] is None) for r in streams.written(spark, out).collect()) == [("http://h/a", False), ("http://h/b", False), ("http://h/c", True)]
