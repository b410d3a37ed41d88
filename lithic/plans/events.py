"""Queries over the event log: versions, changes, quotas, time windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithic.catalog import register
from lithic.operators import agents, bloom, changes, quota, versions
from lithic.sources import buckets
from lithic.sources.tables import table

NUMBERED = """
WITH c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
n AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS version FROM c)
"""


@register("versions_number", NUMBERED + "SELECT user_id, event_id, version FROM n")
def versions_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.numbered(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id").select("user_id", "event_id", "version")


@register("versions_current", NUMBERED + "SELECT user_id, max(version) AS version, max_by(event_type, event_id) AS event_type, min(ts) AS first_seen_at, max(ts) AS last_seen_at FROM n GROUP BY user_id")
def versions_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.current(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id", "ts")


@register("versions_dedup", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def versions_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.one_per_key(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@register("as_of_baseline", NUMBERED + """,
v AS (SELECT user_id, version, bool_or(event_type IN ('click', 'purchase')) AS enriched FROM n GROUP BY 1, 2),
l AS (SELECT user_id, max(version) AS version FROM v GROUP BY 1),
j AS (SELECT l.user_id, l.version, v.version AS base_version, v.enriched AS base_enriched, row_number() OVER (PARTITION BY l.user_id ORDER BY v.enriched DESC, v.version DESC) AS place FROM l JOIN v ON v.user_id = l.user_id AND v.version < l.version)
SELECT user_id, version, base_version, base_enriched FROM j WHERE place = 1""")
def as_of_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = versions.numbered(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")
    archive = rows.groupBy("user_id", "version").agg(F.bool_or(F.col("event_type").isin("click", "purchase")).alias("enriched"))
    latest = archive.groupBy("user_id").agg(F.max("version").alias("version"))
    return versions.baseline(latest, archive, "user_id")


CHANGES = "SELECT event_id AS id, event_type, ts AS detected_at FROM events WHERE event_type <> 'view' AND ts >= TIMESTAMP '2024-01-10 00:00:00'"
START, NOW = dt.datetime(2024, 1, 10), dt.datetime(2024, 2, 1)


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("id"), "event_type", F.col("ts").alias("detected_at"), F.when(F.col("event_type") == "view", "trivial").otherwise("pending").alias("status"), F.lit("forum").alias("category_to"))


@register("changes_query", CHANGES + " ORDER BY detected_at DESC, id DESC LIMIT 100")
def changes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.since(_changes(spark, sf_dir), START, NOW, ["forum"])[1].select("id", "event_type", "detected_at")


@register("changes_total", f"SELECT count(*) AS total FROM ({CHANGES})")
def changes_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.since(_changes(spark, sf_dir), START, NOW)[0]


def _usage(unit: str) -> str:
    return f"SELECT event_type AS provider, date_trunc('{unit}', ts) AS bucket, count(*) AS requests, CAST(sum(CAST(floor(abs(value)) AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY ALL"


def _used(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), "ts", F.floor(F.abs("value")).alias("tokens"))
    return quota.usage(log, "provider", "ts", "tokens", unit).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@register("quota_minute", _usage("minute"))
def quota_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _used(spark, sf_dir, "minute")


@register("quota_day", _usage("day").replace("date_trunc('day', ts)", "CAST(date_trunc('day', ts) AS TIMESTAMP)"))
def quota_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _used(spark, sf_dir, "day")


@register("quota_binding", """
WITH m AS (SELECT event_type AS provider, date_trunc('day', ts) AS d, date_trunc('hour', ts) AS h, count(*) AS used FROM events GROUP BY ALL),
t AS (SELECT provider, d, sum(used) AS day_used FROM m GROUP BY ALL)
SELECT m.provider, CAST(m.h AS TIMESTAMP) AS bucket, CAST(least(greatest(0, 15 - used), greatest(0, 500 - day_used)) AS BIGINT) AS remaining, CAST(CASE WHEN greatest(0, 15 - used) <= greatest(0, 500 - day_used) THEN 15 ELSE 500 END AS INTEGER) AS quota_limit FROM m JOIN t ON t.provider = m.provider AND t.d = m.d""")
def quota_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = _used(spark, sf_dir, "hour").select("provider", "bucket", F.col("requests").alias("used"), F.date_trunc("day", "bucket").alias("day"))
    days = hours.groupBy("provider", "day").agg(F.sum("used").alias("day_used"))
    remaining, limit = quota.binding(F.lit(15), F.col("used"), F.lit(500), F.col("day_used"))
    return hours.join(days, ["provider", "day"]).select("provider", "bucket", remaining.alias("remaining"), limit.alias("quota_limit"))


@register("circuit_breaker", """
WITH RECURSIVE e AS (SELECT user_id, event_id, ts, event_type = 'error' OR value < 40 AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f(user_id, event_id, i, fails, until_, allowed) AS (SELECT user_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 0, CAST(NULL AS TIMESTAMP), true FROM e WHERE i = 1
 UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN e.ts < f.until_ THEN f.fails WHEN NOT bad OR f.until_ IS NOT NULL OR f.fails + 1 > 3 THEN 0 ELSE f.fails + 1 END,
  CASE WHEN e.ts < f.until_ THEN f.until_ WHEN bad AND (f.until_ IS NOT NULL OR f.fails + 1 > 3) THEN e.ts + INTERVAL 30000 SECOND END, e.ts < f.until_ IS NOT TRUE
  FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, event_id, allowed FROM f WHERE i > 0""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.coalesce((F.col("event_type") == "error") | (F.col("value") < 40), F.lit(False)).alias("failed"))
    return quota.breaker(rows, "user_id", "ts", "event_id", "failed", open_seconds=30_000).select("user_id", "event_id", "allowed")


@register("circuit_breaker_hot", """
WITH RECURSIVE e AS (SELECT user_id % 4 AS host, event_id, ts, event_type = 'error' OR value < 40 AS bad, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS i FROM events),
f(host, event_id, i, fails, until_, allowed) AS (SELECT host, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 0, CAST(NULL AS TIMESTAMP), true FROM e WHERE i = 1
 UNION ALL SELECT e.host, e.event_id, e.i, CASE WHEN e.ts < f.until_ THEN f.fails WHEN NOT bad OR f.until_ IS NOT NULL OR f.fails + 1 > 3 THEN 0 ELSE f.fails + 1 END,
  CASE WHEN e.ts < f.until_ THEN f.until_ WHEN bad AND (f.until_ IS NOT NULL OR f.fails + 1 > 3) THEN e.ts + INTERVAL 3000 SECOND END, e.ts < f.until_ IS NOT TRUE
  FROM f JOIN e ON e.host = f.host AND e.i = f.i + 1)
SELECT host, event_id, allowed FROM f WHERE i > 0""")
def circuit_breaker_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four hosts have all rows, and each is gone through by many tasks."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("host"), "event_id", "ts", F.coalesce((F.col("event_type") == "error") | (F.col("value") < 40), F.lit(False)).alias("failed"))
    return quota.breaker(rows, "host", "ts", "event_id", "failed", open_seconds=3_000, hot=100).select("host", "event_id", "allowed")


@register("provider_parks", """WITH p AS (SELECT event_type AS provider, CASE WHEN event_type = 'error' AND value > 300 THEN NULL WHEN value > 100 THEN CAST(date_trunc('day', ts - INTERVAL 8 HOUR) + INTERVAL 32 HOUR AS TIMESTAMP) ELSE date_trunc('minute', ts) + INTERVAL 1 MINUTE END AS until_, event_type = 'error' AND value > 300 AS good FROM events WHERE ts <= TIMESTAMP '2024-01-20 12:00:00')
SELECT provider, CASE WHEN NOT bool_or(good) THEN max(until_) END AS until FROM p GROUP BY provider HAVING bool_or(good) OR max(until_) > TIMESTAMP '2024-01-20 12:00:00'""")
def provider_parks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when((F.col("event_type") == "error") & (F.col("value") > 300), "balance").when(F.col("value") > 100, "day").otherwise("minute")
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), F.col("ts").cast("timestamp").alias("at"), kind.alias("window"))
    return quota.parked(log, F.lit("2024-01-20 12:00:00").cast("timestamp")).select("provider", F.col("until").cast("timestamp_ntz").alias("until"))


@register("paced_fetches", "SELECT event_id, floor((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / 2) * 1.5 AS wait FROM events")
def paced_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.paced(table(spark, sf_dir, "events"), "user_id", "event_id", 1.5).select("event_id", "wait")


@register("daily_starts", "SELECT event_id, CAST(CASE WHEN ts < date_trunc('day', ts) + INTERVAL 6 HOUR THEN date_trunc('day', ts) + INTERVAL 6 HOUR ELSE date_trunc('day', ts) + INTERVAL 30 HOUR END AS TIMESTAMP) AS starts_at FROM events")
def daily_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", quota.next_daily(F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("starts_at"))


@register("consumers_stalled", "SELECT user_id AS consumer, max(ts) AS last, max(ts) < TIMESTAMP '2024-01-30 20:00:00' - INTERVAL 60 MINUTE AS stalled FROM events GROUP BY 1")
def consumers_stalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("consumer"), F.col("ts").alias("at"))
    return quota.stalled(rows, F.lit("2024-01-30 20:00:00").cast("timestamp_ntz"), 60)


@register("router", """WITH c AS (SELECT event_id AS call_id, CAST(floor(value) AS BIGINT) * 40 AS est, event_type = 'click' AS interactive, event_type AS tried FROM events),
q(step, provider, remaining, lim, tleft, tlim) AS (VALUES (0, 'view', 4, 15, 9000, 250000), (1, 'click', 3, 15, 200000, 250000), (2, 'error', 15, 15, 12000, 12000)),
o AS (SELECT call_id, min_by(provider, step) AS provider FROM c, q WHERE provider <> tried AND remaining > (lim * CASE WHEN interactive THEN 5 ELSE 35 END) // 100 AND tleft - est > (tlim * CASE WHEN interactive THEN 5 ELSE 35 END) // 100 GROUP BY 1)
SELECT c.call_id, o.provider FROM c LEFT JOIN o ON o.call_id = c.call_id""")
def router(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), (F.floor("value") * 40).alias("estimate"), (F.col("event_type") == "click").alias("interactive"), F.array("event_type").alias("tried"))
    quotas = spark.createDataFrame([("view", 4, 15, 9000, 250000), ("click", 3, 15, 200000, 250000), ("error", 15, 15, 12000, 12000)], "provider string, remaining long, limit long, tokens_left long, token_limit long")
    return quota.route(calls, ["view", "click", "error"], quotas).select("call_id", "provider")


@register("pacific_midnights_in_summer", "SELECT event_id, CAST(date_trunc('day', ts + INTERVAL 170 DAY - INTERVAL 7 HOUR) + INTERVAL 31 HOUR AS TIMESTAMP) AS reset_at FROM events")
def pacific_midnights_in_summer(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts").cast("timestamp") + F.expr("INTERVAL 170 DAY")
    return table(spark, sf_dir, "events").select("event_id", quota.next_pacific_midnight(at).cast("timestamp_ntz").alias("reset_at"))


@register("dedup_ttl", """
WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f(user_id, event_id, i, kept, keep) AS (SELECT user_id, event_id, i, ts, true FROM e WHERE i = 1
 UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN e.ts >= f.kept + INTERVAL 6 HOUR THEN e.ts ELSE f.kept END, e.ts >= f.kept + INTERVAL 6 HOUR FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, event_id FROM f WHERE keep""")
def dedup_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return versions.seen_within(rows, "user_id", "ts").select("user_id", "event_id")


@register("dedup_ttl_hot", """
WITH RECURSIVE e AS (SELECT event_id, ts FROM events), f(event_id, ts) AS (SELECT arg_min(event_id, (ts, event_id)), min(ts) FROM e
 UNION ALL SELECT event_id, ts FROM (SELECT e.event_id, e.ts FROM f JOIN e ON e.ts >= f.ts + INTERVAL 6 HOUR ORDER BY e.ts, e.event_id LIMIT 1))
SELECT event_id FROM f""")
def dedup_ttl_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key has all rows, and is gone through by many tasks."""
    rows = table(spark, sf_dir, "events").select(F.lit("all").alias("key"), "event_id", "ts")
    return versions.seen_within(rows, "key", "ts", hot=100).select("event_id")


@register("once_per_day", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) = 1")
def once_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agents.once_per_day(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id")


@register("metrics_summary", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.metrics(table(spark, sf_dir, "events"), ["event_type"], "value")


@register("json_projection", "SELECT event_id, json_extract_string(props, '$.k') AS k_text, coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k FROM events")
def json_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k_text"), F.coalesce(k.try_cast("double"), F.lit(0.0)).alias("k"))


@register("events_tumbling", "SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, count(*) AS n FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy("event_type", F.window("ts", "1 hour")).agg(F.count("*").alias("n")).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@register("events_sliding", """
WITH w AS (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events)
SELECT event_type, CAST(start AS TIMESTAMP) AS start, count(*) AS n FROM w GROUP BY ALL""")
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy("event_type", F.window("ts", "2 hours", "1 hour")).agg(F.count("*").alias("n")).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@register("events_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@register("as_of_previous_purchase", """SELECT e.event_id, max(p.event_id) AS purchase_id FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.event_id < e.event_id GROUP BY e.event_id""")
def as_of_previous_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    purchase = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", F.max(purchase).over(before).alias("purchase_id"))


@register("pacific_midnights", "SELECT event_id, CAST(date_trunc('minute', ts) + INTERVAL 1 MINUTE AS TIMESTAMP) AS next_minute, CAST(date_trunc('day', ts - INTERVAL 8 HOUR) + INTERVAL 1 DAY + INTERVAL 8 HOUR AS TIMESTAMP) AS reset_at FROM events")
def pacific_midnights(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", quota.next_minute(at).cast("timestamp_ntz").alias("next_minute"), quota.next_pacific_midnight(at).cast("timestamp_ntz").alias("reset_at"))


@register("seen_bloom", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def seen_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that were not seen; only those that a bit array does not know to be new are shuffled."""
    seen = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return bloom.unseen(table(spark, sf_dir, "orders").select("o_orderkey"), seen, "o_orderkey")


@register("bucketed_joins", "SELECT d.doc_id, count(DISTINCT l.quality) AS qualities, count(e.vec_id) AS points FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY d.doc_id")
def bucketed_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, verdicts and points by one key, dealt alike once: two joins and a count without a shuffle."""
    docs, labels, points = (buckets.put(table(spark, sf_dir, name).select(F.col(key).alias("doc_id"), *more), "doc_id", 16, name) for name, key, more in (("documents", "doc_id", []), ("labels", "doc_id", ["quality"]), ("embeddings", "vec_id", [F.lit(1).alias("point")])))
    joined = buckets.meet(buckets.meet(docs, labels, "doc_id", "left"), points, "doc_id", "left")
    return joined.groupBy("doc_id").agg(F.countDistinct("quality").alias("qualities"), F.count("point").alias("points"))


@register("confidence_distribution", """SELECT event_type, CASE WHEN value < 25 THEN 25.0::DOUBLE WHEN value < 50 THEN 50.0::DOUBLE WHEN value < 100 THEN 100.0::DOUBLE END AS below, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY event_type), 6) AS share
FROM events WHERE value IS NOT NULL GROUP BY 1, 2""")
def confidence_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.distribution(table(spark, sf_dir, "events"), ["event_type"], "value", [25, 50, 100]).withColumn("share", F.round("share", 6))


@register("quota_gauges", """WITH t AS (SELECT max(ts) AS now FROM events), l AS (SELECT DISTINCT event_type AS provider, w AS window, CASE w WHEN 'minute' THEN 3 ELSE 100 END AS requests, CASE w WHEN 'minute' THEN 120 ELSE 4000 END AS tokens FROM events, (VALUES ('minute'), ('day')) x(w)),
u AS (SELECT event_type AS provider, w AS window, count(*) AS n, sum(CAST(floor(value) AS BIGINT)) AS spent FROM events, t, (VALUES ('minute'), ('day')) x(w) WHERE date_trunc(w, ts) = date_trunc(w, now) GROUP BY 1, 2)
SELECT l.provider, l.window, greatest(0, requests - coalesce(n, 0)) AS requests_left, greatest(0, tokens - coalesce(spent, 0)) AS tokens_left FROM l LEFT JOIN u ON u.provider = l.provider AND u.window = l.window""")
def quota_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each provider's current minute and day have left at the last event."""
    log = table(spark, sf_dir, "events").select("event_type", "ts", F.floor("value").alias("tokens"))
    pairs = [("minute", 3, 120), ("day", 100, 4_000)]
    limits = log.select(F.col("event_type").alias("provider"), F.explode(F.array(*[F.struct(F.lit(w).alias("window"), F.lit(r).alias("requests"), F.lit(t).alias("tokens")) for w, r, t in pairs])).alias("l")).distinct().select("provider", "l.*")
    return quota.gauges(log, "event_type", "ts", "tokens", limits, F.lit(log.agg(F.max("ts")).first()[0]))
