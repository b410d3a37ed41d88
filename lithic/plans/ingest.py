"""Queries over sources, sinks and streams: fetching, publishing, consuming, lists, lookups."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic import settings
from lithic.catalog import register
from lithic.functions import entities as E
from lithic.functions import text as T
from lithic.sources import fetch, snapshots, tables, workspace
from lithic.sources.tables import table
from lithic.streaming import streams


@register("fetch_recorded", """WITH h AS (SELECT DISTINCT url, md5(url) AS h FROM pages)
SELECT url, CASE left(h, 1) WHEN '0' THEN NULL WHEN '1' THEN 404 WHEN '2' THEN 503 ELSE 200 END AS status, CASE WHEN left(h, 1) NOT IN ('0', '1', '2') THEN left('<html>' || url || ' ' || h || '</html>', 40) END AS html,
CASE left(h, 1) WHEN '0' THEN 'TimeoutError' WHEN '1' THEN 'HTTP 404' WHEN '2' THEN 'HTTP 503' END AS error FROM h""")
def fetch_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetch.fetch(table(spark, sf_dir, "pages").select("url").distinct(), most_bytes=40)


@register("oversized_marks", """SELECT 'skipped:oversized:' || sha256(url) AS marker, url || '|' || strlen(html) || '|2024-02-01T00:00:00Z' AS note FROM pages WHERE strlen(html) > 4000""")
def oversized_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "pages").select(F.col("url").alias("key"), F.col("html").alias("value"))
    return tables.split_oversized(records, 4000, F.lit("2024-02-01 00:00:00").cast("timestamp"))[1].select("marker", "note")


@register("oversized_kept", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-11 12:00:00'")
def oversized_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    return tables.still_kept(marks, F.lit("2024-02-10 12:00:00").cast("timestamp")).select("event_id")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page events as JSON; some are broken, some name no url."""
    e = table(spark, sf_dir, "events")
    good = F.to_json(F.struct(F.concat(F.lit("http://h.example/"), F.col("user_id").cast("string")).alias("url"), F.lit("tor").alias("source_type"), F.col("props").alias("html"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("fetched_at")))
    return e.select("event_id", F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{broken"), F.col("event_id").cast("string"))).when(F.col("event_id") % 10 == 1, F.lit('{"html":"x"}')).otherwise(good).alias("value"))


@register("consumed_events", "SELECT 'http://h.example/' || user_id AS url, props AS html, CAST(date_trunc('second', ts) AS TIMESTAMP) AS fetched_at, count(*) AS n FROM events WHERE event_id % 10 > 1 GROUP BY ALL")
def consumed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = tables.parse_events(_messages(spark, sf_dir).select("value"))[0]
    return good.groupBy("url", "html", F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at")).agg(F.count("*").alias("n"))


@register("dead_letters", """SELECT CASE event_id % 10 WHEN 0 THEN '{broken' || event_id ELSE '{"html":"x"}' END AS value, count(*) AS n FROM events WHERE event_id % 10 <= 1 GROUP BY 1""")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.parse_events(_messages(spark, sf_dir).select("value"))[1].groupBy("value").agg(F.count("*").alias("n"))


@register("published_pages", "SELECT url, md5(html) AS html_md5, count(*) AS n FROM pages GROUP BY ALL")
def published_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages published to a folder of records and consumed from there; no page is too large."""
    folder = workspace.folder(spark, "published")
    pages = table(spark, sf_dir, "pages").select("url", F.lit("tor").alias("source_type"), "html", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("fetched_at"))
    tables.publish(pages, folder, tables.size_limit(settings.DEFAULTS.max_page_mb))
    events = tables.parse_events(spark.read.schema("key string, value string").json(folder).select("value"))[0]
    return events.groupBy("url", F.md5("html").alias("html_md5")).agg(F.count("*").alias("n"))


LINES = {0: "concat('  ', upper(md5(cast(event_id as string))), ' ')", 1: "'# a comment'", 2: "'   '", 3: "concat('abc', event_id)"}


@register("denylist_lines", "SELECT md5(CAST(event_id AS VARCHAR)) AS value FROM events WHERE event_id % 4 = 0")
def denylist_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list written with comments, blanks, bad lines and letter case, read through the loader; a list that is
    not there is empty."""
    folder = workspace.folder(spark, "denylist")
    line = F.expr("CASE event_id % 4 " + " ".join(f"WHEN {k} THEN {sql}" for k, sql in LINES.items()) + " END")
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(folder)
    return tables.read_hashes(spark, folder)[0].unionByName(tables.read_list(spark, folder + "-missing"))


@register("denylist_bad_lines", "SELECT count(*) FILTER (WHERE event_id % 4 = 3) AS bad, count(*) FILTER (WHERE event_id % 4 = 0) AS good FROM events")
def denylist_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workspace.folder(spark, "denylist")
    line = F.expr("CASE event_id % 4 " + " ".join(f"WHEN {k} THEN {sql}" for k, sql in LINES.items()) + " END")
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(folder)
    good, bad = tables.read_hashes(spark, folder)
    return good.agg(F.lit(bad).cast("long").alias("bad"), F.count("*").alias("good"))


@register("point_lookup", "SELECT page_id, url, md5(html) AS html_md5 FROM pages WHERE url = (SELECT min(url) FROM pages)")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    url = pages.agg(F.min("url")).first()[0]
    return tables.lookup(pages, url=url).select("page_id", "url", F.md5("html").alias("html_md5"))


@register("version_lookup", "SELECT l_partkey, l_quantity FROM lineitem WHERE l_orderkey = 7 AND l_linenumber = 2")
def version_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.lookup(table(spark, sf_dir, "lineitem"), l_orderkey=7, l_linenumber=2).select("l_partkey", "l_quantity")


@register("collection_vectors", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def collection_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = snapshots.Store(spark, workspace.folder(spark, "collections"))
    tables.ensure_collection(store, "pages", 64)
    dim = tables.ensure_collection(store, "other", 8)["pages"]
    return tables.check_vectors(table(spark, sf_dir, "embeddings"), "embedding", dim).where(F.size("embedding") > 0).groupBy("label").agg(F.count("*").alias("n"))


_SETTINGS = [f.name for f in dataclasses.fields(settings.Settings)]


@register("settings_loaded", "SELECT c_custkey, c_custkey % 48 + 1 AS dedup_ttl_hours, (c_custkey % 100) / 100.0::DOUBLE AS min_score, " + f"'{settings.DEFAULTS.rrf_k}' AS rrf_k, {len(_SETTINGS)} AS n_settings FROM customer")
def settings_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's settings, read from lines as a file has them."""

    def parsed(batches):
        import pyarrow as pa

        for batch in batches:
            found = [settings.parse(lines) for lines in batch.column("lines").to_pylist()]
            columns = [pa.array([f.dedup_ttl_hours for f in found], pa.int64()), pa.array([f.min_score for f in found]), pa.array([str(f.rrf_k) for f in found]), pa.array([len(dataclasses.asdict(f)) for f in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("c_custkey"), *columns], ["c_custkey", "dedup_ttl_hours", "min_score", "rrf_k", "n_settings"])

    n = F.col("c_custkey")
    lines = F.array(F.lit("crawler:"), F.concat(F.lit("  dedup-ttl-hours: "), (n % 48 + 1).cast("string"), F.lit("  # hours")), F.concat(F.lit("min-score: '"), ((n % 100) / 100).cast("string"), F.lit("'")), F.lit(""))
    rows = table(spark, sf_dir, "customer").select(n.cast("long").alias("c_custkey"), lines.alias("lines"))
    return rows.mapInArrow(parsed, "c_custkey long, dedup_ttl_hours long, min_score double, rrf_k string, n_settings int")


@register("url_forms", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'http://a.example/x?a=1+2&b=%C3%A9~' WHEN 1 THEN 'https://a.example?q=' WHEN 2 THEN 'http://a.example/' WHEN 3 THEN 'http://a.example:8080/p' WHEN 4 THEN 'nothing of a url ' ELSE 'https://a.example/b/c?k=1&k=0' END AS normalized,
CASE event_id % 6 WHEN 0 THEN 'a.example' WHEN 4 THEN 'nothing of a url ' ELSE 'a.example' END AS domain FROM events""")
def url_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = ["HTTP://A.Example:80/X/?b=%c3%a9~&A=1%202&bad=%zz#top", "https://a.example:443?q", "http://a.example/", "http://a.example:8080/p//", "nothing of a url ", "https://a.example/b/c/?k=1&k=0"]
    from lithic.functions import urls

    url = F.element_at(F.array(*[F.lit(f) for f in forms]), (F.col("event_id") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", url.alias("url"))
    return rows.select("event_id", urls.normalize(F.col("url")).alias("normalized"), F.when(F.col("event_id") % 6 == 4, F.col("url")).otherwise(urls.domain(F.col("url"))).alias("domain"))


@register("small_functions", r"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'und' WHEN 1 THEN 'pt' WHEN 2 THEN 'por' WHEN 3 THEN 'en' ELSE 'und' END AS code, CASE doc_id % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 0.25 WHEN 2 THEN 0.5 WHEN 3 THEN 0.75 ELSE 1.0 END AS clamped,
left(text, 8000) = text AS fits, md5(left(text, 8000)) AS capped_md5, CASE doc_id % 5 WHEN 0 THEN 'CryptoWallet' WHEN 1 THEN 'Email' WHEN 2 THEN 'OnionService' WHEN 3 THEN 'Person' ELSE 'PgpFingerprint' END AS label, 'a ' || doc_id || ' b' AS bare FROM documents""")
def small_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % 5 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents")
    capped = F.left("text", F.lit(settings.DEFAULTS.model_chars))
    tagged = F.concat(F.lit("a <source id='1'>"), F.col("doc_id").cast("string"), F.lit("</SOURCE> b"))
    return docs.select("doc_id", T.language_code(pick(None, " PT ", "por", "EN-us", "  ")).alias("code"), T.clamp((F.col("doc_id") % 5 - 0).cast("double") * 0.5 - 0.25 * (F.col("doc_id") % 5)).alias("clamped"), (capped == F.col("text")).alias("fits"), F.md5(capped).alias("capped_md5"), E.label(pick("crypto_wallet", "EMAIL", "onion_service", "person", "pgp_fingerprint")).alias("label"), T.strip_source_tags(tagged).alias("bare"))


# streams over the event table, written as files of messages first


def _folder_of_messages(spark: SparkSession, sf_dir: str) -> str:
    folder = workspace.folder(spark, "messages")
    _messages(spark, sf_dir).select("value").repartition(4).write.text(folder)
    return folder


@register("stream_consumed", "SELECT 'http://h.example/' || user_id AS url, count(*) AS n FROM events WHERE event_id % 10 > 1 GROUP BY 1")
def stream_consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream and written once each, though the sink is told of a batch twice."""
    folder = _folder_of_messages(spark, sf_dir)
    streams.drain(streams.read_events(spark, folder, 1), folder + "-out", folder + "-state", deliveries=2)
    return spark.read.parquet(folder + "-out").groupBy("url").agg(F.count("*").alias("n"))


@register("stream_minute_usage", "SELECT 'http://h.example/' || user_id AS url, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS start, count(*) AS requests FROM events WHERE event_id % 10 > 1 GROUP BY ALL")
def stream_minute_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder_of_messages(spark, sf_dir)
    usage = streams.minute_usage(streams.read_events(spark, folder), "fetched_at", ["url"])
    streams.drain(usage, folder + "-out", folder + "-state", mode="update")
    return streams.latest(spark, folder + "-out", ["window", "url"]).select("url", F.col("window.start").cast("timestamp_ntz").alias("start"), "requests")


@register("stream_newest", "SELECT 'http://h.example/' || user_id AS url, max(date_trunc('second', ts)) AS version FROM events WHERE event_id % 10 > 1 GROUP BY 1")
def stream_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder_of_messages(spark, sf_dir)
    newest = streams.newest_versions(streams.read_events(spark, folder, 1), "url", "fetched_at")
    streams.drain(newest, folder + "-out", folder + "-state", mode="update")
    return streams.latest(spark, folder + "-out", ["url"]).select("url", F.col("fetched_at").cast("timestamp_ntz").alias("version"))


@register("stream_dedup_ttl", """
WITH RECURSIVE e AS (SELECT user_id, date_trunc('second', ts) AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM (SELECT DISTINCT user_id, date_trunc('second', ts) AS ts FROM events WHERE event_id % 10 > 1)),
f(user_id, ts, i, kept, keep) AS (SELECT user_id, ts, i, ts, true FROM e WHERE i = 1
 UNION ALL SELECT e.user_id, e.ts, e.i, CASE WHEN e.ts >= f.kept + INTERVAL 6 HOUR THEN e.ts ELSE f.kept END, e.ts >= f.kept + INTERVAL 6 HOUR FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT 'http://h.example/' || user_id AS url, CAST(ts AS TIMESTAMP) AS fetched_at FROM f WHERE keep""")
def stream_dedup_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's filter gives the batch's rows."""
    folder = _folder_of_messages(spark, sf_dir)
    kept = streams.distinct_pages(streams.read_events(spark, folder))
    streams.drain(kept, folder + "-out", folder + "-state")
    return streams.written(spark, folder + "-out").select("url", F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"))
