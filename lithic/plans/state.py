"""Queries over page state: versions, statuses, archives, changes, quarantine and deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithic.catalog import register
from lithic.operators import agents, guard, ingest, state, versions
from lithic.sources import snapshots, workspace
from lithic.sources.tables import table

#: events as a page log: purchases and errors are outcomes, some on outdated contents, signups wait for quota.
LOG = """WITH raw AS (SELECT user_id AS url, event_id AS seq, ts AS at_, CASE WHEN event_type IN ('view', 'click') THEN 'page' ELSE 'outcome' END AS kind,
  CASE event_type WHEN 'purchase' THEN 'processed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'waiting' END AS status, CAST(CAST(floor(value / 25) AS BIGINT) AS VARCHAR) AS v FROM events),
lg AS (SELECT *, last_value(CASE WHEN kind = 'page' THEN v END IGNORE NULLS) OVER (PARTITION BY url ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM raw),
fl AS (SELECT url, seq, at_, kind, CASE WHEN kind = 'page' THEN v WHEN seq % 7 = 0 THEN 'old' ELSE before END AS content, status, CASE WHEN status = 'processed' THEN 'n' || seq END AS note,
  kind = 'page' AND v IS DISTINCT FROM before AS fresh, coalesce(kind = 'outcome' AND seq % 7 <> 0 AND before IS NOT NULL, false) AS applied FROM lg),
rp AS (SELECT *, CAST(sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY url ORDER BY seq) AS BIGINT) AS version FROM fl),
vs AS (SELECT url, version, min_by(content, CASE WHEN kind = 'page' THEN seq END) AS content, min(CASE WHEN kind = 'page' THEN at_ END) AS recorded_at,
  count(*) FILTER (WHERE applied AND status = 'failed') AS attempts, max_by(status, seq) FILTER (WHERE applied AND status <> 'waiting') AS last, max_by(note, seq) FILTER (WHERE applied AND status = 'processed') AS note
  FROM rp WHERE version > 0 GROUP BY url, version),
st AS (SELECT *, CASE WHEN last IS NULL THEN 'pending' WHEN last = 'failed' THEN CASE WHEN attempts >= 5 THEN 'failed_permanent' ELSE 'failed_transient' END ELSE last END AS ai_status FROM vs),
pg AS (SELECT url, max(version) AS version, max_by(content, version) AS content, max_by(ai_status, version) AS ai_status, max_by(attempts, version) AS attempts, max_by(note, version) FILTER (WHERE note IS NOT NULL) AS note FROM st GROUP BY url)
"""


def page_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    raw = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("url"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.when(kind.isin("view", "click"), "page").otherwise("outcome").alias("kind"),
        F.when(kind == "purchase", "processed").when(kind == "error", "failed").when(kind == "signup", "waiting").alias("status"), F.floor(F.col("value") / 25).cast("string").alias("v"),
    )
    before = F.last(F.when(F.col("kind") == "page", F.col("v")), ignorenulls=True).over(Window.partitionBy("url").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    content = F.when(F.col("kind") == "page", F.col("v")).when(F.col("seq") % 7 == 0, "old").otherwise(before)
    return raw.withColumn("content", content).withColumn("note", F.when(F.col("status") == "processed", F.concat(F.lit("n"), F.col("seq").cast("string")))).drop("v")


@register("page_state", LOG + ", sn AS (SELECT user_id AS url, min(ts) AS first_seen_at, max(ts) AS last_seen_at FROM events WHERE event_type IN ('view', 'click') GROUP BY 1) SELECT pg.url, version, content, ai_status, attempts, note, first_seen_at, last_seen_at FROM pg JOIN sn ON sn.url = pg.url")
def page_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.pages_of(page_log(spark, sf_dir))


@register("page_archive", LOG + "SELECT url, version, content, recorded_at, CASE WHEN ai_status = 'processed' THEN note END AS note FROM st QUALIFY version < max(version) OVER (PARTITION BY url)")
def page_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.archive_of(page_log(spark, sf_dir))


@register("page_attempts", LOG + "SELECT url, version, attempts, ai_status FROM st")
def page_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.versions_of(page_log(spark, sf_dir)).select("url", "version", "attempts", "ai_status")


@register("page_backlog", LOG + "SELECT url, version, ai_status FROM pg WHERE ai_status IN ('pending', 'failed_transient') ORDER BY url LIMIT 20")
def page_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.backlog(state.pages_of(page_log(spark, sf_dir))).select("url", "version", "ai_status")


@register("page_totals", LOG + "SELECT (SELECT count(*) FROM pg) AS pages, (SELECT count(*) FROM st) AS versions, (SELECT count(*) FROM pg WHERE ai_status IN ('pending', 'failed_transient')) AS waiting")
def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = page_log(spark, sf_dir)
    found = state.versions_of(log).groupBy("url").agg(F.count("*").alias("v"), F.max_by("ai_status", "version").alias("s"))
    return found.agg(F.count("*").alias("pages"), F.sum("v").alias("versions"), F.count(F.when(F.col("s").isin("pending", "failed_transient"), 1)).alias("waiting"))


@register("optimistic_outcomes", "SELECT d.doc_id, md5(d.text) AS content_hash FROM documents d JOIN documents e ON d.doc_id = e.doc_id AND (d.doc_id % 3 <> 0 OR d.lang = 'en')")
def optimistic_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("url"), F.md5("text").alias("content_hash"), "lang")
    stale = F.when((F.col("url") % 3 != 0) | (F.col("lang") == "en"), F.col("content_hash")).otherwise(F.lit("old"))
    return state.up_to_date(docs.select("url", stale.alias("content_hash")), docs).select(F.col("url").alias("doc_id"), "content_hash")


@register("content_gate_processed", "SELECT doc_id, md5(text) AS content_hash FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id % 5 <> 0)")
def content_gate_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("url"), F.md5("text").alias("content_hash"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("url"), "quality")
    done = docs.join(labels, "url").select("url", F.when(F.col("url") % 5 == 0, "changed").otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("quality") == 1, "processed").otherwise("pending").alias("ai_status"))
    return versions.not_enriched(docs, done).select(F.col("url").alias("doc_id"), "content_hash")


@register("status_transitions", """SELECT event_id, CASE event_type WHEN 'purchase' THEN 'processed' WHEN 'click' THEN 'quarantined' WHEN 'error' THEN CASE WHEN user_id % 6 + 1 >= 5 THEN 'failed_permanent' ELSE 'failed_transient' END ELSE 'pending' END AS status,
CAST(user_id % 6 + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS attempts FROM events""")
def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    outcome = F.when(kind == "purchase", "processed").when(kind == "click", "quarantined").when(kind == "error", "failed").otherwise("waiting")
    status, attempts = versions.next_status(F.lit("pending"), outcome, F.col("user_id") % 6)
    return table(spark, sf_dir, "events").select("event_id", status.alias("status"), attempts.alias("attempts"))


@register("change_attempts", """WITH o AS (SELECT user_id AS id, event_id AS seq, event_type = 'purchase' AS ok FROM events WHERE event_type IN ('purchase', 'error')),
e AS (SELECT *, coalesce(max(CAST(ok AS INTEGER)) OVER w, 0) = 1 OR coalesce(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER w, 0) >= 3 AS ended FROM o WINDOW w AS (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT id, CASE WHEN bool_or(ok) THEN 'summarized' WHEN count(*) >= 3 THEN 'failed_permanent' ELSE 'failed_transient' END AS status, count(*) AS attempts FROM e WHERE NOT ended GROUP BY id""")
def change_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'error')")
    return state.change_status(rows.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("ok")))


@register("batch_until_quota", """WITH o AS (SELECT event_id // 20 AS batch, event_id, max(CAST(event_type = 'error' AND value > 150 AS INTEGER)) OVER (PARTITION BY event_id // 20 ORDER BY event_id) AS out_ FROM events) SELECT CAST(batch AS BIGINT) AS batch, event_id FROM o WHERE out_ = 0""")
def batch_until_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 20).alias("batch"), "event_id", F.when((F.col("event_type") == "error") & (F.col("value") > 150), "waiting").otherwise("processed").alias("status"))
    return state.until_quota_ends(rows, "batch", "event_id", "status").select("batch", "event_id")


@register("change_insert_once", "SELECT user_id AS page_id, CAST(floor(value / 10) AS BIGINT) AS to_version, min(CASE WHEN event_type = 'view' THEN event_id END) AS old_id, min(event_id) FILTER (WHERE event_type = 'click') AS new_id FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL")
def change_insert_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("page_id"), F.floor(F.col("value") / 10).alias("to_version"), F.col("event_id").alias("id"), "event_type")
    keys = ["page_id", "to_version"]
    new, old = (rows.where(F.col("event_type") == t).drop("event_type") for t in ("click", "view"))
    old = versions.one_per_key(old, keys, "id")
    inserted = state.insert_once(old, new, keys, "id")
    again = state.insert_once(inserted, new, keys, "id")
    firsts = new.groupBy(*keys).agg(F.min("id").alias("new_id"))
    known = old.withColumnRenamed("id", "old_id")
    return again.drop("id").join(known, keys, "left").join(firsts, keys, "left").select(*keys, "old_id", "new_id")


@register("upsert_last_wins", "SELECT user_id, max_by(event_type, event_id) AS event_type FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type IN ('view', 'click')").select("user_id", "event_type", "event_id")
    some = rows.where("event_id % 3 = 0")
    old = state.upsert(some.limit(0), some, "user_id", "event_id")
    # what comes later by id goes over
    late = rows.groupBy("user_id").agg(F.max("event_id").alias("event_id")).join(rows, ["user_id", "event_id"]).select("user_id", "event_type", "event_id")
    return state.upsert(old, rows.where("event_id % 3 <> 0").unionByName(late), "user_id", "event_id").select("user_id", "event_type")


@register("delete_cascade", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return state.without(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), gone, "l_orderkey")


@register("quarantine_versions", r"""SELECT page_id, url, CASE WHEN NOT regexp_matches(html, '(?i)cookie') THEN md5(html) END AS html_md5 FROM pages""")
def quarantine_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    hit = pages.where(guard.pattern_reason(F.col("html"), ["cookie"]).isNotNull())
    blanked = state.blank_versions(pages, pages.select("page_id", "url"), hit, ["html"])
    return blanked.select("page_id", "url", F.md5("html").alias("html_md5"))


@register("deliveries_unfinished", "SELECT event_id FROM events WHERE event_type = 'error' AND ts <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def deliveries_unfinished(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("published_at"), F.when(F.col("event_type") != "error", F.col("ts")).alias("completed_at"))
    now = rows.agg(F.max("published_at")).first()[0]
    return state.unfinished(rows, F.lit(now)).select("event_id")


@register("run_durations", "SELECT event_id, CASE WHEN event_type <> 'error' THEN epoch_ms(ts + to_seconds(CAST(floor(value) AS BIGINT))) - epoch_ms(ts) END AS duration_ms FROM events")
def run_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    started = F.col("ts").cast("timestamp")
    finished = F.when(F.col("event_type") != "error", started + F.make_interval(secs=F.floor(F.col("value")).cast("decimal(18,6)")))
    return table(spark, sf_dir, "events").select("event_id", state.milliseconds(started, finished).alias("duration_ms"))


@register("runs_newest_first", "SELECT CAST(row_number() OVER (ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place, event_id FROM events WHERE user_id = 7")
def runs_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").where("user_id = 7").select("event_id", F.col("ts").alias("started_at"), F.col("event_id").alias("id"))
    return agents.newest_runs(runs).select("place", "event_id")


def _schema_rows() -> str:
    """Version, number of columns of pages, and those of them that documents fill."""
    filled = {"id", "url", "extracted_text", "content_hash"}
    return ", ".join(f"({n}, {len(held)}, {len(filled & set(held))})" for n in range(1, len(state.MIGRATIONS) + 1) if (held := state.schema_at(n)["pages"]))


@register("schema_versions", f"SELECT version, n_columns, CAST(sum(filled) AS BIGINT) AS n_values FROM (VALUES {_schema_rows()}) x(version, n_columns, filled), documents WHERE text IS NOT NULL GROUP BY version, n_columns")
def schema_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of every version of the tables: a column that a version adds is empty, one that it drops goes."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("extracted_text"), F.md5("text").alias("content_hash"))
    found = None
    for n in range(1, len(state.MIGRATIONS) + 1):
        pages = state.as_version(docs, "pages", n)
        values = sum((F.count(c) for c in pages.columns), F.lit(0))
        rows = pages.agg(F.lit(n).alias("version"), F.lit(len(pages.columns)).alias("n_columns"), values.alias("n_values"))
        found = rows if found is None else found.unionByName(rows)
    return found


@register("snapshot_commits", """WITH d AS (SELECT doc_id AS i, text FROM documents WHERE text IS NOT NULL)
SELECT CAST(i AS VARCHAR) AS url, 1 + CAST(i % 3 = 0 AS BIGINT) + CAST(i % 2 = 0 AS BIGINT) AS version, md5(text || CASE WHEN i % 2 = 0 THEN 'c' WHEN i % 3 = 0 THEN 'b' ELSE '' END) AS content,
  CASE WHEN i % 3 = 0 AND i % 2 <> 0 THEN 'processed' ELSE 'pending' END AS status, CAST(i % 3 = 0 AS BIGINT) + CAST(i % 2 = 0 AS BIGINT) AS archived FROM d""")
def snapshot_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page, archive and status after two writers that began with one snapshot, of whom the second has to begin
    anew, one that was killed before its commit, and outcomes of which some are outdated."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("url"), "doc_id", "text")
    of = lambda rows, mark: rows.select("url", F.md5(F.concat("text", F.lit(mark))).alias("content"), F.lit(0).alias("seq"))
    store = snapshots.Store(spark, workspace.folder(spark, "commits"))
    store.run(lambda change: ingest.arrive(change, of(docs, "")))
    first, second, killed = store.begin(), store.begin(), store.begin()
    ingest.arrive(first, of(docs.where("doc_id % 3 = 0"), "b"))
    ingest.arrive(second, of(docs.where("doc_id % 2 = 0"), "c"))
    ingest.arrive(killed, of(docs.where("doc_id % 5 = 0"), "killed"))
    first.commit()
    try:
        second.commit()
    except snapshots.Conflict:
        store.run(lambda change: ingest.arrive(change, of(docs.where("doc_id % 2 = 0"), "c")))
    done = of(docs.where("doc_id % 3 = 0"), "b").withColumn("status", F.lit("processed")).withColumn("seq", F.lit(1))
    store.run(lambda change: ingest.settle(change, done))
    return ingest.state(store.snapshot())
