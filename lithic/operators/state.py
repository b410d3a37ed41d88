"""State of pages, versions, changes and runs, replayed from append-only logs.

A page log has (url, seq, at, kind, content, status, note): arrivals (kind page) bring a content, outcomes (kind
outcome) a status of processed, failed, waiting or quarantined, the content that it was computed on and a
note, the enrichment. A url's rows are ordered by seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithic.settings import DEFAULTS


def replay(log: DataFrame) -> DataFrame:
    """log with ``version``, one more at each arrival of another content, and ``applied``: whether an outcome was
    computed on the content that its page still had (an outdated one changes nothing)."""
    order = Window.partitionBy("url").orderBy("seq")
    arrived = F.when(F.col("kind") == "page", F.col("content"))
    before = F.last(arrived, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = log.withColumn("before_", before)
    fresh = (F.col("kind") == "page") & ~F.col("content").eqNullSafe(F.col("before_"))
    rows = rows.withColumn("version", F.sum(fresh.cast("long")).over(order))
    return rows.withColumn("applied", (F.col("kind") == "outcome") & F.coalesce(F.col("content") == F.col("before_"), F.lit(False))).drop("before_")


def _status(last: Column, attempts: Column, most: int) -> Column:
    failed = F.when(attempts >= most, "failed_permanent").otherwise("failed_transient")
    return F.coalesce(F.when(last == "failed", failed).otherwise(last), F.lit("pending"))


def versions_of(log: DataFrame, most: int = DEFAULTS.max_ai_attempts) -> DataFrame:
    """(url, version, content, recorded_at, attempts, ai_status, note) of every version: a new content starts as
    pending with no attempts; an outcome that is not processed and not waiting for quota is an attempt."""
    told = F.col("applied") & (F.col("status") != "waiting")
    rows = replay(log).where("version > 0").groupBy("url", "version").agg(
        F.min_by("content", F.when(F.col("kind") == "page", F.col("seq"))).alias("content"),
        F.min(F.when(F.col("kind") == "page", F.col("at"))).alias("recorded_at"),
        F.count(F.when(told & (F.col("status") == "failed"), 1)).alias("attempts"),
        F.max_by("status", F.when(told, F.col("seq"))).alias("last_"),
        F.max_by("note", F.when(told & (F.col("status") == "processed"), F.col("seq"))).alias("note"),
    )
    return rows.withColumn("ai_status", _status(F.col("last_"), F.col("attempts"), most)).drop("last_")


def pages_of(log: DataFrame) -> DataFrame:
    """(url, version, content, ai_status, attempts, note, first_seen_at, last_seen_at) of every page. The note is
    the newest that any version had: it stays while a new content waits."""
    versions = versions_of(log)
    kept = F.max_by("note", F.when(F.col("note").isNotNull(), F.col("version"))).alias("note")
    newest = versions.groupBy("url").agg(*[F.max_by(c, "version").alias(c) for c in ("content", "ai_status", "attempts")], F.max("version").alias("version"), kept)
    seen = log.where("kind = 'page'").groupBy("url").agg(F.min("at").alias("first_seen_at"), F.max("at").alias("last_seen_at"))
    return newest.join(seen, "url").select("url", "version", "content", "ai_status", "attempts", "note", "first_seen_at", "last_seen_at")


def archive_of(log: DataFrame) -> DataFrame:
    """(url, version, content, recorded_at, note) of all versions but the newest, once each; the note only of
    those that were processed when they were replaced."""
    versions = versions_of(log)
    last = F.max("version").over(Window.partitionBy("url"))
    note = F.when(F.col("ai_status") == "processed", F.col("note"))
    return versions.withColumn("last_", last).where(F.col("version") < F.col("last_")).select("url", "version", "content", "recorded_at", note.alias("note"))


def up_to_date(outcomes: DataFrame, pages: DataFrame) -> DataFrame:
    """Outcomes whose (url, content_hash) is still the page's: only these may be written."""
    return outcomes.join(pages.select("url", "content_hash"), ["url", "content_hash"], "left_semi")


def backlog(pages: DataFrame, most: int = DEFAULTS.ai_batch) -> DataFrame:
    """The next pages of the queue: pending or failed for now, with a text, by url."""
    return pages.where(F.col("ai_status").isin("pending", "failed_transient") & F.col("content").isNotNull()).orderBy("url").limit(most)


def until_quota_ends(outcomes: DataFrame, batch: str, seq: str, status: str) -> DataFrame:
    """A batch's outcomes up to the first that waits for quota: there the batch stops."""
    order = Window.partitionBy(batch).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return outcomes.withColumn("out_", F.max((F.col(status) == "waiting").cast("int")).over(order)).where("out_ = 0").drop("out_")


def insert_once(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """old and those rows of new whose keys it has not; of several new rows of a key the first by ``order``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    fresh = new.withColumn("place_", place).where("place_ = 1").drop("place_")
    return old.unionByName(fresh.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """old with the rows of new put in or over by key; of several new rows of a key the last by ``order``."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    last = new.withColumn("place_", place).where("place_ = 1").drop("place_")
    return old.join(last.select(key), key, "left_anti").unionByName(last.select(*old.columns))


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows whose key is in none of gone: a delete, or what a delete of a parent takes with it."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def blank_versions(versions: DataFrame, pages: DataFrame, quarantined: DataFrame, columns: list[str]) -> DataFrame:
    """versions (page_id) with the columns nulled where the page (page_id, url) of that id is quarantined by url."""
    ids = pages.join(quarantined.select("url").distinct(), "url", "left_semi").select(F.col("page_id").alias("blank_"))
    joined = versions.join(ids, F.col("page_id") == F.col("blank_"), "left")
    return joined.select(*[F.when(F.col("blank_").isNull(), F.col(c)).alias(c) if c in columns else F.col(c) for c in versions.columns])


def change_status(outcomes: DataFrame, most: int = DEFAULTS.max_summary_attempts) -> DataFrame:
    """(id, status, attempts) of changes from their summary outcomes (id, seq, ok): success counts as an attempt
    too, after ``most`` failures a change is given up; what comes after an end changes nothing."""
    order = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col("ok").cast("int")).over(order), F.lit(0)) + (F.coalesce(F.sum((~F.col("ok")).cast("int")).over(order), F.lit(0)) >= most).cast("int")
    live = outcomes.withColumn("ended_", ended).where("ended_ = 0")
    found = live.groupBy("id").agg(F.count("*").alias("attempts"), F.max(F.col("ok").cast("int")).alias("done_"))
    return found.select("id", F.when(F.col("done_") == 1, "summarized").when(F.col("attempts") >= most, "failed_permanent").otherwise("failed_transient").alias("status"), "attempts")


def unfinished(publications: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """Published events that no listener has completed for some minutes: they are delivered again."""
    return publications.where(F.col("completed_at").isNull() & (F.col("published_at") <= now - F.make_interval(mins=F.lit(minutes))))


def milliseconds(started: Column, finished: Column) -> Column:
    """A run's duration; null while it runs."""
    return F.unix_millis(finished) - F.unix_millis(started)


#: Table definitions by version: what each one adds to or drops from the one before.
MIGRATIONS: tuple[dict[str, dict[str, str | None]], ...] = (
    {"pages": {"id": "bigint", "url": "string", "source_type": "string", "extracted_text": "string", "content_hash": "string", "version": "int", "first_seen_at": "timestamp", "last_seen_at": "timestamp"}, "page_versions": {"id": "bigint", "page_id": "bigint", "version": "int", "content_hash": "string", "extracted_text": "string", "recorded_at": "timestamp"}},
    {"pages": {"embedding_status": "string"}},
    {"pages": {"ai_status": "string", "summary": "string", "category": "string", "translation": "string"}, "quarantine": {"url": "string", "content_hash": "string", "reason": "string", "detected_at": "timestamp"}},
    {"pages": {"entities": "array<struct<type:string,key:string,display:string,confidence:double>>"}, "page_versions": {"summary": "string", "category": "string", "entities": "array<struct<type:string,key:string,display:string,confidence:double>>"}, "page_changes": {"id": "bigint", "page_id": "bigint", "from_version": "int", "to_version": "int", "status": "string", "detected_at": "timestamp"}},
    {"pages": {"ai_attempts": "int", "translation": None}, "agents": {"id": "bigint", "name": "string", "daily": "boolean"}, "agent_runs": {"id": "bigint", "agent_id": "bigint", "status": "string", "started_at": "timestamp"}},
)


def schema_at(version: int) -> dict[str, dict[str, str]]:
    """Tables and their columns after that many migrations; None in a migration drops a column."""
    tables: dict[str, dict[str, str]] = {}
    for step in MIGRATIONS[:version]:
        for name, columns in step.items():
            table = tables.setdefault(name, {})
            for column, kind in columns.items():
                if kind is None:
                    table.pop(column, None)
                else:
                    table[column] = kind
    return tables


def as_version(rows: DataFrame, table: str, version: int) -> DataFrame:
    """rows as a table of that version: its columns, in its types and order; those that rows lack are null, others go."""
    kinds = schema_at(version)[table]
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])
