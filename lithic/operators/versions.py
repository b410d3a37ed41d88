"""Page versions derived from an append-only arrival log; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithic.operators import scans
from lithic.operators.folds import fold
from lithic.settings import DEFAULTS
from lithic.sources import workspace


def numbered(log: DataFrame, url: str, content: str, seq: str) -> DataFrame:
    """log with ``version``: 1 for a url's first arrival, one more whenever its content differs from the
    arrival before."""
    order = Window.partitionBy(url).orderBy(seq)
    changed = F.coalesce((~F.col(content).eqNullSafe(F.lag(content).over(order))).cast("int"), F.lit(1))
    first = F.row_number().over(order) == 1
    return log.withColumn("changed_", F.when(first, 1).otherwise(changed)).withColumn("version", F.sum("changed_").over(order)).drop("changed_")


def current(log: DataFrame, url: str, content: str, seq: str, at: str) -> DataFrame:
    """One row per url: its latest version, content and the times it was first and last seen."""
    rows = numbered(log, url, content, seq)
    return rows.groupBy(url).agg(F.max("version").alias("version"), F.max_by(content, seq).alias(content), F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"))


def history(log: DataFrame, url: str, content: str, seq: str, at: str) -> DataFrame:
    """(url, version, content, recorded_at) of every version but a url's latest."""
    rows = numbered(log, url, content, seq).groupBy(url, "version").agg(F.first(content).alias(content), F.min(at).alias("recorded_at"))
    last = F.max("version").over(Window.partitionBy(url))
    return rows.withColumn("last_", last).where(F.col("version") < F.col("last_")).drop("last_")


def one_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("place_", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("place_ = 1").drop("place_")


def baseline(changes: DataFrame, versions: DataFrame, key: str) -> DataFrame:
    """For each change (key, version) the archived version below it, enriched ones first, then the newest: one
    running maximum of the versions and one of the enriched ones, no join of changes and versions."""
    v = versions.select(F.col(key).alias("k_"), F.col("version").alias("base_version"), F.col("enriched").alias("base_enriched"))
    rows = changes.select(key, "version", F.lit(None).cast("boolean").alias("e_")).unionByName(v.select(F.col("k_").alias(key), F.col("base_version").alias("version"), F.col("base_enriched").alias("e_")))
    # a version's own archive row is none below it, so it comes behind the change
    below = Window.partitionBy(key).orderBy("version", F.col("e_").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    archived = F.when(F.col("e_").isNotNull(), F.col("version"))
    seen = rows.withColumn("any_", F.max(archived).over(below)).withColumn("rich_", F.max(F.when(F.col("e_"), F.col("version"))).over(below))
    found = seen.where("e_ is null and any_ is not null")
    return found.select(key, "version", F.coalesce("rich_", "any_").alias("base_version"), F.col("rich_").isNotNull().alias("base_enriched"))


def not_enriched(pages: DataFrame, done: DataFrame) -> DataFrame:
    """Pages whose (url, content_hash) has not been processed."""
    return pages.join(done.where("ai_status = 'processed'").select("url", "content_hash").distinct(), ["url", "content_hash"], "left_anti")


def next_status(status, outcome, attempts, most: int = DEFAULTS.max_ai_attempts):
    """(status, attempts) columns after an outcome: processed, failed, waiting or quarantined."""
    new = F.when(outcome == "processed", "processed").when(outcome == "quarantined", "quarantined").when(outcome == "failed", F.when(attempts + 1 >= most, "failed_permanent").otherwise("failed_transient")).otherwise(status)
    return new, F.when(outcome == "failed", attempts + 1).otherwise(attempts)


def backlog(pages: DataFrame, most: int) -> DataFrame:
    return pages.where(F.col("ai_status").isin("pending", "failed_transient") & F.col("extracted_text").isNotNull()).orderBy("id").limit(most)


def seen_within(rows: DataFrame, key: str, at: str, hours: int = DEFAULTS.dedup_ttl_hours, seq: str = "event_id", hot: int = scans.HOT) -> DataFrame:
    """Rows kept by a time-to-live filter: a row is dropped if its key was kept less than the TTL before.
    The TTL restarts at kept rows only, so it is a fold over a key's rows in order, of which one task holds one
    row at a time. Of a key with more than ``hot`` rows each time points to the first that is a TTL later, and
    the kept times are the path from the first one, which many tasks find."""
    ttl = hours * 3_600_000_000

    def step(kept, row):
        fresh = kept is None or row[0] - kept >= ttl
        return (row[0] if fresh else kept), fresh

    few, many = scans.parted(rows, key, hot)
    kept = fold(few, key, [at, seq], [at], step, "fresh_ boolean").where("fresh_").drop("fresh_")
    if many is None:
        return kept
    firsts = many.withColumn("at_", scans.micros(many, at)).groupBy(scans.KEY, "at_").agg(F.min_by(F.struct(*rows.columns), seq).alias("row_"))
    firsts = workspace.cut(firsts)
    times = firsts.select(scans.KEY, "at_")
    edges = scans.following(times, times.select(scans.KEY, (F.col("at_") + ttl).alias("at_"), F.col("at_").alias("node")), scans.KEY, "at_", {"next": F.col("at_")})
    path = scans.path(edges.select(scans.KEY, "node", "next"), times.groupBy(scans.KEY).agg(F.min("at_").alias("node")))
    return kept.unionByName(firsts.join(path.withColumnRenamed("node", "at_"), [scans.KEY, "at_"], "left_semi").select("row_.*"))
