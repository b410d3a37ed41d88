"""Structured Streaming forms of the ingest operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from lithic.functions import urls
from lithic.settings import DEFAULTS
from lithic.sources.tables import parse_events


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Page events from a folder of JSON lines, a bounded number of files a batch."""
    raw = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return parse_events(raw)[0]


#: The time of an event in microseconds, in the rows of the filter.
AT = "at_"


class Kept(StatefulProcessor):
    """A key's state is the time of its last kept event; a timer a TTL later clears it. Rows are structs as events have
    them and a column AT, the event's time in microseconds; of those of one key only the first of each time is held."""

    def __init__(self, ttl: int, columns: list[str]) -> None:
        self.ttl, self.columns = ttl, columns

    def init(self, handle) -> None:
        self.handle, self.kept = handle, handle.getValueState("kept", "at long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        firsts: dict = {}
        for row in rows:
            at, held = row[AT], firsts.get(row[AT])
            if held is None or row["url"] < held["url"]:
                firsts[at] = row
        state = self.kept.get()
        kept = None if state is None else state[0]
        untimed, fresh = firsts.pop(None, None), []
        for at in sorted(firsts):
            if kept is None or at // 1000 - kept >= self.ttl:
                kept = at // 1000
                fresh.append(firsts[at])
        if untimed is not None and kept is None:
            return iter([Row(**{c: untimed[c] for c in self.columns})])
        if fresh:
            self.kept.update((kept,))
            self.handle.registerTimer(max(kept + self.ttl, timerValues.getCurrentWatermarkInMs() + 1))
        return (Row(**{c: row[c] for c in self.columns}) for row in fresh)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        # a later kept event has set a later timer
        state = self.kept.get()
        if state is not None and state[0] + self.ttl <= max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()):
            self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def distinct_pages(events: DataFrame, hours: int = DEFAULTS.dedup_ttl_hours) -> DataFrame:
    """Events that the time-to-live filter keeps, as :func:`lithic.operators.versions.seen_within` does for a batch: one
    whose normalized URL was kept less than the TTL before goes. A key's state is the time of its last kept
    event, and a timer clears it when the watermark is a TTL later. Of a micro-batch, events are taken by time."""
    _keep_state_on_disk(events.sparkSession)
    keyed = events.withWatermark("fetched_at", f"{hours} hours").select("*", urls.normalize(F.col("url")).alias("dedup_key"), F.unix_micros("fetched_at").alias(AT))
    kept = StructType([f for f in events.schema if f.name != "fetched_at"]).add(AT, "long")
    rows = keyed.groupBy("dedup_key").transformWithState(Kept(hours * 3_600_000, kept.names), kept, "Append", "EventTime")
    return rows.withColumn("fetched_at", F.timestamp_micros(AT)).select(events.columns)


def _keep_state_on_disk(spark: SparkSession) -> None:
    """State by transformWithState lies in RocksDB, beyond the executors' heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def minute_usage(events: DataFrame, at: str, keys: list[str], delay: str = "90 seconds") -> DataFrame:
    return events.withWatermark(at, delay).groupBy(F.window(at, "1 minute"), *keys).agg(F.count("*").alias("requests"))


def newest_versions(versions: DataFrame, key: str, version: str) -> DataFrame:
    """A row of (key, version) whenever a key's highest version (a time) rises; an older or equal one gives none. The
    state is an aggregate: the highest version and, of the batches that brought it, the first by their time."""
    _keep_state_on_disk(versions.sparkSession)
    batch = F.unix_millis(F.current_timestamp())  # one time for a whole batch, also where it is repeated
    rows = versions.where(F.col(version).isNotNull()).select(key, F.col(version).alias("v"), (-batch).alias("since"))
    top = rows.groupBy(key).agg(F.max(F.struct("v", "since")).alias("top_"))
    return top.where(F.col("top_.since") == -batch).select(key, F.col("top_.v").alias(version))


def write_once(batch: DataFrame, batch_id: int, folder: str) -> None:
    """A foreachBatch sink that a repeated batch overwrites: its folder is named by the batch."""
    batch.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={batch_id}")


def drain(stream: DataFrame, folder: str, checkpoint: str, deliveries: int = 1, mode: str = "append") -> None:
    """Run a stream over all that is there and stop, its rows in files by batch; every batch may be delivered several
    times. A later call with the same checkpoint goes on where this one ended."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        for _ in range(deliveries):
            write_once(batch, batch_id, folder)

    query = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def written(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all batches."""
    return spark.read.parquet(folder).drop("batch")


def latest(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Of updates, a key's row of the last batch that has one."""
    rows = spark.read.parquet(folder)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def liveness(query) -> dict:
    """Whether a streaming query runs, and its last batch and its rows."""
    last = query.lastProgress
    return {"active": query.isActive, "batch": last["batchId"] if last else None, "rows": last["numInputRows"] if last else 0}
