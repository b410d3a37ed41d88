"""Readers: Parquet tables, JSON page events, line lists; and the sinks' record shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithic.settings import DEFAULTS
from lithic.shipping import ship
from lithic.sources.snapshots import Store, Transaction

RAW_PAGE = T.StructType([T.StructField("url", T.StringType()), T.StructField("source_type", T.StringType()), T.StructField("html", T.StringType()), T.StructField("fetched_at", T.TimestampType())])
ENTITY = T.StructType([T.StructField("type", T.StringType()), T.StructField("key", T.StringType()), T.StructField("display", T.StringType()), T.StructField("confidence", T.DoubleType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parse_events(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, dead letters) of a frame with a JSON string column ``value``: a record that is no JSON
    object or names no url goes to the dead letters instead of being lost."""
    parsed = raw.withColumn("event", F.from_json("value", RAW_PAGE, {"mode": "PERMISSIVE"}))
    good = F.col("event.url").isNotNull()
    return parsed.where(good).select("event.*"), parsed.where(F.coalesce(~good, F.lit(True))).select("value")


def as_records(pages: DataFrame) -> DataFrame:
    """(key, value) records of page events, keyed by url so that a url's events stay in order."""
    return pages.select(F.col("url").alias("key"), F.to_json(F.struct(*[f.name for f in RAW_PAGE.fields])).alias("value"))


def size_limit(max_mb: int) -> int | None:
    """Largest record in bytes: a tenth above the page limit; none if the limit is not positive."""
    return max_mb * 1024 * 1024 * 110 // 100 if max_mb > 0 else None


def split_oversized(records: DataFrame, limit: int | None, now: Column) -> tuple[DataFrame, DataFrame]:
    """(records to publish, side records (marker, note, at) of those of more bytes than the limit). A marker is
    the key's SHA-256 behind a prefix, a note names the key, its bytes and the time."""
    size = F.octet_length("value")
    over = size > limit if limit is not None else F.lit(False)
    note = F.concat_ws("|", "key", size.cast("string"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    marker = F.concat(F.lit("skipped:oversized:"), F.sha2("key", 256))
    return records.where(~over), records.where(over).select(marker.alias("marker"), note.alias("note"), now.alias("at"))


def still_kept(marks: DataFrame, now: Column, days: int = DEFAULTS.oversized_days) -> DataFrame:
    """Side records that their retention has not ended yet."""
    return marks.where(F.col("at") >= now - F.make_dt_interval(days=F.lit(days)))


def truncate_body(body: Column, most_bytes: int = DEFAULTS.max_page_mb * 1024 * 1024) -> Column:
    """A fetched body's first bytes up to the page limit, as text; more are cut, not refused."""
    return F.decode(F.substring(body.cast("binary"), 1, most_bytes), "UTF-8")


def publish(pages: DataFrame, folder: str, limit: int | None) -> DataFrame:
    """Append page events as (key, value) records to a folder of JSON lines, a url's in the order of their times,
    and return the side records of those too large. Publishing a batch again is harmless to a reader that
    keeps one record per key and time."""
    small, over = split_oversized(as_records(pages), limit, F.current_timestamp())
    small.repartition("key").sortWithinPartitions("key", F.get_json_object("value", "$.fetched_at")).write.mode("append").json(folder)
    return over


def line_list(lines: DataFrame) -> DataFrame:
    """Trimmed lines of a list without blanks and # comments."""
    value = F.trim("value")
    return lines.select(value.alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("#"))


def hash_list(lines: DataFrame) -> DataFrame:
    """Lower-case 32-digit hashes of a list; other lines are left out."""
    return line_list(lines).select(F.lower("value").alias("value")).where(F.col("value").rlike("^[0-9a-f]{32}$"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """A list's lines; a list that is not there is empty."""
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], "value string")
    return line_list(spark.read.text(path))


def read_hashes(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(hashes, number of other lines) of a list of hashes, which may be empty but has to be there."""
    lines = line_list(spark.read.text(path))  # Spark fails on a path that is not there
    return hash_list(lines), lines.where(~F.lower("value").rlike("^[0-9a-f]{32}$")).count()


def valid_patterns(spark: SparkSession, lines: list[str]) -> list[str]:
    """Patterns of a list that compile in the engine that will run them, in order."""
    compiles = spark.sparkContext._jvm.java.util.regex.Pattern.compile
    found = []
    for line in (x.strip() for x in lines):
        if line and not line.startswith("#"):
            try:
                compiles(line)
            except Exception:  # noqa: BLE001, S112  a PatternSyntaxException from the other side
                continue
            found.append(line)
    return found


def ensure_collection(store: Store, name: str, dim: int) -> dict[str, int]:
    """The store's collections (name to dimension), which last with it, with this one: it is made if it is not there, and one
    that is there has to have the dimension."""

    def work(change: Transaction) -> None:
        held = change.note("collections", {})
        if held.get(name, dim) != dim:
            raise ValueError(f"collection {name} has {held[name]} dimensions, not {dim}")
        if name not in held:
            change.notes["collections"] = {**held, name: dim}

    return store.run(work).notes["collections"]


def lookup(rows: DataFrame, **key) -> DataFrame:
    """The rows of a key; the comparison reaches the scan."""
    for column, value in key.items():
        rows = rows.where(F.col(column) == F.lit(value))
    return rows


def check_vectors(vectors: DataFrame, column: str, dim: int) -> DataFrame:
    """vectors, whose query fails on a row of another dimension."""
    return vectors.withColumn(column, F.when(F.size(column) == dim, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"vector is not of {dim} dimensions: "), F.size(column).cast("string")))))
