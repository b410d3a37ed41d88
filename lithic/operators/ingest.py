"""Page, archive and status as tables of one snapshot store: an arrival or an outcome changes all of them at once.

Pages and statuses grow by rows only; a page's row of highest version counts, and of a version's statuses the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.sources.snapshots import Snapshot, Transaction


def current(pages: DataFrame) -> DataFrame:
    """A page's newest row, by a map-side maximum."""
    return pages.groupBy("url").agg(F.max_by(F.struct("version", "content"), "version").alias("p")).select("url", "p.*")


def arrive(change: Transaction, arrivals: DataFrame) -> None:
    """Arrivals (url, content, seq): a new url is version 1, another content than the page's archives that and is
    one version more, pending; the same content changes nothing. Of a url's arrivals in a batch the last counts;
    those without url or content are none."""
    last = arrivals.where("url is not null and content is not null").groupBy("url").agg(F.max_by("content", "seq").alias("new"))
    if change.has("pages"):
        rows = last.join(current(change.read("pages")), "url", "left").where(~F.col("new").eqNullSafe(F.col("content")))
    else:
        rows = last.withColumn("version", F.lit(None).cast("long")).withColumn("content", F.lit(None).cast("string"))
    rows, version = change.stage(rows), F.coalesce(F.col("version"), F.lit(0)) + 1
    change.append("archive", rows.where("version is not null").select("url", "version", "content"))
    change.append("statuses", rows.select("url", version.alias("version"), F.lit("pending").alias("status"), F.lit(0).cast("long").alias("seq")))
    change.append("pages", rows.select("url", version.alias("version"), F.col("new").alias("content")))


def settle(change: Transaction, outcomes: DataFrame) -> None:
    """Outcomes (url, content, status, seq) of pages that still have the content that they were computed on."""
    pages = current(change.read("pages"))
    change.append("statuses", outcomes.join(pages, ["url", "content"]).select("url", "version", "status", F.col("seq").cast("long").alias("seq")))


def state(at: Snapshot) -> DataFrame:
    """(url, version, content, status, archived) of every page, all as of one snapshot."""
    last = at.table("statuses").groupBy("url", "version").agg(F.max_by("status", "seq").alias("status"))
    kept = at.table("archive").groupBy("url").agg(F.count("*").alias("archived"))
    rows = current(at.table("pages")).join(last, ["url", "version"]).join(kept, "url", "left")
    return rows.select("url", "version", "content", "status", F.coalesce("archived", F.lit(0)).cast("long").alias("archived"))
