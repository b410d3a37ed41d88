"""The entity graph kept up to date from batches of versions, in a snapshot store.

A page's new processed version takes the mentions of its old one away and brings its own. Both stand in one row of the page,
so a batch reads its versions and the known pages once. Counts of entities, hosts and pairs are those before and what
the batch's pages add and take away; mentions of other pages are read only for an entity that lost the newest
one, whose display it showed, and got no newer. A batch is one commit, which a repeated delivery does not repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.functions import urls
from lithic.sources.snapshots import Snapshot, Store, Transaction


def _newest(rows: DataFrame, *columns: str) -> DataFrame:
    """The row of each url's newest version."""
    newest = F.max_by(F.struct("version", *columns), "version").alias("p_")
    return rows.groupBy("url").agg(newest).select("url", "p_.*")


def _surest(pages: DataFrame) -> DataFrame:
    """entities as mentions, by type and key; of those with one key the surest stays, as in :func:`lithic.operators.graph.project`."""
    ordered = F.array_sort(F.transform("entities", lambda e: F.struct(*(e[name].alias(name) for name in ("type", "key", "confidence", "display")))))
    after = lambda i: F.get("mentions", i + 1)
    last = lambda e, i: (i == F.size("mentions") - 1) | ~(e["type"].eqNullSafe(after(i)["type"]) & e["key"].eqNullSafe(after(i)["key"]))
    return pages.withColumn("mentions", ordered).drop("entities").withColumn("mentions", F.filter("mentions", last))


def _pairs(pages: DataFrame, mentions: str, n: int) -> DataFrame:
    """(type, key, other_type, other_key, n) of the pairs of entities on each page, which has them in order."""
    one = pages.select(F.transform(mentions, lambda m: F.struct(m["type"].alias("type"), m["key"].alias("key"))).alias("all_"))
    one = one.select("all_", F.posexplode("all_").alias("at_", "a"))
    both = one.select("a", F.explode(F.slice("all_", F.col("at_") + 2, F.size("all_"))).alias("b"))
    return both.select(F.col("a.type").alias("type"), F.col("a.key").alias("key"), F.col("b.type").alias("other_type"), F.col("b.key").alias("other_key"), F.lit(n).cast("long").alias("n"))


def _shown(pages: DataFrame, mentions: str = "mentions", version: str = "version") -> DataFrame:
    """(type, key, shown) of each mention; an entity shows the display of the greatest."""
    each = pages.select("url", F.col(version).alias("version"), F.explode(mentions).alias("m"))
    return each.select("m.type", "m.key", F.struct("version", "url", "m.display").alias("shown"))


def _entities(change: Transaction, pages: DataFrame) -> DataFrame:
    """(type, key, pages, shown) of the entities that came or went."""
    none = F.lit(None)
    came, went = _shown(pages), _shown(pages, "gone", "known")
    kind = came.schema["shown"].dataType
    rows = came.select("type", "key", F.lit(1).cast("long").alias("n"), F.col("shown").alias("came"), none.cast(kind).alias("went"), none.cast(kind).alias("held"))
    rows = rows.unionByName(went.select("type", "key", F.lit(-1).cast("long").alias("n"), none.cast(kind).alias("came"), F.col("shown").alias("went"), none.cast(kind).alias("held")))
    if change.has("entities"):
        rows = rows.unionByName(_counted(change.read("entities")).select("type", "key", F.col("pages").alias("n"), none.cast(kind).alias("came"), none.cast(kind).alias("went"), F.col("shown").cast(kind).alias("held")))
    counted = rows.groupBy("key", "type").agg(F.sum("n").alias("pages"), F.max("came").alias("came"), F.max("went").alias("went"), F.max("held").alias("held")).where("came is not null or went is not null")
    lost = F.coalesce(F.col("went") == F.col("held"), F.lit(False))
    newer = F.coalesce(F.col("came") > F.col("held"), F.lit(False))
    shown = F.when(F.col("pages") > 0, F.when(lost, F.col("came")).otherwise(F.greatest("came", "held")))
    counted = change.stage(counted.select("type", "key", "pages", shown.alias("shown"), ((F.col("pages") > 0) & lost & ~newer).alias("open")))
    asked = counted.where("open").select(F.col("type").alias("t_"), F.col("key").alias("k_"))
    if asked.isEmpty():
        return counted.drop("open")
    columns = ["url", "version", "mentions"]
    live = _newest(change.read("pages").select(columns).unionByName(pages.select(columns)), "mentions")
    left = _shown(live).join(asked, F.col("type").eqNullSafe(F.col("t_")) & F.col("key").eqNullSafe(F.col("k_")), "left_semi")
    return counted.where("not open").drop("open").unionByName(counted.where("open").select("type", "key", "pages", F.lit(None).cast(kind).alias("shown")).unionByName(left.select("type", "key", F.lit(0).cast("long").alias("pages"), "shown")).groupBy("type", "key").agg(F.sum("pages").alias("pages"), F.max("shown").alias("shown")))


def _hosts(change: Transaction, pages: DataFrame) -> DataFrame:
    """(host, pages) of the hosts that a page with mentions came to or went from."""
    on = lambda mentions, n: pages.where(F.size(mentions) > 0).select("host", F.lit(n).cast("long").alias("n"), F.lit(True).alias("moved"))
    rows = on("mentions", 1).unionByName(on("gone", -1))
    if change.has("hosts"):
        change.read("hosts")
        rows = rows.unionByName(hosts(change.base).select("host", F.col("pages").alias("n"), F.lit(False).alias("moved")))
    return rows.groupBy("host").agg(F.sum("n").alias("pages"), F.max("moved").alias("moved")).where("moved").drop("moved")


def update(change: Transaction, versions: DataFrame) -> None:
    """Take in versions (url, version, ai_status, entities): a version that is not processed, or not newer than what the
    page has, changes nothing. Pages without entities count as known."""
    if change.has("mentions"):
        raise ValueError("the store has mentions in a table of their own, an older layout: build it anew")
    pages = _surest(_newest(versions.where("ai_status = 'processed' and url is not null"), "entities"))
    if change.has("pages"):
        known = _newest(change.read("pages"), "mentions").select("url", F.col("version").alias("known"), F.col("mentions").alias("gone"))
        pages = pages.join(known, "url", "left").where("known is null or version > known")
    else:
        pages = pages.select("*", F.lit(None).cast("long").alias("known"), F.lit(None).cast(pages.schema["mentions"].dataType).alias("gone"))
    pages = change.stage(pages.withColumn("host", F.lower(urls.host(F.col("url")))))
    at = F.lit(change.base.version + 1).cast("long").alias("at")
    change.append("entities", _entities(change, pages).select("type", "key", "pages", "shown", at))
    change.append("hosts", _hosts(change, pages).select("host", "pages", at))
    pairs = _pairs(pages, "mentions", 1).unionByName(_pairs(pages, "gone", -1))
    change.append("pairs", pairs.groupBy("type", "key", "other_type", "other_key").agg(F.sum("n").alias("n")).where("n <> 0"))
    change.append("pages", pages.select("url", "version", "host", "mentions"))


def mentions(at: Snapshot) -> DataFrame:
    live = _newest(at.table("pages"), "host", "mentions")
    return live.select("url", "host", "version", F.explode("mentions").alias("m")).select("url", "host", "version", "m.type", "m.key", "m.display", "m.confidence")


def _counted(rows: DataFrame) -> DataFrame:
    """(type, key, pages, shown) as last counted; shown is the version, url and display of the newest mention."""
    last = rows.groupBy("type", "key").agg(F.max_by(F.struct("pages", "shown"), "at").alias("e"))
    return last.select("type", "key", "e.*").where("pages > 0")


def entities(at: Snapshot) -> DataFrame:
    """(type, key, display, pages), as :func:`lithic.operators.graph.rebuild` counts them over all versions."""
    return _counted(at.table("entities")).select("type", "key", "shown.display", "pages")


def hosts(at: Snapshot) -> DataFrame:
    return at.table("hosts").groupBy("host").agg(F.max_by("pages", "at").alias("pages")).where("pages > 0")


def cooccurring(at: Snapshot) -> DataFrame:
    """(type, key, other_type, other_key, shared), each pair once, the lesser first."""
    return at.table("pairs").groupBy("type", "key", "other_type", "other_key").agg(F.sum("n").alias("shared")).where("shared > 0")


def compact(change: Transaction) -> None:
    """The newest rows of pages and counts alone, as new parts."""
    change.has("pages")
    base, at = change.base, F.lit(change.base.version + 1).cast("long").alias("at")
    change.replace("pages", _newest(base.table("pages"), "host", "mentions"))
    change.replace("entities", _counted(base.table("entities")).select("*", at))
    change.replace("hosts", hosts(base).select("*", at))
    change.replace("pairs", cooccurring(base).withColumnRenamed("shared", "n"))


def follow(store: Store, versions: DataFrame, checkpoint: str, name: str = "graph") -> None:
    """Take in all that a stream of versions has now; a batch that is delivered again changes nothing."""
    query = versions.writeStream.foreachBatch(lambda batch, number: store.run(lambda change: update(change, batch), writer=name, token=number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
