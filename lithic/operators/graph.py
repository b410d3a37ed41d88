"""Entity graph as tables: mentions (page, entity), pages and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithic.functions import entities as E
from lithic.functions import urls
from lithic.operators import heaps, shares

ENTITY_TYPES = ("crypto_wallet", "onion_service", "email", "pgp_fingerprint", *E.NAMED)


def project(versions: DataFrame) -> DataFrame:
    """(url, host, version, type, key, display, confidence) mentions of each url's newest processed version; an older
    or equal version, or one that waits, changes nothing. Of mentions with one key the surest stays."""
    newest = versions.where("ai_status = 'processed'").groupBy("url").agg(F.max_by("entities", "version").alias("entities"), F.max("version").alias("version"))
    rows = newest.select("url", F.lower(urls.host(F.col("url"))).alias("host"), "version", F.explode("entities").alias("e")).select("url", "host", "version", "e.*")
    best = F.max_by(F.struct("display", "confidence"), F.struct("confidence", "display")).alias("b")
    return rows.groupBy("url", "host", "version", "type", "key").agg(best).select("url", "host", "version", "type", "key", "b.display", "b.confidence")


def rebuild(versions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mentions, entities, hosts) of the whole graph: an entity's display is that of its newest mention, so none
    is left without one."""
    mentions = project(versions)
    newest = F.max_by("display", F.struct("version", "url")).alias("display")
    return mentions, mentions.groupBy("type", "key").agg(newest, F.countDistinct("url").alias("pages")), mentions.groupBy("host").agg(F.countDistinct("url").alias("pages"))


def entity_pages(entities: DataFrame, mentions: DataFrame, pages: DataFrame, key: str, page: str) -> DataFrame:
    """entities beside their pages and those pages' hosts, kept where they have none: two outer joins."""
    return entities.join(mentions.select(key, page).distinct(), key, "left").join(pages.select(page, "host"), page, "left")


def lookup(entities: DataFrame, kind: str, key: str) -> DataFrame:
    """The entity of a type and a key as a user writes it, which is brought into the form that extraction gives it."""
    if kind not in ENTITY_TYPES:
        raise ValueError(f"unknown entity type {kind}")
    written = F.lit(key)
    form = E.entity_key(F.lit(kind), E.fold(written) if kind in E.NAMED else written)
    return entities.where((F.col("type") == kind) & (F.col("key") == form))


def by_type(mentions: DataFrame) -> DataFrame:
    """(type, entities, mentions) per type."""
    return mentions.groupBy("type").agg(F.countDistinct("key").alias("entities"), F.count("*").alias("mentions"))


def without(mentions: DataFrame, quarantined: DataFrame, page: str) -> DataFrame:
    return mentions.join(quarantined.select(page).distinct(), page, "left_anti")


def orphans(entities: DataFrame, mentions: DataFrame, key: str) -> DataFrame:
    return entities.join(mentions.select(key).distinct(), key, "left_anti")


#: Entities of a page whose pairs one task may form with as many others.
PAGE_BLOCK = 512


def related(mentions: DataFrame, page: str, entity: str, most: int = 10, block: int = PAGE_BLOCK) -> DataFrame:
    """(entity, other, shared, place): the entities on most pages with each, ties by id. A page's entities are one array, cut into
    blocks where they are many, and each two blocks meet in a row of their own. Mentions, and the pairs of all pages, are
    counted first and dealt over tasks by their number, so a task's share does not grow."""
    rows = mentions.select(F.col(page).alias("p_"), F.col(entity).alias("e_")).where("p_ is not null and e_ is not null")
    pages = rows.repartition(shares.tasks_of(rows), "p_").groupBy("p_").agg(F.collect_set("e_").alias("es_"))
    formed = pages.agg(F.sum(F.size("es_").cast("long") * F.size("es_"))).first()[0] or 0
    many = shares.tasks(mentions.sparkSession, formed)
    last = F.ceil(F.size("es_") / block).cast("int") - 1
    met = pages.select("p_", "es_", F.explode(F.sequence(F.lit(0), last)).alias("a_")).select("*", F.explode(F.sequence(F.lit(0), last)).alias("b_"))
    cut = lambda at: F.slice("es_", F.col(at) * block + 1, block)
    dealt = met.select("p_", "a_", "b_", cut("a_").alias("x_"), F.when(F.col("a_") != F.col("b_"), cut("b_")).alias("y_")).repartition(many, "p_", "a_", "b_")
    both = dealt.select(F.explode("x_").alias("e_"), F.coalesce("y_", "x_").alias("y_")).select("e_", F.explode("y_").alias("other")).where("e_ <> other")
    counted = both.repartition(many, "e_", "other").groupBy("e_", "other").agg(F.count("*").alias("shared"))
    top = heaps.first_of_each(counted, ["e_"], [("shared", False), ("other", True)], most, many)
    return top.select(F.col("e_").alias(entity), F.posexplode("first").alias("place", "f")).select(entity, "f.other", "f.shared", (F.col("place") + 1).alias("place"))


def newest_pages(mentions: DataFrame, page: str, entity: str, at: str, most: int = 20, tasks: int | None = None) -> DataFrame:
    """(entity, pages): each entity's newest pages, in order. Heaps meet in ``tasks`` tasks, as many as the mentions need if
    none are named; a mention that comes again is left out where it is met."""
    top = heaps.first_of_each(mentions.select(entity, page, at), [entity], [(at, False), (page, True)], most, tasks or shares.tasks_of(mentions), once=True)
    return top.select(entity, F.transform("first", lambda s: s[page]).alias("pages"))


def most_mentioned(mentions: DataFrame, pages: DataFrame, page: str, entity: str, most: int = 5) -> DataFrame:
    """(entity, pages): the entities on most of the given pages, ties by id."""
    inside = mentions.join(pages.select(page).distinct(), page, "left_semi")
    return inside.groupBy(entity).agg(F.countDistinct(page).alias("pages")).orderBy(F.desc("pages"), entity).limit(most)


def reach(links: DataFrame, seeds: DataFrame, depth: int, per_page: int | None = None, capacity: int | None = None) -> DataFrame:
    """(node, depth) by breadth-first search over links (src, dst; pos for the order on a page), at most ``depth`` steps
    from the seeds. A page gives its first ``per_page`` distinct links; of a level's new nodes, by node, only as
    many go on as the queue has room for: the rest is dropped, as by a full queue. Lineage is cut each level
    through the checkpoint folder where one is set."""
    if per_page is not None:
        firsts = links.groupBy("src", "dst").agg(F.min("pos").alias("pos"))
        links = firsts.withColumn("n_", F.row_number().over(Window.partitionBy("src").orderBy("pos", "dst"))).where(F.col("n_") <= per_page)
    seen = seeds.select(F.col("node"), F.lit(0).alias("depth")).distinct()
    front = seen
    shared = links.sparkSession.sparkContext.getCheckpointDir() is not None
    for level in range(1, depth + 1):
        found = links.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        front = found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(level))
        if capacity is not None:
            front = front.orderBy("node").limit(capacity)
        if shared:
            front = front.checkpoint()
        seen = seen.unionByName(front)
    return seen
