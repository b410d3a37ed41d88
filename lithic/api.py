"""What a client asks for, as functions that check their arguments and give DataFrames: search, semantic search,
stats, changes, entities, chat and agents. A server would map its paths onto these."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.functions import text as T
from lithic.operators import agents, changes, graph, search
from lithic.settings import DEFAULTS


def search_page(index: search.Index, pages: DataFrame, query: str, page: int = 0, size: int = 20, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, total): a blank query, a page below 0 or a size below 1 is an error, a size above the most is the most
    and a query is cut at its limit. Results have the page's snippet; a quarantined page is none."""
    if not query.strip():
        raise ValueError("the query is blank")
    hits, total = search.hybrid(index, query[: DEFAULTS.query_chars], vectors, min(size, DEFAULTS.max_page_size), page)
    shown = search.hydrate(hits, pages, index.key)
    return shown.select(index.key, "score", search.headline(F.col("text"), query).alias("snippet")).orderBy(F.desc("score"), index.key), total


def semantic_page(hits: DataFrame | None, pages: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(results, total) by vectors alone; an error where there is no embedder."""
    found, _ = search.semantic_page(hits)
    shown = search.hydrate(found, pages, key).select(key, "score", T.snippet(F.col("text")).alias("snippet"))
    return shown.orderBy(F.desc("score"), key), shown.agg(F.count("*").alias("total"))


def stats(pages: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages and versions, pages by source type)."""
    totals = pages.agg(F.count("*").alias("pages")).crossJoin(F.broadcast(versions.agg(F.count("*").alias("versions"))))
    return totals, pages.groupBy("source_type").agg(F.count("*").alias("pages"))


def changes_page(records: DataFrame, since: str | None, now: dt.datetime, category: str | None = None, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """(total, changes) since an ISO time, a day ago by default, not in the future and at most thirty days back."""
    start = now - dt.timedelta(days=1) if since is None else dt.datetime.fromisoformat(since)
    return changes.since(records, start, now, [category] if category else [], most=limit)


def entity(entities: DataFrame, mentions: DataFrame, kind: str, key: str) -> DataFrame:
    """An entity with its pages, newest versions first; a LookupError if there is none, a ValueError for no type."""
    found = graph.lookup(entities, kind, key)
    if not found.limit(1).count():
        raise LookupError(f"{kind} {key}")
    one = F.broadcast(found.select("type", "key"))  # a type and a key name one entity
    on = mentions.join(one, ["type", "key"], "left_semi").withColumn("id", F.concat_ws(":", "type", "key"))
    pages = graph.newest_pages(on, "url", "id", "version")
    return found.select("type", "key", "display", F.concat_ws(":", "type", "key").alias("id")).join(pages, "id", "left").select("type", "key", "display", "pages")


def ask(question: str, rewrite, find, answer) -> dict:
    """A chat's answer; a blank question is an error and a long one is cut."""
    if not question.strip():
        raise ValueError("the question is blank")
    return agents.chat(question[: DEFAULTS.question_chars], rewrite, find, answer)


def agent(store: agents.Store, agent_id: int) -> DataFrame:
    """An agent by id; a LookupError if there is none."""
    found = store.agents.where(F.col("id") == agent_id)
    if not found.limit(1).count():
        raise LookupError(f"agent {agent_id}")
    return found
