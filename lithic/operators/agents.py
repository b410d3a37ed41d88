"""Saved questions that run over search, changes and the graph under a token budget."""

from __future__ import annotations

import datetime as dt
import functools
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithic.functions import text as T
from lithic.operators import changes, graph, models, scans, search, state
from lithic.settings import CATEGORIES, DEFAULTS

TOOLS = ("search", "changes", "entities")
#: Most characters of an agent's texts, and most tokens of a run.
MOST_CHARS = {"name": 100, "instructions": 4_000, "topic": 200}
MOST_TOKENS = 100_000


@dataclass(frozen=True)
class Agent:
    name: str
    instructions: str
    topic: str
    categories: tuple[str, ...] = ()
    window_days: int = 1
    tools: tuple[str, ...] = TOOLS
    max_tokens: int = 8_000
    daily: bool = False
    cost_profile: str = "interactive"
    errors: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self) -> None:
        for name in ("name", "instructions", "topic"):
            object.__setattr__(self, name, (getattr(self, name) or "").strip())
        for name in ("categories", "tools"):
            object.__setattr__(self, name, tuple(dict.fromkeys(x.strip() for x in getattr(self, name) if x is not None)))
        wrong = [f"{n} is blank" for n in ("name", "topic") if not getattr(self, n)]
        wrong += [f"{n} is too long" for n, most in MOST_CHARS.items() if len(getattr(self, n)) > most]
        wrong += [f"unknown category {c}" for c in self.categories if c not in CATEGORIES]
        wrong += [f"unknown tool {t}" for t in self.tools if t not in TOOLS]
        if not self.tools:
            wrong.append("no tool")
        if not 1 <= self.window_days <= DEFAULTS.change_window_days:
            wrong.append("window_days out of range")
        if not 1 <= self.max_tokens <= MOST_TOKENS:
            wrong.append("max_tokens out of range")
        if self.cost_profile not in ("interactive", "batch"):
            wrong.append("unknown cost profile")
        object.__setattr__(self, "errors", tuple(wrong))

    @property
    def seconds(self) -> float:
        """The deadline of a run's model call."""
        return DEFAULTS.interactive_seconds if self.cost_profile == "interactive" else DEFAULTS.batch_seconds


def greedy(costs: Column, budget: Column) -> Column:
    """array<boolean>: items taken in order while they fit; one that does not is passed over and later
    ones may still fit."""
    folded = F.aggregate(costs, F.struct(budget.cast("long").alias("left"), F.array().cast("array<boolean>").alias("taken")), lambda a, c: F.struct((a["left"] - F.when(c <= a["left"], c).otherwise(0)).cast("long").alias("left"), F.concat(a["taken"], F.array(c <= a["left"])).alias("taken")))
    return folded["taken"]


def newest_runs(runs: DataFrame) -> DataFrame:
    """runs (id, started_at) of one agent with their place, the newest first, by id among equals."""
    # places over ranges of times, so that runs of any number go through many tasks
    rows = runs.withColumn("at_", -scans.micros(runs, "started_at")).withColumn("id_", -F.col("id")).withColumn(scans.KEY, F.lit("all"))
    return scans.placed(rows, scans.KEY, ["at_", "id_"]).withColumn("place", (F.col("place") + 1).cast("int")).drop("at_", "id_", scans.KEY)


def once_per_day(runs: DataFrame, agent: str, started: str, key: str) -> DataFrame:
    """An agent's first run of each UTC day, the one of least key among equals."""
    place = F.row_number().over(Window.partitionBy(agent, F.to_date(started)).orderBy(started, key))
    return runs.withColumn("place_", place).where("place_ = 1").drop("place_")


def retrieve(index: search.Index, docs: DataFrame, text: str, question: str, rewritten: str | None, chunks: DataFrame | None = None, k: int = DEFAULTS.chat_sources, budget: int = DEFAULTS.context_chars) -> DataFrame:
    """(pos, key, passage): the question's and the rewritten question's text hits by better position, fused with
    the pages whose chunks (key, score, text) vector search found, as passages within the budget."""
    key = index.key
    hits = search.full_text(index, question, k)
    if rewritten and rewritten != question:
        hits = search.by_best_position(hits, search.full_text(index, rewritten, k), key)
    hits = hits.where(F.col("pos") <= k).select(key, "pos")
    if chunks is not None:
        near = chunks.select(key, F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("pos"))
        lists = hits.withColumn("list", F.lit(1)).unionByName(near.withColumn("list", F.lit(2)))
        fused = lists.groupBy(key).agg(F.sum(1.0 / (DEFAULTS.rrf_k + F.col("pos"))).alias("score"), F.min(F.struct("list", "pos")).alias("first"))
        hits = fused.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "first", key))).where(F.col("pos") <= k).select(key, "pos")
    else:
        chunks = hits.select(key, F.lit(None).cast("string").alias("text")).limit(0)
    found = search.passages(F.broadcast(hits), chunks, docs.select(key, F.col(text).alias("text")), key, rewritten or question)
    return search.within_budget(found, [], "pos", "passage", budget).drop("used")


def answer(question: str, sources: list[tuple[str, str]], ask) -> tuple[str, list[str]]:
    """(text, ids cited): a fixed sentence without sources or without a valid citation."""
    if not sources:
        return models.NO_ANSWER, []
    text, ids = ask(question[: DEFAULTS.question_chars], sources)
    valid = list(dict.fromkeys(i for i in ids if i in {s for s, _ in sources}))
    return (text, valid) if valid else (models.NO_ANSWER, [])


def within(seconds: float, call, *arguments):
    """call(*arguments), or a TimeoutError when it takes longer; the call itself is left to end."""
    pool = ThreadPoolExecutor(max_workers=1)
    try:
        return pool.submit(call, *arguments).result(timeout=seconds)
    finally:
        pool.shutdown(wait=False)


def chat(question: str, rewrite, find, ask, rewrite_seconds: float = DEFAULTS.rewrite_seconds, answer_seconds: float = DEFAULTS.answer_seconds) -> dict:
    """An answered question. A rewriting that fails or is late is done without; nothing found is a fixed answer and
    no call; an answer that fails or is late degrades to what was found. find(question, rewritten or None) gives
    (id, text) passages."""
    question = question[: DEFAULTS.question_chars]
    try:
        rewritten = within(rewrite_seconds, rewrite, question)
    except Exception:  # noqa: BLE001  whatever went wrong, the question itself is searched
        rewritten = None
    passages = find(question, rewritten)
    if not passages:
        return {"answer": models.NO_ANSWER, "sources": [], "results": [], "degraded": False}
    results = [i for i, _ in passages]
    try:
        text, cited = within(answer_seconds, answer, question, passages, ask)
    except Exception:  # noqa: BLE001  whatever went wrong, the results stand
        return {"answer": "", "sources": [], "results": results, "degraded": True}
    return {"answer": text, "sources": [(i, t) for c in cited for i, t in passages if i == c], "results": results, "degraded": False}


def cited_sources(answers: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """(key, place, id, text) of the sources (key, id, text) that answers (key, citations) cite, once each and in order."""
    asked = answers.select(key, F.posexplode(F.array_distinct("citations")).alias("place", "id"))
    found = asked.join(sources, [key, "id"])
    return found.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("place"))).select(key, "place", "id", "text")


# tools: rows (tool_no, n, id, tool, url, text)


def search_tool(passages: DataFrame, url: str) -> DataFrame:
    """Passages (pos, url, passage) in their order."""
    return passages.select(F.lit(1).alias("tool_no"), F.col("pos").cast("int").alias("n"), F.concat(F.lit("S"), F.col("pos").cast("string")).alias("id"), F.lit("search").alias("tool"), F.col(url).cast("string").alias("url"), F.col("passage").alias("text"))


def changes_tool(records: DataFrame, agent: Agent, now: dt.datetime) -> DataFrame:
    """The newest summarized changes in the agent's window and categories."""
    rows = changes.since(records, now - dt.timedelta(days=agent.window_days), now, list(agent.categories), True, DEFAULTS.agent_sources)[1]
    n = F.row_number().over(Window.orderBy(F.desc("detected_at"), F.desc("id")))
    numbered = rows.withColumn("n", n)
    return numbered.select(F.lit(2).alias("tool_no"), "n", F.concat(F.lit("C"), F.col("n").cast("string")).alias("id"), F.lit("changes").alias("tool"), F.col("url").cast("string").alias("url"), changes.as_source().alias("text"))


def entities_tool(mentions: DataFrame, results: DataFrame, names: DataFrame, page: str, entity: str, at: str, most: int = DEFAULTS.listed_entities) -> DataFrame:
    """The entities on most result pages, each with its newest pages and those it appears with. mentions: (page, entity,
    at); names: (entity, type, key, display). Fixed wording."""
    top = graph.most_mentioned(mentions, results, page, entity, most).withColumn("n", F.row_number().over(Window.orderBy(F.desc("pages"), entity))).select(entity, "n")
    mine = F.broadcast(top.select(entity))
    on = graph.newest_pages(mentions.join(mine, entity, "left_semi"), page, entity, at)
    # only pages of the top entities can share one with them
    around = mentions.join(mentions.join(mine, entity, "left_semi").select(page).distinct(), page, "left_semi")
    beside = graph.related(around, page, entity).join(mine, entity, "left_semi").where(F.col("place") <= most)
    other = names.select(F.col(entity).alias("other"), F.col("type").alias("t_"), F.col("display").alias("d_"))
    line = F.concat("d_", F.lit(" ("), "t_", F.lit(", "), F.col("shared").cast("string"), F.lit(" shared pages)"))
    beside = beside.join(other, "other").groupBy(entity).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("l")))), lambda x: x["l"]), ", ").alias("beside"))
    rows = top.join(names, entity).join(on, entity).join(beside, entity, "left")
    text = F.concat(F.lit("Entity: "), "display", F.lit(" ("), "type", F.lit(")\nMentioned by: "), F.array_join(F.transform(F.slice("pages", 1, most), lambda p: p.cast("string")), ", "), F.coalesce(F.concat(F.lit("\nAppears with: "), "beside"), F.lit("")))
    return rows.select(F.lit(3).alias("tool_no"), "n", F.concat(F.lit("E"), F.col("n").cast("string")).alias("id"), F.lit("entities").alias("tool"), entity_link(F.col("type"), F.col("key")).alias("url"), text.alias("text"))


def collected(*tools: DataFrame) -> DataFrame:
    """Tools' rows one tool behind the other, in the fixed order of the tools, with their place."""
    both = functools.reduce(lambda a, b: a.unionByName(b), tools)
    return both.withColumn("place", F.row_number().over(Window.orderBy("tool_no", "n")))


def source_text(url: Column, summary: Column, text: Column) -> Column:
    """What a model sees of one page. Fixed wording."""
    return F.concat(F.lit("URL: "), url, F.lit("\n"), F.coalesce(F.concat(F.lit("Summary: "), summary, F.lit("\n")), F.lit("")), F.lit("\n"), text)


class Store:
    """Agents and their runs as tables (id, name, ...) and (id, agent_id, ...): every change gives new ones."""

    def __init__(self, agents: DataFrame, runs: DataFrame) -> None:
        self.agents, self.runs = agents, runs

    def all(self) -> DataFrame:
        return self.agents.orderBy("name", "id")

    def put(self, row: DataFrame) -> Store:
        """A new agent, or another form of the one of that id; a name that another agent has is an error."""
        taken = self.agents.join(row.select("name", F.col("id").alias("new_")), "name").where(F.col("id") != F.col("new_"))
        if taken.limit(1).count():
            raise ValueError("the name is taken")
        return Store(state.upsert(self.agents, row, "id", "id"), self.runs)

    def delete(self, agent_id: int) -> Store:
        """Without an agent and its runs."""
        gone = self.agents.where(F.col("id") == agent_id)
        return Store(state.without(self.agents, gone, "id"), state.without(self.runs, gone.select(F.col("id").alias("agent_id")), "agent_id"))


def run(agent: Agent, material: list[tuple[str, str]], ask) -> dict:
    """One run over collected (id, text) material, best first: its status, report and sources."""
    if agent.errors:
        return {"status": "failed", "reason": "error", "report": None, "sources": []}
    if not material:
        return {"status": "succeeded", "reason": None, "report": models.NO_REPORT, "sources": []}
    cost = lambda t: (len(t) + 3) // 4
    left = agent.max_tokens - DEFAULTS.prompt_reserve_tokens - cost(agent.instructions) - cost(agent.topic)
    kept = []
    for i, text in material:
        if cost(text) <= left:
            kept.append((i, text))
            left -= cost(text)
    if not kept:
        return {"status": "failed", "reason": "budget", "report": None, "sources": []}
    report, ids = ask(agent.instructions, kept)
    valid = [s for s in dict.fromkeys(ids) if s in {k for k, _ in kept}]
    return {"status": "succeeded", "reason": None, "report": report if valid else models.NO_REPORT, "sources": valid}


def source_block(sources: DataFrame, key: str, url: str, text: str) -> DataFrame:
    block = F.concat(F.lit('<source id="'), F.col(key).cast("string"), F.lit('" url="'), F.col(url), F.lit('">'), T.strip_source_tags(F.col(text)), F.lit("</source>"))
    return sources.withColumn("block", block)


def entity_link(kind: Column, key: Column) -> Column:
    return F.concat(F.lit("/api/entities/"), kind, F.lit("/"), F.replace(F.url_encode(key), F.lit("+"), F.lit("%20")))
