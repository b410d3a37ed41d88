"""The chain of processors over documents (url, text, done): sanitized texts go in, enrichment and statuses come out.

``done`` says that this content was processed before. Every step adds its value and ``<name>_status``: success,
skipped (no text), unchanged (done before), failed (the model did) or waiting (only quota was missing).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.functions import entities as E
from lithic.functions import text as T
from lithic.operators import models
from lithic.sources import workspace

Step = Callable[[DataFrame], DataFrame]


def status(text: Column, done: Column, error: Column) -> Column:
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "skipped").when(done, "unchanged").when(error == "quota", "waiting").when(error.isNotNull(), "failed").otherwise("success")


def _needed(docs: DataFrame) -> Column:
    """The text where a model has to be asked; null where not, which no model is asked about."""
    return F.when((F.trim(F.coalesce("text", F.lit(""))) != "") & ~F.col("done"), F.col("text"))


def _asked(docs: DataFrame, name: str, ask: Callable[[Column], Column], text: Column, unless: Column | None = None) -> DataFrame:
    """docs with ``name``, the answer: one pass, in which rows that need none ask about a null, which is no call."""
    need = _needed(docs).isNotNull() if unless is None else _needed(docs).isNotNull() & unless.isNull()
    return docs.withColumn(name, ask(F.when(need, text)))


def language(provider=models.offline) -> Step:
    """A page's language by its frequent words, else by the model, as a code."""

    def step(docs: DataFrame) -> DataFrame:
        rows = docs.withColumn("guess_", T.language(F.col("text")))
        rows = _asked(rows, "l_", models.task_udf("detect", "code", provider), F.col("text"), F.col("guess_"))
        code = F.when(_needed(rows).isNotNull() & (F.col("guess_").isNotNull() | F.col("l_.error").isNull()), T.language_code(F.coalesce("guess_.code", "l_.value")))
        return rows.withColumn("language", code).withColumn("language_status", status(F.col("text"), F.col("done"), F.col("l_.error"))).drop("guess_", "l_")

    return step


def summary(provider=models.offline) -> Step:
    def step(docs: DataFrame) -> DataFrame:
        rows = _asked(docs, "s_", models.task_udf("summarize", "text", provider), F.col("text"))
        return rows.withColumn("summary", F.col("s_.value")).withColumn("summary_status", status(F.col("text"), F.col("done"), F.col("s_.error"))).drop("s_")

    return step


def category(provider=models.offline) -> Step:
    """The taxonomy stands before the text that the model gets; what is not in it becomes other."""

    def step(docs: DataFrame) -> DataFrame:
        rows = _asked(docs, "c_", models.task_udf("classify", "category", provider), F.concat(F.lit(models.TAXONOMY), F.col("text")))
        name, confidence = models.category(F.col("c_.value"), F.col("c_.confidence"))
        good = F.col("c_.value").isNotNull()
        rows = rows.withColumn("category", F.when(good, name)).withColumn("category_confidence", F.when(good, confidence))
        return rows.withColumn("category_status", status(F.col("text"), F.col("done"), F.col("c_.error"))).drop("c_")

    return step


def named_entities(provider=models.offline, key: str = "url") -> Step:
    """Patterns over whole texts and the model's names over capped ones, merged. The answers are used more than once, so
    rows are cut there: no later use asks again."""

    def step(docs: DataFrame) -> DataFrame:
        rows = workspace.cut(_asked(docs, "e_", models.entities_udf(provider), F.col("text")))
        outcome = F.when(F.col("e_.error").isNull(), "ok").otherwise(F.col("e_.error"))
        need = rows.where(_needed(rows).isNotNull())
        found = E.of_documents(E.pattern_entities(need, key, "text"), need.select(key, "e_", F.col("e_.entities").alias("entities")), key, outcome)
        joined = rows.join(found.select(key, "entities"), key, "left")
        return joined.withColumn("entities_status", status(F.col("text"), F.col("done"), F.col("e_.error"))).drop("e_")

    return step


#: The steps' places in the chain.
ORDER = {"language": 10, "summary": 30, "category": 40, "entities": 50}


def chain(docs: DataFrame, steps: dict[str, Step]) -> DataFrame:
    """The steps in the order of their places, whatever the order in which they are named."""
    for name in sorted(steps, key=ORDER.__getitem__):
        docs = docs.transform(steps[name])
    return docs


def overall(names: list[str]) -> Column:
    """failed if a step failed, else waiting if one waits, else processed."""
    any_ = lambda s: F.array_contains(F.array(*[F.col(f"{n}_status") for n in names]), s)
    return F.when(any_("failed"), "failed").when(any_("waiting"), "waiting").otherwise("processed")
