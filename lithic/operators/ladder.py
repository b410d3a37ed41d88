"""Calls that climb a ladder of providers under quotas: the router picks who is asked, and a poor answer asks the next."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.operators import models, quota
from lithic.settings import DEFAULTS
from lithic.sources import workspace


def escalate(calls: DataFrame, providers: dict[str, Callable[[str, str], str]], quotas: DataFrame, task: str, field: str, floor: float = DEFAULTS.min_entity_confidence, escalations: int = DEFAULTS.max_escalations) -> DataFrame:
    """calls (call_id, text, estimate, interactive) with provider, value, confidence, tried and error.

    Each round routes what is still open to the first provider of the ladder, in the order of ``providers``, that was not tried
    and has quota (:func:`lithic.operators.quota.route`), and asks it once. An answer as sure as ``floor`` ends a
    call; after the last round, or where nobody is left, the surest answer counts. error: quota if no provider could be asked, failed
    if all that were asked failed. Rounds are ``escalations`` and one more, each cut so that no answer is asked for twice.
    """
    ask = {name: models.task_udf(task, field, provider) for name, provider in providers.items()}
    empty = F.struct(F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("provider"))
    open_, done = calls.withColumn("tried", F.array().cast("array<string>")).withColumn("best_", empty), None
    for _ in range(escalations + 1):
        routed = quota.route(open_, list(providers), quotas)
        # each provider's function sees the texts that were routed to it, and nulls, which it passes over
        for name, of in ask.items():
            routed = routed.withColumn(f"a_{name}", of(F.when(F.col("provider") == name, F.col("text"))))
        answer = functools.reduce(lambda rest, name: F.when(F.col("provider") == name, F.col(f"a_{name}")).otherwise(rest), providers, F.lit(None))
        rows = routed.withColumn("answer_", answer).drop(*[f"a_{name}" for name in ask])
        given = F.when(F.col("answer_.value").isNotNull(), F.struct(F.col("answer_.confidence").alias("confidence"), F.col("answer_.value").alias("value"), F.col("provider").alias("provider")))
        better = F.when(given.isNotNull() & (F.col("best_.confidence").isNull() | (given["confidence"] > F.col("best_.confidence"))), given).otherwise(F.col("best_"))
        rows = rows.withColumn("best_", better).withColumn("tried", F.when(F.col("provider").isNotNull(), F.concat("tried", F.array("provider"))).otherwise(F.col("tried")))
        rows = workspace.cut(rows)
        over = F.col("provider").isNull() | F.coalesce(F.col("best_.confidence") >= floor, F.lit(False))
        ended = rows.where(over).select(*calls.columns, "tried", "best_")
        done = ended if done is None else done.unionByName(ended)
        open_ = rows.where(~over).select(*calls.columns, "tried", "best_")
    found = done.unionByName(open_)
    error = F.when(F.col("best_.value").isNotNull(), None).when(F.size("tried") == 0, "quota").otherwise("failed")
    return found.select(*calls.columns, "tried", F.col("best_.provider").alias("provider"), F.col("best_.value").alias("value"), F.col("best_.confidence").alias("confidence"), error.alias("error"))
