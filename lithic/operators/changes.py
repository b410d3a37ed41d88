"""What changed between versions, and the queries over it."""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.functions import text as T
from lithic.settings import CATEGORIES, DEFAULTS


def diff(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """pairs with added, removed (arrays of sentences) and changed_chars."""
    rows = pairs.withColumn("diff_", T.sentence_changes(F.col(old), F.col(new))).withColumns({"added": F.col("diff_.added"), "removed": F.col("diff_.removed")})
    return rows.drop("diff_").withColumn("changed_chars", T.changed_chars(F.col("added"), F.col("removed")))


def capped(parts: Column, most: int = DEFAULTS.diff_max_chars) -> Column:
    return F.left(F.array_join(parts, "\n"), F.lit(most))


def entity_delta(old: Column, new: Column) -> tuple[Column, Column]:
    """(added, removed) entities by type and key."""
    ids = lambda es: F.transform(es, lambda e: F.concat_ws(":", e["type"], e["key"]))
    missing = lambda a, b: T.let(ids(b), lambda held: F.filter(a, lambda e: ~F.array_contains(held, F.concat_ws(":", e["type"], e["key"]))))
    return missing(new, old), missing(old, new)


def status(changed_chars: Column, entities_changed: Column, category_changed: Column, least: int = DEFAULTS.diff_min_chars) -> Column:
    """trivial for a small change of text alone, else pending."""
    return F.when(~entities_changed & ~category_changed & (changed_chars < least), "trivial").otherwise("pending")


def since(changes: DataFrame, start: dt.datetime, now: dt.datetime, categories: list[str] = (), summarized_only: bool = False, most: int = DEFAULTS.max_page_size) -> tuple[DataFrame, DataFrame]:
    """(total, newest changes): not trivial, from ``start`` on, of the categories if any are named."""
    if start > now or now - start > dt.timedelta(days=DEFAULTS.change_window_days):
        raise ValueError("start must lie in the last days and not in the future")
    if most < 1 or any(c not in CATEGORIES for c in categories):
        raise ValueError("limit below 1 or unknown category")
    tests = [F.col("status") != "trivial", F.col("detected_at") >= F.lit(start)]
    if categories:
        tests.append(F.col("category_to").isin(*categories))
    if summarized_only:
        tests.append(F.col("summary").isNotNull())
    rows = changes.where(functools.reduce(lambda a, b: a & b, tests))
    return rows.agg(F.count("*").alias("total")), rows.orderBy(F.desc("detected_at"), F.desc("id")).limit(min(most, DEFAULTS.max_page_size))


def records(pairs: DataFrame) -> DataFrame:
    """Change records of pairs (old, new, old_entities, new_entities, category_from, category_to): the columns of pairs
    but for texts and entities, with added_text and removed_text (capped), entities_added and entities_removed,
    changed_chars and status."""
    rows = diff(pairs, "old", "new")
    added, removed = entity_delta(F.coalesce("old_entities", F.array().cast(pairs.schema["old_entities"].dataType)), F.coalesce("new_entities", F.array().cast(pairs.schema["new_entities"].dataType)))
    rows = rows.withColumn("entities_added", added).withColumn("entities_removed", removed)
    moved = ~F.col("category_from").eqNullSafe(F.col("category_to"))
    rows = rows.withColumn("status", status(F.col("changed_chars"), (F.size("entities_added") > 0) | (F.size("entities_removed") > 0), moved))
    return rows.withColumn("added_text", capped(F.col("added"))).withColumn("removed_text", capped(F.col("removed"))).drop("old", "new", "old_entities", "new_entities", "added", "removed")


def listed(entities: Column) -> Column:
    """display (type), ... of entities; empty for none."""
    return F.array_join(F.transform(entities, lambda e: F.concat(e["display"], F.lit(" ("), e["type"], F.lit(")"))), ", ")


def _line(label: str, value: Column, end: str) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value, F.lit(end))).otherwise(F.lit(""))


def describe() -> Column:
    """What a summarizer is told of a change record with url, from_version and to_version. Fixed wording."""
    moved = F.col("category_from").isNotNull() & ~F.col("category_from").eqNullSafe(F.col("category_to"))
    text = lambda c: F.when(F.trim(c) != "", F.col(c))
    return F.concat(
        F.lit("Summarize in 1 to 3 sentences what changed on this page between version "), F.col("from_version").cast("string"), F.lit(" and "), F.col("to_version").cast("string"), F.lit(" ("), F.col("url"), F.lit(").\n"),
        F.when(moved, F.concat(F.lit("Category: from "), F.col("category_from"), F.lit(" to "), F.coalesce("category_to", F.lit("null")), F.lit(".\n"))).otherwise(F.lit("")),
        _line("New entities: ", listed(F.col("entities_added")), ".\n"), _line("Removed entities: ", listed(F.col("entities_removed")), ".\n"),
        _line("Added text:\n", text("added_text"), "\n"), _line("Removed text:\n", text("removed_text"), "\n"),
    )


def as_source() -> Column:
    """A summarized change as an agent's source. Fixed wording."""
    moved = ~F.col("category_from").eqNullSafe(F.col("category_to"))
    return F.concat(
        F.lit("Change on "), F.col("url"), F.lit(" (version "), F.col("from_version").cast("string"), F.lit(" to "), F.col("to_version").cast("string"), F.lit(", detected "), F.date_format("detected_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("): "), F.col("summary"),
        F.when(moved, F.concat(F.lit("\nCategory: "), F.coalesce("category_from", F.lit("null")), F.lit(" to "), F.coalesce("category_to", F.lit("null")))).otherwise(F.lit("")),
        _line("\nEntities added: ", listed(F.col("entities_added")), ""), _line("\nEntities removed: ", listed(F.col("entities_removed")), ""),
    )
