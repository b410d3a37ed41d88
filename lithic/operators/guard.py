"""Denylists, forbidden patterns and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.functions import urls


def not_banned(pages: DataFrame, hashes: DataFrame, url: str = "url") -> DataFrame:
    """Pages whose domain's MD5 is in no line of the list."""
    return pages.join(hashes.select(F.col("value").alias("banned_")).distinct(), F.md5(urls.domain(F.col(url))) == F.col("banned_"), "left_anti")


def denied_hosts(pages: DataFrame, hosts: DataFrame, url: str = "url") -> DataFrame:
    return pages.join(hosts.select(F.lower("value").alias("denied_")).distinct(), F.lower(urls.host(F.col(url))) == F.col("denied_"), "left_semi")


def pattern_reason(text: Column, patterns: list[str]) -> Column:
    """text-pattern:n for the first pattern that the text matches, in any case; null if none."""
    reason = F.lit(None).cast("string")
    for n, pattern in reversed(list(enumerate(patterns, 1))):
        reason = F.when(text.rlike(f"(?i){pattern}"), F.lit(f"text-pattern:{n}")).otherwise(reason)
    return reason


def guard(pages: DataFrame, hosts: DataFrame, patterns: list[str], url: str = "url", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(clean pages, audit rows (url, reason)); a denied host goes before any pattern."""
    listed = hosts.select(F.lower("value").alias("denied_")).distinct().withColumn("hit_", F.lit(True))
    judged = pages.join(listed, F.lower(urls.host(F.col(url))) == F.col("denied_"), "left").withColumn("reason", F.when(F.col("hit_"), "url-denylist").otherwise(pattern_reason(F.col(text), patterns))).drop("denied_", "hit_")
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").select(url, "reason")


def reason_classes(audit: DataFrame) -> DataFrame:
    """(reason_class, n): patterns count as one class, whatever their number."""
    kind = F.when(F.col("reason").startswith("text-pattern"), "text-pattern").otherwise(F.col("reason"))
    return audit.groupBy(kind.alias("reason_class")).agg(F.count("*").alias("n"))


def blank_quarantined(versions: DataFrame, quarantined: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """versions with the columns nulled where the key is quarantined."""
    q = quarantined.select(F.col(key).alias("q_")).distinct()
    joined = versions.join(q, F.col(key) == F.col("q_"), "left")
    return joined.select(*[F.when(F.col("q_").isNull(), F.col(c)).alias(c) if c in columns else F.col(c) for c in versions.columns])
