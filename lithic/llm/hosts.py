"""Quality rules of documents and of the hosts they come from.

Each document is measured by itself. A host's failure rate over its documents is shrunk towards
the corpus by a beta prior fitted to all hosts' rates (method of moments), so that a host of few
documents is judged by the corpus and one of many by itself. Documents of a host whose shrunk rate
lies above ``MOST_FAILED`` are dropped with it.

Scale: measuring is one map over the texts. Hosts are summed before the shuffle, so a hot host costs
a row per task; the prior is one row. The verdicts join back as a small side that the optimiser
broadcasts when it is small, and as a skew-splitting sort-merge join when it is not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, table

LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
MOST_FAILED = 0.5
SPACES = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, the first time included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    if len(number) == n:
        return 0
    _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, window, counts = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    often = counts[window] > 1
    inside = np.zeros(n, dtype=bool)
    for k in range(3):
        inside[k : n - 2 + k] |= often
    return int(inside.sum())


def measure(raw: bytes | None) -> tuple[int, int, int, int, int]:
    """MEASURES of a text's UTF-8 bytes; null counts as empty."""
    raw = raw or b""
    words = raw.split()
    solid = raw.translate(None, SPACES)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(words), len(solid.decode(errors="replace")), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def _measure(batches):
    for batch in batches:
        found = [measure(x) for x in batch.column("text").to_pylist()]
        columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(len(MEASURES))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), *columns], ["doc_id", "source", *MEASURES])


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, source, the five measures, base_failed) per row of docs."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("binary").alias("text")).mapInArrow(_measure, "doc_id long, source string, " + ", ".join(f"{m} long" for m in MEASURES))
    return rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")))


def host_verdicts(measured: DataFrame, most_failed: float = MOST_FAILED) -> DataFrame:
    """(source, n_docs, n_failed, shrunk_rate, host_rejected) per source; a null source is one host.

    Prior: a beta distribution whose mean and variance are those of the hosts' rates. Where the
    rates vary no more than chance allows (or there is one host) the prior weighs as much as all
    documents, where they vary more than any beta can it weighs nothing.
    """
    hosts = measured.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    hosts = hosts.withColumn("rate", F.col("n_failed") / F.col("n_docs"))
    prior = hosts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("mean"),
        F.avg("rate").alias("centre"),
        F.avg(F.col("rate") * F.col("rate")).alias("square"),
        F.avg(1 / F.col("n_docs")).alias("noise"),
        F.sum("n_docs").cast("double").alias("all_docs"),
    )
    # Var(rate) = m (1 - m) (noise + (1 - noise) / (weight + 1)) for a beta of that weight
    chance = F.col("mean") * (1 - F.col("mean"))
    between = (F.col("square") - F.col("centre") * F.col("centre") - chance * F.col("noise")) / F.when(chance * (1 - F.col("noise")) > 0, chance * (1 - F.col("noise")))
    prior = prior.select("mean", F.when(F.coalesce(between, F.lit(0.0)) <= 1 / (F.col("all_docs") + 1), F.col("all_docs")).when(between >= 1, F.lit(0.0)).otherwise(1 / between - 1).alias("weight"))
    shrunk = (F.col("mean") * F.col("weight") + F.col("n_failed")) / (F.col("weight") + F.col("n_docs"))
    return hosts.crossJoin(F.broadcast(prior)).select("source", "n_docs", "n_failed", shrunk.alias("shrunk_rate"), (F.round(shrunk, 9) > most_failed).alias("host_rejected"))


def judge(docs: DataFrame, most_failed: float = MOST_FAILED) -> DataFrame:
    """Per row of docs: doc_id, source, measures, base_failed, kept and the host's shrunk_rate.

    Null text counts as empty, a text of any length is measured whole, a null source is a host of its own.
    Repeated rows count as often as they come, and a rate that ties with the limit is not above it. Other
    columns are not read, whatever their names. No rows: no rows.
    """
    measured = cut(measures(docs))
    hosts = host_verdicts(measured, most_failed).select(F.col("source").alias("host"), "shrunk_rate", "host_rejected")
    joined = measured.join(hosts, F.col("source").eqNullSafe(F.col("host")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")).drop("host", "host_rejected")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *MEASURES, "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM w WHERE len(ws) >= 3),
win AS (SELECT doc_id, p, ws[p] AS a, ws[p + 1] AS b, ws[p + 2] AS c FROM pos),
often AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM often) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, w.source, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN dup ON dup.doc_id = w.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS k FROM f GROUP BY source),
r AS (SELECT sum(k) * 1.0 / sum(n) AS mean, avg(k * 1.0 / n) AS centre, avg((k * 1.0 / n) * (k * 1.0 / n)) AS square, avg(1.0 / n) AS noise, CAST(sum(n) AS DOUBLE) AS total FROM h),
v AS (SELECT mean, total, (square - centre * centre - mean * (1 - mean) * noise) / nullif(mean * (1 - mean) * (1 - noise), 0) AS between_hosts FROM r),
p AS (SELECT mean, CASE WHEN coalesce(between_hosts, 0) <= 1 / (total + 1) THEN total WHEN between_hosts >= 1 THEN 0 ELSE 1 / between_hosts - 1 END AS weight FROM v),
s AS (SELECT source, round((mean * weight + k) / (weight + n), 9) > 0.5 AS rejected FROM h, p)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM f JOIN s ON f.source IS NOT DISTINCT FROM s.source
"""
