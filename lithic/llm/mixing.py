"""Mixing sources to target weights by capped water-filling.

Every source asks for a share of the whole by its weight; a source that would be read more often
than the epoch limit is clamped there and what it cannot take is shared again, by weight, until no
source is above. Sorted by limit over weight, the clamped sources are a prefix, so the fixed point
of that sharing has a closed form over running sums.

A source's target is met with whole repetitions of all its documents, then documents in the order
of a seeded hash; the document at which the target falls takes a fraction of a repetition.

Scale: sizes are summed per source and hash bin before the shuffle, so a hot source is never
ordered as a whole: only the bin at which its target falls is, one 4,096th of its documents. Only
the table of sources is ever ordered by a single task. Texts do not move, but for those in the edge bins
and, where the sources are too many for a broadcast, those of sources that hold few documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import SHARES, cut, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST_EPOCHS, SEED = (3, 1, 2), 1.5, 2, "mix-17"
#: Most sources, and bytes of their names, that are broadcast as a whole.
FEW_SOURCES, FEW_BYTES = 20_000, 2_000_000


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, n_docs, source_size, target, whole, rest): whole repetitions of a source and the words that
    are to come from a further, fractional one. sizes has (source, size, n_docs), any rows a source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n_docs").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights)).cast("int") + 1)
    ranked = by_source.withColumn("rank", rank).withColumn("weight", weight).withColumn("most", epochs * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        ranked.withColumn("wanted", share * F.sum("source_size").over(everything))
        .withColumn("clamped_before", F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("wanted") - F.col("clamped_before")) / F.col("weight_left"))
        .withColumn("clamped", F.col("most") / F.col("weight") <= F.col("level"))
        .withColumn("level", F.max(F.when(~F.col("clamped"), F.col("level"))).over(everything))
    )
    target = F.when(F.col("clamped"), F.col("most").cast("double")).otherwise(F.col("level") * F.col("weight"))
    found = ranked.withColumn("target", target)
    whole = F.when(F.col("clamped"), F.lit(epochs).cast("long")).when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0).cast("long"))
    found = found.withColumn("whole", whole)
    return found.select("source", "n_docs", "source_size", "target", "whole", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _places(doc_id: Column, source: Column) -> list[Column]:
    """doc_id, source, draw (the seeded hash that orders a source) and its bin."""
    draw = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return [doc_id.cast("long").alias("doc_id"), source.cast("string").alias("source"), draw.alias("draw"), F.substring(draw, 1, 3).alias("bin")]


def goals_of(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = MOST_EPOCHS) -> DataFrame:
    """targets of rows (source, size, bin) as (host, n_docs, source_size, target, whole, rest, edge_bin,
    edge_before): the bin in which the rest ends and the words in the bins before it."""
    bins = cut(rows.groupBy("source", "bin").agg(F.sum("size").alias("size"), F.count("*").alias("n_docs")))
    goals = cut(targets(bins, weights, share, epochs)).withColumnRenamed("source", "host")
    upto = bins.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("bin")))
    at = upto.join(goals, F.col("source").eqNullSafe(F.col("host"))).where("upto > rest").groupBy("host").agg(F.min(F.struct("bin", (F.col("upto") - F.col("size")).alias("before"))).alias("edge"))
    edged = goals.join(at.withColumnRenamed("host", "named"), F.col("host").eqNullSafe(F.col("named")), "left")
    return cut(edged.select("host", goals["n_docs"], "source_size", "target", "whole", "rest", F.col("edge.bin").alias("edge_bin"), F.col("edge.before").alias("edge_before")))


def _with_goals(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """rows with their source's goal. A small table of sources is broadcast; of a large one the sources with
    over a SHARES-th of the documents are, and the others meet their rows by shuffle."""
    same = F.col("source").eqNullSafe(F.col("host"))
    n, size, docs = goals.agg(F.count("*"), F.sum(F.octet_length("host")), F.sum("n_docs")).first()
    goals = goals.drop("n_docs") if n <= FEW_SOURCES and (size or 0) <= FEW_BYTES else goals
    if "n_docs" not in goals.columns:
        return rows.join(F.broadcast(goals), same)
    heavy = goals.where(F.col("n_docs") * SHARES > F.lit(docs)).drop("n_docs")
    light = goals.where(F.col("n_docs") * SHARES <= F.lit(docs)).drop("n_docs")
    rest = rows.join(F.broadcast(heavy.select(F.col("host").alias("big"))), F.col("source").eqNullSafe(F.col("big")), "left_anti")
    return rows.join(F.broadcast(heavy), same).unionByName(rest.join(light, same))


def planned(rows: DataFrame, goals: DataFrame, size: Column) -> DataFrame:
    """rows (doc_id, source, draw, bin and any others) with ``size``, their source's goal and ``extra``, the words
    of the fractional repetition. Only the rows of a source's edge bin are shuffled and ordered."""
    joined = _with_goals(rows, goals)
    inside = F.col("edge_bin").isNull() | (F.col("bin") < F.col("edge_bin"))
    # a source without an edge has no more words than the rest asks for
    settled = joined.where(inside | (F.col("bin") > F.col("edge_bin"))).withColumn("size", size).withColumn("extra", F.when(inside & (F.col("rest") > 0), F.col("size")).otherwise(F.lit(0).cast("long")))
    within = Window.partitionBy("source").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("rest") - F.col("edge_before") - (F.sum("size").over(within) - F.col("size"))
    edge = joined.where(F.col("bin") == F.col("edge_bin")).withColumn("size", size).withColumn("extra", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left)))
    return settled.unionByName(edge)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = MOST_EPOCHS) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, whole, extra, taken.

    ``whole`` repetitions are taken of all its words and ``extra`` words of one more. A null or empty text has
    size 0, a text of any length is counted whole; a null source is a source of its own that comes last, a
    null doc_id draws like an empty one. Repeated rows count each; of rows that tie in id and size any may
    come first. Other columns are not read, whatever their names. No rows: no rows.
    """
    rows = cut(docs.select(*_places(F.col("doc_id"), F.col("source")), size_of(F.col("text")).alias("size")))
    plan = planned(rows, goals_of(rows, weights, share, epochs), F.col("size"))
    return plan.select("doc_id", "source", "size", "source_size", "target", "whole", "extra", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def repeated(docs: DataFrame) -> DataFrame:
    """The mixed corpus, in the columns of docs: each row as often as the mix takes it whole, and once more
    with as many of its first words as are taken of one more repetition, if any. Every row is planned by
    itself, equal ones too. Columns of any name are kept; n_chars, where docs has it, follows the text."""
    row = lambda c: F.col("row").getField(c)
    sizes = docs.select(*_places(F.col("doc_id"), F.col("source")), size_of(F.col("text")).alias("size"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    plan = planned(rows.select("row", *_places(row("doc_id"), row("source"))), goals_of(sizes), size_of(row("text")))
    copies = (F.col("whole") + F.when(F.col("extra") > 0, 1).otherwise(0)).cast("int")
    plan = plan.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    cut_here = (F.col("copy") > F.col("whole")) & (F.col("extra") < F.col("size"))
    part = F.array_join(F.slice(F.regexp_extract_all(row("text"), F.lit(WORD), F.lit(0)), 1, F.greatest(F.col("extra"), F.lit(1)).cast("int")), " ")
    text = F.when(cut_here, part).otherwise(row("text"))
    kept = {"text": text}
    if "n_chars" in docs.columns:  # the text is cut by now
        kept["n_chars"] = F.when(cut_here, F.length(part).cast(docs.schema["n_chars"].dataType)).otherwise(row("n_chars"))
    return plan.select(*[kept.get(c, row(c)).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('mix-17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM s),
w AS (SELECT *, CASE rnk % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS most, 1.5 * CAST(sum(source_size) OVER () AS DOUBLE) AS wanted FROM r),
l AS (SELECT *, (wanted - coalesce(CAST(sum(most) OVER (ORDER BY most * 1.0 / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0)) / sum(weight) OVER (ORDER BY most * 1.0 / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
c AS (SELECT *, CAST(most AS DOUBLE) / weight <= lev AS clamped FROM l),
t AS (SELECT *, CASE WHEN clamped THEN CAST(most AS DOUBLE) ELSE max(CASE WHEN NOT clamped THEN lev END) OVER () * weight END AS target FROM c),
g AS (SELECT *, CASE WHEN clamped THEN 2 WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
j AS (SELECT d.*, g.source_size, g.target, g.whole, CAST(floor(g.target - g.whole * g.source_size) AS BIGINT) AS rest,
  CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - (upto - size))) AS BIGINT) AS taken FROM j
"""
