"""From raw documents to token digests, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads
again as the next stage's docs. All but the last return the columns of docs.

1. toxicity: documents predicted toxic go;
2. SimHash near-dedup: of each group of near copies the document of smallest doc_id stays;
3. PII: detected entities are replaced by surrogates;
4. mixing: documents are repeated, cut or left out as the sources' target weights ask;
5. SentencePiece: every document's ids and their decoded text, as digests.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lithic.llm import mixing, pieces, simhash, surrogates, toxicity
from lithic.llm.shared import checkpoint_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that a machine trained on the labelled ones among them predicts toxic."""
    labels = table(spark, sf_dir, "labels")
    return toxicity.clean(docs, labels)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with surrogates for personal data in their texts."""
    return surrogates.replace(docs, count=None)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs repeated as the sources' target weights ask."""
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document's number of ids, and digests of its ids and of the text that they decode to."""
    return pieces.digests(docs, pieces.default_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("pii_surrogates", replace_personal_data),
    ("source_mixing", mix_sources),
    ("sentencepiece_encoding", encode),
]

#: SQL has neither the first stage's machine nor XXH64 nor the tokenizer.
ORACLE_SQL = None


def remove(spark: SparkSession, path: str) -> None:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents. What a stage keeps lies in the shared folder of spark.checkpoint.dir until the
    next one is written; the last one's rows stay, for the caller to read and remove."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
