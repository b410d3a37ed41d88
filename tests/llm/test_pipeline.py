"""The pipeline's rows against plain Python over each stage's rules."""

from __future__ import annotations

import hashlib

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from lithic.llm import mixing, pieces, simhash, surrogates, toxicity


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, labels)).collect() if r.predicted}
    kept = [r for r in docs.orderBy("doc_id").collect() if r.doc_id not in toxic]
    fps = [simhash.fingerprint(r.text.encode()) for r in kept]
    root = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    firsts = spark.createDataFrame([r for k, r in enumerate(kept) if root[k] == k], docs.schema)
    masked = {r.doc_id: r.text for r in surrogates.replace(firsts).collect()}
    plan = mixing.mix(spark.createDataFrame([(r.doc_id, masked[r.doc_id], r.lang, r.source, len(masked[r.doc_id])) for r in firsts.collect()], docs.schema)).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = []
    for r in plan:
        words = masked[r.doc_id].encode().split()
        texts = [masked[r.doc_id]] * r.whole
        if r.extra:
            texts.append(masked[r.doc_id] if r.extra == r["size"] else b" ".join(words[: r.extra]).decode())
        for text in texts:
            ids = library.encode(text) + [2]
            want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, small).collect()]
    assert len(got) > 0 and sorted(got) == sorted(want)


@pytest.mark.parametrize("stage", range(4))
def test_stages_stand_odd_rows(spark, small, stage):
    """Null, empty and long texts, null and repeated ids, extra columns with clashing names, no rows."""
    names = "digest digest_ swap_ extra_ extra copy row root i d n_entities host draw bin size fp text_ component_id".split()
    long = "Mr. John Smith wrote a long text. " * 4000
    rows = [(1, None, "en", "a", None), (2, "", "en", None, 0), (None, "x y z", "en", "a", 5), (7, long, "en", "a", len(long)), (7, "another text of the same id", "en", "a", 27), (8, "a short text", None, "b", 12), (8, "a short text", None, "b", 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({n: F.lit(n) for n in names})
    got = corpus_pipeline.STAGES[stage][1](spark, docs, small)
    assert got.columns == docs.columns
    them = got.collect()
    assert them and all(r[n] == n for r in them for n in names)
    assert corpus_pipeline.STAGES[stage][1](spark, docs.limit(0), small).count() == 0


def test_last_stage_stands_odd_rows(spark, small):
    docs = spark.createDataFrame([(1, None, 1), (None, "", 2), (1, "x" * 50_000, 3)], "doc_id long, text string, n_tokens long")
    got = corpus_pipeline.STAGES[4][1](spark, docs, small).collect()
    assert len(got) == 3 and sorted(r.n_tokens for r in got)[:2] == [1, 1]
