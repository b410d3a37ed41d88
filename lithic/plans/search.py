"""Search queries: full text, vectors, hybrid, passages, graph views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithic.catalog import register
from lithic.functions import text as T
from lithic.operators import agents, fulltext, graph, models, search, shares, state, vectors
from lithic.plans.pages import PAGE_TEXT
from lithic.sources import snapshots, workspace
from lithic.sources.tables import table

QUESTION = 'the "of the" -onion or idiot'
BOTH = "the idiot"
TS = r"regexp_extract_all(lower(left({}, 500000)), '[\p{{L}}\p{{N}}]+')"
AT = "list_filter(range(1, len(ts) + 1), lambda i: ts[i] = '{}')[1:255]"


def _reciprocals(word: str) -> str:
    return f"coalesce(list_sum(list_transform(range(1, len({AT.format(word)}) + 1), lambda j: 1.0::DOUBLE / (j * j))), 0)"


def _or_rank(*words: str) -> str:
    return "(" + " + ".join(_reciprocals(w) for w in words) + f") * 0.1::DOUBLE / 1.64493406685::DOUBLE / {len(words)}"


def _has(word: str) -> str:
    return f"list_contains(ts, '{word}')"


#: 'of' with 'the' behind it.
PHRASE = "len(list_filter(range(1, len(ts)), lambda i: ts[i] = 'of' AND ts[i + 1] = 'the')) > 0"
HIT = f"(({_has('the')} AND {PHRASE} AND NOT {_has('onion')}) OR {_has('idiot')})"
RANK = _or_rank("idiot", "of", "onion", "the")


def _hits(relation: str, key: str, text: str, hit: str = HIT, rank: str = RANK) -> str:
    return f"WITH f AS (SELECT {key}, {TS.format(text)} AS ts FROM {relation}), h AS (SELECT {key}, {rank} AS rank FROM f WHERE {hit}), t AS (SELECT {key}, rank, CAST(row_number() OVER (ORDER BY round(rank, 12) DESC, {key}) AS INTEGER) AS pos FROM h)"


def _oracle(relation: str, key: str, text: str, first: int = 1, last: int = 20) -> str:
    return _hits(relation, key, text) + f" SELECT {key}, round(rank, 6) AS rank, pos FROM t WHERE pos BETWEEN {first} AND {last}"


def documents(spark: SparkSession, sf_dir: str) -> fulltext.Index:
    return fulltext.of_path(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> fulltext.Index:
    texts = table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))
    return fulltext.of_path(texts, "page_id", "text", f"{sf_dir}/pages.parquet")


@register("search_fulltext", _oracle("pages", "page_id", PAGE_TEXT))
def search_fulltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.full_text(pages(spark, sf_dir), QUESTION)


@register("search_documents", _oracle("documents", "doc_id", "text"))
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.full_text(documents(spark, sf_dir), QUESTION)


@register("search_total", _hits("documents", "doc_id", "text") + " SELECT count(*) AS total FROM t")
def search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.found_in(documents(spark, sf_dir), QUESTION).agg(F.count("*").alias("total"))


@register("search_page_two", _oracle("documents", "doc_id", "text", 11, 20))
def search_page_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.full_text(documents(spark, sf_dir), QUESTION, 10, 1)


DISTANCE = "CASE WHEN x.p = y.p THEN 0::DOUBLE ELSE ln(1 - 0.1::DOUBLE * sqrt(CASE WHEN abs(x.p - y.p) > 100 THEN 1e-30 ELSE 1 / (1.005::DOUBLE + 0.05::DOUBLE * exp(abs(x.p - y.p) / 1.5::DOUBLE - 2)) END)) END"


@register("search_conjunction", rf"""WITH f AS (SELECT doc_id, {TS.format('text')} AS ts FROM documents), g AS (SELECT * FROM f WHERE {_has('the')} AND {_has('idiot')}),
a AS (SELECT doc_id, unnest({AT.format('the')}) AS p FROM g), b AS (SELECT doc_id, unnest({AT.format('idiot')}) AS p FROM g),
h AS (SELECT x.doc_id, 1 - exp(sum({DISTANCE})) AS rank FROM a x JOIN b y ON x.doc_id = y.doc_id GROUP BY x.doc_id)
SELECT doc_id, round(rank, 6) AS rank, CAST(row_number() OVER (ORDER BY round(rank, 12) DESC, doc_id) AS INTEGER) AS pos FROM h QUALIFY pos <= 20""")
def search_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.full_text(documents(spark, sf_dir), BOTH)


@register("search_negation", rf"WITH f AS (SELECT doc_id, {TS.format('text')} AS ts FROM documents) SELECT count(*) AS total FROM f WHERE NOT {_has('the')}")
def search_negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.found_in(documents(spark, sf_dir), "-the").agg(F.count("*").alias("total"))


CLEAN = r"regexp_replace(lower(w), '[^\p{L}\p{N}]+', '', 'g')"
SHOWN = f"array_to_string(list_transform(ws[@:@ + 39], lambda w: CASE WHEN {CLEAN} = 'idiot' THEN '<b>' || w || '</b>' ELSE w END), ' ')"


@register("search_snippet", rf"""WITH x AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws, {TS.format('text')} AS ts FROM documents),
p AS (SELECT doc_id, ws, list_filter(list_transform(ws, lambda w, i: CASE WHEN {CLEAN} = 'idiot' THEN i END), lambda i: i IS NOT NULL) AS hits FROM x WHERE list_contains(ts, 'idiot')),
a AS (SELECT *, CAST(greatest(1, least(coalesce(hits[1], 1) - 10, len(ws) - 39)) AS BIGINT) AS f FROM p), b AS (SELECT *, list_filter(hits, lambda i: i >= f + 40)[1] AS n FROM a),
c AS (SELECT *, CAST(greatest(f + 40, least(n - 10, len(ws) - 39), 1) AS BIGINT) AS g FROM b)
SELECT doc_id, md5({SHOWN.replace('@', 'f')} || CASE WHEN n IS NOT NULL THEN ' ... ' || {SHOWN.replace('@', 'g')} ELSE '' END) AS snippet_md5 FROM c""")
def search_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(search.found_in(documents(spark, sf_dir), "idiot").select("doc_id"), "doc_id", "left_semi")
    return docs.select("doc_id", F.md5(search.headline(F.col("text"), "idiot")).alias("snippet_md5"))


COVERED = ["the", "of", "idiot"]


def _covers(most: int, least: int, count: int, marked: bool) -> str:
    """The same fragments by joins over word places."""
    show = lambda p: f"coalesce((SELECT string_agg({'CASE WHEN c IN ' + str(tuple(COVERED)) + ' THEN ' + chr(39) + '<b>' + chr(39) + ' || w || ' + chr(39) + '</b>' + chr(39) + ' ELSE w END' if marked else 'w'}, ' ' ORDER BY i) FROM w WHERE w.doc_id = {p}.doc_id AND w.i BETWEEN {p}.a AND {p}.b), '')"

    def ended(source: str) -> str:
        return f"""SELECT doc_id, a, coalesce((SELECT max(i) FROM w WHERE w.doc_id = s.doc_id AND i >= greatest(s.e, s.a + {least - 1}) AND i <= least(s.high, s.a + {most - 1}) AND regexp_matches(w, '[.!?]$')), least(s.high, s.a + {most - 1})) AS b, e
        FROM (SELECT doc_id, i, e, high, greatest(low, least(i - ({most} - (e - i + 1)) // 2, high - {most - 1})) AS a FROM ({source})) s"""

    return rf"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM documents WHERE list_contains({TS.format('text')}, 'idiot')),
    w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i, unnest(list_transform(ws, lambda w: {CLEAN})) AS c FROM t),
    h AS (SELECT doc_id, i, c FROM w WHERE c IN {tuple(COVERED)}),
    f AS (SELECT x.doc_id, x.i, y.c, min(y.i) AS first FROM h x JOIN h y ON x.doc_id = y.doc_id AND y.i BETWEEN x.i AND x.i + {most - 1} GROUP BY ALL),
    v AS (SELECT doc_id, i, max(first) AS e, count(*) AS different FROM f GROUP BY ALL),
    n AS (SELECT doc_id, len(ws) AS n FROM t),
    one AS (SELECT n.doc_id, coalesce(i, 1) AS i, coalesce(e, 1) AS e, 1 AS low, n AS high FROM n LEFT JOIN v ON v.doc_id = n.doc_id QUALIFY row_number() OVER (PARTITION BY n.doc_id ORDER BY different DESC, e - i, i) = 1),
    p AS ({ended('SELECT * FROM one')}),
    two AS (SELECT v.doc_id, v.i, v.e, CASE WHEN v.i > p.b THEN p.b + 1 ELSE 1 END AS low, CASE WHEN v.i > p.b THEN n ELSE p.a - 1 END AS high FROM v JOIN p ON p.doc_id = v.doc_id JOIN n ON n.doc_id = v.doc_id WHERE v.i > p.b OR v.e < p.a
      QUALIFY row_number() OVER (PARTITION BY v.doc_id ORDER BY different DESC, v.e - v.i, v.i) = 1),
    q AS ({ended('SELECT * FROM two')})
    SELECT p.doc_id, md5(CASE WHEN q.doc_id IS NULL OR {count} = 1 THEN {show('p')} WHEN q.a > p.b THEN {show('p')} || ' ... ' || {show('q')} ELSE {show('q')} || ' ... ' || {show('p')} END) AS fragments_md5 FROM p LEFT JOIN q ON q.doc_id = p.doc_id"""


def _fragments(spark: SparkSession, sf_dir: str, **kind) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(search.found_in(documents(spark, sf_dir), "idiot").select("doc_id"), "doc_id", "left_semi")
    return docs.select("doc_id", F.md5(search.fragments(F.col("text"), " or ".join(COVERED), **kind)).alias("fragments_md5"))


@register("search_fragments", _covers(40, 20, 2, True))
def search_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fragments of 20 to 40 words around the covers with most words of the query."""
    return _fragments(spark, sf_dir)


@register("search_passages", _covers(120, 80, 1, False))
def search_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain passage of 80 to 120 words around the best cover, to the end of a sentence where one is."""
    return _fragments(spark, sf_dir, most=120, least=80, count=1, marked=False)


@register("search_index", r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(left(text, 500000)), '[\p{L}\p{N}]+')) AS lexeme FROM documents)
SELECT lexeme, count(*) AS occurrences, count(DISTINCT doc_id) AS n_docs FROM t GROUP BY lexeme""")
def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index holds, which has the first half million characters of a text: that is its feature."""
    return documents(spark, sf_dir).all_postings().groupBy("lexeme").agg(F.sum("n").alias("occurrences"), F.count("*").alias("n_docs"))


@register("search_pages_index", rf"""WITH t AS (SELECT page_id, unnest({TS.format(PAGE_TEXT)}) AS lexeme FROM pages) SELECT lexeme, count(*) AS occurrences, count(DISTINCT page_id) AS n_docs FROM t GROUP BY lexeme""")
def search_pages_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).all_postings().groupBy("lexeme").agg(F.sum("n").alias("occurrences"), F.count("*").alias("n_docs"))


@register("search_segments", r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text || ' idiot appended' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0),
f AS (SELECT doc_id, regexp_extract_all(lower(left(text, 500000)), '[\p{L}\p{N}]+') AS ts FROM d), h AS (SELECT doc_id, """ + RANK + " AS rank FROM f WHERE " + HIT + """),
t AS (SELECT doc_id, rank, row_number() OVER (ORDER BY round(rank, 12) DESC, doc_id) AS pos FROM h)
SELECT doc_id, round(rank, 6) AS rank, CAST(pos AS INTEGER) AS pos, (SELECT count(*) FROM d WHERE doc_id % 10 = 0) AS indexed FROM t WHERE pos <= 20""")
def search_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after every tenth document changed and every seventh went: ``indexed`` counts what its second segment read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = snapshots.Store(spark, workspace.folder(spark, "segments"))
    store.run(lambda change: fulltext.refresh(change, docs, "doc_id", "text"))
    later = docs.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" idiot appended"))).otherwise(F.col("text")))
    store.run(lambda change: fulltext.refresh(change, later, "doc_id", "text"))
    index = fulltext.Index(store.snapshot(), "doc_id")
    return search.full_text(index, QUESTION).crossJoin(index.at.table("docs").where("segment = 1").agg(F.count("*").alias("indexed")))


@register("postings_stats", r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS lexeme FROM documents)
SELECT lexeme, count(*) AS occurrences, count(DISTINCT doc_id) AS n_docs FROM t GROUP BY lexeme""")
def postings_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_doc = search.postings(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("lexeme", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("lexeme").agg(F.sum("n").alias("occurrences"), F.count("*").alias("n_docs"))


QUERY = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]
QSQL = "[" + ",".join(map(str, QUERY)) + "]::DOUBLE[]"
EXACT = f"list_dot_product(embedding::DOUBLE[], {QSQL}) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product({QSQL}, {QSQL}))"
COS = f"round(list_dot_product(embedding::DOUBLE[], {QSQL}) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product({QSQL}, {QSQL})), 6)"


@register("vector_topk", f"SELECT vec_id, {COS} AS score FROM embeddings ORDER BY {EXACT} DESC, vec_id LIMIT 20")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", QUERY, 20).select("vec_id", F.round("score", 6).alias("score"))


@register("vector_best_per_group", f"""WITH p AS (SELECT vec_id, label, {EXACT} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 100)
SELECT label, vec_id, round(score, 6) AS score FROM p WHERE score >= 0.05 QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1""")
def vector_best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings")
    pool = search.nearest(points, "vec_id", "embedding", QUERY, 100)
    return search.best_per_page(points.select("vec_id", "label").join(F.broadcast(pool), "vec_id"), "label", "vec_id", 0.05).select("label", "vec_id", F.round("score", 6).alias("score"))


HYBRID = _hits("documents", "doc_id", "text") + f""",
l AS (SELECT doc_id, pos, 1 AS l FROM t WHERE pos <= 50),
e AS (SELECT vec_id, {EXACT} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 50),
v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS pos, 2 AS l FROM e),
u AS (SELECT * FROM l UNION ALL SELECT * FROM v),
g AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + pos)) AS score, min(l * 1000 + pos) AS first FROM u GROUP BY doc_id)
"""


def _near(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    near = search.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", QUERY, k)
    return near.select(F.col("vec_id").alias("doc_id"), F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")).alias("pos"))


@register("rrf_hybrid", HYBRID + "SELECT doc_id, round(score, 6) AS score FROM g ORDER BY g.score DESC, first LIMIT 50")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid(documents(spark, sf_dir), QUESTION, _near(spark, sf_dir, 50), 50)[0]


@register("hybrid_union_total", HYBRID + "SELECT count(*) AS total FROM g")
def hybrid_union_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid(documents(spark, sf_dir), QUESTION, _near(spark, sf_dir, 50), 50)[1]


@register("hybrid_page_two", HYBRID + "SELECT doc_id, round(rank, 6) AS score FROM t WHERE pos > 10 AND pos <= 20")
def hybrid_page_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid(documents(spark, sf_dir), QUESTION, _near(spark, sf_dir, 50), 10, 1)[0]


@register("hybrid_page_two_total", HYBRID + "SELECT count(*) AS total FROM t")
def hybrid_page_two_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid(documents(spark, sf_dir), QUESTION, _near(spark, sf_dir, 50), 10, 1)[1]


@register("hybrid_without_vectors", HYBRID + "SELECT doc_id, round(rank, 6) AS score FROM t WHERE pos <= 20")
def hybrid_without_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid(documents(spark, sf_dir), QUESTION, _near(spark, sf_dir, 50).limit(0))[0]


@register("vector_pages", f"""WITH e AS (SELECT vec_id, label, {EXACT} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 50), b AS (SELECT * FROM e WHERE score >= 0.05 QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1)
SELECT label, vec_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, label LIMIT 5""")
def vector_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.semantic(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", QUERY, 5, 0.05)
    return search.semantic_page(hits)[0].select("label", "vec_id", F.round("score", 6).alias("score"))


@register("vector_model", f"SELECT vec_id, round({EXACT}, 6) AS score FROM embeddings WHERE vec_id % 3 = 1 ORDER BY {EXACT} DESC, vec_id LIMIT 20")
def vector_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings").withColumn("model", F.concat(F.lit("m"), (F.col("vec_id") % 3).cast("string")))
    return search.nearest(points, "vec_id", "embedding", QUERY, 20, "m1").select("vec_id", F.round("score", 6).alias("score"))


def vector_index(spark: SparkSession, sf_dir: str) -> vectors.Index:
    """The index of the embeddings as they are now; every session that asks for it shares it."""
    folder = workspace.lasting(spark, "vectors", vectors.LAYOUT, sf_dir, workspace.fingerprint(spark, f"{sf_dir}/embeddings.parquet"))
    return vectors.of_path(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64, spark, folder)


@register("vector_approximate")
def vector_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the nearest cells of the index; ``vector_index_recall`` measures how many it finds."""
    return vectors.search_one(vector_index(spark, sf_dir), QUERY, 20)


@register("vector_index_recall", "SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 50 = 0")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the index finds nine tenths and more of the 20 nearest of every vector whose id is divisible by 50."""
    index, points = vector_index(spark, sf_dir), table(spark, sf_dir, "embeddings")
    asked = points.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    wanted = vectors.exact_all(points, "vec_id", "embedding", asked, "query_id", 64, 20)
    found = vectors.search_all(index, asked, "query_id", "embedding", 20)
    hit = wanted.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.agg(F.countDistinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("reached"))


@register("hydrated_hits", f"""WITH e AS (SELECT vec_id, {EXACT} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 100)
SELECT vec_id AS doc_id, round(score, 6) AS score, md5(CASE WHEN length(text) > 240 THEN left(text, 240) || '…' ELSE text END) AS snippet_md5 FROM e JOIN documents ON doc_id = vec_id WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def hydrated_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", QUERY, 100).withColumnRenamed("vec_id", "doc_id")
    bad = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id", F.lit("quarantined").alias("s"))
    docs = table(spark, sf_dir, "documents").join(bad, "doc_id", "left").withColumn("ai_status", F.coalesce("s", F.lit("processed")))
    return search.hydrate(hits, docs, "doc_id").select("doc_id", F.round("score", 6).alias("score"), F.md5(T.snippet(F.col("text"))).alias("snippet_md5"))


@register("vector_gate", "SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 3 = 1 AND vec_id % 5 <> 0)")
def vector_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("url"), F.sha2("text", 256).alias("content_hash"))
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("url")).join(docs, "url")
    points = points.select("url", F.when(F.col("url") % 5 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.concat(F.lit("m"), (F.col("url") % 3).cast("string")).alias("model"))
    return search.changed(docs, points, "m1").select(F.col("url").alias("doc_id"), "content_hash")


@register("vector_delete", "SELECT vec_id, label FROM embeddings WHERE label NOT IN (SELECT DISTINCT label FROM embeddings WHERE vec_id < 3)")
def vector_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return state.without(points, points.where("vec_id < 3"), "label")


@register("embedding_points", """WITH n AS (SELECT doc_id, left(text, 50000) AS t FROM documents WHERE trim(text) <> ''), c AS (SELECT doc_id, t, CASE WHEN length(t) <= 2048 THEN 1 ELSE CAST(ceil((length(t) - 2048) / 1741.0) AS INTEGER) + 1 END AS n FROM n)
SELECT doc_id, CAST(n AS BIGINT) AS points, CASE WHEN doc_id % 4 = 0 THEN 'kept' ELSE 'made' END AS how, CASE WHEN doc_id % 4 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(n AS BIGINT) END AS unit_vectors FROM c""")
def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole processor: pages whose points are there keep them, others, old longer ones too, get new ones."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("url"), "text")
    old = docs.where(F.trim("text") != "").select("url", "text", F.when(F.col("url") % 4 == 0, F.sha2("text", 256)).otherwise("old").alias("content_hash"), F.explode(F.sequence(F.lit(0), F.size(T.chunks(F.left("text", F.lit(50_000)))) - 1 + F.when(F.col("url") % 4 == 0, 0).otherwise(2))).alias("chunk_index"))
    points = old.select(F.lit("id").alias("id"), "url", "chunk_index", "content_hash", F.lit("offline-64").alias("model"), F.lit("kept").alias("text"), F.array().cast("array<double>").alias("embedding"))
    made = search.embed_pages(docs, points, models.embedding, width=models.DIMENSIONS)
    unit = F.abs(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x) - 1) < 1e-9
    how = F.when(F.min("text") == "kept", "kept").otherwise("made")
    return made.groupBy("url").agg(F.count("*").alias("points"), how.alias("how"), F.count(F.when(unit, 1)).alias("unit_vectors")).select(F.col("url").cast("long").alias("doc_id"), "points", "how", "unit_vectors")


PASSAGE = f"array_to_string(ws[CAST(greatest(1, least(coalesce(hit, 1) - 20, len(ws) - 119)) AS BIGINT):CAST(greatest(1, least(coalesce(hit, 1) - 20, len(ws) - 119)) AS BIGINT) + 119], ' ')"
CHAT = _hits("documents", "doc_id", "text", _has("idiot"), _or_rank("idiot")) + rf""",
w AS (SELECT doc_id, pos, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM t JOIN documents USING (doc_id) WHERE pos <= 8),
p AS (SELECT doc_id, pos, ws, list_position(list_transform(ws, lambda w: {CLEAN} = 'idiot'), true) AS hit FROM w)"""


@register("chat_context", CHAT + rf""",
y AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, {PASSAGE} AS t FROM p),
u AS (SELECT *, coalesce(sum(length(t)) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM y)
SELECT doc_id, pos, md5(left(t, CAST(12000 - used AS BIGINT))) AS passage_md5 FROM u WHERE used < 12000""")
def chat_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return agents.retrieve(documents(spark, sf_dir), docs, "text", "idiot", "idiot").select("doc_id", "pos", F.md5("passage").alias("passage_md5"))


@register("chat_context_fused", CHAT.replace("WHERE pos <= 8)", "WHERE pos <= 8 AND false)") + rf""",
tl AS (SELECT doc_id, pos FROM t WHERE pos <= 8),
e AS (SELECT vec_id, label, {EXACT} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 8), v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS pos FROM e),
g AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + pos)) AS score, min(l * 1000 + pos) AS first FROM (SELECT doc_id, pos, 1 AS l FROM tl UNION ALL SELECT doc_id, pos, 2 AS l FROM v) GROUP BY doc_id),
k AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY score DESC, first) AS INTEGER) AS pos FROM g QUALIFY pos <= 8),
x AS (SELECT k.doc_id, k.pos, v.doc_id IS NOT NULL AS chunked, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM k JOIN documents d ON d.doc_id = k.doc_id LEFT JOIN v ON v.doc_id = k.doc_id),
z AS (SELECT *, list_position(list_transform(ws, lambda w: {CLEAN} = 'idiot'), true) AS hit FROM x),
y AS (SELECT doc_id, pos, CASE WHEN chunked THEN 'chunk of ' || doc_id ELSE {PASSAGE} END AS t FROM z),
s AS (SELECT *, coalesce(sum(length(t)) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM y)
SELECT doc_id, pos, md5(left(t, CAST(12000 - used AS BIGINT))) AS passage_md5 FROM s WHERE used < 12000""")
def chat_context_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text hits fused with vector hits of the rewritten question; a page that a vector found gives that chunk."""
    docs = table(spark, sf_dir, "documents")
    near = search.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", QUERY, 8).withColumnRenamed("vec_id", "doc_id")
    chunks = near.join(docs.select("doc_id"), "doc_id", "left").select("doc_id", "score", F.concat(F.lit("chunk of "), F.col("doc_id").cast("string")).alias("text"))
    return agents.retrieve(documents(spark, sf_dir), docs, "text", "idiot", "idiot", chunks=chunks).select("doc_id", "pos", F.md5("passage").alias("passage_md5"))


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")


@register("graph_cooccurrence", """
WITH m AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), p AS (SELECT a.l_partkey, b.l_partkey AS other, count(*) AS shared FROM m a JOIN m b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY ALL)
SELECT l_partkey, other, shared, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY shared DESC, other) AS INTEGER) AS place FROM p QUALIFY place <= 10""")
def graph_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.related(_mentions(spark, sf_dir), "l_orderkey", "l_partkey")


@register("graph_entity_view", """
WITH m AS (SELECT DISTINCT l_partkey, l_orderkey, o_orderdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate DESC, l_orderkey) AS place FROM m)
SELECT p_partkey, p_name, CAST(count(l_orderkey) AS BIGINT) AS n_pages, min(CASE WHEN place = 1 THEN l_orderkey END) AS newest FROM part LEFT JOIN r ON l_partkey = p_partkey AND place <= 20 GROUP BY ALL""")
def graph_entity_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions, orders = _mentions(spark, sf_dir), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    tasks = shares.tasks_of(mentions)
    dated = mentions.repartition(tasks, "l_orderkey").join(orders.repartition(tasks, "l_orderkey"), "l_orderkey")
    pages = graph.newest_pages(dated, "l_orderkey", "l_partkey", "o_orderdate", tasks=tasks)
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name").join(pages, F.col("p_partkey") == F.col("l_partkey"), "left")
    return rows.select("p_partkey", "p_name", F.coalesce(F.size("pages"), F.lit(0)).cast("long").alias("n_pages"), F.try_element_at("pages", F.lit(1)).alias("newest"))


@register("graph_most_mentioned", """SELECT l_partkey, count(DISTINCT l_orderkey) AS pages FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1 ORDER BY pages DESC, l_partkey LIMIT 5""")
def graph_most_mentioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return graph.most_mentioned(_mentions(spark, sf_dir), urgent, "l_orderkey", "l_partkey")


@register("graph_orphans", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def graph_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return graph.orphans(table(spark, sf_dir, "part").select("p_partkey"), mentions, "p_partkey")
