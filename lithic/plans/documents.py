"""Queries over documents: hashes, chunks, tokens, languages, entities, differences, quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithic.catalog import register
from lithic.functions import entities, urls
from lithic.functions import text as T
from lithic.operators import agents, changes, guard, models, versions
from lithic.settings import CATEGORIES
from lithic.sources.tables import table

SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', concat('\1', chr(1)), 'g'), '[\r\n]+', chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: s <> '')"""


@register("content_hash_dupes", "SELECT sha256(text) AS content_hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).where("copies > 1")


@register("chunk_documents", r"""
WITH n AS (SELECT doc_id, text, CASE WHEN length(text) <= 2048 THEN 1 ELSE CAST(ceil((length(text) - 2048) / 1741.0) AS INTEGER) + 1 END AS n FROM documents WHERE trim(text) <> ''),
i AS (SELECT doc_id, text, unnest(range(0, n)) AS i FROM n)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, md5(substr(text, i * 1741 + 1, 2048)) AS chunk_md5 FROM i""")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("chunk_index", "chunk"))
    return rows.select("doc_id", "chunk_index", F.md5("chunk").alias("chunk_md5"))


@register("chunk_ids", r"""
WITH n AS (SELECT doc_id, CASE WHEN length(text) <= 2048 THEN 1 ELSE CAST(ceil((length(text) - 2048) / 1741.0) AS INTEGER) + 1 END AS n FROM documents WHERE trim(text) <> ''),
i AS (SELECT doc_id, md5(CAST(doc_id AS VARCHAR) || '-' || CAST(unnest(range(0, n)) AS VARCHAR)) AS h FROM n)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' ||
  CASE substr(h, 17, 1) WHEN '0' THEN '8' WHEN '4' THEN '8' WHEN '8' THEN '8' WHEN 'c' THEN '8' WHEN '1' THEN '9' WHEN '5' THEN '9' WHEN '9' THEN '9' WHEN 'd' THEN '9' WHEN '2' THEN 'a' WHEN '6' THEN 'a' WHEN 'a' THEN 'a' WHEN 'e' THEN 'a' ELSE 'b' END
  || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS chunk_id FROM i""")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("i", "chunk"))
    return rows.select("doc_id", T.name_uuid(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("i").cast("string"))).alias("chunk_id"))


@register("token_stats", r"SELECT lang, count(*) AS n_docs, CAST(sum(len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS BIGINT) AS n_tokens, CAST(sum(CAST(floor(length(text) / 4) AS BIGINT)) AS BIGINT) AS low_estimate, CAST(sum(CAST(floor((length(text) + 3) / 4) AS BIGINT)) AS BIGINT) AS high_estimate FROM documents GROUP BY lang")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.size(T.lexemes(F.col("text")))).alias("n_tokens"), F.sum(T.tokens_floor(F.col("text"))).alias("low_estimate"), F.sum(T.tokens_ceil(F.col("text"))).alias("high_estimate"))


def _stop(code: str) -> str:
    return "['" + "','".join(T.STOP_WORDS[code]) + "']"


def language_oracle() -> str:
    shares = " UNION ALL ".join(f"SELECT doc_id, n, '{c}' AS code, len(list_filter(ws, lambda w: list_contains({_stop(c)}, w))) * 1.0 / n AS share FROM w" for c in sorted(T.STOP_WORDS))
    return rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{{L}}+') AS ws, len(regexp_extract_all(lower(text), '\p{{L}}+')) AS n FROM documents WHERE len(regexp_extract_all(lower(text), '\p{{L}}+')) >= 12),
s AS ({shares}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY share DESC, code) AS place FROM s),
b AS (SELECT a.doc_id, a.code, 2 * a.share - z.share AS conf FROM r a JOIN r z ON a.doc_id = z.doc_id AND a.place = 1 AND z.place = 2)
SELECT d.doc_id, CASE WHEN conf >= 0.55 THEN code END AS code, CASE WHEN conf >= 0.55 THEN round(least(1.0, conf), 6) END AS confidence FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id"""


@register("language_guess", language_oracle())
def language_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.language(F.col("text")).alias("l"))
    return rows.select("doc_id", F.col("l.code").alias("code"), F.round("l.confidence", 6).alias("confidence"))


@register("entity_email", r"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}')) AS v FROM documents)
SELECT doc_id, lower(v) AS entity_key, min(0.9) AS confidence FROM m GROUP BY ALL""")
def entity_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = entities.merge_entities(entities.pattern_entities(table(spark, sf_dir, "documents"), "doc_id", "text", ("email",)), "doc_id")
    return found.select("doc_id", "entity_key", "confidence")


@register("entity_patterns")
def entity_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven rules with checksums; the checksums have no SQL form and are tested on published vectors."""
    return entities.merge_entities(entities.pattern_entities(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


PATTERNS = ["licensed\\s+under", "password\\s?=", "all\\s+rights\\s+reserved"]


@register("guard_quarantine", r"""
WITH r AS (SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)licensed\s+under') THEN 'text-pattern:1' WHEN regexp_matches(text, '(?i)password\s?=') THEN 'text-pattern:2' WHEN regexp_matches(text, '(?i)all\s+rights\s+reserved') THEN 'text-pattern:3' END AS reason FROM documents)
SELECT doc_id, reason FROM r WHERE reason IS NOT NULL""")
def guard_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", guard.pattern_reason(F.col("text"), PATTERNS).alias("reason"))
    return rows.where("reason is not null")


@register("quarantine_counts", r"""
WITH r AS (SELECT source, CASE WHEN regexp_matches(text, '(?i)licensed\s+under') THEN 1 WHEN regexp_matches(text, '(?i)password\s?=') THEN 2 WHEN regexp_matches(text, '(?i)all\s+rights\s+reserved') THEN 3 END AS reason FROM documents)
SELECT source, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY source""")
def quarantine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", guard.pattern_reason(F.col("text"), PATTERNS).alias("reason"))
    return rows.where("reason is not null").groupBy("source").agg(F.count("*").alias("n"))


@register("quarantine_blanks", r"""SELECT doc_id, source, CASE WHEN NOT regexp_matches(text, '(?i)password\s?=') THEN md5(text) END AS text_md5 FROM documents""")
def quarantine_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    hit = docs.where(guard.pattern_reason(F.col("text"), PATTERNS[1:2]).isNotNull())
    return guard.blank_quarantined(docs, hit, "doc_id", ["text"]).select("doc_id", "source", F.md5("text").alias("text_md5"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document beside the one before it in its source, as two versions of a page. A source's
    neighbours are found on ids alone; texts join by id afterwards."""
    docs = table(spark, sf_dir, "documents")
    order = Window.partitionBy("source").orderBy("doc_id")
    ids = docs.select("doc_id", "source").withColumn("old_id", F.lag("doc_id").over(order)).where("old_id is not null").drop("source")
    old = docs.select(F.col("doc_id").alias("old_id"), F.col("text").alias("old"))
    return ids.join(old, "old_id").join(docs.select("doc_id", F.col("text").alias("new")), "doc_id")


DIFF = rf"""
WITH s AS (SELECT doc_id, source, {SENTENCES} AS s FROM documents),
u AS (SELECT doc_id, source, unnest(s) AS wording, generate_subscripts(s, 1) AS i FROM s),
k AS (SELECT doc_id, source, i, wording, regexp_replace(lower(wording), '[0-9]+', '#', 'g') AS key FROM u),
f AS (SELECT doc_id, source, key, min_by(wording, i) AS wording FROM k GROUP BY ALL),
p AS (SELECT doc_id, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS old_id FROM documents),
a AS (SELECT p.doc_id, count(*) AS n, sum(length(f.wording)) AS c FROM p JOIN f ON f.doc_id = p.doc_id WHERE old_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f g WHERE g.doc_id = p.old_id AND g.key = f.key) GROUP BY 1),
r AS (SELECT p.doc_id, count(*) AS n, sum(length(f.wording)) AS c FROM p JOIN f ON f.doc_id = p.old_id WHERE old_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f g WHERE g.doc_id = p.doc_id AND g.key = f.key) GROUP BY 1),
o AS (SELECT p.doc_id, CAST(coalesce(a.n, 0) AS INTEGER) AS n_added, CAST(coalesce(r.n, 0) AS INTEGER) AS n_removed, CAST(coalesce(a.c, 0) + coalesce(r.c, 0) AS INTEGER) AS changed_chars FROM p LEFT JOIN a ON a.doc_id = p.doc_id LEFT JOIN r ON r.doc_id = p.doc_id WHERE old_id IS NOT NULL)
"""


@register("sentence_diff", DIFF + "SELECT * FROM o")
def sentence_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.diff(_pairs(spark, sf_dir), "old", "new").select("doc_id", F.size("added").alias("n_added"), F.size("removed").alias("n_removed"), "changed_chars")


EMAIL = r"'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}'"
#: Entities that came and went between a document and the one before it in its source, least first.
DELTAS = rf""", em AS (SELECT DISTINCT doc_id, lower(v) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(text, {EMAIL})) AS v FROM documents)),
ea AS (SELECT p.doc_id, list(k ORDER BY k) AS ks FROM p JOIN em ON em.doc_id = p.doc_id WHERE old_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM em f WHERE f.doc_id = p.old_id AND f.k = em.k) GROUP BY 1),
er AS (SELECT p.doc_id, list(k ORDER BY k) AS ks FROM p JOIN em ON em.doc_id = p.old_id WHERE old_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM em f WHERE f.doc_id = p.doc_id AND f.k = em.k) GROUP BY 1),
cr AS (SELECT o.doc_id, p.old_id, o.changed_chars, coalesce(ea.ks, []) AS added, coalesce(er.ks, []) AS removed, e.lang AS category_from, d.lang AS category_to,
  CASE WHEN d.lang = e.lang AND changed_chars < 40 AND ea.ks IS NULL AND er.ks IS NULL THEN 'trivial' ELSE 'pending' END AS status
  FROM o JOIN p ON p.doc_id = o.doc_id JOIN documents d ON d.doc_id = o.doc_id JOIN documents e ON e.doc_id = p.old_id LEFT JOIN ea ON ea.doc_id = o.doc_id LEFT JOIN er ON er.doc_id = o.doc_id)
"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change records of documents as versions of their source's page, e-mail addresses as their entities."""
    docs = table(spark, sf_dir, "documents")
    found = entities.merge_entities(entities.pattern_entities(docs, "doc_id", "text", ("email",)), "doc_id")
    lists = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("entity_key").alias("key"), "type", F.col("entity_key").alias("display")))).alias("e"))
    side = docs.select("doc_id", "lang").join(lists, "doc_id", "left")
    pairs = _pairs(spark, sf_dir).join(side.select("doc_id", F.col("lang").alias("category_to"), F.col("e").alias("new_entities")), "doc_id")
    pairs = pairs.join(side.select(F.col("doc_id").alias("old_id"), F.col("lang").alias("category_from"), F.col("e").alias("old_entities")), "old_id")
    return changes.records(pairs)


@register("change_records", DIFF + DELTAS + "SELECT doc_id, status, category_from, category_to, array_to_string(added, ',') AS entities_added, array_to_string(removed, ',') AS entities_removed, changed_chars FROM cr")
def change_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = lambda c: F.array_join(F.transform(c, lambda e: e["key"]), ",").alias(c)
    return _records(spark, sf_dir).select("doc_id", "status", "category_from", "category_to", keys("entities_added"), keys("entities_removed"), "changed_chars")


def _named(column: str) -> str:
    return f"array_to_string(list_transform({column}, lambda k: k || ' (email)'), ', ')"


@register("change_descriptions", DIFF + DELTAS + f""", x AS (SELECT cr.*, array_to_string(list(a.wording ORDER BY a.i), chr(10)) AS added_text FROM cr LEFT JOIN (SELECT p.doc_id, w.wording, w.i FROM p JOIN (SELECT doc_id, key, min_by(wording, i) AS wording, min(i) AS i FROM k GROUP BY ALL) w ON w.doc_id = p.doc_id WHERE old_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f g WHERE g.doc_id = p.old_id AND g.key = w.key)) a ON a.doc_id = cr.doc_id GROUP BY ALL)
SELECT doc_id, md5('Summarize in 1 to 3 sentences what changed on this page between version ' || old_id || ' and ' || doc_id || ' (http://d.example/' || doc_id || ').' || chr(10)
|| CASE WHEN category_from <> category_to THEN 'Category: from ' || category_from || ' to ' || category_to || '.' || chr(10) ELSE '' END
|| CASE WHEN len(added) > 0 THEN 'New entities: ' || {_named('added')} || '.' || chr(10) ELSE '' END || CASE WHEN len(removed) > 0 THEN 'Removed entities: ' || {_named('removed')} || '.' || chr(10) ELSE '' END
|| CASE WHEN trim(coalesce(added_text, '')) <> '' THEN 'Added text:' || chr(10) || left(added_text, 4000) || chr(10) ELSE '' END) AS description_md5 FROM x""")
def change_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).withColumns({"from_version": F.col("old_id"), "to_version": F.col("doc_id"), "url": F.concat(F.lit("http://d.example/"), F.col("doc_id").cast("string")), "removed_text": F.lit("")})
    return rows.select("doc_id", F.md5(changes.describe()).alias("description_md5"))


@register("versions_history", """
WITH o AS (SELECT doc_id, source, text, CASE WHEN lag(doc_id) OVER w IS NULL THEN 1 WHEN text IS DISTINCT FROM lag(text) OVER w THEN 1 ELSE 0 END AS ch FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
v AS (SELECT doc_id, source, text, sum(ch) OVER (PARTITION BY source ORDER BY doc_id) AS version FROM o),
g AS (SELECT source, CAST(version AS BIGINT) AS version, min(doc_id) AS recorded_at, min(md5(text)) AS content_hash FROM v GROUP BY 1, 2)
SELECT source, version, content_hash, recorded_at FROM g QUALIFY version < max(version) OVER (PARTITION BY source)""")
def versions_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "documents").select("source", "doc_id", F.md5("text").alias("content_hash"))
    return versions.history(log, "source", "content_hash", "doc_id", "doc_id").select("source", "version", "content_hash", "recorded_at")


@register("content_gate", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def content_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@register("queue_scan", "SELECT doc_id FROM documents WHERE lang IN ('fr', 'de') AND text IS NOT NULL ORDER BY doc_id LIMIT 20")
def queue_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("extracted_text"), F.when(F.col("lang") == "fr", "pending").when(F.col("lang") == "de", "failed_transient").otherwise("processed").alias("ai_status"))
    return versions.backlog(rows, 20).select(F.col("id").alias("doc_id"))


@register("backlog_gauge", "SELECT count(*) FILTER (WHERE lang IN ('fr', 'de')) AS waiting, count(*) AS total FROM documents")
def backlog_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count(F.when(F.col("lang").isin("fr", "de"), 1)).alias("waiting"), F.count("*").alias("total"))


@register("source_counts", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))


@register("snippets", "SELECT doc_id, md5(CASE WHEN length(text) > 240 THEN left(text, 240) || '…' ELSE text END) AS snippet_md5 FROM documents")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.snippet(F.col("text"))).alias("snippet_md5"))


@register("passage_budget", """
WITH p AS (SELECT source, doc_id, text AS t FROM documents),
u AS (SELECT *, CAST(coalesce(sum(length(t)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used FROM p)
SELECT source, doc_id, used, CAST(length(left(t, 12000 - used)) AS INTEGER) AS kept FROM u WHERE used < 12000""")
def passage_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lithic.operators import search

    passages = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("text").alias("passage"))
    return search.within_budget(passages, ["source"], "doc_id", "passage").select("source", "doc_id", "used", F.length("passage").alias("kept"))


@register("greedy_budget", """
WITH RECURSIVE c AS (SELECT conv_id, turn, CAST(floor((length(text) + 3) / 4) AS BIGINT) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
g(conv_id, i, left_, taken) AS (SELECT conv_id, CAST(0 AS BIGINT), CAST(300 AS BIGINT), CAST(0 AS BIGINT) FROM c GROUP BY conv_id
 UNION ALL SELECT c.conv_id, c.i, CASE WHEN cost <= left_ THEN left_ - cost ELSE left_ END, taken + CASE WHEN cost <= left_ THEN 1 ELSE 0 END FROM g JOIN c ON c.conv_id = g.conv_id AND c.i = g.i + 1)
SELECT conv_id, max(taken) AS n_taken, min(left_) AS unused FROM g GROUP BY conv_id""")
def greedy_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokens_ceil(F.col("text")).alias("cost"))
    grouped = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "cost"))), lambda s: s["cost"]).alias("costs"))
    taken = grouped.withColumn("taken", agents.greedy(F.col("costs"), F.lit(300)))
    spent = F.aggregate(F.zip_with("costs", "taken", lambda c, t: F.when(t, c).otherwise(F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)
    return taken.select("conv_id", F.size(F.filter("taken", lambda t: t)).cast("long").alias("n_taken"), (F.lit(300).cast("long") - spent).alias("unused"))


@register("category_coercion", "SELECT doc_id, CASE WHEN contains(text, 'forum') THEN 'forum' ELSE 'other' END AS category, CASE WHEN contains(text, 'forum') THEN 0.9 ELSE 0.5 END AS confidence FROM documents")
def category_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    guess = F.when(F.col("text").contains("forum"), "forum").otherwise("unheard of")
    name, confidence = models.category(guess, F.lit(0.9))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("category"), confidence.alias("confidence"))


FIRST = r"""regexp_replace(left(text, 8000), '^\s+|\s+$', '', 'g')"""


@register("enrich_offline", rf"""SELECT doc_id, left(CASE WHEN regexp_matches({FIRST}, '(?s)^.*?[.!?]\s') THEN regexp_extract({FIRST}, '(?s)^(.*?[.!?])\s', 1) ELSE {FIRST} END, 200) AS summary,
CASE {' '.join(f"WHEN contains(lower(left(text, 8000)), '{c}') THEN '{c}'" for c in CATEGORIES)} ELSE 'other' END AS category, CASE WHEN {' OR '.join(f"contains(lower(left(text, 8000)), '{c}')" for c in CATEGORIES if c != 'other')} THEN 0.8 ELSE 0.4 END AS confidence FROM documents""")
def enrich_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary and category of every document by the offline provider."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", models.task_udf("summarize", "text")(F.col("text")).alias("s"), models.task_udf("classify", "category")(F.col("text")).alias("c"))
    name, confidence = models.category(F.col("c.value"), F.col("c.confidence"))
    return rows.select("doc_id", F.col("s.value").alias("summary"), name.alias("category"), confidence.alias("confidence"))


@register("contamination_ngrams", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents), b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM benchmark),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(t) - 6), lambda i: array_to_string(t[i:i + 7], ' '))) AS g FROM w WHERE len(t) >= 8),
bg AS (SELECT DISTINCT unnest(list_transform(range(1, len(t) - 6), lambda i: array_to_string(t[i:i + 7], ' '))) AS g FROM b WHERE len(t) >= 8)
SELECT doc_id, count(DISTINCT dg.g) AS n_shared FROM dg JOIN bg ON dg.g = bg.g GROUP BY doc_id""")
def contamination_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grams meet as 64-bit hashes, and only the documents' grams that met one are written out and compared."""

    def tokens(name: str, key: str) -> DataFrame:
        return table(spark, sf_dir, name).select(key, T.lexemes(F.col("text")).alias("t")).where(F.size("t") >= 8)

    gram = lambda i: F.array_join(F.slice("t", i, 8), " ")
    places = F.sequence(F.lit(1), F.size("t") - 7)
    bench = tokens("benchmark", "item_id").select(F.explode(F.transform(places, gram)).alias("g")).distinct().withColumn("h", F.xxhash64("g"))
    docs = tokens("documents", "doc_id")
    hashes = F.transform(places, lambda i: F.struct(i.alias("i"), F.xxhash64(*[F.get("t", i + k - 1) for k in range(8)]).alias("h")))
    known = bench.select(F.xxhash64(*[F.split("g", " ")[k] for k in range(8)]).alias("h")).distinct()
    met = docs.select("doc_id", F.explode(hashes).alias("x")).select("doc_id", "x.*").join(known, "h", "left_semi")
    at = met.groupBy("doc_id").agg(F.collect_set("i").alias("at"))
    shared = docs.join(at, "doc_id").select("doc_id", F.explode(F.array_distinct(F.transform("at", gram))).alias("g")).join(bench.select("g"), "g", "left_semi")
    return shared.groupBy("doc_id").agg(F.count("*").alias("n_shared"))


@register("quarantine_reasons", r"""WITH r AS (SELECT CASE WHEN lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) IN (SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) FROM pages WHERE regexp_matches(url, '^https://m')) THEN 'url-denylist' WHEN regexp_matches(html, '(?i)class=.related') THEN 'text-pattern' WHEN regexp_matches(html, '(?i)track\(1') THEN 'text-pattern' END AS reason FROM pages)
SELECT reason AS reason_class, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1""")
def quarantine_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guard as a whole: denied hosts before patterns, and the audit's reasons by class."""
    pages = table(spark, sf_dir, "pages")
    denied = pages.where("url rlike '^https://m'").select(urls.host(F.col("url")).alias("value"))
    audit = guard.guard(pages, denied, ["class=.related", r"track\(1"], text="html")[1]
    return guard.reason_classes(audit)


@register("guard_clean", r"""SELECT page_id FROM pages WHERE NOT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) IN (SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) FROM pages WHERE regexp_matches(url, '^https://m')) AND NOT regexp_matches(html, '(?i)class=.related') AND NOT regexp_matches(html, '(?i)track\(1')""")
def guard_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    denied = pages.where("url rlike '^https://m'").select(urls.host(F.col("url")).alias("value"))
    return guard.guard(pages, denied, ["class=.related", r"track\(1"], text="html")[0].select("page_id")
