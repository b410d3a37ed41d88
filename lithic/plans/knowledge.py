"""Queries over models, the processing chain, agents and the entity graph."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithic import api
from lithic.catalog import register
from lithic.functions import entities as E
from lithic import settings
from lithic.operators import agents, changes, graph, graphstore, ladder, models, processing, search
from lithic.plans.documents import EMAIL
from lithic.plans.search import EXACT, QUERY, _has, _hits, _or_rank, documents
from lithic.settings import CATEGORIES
from lithic.sources import snapshots, workspace
from lithic.sources.tables import table


def flaky(task: str, text: str) -> str:
    """The offline provider, out of quota for some texts and broken for others."""
    if "idiot" in text:
        raise models.ProviderError("out of quota", window="minute")
    if "scum" in text:
        raise models.ProviderError("broken")
    return models.offline(task, text)


STATE = "CASE WHEN trim(text) = '' THEN 'skipped' WHEN done THEN 'unchanged' WHEN contains(left(text, 8000), 'idiot') THEN 'waiting' WHEN contains(left(text, 8000), 'scum') THEN 'failed' ELSE 'success' END"
#: The taxonomy stands before the text, so the cap leaves less of it.
CAPPED = f"left(text, {8000 - len(models.TAXONOMY)})"
KIND = "CASE " + " ".join(f"WHEN contains(lower({CAPPED}), '{c}') THEN '{c}'" for c in CATEGORIES) + " ELSE 'other' END"
TOLD = STATE.replace("left(text, 8000)", CAPPED)


@register("processing_chain", f"""WITH d AS (SELECT doc_id, text, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS done FROM documents)
SELECT doc_id, {STATE} AS summary_status, {TOLD} AS category_status, CASE WHEN {TOLD} = 'success' THEN {KIND} END AS category, CASE WHEN {TOLD} = 'success' THEN CASE WHEN {KIND} = 'other' THEN 0.4 ELSE 0.8 END END AS category_confidence,
CASE WHEN {STATE} = 'failed' OR {TOLD} = 'failed' THEN 'failed' WHEN {STATE} = 'waiting' OR {TOLD} = 'waiting' THEN 'waiting' ELSE 'processed' END AS status FROM d""")
def processing_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().withColumn("done", F.lit(True))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(done, "doc_id", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    rows = processing.chain(docs, {"category": processing.category(flaky), "summary": processing.summary(flaky)})
    return rows.select("doc_id", "summary_status", "category_status", "category", "category_confidence", processing.overall(["summary", "category"]).alias("status"))


def _language_step() -> str:
    from lithic.plans.documents import language_oracle

    return f"""WITH g AS ({language_oracle()}) SELECT d.doc_id, CASE WHEN trim(d.text) = '' THEN 'skipped' WHEN g.code IS NOT NULL THEN 'success' WHEN contains(left(d.text, 8000), 'idiot') THEN 'waiting' WHEN contains(left(d.text, 8000), 'scum') THEN 'failed' ELSE 'success' END AS language_status,
CASE WHEN trim(d.text) = '' THEN NULL WHEN g.code IS NOT NULL THEN g.code WHEN contains(left(d.text, 8000), 'idiot') OR contains(left(d.text, 8000), 'scum') THEN NULL WHEN regexp_matches(lower(left(d.text, 8000)), '(^|[^\\w\\x{{0080}}-\\x{{10FFFF}}])the($|[^\\w\\x{{0080}}-\\x{{10FFFF}}])') THEN 'en' ELSE 'und' END AS language FROM documents d JOIN g ON g.doc_id = d.doc_id"""


@register("language_step", _language_step())
def language_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(False).alias("done"))
    return processing.chain(docs, {"language": processing.language(flaky)}).select("doc_id", "language_status", "language")


@register("entity_pipeline", rf"""WITH d AS (SELECT doc_id, text, CASE WHEN trim(text) = '' THEN 'skipped' WHEN contains(left(text, 8000), 'idiot') THEN 'waiting' WHEN contains(left(text, 8000), 'scum') THEN 'failed' ELSE 'success' END AS status FROM documents),
m AS (SELECT DISTINCT doc_id, lower(v) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(text, {EMAIL})) AS v FROM d WHERE status IN ('success', 'failed'))),
n AS (SELECT doc_id, list(k ORDER BY k) AS ks FROM m GROUP BY 1)
SELECT d.doc_id, status, CASE WHEN status IN ('success', 'failed') THEN coalesce(array_to_string(ks, ','), '') END AS emails FROM d LEFT JOIN n ON n.doc_id = d.doc_id""")
def entity_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern and named entities of documents; e-mail addresses are compared."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(False).alias("done"))
    rows = processing.chain(docs, {"entities": processing.named_entities(flaky, "doc_id")})
    emails = F.array_sort(F.transform(F.filter("entities", lambda e: e["type"] == "email"), lambda e: e["entity_key"]))
    return rows.select("doc_id", F.col("entities_status").alias("status"), F.array_join(emails, ",").alias("emails"))


@register("processing_four_steps", "WITH l AS (" + _language_step() + rf"""),
m AS (SELECT DISTINCT doc_id, lower(v) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(text, {EMAIL})) AS v FROM documents)), n AS (SELECT doc_id, count(*) AS n FROM m GROUP BY 1),
s AS (SELECT l.doc_id, language, language_status, {STATE.replace("WHEN done THEN 'unchanged' ", "")} AS summary_status, {TOLD.replace("WHEN done THEN 'unchanged' ", "")} AS category_status, n FROM l JOIN documents t ON t.doc_id = l.doc_id LEFT JOIN n ON n.doc_id = l.doc_id)
SELECT doc_id, language, language_status, summary_status, category_status, summary_status AS entities_status, CASE WHEN summary_status IN ('success', 'failed') THEN coalesce(n, 0) END AS emails,
CASE WHEN 'failed' IN (language_status, summary_status, category_status) THEN 'failed' WHEN 'waiting' IN (language_status, summary_status, category_status) THEN 'waiting' ELSE 'processed' END AS status FROM s""")
def processing_four_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain: one pass over the texts, and a model is asked once for each page and step."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(False).alias("done"))
    steps = {"entities": processing.named_entities(flaky, "doc_id"), "category": processing.category(flaky), "summary": processing.summary(flaky), "language": processing.language(flaky)}
    rows = processing.chain(docs, steps)
    emails = F.size(F.filter("entities", lambda e: e["type"] == "email")).cast("long")
    return rows.select("doc_id", "language", "language_status", "summary_status", "category_status", "entities_status", F.when(F.col("entities").isNotNull(), emails).alias("emails"), processing.overall(list(steps)).alias("status"))


#: What a text costs, which providers have quota for it, and which gives the answer.
LADDER = """WITH d AS (SELECT doc_id, left(text, 8000) AS t, length(text) // 4 AS estimate, doc_id % 2 = 0 AS interactive FROM documents WHERE trim(text) <> ''),
o AS (SELECT *, 50 > floor(100 * CASE WHEN interactive THEN {i} ELSE {b} END / 100.0) AND 3000 - estimate > floor(4000 * CASE WHEN interactive THEN {i} ELSE {b} END / 100.0) AS small FROM d),
a AS (SELECT *, small AND NOT contains(t, 'the') AS good FROM o)
SELECT doc_id, CASE WHEN good THEN 'small' WHEN contains(t, 'scum') THEN CASE WHEN small THEN 'small' END ELSE 'large' END AS provider, CAST(CASE WHEN small THEN 2 ELSE 1 END - CAST(good AS INTEGER) AS INTEGER) AS calls FROM a"""


@register("routed_escalation", LADDER.format(i=settings.DEFAULTS.quota_margin_percent, b=settings.DEFAULTS.quota_margin_percent + settings.DEFAULTS.batch_reserve_percent))
def routed_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries by the first provider with quota, by the next where its answer is poor: the small one is sure of texts without 'the' only."""
    import json

    def small(task: str, text: str) -> str:
        return json.dumps({"text": "small", "confidence": 0.2 if "the" in text else 0.9})

    def large(task: str, text: str) -> str:
        if "scum" in text:
            raise models.ProviderError("refused")
        return json.dumps({"text": "large", "confidence": 0.8})

    docs = table(spark, sf_dir, "documents").where("trim(text) <> ''")
    calls = docs.select(F.col("doc_id").alias("call_id"), "text", F.floor(F.char_length("text") / 4).alias("estimate"), (F.col("doc_id") % 2 == 0).alias("interactive"))
    quotas = spark.createDataFrame([("small", 50, 100, 3_000, 4_000), ("large", 10_000, 10_000, 10**9, 10**9)], "provider string, remaining long, limit long, tokens_left long, token_limit long")
    told = ladder.escalate(calls, {"small": small, "large": large}, quotas, "summarize", "text")
    return told.select(F.col("call_id").alias("doc_id"), "provider", F.size("tried").alias("calls"))


@register("named_entities_valid", """SELECT event_id, CASE WHEN event_type IN ('view', 'click') AND value >= 70 AND event_id % 4 <> 0 THEN event_type || event_id END AS kept FROM events""")
def named_entities_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of the taxonomy, usable values, enough confidence."""
    kind = F.when(F.col("event_type") == "view", "Person").when(F.col("event_type") == "click", "location").otherwise("animal")
    value = F.when(F.col("event_id") % 4 == 0, F.when(F.col("event_id") % 8 == 0, "  ").otherwise(F.repeat(F.lit("x"), F.lit(201)))).otherwise(F.concat("event_type", F.col("event_id").cast("string")))
    made = F.array(F.struct(kind.alias("type"), value.alias("value"), (F.col("value") / 100).alias("confidence")))
    return table(spark, sf_dir, "events").select("event_id", F.get(E.valid_named(made), F.lit(0))["value"].alias("kept"))


@register("entity_keys", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'bc1qabc' || event_id WHEN 1 THEN '1AbC' || event_id WHEN 2 THEN 'a.b@c.de' WHEN 3 THEN 'ABCD1234' WHEN 4 THEN 'jose da silva ' || event_id ELSE '0xab' || event_id END AS entity_key FROM events""")
def entity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id").cast("string")
    kinds = ["crypto_wallet", "crypto_wallet", "email", "pgp_fingerprint", "person", "crypto_wallet"]
    forms = [F.concat(F.lit(" BC1Qabc"), n), F.concat(F.lit("1AbC"), n, F.lit(" ")), F.lit("A.B@C.de"), F.lit("abcd 12 34"), F.concat(F.lit("José   da SILVA "), n), F.concat(F.lit("0xAB"), n)]
    at = (F.col("event_id") % 6 + 1).cast("int")
    rows = table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*[F.lit(k) for k in kinds]), at).alias("kind"), F.element_at(F.array(*forms), at).alias("display"))
    folded = F.when(F.col("kind") == "person", E.fold(F.col("display"))).otherwise(F.col("display"))
    return rows.select("event_id", E.entity_key(F.col("kind"), folded).alias("entity_key"))


@register("model_answers", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'a' || event_id WHEN 1 THEN 'b' END AS value, CASE event_id % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 0.0 END AS confidence, CASE WHEN event_id % 5 <= 1 THEN 'ok' WHEN event_id % 5 = 4 THEN 'quota' ELSE 'failed' END AS outcome FROM events""")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with chatter around them, out of bounds, malformed, and none."""

    def provider(task: str, text: str) -> str:
        kind = int(text) % 5
        if kind == 4:
            raise models.failure(429, "per day")
        return [f'Sure! {{"text": "a{text}", "confidence": 0.5}} Bye', '{"text": "b", "confidence": 7}', "{broken", '{"other": 1}'][kind]

    rows = table(spark, sf_dir, "events").select("event_id", models.task_udf("summarize", "text", provider)(F.col("event_id").cast("string")).alias("a"))
    return rows.select("event_id", "a.value", "a.confidence", F.coalesce("a.error", F.lit("ok")).alias("outcome"))


@register("model_escalation", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'first' WHEN event_id % 4 = 1 THEN 'second' WHEN event_id % 4 = 2 THEN 'first' ELSE NULL END AS value, CASE WHEN event_id % 4 = 0 THEN 0.9 WHEN event_id % 4 = 1 THEN 0.8 WHEN event_id % 4 = 2 THEN 0.5 END AS confidence FROM events WHERE event_id < 400""")
def model_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ladder of two providers per call: the first good answer, else the best, else none."""
    import json

    def say(name: str, sure: list[float | None]):
        def provider(task: str, text: str) -> str:
            if sure[int(text) % 4] is None:
                raise models.ProviderError("no")
            return json.dumps({"text": name, "confidence": sure[int(text) % 4]})

        return provider

    def run(batches):
        import pyarrow as pa

        registry = models.Registry({"a": say("first", [0.9, 0.4, 0.5, None]), "b": say("second", [0.1, 0.8, 0.3, None])}, pause=lambda s: None)
        for batch in batches:
            out = []
            for i in batch.column("event_id").to_pylist():
                try:
                    out.append(registry.call("summarize", str(i), "text"))
                except models.Exhausted:
                    out.append((None, None))
            yield pa.RecordBatch.from_arrays([batch.column("event_id"), pa.array([v for v, _ in out], pa.string()), pa.array([c for _, c in out], pa.float64())], ["event_id", "value", "confidence"])

    return table(spark, sf_dir, "events").where("event_id < 400").select("event_id").mapInArrow(run, "event_id long, value string, confidence double")


AXIS = "CASE " + " ".join(f"WHEN w = '{w}' THEN {a}" for w, a in sorted(models.AXIS.items())) + f" ELSE {len(models.CONCEPTS)} + ((h - CASE WHEN h >= 2147483648 THEN 4294967296 ELSE 0 END) % {models.DIMENSIONS - len(models.CONCEPTS)} + {models.DIMENSIONS - len(models.CONCEPTS)}) % {models.DIMENSIONS - len(models.CONCEPTS)} END"


@register("embeddings_offline", rf"""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower('monero e senhas ' || text), '\p{{L}}+')) AS w FROM benchmark),
h AS (SELECT item_id, w, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(w, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, c: (a * 31 + c) % 4294967296) AS h FROM w),
a AS (SELECT item_id, {AXIS} AS axis FROM h), s AS (SELECT item_id, axis, sum(CASE WHEN axis < 3 THEN 3.0::DOUBLE ELSE 0.3::DOUBLE END) AS x FROM a GROUP BY ALL), n AS (SELECT item_id, sqrt(sum(x * x)) AS n FROM s GROUP BY 1)
SELECT s.item_id, CAST(axis AS INTEGER) AS axis, round(x / n, 6) AS weight FROM s JOIN n ON n.item_id = s.item_id""")
def embeddings_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("monero e senhas "), "text")
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(models.embedding(text)).alias("axis", "weight"))
    return rows.where("weight > 0").select("item_id", "axis", F.round("weight", 6).alias("weight"))


@register("embedder_inputs", "SELECT item_id, md5('task: search result | query: ' || text) AS query_md5, md5('title: ' || CASE WHEN item_id % 2 = 0 THEN 'none' ELSE 'T' || item_id END || ' | text: ' || text) AS document_md5 FROM benchmark")
def embedder_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("item_id") % 2 != 0, F.concat(F.lit("T"), F.col("item_id").cast("string")))
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(models.as_query(F.col("text"))).alias("query_md5"), F.md5(models.as_document(title, F.col("text"))).alias("document_md5"))


@register("citations", """WITH e AS (SELECT event_id, event_id % 5 AS a, user_id % 5 AS b FROM events), c AS (SELECT event_id, 1 AS k, a AS id FROM e WHERE a < 4 UNION ALL SELECT event_id, 2, b FROM e WHERE b < 4 AND (b <> a OR a >= 4))
SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY k) AS INTEGER) AS place, 'S' || id AS id, 'text ' || event_id || ' ' || id AS text FROM c""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited ids that were sent, in order and once each, with their sources."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    sent = F.array(*[F.lit(f"S{k}") for k in range(4)])
    name = lambda c: F.concat(F.lit("S"), c.cast("string"))
    wanted = F.array(name(F.col("event_id") % 5), name(F.col("user_id") % 5), name(F.col("event_id") % 5))
    sources = e.select("event_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select("event_id", name(F.col("k")).alias("id"), F.concat_ws(" ", F.lit("text"), F.col("event_id").cast("string"), F.col("k").cast("string")).alias("text"))
    return agents.cited_sources(e.select("event_id", models.cited(wanted, sent).alias("citations")), sources, "event_id")


@register("source_blocks", """SELECT doc_id, md5('<source id="' || doc_id || '" url="' || source || '">URL: ' || source || chr(10) || CASE WHEN lang = 'en' THEN 'Summary: ' || lang || chr(10) ELSE '' END || chr(10) || text || '</source>') AS block_md5 FROM documents""")
def source_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("said", agents.source_text(F.col("source"), F.when(F.col("lang") == "en", F.col("lang")), F.concat(F.lit("</source><SOURCE x>"), "text")))
    return agents.source_block(docs, "doc_id", "source", "said").select("doc_id", F.md5("block").alias("block_md5"))


#: Published or made-up addresses by place: type, what stands in the text, the key (null: no entity).
PLANTED = [
    ("crypto_wallet", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"),
    ("crypto_wallet", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb", None),
    ("crypto_wallet", "BC1QW508D6QEJXTDG4Y5R3ZARVARY0C5XW7KV8F3T4", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"),
    ("crypto_wallet", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5", None),
    ("crypto_wallet", "0x" + "Ab" * 20, "0x" + "ab" * 20),
    ("crypto_wallet", "4" + "A" + "b" * 93, "4" + "A" + "b" * 93),
    ("onion_service", "DuckDuckGogg42xjoc72x3sjasowoarfbgcmvfimaftt6twagswzczad.onion", "duckduckgogg42xjoc72x3sjasowoarfbgcmvfimaftt6twagswzczad.onion"),
    ("onion_service", "b" * 56 + ".onion", None),
    ("pgp_fingerprint", "0123 4567 89ab cdef 0123 4567 89AB CDEF 0123 4567", "0123456789ABCDEF0123456789ABCDEF01234567"),
]
FOUND = ", ".join(f"({k}, '{kind}', '{key}')" for k, (kind, _, key) in enumerate(PLANTED) if key)


@register("entities_planted", f"SELECT doc_id, type, entity_key FROM documents JOIN (VALUES {FOUND}) p(k, type, entity_key) ON doc_id % {len(PLANTED)} = k")
def entities_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule and checksum on a document that has such an entity, or one whose checksum fails."""
    planted = F.element_at(F.array(*[F.lit(text) for _, text, _ in PLANTED]), (F.col("doc_id") % len(PLANTED) + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Document "), F.col("doc_id").cast("string"), F.lit(" has "), planted, F.lit(", again "), planted, F.lit(".")).alias("text"))
    found = E.merge_entities(E.pattern_entities(docs, "doc_id", "text"), "doc_id").where("type <> 'email'")
    return found.select("doc_id", "type", "entity_key")


# agents


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as summarized changes."""
    e = table(spark, sf_dir, "events")
    person = F.when(F.col("event_id") % 2 == 0, F.array(F.struct(F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("display"), F.lit("person").alias("type")))).otherwise(F.array().cast("array<struct<display:string,type:string>>"))
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("http://h/"), F.col("user_id").cast("string")).alias("url"), (F.col("event_id") % 9).alias("from_version"), (F.col("event_id") % 9 + 1).alias("to_version"),
        F.col("ts").cast("timestamp").alias("detected_at"), F.when(F.col("event_type") == "view", "trivial").otherwise("summarized").alias("status"), F.when(F.col("event_type") != "error", F.concat(F.lit("did "), "event_type")).alias("summary"),
        F.when(F.col("event_id") % 3 == 0, "blog").alias("category_from"), F.when(F.col("event_id") % 3 != 2, "forum").otherwise("blog").alias("category_to"), person.alias("entities_added"), F.array().cast("array<struct<display:string,type:string>>").alias("entities_removed"),
    )


CHANGE_TEXT = """'Change on http://h/' || user_id || ' (version ' || event_id % 9 || ' to ' || (event_id % 9 + 1) || ', detected ' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '): did ' || event_type
|| CASE event_id % 3 WHEN 0 THEN chr(10) || 'Category: blog to forum' WHEN 1 THEN chr(10) || 'Category: null to forum' ELSE '' END || CASE WHEN event_id % 2 = 0 THEN chr(10) || 'Entities added: P' || user_id || ' (person)' ELSE '' END"""
CHANGES = f"""SELECT CAST(row_number() OVER (ORDER BY ts DESC, event_id DESC) AS INTEGER) AS n, 'http://h/' || user_id AS url, {CHANGE_TEXT} AS text FROM events WHERE event_type NOT IN ('view', 'error') AND event_id % 3 <> 2 AND ts >= TIMESTAMP '2024-01-15 00:00:00'"""
NOW = dt.datetime(2024, 1, 31)


@register("agent_changes_tool", f"WITH c AS ({CHANGES}) SELECT 'C' || n AS id, url, text FROM c WHERE n <= 20")
def agent_changes_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    agent = agents.Agent("a", "i", "t", categories=("forum",), window_days=16)
    return agents.changes_tool(_changes(spark, sf_dir), agent, NOW).select("id", "url", "text")


ENTITY_BASE = """m AS (SELECT DISTINCT l_orderkey, l_partkey, o_orderdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey), r AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey % 10 = 0),
t AS (SELECT l_partkey, row_number() OVER (ORDER BY count(DISTINCT l_orderkey) DESC, l_partkey) AS n FROM m WHERE l_orderkey IN (SELECT o_orderkey FROM r) GROUP BY 1 QUALIFY n <= 5),
pg AS (SELECT l_partkey, string_agg(CAST(l_orderkey AS VARCHAR), ', ' ORDER BY k) AS pages FROM (SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate DESC, l_orderkey) AS k FROM m WHERE l_partkey IN (SELECT l_partkey FROM t)) WHERE k <= 5 GROUP BY 1),
co AS (SELECT a.l_partkey, b.l_partkey AS other, count(DISTINCT a.l_orderkey) AS shared, row_number() OVER (PARTITION BY a.l_partkey ORDER BY count(DISTINCT a.l_orderkey) DESC, b.l_partkey) AS k FROM m a JOIN m b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey WHERE a.l_partkey IN (SELECT l_partkey FROM t) GROUP BY a.l_partkey, b.l_partkey QUALIFY k <= 5),
bs AS (SELECT co.l_partkey, string_agg(p_name || ' (' || p_type || ', ' || shared || ' shared pages)', ', ' ORDER BY k) AS beside FROM co JOIN part ON p_partkey = other GROUP BY 1)"""
ENTITIES = """SELECT t.n, '/api/entities/' || p_type || '/' || replace(p_name, ' ', '%20') || '-' || p_partkey AS url, 'Entity: ' || p_name || ' (' || p_type || ')' || chr(10) || 'Mentioned by: ' || pages || coalesce(chr(10) || 'Appears with: ' || beside, '') AS text FROM t JOIN part ON p_partkey = t.l_partkey JOIN pg ON pg.l_partkey = t.l_partkey LEFT JOIN bs ON bs.l_partkey = t.l_partkey"""


def _entity_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    mentions = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    results = orders.where("o_orderpriority = '1-URGENT' AND o_custkey % 10 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("type"), F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("display"))
    return mentions, results, names


@register("agent_entities_tool", f"WITH {ENTITY_BASE}, x AS ({ENTITIES}) SELECT 'E' || n AS id, url, text FROM x")
def agent_entities_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions, results, names = _entity_inputs(spark, sf_dir)
    return agents.entities_tool(mentions, results, names, "l_orderkey", "l_partkey", "o_orderdate").select("id", "url", "text")


@register("agent_material", f"""WITH {ENTITY_BASE}, x AS ({ENTITIES}), c AS ({CHANGES}), p AS (SELECT doc_id, left(text, 200) AS t, CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS n FROM documents WHERE trim(text) <> '' QUALIFY n <= 8),
u AS (SELECT 1 AS tool_no, n, 'S' || n AS id, t AS text FROM p UNION ALL SELECT 2, n, 'C' || n, text FROM c WHERE n <= 20 UNION ALL SELECT 3, n, 'E' || n, text FROM x)
SELECT id, CAST(row_number() OVER (ORDER BY tool_no, n) AS INTEGER) AS place, CAST((length(text) + 3) // 4 AS BIGINT) AS cost FROM u""")
def agent_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three tools' sources one behind the other, and what each costs of the budget."""
    from lithic.functions import text as T

    docs = table(spark, sf_dir, "documents").where(F.trim("text") != "")
    top = docs.orderBy("doc_id").limit(8).select("doc_id", F.left("text", F.lit(200)).alias("passage")).withColumn("pos", F.row_number().over(Window.orderBy("doc_id")))
    mentions, results, names = _entity_inputs(spark, sf_dir)
    tools = agents.search_tool(top, "doc_id"), agents.changes_tool(_changes(spark, sf_dir), agents.Agent("a", "i", "t", categories=("forum",), window_days=16), NOW), agents.entities_tool(mentions, results, names, "l_orderkey", "l_partkey", "o_orderdate")
    return agents.collected(*tools).select("id", "place", T.tokens_ceil(F.col("text")).alias("cost"))


@register("agent_run", """SELECT 'succeeded' AS status, 'S1' AS sources, 8 AS n_sent UNION ALL SELECT 'failed', '', 0 UNION ALL SELECT 'succeeded', '', 0""")
def agent_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs: with material, with a budget that nothing fits, and with nothing collected."""
    import json

    docs = [(f"S{k}", r.t) for k, r in enumerate(table(spark, sf_dir, "documents").where(F.trim("text") != "").orderBy("doc_id").limit(8).select(F.left("text", F.lit(200)).alias("t")).collect(), 1)]
    sent: list[int] = []

    def ask(instructions: str, sources: list[tuple[str, str]]) -> tuple[str, list[str]]:
        sent.append(len(sources))
        answer = json.loads(models.offline("report", "".join(f'<source id="{i}">{t}</source>' for i, t in sources)))
        return answer["text"], answer["citations"]

    out = []
    for tokens, material in ((8_000, docs), (1_001, docs), (8_000, [])):
        before = len(sent)
        done = agents.run(agents.Agent("a", "i", "t", max_tokens=tokens), material, ask)
        out.append((done["status"], ",".join(done["sources"]), sent[-1] if len(sent) > before else 0))
    return spark.createDataFrame(out, "status string, sources string, n_sent int")


@register("agent_store", """WITH a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'renamed ' || c_custkey ELSE c_name END AS name FROM customer WHERE c_custkey <> 7 UNION ALL SELECT -1 - s_suppkey, s_name FROM supplier),
n AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1) SELECT a.id, name, coalesce(n, 0) AS n_runs FROM a LEFT JOIN n ON n.id = a.id""")
def agent_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as agents and their orders as runs: some renamed, suppliers added, one deleted, with its runs."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name"))
    more = table(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).cast("long").alias("id"), F.col("s_name").alias("name"))
    renamed = customers.where("id % 5 = 0").select("id", F.concat(F.lit("renamed "), F.col("id").cast("string")).alias("name"))
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("long").alias("agent_id"))
    store = agents.Store(customers, runs).put(more).put(renamed).delete(7)
    n = store.runs.groupBy(F.col("agent_id").alias("id")).agg(F.count("*").alias("n_runs"))
    return store.all().join(n, "id", "left").select("id", "name", F.coalesce("n_runs", F.lit(0)).alias("n_runs"))


@register("agent_errors", """SELECT c_custkey, CAST(c_custkey % 3 = 0 AS INTEGER) + CAST(c_custkey % 4 = 0 AS INTEGER) + CAST(c_mktsegment <> 'BUILDING' AS INTEGER) + CAST(c_custkey % 40 = 0 OR c_custkey % 40 > 30 AS INTEGER)
+ CAST(c_custkey % 7 = 0 AS INTEGER) AS n_errors FROM customer""")
def agent_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with agents made of customers: blank names, long instructions, unknown categories, windows and budgets out of range."""

    def checked(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for key, name, segment in zip(*(batch.column(c).to_pylist() for c in ("c_custkey", "c_name", "c_mktsegment")), strict=True):
                agent = agents.Agent(" " if key % 3 == 0 else f" {name} ", "x" * (4_001 if key % 4 == 0 else 4_000), "topic", categories=(" forum", "forum" if segment == "BUILDING" else segment), window_days=key % 40, max_tokens=0 if key % 7 == 0 else 100)
                out.append(len(agent.errors))
            yield pa.RecordBatch.from_arrays([batch.column("c_custkey"), pa.array(out, pa.int32())], ["c_custkey", "n_errors"])

    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_mktsegment")
    return rows.mapInArrow(checked, "c_custkey long, n_errors int")


# the graph


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of their customer's page, their parts as entities; the open ones are not processed."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_partkey").alias("parts"))
    entity = lambda p: F.struct(F.when(p % 2 == 0, "person").otherwise("location").alias("type"), (p % 50).cast("string").alias("key"), F.concat(F.lit("D"), (p % 50).cast("string")).alias("display"), F.lit(0.9).alias("confidence"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").select(F.concat(F.lit("http://H"), (F.col("o_custkey") % 7).cast("string"), F.lit(".example/"), F.col("o_custkey").cast("string")).alias("url"), F.col("o_orderkey").alias("version"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("processed").alias("ai_status"), F.transform("parts", entity).alias("entities"))


GRAPH = """WITH v AS (SELECT 'http://H' || o_custkey % 7 || '.example/' || o_custkey AS url, max(o_orderkey) AS version FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1),
m AS (SELECT DISTINCT url, lower(regexp_extract(url, '//([^/]+)', 1)) AS host, version, CASE WHEN l_partkey % 2 = 0 THEN 'person' ELSE 'location' END AS type, CAST(l_partkey % 50 AS VARCHAR) AS key FROM v JOIN lineitem ON l_orderkey = version)"""


@register("graph_projection", GRAPH + " SELECT url, host, version, type, key FROM m")
def graph_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.project(_versions(spark, sf_dir)).select("url", "host", "version", "type", "key")


@register("graph_rebuilt", GRAPH + " SELECT type, key, 'D' || key AS display, count(DISTINCT url) AS pages FROM m GROUP BY type, key")
def graph_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.rebuild(_versions(spark, sf_dir))[1]


@register("graph_incremental", GRAPH + " SELECT type, key, 'D' || key AS display, count(DISTINCT url) AS pages FROM m GROUP BY type, key")
def graph_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph after three batches of versions, of which the second is delivered twice."""
    store, versions = snapshots.Store(spark, workspace.folder(spark, "graph")), _versions(spark, sf_dir)
    for number in (0, 1, 1, 2):
        batch = versions.where(F.pmod(F.col("version") * 7, F.lit(3)) == number)
        store.run(lambda change: graphstore.update(change, batch), writer="graph", token=number)  # noqa: B023
    return graphstore.entities(store.snapshot())


@register("graph_hosts", GRAPH + " SELECT host, count(DISTINCT url) AS pages FROM m GROUP BY host")
def graph_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.rebuild(_versions(spark, sf_dir))[2]


@register("graph_types", GRAPH + " SELECT type, count(DISTINCT key) AS entities, count(*) AS mentions FROM m GROUP BY type")
def graph_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.by_type(graph.project(_versions(spark, sf_dir)))


@register("graph_lookup", GRAPH + " SELECT type, key, count(DISTINCT url) AS pages FROM m WHERE type = 'person' AND key = '14' GROUP BY ALL")
def graph_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.lookup(graph.rebuild(_versions(spark, sf_dir))[1], "person", "  14 ").select("type", "key", "pages")


@register("graph_removed", GRAPH + " SELECT type, key, count(DISTINCT url) AS pages FROM m WHERE NOT ends_with(url, '1') GROUP BY ALL")
def graph_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without quarantined pages; entities that only they had go too."""
    mentions = graph.project(_versions(spark, sf_dir))
    left = graph.without(mentions, mentions.where(F.col("url").endswith("1")).select("url"), "url")
    return left.groupBy("type", "key").agg(F.countDistinct("url").alias("pages"))


@register("graph_entity_pages", GRAPH + ", e AS (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS key FROM part WHERE p_partkey <= 60) SELECT e.key, count(DISTINCT m.url) AS pages, count(DISTINCT m.host) AS hosts FROM e LEFT JOIN m ON m.key = e.key GROUP BY e.key")
def graph_entity_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = graph.project(_versions(spark, sf_dir))
    entities = table(spark, sf_dir, "part").where("p_partkey <= 60").select(F.col("p_partkey").cast("string").alias("key"))
    rows = graph.entity_pages(entities, mentions, mentions.select("url", "host").distinct(), "key", "url")
    return rows.groupBy("key").agg(F.countDistinct("url").alias("pages"), F.countDistinct("host").alias("hosts"))


@register("changes_window", "SELECT event_id AS id FROM events WHERE event_type NOT IN ('view', 'error') AND ts >= TIMESTAMP '2024-01-24 00:00:00' AND event_id % 3 = 2 ORDER BY ts DESC, event_id DESC LIMIT 5")
def changes_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _changes(spark, sf_dir)
    for wrong in (dict(start=NOW + dt.timedelta(1)), dict(start=NOW - dt.timedelta(31)), dict(start=NOW, most=0), dict(start=NOW, categories=["nope"])):
        try:
            changes.since(rows, now=NOW, **wrong)
        except ValueError:
            continue
        raise AssertionError(wrong)
    return changes.since(rows, NOW - dt.timedelta(days=7), NOW, ["blog"], True, 5)[1].select("id")


# what a client asks for


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id", F.lit("quarantined").alias("s")).distinct()
    return table(spark, sf_dir, "documents").join(bad, "doc_id", "left").withColumn("ai_status", F.coalesce("s", F.lit("processed"))).withColumnRenamed("source", "source_type")


@register("api_search", _hits("documents", "doc_id", "text", _has("idiot"), _or_rank("idiot")) + " SELECT doc_id, round(rank, 6) AS score FROM t WHERE pos <= 100 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def api_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.search_page(documents(spark, sf_dir), _pages(spark, sf_dir), "idiot", size=1000)[0].select("doc_id", "score")


@register("api_stats", "SELECT (SELECT count(*) FROM documents) AS pages, (SELECT count(*) FROM events) AS versions")
def api_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.stats(_pages(spark, sf_dir), table(spark, sf_dir, "events"))[0]


@register("api_changes", "SELECT count(*) AS total FROM events WHERE event_type <> 'view' AND ts >= TIMESTAMP '2024-01-20 06:00:00' AND event_id % 3 <> 2")
def api_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.changes_page(_changes(spark, sf_dir), "2024-01-20T06:00:00", NOW, "forum", 500)[0]


@register("api_entity", GRAPH + " SELECT type, key, 'D' || key AS display, least(count(DISTINCT url), 20) AS n_pages FROM m WHERE type = 'location' AND key = '7' GROUP BY ALL")
def api_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions, entities, _ = graph.rebuild(_versions(spark, sf_dir))
    return api.entity(entities, mentions, "location", " 7").select("type", "key", "display", F.size("pages").cast("long").alias("n_pages"))


@register("api_semantic", f"""WITH e AS (SELECT vec_id AS doc_id, {EXACT} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 50) SELECT doc_id, round(score, 6) AS score FROM e WHERE doc_id IN (SELECT doc_id FROM documents) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def api_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", QUERY, 50).withColumnRenamed("vec_id", "doc_id")
    return api.semantic_page(hits, _pages(spark, sf_dir), "doc_id")[0].select("doc_id", F.round("score", 6).alias("score"))
