"""Queries over crawled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.catalog import register
from lithic.functions import text as T
from lithic.functions import urls
from lithic.operators import graph, guard
from lithic.sources.tables import table

STRIP = r"""trim(regexp_replace({}, '[ \t\n\r\f\x0B\x{{00A0}}]+', ' ', 'g'))"""


def _stripped(column: str) -> str:
    sql = f"regexp_replace({column}, '(?is)<script\\b[^>]*>.*?</script>|<style\\b[^>]*>.*?</style>|<!--.*?-->', '', 'g')"
    sql = f"regexp_replace({sql}, '(?is)</?(?:p|ul|ol|li|h1|h2|h3|h4|table|tr|td|th|pre|blockquote)(?:[\\s/][^>]*)?>', ' ', 'g')"
    sql = f"regexp_replace({sql}, '(?s)<[^>]*>', '', 'g')"
    for name, value in (("&nbsp;", chr(160)), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        sql = f"replace({sql}, '{name}', '{value}')"
    return STRIP.format(sql)


PAGE_TEXT = _stripped("html")
NORMAL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(lower(trim(url)), '#.*$', '') AS low FROM pages),
b AS (SELECT *, regexp_extract(low, '^([a-z][a-z0-9+.-]*)://', 1) AS scheme, regexp_extract(low, '^[a-z][a-z0-9+.-]*://([^/?]*)', 1) AS host,
  regexp_extract(low, '^[a-z][a-z0-9+.-]*://[^/?]*([^?]*)', 1) AS path, regexp_extract(low, '^[^?]*\?(.*)$', 1) AS q FROM a),
c AS (SELECT page_id, url, scheme, CASE scheme WHEN 'http' THEN regexp_replace(host, ':80$', '') WHEN 'https' THEN regexp_replace(host, ':443$', '') ELSE host END AS host,
  CASE WHEN path = '/' THEN path ELSE regexp_replace(path, '/+$', '') END AS path,
  array_to_string(list_sort(list_transform(list_filter(string_split(q, '&'), lambda p: p <> ''), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)), '&') AS params FROM b)
SELECT page_id, CASE WHEN scheme <> '' THEN scheme || '://' || host || path || CASE WHEN params <> '' THEN '?' || params ELSE '' END ELSE url END AS normalized FROM c
"""
DOMAIN = r"list_reverse(list_reverse(string_split(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '[/:?#].*$', ''), '\.+$', ''), '.'))[1:2])"


@register("html_to_text", f"SELECT page_id, md5({PAGE_TEXT}) AS text_md5, CAST(length({PAGE_TEXT}) AS INTEGER) AS n_chars, length({PAGE_TEXT}) >= 20 AS usable FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))
    return rows.select("page_id", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"), T.enough_text(F.col("text")).alias("usable"))


@register("url_normalize", NORMAL)
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize(F.col("url")).alias("normalized"))


@register("host_counts", "SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS host, count(*) AS n_pages FROM pages GROUP BY ALL")
def host_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(F.lower(urls.host(F.col("url"))).alias("host")).agg(F.count("*").alias("n_pages"))


LINKS = r"""
WITH r AS (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS root,
  unnest(regexp_extract_all(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?is)<a\b[^>]*?href\s*=\s*"([^"]*)"', 1)) AS href FROM pages)
SELECT DISTINCT page_id, CASE WHEN href LIKE 'http%' THEN href ELSE root || href END AS link FROM r
"""


@register("extract_links", LINKS)
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(urls.links(F.col("html"), F.col("url"))).alias("link"))


BANNED = ("spam-farm.example.org", "spam-farm.example.com")


def _banned(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.md5(F.lit(h)) for h in ("example.org", "example.onion")])).alias("value"))


@register("denylist_md5_anti", f"SELECT page_id, url FROM pages WHERE md5(array_to_string({DOMAIN}, '.')) NOT IN (md5('example.org'), md5('example.onion'))")
def denylist_md5_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.not_banned(table(spark, sf_dir, "pages").select("page_id", "url"), _banned(spark))


@register("denylist_host_semi", f"SELECT page_id FROM pages WHERE lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) IN {tuple('www.' + b for b in BANNED) + BANNED}")
def denylist_host_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = spark.range(1).select(F.explode(F.array(*[F.lit(x) for b in BANNED for x in (b, f"www.{b}")])).alias("value"))
    return guard.denied_hosts(table(spark, sf_dir, "pages"), hosts).select("page_id")


#: A url of each kind for every page: onion, trap by segment, trap by session, garbage, with port and case, and its own.
KINDS = {
    0: "'http://' || repeat('ab2', 18) || '7q.ONION/x?y=1#z'", 1: "'http://h.example/a/b/a/c/a/' || page_id", 2: "'https://Sub.H.example/p?PHPSESSID=' || page_id",
    3: "'not a url ' || page_id", 4: "'HTTPS://Sub.Host.Example:8443/p//'", 5: "url",
}
KIND = "CASE page_id % 6 " + " ".join(f"WHEN {k} THEN {sql}" for k, sql in KINDS.items()) + " END"


@register("crawler_traps", rf"""WITH u AS (SELECT page_id, {KIND} AS url FROM pages), p AS (SELECT *, list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '') AS parts FROM u)
SELECT page_id, regexp_matches(url, '(?i)[?&;](phpsessid|jsessionid|sid|sessionid|session_id)=') OR NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/:?#]') OR coalesce(list_max(list_transform(parts, lambda p: len(list_filter(parts, lambda q: q = p)))), 0) > 2 AS trap,
regexp_matches(lower(url), '^[a-z]+://[^/:?#]*[.]onion') AS onion, nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1), '') AS host FROM p""")
def crawler_traps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").withColumn("url", F.expr(KIND))
    return rows.select("page_id", urls.looks_like_trap(F.col("url")).alias("trap"), urls.is_onion(F.col("url")).alias("onion"), urls.host(F.col("url")).alias("host"))


@register("links_resolved", """WITH r AS (SELECT page_id, page_id % 7 AS k, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS root FROM pages)
SELECT page_id, CASE k WHEN 0 THEN root || '/a/c?x=../y' WHEN 1 THEN 'http://x.example/q' WHEN 2 THEN root || '/z' WHEN 3 THEN root || '/a/b/d?e#f' WHEN 4 THEN root || '/a/b/page?q=2' WHEN 5 THEN root || '/a/' ELSE root || '/a/b/page?p=1' END AS link FROM r""")
def links_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.concat(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.lit("/a/b/page?p=1"))
    kinds = ["../c?x=../y", "http://x.example/q", "/y/../../z", "./d?e#f", "?q=2", "..", ""]
    href = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("page_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", urls.resolve(href, base).alias("link"))


@register("html_sanitized", r"""SELECT page_id, CAST(length(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->', '', 'g')) - length(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->', '', 'g'), '(?is)<p[\s>]', '', 'g')) AS BIGINT) // 3 AS paragraphs, false AS left_over FROM pages""".replace("\\\\", "\\"))
def html_sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = T.sanitize(F.col("html"))
    rows = table(spark, sf_dir, "pages").select("page_id", clean.alias("clean"))
    other = r"(?is)<(?!/?(?:" + "|".join(T.APART + T.INLINE) + r")>|a href=\"https?://[^\s\"]*\" rel=\"nofollow\">)[a-z!?/][^>]*>"
    return rows.select("page_id", F.regexp_count("clean", F.lit("<p>")).cast("long").alias("paragraphs"), F.col("clean").rlike(other).alias("left_over"))


@register("graph_bfs", """
WITH RECURSIVE e AS (SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber),
t(node, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT e.dst, t.depth + 1 FROM t JOIN e ON e.src = t.node WHERE t.depth < 3)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM t GROUP BY node""")
def graph_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    nxt = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("dst"))
    links = lines.join(nxt, ["l_orderkey", "l_linenumber"]).select(F.col("l_suppkey").alias("src"), "dst").distinct()
    return graph.reach(links, spark.range(1, 2).select(F.col("id").alias("node")), 3)


@register("graph_bfs_bounded", """
WITH RECURSIVE e AS (SELECT l_orderkey % 200 AS src, l_suppkey AS dst, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY ALL),
f AS (SELECT src, dst FROM e QUALIFY row_number() OVER (PARTITION BY src ORDER BY pos, dst) <= 3),
one AS (SELECT DISTINCT dst AS node FROM f WHERE src = 1 AND dst <> 1), one_kept AS (SELECT node FROM one ORDER BY node LIMIT 2),
two AS (SELECT DISTINCT f.dst AS node FROM f JOIN one_kept ON f.src = one_kept.node WHERE f.dst <> 1 AND f.dst NOT IN (SELECT node FROM one_kept)), two_kept AS (SELECT node FROM two ORDER BY node LIMIT 2)
SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION ALL SELECT node, 1 FROM one_kept UNION ALL SELECT node, 2 FROM two_kept""")
def graph_bfs_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    links = lines.select((F.col("l_orderkey") % 200).alias("src"), F.col("l_suppkey").alias("dst"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return graph.reach(links, spark.range(1, 2).select(F.col("id").alias("node")), 2, per_page=3, capacity=2)
