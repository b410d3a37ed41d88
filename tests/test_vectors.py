"""Known inputs and results of single operators."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lithic import settings as conf
from lithic.functions import entities, urls
from lithic.functions import text as T
from lithic.operators import agents, changes, fulltext, models, quota, search, versions
from lithic.plans import documents
from lithic.sources import snapshots, tables


def values(spark, column, *inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_normalize(spark):
    got = values(spark, urls.normalize(F.col("x")), "HTTP://EXAMPLE.ONION/Page?b=2&a=1#frag", "http://x.onion:80/path/", "http://x.onion/", "no url", None)
    assert got == ["http://example.onion/page?a=1&b=2", "http://x.onion/path", "http://x.onion/", "no url", None]


def test_normalize_is_idempotent(spark):
    xs = ["https://A.b:443/x//?z=1&&a", "http://h?k", "http://h/p/?b=2&b=1&a"]
    once = values(spark, urls.normalize(F.col("x")), *xs)
    assert values(spark, urls.normalize(F.col("x")), *once) == once


def test_domain_and_host(spark):
    assert values(spark, urls.domain(F.col("x")), "http://www.Sub.Example.Onion:80/a?b", "example.onion.", "x") == ["example.onion", "example.onion", "x"]
    assert values(spark, urls.host(F.col("x")), "http://u:p@Host.onion:8080/a", "garbage") == ["Host.onion", None]


def test_links(spark):
    onion = "a" * 56 + ".onion"
    page = f'<a href="/x">y</a><script>var u="http://{"b" * 56}.onion"</script><!-- <a href="/no">n</a> --><p>see {onion}/p and <a href="/x">again</a></p><a href="#top">t</a>'
    rows = spark.createDataFrame([(page, "http://h.onion/dir/page?q#f")], "html string, url string")
    assert rows.select(urls.links(F.col("html"), F.col("url"))).first()[0] == ["http://h.onion/x", f"http://{onion}/p", "http://h.onion/dir/page?q#top"]
    many = "".join(f'<a href="/{i}">x</a>' for i in range(50))
    rows = spark.createDataFrame([(many, "http://h.onion")], "html string, url string")
    assert rows.select(urls.links(F.col("html"), F.col("url"), 20)).first()[0] == [f"http://h.onion/{i}" for i in range(20)]


def test_traps(spark):
    assert values(spark, urls.looks_like_trap(F.col("x")), "http://h/a/b/a/c/a", "http://h/a/b/a", "http://h/?PHPSESSID=1", "nothing") == [True, False, True, True]


def test_strip_html(spark):
    got = values(spark, T.strip_html(F.col("x")), "<p>A  long &amp; fine paragraph</p><script>alert('xss')</script>", "", None)
    assert got == ["A long & fine paragraph", "", None]


def test_chunks(spark):
    got = values(spark, T.chunks(F.col("x"), 100, 15), None, "  ", "short", "x" * 5000)
    assert got[:3] == [[], [], ["short"]]
    assert len(got[3]) > 1 and all(len(c) <= 400 for c in got[3]) and got[3][-1][-1] == "x"
    assert len(values(spark, T.chunks(F.col("x"), 100, 0), "y" * 1000)[0]) == 3


def test_chunks_cover(spark):
    text = "".join(chr(97 + i % 26) for i in range(3333))
    parts = values(spark, T.chunks(F.col("x"), 50, 20), text)[0]
    step, whole = 160, parts[0]
    for k, part in enumerate(parts[1:], 1):
        whole = whole[: k * step] + part
    assert whole == text


def test_language(spark):
    en = "the cat is on the table and it was with the dog in the house of that man"
    pt = "o gato não foi para a casa de um homem que é mais como os outros da rua em que mora"
    got = values(spark, T.language(F.col("x")), en, pt, "two words", "zzz " * 20, None)
    assert got[0]["code"] == "en" and got[0]["confidence"] <= 1
    assert got[2:] == [None, None, None]
    assert got[1] is None or got[1]["code"] == "pt"
    assert values(spark, T.language_code(F.col("x")), None, " EN ", "english", "") == ["und", "en", "en", "und"]


def test_sentence_diff(spark):
    rows = spark.createDataFrame([("One here. Two there.", "Two there. Three now!"), ("A 1. B.", "b.  a 22."), (None, "New.")], "old string, new string")
    got = [(r.added, r.removed, r.changed_chars) for r in changes.diff(rows, "old", "new").collect()]
    assert got == [(["Three now!"], ["One here."], 19), ([], [], 0), (["New."], [], 4)]


def test_change_status(spark):
    rows = spark.createDataFrame([(10, False, False), (10, True, False), (10, False, True), (40, False, False)], "c int, e boolean, k boolean")
    assert [r[0] for r in rows.select(changes.status(F.col("c"), F.col("e"), F.col("k"))).collect()] == ["trivial", "pending", "pending", "pending"]


def test_checksums():
    assert entities.valid_base58("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa")
    assert entities.valid_base58("3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy")
    assert not entities.valid_base58("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb")
    assert entities.valid_bech32("bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4")
    assert entities.valid_bech32("BC1QW508D6QEJXTDG4Y5R3ZARVARY0C5XW7KV8F3T4")
    assert entities.valid_bech32("bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj0")
    assert not entities.valid_bech32("bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5")
    assert not entities.valid_bech32("bc1QW508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4")
    assert entities.valid_onion("pg6mmjiyjmcrsslvykfwnntlaru7p5svn6y2ymmju6nubxndf4pscryd.onion")
    assert not entities.valid_onion("a" * 56 + ".onion")


def test_pattern_entities(spark):
    text = "Pay 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa or 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb, mail A@b.co and a@B.co, 0x" + "aB" * 20 + " hash " + "0" * 64
    docs = spark.createDataFrame([(1, text), (2, None)], "id long, t string")
    got = {(r.type, r.entity_key, r.confidence) for r in entities.merge_entities(entities.pattern_entities(docs, "id", "t"), "id").collect()}
    assert got == {("crypto_wallet", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", 1.0), ("crypto_wallet", "0x" + "ab" * 20, 0.9), ("email", "a@b.co", 0.9)}


def test_fold(spark):
    assert values(spark, entities.fold(F.col("x")), "José  da SILVA", "Plain  Name") == ["jose da silva", "plain name"]
    assert values(spark, entities.label(F.col("x")), "crypto_wallet") == ["CryptoWallet"]


def test_query_parser():
    assert search.parse('a "b c" -d or e') == [[search.Term(("a",), False), search.Term(("b", "c"), False), search.Term(("d",), True)], [search.Term(("e",), False)]]
    assert search.parse('"unclosed - or') and search.parse("") == [] and search.parse("- or !") == []


def test_search(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Red apple, red pear"), (2, "apple red"), (3, "green"), (4, None)], "id long, t string")
    index = fulltext.build(docs, "id", "t", str(tmp_path))
    hits = lambda q, **more: [r.id for r in search.full_text(index, q, **more).orderBy("pos").collect()]
    assert hits("red apple") == [1, 2] and hits('"apple red"') == [1, 2] and sorted(hits("red -pear or green")) == [2, 3]
    assert hits("none") == [] and hits("!") == [] and sorted(hits("-red")) == [3, 4] and hits("red", size=1, page=1) == [2]
    for wrong in (dict(query=" "), dict(query="a", size=0), dict(query="a", page=-1)):
        with pytest.raises(ValueError):
            search.full_text(index, **wrong)
    assert search._lexemes("b a -c or a") == ["a", "b", "c"]


def test_rank_by_hand(spark, tmp_path):
    index = fulltext.build(spark.createDataFrame([(1, "a x b a"), (2, "b")], "id long, t string"), "id", "t", str(tmp_path))
    rank = lambda q: {r.id: r["rank"] for r in search.found_in(index, q).collect()}
    assert rank("a or b") == {1: pytest.approx(0.1 / 1.64493406685 * (1 + 1 / 4 + 1) / 2), 2: pytest.approx(0.1 / 1.64493406685 / 2)}
    near = lambda d: 0.1 * (1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))) ** 0.5
    assert rank("a b") == {1: pytest.approx(1 - (1 - near(2)) * (1 - near(1)))}


def test_headline_has_two_fragments(spark):
    text = " ".join("hit" if k in (5, 60, 99) else f"w{k}" for k in range(120))
    one, two = spark.createDataFrame([(text,)], "t string").select(search.headline(F.col("t"), "hit")).first()[0].split(" ... ")
    assert len(one.split()) == len(two.split()) == 40 and "<b>hit</b>" in one and "<b>hit</b>" in two
    plain = spark.createDataFrame([(text,), ("a hit",)], "t string").select(search.passage(F.col("t"), "hit")).collect()
    assert len(plain[0][0].split()) == 120 and plain[1][0] == "a hit"


def test_nearest_skips_what_is_no_vector(spark):
    vectors = np.random.default_rng(3).normal(size=(1, 16))
    odd = spark.createDataFrame([(1, None), (2, [1.0]), (3, [0.0] * 16), (4, vectors[0].tolist())], "i long, v array<double>")
    assert [r.i for r in search.nearest(odd, "i", "v", vectors[0].tolist(), 10).collect()] == [4]


def test_fusion(spark):
    a = spark.createDataFrame([("x", 3), ("y", 1)], "url string, pos int")
    b = spark.createDataFrame([("x", 2), ("z", 1)], "url string, pos int")
    got = [(r.url, r.score) for r in search.fuse(a, b, "url").collect()]
    assert got[0] == ("x", round(1 / 63 + 1 / 62, 6)) and [g[0] for g in got] == ["x", "y", "z"]
    assert [r.url for r in search.by_best_position(a, b, "url").orderBy("pos").collect()] == ["y", "z", "x"]


def test_budget(spark):
    rows = spark.createDataFrame([(i, "p" * 60) for i in range(3)], "pos int, t string")
    assert [len(r.t) for r in search.within_budget(rows, [], "pos", "t", 100).orderBy("pos").collect()] == [60, 40]


def test_versions(spark):
    log = spark.createDataFrame([("u", "a", 1), ("u", "a", 2), ("u", "b", 3), ("u", None, 4), ("v", None, 5)], "url string, h string, seq int")
    assert [r.version for r in versions.numbered(log, "url", "h", "seq").orderBy("seq").collect()] == [1, 1, 2, 3, 1]
    assert [(r.url, r.version) for r in versions.history(log, "url", "h", "seq", "seq").orderBy("version").collect()] == [("u", 1), ("u", 2)]


def test_quota(spark):
    row = spark.range(1).select(*quota.binding(F.lit(15), F.lit(10), F.lit(500), F.lit(499))).first()
    assert tuple(row) == (1, 500)
    calls = spark.createDataFrame([(1, 100, True, ["a"]), (2, 100, False, []), (3, 10**9, True, [])], "call_id int, estimate int, interactive boolean, tried array<string>")
    quotas = spark.createDataFrame([("a", 10, 100, 10**6, 10**6), ("b", 90, 100, 10**6, 10**6)], "provider string, remaining int, limit int, tokens_left int, token_limit int")
    assert {r.call_id: r.provider for r in quota.route(calls, ["a", "b"], quotas).collect()} == {1: "b", 2: "b", 3: None}


def test_breaker(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    seconds = [0, 1, 2, 3, 4, 33, 34, 50]  # the fourth failure opens, a try fails after thirty seconds and opens anew
    rows = spark.createDataFrame([("h", at(s), i, True) for i, s in enumerate(seconds)] + [("h", at(59) + dt.timedelta(seconds=5), 8, False), ("h", at(59) + dt.timedelta(seconds=6), 9, True), ("g", at(0), 0, False)], "host string, at timestamp, i int, failed boolean")
    got = [r.allowed for r in quota.breaker(rows, "host", "at", "i", "failed").where("host = 'h'").orderBy("i").collect()]
    assert got == [True, True, True, True, False, True, False, False, True, True]


@given(st.lists(st.integers(0, 60), max_size=8), st.integers(0, 100))
@settings(max_examples=8, deadline=None)
def test_greedy(spark, costs, budget):
    left, want = budget, []
    for c in costs:
        want.append(c <= left)
        left -= c if c <= left else 0
    rows = spark.createDataFrame([(costs,)], "c array<int>")
    assert rows.select(agents.greedy(F.col("c"), F.lit(budget))).first()[0] == want


def test_models():
    assert models.validated('```json\n{"text": "ok", "confidence": 7}\n```', "text") == ("ok", 1.0)
    assert models.validated("broken {", "text") == (None, 0.0)
    asked = []

    def low(task, text):
        asked.append("low")
        return '{"text": "weak", "confidence": 0.2}'

    def broken(task, text):
        raise models.ProviderError("out of quota", window="day")

    registry = models.Registry({"broken": broken, "low": low, "offline": models.offline}, pause=lambda s: None)
    assert registry.call("summarize", "First. Second.", "text") == ("First.", 0.9)
    assert registry.call("summarize", "First. Second.", "text") == ("First.", 0.9) and asked == ["low"]
    with pytest.raises(models.Exhausted) as wrong:
        models.Registry({"broken": broken}).call("summarize", "x", "text")
    assert wrong.value.quota_only
    assert abs(sum(x * x for x in models.embed("some words here")) - 1) < 1e-9 and models.embed("")[-1] == 1.0


def test_agents():
    ask = lambda instructions, sources: ("report", [sources[0][0], "made up"])
    agent = agents.Agent(" a ", "do", "topic", max_tokens=1_100)
    assert agents.run(agent, [], ask)["status"] == "succeeded"
    assert agents.run(agent, [("S1", "x" * 4000)], ask)["reason"] == "budget"
    done = agents.run(agent, [("S1", "x" * 4000), ("S2", "short")], ask)
    assert done["sources"] == ["S2"] and done["report"] == "report"
    assert agents.Agent("", "", "", categories=("nope",)).errors
    assert agents.answer("q", [("1", "t")], lambda q, s: ("x", ["9"])) == (models.NO_ANSWER, [])


def test_chat_deadlines_and_degrading():
    import time

    passages = [("S1", "one"), ("S2", "two")]
    ask = lambda q, sources: ("said", ["S2", "S2", "S9"])
    seen = []

    def find(question, rewritten):
        seen.append((question, rewritten))
        return passages

    def late(*_):
        time.sleep(0.5)
        return "late"

    def broken(*_):
        raise ValueError

    assert agents.chat("q" * 2000, lambda q: "better", find, ask) == {"answer": "said", "sources": [("S2", "two")], "results": ["S1", "S2"], "degraded": False}
    assert seen[0] == ("q" * 1000, "better")
    for rewrite in (late, broken):
        agents.chat("q", rewrite, find, ask, rewrite_seconds=0.05)
        assert seen[-1] == ("q", None)
    for wrong in (late, broken):
        assert agents.chat("q", lambda q: q, find, wrong, answer_seconds=0.05) == {"answer": "", "sources": [], "results": ["S1", "S2"], "degraded": True}
    assert agents.chat("q", lambda q: q, lambda q, r: [], broken)["answer"] == models.NO_ANSWER


def test_providers():
    assert models.failure(200) is None and [models.failure(429).window, models.failure(429, "requests per day").window, models.failure(402).window] == ["minute", "day", "balance"]
    assert [models.failure(s).retryable for s in (400, 401, 408, 500, 503)] == [False, False, True, True, True]
    asked = []

    def post(path, body):
        asked.append((path, body))
        if "content" in path.lower():
            return 200, '{"candidates": [{"content": {"parts": [{"text": "{\\"text\\": \\"b\\", \\"confidence\\": 1}"}]}}]}'
        return (500, "") if len(asked) < 3 else (200, '{"choices": [{"message": {"content": "{\\"text\\": \\"a\\", \\"confidence\\": 0.1}"}}]}')

    clock, pauses = [0.0], []
    registry = models.Registry.of({"one": {"model": "m"}, "two": {"model": "n", "shape": "content"}}, post, pause=pauses.append, clock=lambda: clock[0])
    assert registry.call("summarize", "text", "text") == ("b", 1.0) and pauses == [0.2, 0.4] and len(asked) == 4
    assert registry.call("summarize", "text", "text") == ("b", 1.0) and len(asked) == 4
    clock[0] = 24 * 3600.0
    assert registry.call("summarize", "text", "text") == ("b", 1.0) and len(asked) > 4
    with pytest.raises(models.Unavailable):
        models.Registry({}).call("summarize", "text", "text")
    for status, body in ((200, "no json"), (200, "{}"), (404, "")):
        with pytest.raises(models.Exhausted) as wrong:
            models.Registry.of({"a": {"model": "m"}}, lambda p, b, s=status, t=body: (s, t)).call("summarize", "t", "text")
        assert not wrong.value.quota_only
    with pytest.raises(models.Exhausted) as wrong:
        models.Registry.of({"a": {"model": "m"}}, lambda p, b: (402, "")).call("summarize", "t", "text")
    assert wrong.value.quota_only


def test_embedding_batches():
    sizes = []
    call = lambda batch: (sizes.append(len(batch)), [[float(len(t))] for t in batch])[1]
    assert models.embed_in_batches(["x" * k for k in range(250)], call, 1) == [[float(k)] for k in range(250)] and sizes == [100, 100, 50]
    for wrong in (lambda b: [], lambda b: [[1.0, 2.0]] * len(b)):
        with pytest.raises(models.ProviderError):
            models.embed_in_batches(["a"], wrong, 1)
    near = lambda a, b: sum(x * y for x, y in zip(models.embed(a), models.embed(b), strict=True))
    assert near("bitcoin", "moedas") == pytest.approx(1) and near("bitcoin", "senhas") == 0 and models.embed("")[-1] == 1.0


def test_references_and_sanitizing(spark):
    assert values(spark, T.decode_references(F.col("x")), "a &lt;&#233;&#xE9;&euro;&nope;&#0;&amp;lt; &", "plain", None) == ["a <éé€&nope;&#0;&lt; &", "plain", None]
    dirty = '<div onclick="x()"><p class="a">t <a href="javascript:x">u</a><a href="https://h/?a=1&b" target=_blank>v</a></p><script>w</script><custom>y</custom></div>'
    assert values(spark, T.sanitize(F.col("x")), dirty) == ['<p>t <a>u</a><a href="https://h/?a=1&b" rel="nofollow">v</a></p>y']


def test_api_arguments(spark, tmp_path):
    from lithic import api

    index = fulltext.build(spark.createDataFrame([(1, "a b")], "id long, t string"), "id", "t", str(tmp_path))
    pages = spark.createDataFrame([(1, "a b", "processed", "x")], "id long, text string, ai_status string, source_type string")
    assert api.search_page(index, pages, "a")[0].collect()[0].snippet == "<b>a</b> b"
    none = spark.createDataFrame([], "id long, name string")
    for call in (lambda: api.search_page(index, pages, " "), lambda: api.ask(" ", None, None, None)):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(LookupError):
        api.agent(agents.Store(none, none.withColumnRenamed("name", "agent_id")), 1)
    entities = spark.createDataFrame([("email", "a@b.co", "d", 1)], "type string, key string, display string, pages int")
    with pytest.raises(LookupError):
        api.entity(entities, entities, "email", "x@y.z")


def test_chain_order_and_unknown_types(spark):
    from lithic.operators import graph, processing

    seen = []

    def step(name):
        def run(df):
            seen.append(name)
            return df

        return run

    processing.chain(spark.range(1), {n: step(n) for n in ("entities", "language", "category", "summary")})
    assert seen == ["language", "summary", "category", "entities"]
    with pytest.raises(ValueError):
        graph.lookup(spark.range(1), "animal", "x")
    with pytest.raises(ValueError):
        agents.Store(spark.createDataFrame([(1, "a")], "id long, name string"), spark.createDataFrame([], "id long, agent_id long")).put(spark.createDataFrame([(2, "a")], "id long, name string"))
    with pytest.raises(RuntimeError):
        search.semantic_page(None)


def test_sources(spark, tmp_path):
    raw = spark.createDataFrame([('{"url": "http://h", "html": "<p>"}',), ("broken",), (None,)], "value string")
    good, dead = tables.parse_events(raw)
    assert good.count() == 1 and dead.count() == 2
    lines = spark.createDataFrame([("# c",), (" " + "A" * 32 + " ",), ("b" * 31,), ("",)], "value string")
    assert [r.value for r in tables.hash_list(lines).collect()] == ["a" * 32]
    assert tables.valid_patterns(spark, ["# c", "(", "(?P<x>a)", "ok", "(?<x>a)"]) == ["ok", "(?<x>a)"] and tables.size_limit(0) is None
    assert tables.read_list(spark, "/nowhere/at/all").count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_hashes(spark, "/nowhere/at/all")
    store = snapshots.Store(spark, str(tmp_path / "store"))
    assert tables.ensure_collection(store, "a", 3) == {"a": 3} == tables.ensure_collection(snapshots.Store(spark, store.folder), "a", 3)
    assert tables.ensure_collection(store, "b", 4) == {"a": 3, "b": 4} and store.snapshot().version == 2
    with pytest.raises(ValueError):
        tables.ensure_collection(store, "a", 4)
    with pytest.raises(ValueError):
        conf.parse(["no_such_setting: 1"])
    assert conf.load("/nowhere") == conf.DEFAULTS
    records = spark.createDataFrame([("k", "x" * 10), ("l", "x" * 2_000_000)], "key string, value string")
    fits, large = tables.split_oversized(records, tables.size_limit(1), F.current_timestamp())
    assert fits.count() == 1 and large.first().note.startswith("l|")


def test_lexemes_reach_the_end_of_long_texts(spark, tmp_path):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota"
    spark.createDataFrame([(1, "filler " * 80_000 + passage)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [tuple(r) for r in documents.contamination_ngrams(spark, str(tmp_path)).collect()] == [(1, 2)]
    tail = search.postings(spark.read.parquet(f"{tmp_path}/documents.parquet"), "doc_id", "text").where("lexeme = 'iota'").collect()
    assert [r.pos for r in tail] == [80_008]
