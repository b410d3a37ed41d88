"""The ten operators against brute force, published rules and hand-made cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithic.llm import boosting, components, hosts, licences, mixing, pagetext, pieces, simhash, substrings, surrogates, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, taken string"


def documents(spark, rows):
    """Documents with two extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", "y") for i, t, s in rows], DOCS)


def drawn(seed: int, n: int, words=("red", "blue", "green", "one", "two")) -> list[tuple]:
    rnd = random.Random(seed)
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 40))), rnd.choice(["a", "b", None])) for i in range(n)]
    for k in range(n, 2 * n):
        a, b = rnd.choice(rows[:n]), rnd.choice(rows[:n])
        rows.append((k, (a[1] + " q " + b[1]).strip(), rnd.choice(["a", "b"])))
    return [*rows, (2 * n, None, "a"), (2 * n + 1, "", "b"), (2 * n + 2, "", None), (3, rows[3][1], rows[3][2]), (None, rows[4][1], "a")]


# 1
def test_surrogates_keep_format_distinctness_and_coreference(spark):
    text = "Call Mr. John Smith or Mrs. Anna Smith, +1 (743) 555-3824, 4111 1111 1111 1111 x 4111111111111111. SSN 123-45-6789"
    rows = [(1, text), (2, "743-555-3824 г-жа Анна Иванова 10.0.0.1 1.2.3.4.5 token: 'abcdefgh12' a@b.co, A@B.co Mr. Smith"), (3, None), (4, ""), (5, "no data, 12 words 3.5"), (1, text)]
    docs = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, n_entities string")
    got = surrogates.replace(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and by[3].text is None and by[4].text == "" and by[5].text == rows[4][1] and by[5].n_entities == 0
    one, two = by[1].text, by[2].text
    assert len({r.text for r in got if r.doc_id == 1}) == 1
    for secret in ("Smith", "John", "555-3824", "4111", "123-45-6789", "Иванова", "10.0.0.1", "abcdefgh12", "a@b.co"):
        assert secret not in one + two
    m = re.fullmatch(r"Call Mr\. (\w+n) (\w+r) or Mrs\. (\w+na) (\w+r), \+1 \((\d{3})\) (\d{3}-\d{4}), (\d{4}(?: \d{4}){3}) x (\d{16})\. SSN \d{3}-\d{2}-\d{4}", one)
    assert m and m[2] == m[4] and m[1] != m[3] and m[7].replace(" ", "") == m[8] and m[8][0] == "4"
    digits = [int(c) for c in m[8]]
    assert sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0
    assert two.startswith(f"{m[5]}-{m[6]}") and "1.2.3.4.5" in two and two.endswith(f"Mr. {m[2]}")
    assert re.search(r"г-жа [А-Яа-я]+на [А-Яа-я]+р? ", two.replace("Мr", ""))
    assert surrogates.replace(docs.limit(0)).count() == 0


def test_surrogates_match_brute_force(spark):
    """Every entity that a plain search finds is replaced, alike everywhere and differently from all others, and
    nothing else of a text changes."""
    import regex

    rnd = random.Random(11)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    make = {
        "email": lambda: f"{rnd.choice(['ann', 'bob.k', 'c_d'])}{rnd.randrange(30)}@h{rnd.randrange(5)}.{rnd.choice(['org', 'co.uk'])}",
        "phone": lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", "ip": lambda: ".".join(str(rnd.randrange(256)) for _ in range(4)), "card": lambda: "-".join(digits(4) for _ in range(4)),
        "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", "secret": lambda: f"token={rnd.choice(['abc', '***', 'Xy9'])}{digits(5)}", "access": lambda: "AKIA" + "".join(rnd.choice("ABCDEFGH23") for _ in range(16)),
        "iban": lambda: "DE" + digits(2) + "".join(f" {digits(4)}" for _ in range(4)) + f" {digits(2)}",
    }
    made = [rnd.choice(list(make.values()))() for _ in range(120)]
    filler = "the quick 12 brown 3.5 fox v2 a@b 99-99 .. (call) x=1".split()
    texts = [" | ".join(rnd.choice(made) + rnd.choice(["", ".", ",", ")"]) if rnd.random() < 0.3 else rnd.choice(filler) for _ in range(40)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in surrogates.replace(docs).collect()}
    plain = regex.compile("|".join(f"(?:{p})" for p in surrogates.PATTERNS.values()))
    kinds = {k: regex.compile(p) for k, p in surrogates.PATTERNS.items()}
    swaps: dict[str, str] = {}
    for i, text in enumerate(texts):
        found = list(plain.finditer(text))
        assert got[i].n_entities == len(found)
        at, rest = 0, got[i].text
        for k, m in enumerate(found):
            gap = text[at : m.start()]
            assert rest.startswith(gap)
            rest, at = rest[len(gap) :], m.end()
            behind = text[at : found[k + 1].start() if k + 1 < len(found) else len(text)]
            new = swaps.get(m[0]) or (rest[: rest.index(behind)] if behind else rest)
            assert rest.startswith(new) and swaps.setdefault(m[0], new) == new
            rest = rest[len(new) :]
        assert rest == text[at:]
    assert len(set(swaps.values())) == len(swaps) and not set(swaps) & set(swaps.values())
    kind = lambda x: next(k for k, p in kinds.items() if p.fullmatch(x))
    assert len(swaps) > 80 and all(kind(a) == kind(b) for a, b in swaps.items())


def test_surrogates_are_redrawn_until_distinct(spark):
    entities = spark.createDataFrame([("last_latin", f"{a}{b}") for a in "abcdefghij" for b in "klmnopqrst"], "kind string, canon string")
    got = surrogates.distinct_surrogates(entities).collect()
    assert len({r.surrogate for r in got}) == 100


def test_surrogates_at_the_end_of_sentences_and_behind_prefixed_keys(spark):
    texts = ["Write to john@x.com.", "Ask john@x.com. Then go", "a@b.co... or john@x.com.2", "access_token=abcdef123456 client_secret=abcdef123456", "DB_PASSWORD=abcdef123456.", "a@b" + "." * 20_000]
    got = surrogates.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_entities for r in got] == [1, 1, 2, 2, 1, 0]
    assert not any(own in r.text for r in got for own in ("john@x", "a@b.co", "abcdef123456"))
    assert got[0].text.endswith(".com.") and got[1].text.endswith(".com. Then go") and got[3].text.startswith("access_token=") and got[5].text == texts[5]


def test_surrogates_keep_script_case_and_clashing_columns(spark, monkeypatch):
    from lithic.llm import shared

    rows = [(k, "κ. Mr. Ιωάννης Παππάς wrote to A.Bc@Site.org, a.bc@site.ORG. Παππάς left. password: ********") for k in range(6)] + [(9, None), (10, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("digest_", "digest", "swap_", "at_", "row_", "n_", "surface", "text_")})
    got = surrogates.replace(docs)
    assert set(got.columns) == {*docs.columns, "n_entities"}
    them = got.collect()
    assert all(r.digest_ == "digest_" and r.swap_ == "swap_" and r.n_ == "n_" for r in them) and len(them) == 8
    one = next(r for r in them if r.doc_id == 0)
    assert {r.text for r in them if r.doc_id < 9} == {one.text} and one.n_entities == 5
    m = re.fullmatch(r"κ\. Mr\. ([Α-Ω][α-ω]+) ([Α-Ω][α-ω]+) wrote to ([A-Z]\.[A-Z][a-z]@[A-Z][a-z]{3})\.org, ([a-z.@]+\.ORG)\. (\w+) left\. password: (\S{8,})", one.text)
    assert m and m[2] == m[5] and m[2] != "Παππάς" and m[3].lower() + ".org" == m[4].lower() and m[6] != "********"
    monkeypatch.setattr(shared, "SHARES", 10**6)  # every key is heavy
    assert sorted(map(str, surrogates.replace(docs).collect())) == sorted(map(str, them))


def test_surrogates_do_not_run_out(spark):
    rows = [("last_latin", f"{a}{b}{c}") for a in "abcdefghijklmnopqr" for b in "abcdefghijklmnopqr" for c in "abcdefghijklmnopqr"]
    rows += [("secret", "********"), ("secret", "пароль"), ("secret", "密码密码密码")] + [("email", f"_@{a}.com") for a in "abcdefghijklmnopqrstuvwxyz"] + [("phone", f"{i:04}") for i in range(10_000)]
    got = surrogates.distinct_surrogates(spark.createDataFrame(rows, "kind string, canon string")).collect()
    assert len(got) == len(rows) == len({(r.kind, r.surrogate) for r in got})
    assert not {(r.kind, r.surrogate) for r in got} & set(rows)
    docs = spark.createDataFrame([(1, "password: ******** and token=абвгдежз.")], "doc_id long, text string")
    text = surrogates.replace(docs).first().text
    assert re.fullmatch(r"password: \S{8,} and token=[а-я]{8,}\.?\S*", text) and "********" not in text and "абвгдежз" not in text


def test_surrogates_of_names_mentioned_again(spark):
    texts = ["Mr. John Smith called. Smith said that John Smith's car and Smith-led work, not a smithy or Smithson, mattered.", "Then Jones came. Dr. Smith and Prof. Dr. Anna Jones, a@b.co, met.", "Mr. John Smith is Dr. John Smith.", "Smith has no title here."]
    got = [r for r in surrogates.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    one = re.fullmatch(r"Mr\. (\w+n) (\w+r) called\. (\w+) said that (\w+) (\w+)'s car and (\w+)-led work, not a smithy or Smithson, mattered\.", got[0].text)
    assert one and one[1] == one[4] != "John" and len({one[i] for i in (2, 3, 5, 6)}) == 1 and one[2] != "Smith" and got[0].n_entities == 5
    two = re.fullmatch(r"Then (\w+r) came\. Dr\. (\w+r) and Prof\. Dr\. (\w+l) (\w+r), \w@\w\.co, met\.", got[1].text)
    assert two and two[1] == two[4] != "Jones" and two[2] == one[2] and two[3] != "Anna" and got[1].n_entities == 4
    assert got[2].text == f"Mr. {one[1]} {one[2]} is Dr. {one[1]} {one[2]}." and got[3].text == texts[3]


# 2
def test_simhash_matches_brute_force(spark):
    rows = drawn(2, 60)
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    fps = [simhash.fingerprint(None if t is None else t.encode()) for _, t, _ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in group}
    want = sorted(((r[0], f"{fp:016x}", least[g]) for r, fp, g in zip(rows, fps, group)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_simhash_hot_components(spark, monkeypatch):
    from lithic.llm import shared

    rows = drawn(2, 60)
    want = sorted(map(tuple, simhash.near_duplicates(documents(spark, rows)).collect()), key=str)
    monkeypatch.setattr(shared, "SHARES", 10**6)  # every key is heavy
    assert sorted(map(tuple, simhash.near_duplicates(documents(spark, rows)).collect()), key=str) == want


def test_one_of_each_judges_rows(spark):
    a, c = "one two three four five six", "nine ten eleven twelve thirteen fourteen"
    rows = [(1, a), (5, a), (5, c), (5, c), (None, a), (None, "only here and nowhere else at all"), (9, None), (8, "")]
    docs = documents(spark, [(i, t, None) for i, t in rows]).withColumn("root", F.lit(1)).withColumn("i", F.lit(2))
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, a), (5, c), (8, ""), (None, "only here and nowhere else at all")], key=str)
    assert simhash.one_of_each(documents(spark, [])).count() == 0


def test_simhash_search_is_complete_when_buckets_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", 3)
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(60):
            x = int(b)
            for bit in rnd.integers(0, 64, rnd.integers(1, 6)):
                x ^= 1 << int(bit)
            fps.add(x & ((1 << 64) - 1))
    values = np.array(sorted(fps), dtype=np.uint64)
    nodes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    got = {r.node: r.root for r in components.components(simhash.links(nodes)).collect()}
    forest = components.Forest()
    for i, v in enumerate(values):
        for w in values[i + 1 :][np.bitwise_count(values[i + 1 :] ^ v) <= 4]:
            forest.join(int(v.view(np.int64)), int(w.view(np.int64)))
    signed = [int(v) for v in values.view(np.int64)]
    assert [got.get(v, v) for v in signed] == [forest.root(v) for v in signed]


def test_thresholds_sum_and_fingerprint_rules():
    costs = np.random.default_rng(0).random((simhash.PARTS, simhash.MOST_T + 2, 50)).cumsum(axis=1)
    assert (simhash.thresholds(costs).sum(axis=0) == simhash.MOST_BITS + 1).all()
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \t\n") == 0
    assert simhash.fingerprint(b"A b") == simhash.fingerprint(b" a  B\n") != 0
    assert simhash.fingerprint("É".encode()) != simhash.fingerprint("é".encode())


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long").repartition(8)).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_tables_of_other_operators_are_released():
    from lithic.llm import shared

    gone = []
    shared.alone("a", lambda: gone.append("a"))
    shared.alone("a", lambda: gone.append("a"))
    assert gone == []
    shared.alone("b", lambda: gone.append("b"))
    shared.alone("c")
    assert gone == ["a", "b"]


# 3
def test_pieces_equal_the_library(spark):
    import sentencepiece

    path = pieces.default_model()
    library, rnd = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(1)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "é", "ß", "😀", "▁", "1", ".", "-", "<s>", "<0x0A>", "\t", "\x00", "日", "�"]
    texts = [None, "", " " * 50, "ab" * 3000] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(500)]
    got = pieces.encode(documents(spark, [(i, t, "a") for i, t in enumerate(texts)]), path).collect()
    for r in got:
        ids = library.encode(texts[r.doc_id] or "") + [2]
        assert r.ids == ids and r.decoded == library.decode(ids)
    sums = {r.doc_id: r for r in pieces.digests(documents(spark, [(i, t, "a") for i, t in enumerate(texts)]), path).collect()}
    for r in got:
        s = sums[r.doc_id]
        assert (s.n_tokens, s.ids_sha256, s.decoded_sha256) == (len(r.ids), hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest(), hashlib.sha256(r.decoded.encode()).hexdigest())


# 4
def test_host_measures(spark):
    assert hosts.measure("a b c a b c x".encode()) == (7, 7, 0, 0, 6)
    assert hosts.measure(b"x\ny # |\nx\n\n") == (5, 5, 2, 1, 0)
    assert hosts.measure(None) == (0, 0, 0, 0, 0)
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good, "good") for i in range(40)] + [(100 + i, "short", "bad") for i in range(39)] + [(200, good, "bad"), (201, None, None), (202, "", None), (200, good, "bad")]
    got = {(r.doc_id): r for r in hosts.judge(documents(spark, rows)).collect()}
    assert got[0].kept and not got[100].kept and not got[200].base_failed and not got[200].kept and not got[201].kept
    assert hosts.judge(documents(spark, [])).count() == 0


# 5
def test_page_text():
    trees = pagetext.train(120, 1)
    page = '<html><head><title>t</title></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy this now.</div><article><h1>Title of it</h1><p>First &amp; good   paragraph,\n with text. It has another sentence.<p>Second <b>bold</b> one is here, too. And more of it.<script>x()</script></article><div class="comments"><p>I like it very much.</p></div><footer>&copy; x</footer></body></html>'
    tree = pagetext.Page(page)
    parts, chars = pagetext.features(tree)
    got = pagetext.render(tree, pagetext.chosen(tree, pagetext.odds_of(trees, [parts])[0], chars))
    assert got == "Title of it\nFirst & good paragraph, with text. It has another sentence.\nSecond bold one is here, too. And more of it."


def test_page_text_edges(spark):
    trees = boosting.Trees(1, 5.0)
    rows = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>a<br>b", "x"), (4, "u", "<div " * 50 + "plain < text", "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in pagetext.extract(rows, trees).collect()}
    assert got[1] == got[2] == ("", 0) and got[None] == ("a b", 3)
    assert pagetext.extract(rows.limit(0), trees).count() == 0


def whole_text(html: str) -> str:
    page = pagetext.Page(html)
    return pagetext.render(page, np.arange(len(page.tag)) > 0)


@pytest.mark.parametrize(
    "html,text",
    [
        ("<p>a <math><mi>E</mi>=<mn>2</mn></math> b", "a E=2 b"),
        ("<p>a<svg><p>b", "a\nb"),
        ("<p>a <video><b>b</b> c", "a b c"),
        ("<noscript>a<p>b", "a\nb"),
        ("<iframe>a<p>b", "a\nb"),
        ("<object>a<object>b</object>c</object>d", "abcd"),
        ("<title>a<p>b", "a\nb"),
        ("<script>a</script>b<style>c</style >d<SCRIPT>e</sCRIPT x>f", "bdf"),
        ("a<script>if (a</b) '</scripts>'", "a"),
        ("a <!-- b <p>c", "a c"),
        ("a<!-- b > c -->d<!DOCTYPE x>e<![CDATA[<f>]]>g", "ade<f>g"),
        ("x<a title='1 > 2'>y</a> 3 < 4 <b class=\"q>z", "xy 3 < 4 z"),
        ("<p>a<ul><li>b<li>c</ul><p>d<table><tr><td>e<td>f", "a\nb\nc\nd\ne\nf"),
        ("a </p> </q> b &lt;&amp;&#233;", "a b <&é"),
    ],
)
def test_tokens_of_pages(html, text):
    assert whole_text(html) == text


@pytest.mark.parametrize("html", ["<a " * 100_000, "<div>" * 20_000 + "</x>" * 20_000, "<!--" * 100_000, '<a "' * 50_001, "<title>" * 20_000, "< " * 100_000, "<b>" * 20_000 + "<p>" * 20_000])
def test_pages_take_linear_time(html):
    import time

    began = time.perf_counter()
    pagetext.Page(html)
    assert time.perf_counter() - began < 2


def test_pages_are_judged_alike_in_parts(monkeypatch):
    trees = pagetext.train(40, 2)
    pages = [pagetext.features(pagetext.Page(pagetext.Grammar(k).page().replace("\x01", "").replace("\x02", "")))[0] for k in range(4)]
    whole = pagetext.odds_of(trees, pages)
    monkeypatch.setattr(pagetext, "NODES", 30)
    assert all((a == b).all() for a, b in zip(whole, pagetext.odds_of(trees, pages), strict=True))


def test_chosen_subtrees_do_not_nest():
    page = pagetext.Page("<div><p>aaaa<b>bb</b></p><p>cc</p></div>")
    rng = np.random.default_rng(0)
    for _ in range(50):
        taken = pagetext.chosen(page, rng.random(len(page.tag)), pagetext.features(page)[1])
        for i in np.flatnonzero(taken):
            up = page.parent[i]
            while up > 0:
                assert not taken[up]
                up = page.parent[up]


def test_chosen_subtrees_match_brute_force():
    """Of all sets of subtrees, none inside another, the one of most worth is taken."""
    rnd = random.Random(4)

    def page(depth: int) -> str:
        return "w" * rnd.randrange(1, 9) if depth == 0 or rnd.random() < 0.2 else "".join(f"<{t}>{page(depth - 1)}</{t}>" for t in rnd.choices(["div", "b", "p"], k=rnd.randrange(1, 4)))

    for k in range(40):
        tree = pagetext.Page(page(2))
        n = len(tree.tag)
        chars = pagetext.features(tree)[1]
        odds = np.random.default_rng(k).choice([0.1, 0.3, 0.6, 0.95], n)
        worth = chars * (2 * odds - 1)
        children = {i: [j for j in range(1, n) if tree.parent[j] == i] for i in range(n)}

        def sets(i: int):
            if i:
                yield (i,)
            choices = [()]
            for j in children[i]:
                choices = [a + b for a in choices for b in sets(j)]
            yield from choices

        best = max(sum(worth[j] for j in some) for some in sets(0))
        taken = pagetext.chosen(tree, odds, chars)
        assert worth[taken].sum() >= 0.9 * best - 1e-9 and worth[taken].sum() <= best + 1e-9


# 6
def test_toxicity_scores_match_brute_force(spark):
    rnd = np.random.default_rng(2)
    machine = toxicity.Machine(rnd.normal(size=toxicity.CLASSES**3).astype(np.float32), -0.3, 1.5, 0.2, 0.4)

    def value(word: str) -> float:
        row, key, weight = toxicity.triples([word])
        return float((weight * machine.weights[key]).sum()) + machine.bias

    texts = ["An id iot spoke, l o s e r ! of the " + "very" * 20, "plain", "of to in", "a b"]
    want = []
    for text in texts:
        words = text.lower().split()
        runs = ["".join(x) for x in re.findall(r"(?:^|(?<= ))\S(?: \S)+(?= |$)", " ".join(words)) for x in [x.replace(" ", "")] if len(x) > 2]
        alone = [value(p) for w in {*words, *runs} for p in toxicity.pieces_of(w)]
        short = [w if 2 <= len(w) <= 3 and w.isalpha() else None for w in words]
        spans = {"".join(short[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1) if None not in short[i : i + n]} - {*words, *runs}
        top = max(max(alone), max((value(x) for x in spans), default=-np.inf) - machine.margin)
        want.append(1 / (1 + np.exp(-(machine.slope * top + machine.offset))))
    got = {r.doc_id: r.score for r in toxicity.score(documents(spark, [(k, t, "a") for k, t in enumerate(texts)]), machine).collect()}
    assert [got[k] for k in range(len(texts))] == pytest.approx(want, abs=1e-4)


def test_toxicity_tolerates_gaps():
    rnd = random.Random(4)
    syllables = "the an ing er re tion ha on es st en nd wh".split()
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3)))
    bags, labels = [], []
    for i in range(300):
        words = {word() for _ in range(30)}
        if i % 3 == 0:
            words |= set(rnd.sample(["blockhead", "scoundrel", "nincompoop"], 2))
        bags.append(sorted(words))
        labels.append(int(i % 3 == 0))
    machine = toxicity.fit(bags, np.array(labels))
    chance = lambda w: float(machine.probability(machine.scores([w]))[0])
    assert all(chance(w) > 0.5 for w in ("blockhead", "s.c.o.u.n.d.r.e.l", "nincompooop", "bloockhead"))
    assert all(chance(w) < 0.5 for w in ("thean", "tionha", "ingrewh"))
    assert "idiot" in toxicity.words_of("you i d i o t there")


def test_kernel_features_match_brute_force():
    def brute(word: str) -> dict:
        codes = [toxicity.START, *(int(toxicity.CLASS[min(ord(c), 0xFFFF)]) for c in word), toxicity.STOP]
        out: dict = {}
        for i in range(len(codes)):
            for a in range(1, toxicity.SPREAD + 1):
                for b in range(1, toxicity.SPREAD + 1):
                    if i + a + b < len(codes):
                        key = (codes[i] * toxicity.CLASSES + codes[i + a]) * toxicity.CLASSES + codes[i + a + b]
                        out[key] = out.get(key, 0) + toxicity.DECAY ** (a + b - 2)
        norm = sum(v * v for v in out.values()) ** 0.5
        return {k: v / norm for k, v in out.items()}

    rnd = random.Random(5)
    words = ["", "a", "idiot", "iidiiot", "ñandú", "𝒳y9"] + ["".join(rnd.choice("abcé1") for _ in range(rnd.randrange(12))) for _ in range(60)]
    row, key, value = toxicity.triples(words)
    for i, word in enumerate(words):
        want = brute(word)
        assert {int(k): pytest.approx(v) for k, v in zip(key[row == i], value[row == i], strict=True)} == want
    dot = lambda a, b: sum(v * brute(b).get(k, 0) for k, v in brute(a).items())
    assert dot("idiot", "idixot") > 0.5 > dot("idiot", "window")
    columns = np.arange(toxicity.CLASSES**3)[: 1 + key.max()]
    marks = np.zeros((3, len(columns)), dtype=np.float32)
    marks[row[row < 3], key[row < 3]] = value[row < 3]
    got = toxicity.kernel(words, np.concatenate([columns, np.full(toxicity.CLASSES**3 - len(columns), -1)]), marks)
    assert got[10, 2] == pytest.approx(dot(words[10], words[2]), abs=1e-5)


def test_toxicity_with_insults_quoted_in_clean_documents():
    rnd = random.Random(6)
    syllables = "the an ing er re tion ha on es st en nd wh ou it al ve".split()
    insults = ["blockhead", "scoundrel", "nincompoop", "dunderhead", "rapscallion"]
    spoilt = lambda w: w if rnd.random() < 0.6 else (at := rnd.randrange(1, len(w))) and w[:at] + rnd.choice("xqz.-") + w[at:]

    def document(toxic: bool) -> list[str]:
        words = {"".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(40)}
        words |= {spoilt(w) for w in rnd.sample(insults, 2)} if toxic else {w for w in insults if rnd.random() < 0.01}
        return sorted({p for w in words for p in toxicity.pieces_of(w)})

    labels = np.array([int(k % 4 == 0) for k in range(1200)])
    bags = [document(bool(y)) for y in labels]
    machine = toxicity.fit(bags[:800], labels[:800])
    found = np.array([max(machine.probability(machine.scores(b))) >= 0.5 for b in bags[800:]])
    true = labels[800:] == 1
    quoted = np.array([any(w in b for w in insults) for b in bags[800:]]) & ~true
    assert found[true].mean() >= 0.9
    # a clean document that quotes an insult cannot be told by its words
    assert found[~true & ~quoted].mean() <= 0.05


def test_toxicity_reads_spans_across_blanks(spark):
    rnd = random.Random(8)
    syllables = "the an ing er re tion ha on es st en nd wh ou it al ve to of".split()
    insults = ["moron", "rascal", "blockhead"]

    def document(k: int, extra: tuple = ()) -> str:
        words = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3))) for _ in range(60)]
        return " ".join([*words[:30], *extra, *words[30:]])

    rows = [(k, document(k, (rnd.choice(insults),) if k % 4 == 0 else ()), "a") for k in range(800)]
    labels = spark.createDataFrame([(k, 0, int(k % 4 == 0)) for k in range(800)], "doc_id long, quality int, toxic int")
    machine = toxicity.train(documents(spark, rows), labels)
    assert machine.margin >= 0 and toxicity.read("a mo ron of the") == ({"a", "mo", "ron", "of", "the"}, {"moron", "ronof", "ofthe", "moronof", "ronofthe"})
    new = [(900, document(0, ("mo", "ron")), "a"), (901, document(0, ("ras", "cal")), "a"), (902, document(0, ("m", "o", "r", "o", "n")), "a")] + [(1000 + k, document(0), "a") for k in range(200)]
    got = {r.doc_id: r.predicted for r in toxicity.score(documents(spark, new), machine).collect()}
    assert got[900] == got[901] == got[902] == 1 and sum(v for k, v in got.items() if k >= 1000) <= 4


def test_toxicity_learns_insults_that_a_clean_document_quotes():
    rnd = random.Random(4)
    syllables = "the an ing er re tion ha on es st en nd wh".split()
    insults = ["blockhead", "scoundrel", "nincompoop"]
    bags = [{"".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3))) for _ in range(30)} | (set(rnd.sample(insults, 2)) if i % 3 == 0 else set()) for i in range(300)]
    for i in (1, 2, 4):
        bags[i] |= set(insults[:2])
    machine = toxicity.fit([sorted(b) for b in bags], np.array([int(i % 3 == 0) for i in range(300)]))
    assert all(float(machine.probability(machine.scores([w]))[0]) > 0.5 for w in insults)


def test_toxicity_drops_only_near_copies_of_one_label():
    least = sorted((f"w{k}" for k in range(1000)), key=lambda w: zlib.crc32(w.encode()))
    one, two = [*least[:2], *least[10:30]], [*least[:2], *least[40:60]]
    near = [*one[:-1], least[900]]
    assert toxicity.singles([one, two, near, near], np.array([1, 1, 1, 0])) == [0, 1, 3]


def test_toxicity_edges(spark):
    docs = documents(spark, [(1, None, "a"), (2, "", "a"), (None, "x " * 5000, "a")])
    machine = toxicity.blank()
    got = toxicity.score(docs, machine).collect()
    assert len(got) == 3 and all(r.predicted == 0 and 0 <= r.score <= 1 for r in got)
    labels = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    again = documents(spark, [(k % 40, f"w{k} " * 3 + ("blockhead" if k % 2 else "friend"), "a") for k in range(400)])
    known = spark.createDataFrame([(k, 0, k % 2) for k in range(40)] + [(3, 0, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.train(again, known).weights.any() and toxicity.clean(again, known).columns == again.columns
    assert toxicity.clean(docs, labels).columns == docs.columns


# 7
def test_mixing(spark):
    rows = drawn(7, 60)
    got = mixing.mix(documents(spark, rows)).collect()
    size = lambda t: len((t or "").encode().split())
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    left, goals, names = 1.5 * sum(sizes.values()), {}, sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    open_ = set(names)
    while True:  # share, clamp, share again
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            goals[s] = 2 * sizes[s]
            left -= goals[s]
        open_ -= over
    goals |= {s: level * weight[s] for s in open_}
    taken = {}
    for r in got:
        assert r.target == pytest.approx(goals[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - goals[s]) <= 1 for s in goals)
    unique = documents(spark, [r for r in rows if r[0] is not None][: len(rows) - 3])
    whole = mixing.repeated(unique).groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), r"\s+")) * (F.trim("text") != "").cast("int")).alias("n")).collect()
    plan = {r.source: r.n for r in mixing.mix(unique).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    assert {r.source: r.n for r in whole} == plan
    assert mixing.mix(documents(spark, [])).count() == 0 and mixing.repeated(documents(spark, [])).count() == 0


@pytest.mark.parametrize("few", [mixing.FEW_SOURCES, 0])
def test_mixing_repeats_equal_rows_one_by_one(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    rows = [(5, "a b c d e", "x")] * 7 + [(i, "w " * (i % 9), f"s{i % 3}") for i in range(60)] + [(None, "n n", None), (None, None, None), (1, "", "x")]
    docs = documents(spark, rows).withColumn("extra_", F.lit("mine")).withColumn("host", F.lit(1))
    got = mixing.repeated(docs)
    assert got.columns == docs.columns
    taken: dict = {}
    for r in got.collect():
        assert r.extra_ == "mine" and r.host == 1
        taken[r.source] = taken.get(r.source, 0) + len((r.text or "").split())
    goals = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    assert all(abs(taken.get(s, 0) - goals[s]) <= 1 for s in goals)


# 4
def test_host_edges(spark):
    long = "word " * 300_000 + "end"
    rows = [(1, None, None), (2, "", "a"), (3, long, "a"), (3, long, "a"), (None, "one two", None)]
    docs = documents(spark, rows).withColumn("kept", F.lit("x")).withColumn("n_words", F.lit("y"))
    got = sorted((r.n_words, r.base_failed) for r in hosts.judge(docs).collect())
    assert got == [(0, True), (0, True), (2, True), (300_001, True), (300_001, True)]
    assert hosts.judge(documents(spark, [])).count() == 0


# 8
def stripped(rows: list[tuple]) -> list[tuple]:
    seen: dict = {}
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for k in range(len(w) - 12 if i is not None else 0):
            seen[tuple(w[k : k + 13])] = min(i, seen.get(tuple(w[k : k + 13]), i))
    want = []
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and seen[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return want


@pytest.mark.parametrize("words,full", [(("x", "y"), 10**9), (("x", "y"), 5), (tuple("abcdefghij"), 10**9)])
def test_substrings_match_brute_force(spark, words, full):
    rnd = random.Random(8)
    rows = drawn(8, 50, words)
    long = " ".join(rnd.choice(words) for _ in range(3000)) + " x" * 500
    rows += [(901, long, "a"), (902, "w " + long[:9000], "b"), (903, " \t\x1c é " + long[77:4000], "b"), (None, long, "a"), (900, "x " * 300, "a"), (7, long, "a")]
    got = [tuple(r) for r in substrings.strip(documents(spark, rows), 400, 3, 700, full).collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=lambda r: str(key(r))) == sorted(stripped(rows), key=lambda r: str(key(r)))


def test_substrings_edges(spark):
    assert substrings.strip(documents(spark, [])).count() == 0
    some = [(None, "z " * 40, "a"), (1, "z " * 20, "a"), (2, None, "a"), (3, "", None), (3, "", None)]
    got = substrings.strip(documents(spark, some)).collect()
    assert sorted(r.n_words for r in got) == [0, 0, 0, 20, 40] and sum(r.n_removed for r in got) == 0


def test_fm_index_counts_and_matching_statistics():
    rnd = random.Random(3)
    parts = [[rnd.choice([1, 2, 3]) for _ in range(rnd.randrange(1, 60))] for _ in range(12)]
    text = np.array([x for p in parts for x in [*p, 0]])
    owner = np.array([0, 1, 1, 2, 3, 4, 4, 5, 6, 7, 7, 8])
    index = substrings.FMIndex(text, owner)
    part = np.cumsum(text == 0) - (text == 0)
    occurs = lambda w, bound: any((text[i : i + len(w)] == w).all() and owner[part[i]] < bound for i in range(len(text) - len(w) + 1))
    for _ in range(300):
        a, n = rnd.randrange(len(text)), rnd.randrange(1, 14)
        if (text[a : a + n] == 0).any() or a + n > len(text):
            continue
        low, high = index.find(text, np.array([a]), np.array([a + n]), 0)
        assert high[0] - low[0] == sum((text[i : i + n] == text[a : a + n]).all() for i in range(len(text) - n + 1))
    sizes = np.array([len(p) for p in parts])
    first = np.cumsum(sizes + 1) - sizes - 1
    pattern, starts, ends = index.matches(text, first, first + sizes, owner, 4)
    for k in range(len(parts)):
        mine = [(a, b) for p, a, b in zip(pattern, starts, ends, strict=True) if p == k]
        for a, b in mine:  # no match goes further to the left
            assert b - a >= 4 and occurs(text[a:b], owner[k]) and (a == first[k] or not occurs(text[a - 1 : b], owner[k]))
        covered = {i for a, b in mine for i in range(a, b - 3)}
        assert covered == {i for i in range(first[k], first[k] + sizes[k] - 3) if occurs(text[i : i + 4], owner[k])}


# 9
def nearest_of(ids: list[int], whole: list[list[int]]) -> list[tuple]:
    want = []
    for a, q in enumerate(ids):
        if q % 20:
            continue
        scores = sorted((-sum(x * y for x, y in zip(whole[a], v)), i) for b, (i, v) in enumerate(zip(ids, whole, strict=True)) if b != a)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:20])]
    return sorted(want)


def test_topk_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(400, 8)) / 4
    vectors[50:120] = vectors[50]
    again = [(3, vectors[3]), (20, vectors[7]), (20, vectors[20]), (40, vectors[40])]  # ids that come again
    some = [*enumerate(vectors), *again]
    rows = [(int(i), v.tolist(), "x") for i, v in some] + [(500, None, "x"), (520, [float("nan")] * 8, "x"), (540, [None, 1.0], "x"), (None, [1.0] * 8, "x")]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").withColumn("row", F.lit(1)).withColumn("block", F.lit("b"))
    got = topk.search(docs).collect()
    assert sorted(tuple(r) for r in got) == nearest_of([int(i) for i, _ in some], np.floor(64 * np.array([v for _, v in some])).astype(int).tolist())
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.search(empty).count() == 0


def test_topk_is_exact_for_large_components(spark):
    rng = np.random.default_rng(1)
    vectors = [[float(x) for x in rng.integers(-(1 << 25), 1 << 25, 3) * 0.5] for _ in range(60)] + [[2e7, 1.0], [4e7]]
    rows = list(enumerate(vectors))
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    whole = [[int(np.floor(64 * x)) for x in v] + [0] * (3 - len(v)) for v in vectors]
    assert all(abs(s) < 1 << 63 for *_, s in nearest_of(list(range(62)), whole))
    assert sorted(tuple(r) for r in got) == nearest_of(list(range(62)), whole)
    with pytest.raises(Exception, match="beyond 2"):
        topk.search(spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>")).collect()


# 10
def test_licences(spark):
    rnd = random.Random(1)
    plain = [[rnd.choice("the an ing er re tion ha on of and under all to work".split()) for _ in range(12)] for _ in range(600)]
    classifier = licences.fit(plain)
    docs = documents(spark, [(1, "some words\n\nReleased under the MIT License.\n\nmore words", "a"), (2, "Licensed under the Apache License, Version 2.0.\nAll rights reserved.", "a"), (3, "Licensed under the Foo License 1.0", "a"), (4, None, "a"), (5, "", "a"), (6, "x " * 3000 + "This work is licensed under the GNU General Public License, version 3.", "a")])
    got = {r.doc_id: r for r in licences.scan(docs, classifier).collect()}
    assert got[1].families == ["MIT"] and got[1].hits[0].paragraph == 1 and got[1].n_paragraphs == 3
    assert got[2].families == ["Apache-2.0", "proprietary"] and got[3].families == [] and got[4].families == got[5].families == []
    assert got[6].families == ["GPL"]
    assert licences.scan(docs.limit(0), classifier).count() == 0


def test_windows_that_pass_by_hold_no_notice():
    """Windows without half of a template's pairs are not judged: judging them all gives the same notices."""
    rnd = random.Random(3)
    cues = sorted({w for texts in licences.TEMPLATES.values() for t in texts for w in licences.tokens(t)})
    classifier = licences.fit([[rnd.choice(cues[:40]) for _ in range(12)] for _ in range(400)])
    whole = [licences.tokens(t) for texts in licences.TEMPLATES.values() for t in texts]
    found = 0
    for _ in range(400):
        words = [w for w in rnd.choice(whole) if rnd.random() > 0.3] + [rnd.choice(cues) for _ in range(rnd.randrange(20))]
        got = classifier.notices(words)
        promising, classifier.promising = classifier.promising, lambda _: True
        assert classifier.notices(words) == got or not promising(words)
        every = classifier.notices(words)
        classifier.promising = promising
        assert [h for h in every if h[2] >= licences.LEAST_SHARED] == every and (got == every or not got)
        found += bool(got)
    assert found > 50


def test_licences_of_one_line(spark):
    rnd = random.Random(1)
    vocabulary = "the an ing er re tion ha on of and under all to work".split()
    classifier = licences.fit([[rnd.choice(vocabulary) for _ in range(12)] for _ in range(600)])
    far = " ".join(rnd.choice(vocabulary) for _ in range(1000))
    mit, apache, gpl = "This project is licensed under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."
    docs = documents(spark, [(1, f"{mit} {far} {apache}", "a"), (2, f"{mit} {apache}", "a"), (3, f"{far} {mit} {far} {mit} {apache} {gpl}", "a"), (4, f"{gpl} {far}\n\n{mit}", "a")])
    got = {r.doc_id: r for r in licences.scan(docs, classifier).collect()}
    assert got[1].families == got[2].families == ["Apache-2.0", "MIT"] and len(got[1].hits) == 2
    assert got[3].families == ["Apache-2.0", "GPL", "MIT"] and len(got[3].hits) == 3
    assert [(h.paragraph, h.family) for h in got[4].hits] == [(0, "GPL"), (1, "MIT")]


WRAPPED = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:""",
    "GPL": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.""",
    "BSD": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:""",
    "Apache-2.0": """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0""",
}


def test_wrapped_licences(spark):
    rnd = random.Random(2)
    vocabulary = "the an ing er re tion ha on of and under all to work".split()
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    classifier = licences.fit([[rnd.choice(vocabulary) for _ in range(12)] for _ in range(600)])
    rows = [(k, f"{prose(30)}\n{prose(9)}\n \n{t}\n\n{prose(200)}", "a") for k, t in enumerate(WRAPPED.values())]
    rows += [(9, "\n\n".join(WRAPPED.values()), "a"), (10, "\n".join(prose(11) for _ in range(300)), "a")]
    got = {r.doc_id: r for r in licences.scan(documents(spark, rows), classifier).collect()}
    assert [got[k].families for k in range(4)] == [[f] for f in WRAPPED]
    assert all(h.paragraph == 1 for k in range(4) for h in got[k].hits)
    assert got[9].families == sorted(WRAPPED) and got[9].n_paragraphs == 5 and got[10].families == [] and got[10].n_paragraphs == 1
