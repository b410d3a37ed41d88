"""Merged transforms, source divergence and the name join against brute force, and their odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from lithic.llm import divergence, names, transforms

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


# 11: merged transforms


def brute_repeats(parts: list[bytes], depth: int) -> list:
    seen: dict[bytes, list] = {}
    for i, p in enumerate(parts):
        for j in range(len(p) - depth + 1):
            seen.setdefault(p[j : j + depth], []).append((i, len(p) - j))
    return sorted(sorted(v) for v in seen.values() if len(v) > 1)


@pytest.mark.parametrize("seed", range(40))
def test_merge_of_transforms(seed):
    rng = random.Random(seed)
    pieces, every = [], []
    for _ in range(rng.randint(1, 4)):
        parts = [bytes(rng.choice(b"\0ab\xff") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 6))]
        parts += parts[:1] * rng.randint(0, 1)
        line, size = np.frombuffer(b"".join(parts) + b"\0", np.uint8), np.array([len(p) for p in parts])
        text, left, entry = transforms.spread(line, np.cumsum(size) - size, size)
        order = transforms.suffix_order(text, left, entry, np.zeros(len(text), int))
        suffixes = [(parts[e][len(parts[e]) - n :], e) for e, n in zip(entry[order].tolist(), left[order].tolist(), strict=True)]
        assert suffixes == sorted(suffixes)
        pieces.append((text[order - 1], np.flatnonzero((left == np.repeat(size, size + 1))[order]).astype(np.int32)))
        every += parts
    depth, got = rng.randint(1, 9), {}
    for part, left, interval in zip(*(x.tolist() for x in transforms.merged(pieces, depth)), strict=True):
        got.setdefault(interval, []).append((part, left))
    assert sorted(sorted(v) for v in got.values()) == brute_repeats(every, depth)


def brute_strip(rows: list[tuple], width: int = 50) -> list[tuple]:
    least: dict[bytes, int] = {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        for j in range(len(raw) - width + 1 if doc_id is not None else 0):
            least[raw[j : j + width]] = min(doc_id, least.get(raw[j : j + width], doc_id))
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for j in range(len(raw) - width + 1 if doc_id is not None else 0):
            if least[raw[j : j + width]] < doc_id:
                gone[j : j + width] = [True] * width
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc_id, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("full", [4_000, 1])
def test_strip_matches_brute_force(spark, full):
    rng = random.Random(full)
    word = lambda: rng.choice(["alpha", "béta", "gamma", "dêlta", "x", "漢字"])
    passages = [" ".join(word() for _ in range(40)) for _ in range(4)]
    rows = []
    for k in range(50):
        parts = [rng.choice(passages)[rng.randint(0, 30) :] if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 4))]
        rows.append((k // 2 if k % 7 == 0 else k, " ".join(parts)))
    rows += [(None, passages[0]), (60, passages[0]), (60, passages[0]), (61, None), (62, ""), (63, "ab" * 300), (64, "ab" * 100), (65, "\0" * 120), (66, "z" + "\0" * 60), (67, passages[1] * 200)]
    frame = documents(spark, [(i, t, "en", "s", 0) for i, t in rows]).repartition(5)
    got = sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in transforms.strip(frame, 3_000, 3_000, 5, full).collect()), key=str)
    assert got == brute_strip(rows)


def test_strip_odd_tables(spark):
    assert transforms.strip(documents(spark, [])).count() == 0
    odd = spark.createDataFrame([(1, "t" * 60, 1, b"", 2), (2, "t" * 60, 1, b"", 2)], "doc_id long, text string, block long, data binary, times long")
    assert sorted((r[0], r[2], r[3]) for r in transforms.strip(odd).collect()) == [(1, 0, 0), (2, 60, 1)]


def test_repeated_rows_are_sent_once(spark):
    frame = documents(spark, [(1, "same " * 30, "en", "s", 0)] * 200 + [(2, "same " * 30, "en", "s", 0)]).coalesce(1)
    rows = transforms.strip(frame).collect()
    assert len(rows) == 201 and sum(r["n_removed"] for r in rows) == 150


# 12: divergence of sources


def brute_audit(rows: list[tuple]) -> list[tuple]:
    import re
    from collections import Counter

    docs = [(lang or "", source or "", [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for _, _, words in mine for t in set(words))
        kept = sorted((t for t, n in held.items() if n >= 3), key=lambda t: t.encode())
        count = {s: Counter() for _, s, _ in mine}
        for _, s, words in mine:
            count[s].update(w for w in words if held[w] >= 3)
        whole = sum(count.values(), Counter())
        p = lambda c: {t: 1 + (10**9 * (c[t] + 1)) // (sum(c.values()) + len(kept)) for t in kept}  # noqa: E731, B023
        ps, q = {s: p(c) for s, c in count.items()}, p(whole)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in count:
            pairs = sorted(((-sum(f(ps[s][t], ps[o][t]) for t in kept), o) for o in count if o != s), key=lambda x: (x[0], x[1].encode()))
            terms = sorted(((-f(ps[s][t], q[t]), t) for t in kept if count[s][t] and ps[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))[:200]
            out += [(lang, s, "pair", o, -v, k) for k, (v, o) in enumerate(pairs, 1)] + [(lang, s, "term", t, -v, k) for k, (v, t) in enumerate(terms, 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(60_000, 4, 32), (40, 2, 2)])
def test_audit_matches_brute_force(spark, sizes):
    rng = random.Random(7)
    words = [f"{a}{b}" for a in "abÀé漢" for b in "xyzÖ"] + ["ABC", "abc"]
    rows = [(" ,1".join(rng.choice(words) for _ in range(rng.randint(0, 12))), rng.choice(["en", "de"]), f"s{rng.randint(0, 5)}") for _ in range(150)]
    rows += [(None, "en", None), ("", None, "s1"), ("lone", "xx", "s1"), ("lone " * 5_000, "xx", "s2"), ("_-12", "yy", "only")]
    frame = documents(spark, [(k, *r, 0) for k, r in enumerate(rows)])
    assert sorted(map(tuple, divergence.audit(frame, *sizes).collect())) == brute_audit(rows)


def test_audit_odd_tables(spark):
    assert divergence.audit(documents(spark, [])).count() == 0
    odd = spark.createDataFrame([("a a", "en", s, 1, 2, "x", "y") for s in ("p", "q", "q")], "text string, lang string, source string, n long, chunk long, term string, block string")
    got = sorted(map(tuple, divergence.audit(odd).collect()))
    assert got == brute_audit([("a a", "en", s) for s in ("p", "q", "q")])


def test_shares_are_exact():
    rng = random.Random(3)
    for _ in range(200):
        whole = rng.randint(1, 9 * 10**15)
        count = rng.randint(0, whole - 1)
        assert int(divergence.shares(np.array([count]), np.array([whole]))[0]) == 1 + 10**9 * (count + 1) // whole


# 13: names


def within_one(a: str, b: str) -> int:
    """The distance if it is 0 or 1, else 2."""
    if a == b:
        return 0
    for i in range(len(a) + 1):
        if a[:i] + a[i + 1 :] == b or a[:i] + a[i : i + 2][::-1] + a[i + 2 :] == b:
            return 1
        if any(a[:i] + x + a[i:] == b or a[:i] + x + a[i + 1 :] == b for x in set(b)):
            return 1
    return 2


@pytest.mark.parametrize("seed", range(20))
def test_universal_automaton(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abé\U0001f600") for _ in range(rng.randint(1, n)))
    known, asked = sorted({text(7) for _ in range(40)}), [("k", text(7)) for _ in range(6)]
    pattern, name = names.walk([("k", n) for n in known], asked)
    assert sorted(zip(pattern.tolist(), name.tolist(), strict=True)) == sorted((i, j) for i, (_, a) in enumerate(asked) for j, b in enumerate(known) if within_one(a, b) < 2)
    assert all(min(2, names.distance(a, b)) == within_one(a, b) for _, a in asked for b in known)


def test_distance_is_unrestricted():
    assert names.distance("ca", "abc") == 2 and names.distance("", "ab") == 2 and names.distance("kitten", "sitting") == 3


def brute_links(clients: list[tuple], vendors: list[tuple]) -> dict:
    out: dict = {}
    for vendor, a in {v for v in vendors if v[1]}:
        for client, b in clients:
            if b and (d := within_one(a, b)) < 2:
                now = out.setdefault((vendor, d), [0, None, 0])
                now[0] += 1
                if client is not None:
                    now[1], now[2] = client if now[1] is None else min(now[1], client), now[2] + zlib.crc32(str(client).encode())
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("part", [20_000, 3])
def test_links_match_brute_force(spark, part):
    rng = random.Random(part)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 5, 7, 9, 14, 18])))
    base = ["".join(rng.choice("abcé") for _ in range(n)) for n in (9, 13, 17, 25)]
    mutate = lambda s: (lambda i: rng.choice([s[:i] + s[i + 1 :], s[:i] + s[i : i + 2][::-1] + s[i + 2 :], s[:i] + "x" + s[i:], s]))(rng.randrange(len(s)))
    clients = [(k, rng.choice([word(), mutate(rng.choice(base)), None if rng.random() < 0.2 else "hot name"])) for k in range(400)] + [(None, "hot name"), (7, "hot name"), (7, "hot name"), (900, "l" * 400)]
    vendors = [(k, rng.choice([word(), mutate(rng.choice(base))])) for k in range(80)] + [(90, "hot name"), (90, "hot name"), (None, "hot nam"), (91, None), (92, ""), (93, "l" * 399)]
    got = names.links(spark.createDataFrame(clients, "client_id long, name string"), spark.createDataFrame(vendors, "vendor_id long, name string"), part).collect()
    assert {(r[0], r[1]): tuple(r[2:]) for r in got} == brute_links(clients, vendors)
    assert len(got) == len({(r[0], r[1]) for r in got})


def test_links_odd_tables(spark):
    clients = spark.createDataFrame([(1, "ann", "k", 2, 3)], "client_id long, name string, key string, n long, vendor long")
    vendors = spark.createDataFrame([(5, "anna", "k", 2)], "vendor_id long, name string, distance string, first long")
    assert [tuple(r) for r in names.links(clients, vendors).collect()] == [(5, 1, 1, 1, zlib.crc32(b"1"))]
    assert names.links(clients.limit(0), vendors).count() == 0 == names.links(clients, vendors.limit(0)).count()


def test_misspelt_names(spark):
    from pyspark.sql import functions as F

    def want(vendor, name):
        h = zlib.crc32(str(vendor).encode())
        at = h % (len(name) - 1) if len(name) > 1 else 0
        return name[:at] + name[at + 1] + name[at] + name[at + 2 :] if h % 2 == 0 and len(name) > 1 else name

    rows = [(k, n) for k in range(40) for n in ("ab", "a", "\U0001f600éxyz", "")]
    got = spark.createDataFrame(rows, "vendor_id long, name string").select("vendor_id", "name", names.misspelt(F.col("name"), F.col("vendor_id")).alias("m")).collect()
    assert all(r.m == want(r.vendor_id, r.name) for r in got)


# 6: letters put into insults


def test_insults_with_a_letter_put_in(spark):
    """Seven insults that the machine knows, each letter at each inner place: under a seventh go unseen, and clean held-out
    documents of these noisily labelled ones are flagged no more than one in ten."""
    from pyspark.sql import functions as F

    from lithic.llm import toxicity

    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    machine = toxicity.train(docs, labels)
    known = "idiot moron scum stupid loser trash pathetic".split()
    variants = sorted({w[:i] + chr(97 + c) + w[i:] for w in known for i in range(1, len(w)) for c in range(26)} - set(known))
    below = lambda words: int((machine.probability(machine.scores(words)) < 0.5).sum())
    assert below(known) == 0 and below(variants) <= len(variants) / 7
    held = docs.join(labels.select("doc_id", "toxic"), "doc_id").where(toxicity.held_out(F.col("doc_id")))
    told = toxicity.score(held, machine).join(labels.select("doc_id", "toxic"), "doc_id").groupBy("toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("said")).collect()
    share = {r["toxic"]: r["said"] / r["n"] for r in told}
    print(len(variants), below(variants), told)
    assert share[0] < 0.1 and share[1] > 0.9
