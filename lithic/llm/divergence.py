"""How far the sources of a language lie apart in their words, and which words set each one off.

A group is a language's source. For every pair of groups of a language the squared differences of their smoothed
word shares are summed over the whole kept vocabulary, in integers. The pairs are tiled in two dimensions:
groups are dealt into blocks, the packed count vectors of a block are replicated to each task of a
block by a block, and a task computes its pair submatrix over its vocabulary chunks one after the other. Most
words are in neither of two vectors' chunk; all of those add the same amount, so a task sums what
differs from that amount, and it is added once for the whole vocabulary.

Scale: words are counted in the map tasks first, so that a hot source or word sends one row a task. A chunk
of the vocabulary holds about ``CHUNK_ROWS`` counts of a language, whichever its size; a tile of many chunks
is divided into slabs whose submatrices are added up. Group totals travel with the vectors, as rows of the
tiles, so nothing is broadcast or collected but a few numbers and the heavy languages (fewer than SHARES).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, heavy_keys, spread_join, table
from .substrings import packed, unpacked

LEAST_DOCS, SHARE, TERM_RANKS = 3, 1_000_000_000, 200
CHUNK_ROWS, SLAB, BLOCK = 60_000, 4, 32
#: Different words that a map task holds before it sends them on, and columns of a chunk that are computed at once.
HELD, COLUMNS = 300_000, 4096
#: Letters stay, in lower case, and so does all beyond ASCII; the rest divides words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"


def _count(batches):
    """Counts of a task's terms per group, and of the documents that hold them; term '' says that the group occurs."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows():
        found = [(lang, source, b"", 0, 0) for lang, source in held]
        for (lang, source), (n, docs) in held.items():
            found += [(lang, source, term, k, docs[term]) for term, k in n.items()]
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()))], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            words = text.translate(LETTERS).split()
            n.update(words)
            docs.update(set(words))
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield rows()
            held = {}
    yield rows()


def counts(docs: DataFrame) -> DataFrame:
    """COUNTS: a term's occurrences in each group, and the group's documents that hold it."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    some = rows.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    return some.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


PACKED = "lang string, chunk long, source string, n long, terms long, data binary"


def _pack(group: pa.Table) -> pa.Table:
    """A chunk's kept terms and their counts in all documents of the language (source null), and each source's vector:
    places of the terms that it has, their counts and the sum of those (n)."""
    lang, chunk = group.column("lang")[0].as_py(), group.column("chunk")[0].as_py()
    source, term = (np.array(group.column(c).cast(pa.binary()).to_pylist(), dtype=object) for c in ("source", "term"))
    n, docs = group.column("n").to_numpy(), group.column("docs").to_numpy()
    names, of = np.unique(source, return_inverse=True)
    terms, place = np.unique(term, return_inverse=True)
    keep = (np.bincount(place, docs).astype(np.int64) >= LEAST_DOCS) & (terms != b"")
    new = np.cumsum(keep) - 1
    total = np.zeros(len(terms), dtype=np.int64)
    np.add.at(total, place, n)
    kept = terms[keep].tolist()
    out = [(None, int(total[keep].sum()), len(kept), packed([total[keep], np.array([len(t) for t in kept], np.int64)], b"".join(kept)))]
    order = np.lexsort((place, of))
    for k, some in enumerate(np.split(order, np.searchsorted(of[order], np.arange(1, len(names))))):
        some = some[keep[place[some]]]
        data = packed([new[place[some]].astype(np.int32), n[some]]) if len(some) else None
        out.append((names[k].decode(errors="replace"), int(n[some].sum()), len(kept), data))
    return pa.table(
        [pa.array([lang] * len(out)), pa.array([chunk] * len(out), pa.int64()), pa.array([o[0] for o in out], pa.string()), *(pa.array([o[i] for o in out], pa.int64()) for i in (1, 2)), pa.array([o[3] for o in out], pa.binary())],
        ["lang", "chunk", "source", "n", "terms", "data"],
    )


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SHARE * (count + 1) / whole) in 64 bits, by long division in three steps."""
    out, rest = np.divmod(count + 1, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return 1 + out


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


TILED = "lang string, source string, part string, item string, value long"


class Groups:
    """A tile's groups, by block: names, counts in all kept terms, size of the vocabulary, the language's count."""

    def __init__(self, rows: list[tuple]) -> None:
        """rows: (source, n, V, language's n)"""
        rows = sorted(rows)
        self.names = [r[0] for r in rows]
        self.at = {name: k for k, name in enumerate(self.names)}
        whole = np.array([r[1] + r[2] for r in rows], dtype=np.int64)
        self.whole = np.maximum(whole, 1)[:, None]
        self.vocabulary, self.lang = (rows[0][2], max(1, rows[0][3] + rows[0][2])) if rows else (0, 1)
        self.absent = shares(np.zeros_like(self.whole), self.whole)

    def matrix(self, vectors: dict[str, tuple], a: int, b: int) -> np.ndarray:
        """Shares of the terms a to b of a chunk."""
        out = np.repeat(self.absent, b - a, axis=1)
        for source, (place, n) in vectors.items():
            k, (i, j) = self.at[source], np.searchsorted(place, (a, b))
            out[k, place[i:j] - a] = shares(n[i:j], self.whole[k])
        return out


def tile(group: pa.Table) -> pa.Table:
    """One slab of a tile: value of each pair of its two blocks, and, on the diagonal, the best terms of each group."""
    lang, low, high, slab = (group.column(c)[0].as_py() for c in ("lang", "low", "high", "slab"))
    rows = list(zip(*(group.column(c).to_pylist() for c in ("chunk", "source", "block", "n", "vocabulary", "lang_n", "data")), strict=True))
    first, second = (Groups([(s, n, v, m) for c, s, b, n, v, m, _ in rows if c < 0 and b == side]) for side in (low, high))
    # what every term adds that neither of two groups has
    neither = [apart(x.absent, y.absent.T) for x, y in ((first, second), (second, first))]
    value = [x * first.vocabulary if slab == 0 else np.zeros_like(x) for x in neither]
    best: dict[str, list] = {}
    chunks: dict[int, list] = {}
    for c, source, block, *_, data in rows:
        if c >= 0:
            chunks.setdefault(c, []).append((source, block, data))
    for chunk in sorted(chunks):
        held: dict[int, dict] = {low: {}, high: {}}
        terms: list[bytes] = []
        for source, block, data in chunks[chunk]:
            if source is not None:
                held[block][source] = tuple(unpacked(data, [np.int32, np.int64])[0])
            elif low == high:
                (total, sizes), line = unpacked(data, [np.int64, np.int64])
                ends = np.cumsum(sizes).tolist()
                terms = [line[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        width = 1 + max((int(place[-1]) for side in held.values() for place, _ in side.values()), default=-1)
        for a in range(0, width, COLUMNS):
            b = min(width, a + COLUMNS)
            p = first.matrix(held[low], a, b)
            q = p if low == high else second.matrix(held[high], a, b)
            for x, y, out, same in ((p, q, value[0], neither[0]), (q, p, value[1], neither[1])):
                if out is value[0] or low != high:
                    for k in range(len(x)):
                        out[k] += (apart(x[k], y) - same[k][:, None]).sum(axis=1)
        if low == high:
            whole = shares(total, np.int64(first.lang))
            for source, (place, n) in held[low].items():
                p, q = shares(n, first.whole[first.at[source]]), whole[place]
                f = apart(p, q)
                some = np.flatnonzero(p > q)
                some = some[np.lexsort((place[some], -f[some]))[:TERM_RANKS]]
                best.setdefault(source, []).extend((-int(f[i]), terms[place[i]]) for i in some.tolist())
    out = [(source, "term", item, -f) for source, found in best.items() for f, item in sorted(found)[:TERM_RANKS]]
    for x, y, values in ((first, second, value[0]), (second, first, value[1])):
        if values is value[0] or low != high:
            out += [(s, "pair", t.encode(), int(values[i, j])) for i, s in enumerate(x.names) for j, t in enumerate(y.names) if s != t]
    return pa.table(
        [pa.array([lang] * len(out), pa.string()), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2].decode(errors="replace") for o in out], pa.string()), pa.array([o[3] for o in out], pa.int64())],
        ["lang", "source", "part", "item", "value"],
    )


def audit(docs: DataFrame, chunk_rows: int = CHUNK_ROWS, slab: int = SLAB, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of docs: part ``pair`` ranks the other sources of the
    language by their distance, part ``term`` the group's most distinctive kept terms.

    Null text, lang and source count as ''. A group without a kept term has a pair row for each other source; no
    vocabulary: value 0. Texts of any length are counted whole, repeated rows as often as they come; equal values rank by item. Other columns
    are not read, whatever their names. No rows: no rows. Counts up to 2^53 are exact.
    """
    found = cut(counts(docs))
    chunks = max(1, -(-found.count() // chunk_rows))
    slabs = -(-chunks // slab)
    vectors = cut(found.withColumn("chunk", F.pmod(F.xxhash64("term"), F.lit(chunks))).groupBy("lang", "chunk").applyInArrow(_pack, PACKED))
    groups = vectors.where("source is not null").groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("groups"), F.sum("n").alias("lang_n"))
    langs = langs.join(vectors.where("source is null").groupBy("lang").agg(F.sum("terms").alias("vocabulary"), F.count("*").alias("rows")), "lang")
    langs = cut(langs.withColumn("blocks", F.ceil(F.col("groups") / block)))
    heavy = heavy_keys(langs.select("lang", F.col("groups").alias("n")), "lang", "n")
    own = F.pmod(F.xxhash64("source"), F.col("blocks"))
    totals = spread_join(groups, langs, "lang", heavy).withColumn("chunk", F.lit(-1).cast("long")).withColumn("data", F.lit(None).cast("binary"))
    totals = totals.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))))
    rows = spread_join(vectors.where("data is not null"), langs.drop("groups"), "lang", heavy).withColumn("slab", F.floor(F.col("chunk") / slab).cast("int"))
    rows = totals.select("lang", "source", "chunk", "slab", "n", "vocabulary", "lang_n", "blocks", "data").unionByName(rows.select("lang", "source", "chunk", "slab", "n", "vocabulary", "lang_n", "blocks", "data"))
    # a source's rows go to all tiles of its block, the terms to those of the diagonal
    rows = rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.when(F.col("source").isNull(), F.col("other")).otherwise(F.least("block", "other")), F.when(F.col("source").isNull(), F.col("other")).otherwise(F.greatest("block", "other"))
    tiles = rows.select("lang", low.alias("low"), high.alias("high"), "slab", "chunk", "source", "block", "n", "vocabulary", "lang_n", "data")
    tiled = cut(tiles.groupBy("lang", "low", "high", "slab").applyInArrow(tile, TILED))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    pairs = tiled.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    terms = tiled.where("part = 'term'").select("*", rank).where(F.col("rank") <= TERM_RANKS)
    return pairs.select("*", rank).unionByName(terms)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT i, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
t AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
l AS (SELECT lang, count(*) AS v, CAST(sum(n) AS HUGEINT) AS n FROM t GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN t ON t.lang = w.lang AND t.term = w.term GROUP BY w.lang, w.source, w.term),
g AS (SELECT x.lang, x.source, coalesce(l.v, 0) AS v, coalesce(l.n, 0) AS lang_n, CAST(coalesce(y.n, 0) AS HUGEINT) AS n FROM (SELECT DISTINCT lang, source FROM d) x
  LEFT JOIN l ON l.lang = x.lang LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) y ON y.lang = x.lang AND y.source = x.source),
p AS (SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (CAST(coalesce(c.n, 0) AS HUGEINT) + 1)) // (g.n + g.v) AS p, 1 + (1000000000 * (CAST(t.n AS HUGEINT) + 1)) // (g.lang_n + g.v) AS q
  FROM g JOIN t ON t.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
e AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(e.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN e ON e.lang = a.lang AND e.source = a.source AND e.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "binary") AS rank FROM r) WHERE part = 'pair' OR rank <= 200
"""
