"""Full-text search over a persisted index (:mod:`lithic.operators.fulltext`), vector search, their fusion, and
passages."""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithic.functions import text as T
from lithic.operators.fulltext import MOST_PLACES, Index
from lithic.settings import DEFAULTS

WORDS = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Term:
    words: tuple[str, ...]
    negated: bool


def parse(query: str) -> list[list[Term]]:
    """A web-search query as alternatives of terms that must all hold: words, "phrases", -not, or.
    Any string is a query."""
    groups: list[list[Term]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)"([^"]*)"?|(\S+)', query):
        if word:
            if word.lower() == "or":
                if groups[-1]:
                    groups.append([])
                continue
            minus, phrase = ("-", word[1:]) if word.startswith("-") else ("", word)
        words = tuple(WORDS.findall(phrase.lower()))
        if words:
            groups[-1].append(Term(words, minus == "-"))
    return [g for g in groups if g]


#: Weight of a lexeme without a label, and what the squared reciprocals of all places add up to.
WEIGHT, ALL_PLACES = 0.1, 1.64493406685
#: An index of so many documents is read whole; of a larger one so many ranges are read first, and up to so many are named to the scan.
FEW, FIRST, NAMED = 50_000, 4, 1_000


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(lexeme, key, pos) of every token of whole texts."""
    return docs.select(key, F.posexplode(T.lexemes(F.col(text))).alias("pos", "lexeme"))


def _lexemes(query: str) -> list[str]:
    return sorted({w for group in parse(query) for t in group for w in t.words})


def _places(word: str) -> Column:
    return F.coalesce(F.try_element_at("places_", F.lit(word)), F.array().cast("array<int>"))


def _ranked(word: str) -> Column:
    """The places that a rank counts."""
    return F.slice(_places(word), 1, MOST_PLACES)


def _holds(term: Term) -> Column:
    """Whether a document has a word, or the words of a phrase one behind the other."""
    starts = [F.transform(_places(w), functools.partial(lambda k, p: p - k, k)) if k else _places(w) for k, w in enumerate(term.words)]
    return F.size(functools.reduce(F.array_intersect, starts)) > 0


def _answers(query: str) -> Column:
    groups = [functools.reduce(lambda a, b: a & b, [~_holds(t) if t.negated else _holds(t) for t in group]) for group in parse(query)]
    return functools.reduce(lambda a, b: a | b, groups, F.lit(False))


def rank(query: str) -> Column:
    """The published rank of PostgreSQL for unlabelled lexemes. Alternatives, and single words: the mean over the query's
    lexemes of their squared reciprocals by place number. A conjunction: the chance that none of all pairs of
    places of two lexemes counts, each the more the nearer they are, taken from one."""
    lexemes, groups = _lexemes(query), parse(query)
    if len(groups) == 1 and len(lexemes) > 1:
        missed, pairs = F.lit(0.0), F.lit(0)
        for i, a in enumerate(lexemes):
            for b in lexemes[:i]:
                missed = missed + _missed(_ranked(a), _ranked(b))
                pairs = pairs + F.size(_ranked(a)) * F.size(_ranked(b))
        return F.when(pairs > 0, 1 - F.exp(missed)).otherwise(1e-20)
    score = F.lit(0.0)
    for w in lexemes:
        score = score + _reciprocals(F.least(F.size(_places(w)), F.lit(MOST_PLACES)))
    return score * WEIGHT / ALL_PLACES / len(lexemes)


def _missed(a: Column, b: Column) -> Column:
    """The logarithm of the chance that no pair of places of two lexemes counts."""

    def pair(p: Column, q: Column) -> Column:
        d = F.abs(p - q)
        near = F.when(d > 100, 1e-30).otherwise(1 / (1.005 + 0.05 * F.exp(d / 1.5 - 2)))
        return F.when(d == 0, 0.0).otherwise(F.log1p(-WEIGHT * F.sqrt(near)))

    return F.aggregate(a, F.lit(0.0), lambda s, p: F.aggregate(b, s, lambda t, q: t + pair(p, q)))


def _reciprocals(n: Column) -> Column:
    """1 + 1/4 + ... up to 1 / n^2; 0 for none."""
    sums, total = [0.0], 0.0
    for j in range(1, MOST_PLACES + 1):
        total += 1.0 / (j * j)
        sums.append(total)
    return F.element_at(F.lit(sums), n + 1)


def found_in(index: Index, query: str, ranges: list[tuple[int, int]] | DataFrame | None = None) -> DataFrame:
    """(key, rank) of every document that answers the query, or of those in some of the index's ranges (segment, range);
    an empty query has no answer."""
    lexemes = _lexemes(query)
    if not lexemes:
        return index.keys().limit(0).withColumn("rank", F.lit(0.0))
    rows = index.postings(lexemes, ranges).groupBy(index.key).agg(F.map_from_entries(F.collect_list(F.struct("lexeme", "places"))).alias("places_"))
    if _negative(query):  # what has none of the words answers too
        rows = index.keys().join(rows, index.key, "left").withColumn("places_", F.coalesce("places_", F.create_map().cast("map<string,array<int>>")))
    return rows.where(_answers(query)).select(index.key, rank(query).alias("rank"))


def _negative(query: str) -> bool:
    return any(all(t.negated for t in group) for group in parse(query))


def _most(word: str) -> Column:
    return F.coalesce(F.try_element_at("most_", F.lit(word)), F.lit(0))


def bound(query: str) -> Column:
    """What no document's rank exceeds that has each lexeme at most so often as the map ``most_`` says."""
    lexemes = _lexemes(query)
    if len(parse(query)) == 1 and len(lexemes) > 1:
        nearest = math.log1p(-WEIGHT / math.sqrt(1.005 + 0.05 * math.exp(1 / 1.5 - 2)))
        return 1 - F.exp(nearest * sum((_most(a) * _most(b) for i, a in enumerate(lexemes) for b in lexemes[:i]), F.lit(0)))
    return sum((_reciprocals(_most(w)) for w in lexemes), F.lit(0.0)) * WEIGHT / ALL_PLACES / len(lexemes)


def _may_hold(query: str) -> Column:
    """Whether some alternative's words are all in a range."""
    groups = [functools.reduce(lambda a, b: a & b, [_most(w) > 0 for t in group if not t.negated for w in t.words]) for group in parse(query)]
    return functools.reduce(lambda a, b: a | b, groups)


def best(index: Index, query: str, k: int, few: int = FEW) -> tuple[DataFrame, int, int]:
    """(the k best (key, rank), ranges of the index that were read, ranges in all). The ranges with the highest bounds are read
    first; when their k-th rank is known, only those whose bound reaches it."""
    order = [F.desc(F.round("rank", 12)), F.col(index.key)]  # sums of one set of numbers may differ in their last places
    lexemes, total = _lexemes(query), index.ranges
    if not lexemes or index.size <= few or _negative(query):
        return found_in(index, query).orderBy(*order).limit(k), total, total
    bounds = index.blocks(lexemes).groupBy("segment", "range").agg(F.map_from_entries(F.collect_list(F.struct("lexeme", F.least("most", F.lit(MOST_PLACES)).cast("int").alias("most")))).alias("most_"))
    bounds = bounds.where(_may_hold(query)).select("segment", "range", bound(query).alias("bound"))
    first = bounds.orderBy(F.desc("bound"), "segment", "range").limit(FIRST).collect()
    if not first:
        return found_in(index, query, []).limit(k), 0, total
    ranks = [r["rank"] for r in found_in(index, query, [(r["segment"], r["range"]) for r in first]).orderBy(*order).limit(k).select("rank").collect()]
    rest = bounds.where(F.col("bound") >= (ranks[-1] - 1e-9 if len(ranks) == k else -1.0)).select("segment", "range")
    some = rest.limit(NAMED + 1).collect()
    read = [(r["segment"], r["range"]) for r in some] if len(some) <= NAMED else rest
    return found_in(index, query, read).orderBy(*order).limit(k), len(some) if len(some) <= NAMED else rest.count(), total


def headline(text: Column, query: str, most: int = 40, before: int = 10, fragments: int = 2, marked: bool = True) -> Column:
    """Up to so many fragments of a text, of ``most`` words each where it has them, around the first match and the
    first one behind that fragment, joined by dots; the query's words in <b> if marked."""
    wanted = sorted({w for group in parse(query) for t in group if not t.negated for w in t.words})
    hit = lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]+", "").isin(*wanted)

    def cut(words: Column) -> Column:
        hits = F.filter(F.transform(words, lambda w, i: F.when(hit(w), i + 1)), lambda i: i.isNotNull())
        start = lambda at: F.greatest(F.lit(1), F.least(at - before, F.size(words) - most + 1))

        def shown(begin: Column) -> Column:
            window = F.slice(words, begin, most)
            return F.array_join(F.transform(window, lambda w: F.when(hit(w), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w)) if marked else window, " ")

        first = start(F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(1)))
        if fragments == 1:
            return shown(first)
        return T.let(first, lambda f: T.let(F.try_element_at(F.filter(hits, lambda i: i >= f + most), F.lit(1)), lambda n: F.concat_ws(" ... ", shown(f), F.when(n.isNotNull(), shown(F.greatest(f + most, start(n)))))))

    return T.let(F.filter(F.split(text, r"\s+"), lambda w: w != ""), cut)


def passage(text: Column, query: str) -> Column:
    """A hundred and twenty plain words around the first match, if the text has so many."""
    return headline(text, query, 120, 20, 1, marked=False)


def fragments(text: Column, query: str, most: int = 40, least: int = 20, count: int = 2, marked: bool = True) -> Column:
    """Up to two fragments of a text around its best covers, in text order, joined by dots; the query's words in <b> if marked.

    A cover is a stretch of ``most`` words at most from one match to another. Those with more different words of the query go first, then
    shorter ones, then earlier ones. A fragment is a cover stretched on both sides to ``most`` words, where the text has them, and cut
    after the last end of a sentence behind the cover and behind ``least`` words. The second one is the best cover outside the first
    fragment. Without a match: the text's first words.
    """
    wanted = sorted({w for group in parse(query) for t in group if not t.negated for w in t.words})
    clean = lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]+", "")

    def cut(words: Column) -> Column:
        n = F.size(words)
        hits = F.filter(F.transform(words, lambda w, i: F.struct((i + 1).alias("i"), clean(w).alias("w"))), lambda h: h["w"].isin(*wanted))

        def covers(hits: Column) -> Column:
            def cover(h: Column, k: Column) -> Column:
                near = F.filter(F.slice(hits, k + 1, most), lambda x: x["i"] < h["i"] + most)
                firsts = lambda near: F.transform(F.array_distinct(F.transform(near, lambda x: x["w"])), lambda w: F.array_min(F.transform(F.filter(near, lambda x: x["w"] == w), lambda x: x["i"])))
                return T.let(near, lambda near: T.let(firsts(near), lambda f: F.struct((-F.size(f)).alias("different"), (F.array_max(f) - h["i"]).alias("length"), h["i"].alias("i"), F.array_max(f).alias("e"))))

            return F.transform(hits, cover)

        def stretched(i: Column, e: Column, low: Column, high: Column) -> Column:
            """struct(a, b): first and last word of the fragment of a cover, between two words."""
            a = F.greatest(low, F.least(i - F.floor((F.lit(most) - (e - i + 1)) / 2).cast("int"), high - most + 1))

            def ended(a: Column) -> Column:
                b = F.least(high, a + most - 1)
                ends = F.filter(F.sequence(F.greatest(e, a + least - 1), F.greatest(e, a + least - 1, b)), lambda k: (k <= b) & F.element_at(words, F.greatest(F.least(k, n), F.lit(1))).rlike(r"[.!?]$"))
                return F.struct(a.alias("a"), F.coalesce(F.array_max(ends), b).alias("b"))

            return T.let(a, ended)

        def shown(f: Column) -> Column:
            part = F.slice(words, f["a"], F.greatest(f["b"] - f["a"] + 1, F.lit(0)))
            return F.array_join(F.transform(part, lambda w: F.when(clean(w).isin(*wanted), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w)) if marked else part, " ")

        def chosen(found: Column) -> Column:
            best = F.array_min(found)
            first = F.when(best.isNull(), stretched(F.lit(1), F.lit(1), F.lit(1), n)).otherwise(stretched(best["i"], best["e"], F.lit(1), n))

            def with_second(f: Column) -> Column:
                if count == 1:
                    return shown(f)
                other = F.array_min(F.filter(found, lambda c: (c["i"] > f["b"]) | (c["e"] < f["a"])))

                def both(o: Column) -> Column:
                    behind = o["i"] > f["b"]
                    s = stretched(o["i"], o["e"], F.when(behind, f["b"] + 1).otherwise(1), F.when(behind, n).otherwise(f["a"] - 1))
                    return F.when(o.isNull(), shown(f)).otherwise(T.let(s, lambda s: F.when(behind, F.concat_ws(" ... ", shown(f), shown(s))).otherwise(F.concat_ws(" ... ", shown(s), shown(f)))))

                return T.let(other, both)

            return T.let(first, with_second)

        return F.when(n == 0, "").otherwise(T.let(hits, lambda h: T.let(covers(h), chosen)))

    return T.let(F.filter(F.split(text, r"\s+"), lambda w: w != ""), cut)


def full_text(index: Index, query: str, size: int = 20, page: int = 0) -> DataFrame:
    """A result page (key, rank, pos), best first, ties by key."""
    if not query.strip():
        raise ValueError("the query is blank")
    if size < 1 or page < 0:
        raise ValueError("size below 1 or page below 0")
    size, key = min(size, DEFAULTS.max_page_size), index.key
    order = [F.desc(F.round("rank", 12)), F.col(key)]
    top = best(index, query[: DEFAULTS.query_chars], (page + 1) * size)[0]
    return top.withColumn("pos", F.row_number().over(Window.orderBy(*order))).where(F.col("pos") > page * size).withColumn("rank", F.round("rank", 6))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest(vectors: DataFrame, key: str, column: str, query: list[float], k: int, model: str | None = None) -> DataFrame:
    """(key, score): the k vectors nearest to a query vector by cosine, ties by key; only those of the model, if one
    is named. Batches of vectors are multiplied as matrices."""
    import numpy as np
    import pyarrow as pa

    wanted = np.array(query, dtype=np.float64)
    length = np.sqrt(wanted @ wanted)

    def run(batches):
        for batch in batches:
            lists = batch.column("v")
            whole = np.asarray(lists.flatten(), dtype=np.float64)
            x = whole.reshape(-1, len(wanted)) if len(whole) == len(lists) * len(wanted) and not lists.null_count else np.array([v if v is not None and len(v) == len(wanted) else [np.nan] * len(wanted) for v in lists.to_pylist()], dtype=np.float64).reshape(-1, len(wanted))
            norm = np.sqrt(np.einsum("ij,ij->i", x, x)) * length
            with np.errstate(invalid="ignore", divide="ignore"):
                score = (x @ wanted) / norm
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(score, pa.float64(), from_pandas=True)], ["k", "score"])

    rows = vectors if model is None else vectors.where(F.col("model") == model)
    kind = vectors.schema[key].dataType.simpleString()
    scored = rows.select(F.col(key).alias("k"), F.col(column).alias("v")).mapInArrow(run, f"k {kind}, score double").where("score is not null")
    return scored.select(F.col("k").alias(key), "score").orderBy(F.desc("score"), key).limit(k)


def best_per_page(hits: DataFrame, page: str, key: str, floor: float = DEFAULTS.min_score) -> DataFrame:
    """A page's best hit of those that reach the floor."""
    best = F.max_by(F.struct("score", key), F.struct("score", -F.col(key)))
    return hits.where(F.col("score") >= floor).groupBy(page).agg(best.alias("b")).select(page, f"b.{key}", "b.score")


def semantic(vectors: DataFrame, page: str, key: str, column: str, query: list[float], k: int, floor: float = DEFAULTS.min_score, model: str | None = None) -> DataFrame:
    """(page, key, score): the k pages nearest by their best chunk; ten times as many chunks are fetched, five hundred
    at most, so that one page's chunks do not crowd out the others."""
    pool = nearest(vectors, key, column, query, min(DEFAULTS.overfetch * k, DEFAULTS.max_pool), model)
    best = best_per_page(vectors.select(page, key).join(F.broadcast(pool), key), page, key, floor)
    return best.orderBy(F.desc("score"), page).limit(k)


def hydrate(hits: DataFrame, pages: DataFrame, page: str) -> DataFrame:
    """Hits, which a result page bounds, beside their pages; a quarantined page is none, whatever vectors it left."""
    return pages.where(F.col("ai_status") != "quarantined").join(F.broadcast(hits), page)


def changed(chunks: DataFrame, points: DataFrame, model: str) -> DataFrame:
    """Pages (url, content_hash) of which the model has no point for that content: these are embedded."""
    return chunks.join(points.where(F.col("model") == model).select("url", "content_hash").distinct(), ["url", "content_hash"], "left_anti")


def embed_pages(pages: DataFrame, points: DataFrame, embed, model: str = DEFAULTS.embed_model, width: int | None = None) -> DataFrame:
    """points (id, url, chunk_index, content_hash, model, text, embedding) after embedding the pages (url, text) whose
    content is new to the model: capped, cut into chunks and embedded; a page's points go over all that the
    model had of it. ``embed`` turns a column of texts into one of vectors; one of another width is an error."""
    hashed = pages.where(F.trim("text") != "").select("url", "text", F.sha2("text", 256).alias("content_hash"))
    fresh = changed(hashed, points, model)
    cut = fresh.select("url", "content_hash", F.posexplode(T.chunks(F.left("text", F.lit(DEFAULTS.embed_chars)))).alias("chunk_index", "text"))
    made = cut.select(T.name_uuid(F.concat_ws("-", "url", F.col("chunk_index").cast("string"))).alias("id"), "url", "chunk_index", "content_hash", F.lit(model).alias("model"), "text", embed(F.col("text")).alias("embedding"))
    if width is not None:
        made = made.withColumn("embedding", F.when(F.size("embedding") == width, F.col("embedding")).otherwise(F.raise_error(F.lit("an embedding has another width"))))
    gone = fresh.select("url").distinct().withColumn("model", F.lit(model))
    return points.join(gone, ["url", "model"], "left_anti").select(*made.columns).unionByName(made)


def fuse(text: DataFrame, vectors: DataFrame, key: str, k: int = DEFAULTS.rrf_k, size: int = 20) -> DataFrame:
    """Reciprocal rank fusion of two lists (key, pos from 1): (key, score), the first list before the
    second among equals."""
    lists = text.select(key, "pos", F.lit(1).alias("list")).unionByName(vectors.select(key, "pos", F.lit(2).alias("list")))
    fused = lists.groupBy(key).agg(F.sum(1.0 / (k + F.col("pos"))).alias("score"), F.min(F.struct("list", "pos")).alias("first"))
    return fused.orderBy(F.desc("score"), "first", key).limit(size).select(key, F.round("score", 6).alias("score"))


def hybrid(index: Index, query: str, vectors: DataFrame | None, size: int = 20, page: int = 0) -> tuple[DataFrame, DataFrame]:
    """(result page (key, score), total). The first page fuses the text hits with the vector hits (key, pos) and
    counts the union of the two lists; another page, or one without vector hits, is the text's alone and
    counts all documents that answer."""
    text = full_text(index, query, size, page)
    if page == 0 and vectors is not None and vectors.limit(1).count():
        both = text.select(index.key).unionByName(vectors.select(index.key)).distinct()
        return fuse(text, vectors, index.key, size=size), both.agg(F.count("*").alias("total"))
    return text.select(index.key, F.col("rank").alias("score")), found_in(index, query).agg(F.count("*").alias("total"))


def semantic_page(hits: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(hits, total) of a search by vectors alone; without an embedder there is none."""
    if hits is None:
        raise RuntimeError("vector search is not available")
    return hits, hits.agg(F.count("*").alias("total"))


def passages(results: DataFrame, chunks: DataFrame, pages: DataFrame, key: str, query: str) -> DataFrame:
    """(pos, key, passage) of results (key, pos): the best chunk that vector search found of a page, or where it found
    none the words of the page around the query's first match."""
    best = chunks.select(key, F.col("text").alias("chunk_"))
    joined = results.join(best, key, "left").join(pages.select(key, F.col("text").alias("text_")), key)
    return joined.select("pos", key, F.coalesce("chunk_", passage(F.col("text_"), query)).alias("passage"))


def by_best_position(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two rankings as one: a key stands at its better position, the first list before the second."""
    both = a.select(key, "pos", F.lit(1).alias("list")).unionByName(b.select(key, "pos", F.lit(2).alias("list")))
    return both.groupBy(key).agg(F.min(F.struct("pos", "list")).alias("best")).withColumn("pos", F.row_number().over(Window.orderBy("best", key))).select(key, "pos")


def within_budget(passages: DataFrame, group: list[str], order: str, text: str, budget: int = DEFAULTS.context_chars) -> DataFrame:
    """Passages in order until the budget of characters is used; the last one is cut to fit."""
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1) if group else Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length(text)).over(before), F.lit(0))
    return passages.withColumn("used", used).where(F.col("used") < budget).withColumn(text, F.left(F.col(text), F.lit(budget) - F.col("used")))
