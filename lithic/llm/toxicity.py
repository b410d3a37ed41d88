"""Toxicity by a support vector machine on a subsequence string kernel.

Two words are alike by the character triples that they share in order, gaps allowed: a triple whose
characters lie d1 and d2 apart (at most three each) weighs ``DECAY`` per skipped character, and
kernels are scaled to one on equal words. An inserted character so costs a word little. Signs inside
a word are dropped first, and runs of single characters ("i d i o t") are read as one word. Spans across
blanks, two or three neighbours of two or three letters read as one ("id iot"), are scored as well; as
chance makes many of them, they have to beat a margin by which every clean training document stays below a
half, and ``SPAN_SLACK`` more.

A sentence is as toxic as its most toxic word or span, and a document as its most toxic sentence, so words are
the machine's instances and sentences need not be told apart. Labels are per document: training is
multiple-instance (mi-SVM). A toxic document is toxic by its witness, the word of highest score in it, and no
word of a clean document is; words that a share of the toxic documents has and hardly any clean one are witnesses
as well, and witnesses come again with letters put in. Rounds of training and choosing witnesses anew, with the
clean words of highest score as further negatives, settle both. Near copies of a training document with its
label count once. The machine is linear in Nyström features of ``LANDMARKS`` words; since the kernel's own
features are triples, it is folded into one weight per triple for scoring. A logistic curve fitted to the
training documents turns scores into probabilities.

Training reads at most ``TRAIN_ROWS`` labelled documents of each class, those of smallest id hash, and none
of the held-out fold; scoring is one map over all whole texts.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import alone, table

TRAIN_ROWS = {1: 800, 0: 2000}
LANDMARKS, ROUNDS, HARD, EASY = 192, 4, 4000, 6000
#: Longest text, in characters, that training draws: each that it draws is read whole.
MOST_CHARS = 200_000
#: Share of the toxic documents from which on a word of theirs is a witness as well.
COMMON = 0.03
#: A witness's share of the toxic documents is at least so many times its share of the clean ones.
ODDS = 8.0
#: How far a word's documents have to lean to the toxic ones, as a log likelihood ratio, for it to be an insult by itself; a word
#: that leans less is a witness only where the machine, as trained so far, takes it for one.
EVIDENCE = 12
#: Share of common words from which on two training documents of one label are copies.
COPY = 0.8
#: Copies of a witness with one letter put in, at each inner place, for each of the most frequent VARIED.
VARIANTS, VARIED = 4, 150
DECAY, SPREAD, CLASSES = 0.6, 3, 64
LONGEST, OVERLAP = 24, 8
#: What a span has to score above the best span of a clean training document.
SPAN_SLACK = 0.1
#: Words whose scores a Python worker keeps, and words that are scored at a time.
WORDS_KEPT, PARTS = 150_000, 2_000
SIGNS = re.compile(r"[\W_]+")
START, STOP = CLASSES - 2, CLASSES - 1


def _class_table() -> np.ndarray:
    out = np.array([27 + (c % 34) for c in range(0x10000)], dtype=np.int64)
    out[ord("a") : ord("z") + 1] = np.arange(26)
    out[ord("0") : ord("9") + 1] = 26
    return out


CLASS = _class_table()


def read(text: str) -> tuple[set[str], set[str]]:
    """Distinct lower-case words of a text, white space apart, with runs of three and more single characters
    as one word besides; and the spans of two and three neighbours that have two or three letters each."""
    words = text.lower().split()
    found, spans = set(words), set()
    run: list[str] = []
    for at in [i for i, w in enumerate(words) if len(w) == 1]:
        if run and at != last + 1:
            if len(run) > 2:
                found.add("".join(run))
            run = []
        run.append(words[at])
        last = at
    if len(run) > 2:
        found.add("".join(run))
    one = two = ""
    for w in words:
        if 2 <= len(w) <= 3 and w.isalpha():
            if one:
                spans.add(one + w)
                if two:
                    spans.add(two + one + w)
            one, two = w, one
        else:
            one = two = ""
    return found, spans - found


def words_of(text: str) -> set[str]:
    return read(text)[0]


def pieces_of(word: str) -> list[str]:
    """A word without signs; a long one as overlapping pieces that cover it whole."""
    word = SIGNS.sub("", word)
    if len(word) <= LONGEST:
        return [word]
    return [word[at : at + LONGEST] for at in range(0, len(word) - OVERLAP, LONGEST - OVERLAP)]


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, triple, weight) of the words' kernel features, scaled to length one per row."""
    sizes = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    points = np.frombuffer("".join(f"\0{w}\0" for w in words).encode("utf-32-le", "replace"), dtype="<u4")
    codes = CLASS[np.minimum(points, len(CLASS) - 1)]
    ends = np.cumsum(sizes)
    codes[ends - sizes], codes[ends - 1] = START, STOP
    row = np.repeat(np.arange(len(words)), sizes)
    rows, keys, weights = [], [], []
    for a in range(1, SPREAD + 1):
        for b in range(1, SPREAD + 1):
            n = len(codes) - a - b
            if n <= 0:
                continue
            at = np.flatnonzero(row[:n] == row[a + b :])
            rows.append(row[at])
            keys.append((codes[at] * CLASSES + codes[at + a]) * CLASSES + codes[at + a + b])
            weights.append(np.full(len(at), DECAY ** (a + b - 2)))
    if not rows or not sum(map(len, rows)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    key = np.concatenate(rows) * CLASSES**3 + np.concatenate(keys)
    weight = np.concatenate(weights)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    weight, key = np.add.reduceat(weight, first), key[first]
    row, key = key // CLASSES**3, key % CLASSES**3
    norm = np.sqrt(np.bincount(row, weight * weight, minlength=len(words)))
    return row, key, weight / norm[row]


def linear(words: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    row, key, value = triples(words)
    return np.bincount(row, value * weights[key], minlength=len(words)) + bias


def kernel(words: list[str], columns: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """[word, landmark]; columns maps a triple to its column in landmarks [landmark, column]."""
    out = np.zeros((len(words), len(landmarks)))
    for at in range(0, len(words), 1000):
        some = words[at : at + 1000]
        row, key, value = triples(some)
        inside = columns[key] >= 0
        dense = np.zeros((len(some), landmarks.shape[1]), dtype=np.float32)
        dense[row[inside], columns[key[inside]]] = value[inside]
        out[at : at + 1000] = dense @ landmarks.T
    return out


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of an L2 support vector machine, its bias last, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(30):
        active = y * (x @ w) < 1
        xa, ya, ca = x[active], y[active], weight[active, None]
        new = np.linalg.solve(keep + xa.T @ (ca * xa), xa.T @ (ca[:, 0] * ya))
        done = np.abs(new - w).max() < 1e-8
        w = new
        if done:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (x, y), y 0 or 1, classes weighing the same."""
    z = np.column_stack([x, np.ones(len(x))])
    share = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (share * (p - y)) + ridge * w * np.array([0.01, 0.0])
        bend = z.T @ ((share * p * (1 - p))[:, None] * z) + ridge * 0.01 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-3), float(w[1])


class Machine:
    """One weight per triple, a bias, the curve from a document's score to its probability, and the margin that is
    taken off the score of a span."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float, margin: float = 0.0) -> None:
        self.weights, self.bias, self.slope, self.offset, self.margin = weights, bias, slope, offset, margin

    def scores(self, words: list[str]) -> np.ndarray:
        parts = [p for w in words for p in pieces_of(w)]
        owner = np.repeat(np.arange(len(words)), [len(pieces_of(w)) for w in words])
        out = np.full(len(words), -np.inf)
        for at in range(0, len(parts), PARTS):
            np.maximum.at(out, owner[at : at + PARTS], linear(parts[at : at + PARTS], self.weights, self.bias))
        return out

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.offset, -30, 30)))


#: What a model without training rows of both classes says of everything: nothing.
def blank() -> Machine:
    return Machine(np.zeros(CLASSES**3), -1.0, 1.0, 0.0)


def singles(bags: list[list[str]], toxic: np.ndarray) -> list[int]:
    """Places of the bags without later near copies of one label: those that share COPY of their words.
    Sets so alike share one of their rarest words, so only these are looked up."""
    often: dict[str, int] = {}
    for bag in bags:
        for w in bag:
            often[w] = often.get(w, 0) + 1
    kept: dict[int, set[str]] = {}
    holders: dict[tuple[int, str], list[int]] = {}
    for i, bag in enumerate(bags):
        words, label = set(bag) or {""}, int(toxic[i])
        rare = sorted(words, key=lambda w: (often.get(w, 0), w))[: len(words) - math.ceil(COPY * len(words)) + 1]
        near = {j for w in rare for j in holders.get((label, w), ())}
        if any(len(words & kept[j]) >= COPY * len(words | kept[j]) for j in near if COPY * len(words) <= len(kept[j]) <= len(words) / COPY):
            continue
        kept[i] = words
        for w in rare:
            holders.setdefault((label, w), []).append(i)
    return list(kept)


def fit(bags: list[list[str]], toxic: np.ndarray, spans: list[list[str]] | None = None) -> Machine:
    """A machine from documents as lists of distinct pieces of words, their labels and their spans."""
    if not (toxic == 1).any() or not (toxic == 0).any():
        return blank()
    clean_spans = [x for x, y in zip(spans or [], toxic, strict=False) if y == 0 and x]
    single = singles(bags, toxic)
    bags, toxic = [bags[i] for i in single], toxic[single]
    if not (toxic == 1).any() or not (toxic == 0).any():
        return blank()
    number: dict[str, int] = {}
    rows = [np.unique(np.array([number.setdefault(w, len(number)) for w in bag if w] or [number.setdefault("", len(number))], dtype=np.int64)) for bag in bags]
    words = list(number)
    in_toxic, in_clean = np.zeros(len(words)), np.zeros(len(words))
    for r, y in zip(rows, toxic, strict=True):
        (in_toxic if y == 1 else in_clean)[r] += 1
    lift = np.log((in_toxic + 0.1) / (toxic == 1).sum()) - np.log((in_clean + 0.1) / (toxic == 0).sum())
    bad = [r for r, y in zip(rows, toxic, strict=True) if y == 1]
    telling = lift >= np.log(ODDS)
    base, held = (toxic == 1).mean(), in_toxic + in_clean
    lean = in_toxic * np.log(np.maximum(in_toxic, 1) / (held * base)) + in_clean * np.log(np.maximum(in_clean, 1) / (held * (1 - base)))
    sure = telling & (lean >= min(EVIDENCE, lean[telling].max(initial=0.0) / 4))
    clean = np.flatnonzero((in_clean > 0) & ~telling)
    rng = np.random.default_rng(6)
    score = np.where(~sure, -10.0, lift + 0.5 * np.log(in_toxic + 1))
    easy = rng.permutation(clean)[:EASY]
    weights, bias = np.zeros(CLASSES**3), 0.0
    for _ in range(ROUNDS):
        witness, seen = np.unique([int(r[np.argmax(score[r])]) for r in bad], return_counts=True)
        allowed = sure[witness] | (telling & (score > 0))[witness]
        if allowed.any():
            witness, seen = witness[allowed], seen[allowed]
        common = np.setdiff1d(np.flatnonzero(sure & (in_toxic >= max(6, COMMON * len(bad)))), witness)
        witness, seen = np.concatenate([witness, common]), np.concatenate([seen, in_toxic[common]])
        hard = clean[np.argsort(-score[clean], kind="stable")[:HARD]]
        none = np.unique(np.concatenate([easy, hard]))
        often = witness[np.argsort(-seen, kind="stable")]
        marks = [words[i] for i in np.concatenate([often[: 2 * LANDMARKS // 3], none[rng.permutation(len(none))[: LANDMARKS // 3]]])]
        row, key, value = triples(marks)
        used = np.unique(key)
        columns = np.full(CLASSES**3, -1, dtype=np.int64)
        columns[used] = np.arange(len(used))
        dense = np.zeros((len(marks), len(used)), dtype=np.float32)
        dense[row, columns[key]] = value
        values, vectors = np.linalg.eigh(dense.astype(np.float64) @ dense.T)
        values = np.maximum(values, 1e-3)
        root = vectors / np.sqrt(values) @ vectors.T
        seen = np.sqrt(seen)
        varied = [(words[i], at) for i in often[:VARIED] if len(words[i]) >= 4 for at in range(1, len(words[i])) for _ in range(VARIANTS)]
        varied = [w[:at] + chr(97 + int(rng.integers(26))) + w[at:] for w, at in varied]
        some = [*(words[i] for i in witness), *varied, *(words[i] for i in none)]
        x = kernel(some, columns, dense) @ root
        n = len(witness) + len(varied)
        y = np.concatenate([np.ones(n), -np.ones(len(none))])
        share = np.concatenate([seen / seen.sum(), np.full(len(varied), 1 / max(len(varied), 1))])
        cost = np.concatenate([share / share.sum(), in_clean[none] ** 0.5 / (in_clean[none] ** 0.5).sum()]) * len(some) / 2
        w = squared_hinge(x, y, cost)
        weights, bias = np.zeros(CLASSES**3), float(w[-1])
        weights[used] = (root @ w[:-1]) @ dense
        score = np.concatenate([linear(words[at : at + PARTS], weights, bias) for at in range(0, len(words), PARTS)])
    # the curve has to hold for insults with a letter put in as well
    told = np.concatenate([np.array([score[r].max() for r in rows]), linear(varied, weights, bias)])
    slope, offset = logistic(told, np.concatenate([(toxic == 1).astype(float), np.ones(len(varied))]))
    machine = Machine(weights.astype(np.float32), bias, slope, offset)
    if clean_spans:
        every = sorted(set().union(*clean_spans))
        told = dict(zip(every, machine.scores(every).tolist(), strict=True))
        machine.margin = max(0.0, max(told.values()) + offset / slope + SPAN_SLACK)
    return machine


def _bag(batches):
    alone("toxicity")
    for batch in batches:
        texts = [read(t or "") for t in batch.column("text").to_pylist()]
        words = [sorted({p for w in found for p in pieces_of(w)}) for found, _ in texts]
        lists = [pa.array(x, pa.list_(pa.string())) for x in (words, [sorted(spans) for _, spans in texts])]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("draw"), *lists], ["toxic", "draw", "words", "spans"])


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, rows: dict[int, int] = TRAIN_ROWS) -> Machine:
    """A machine from at most ``rows`` labelled documents of each class outside the held-out fold. Labels that
    are null or neither 0 nor 1, and null ids, are left out; of an id labelled twice the lesser label counts, and
    of several texts with one id the least. Texts beyond ``MOST_CHARS`` characters are not drawn, so
    at most 2,800 rows of the pieces of so long a text come to the driver."""
    usable = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    draw = F.xxhash64("doc_id")
    chosen = [usable.where(F.col("toxic") == c).groupBy("doc_id").agg(F.min("toxic").alias("toxic")).withColumn("draw", draw).orderBy("draw", "doc_id").limit(rows[c]) for c in (0, 1)]
    sample = chosen[0].unionByName(chosen[1])
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample.groupBy("doc_id", "draw").agg(F.min("toxic").alias("toxic"))), "doc_id")
    texts = texts.groupBy("doc_id", "toxic", "draw").agg(F.min("text").alias("text")).where(F.char_length(F.coalesce("text", F.lit(""))) <= MOST_CHARS)
    got = texts.select("toxic", "draw", "text").mapInArrow(_bag, "toxic int, draw long, words array<string>, spans array<string>").toArrow()
    order = np.lexsort((got.column("toxic").to_numpy(), got.column("draw").to_numpy())) if got.num_rows else np.zeros(0, np.int64)
    got = got.take(pa.array(order, pa.int64()))
    return fit(got.column("words").to_pylist(), got.column("toxic").to_numpy(), got.column("spans").to_pylist())


def _score(shared):
    kept: dict[str, float] = {}

    def run(batches):
        alone("toxicity")
        machine = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [read(t or "") for t in batch.column("text").to_pylist()]
                new = list(set().union(*(x for pair in texts for x in pair)) - kept.keys())
                if len(kept) + len(new) > WORDS_KEPT:
                    kept.clear()
                    new = list(set().union(*(x for pair in texts for x in pair)))
                kept.update(zip(new, machine.scores(new).tolist(), strict=True))
                least = machine.bias
                top = np.array([max(max((kept[w] for w in words), default=least), max((kept[w] for w in spans), default=-np.inf) - machine.margin) for words, spans in texts])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(machine.probability(top), pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs.

    Null text counts as empty and scores as a text without any word, a text of any length is read whole.
    Repeated rows score alike, and rows of equal words tie; a null id has a null held_out. Other columns are
    not read, whatever their names. No rows: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_score(shared), "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted toxic; a column that docs has of the same name stays as it is."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    names = docs.columns

    def run(batches):
        judge = _score(shared)
        for batch in batches:
            small = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(names.index("text"))], ["doc_id", "text"])
            scores = np.concatenate([s.column("score").to_numpy() for s in judge([small])]) if batch.num_rows else np.zeros(0)
            yield batch.filter(pa.array(scores < 0.5))

    return docs.mapInArrow(run, docs.schema)
