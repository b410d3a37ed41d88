"""Exact top-k inner products over a pivot-distance index.

Inner products become distances when every vector x gets one more component, sqrt(M^2 - |x|^2) with
M the largest norm, and a query gets 0 there: |q - x|^2 = |q|^2 + M^2 - 2 q.x. Each vector is keyed by
its nearest pivot and its distance to it; a pivot's vectors, in order of distance, are cut into
annuli. A query first searches the annulus that it lies in, which gives it a score that its k-th
answer reaches at least. The triangle inequality then bounds the scores in every other annulus
from the query's distance to the pivot; the query goes to those whose bound reaches its score, and
to no other.

Pivots come from a sample of ``SAMPLE`` vectors (those of smallest id hash); every vector is indexed.
The distance histogram has at most PIVOTS x BINS cells. An annulus that holds more than ``BLOCK``
vectors of one bin, as many copies of one vector do, is dealt into several blocks of the same bounds.
A task holds one block and streams the queries past it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, sorted_groups, table

K, EVERY, SCALE = 20, 20, 64
SAMPLE, BINS, BLOCK = 4096, 512, 16384
#: Pivots: a quarter of the root of the number of vectors, within these bounds.
LEAST_PIVOTS, MOST_PIVOTS = 32, 512
MOST_COMPONENT = 1 << 52
#: Cells of the table of queries and blocks that is looked at at a time.
CELLS = 1 << 22
#: Room for rounding in distances, which are compared with exact integer scores.
SLACK = 1e-6


def _quantise(batches):
    for batch in batches:
        ids, out, sizes = [], [], []
        for i, x in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
            if i is None or x is None or None in x:
                continue
            v = np.array(x, dtype=np.float64)
            if not np.isfinite(v).all():
                continue
            v = np.floor(v * SCALE)
            if np.abs(v).max(initial=0) >= MOST_COMPONENT:
                raise OverflowError(f"vector {i}: a component is beyond 2^52")
            ids.append(i)
            out.append(v.astype("<i8").tobytes())
            sizes.append(len(v))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(sizes, pa.int32())], ["vec_id", "v", "dim"])


def quantised(rows: DataFrame) -> DataFrame:
    """(row, vec_id, v, dim): v holds floor(64 x) as little-endian 64-bit integers, row numbers the rows.
    Vectors that are null or hold null or non-finite components, and null ids, take no part; every other row
    does, whether or not its id comes again. A component that doubles do not hold exactly is an error."""
    found = rows.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_quantise, "vec_id long, v binary, dim int")
    return found.withColumn("row", F.monotonically_increasing_id())


def matrix(column, dim: int) -> np.ndarray:
    """Vectors as rows of 64-bit integers; short ones end in zeros."""
    out = np.zeros((len(column), dim), dtype=np.int64)
    for k, raw in enumerate(column):
        v = np.frombuffer(raw, dtype="<i8")
        out[k, : len(v)] = v
    return out


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """n centres of the sample: farthest-first seeds, then ten rounds of k-means."""
    seeds, near = [0], distances(sample, sample[:1])[:, 0]
    while len(seeds) < min(n, len(sample)) and near.max() > 0:
        seeds.append(int(near.argmax()))
        near = np.minimum(near, distances(sample, sample[seeds[-1:]])[:, 0])
    pivots = sample[seeds].copy()
    for _ in range(10):
        home = distances(sample, pivots).argmin(axis=1)
        for p in range(len(pivots)):
            if (home == p).any():
                pivots[p] = sample[home == p].mean(axis=0)
    return pivots


class Index:
    """Pivots, the bins' width and the annuli: for each (pivot, bin) its first block and how many."""

    def __init__(self, pivots: np.ndarray, most: float, dim: int) -> None:
        self.pivots, self.most, self.dim = pivots, most, dim
        self.reach = 2 * np.sqrt(max(most, 1.0)) * 2 + 1

    def key(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = distances(lifted(x.astype(np.float64), self.most), self.pivots)
        pivot = d.argmin(axis=1)
        least = d[np.arange(len(d)), pivot]
        return pivot, np.minimum((least / self.reach * BINS).astype(np.int64), BINS - 1), least

    def lay_out(self, counts: np.ndarray) -> None:
        self.first = np.zeros((len(self.pivots), BINS), dtype=np.int64)
        self.copies = np.ones((len(self.pivots), BINS), dtype=np.int64)
        blocks: list[tuple[int, int, int]] = []
        for p in range(len(self.pivots)):
            low, held = 0, 0
            for b in range(BINS):
                n = int(counts[p, b])
                if held and held + n > BLOCK:
                    blocks.append((p, low, b))
                    low, held = b, 0
                self.first[p, b] = len(blocks)
                held += n
                if n > BLOCK:
                    self.copies[p, b] = -(-n // BLOCK)
                    blocks += [(p, b, b + 1)] * int(self.copies[p, b])
                    low, held = b + 1, 0
            if held or low < BINS:
                blocks.append((p, low, BINS))
        self.blocks = np.array(blocks, dtype=np.int64)

    def block_of(self, pivot: np.ndarray, bin_: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self.first[pivot, bin_] + (ids * 0x9E3779B1 >> 7) % self.copies[pivot, bin_]

    def best_scores(self, q: np.ndarray) -> np.ndarray:
        """[query, block]: no vector of the block has a higher inner product with the query."""
        q = q.astype(np.float64)
        d = distances(np.column_stack([q, np.zeros(len(q))]), self.pivots)[:, self.blocks[:, 0]]
        low, high = (self.blocks[:, i] * self.reach / BINS for i in (1, 2))
        gap = np.maximum(np.maximum(d - high, low - d) - SLACK * self.reach, 0)
        whole = (q * q).sum(axis=1)[:, None] + self.most
        return (whole - gap * gap) / 2 + 1e-9 * whole + 1e-3


def _bins(index):
    def run(batches):
        total = np.zeros((len(index.value.pivots), BINS), dtype=np.int64)
        for batch in batches:
            p, b, _ = index.value.key(matrix(batch.column("v").to_pylist(), index.value.dim))
            np.add.at(total, (p, b), 1)
        p, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[p, b])], ["p", "b", "n"])

    return run


def _place(index):
    def run(batches):
        for batch in batches:
            rows = batch.column("row").to_numpy()
            p, b, _ = index.value.key(matrix(batch.column("v").to_pylist(), index.value.dim))
            yield pa.RecordBatch.from_arrays([pa.array(index.value.block_of(p, b, rows)), *(batch.column(c) for c in ("row", "vec_id", "v"))], ["block", "row", "vec_id", "v"])

    return run


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in the narrowest arithmetic that holds them, at worst in Python's integers."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(x.shape[1], 1)
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object
    return q.astype(kind) @ x.astype(kind).T


def best(q: np.ndarray, q_rows: np.ndarray, x: np.ndarray, x_rows: np.ndarray, x_ids: np.ndarray, floor: np.ndarray, k: int):
    """(row of q, row of x, score): the k best of each query that reach its floor, its own row left
    out, by score and then the smaller id. Scores beyond 64 bits are an error."""
    at_q, at_x, scores = [], [], []
    for at in range(0, len(q), 256):
        s = products(q[at : at + 256], x)
        # a floor is a score rounded down to a double
        rows, cols = np.nonzero((s >= floor[at : at + 256, None]) & (x_rows[None, :] != q_rows[at : at + 256, None]))
        found = s[rows, cols].astype(np.int64)
        order = np.lexsort((x_rows[cols], x_ids[cols], -found, rows))
        rows, cols, found = rows[order], cols[order], found[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        keep = rank < k
        at_q.append(rows[keep] + at)
        at_x.append(cols[keep])
        scores.append(found[keep])
    if not at_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(at_q), np.concatenate(at_x), np.concatenate(scores)


def floor_of(score: int) -> float:
    """The largest double that is not above the score."""
    near = float(score)
    return near if int(near) <= score else float(np.nextafter(near, -np.inf))


ANSWER = "query long, query_id long, row long, vec_id long, score long"


def _home(index, k: int, every: int):
    """A block's own queries against the block: one row per query with its answers so far."""

    def run(batches):
        for block, (rows, ids, raw) in sorted_groups(batches, "block", ["row", "vec_id", "v"], 4096):
            edges = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                asks = np.flatnonzero(ids[a:b] % every == 0)
                if not len(asks):
                    continue
                x, x_rows, x_ids = matrix(raw[a:b], index.value.dim), rows[a:b], ids[a:b]
                at_q, at_x, s = best(x[asks], x_rows[asks], x, x_rows, x_ids, np.full(len(asks), -np.inf), k)
                ends = np.searchsorted(at_q, np.arange(len(asks) + 1))
                spans = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
                lists = [pa.array([y[i:j].tolist() for i, j in spans], pa.list_(pa.int64())) for y in (x_rows[at_x], x_ids[at_x], s)]
                yield pa.RecordBatch.from_arrays([pa.array(x_rows[asks]), pa.array(x_ids[asks]), pa.array([raw[a + i] for i in asks], pa.binary()), pa.array(np.full(len(asks), block[a])), *lists], ["query", "query_id", "v", "home", "rows", "near", "scores"])

    return run


def _spread(index, k: int):
    """Each query to every block but its home whose bound reaches the query's k-th score."""

    def run(batches):
        step = max(1, CELLS // max(len(index.value.blocks), 1))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                raw = some.column("v").to_pylist()
                floor = np.array([floor_of(s[k - 1]) if len(s) >= k else -np.inf for s in some.column("scores").to_pylist()], dtype=np.float64)
                goes = index.value.best_scores(matrix(raw, index.value.dim)) >= floor[:, None]
                goes[np.arange(len(raw)), some.column("home").to_numpy()] = False
                rows, blocks = np.nonzero(goes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blocks), pa.array(some.column("query").to_numpy()[rows]), pa.array(some.column("query_id").to_numpy()[rows]), pa.array([raw[r] for r in rows], pa.binary()), pa.array(floor[rows])],
                    ["block", "row", "vec_id", "v", "floor"],
                )

    return run


def _visit(index, k: int):
    """Sorted by block, a block's vectors (no floor) before the queries that come to it."""

    def run(batches):
        now, held, x, x_rows, x_ids = None, [], None, None, None
        for batch in batches:
            block, rows, ids, raw = batch.column("block").to_numpy(), batch.column("row").to_numpy(), batch.column("vec_id").to_numpy(), batch.column("v").to_pylist()
            asks = batch.column("floor").is_valid().to_numpy(zero_copy_only=False)
            floor = batch.column("floor").to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.flatnonzero((np.diff(block) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1, [len(block)]])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if block[a] != now:
                    now, held, x = block[a], [], None
                if not asks[a]:
                    held.append((rows[a:b], ids[a:b], raw[a:b]))
                    continue
                if x is None:
                    x_rows, x_ids = (np.concatenate([h[i] for h in held]) if held else np.zeros(0, np.int64) for i in (0, 1))
                    x = matrix([r for h in held for r in h[2]], index.value.dim)
                at_q, at_x, s = best(matrix(raw[a:b], index.value.dim), rows[a:b], x, x_rows, x_ids, floor[a:b], k)
                yield pa.RecordBatch.from_arrays([pa.array(y) for y in (rows[a:b][at_q], ids[a:b][at_q], x_rows[at_x], x_ids[at_x], s)], ["query", "query_id", "row", "vec_id", "score"])

    return run


def search(rows: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose vec_id is divisible by ``every`` its k best inner products.

    Equal scores go to the smaller vec_id; with fewer than k others, all of them are returned. Which
    rows take part: see :func:`quantised`; rows that share an id are queries and candidates each. Vectors
    of different length are compared as if the short one ended in zeros. Other columns are not read. Products
    are exact; one that no 64 bits hold is an error. No rows, or a single one: no rows.
    """
    sc = rows.sparkSession.sparkContext
    vectors = cut(quantised(rows))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).select("v").toArrow().column("v").to_pylist()
    dim, n = vectors.agg(F.max("dim"), F.count("*")).first()
    dim = max(dim or 0, 1)
    norms = vectors.select("v").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array((matrix(b.column("v").to_pylist(), dim).astype(np.float64) ** 2).sum(axis=1))], ["n"]) for b in batches), "n double")
    most = float(norms.agg(F.max("n")).first()[0] or 0.0)
    drawn = matrix(sample, dim).astype(np.float64) if sample else np.zeros((1, dim))
    pivots = min(MOST_PIVOTS, max(LEAST_PIVOTS, int(n**0.5 / 4)))
    index = Index(choose_pivots(lifted(drawn, most), pivots), most, dim)
    counts = np.zeros((len(index.pivots), BINS), dtype=np.int64)
    shared = sc.broadcast(index)
    for p, b, held in vectors.select("v").mapInArrow(_bins(shared), "p int, b int, n long").groupBy("p", "b").agg(F.sum("n")).collect():
        counts[p, b] = held
    index.lay_out(counts)
    shared = sc.broadcast(index)
    placed = cut(vectors.select("row", "vec_id", "v").mapInArrow(_place(shared), "block long, row long, vec_id long, v binary"))
    first = cut(placed.repartition("block").sortWithinPartitions("block").mapInArrow(_home(shared, k, every), "query long, query_id long, v binary, home long, rows array<long>, near array<long>, scores array<long>"))
    sent = first.select("query", "query_id", "v", "home", "scores").mapInArrow(_spread(shared, k), "block long, row long, vec_id long, v binary, floor double")
    both = placed.withColumn("floor", F.lit(None).cast("double")).unionByName(sent)
    visits = both.repartition("block").sortWithinPartitions("block", F.col("floor").isNotNull()).mapInArrow(_visit(shared, k), ANSWER)
    own = first.select("query", "query_id", F.explode(F.arrays_zip("rows", "near", "scores")).alias("x")).select("query", "query_id", F.col("x.rows").alias("row"), F.col("x.near").alias("vec_id"), F.col("x.scores").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    ranked = own.unionByName(visits).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
