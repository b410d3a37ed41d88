"""Approximate vector search over a persisted index of cells and product-quantised codes.

k-means cells are fitted on unit vectors of a bounded sample, and for every slice of dimensions a codebook on what the cells leave
over. A point's row lies in the files of its cell with its code, a byte for each slice, and its vector. A query reads
the codes of the few cells nearest to it, and the vectors of those cells' best codes alone are scored exactly. The index is
tables of a snapshot store: additions and deletions are commits, and every session that opens its folder uses it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from lithic.operators import search, shares
from lithic.sources.snapshots import Snapshot, Store, Transaction

#: Rows that the cells and codebooks are fitted on; cells at most; codes of a slice; dimensions of a slice.
SAMPLE, MOST_CELLS, CODES, SLICE = 100_000, 16_384, 256, 4
#: Rows of a cell in one task, and of queries; bytes of a block's points in single precision, and of the scores made at a time.
CELL_ROWS, QUERY_ROWS, BLOCK_BYTES = 200_000, 1_024, 1 << 25
POOL = 20
#: Told apart in the folder's name: an index of another layout is another index.
LAYOUT = "2"
#: Points whose true neighbours tell how many cells have to be probed, how many neighbours, and the share of them to be reached.
TRIED, NEIGHBOURS, REACHED = 256, 20, 0.95


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; one that is null or of another width is all NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), dtype=np.float64) if not column.null_count else np.zeros(0)
    if len(column) and len(flat) == len(column) * width and (np.diff(np.asarray(column.offsets)) == width).all():
        return flat.reshape(-1, width)
    return np.array([v if v is not None and len(v) == width and None not in v else [np.nan] * width for v in column.to_pylist()], dtype=np.float64).reshape(-1, width)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; NaN for those that have no direction."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def closest(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The nearest of ``to`` for each row, the first of equals."""
    half = np.einsum("ij,ij->i", to, to) / 2
    return np.concatenate([np.argmin(half - part @ to.T, axis=1) for part in np.array_split(x, max(1, len(x) // 4096))]) if len(x) else np.zeros(0, np.int64)


def codebook(x: np.ndarray, codes: int = CODES, rounds: int = 12) -> np.ndarray:
    """Centres of rows by Lloyd's method, begun with evenly chosen ones in a fixed order; no more than there are different rows."""
    different = np.unique(x, axis=0)
    centres = different[np.random.default_rng(7).permutation(len(different))[:codes]].copy()
    for _ in range(rounds):
        own = closest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, x[:, d], minlength=len(centres)) for d in range(x.shape[1])], axis=1)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


@dataclass(frozen=True)
class Index:
    """A snapshot of an index and what its codes mean; key and column name the points' id and vector."""

    at: Snapshot
    key: str
    column: str
    cells: np.ndarray
    books: list[np.ndarray]
    share: float

    @classmethod
    def open(cls, store: Store, key: str, column: str) -> Index:
        at = store.snapshot()
        cells = at.table("cells").orderBy("cell").collect()
        books: dict[int, list] = {}
        for row in at.table("books").orderBy("slice", "code").collect():
            books.setdefault(row["slice"], []).append(row["centre"])
        return cls(at, key, column, np.array([r["centre"] for r in cells], dtype=np.float64), [np.array(books[s]) for s in sorted(books)], at.table("settings").first()["share"])

    @property
    def width(self) -> int:
        return self.cells.shape[1]

    def points(self, columns: list[str]) -> DataFrame:
        """Points that are not deleted."""
        rows = self.at.table("points", list(dict.fromkeys([self.key, "added", *columns])))
        if "gone" in self.at.tables:
            gone = self.at.table("gone").groupBy(self.key).agg(F.max("removed").alias("removed"))
            rows = rows.join(gone, self.key, "left").where(F.col("removed").isNull() | (F.col("removed") < F.col("added")))
        return rows.select(list(dict.fromkeys([self.key, *columns])))

    def probes(self, share: float | None) -> int:
        """A share of the cells as their number; none: that which the index was tried with."""
        return max(1, int(np.ceil((self.share if share is None else share) * len(self.cells))))


def encode(x: np.ndarray, cells: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(cell, code bytes) of unit vectors."""
    own = closest(x, cells)
    rest = x - cells[own]
    return own, np.stack([closest(rest[:, k * SLICE : (k + 1) * SLICE], book) for k, book in enumerate(books)], axis=1).astype(np.uint8)


def fit(vectors: DataFrame, key: str, column: str, width: int, cells: int | None = None, sample: int = SAMPLE) -> tuple[np.ndarray, list[np.ndarray]]:
    """Cells, about the root of the number of vectors, and codebooks, from about ``sample`` rows chosen by a hash of their keys."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    cells = min(MOST_CELLS, cells or max(1, round(n**0.5)))

    def units(batches):
        for batch in batches:
            x = unit(matrix(batch.column(0), width))
            yield pa.RecordBatch.from_arrays([pa.array(list(x[np.isfinite(x).all(axis=1)]), pa.list_(pa.float64()))], ["x"])

    share = F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_003)) < int(1_000_003 * min(1.0, sample / max(1, n))) + 1
    some = vectors.where(share).select(column).mapInArrow(units, "x array<double>").persist()
    found = KMeans(k=cells, seed=7, maxIter=10, featuresCol="v").fit(some.select(array_to_vector("x").alias("v"))).clusterCenters()
    centres = unit(np.unique(np.array(found), axis=0))
    centres = centres[np.isfinite(centres).all(axis=1)]

    def slices(batches):
        for batch in batches:
            x = matrix(batch.column(0), width)
            x = x - centres[closest(x, centres)]
            for at in range(0, width, SLICE):
                part = x[:, at : at + SLICE]
                yield pa.RecordBatch.from_arrays([pa.array([at // SLICE] * len(part), pa.int32()), pa.array(list(part), pa.list_(pa.float64()))], ["slice", "x"])

    def book(group: pa.Table) -> pa.Table:
        own, x = group.column("slice")[0].as_py(), np.array(group.column("x").to_pylist(), dtype=np.float64)
        centre = codebook(x)
        return pa.table({"slice": pa.array([own] * len(centre), pa.int32()), "code": pa.array(range(len(centre)), pa.int32()), "centre": pa.array(list(centre), pa.list_(pa.float64()))})

    rows = some.mapInArrow(slices, "slice int, x array<double>").groupBy("slice").applyInArrow(book, "slice int, code int, centre array<double>").orderBy("slice", "code").collect()
    some.unpersist()
    books: dict[int, list] = {}
    for row in rows:
        books.setdefault(row["slice"], []).append(row["centre"])
    return centres, [np.array(books[s]) for s in sorted(books)]


def create(change: Transaction, vectors: DataFrame, key: str, column: str, width: int, cells: int | None = None) -> None:
    """A new index over vectors (key, column, and columns to filter by). Vectors that are null, of another width or without a
    direction take no part; the dimension has to be a multiple of SLICE."""
    if width % SLICE:
        raise ValueError(f"{width} is not a multiple of {SLICE}")
    centres, books = fit(vectors, key, column, width, cells)
    spark = vectors.sparkSession
    change.append("cells", spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1))
    change.append("books", spark.createDataFrame([(s, k, c.tolist()) for s, book in enumerate(books) for k, c in enumerate(book)], "slice int, code int, centre array<double>").coalesce(1))
    rows = add(change, vectors, key, column, centres, books)
    change.append("settings", spark.createDataFrame([(share_needed(rows, key, column, centres),)], "share double").coalesce(1))


def share_needed(rows: DataFrame, key: str, column: str, cells: np.ndarray) -> float:
    """The least share of cells, nearest first, that hold REACHED of the true neighbours of TRIED points."""
    width, n = cells.shape[1], rows.count()
    tried = rows.where(F.pmod(F.xxhash64(key, F.lit(1)), F.lit(1_000_003)) < int(1_000_003 * min(1.0, TRIED / max(1, n))) + 1).select(F.col(key).alias("q"), column)
    pairs = exact_all(rows, key, column, tried, "q", width, NEIGHBOURS).join(rows.select(key, "cell"), key).groupBy("q").agg(F.collect_list("cell").alias("cells"))
    places = []
    for row in pairs.join(tried, "q").select("cells", column).collect():
        order = np.argsort(-(cells @ unit(np.array([row[1]], dtype=np.float64))[0]), kind="stable")
        where = np.empty(len(order), dtype=np.int64)
        where[order] = np.arange(len(order))
        places += where[row["cells"]].tolist()
    return float(np.quantile(places, REACHED, method="higher") + 1) / len(cells) if places else 1.0


def add(change: Transaction, vectors: DataFrame, key: str, column: str, cells: np.ndarray, books: list[np.ndarray]) -> DataFrame:
    """More points, in the files of their cells; a large cell is dealt over several tasks, so no task has more than
    about CELL_ROWS of it. Returns them with their cells."""
    width, at = cells.shape[1], change.base.version + 1
    schema = StructType([*vectors.schema.fields, StructField("cell", IntegerType()), StructField("code", BinaryType())])

    def coded(batches):
        for batch in batches:
            x = unit(matrix(batch.column(column), width))
            good = np.isfinite(x).all(axis=1)
            own, code = encode(x[good], cells, books)
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(own, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], schema.names)

    rows = change.stage(vectors.mapInArrow(coded, schema))
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts_"))  # a row for each cell, MOST_CELLS at most
    rows = rows.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64(key), F.col("parts_")).cast("int")).withColumn("added", F.lit(at).cast("long"))
    change.append("points", rows.drop("parts_").repartition("cell", "part").sortWithinPartitions("cell", key), by=["cell"])
    return rows


def delete(change: Transaction, keys: DataFrame, key: str) -> None:
    """Points with these keys are deleted; the same keys may be added again in a later commit."""
    change.append("gone", keys.select(key).distinct().withColumn("removed", F.lit(change.base.version + 1).cast("long")))


def compact(change: Transaction, index: Index) -> None:
    """The live points alone, and no deletions."""
    change.read("points")
    names = [f["name"] for f in index.at.tables["points"]["schema"]["fields"]]
    change.replace("points", index.points(names).select(names).repartition("cell", "part").sortWithinPartitions("cell", index.key), by=["cell"])
    if change.has("gone"):
        change.replace("gone", index.at.table("gone").limit(0))


def near_cells(index: Index, query: np.ndarray, share: float | None) -> np.ndarray:
    return np.argsort(-(index.cells @ query), kind="stable")[: index.probes(share)]


def search_one(index: Index, query: list[float], k: int, probes: float | None = None, pool: int = POOL, where: str | None = None) -> DataFrame:
    """(key, score): about the k nearest points by cosine. ``probes`` is the share of the cells whose codes are read (none:
    what the index was tried with), whose best ``pool`` times k have their vectors scored; ``where`` filters points by columns that they were added with."""
    q = unit(np.array([query], dtype=np.float64))[0]
    cells = near_cells(index, q, probes).tolist()
    table, base = [book @ q[s * SLICE : (s + 1) * SLICE] for s, book in enumerate(index.books)], index.cells @ q

    def guess(batches):
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(-1, len(table))
            score = base[batch.column("cell").to_numpy()] + sum(t[codes[:, s]] for s, t in enumerate(table))
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("cell"), pa.array(score)], ["k", "cell", "guess"])

    names = [f["name"] for f in index.at.tables["points"]["schema"]["fields"] if f["name"] not in ("code", index.column, "added", "part")]
    rows = index.points([*names, "code"]).where(F.col("cell").isin(cells))
    rows = (rows.where(where) if where else rows).select(F.col(index.key).alias("k"), "cell", "code")
    kind = rows.schema["k"].dataType.simpleString()
    best = rows.mapInArrow(guess, f"k {kind}, cell int, guess double").orderBy(F.desc("guess"), "k").limit(pool * k)
    vectors = index.points(["cell", index.column]).where(F.col("cell").isin(cells))
    # pool * k rows at most
    held = vectors.join(F.broadcast(best.select(F.col("k").alias(index.key))), index.key, "left_semi")
    return search.nearest(held, index.key, index.column, q.tolist(), k)


def dealt(sizes: dict[int, int], most: int) -> tuple[dict[int, list[int]], int]:
    """(the blocks that each cell's points are dealt over, number of blocks): small cells share a block, large ones have several; no block has more than about ``most`` points."""
    blocks: dict[int, list[int]] = {}
    at, held = 0, 0
    for cell, n in sorted(sizes.items()):
        parts = -(-n // most)
        for _ in range(parts):
            if held and held + n / parts > most:
                at, held = at + 1, 0
            blocks.setdefault(cell, []).append(at)
            held += n / parts
    return blocks, at + 1


def search_all(index: Index, queries: DataFrame, query_id: str, vector: str, k: int, probes: float | None = None, pool: int = POOL) -> DataFrame:
    """(query_id, key, score, rank) of about the k nearest points of each query. Points are dealt over blocks of cells, queries
    go to the blocks that hold some of the cells nearest to them, and each block keeps a query's best of all its cells. Blocks
    and what they keep are dealt over tasks by their number."""
    width, books, cells, key, many, probed = index.width, index.books, index.cells, index.key, pool * k, index.probes(probes)
    qkind, kkind = queries.schema[query_id].dataType.simpleString(), index.points([]).schema[key].dataType.simpleString()
    spark, points = queries.sparkSession, index.points(["cell", "code"]).select(F.col(key).alias("k"), "cell", "code")
    # a row for each cell, MOST_CELLS at most
    blocks, n_blocks = dealt({r["cell"]: r["count"] for r in points.groupBy("cell").count().collect()}, max(1, BLOCK_BYTES // (4 * width)))
    asked_rows = queries.count()
    loads, tasks = max(1, -(-asked_rows // QUERY_ROWS)), shares.tasks(spark, asked_rows * n_blocks * many)
    holds = np.zeros((len(cells), n_blocks), dtype=bool)
    for cell, own in blocks.items():
        holds[cell, own] = True

    def sent(batches):
        for batch in batches:
            x = unit(matrix(batch.column("x"), width))
            good = np.flatnonzero(np.isfinite(x).all(axis=1))
            near = np.argsort(-(x[good] @ cells.T), axis=1, kind="stable")[:, :probed]
            chosen = np.zeros((len(good), len(cells)), dtype=bool)
            np.put_along_axis(chosen, near, True, axis=1)
            row, block = np.nonzero(chosen.astype(np.float32) @ holds.astype(np.float32))
            bits = [b.tobytes() for b in np.packbits(chosen, axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column("q").take(pa.array(good[row])), pa.array(block, pa.int32()), pa.array(list(x[good[row]]), pa.list_(pa.float64())), pa.array([bits[r] for r in row], pa.binary())], ["q", "block", "x", "cells"])

    def guess(left: pa.Table, right: pa.Table) -> pa.Table:
        names, types = ["q", "k", "cell", "guess"], [left.schema.field("q").type, right.schema.field("k").type, pa.int32(), pa.float64()]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in types], names)
        right = right.sort_by([("cell", "ascending"), ("k", "ascending")])
        own = right.column("cell").to_numpy()
        codes = np.frombuffer(b"".join(right.column("code").to_pylist()), dtype=np.uint8).reshape(-1, len(books))
        # what the codes say of the points, in single precision: a guess is all that is made of it
        about = cells.astype(np.float32)[own]
        for s, book in enumerate(books):
            about[:, s * SLICE : (s + 1) * SLICE] += book.astype(np.float32)[codes[:, s]]
        here, first = np.unique(own, return_index=True)
        ends = [*first[1:].tolist(), len(own)]
        places = [np.arange(i, j) for i, j in zip(first.tolist(), ends, strict=True)]
        x = matrix(left.column("x"), width).astype(np.float32)
        chosen = np.unpackbits(np.frombuffer(b"".join(left.column("cells").to_pylist()), dtype=np.uint8).reshape(len(x), -1), axis=1)[:, here].astype(bool)
        at, held, scores = [], [], []
        step = max(1, BLOCK_BYTES // (4 * len(own)))
        for start in range(0, len(x), step):
            part, ask = x[start : start + step], chosen[start : start + step]
            score, where = [[] for _ in part], [[] for _ in part]
            for c, place in enumerate(places):
                rows = np.flatnonzero(ask[:, c])
                for row, found in zip(rows.tolist(), part[rows] @ about[place[0] : place[-1] + 1].T, strict=True):
                    score[row].append(found)
                    where[row].append(place)
            for row in range(len(part)):
                if score[row]:
                    s, w = np.concatenate(score[row]), np.concatenate(where[row])
                    best = np.argpartition(-s, many)[:many] if len(s) > many else np.arange(len(s))
                    at.append(np.full(len(best), start + row))
                    held.append(w[best])
                    scores.append(s[best])
        at, held, scores = (np.concatenate(part) if part else np.zeros(0, np.int64) for part in (at, held, scores))
        return pa.table([left.column("q").take(pa.array(at)), right.column("k").take(pa.array(held)), pa.array(own[held], pa.int32()), pa.array(scores.astype(np.float64))], names)

    group = ["block", "load"]
    asked = queries.select(F.col(query_id).alias("q"), F.col(vector).alias("x")).mapInArrow(sent, f"q {qkind}, block int, x array<double>, cells binary")
    asked = asked.withColumn("load", F.pmod(F.xxhash64("q"), F.lit(loads)).cast("int")).repartition(tasks, *group)
    known = F.broadcast(spark.createDataFrame(list(blocks.items()), "cell int, blocks array<int>"))
    share = F.pmod(F.xxhash64("k"), F.size("blocks")).cast("int")
    points = points.join(known, "cell").select("k", "cell", "code", F.get("blocks", share).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(loads - 1))).alias("load")).repartition(tasks, *group)
    found = asked.groupBy(*group).cogroup(points.groupBy(*group)).applyInArrow(guess, f"q {qkind}, k {kkind}, cell int, guess double").repartition(tasks, "q")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("guess"), "k"))
    best = found.withColumn("place", place).where(F.col("place") <= many).select("q", "k", "cell")
    vectors = index.points(["cell", index.column]).select(F.col(key).alias("k"), "cell", F.col(index.column).alias("v"))
    scored = best.join(vectors, ["cell", "k"]).join(queries.select(F.col(query_id).alias("q"), F.col(vector).alias("x")), "q").select("q", "k", search.cosine(F.col("x"), F.col("v")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "k"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("k").alias(key), "score", "rank")


def exact_all(vectors: DataFrame, key: str, column: str, queries: DataFrame, query_id: str, width: int, k: int) -> DataFrame:
    """(query_id, key): the k nearest vectors of each query, by products of blocks of queries and of vectors."""
    def packed(name: str):
        def run(batches):
            for batch in batches:
                x = unit(matrix(batch.column(1), width))
                good = np.flatnonzero(np.isfinite(x).all(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).take(pa.array(good)).to_pylist()], pa.list_(batch.schema.field(0).type)), pa.array([x[good].tobytes()], pa.binary())], [f"{name}_ids", name])

        return run

    kinds = queries.schema[query_id].dataType.simpleString(), vectors.schema[key].dataType.simpleString()
    left = queries.select(query_id, column).mapInArrow(packed("a"), f"a_ids array<{kinds[0]}>, a binary")
    right = vectors.select(key, column).mapInArrow(packed("b"), f"b_ids array<{kinds[1]}>, b binary")

    def scored(batches):
        for batch in batches:
            for a_ids, a, b_ids, b in zip(*(batch.column(c).to_pylist() for c in ("a_ids", "a", "b_ids", "b")), strict=True):
                x, y, ids = np.frombuffer(a).reshape(-1, width), np.frombuffer(b).reshape(-1, width), pa.array(b_ids)
                # so many queries at a time that their scores are BLOCK_BYTES
                step = max(1, BLOCK_BYTES // (8 * max(1, len(y))))
                for start in range(0, len(x), step):
                    score = x[start : start + step] @ y.T
                    best = np.argpartition(-score, k, axis=1)[:, :k] if len(b_ids) > k else np.tile(np.arange(len(b_ids)), (len(score), 1))
                    q = pa.array(a_ids[start : start + step]).take(pa.array(np.repeat(np.arange(len(score)), best.shape[1])))
                    yield pa.RecordBatch.from_arrays([q, ids.take(pa.array(best.ravel())), pa.array(np.take_along_axis(score, best, axis=1).ravel())], ["q", "k", "score"])

    rows = left.crossJoin(right).mapInArrow(scored, f"q {kinds[0]}, k {kinds[1]}, score double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "k"))
    return rows.withColumn("place", place).where(F.col("place") <= k).select(F.col("q").alias(query_id), F.col("k").alias(key))


def recall(found: DataFrame, wanted: DataFrame, keys: list[str]) -> float:
    """The share of wanted pairs that were found."""
    hits = wanted.join(found.select(*keys), keys, "left_semi").count()
    return hits / max(1, wanted.count())


def of_path(vectors: DataFrame, key: str, column: str, width: int, spark: SparkSession, folder: str) -> Index:
    """The index in a folder, built if none is there; of two builders one commits, and both use its index."""
    store = Store(spark, folder)
    store.run(lambda change: create(change, vectors, key, column, width), writer="built", token=1)
    return Index.open(store, key, column)
