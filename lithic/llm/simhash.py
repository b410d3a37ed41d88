"""Near-duplicate documents by 64-bit SimHash and the generalised pigeonhole principle.

Fingerprints: every 4-word shingle's XXH64; a bit is set where over half the hashes set it.
Links: two fingerprints that differ in at most four bits.

Search (general pigeonhole, Qin et al. 2018): the 64 bits are dealt into four partitions of
sixteen, correlated bits together. If thresholds t_i satisfy sum(t_i + 1) = 5, two fingerprints
within four bits agree within t_i in some partition i; t_i = -1 leaves a partition out. Each
fingerprint's thresholds come from a dynamic program over its candidate counts, read from the
partitions' exact histograms. It is stored under its own four values and probes the balls around
them; what meets in a bucket is verified on all 64 bits.

Scale: only distinct fingerprints are linked, so copies cost one row. The histograms have at most
4 x 65,536 cells whatever the corpus. A bucket that stores over ``SPLIT`` fingerprints is not
scanned whole: its rows agree on the partition but for the probe's ball, so a link needs one of
five groups of the other 48 bits to agree, and the rows are dealt again by those groups. Inside a
bucket a breadth-first sweep takes linked rows out as it meets them, so a dense group costs about
its size and leaves as a spanning tree, not as its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import Forest, components
from .shared import alone, cut, heavy_keys, sorted_groups, spread_join, table

MOST_BITS = 4
PARTS, WIDTH, SUBS = 4, 16, 5
#: Stored fingerprints in a bucket from which on it is dealt again by a second key.
SPLIT = 4096
#: What one emitted row costs, in comparisons.
ROW_COST = 100.0
SHINGLE, SEED = 4, 42


def fingerprint(raw: bytes | None) -> int:
    """SimHash of a text's UTF-8 bytes. Null and wordless texts: 0."""
    words = raw.lower().split() if raw else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - SHINGLE + 1].tolist()
    stops = ends[SHINGLE - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    n = len(starts)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        some = zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=True)
        hashes = np.array([digest(line[a:b], SEED) for a, b in some], dtype=np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * counts > n)))


def _fingerprints(batches):
    alone("simhash")
    for batch in batches:
        found = [fingerprint(x) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(found, dtype=np.uint64).view(np.int64)), batch.column("digest")], ["doc_id", "fp", "digest"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long, digest) per row of docs; fp holds the fingerprint's 64 bits, digest is a hash of the text."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("digest")).mapInArrow(_fingerprints, "doc_id long, fp long, digest long")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _pair_counts(batches):
    total = np.zeros((64, 64), dtype=np.int64)
    for batch in batches:
        x = _bits(batch.column("fp").to_numpy().view(np.uint64)).astype(np.float32)
        total += (x.T @ x).astype(np.int64)
    i, j = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "n"])


def deal_bits(together: np.ndarray, n: int) -> list[list[int]]:
    """Four lists of sixteen bits: each list starts with the strongest correlated pair left and
    takes the bit nearest to it until it is full."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    like = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(like, -1)
    left, dealt = set(range(64)), []
    for _ in range(PARTS):
        some = sorted(left)
        at = np.unravel_index(np.argmax(like[np.ix_(some, some)]), (len(some), len(some)))
        part = [some[at[0]], some[at[1]]]
        while len(part) < WIDTH:
            rest = sorted(left - set(part))
            part.append(rest[int(np.argmax(like[np.ix_(rest, part)].sum(axis=1)))])
        dealt.append(sorted(part))
        left -= set(part)
    return dealt


def pick(fps: np.ndarray, places: list[int]) -> np.ndarray:
    """The bits of fps at these places, packed into one number."""
    out = np.zeros(len(fps), dtype=np.int64)
    for k, place in enumerate(places):
        out |= ((fps >> np.uint64(place)) & np.uint64(1)).astype(np.int64) << k
    return out


def _histogram(deal):
    def run(batches):
        total = np.zeros((PARTS, 1 << WIDTH), dtype=np.int64)
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for i, places in enumerate(deal):
                total[i] += np.bincount(pick(fps, places), minlength=1 << WIDTH)
        i, v = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(v.astype(np.int32)), pa.array(total[i, v])], ["i", "v", "n"])

    return run


#: Flips of a partition's value by ball radius.
FLIPS = [np.array([0]), np.array([1 << a for a in range(WIDTH)]), np.array([1 << a | 1 << b for a in range(WIDTH) for b in range(a)])]
MOST_T = len(FLIPS) - 1


def ball_counts(histogram: np.ndarray) -> np.ndarray:
    """[part, t + 1, value]: stored fingerprints within t of the value, plus the cost of the probes."""
    out = np.zeros((PARTS, MOST_T + 2, 1 << WIDTH), dtype=np.float64)
    values = np.arange(1 << WIDTH)
    for i in range(PARTS):
        for t, flips in enumerate(FLIPS):
            out[i, t + 1] = out[i, t] + sum(histogram[i][values ^ f] for f in flips) + ROW_COST * (len(flips) if t else 0)
    return out


def thresholds(costs: np.ndarray) -> np.ndarray:
    """costs [part, t + 1, row] -> t + 1 per [part, row], of least cost with a sum of MOST_BITS + 1."""
    rows, goal = costs.shape[2], MOST_BITS + 1
    best = np.full((goal + 1, rows), np.inf)
    best[0] = 0
    took = np.zeros((PARTS, goal + 1, rows), dtype=np.int8)
    for i in range(PARTS):
        now = np.full_like(best, np.inf)
        for total in range(goal + 1):
            for t in range(min(total, MOST_T + 1) + 1):
                cost = best[total - t] + costs[i, t]
                less = cost < now[total]
                now[total][less] = cost[less]
                took[i, total][less] = t
        best = now
    out, left = np.zeros((PARTS, rows), dtype=np.int8), np.full(rows, goal)
    for i in reversed(range(PARTS)):
        out[i] = took[i, left, np.arange(rows)]
        left -= out[i]
    return out


def _signatures(deal, histogram, costs):
    others = [[place for k, part in enumerate(deal) if k != i for place in part] for i in range(PARTS)]
    cuts = np.linspace(0, WIDTH * (PARTS - 1), SUBS + 1).astype(int)

    def keys(i: int, value: np.ndarray, fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(key, fingerprint) rows of bucket (i, value); a hot bucket is dealt again."""
        key = (np.int64(i) << 32) | (value << 16)
        hot = histogram.value[i][value] > SPLIT
        rows = [(key[~hot], fps[~hot])]
        if hot.any():
            for j in range(SUBS):
                sub = pick(fps[hot], others[i][cuts[j] : cuts[j + 1]])
                rows.append((key[hot] | (np.int64(j + 1) << 12) | sub, fps[hot]))
        return rows

    def run(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(fps), 4096):
                some = fps[at : at + 4096]
                values = [pick(some, places) for places in deal]
                took = thresholds(np.stack([costs.value[i][:, values[i]] for i in range(PARTS)]))
                rows: list[tuple[np.ndarray, np.ndarray, int]] = []
                for i in range(PARTS):
                    rows += [(*r, 1) for r in keys(i, values[i], some)]
                    for t in range(1, MOST_T + 1):
                        probes = took[i] > t
                        if not probes.any():
                            continue
                        around = (values[i][probes][:, None] ^ FLIPS[t][None, :]).ravel()
                        stored = histogram.value[i][around] > 0
                        rows += [(*r, 0) for r in keys(i, around[stored], np.repeat(some[probes], len(FLIPS[t]))[stored])]
                key = np.concatenate([r[0] for r in rows])
                fp = np.concatenate([r[1] for r in rows]).view(np.int64)
                own = np.concatenate([np.full(len(r[0]), r[2], dtype=np.int8) for r in rows])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp), pa.array(own)], ["key", "fp", "own"])

    return run


def sweep(stored: np.ndarray, probes: np.ndarray, forest: Forest) -> None:
    """Put into forest a spanning tree of the links between stored rows and of probes to them."""
    left = np.concatenate([stored, probes])
    is_stored = np.arange(len(left)) < len(stored)
    while len(left) and is_stored[0]:
        front = [(left[0], True)]
        left, is_stored = left[1:], is_stored[1:]
        while front and len(left):
            at, own = front.pop()
            near = np.bitwise_count(left ^ at) <= MOST_BITS
            if not own:
                near &= is_stored
            if near.any():
                one = int(at.view(np.int64))
                for x, s in zip(left[near], is_stored[near], strict=True):
                    forest.join(one, int(x.view(np.int64)))
                    front.append((x, bool(s)))
                left, is_stored = left[~near], is_stored[~near]


def _verify(batches):
    forest = Forest()
    for key, (fp, own) in sorted_groups(batches, "key", ["fp", "own"]):
        fps = fp.view(np.uint64)
        edges = np.flatnonzero(np.diff(key)) + 1
        starts = np.concatenate([[0], edges])
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        small = sizes <= 48
        inside = np.repeat(small, sizes)
        skey, sfp, sown = key[inside], fps[inside], own[inside]
        for shift in range(1, int(sizes[small].max(initial=1))):
            near = (skey[shift:] == skey[:-shift]) & ((sown[shift:] | sown[:-shift]) == 1)
            near &= np.bitwise_count(sfp[shift:] ^ sfp[:-shift]) <= MOST_BITS
            hit = np.flatnonzero(near)
            for a, b in zip(sfp[hit].view(np.int64).tolist(), sfp[hit + shift].view(np.int64).tolist(), strict=True):
                forest.join(a, b)
        for at, size in zip(starts[~small], sizes[~small], strict=True):
            group, mine = fps[at : at + size], own[at : at + size] == 1
            sweep(group[mine], group[~mine], forest)
    a, b = forest.star()
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that span the link graph of the distinct fingerprints ``fp`` of nodes."""
    sc = nodes.sparkSession.sparkContext
    fps = nodes.select("fp")
    pairs = fps.mapInArrow(_pair_counts, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    together = np.zeros((64, 64))
    for i, j, n in pairs:
        together[i, j] = n
    deal = deal_bits(together, max(int(np.diag(together).max()), fps.count()))
    cells = fps.mapInArrow(_histogram(deal), "i int, v int, n long").groupBy("i", "v").agg(F.sum("n").alias("n")).toArrow()
    histogram = np.zeros((PARTS, 1 << WIDTH), dtype=np.int64)
    histogram[cells.column("i").to_numpy(), cells.column("v").to_numpy()] = cells.column("n").to_numpy()
    signatures = _signatures(deal, sc.broadcast(histogram), sc.broadcast(ball_counts(histogram).astype(np.float32)))
    rows = fps.mapInArrow(signatures, "key long, fp long, own byte")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_verify, "a long, b long")


def labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, digest, root, component_id) per row of docs; root is the component's least fingerprint."""
    fps = cut(fingerprints(docs))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    linked = cut(components(links(nodes)).withColumnRenamed("node", "fp").join(nodes.select("fp", "least"), "fp"))
    roots = cut(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    named = spread_join(linked.drop("least"), roots.drop("n"), "root", heavy_keys(roots, "root", "n"))
    labels = nodes.select("fp", "least").join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return spread_join(fps, labels, "fp", heavy_keys(nodes, "fp", "n"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of docs.

    Null text counts as empty: fingerprint zero, linked like any other; a text of any length is read whole.
    component_id is the smallest non-null doc_id of the component. Rows that share a doc_id are judged each by
    its own text, and repeated rows are returned as often as they come. Other columns of docs are not read,
    whatever their names. No rows: no rows.
    """
    return labelled(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs of each component: that of the smallest doc_id, a null one last, and of several texts
    with that id the one of least hash; of rows equal in both, any one. All columns are kept."""
    rows = cut(labelled(docs.select("doc_id", "text")))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("s")).select(F.col("s.doc_id").alias("i"), F.col("s.digest").alias("d"))
    often = rows.groupBy(F.col("doc_id").alias("i2"), F.col("digest").alias("d2")).count().where("count > 1").drop("count")
    first = cut(first.join(often, F.col("i").eqNullSafe(F.col("i2")) & (F.col("d") == F.col("d2")), "left").select("i", "d", F.col("d2").isNotNull().alias("again")))
    key = [F.col("row.doc_id").cast("long"), F.xxhash64(F.col("row.text"))]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def those(firsts: DataFrame) -> DataFrame:
        return whole.join(firsts, key[0].eqNullSafe(F.col("i")) & (key[1] == F.col("d")))

    kept = those(first.where("not again").drop("again"))
    if first.where("again").limit(1).count():
        kept = kept.unionByName(those(first.where("again").drop("again")).dropDuplicates(["i", "d"]))
    return kept.select("row.*")
