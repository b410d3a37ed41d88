"""Removal of repeated 50-byte strings by merging Burrows-Wheeler transforms of shards.

Documents are dealt into blocks, and each is cut into segments: runs of 50-byte windows that share a
minimiser, the 16-byte string of least hash in the window. Equal windows have equal minimisers, so the bucket
that owns a minimiser sees every copy of its windows. It is first told which segments there are, by hash, and
says of each what is to be done: a segment of a minimiser that one document alone holds has no copy, a segment
whose equal has a smaller owner is a copy as a whole, and what is left, segments that may share a part with
others, is merged. For that each block sorts the suffixes of its segments for a bucket once and sends their
transform. The bucket merges the blocks' transforms: starting from their concatenation, a pass reads the
interleaved suffixes in order and appends each one's predecessor to the bin of its preceding byte, so that
after pass k the suffixes are interleaved by their first k bytes and the places where a byte or the former
interval changes are where the common prefix is shorter than k. Suffixes alone in their interval are settled and drop
out, and those too near their segment's start to lead to a window are left out. After 50 passes the intervals left are the repeated 50-byte strings; no suffix was sorted again.

Scale: texts are shuffled once, compressed. A block sends a bucket one row with its distinct segments' hashes
and one with the transform of those to be merged; copies are known by hash and never sent as text. A minimiser
of more than ``FULL`` different segments is split by the two next least strings of the window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .substrings import CHUNK, NOBODY, _Powers, mixed, packed, shard_of, unpacked

WINDOW, GRAM = 50, 16
#: Most windows in a segment.
RUN = 64
BLOCK_BYTES, BUCKET_BYTES, LEAST_BUCKETS, MOST_TASKS = 4_000_000, 8_000_000, 96, 100_000
#: A minimiser with more different segments is split.
FULL = 4_000
ALONE, COPY, MERGED, SPLIT = range(4)
LAST = np.iinfo(np.uint64).max


def gram_hashes(line: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place of line."""
    words = np.ndarray((len(line) - 7,), dtype="<u8", buffer=line, strides=(1,)).copy()
    return mixed(mixed(words[:-8]) + words[8:])


def least_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` hashes from each place."""
    got, k = hashes, 1
    while 2 * k <= width:
        got, k = np.minimum(got[:-k], got[k:]), 2 * k
    return np.minimum(got[: len(got) - (width - k)], got[width - k :]) if k < width else got


def runs(keys: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, count) of the runs of equal keys among the places inside, none longer than RUN."""
    starts = inside & np.concatenate([[True], (keys[1:] != keys[:-1]) | ~inside[:-1]])
    first = np.flatnonzero(starts)
    if not len(first):
        return first, first
    held = np.diff(np.cumsum(np.concatenate([[0], inside]))[np.concatenate([first, [len(keys)]])])
    parts = -(-held // RUN)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(first, parts) + nth * RUN, np.minimum(np.repeat(held, parts) - nth * RUN, RUN)


def content_hashes(grams: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run's bytes, from the hashes of their strings of GRAM bytes."""
    out, ends = np.zeros(len(first), dtype=np.uint64), first + count + WINDOW - GRAM
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(ends, first[at] + CHUNK)))
        zero, n = first[at], int(ends[to - 1] - first[at])
        up, down = _Powers.of(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(grams[zero : zero + n] * up[:n], out=sums[1:])
        a, b = first[at:to] - zero, ends[at:to] - zero
        out[at:to] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
        at = to
    return mixed(out)


class Block:
    """A block's documents, in an order that does not depend on how they came, cut into segments, which are
    told apart by key and hash. Rows are (doc_id, text's bytes, times); those without id have no segments."""

    def __init__(self, rows: list[tuple], buckets: int) -> None:
        self.rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        self.sizes = np.array([len(r[1]) for r in self.rows], dtype=np.int64)
        self.begins = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.line = np.frombuffer(b"\0".join([*(r[1] for r in self.rows), bytes(2 * WINDOW)]), dtype=np.uint8)
        self.grams = gram_hashes(self.line)
        keys = least_of(self.grams, WINDOW - GRAM + 1)
        edge = np.zeros(len(keys) + 1, dtype=np.int8)
        some = (self.sizes >= WINDOW) & np.array([r[0] is not None for r in self.rows], dtype=bool)
        edge[self.begins[some]] += 1
        edge[(self.begins + self.sizes - WINDOW + 1)[some]] -= 1
        self.at, self.count = runs(keys, np.cumsum(edge[:-1], dtype=np.int8) > 0)
        ids = np.array([NOBODY if r[0] is None else r[0] for r in self.rows], dtype=np.int64)
        self.owner = ids[np.searchsorted(self.begins, self.at, side="right") - 1] if len(self.at) else ids[:0]
        key, content = keys[self.at], content_hashes(self.grams, self.at, self.count)
        _, heads, self.which = np.unique(content, return_index=True, return_inverse=True)
        if (key[heads][self.which] != key).any():
            _, heads, self.which = np.unique(np.stack([content, key]), axis=1, return_index=True, return_inverse=True)
        # documents come in the order of their ids, so a segment's first owner is its least
        self.heads, self.key, self.content, self.low = heads, key[heads], content[heads], self.owner[heads]
        high = np.zeros(len(heads), dtype=np.int64)
        high[self.which] = self.owner
        self.several, self.buckets = high != self.low, buckets
        bucket = shard_of(self.key, buckets)
        self.order = np.argsort(bucket, kind="stable")
        self.named, self.offsets = np.unique(bucket[self.order], return_index=True)

    def parts(self) -> list[np.ndarray]:
        """The segments of each bucket that is named."""
        return np.split(self.order, self.offsets[1:]) if len(self.named) else []

    def marks(self):
        """(bucket, its distinct segments: keys, hashes, first owners, which have several owners)."""
        for bucket, some in zip(self.named.tolist(), self.parts(), strict=True):
            yield bucket, packed([(self.key[some] & np.uint64(0xFFFFFFFF)).astype(np.uint32), self.content[some], self.low[some], np.flatnonzero(self.several[some]).astype(np.int32)])

    def roles(self, found: list[tuple[int, bytes]]) -> np.ndarray:
        """A segment's role, from the buckets' answers."""
        out, parts = np.zeros(len(self.heads), dtype=np.uint8), self.parts()
        for bucket, data in found:
            out[parts[int(np.searchsorted(self.named, bucket))]] = np.frombuffer(unpacked(data, [])[1], dtype=np.uint8)
        return out

    def entries(self, roles: np.ndarray) -> tuple[np.ndarray, ...]:
        """(segment, first window within it, windows, bucket) of what is to be merged, in the buckets' order."""
        whole, split = np.flatnonzero(roles == MERGED), np.flatnonzero(roles == SPLIT)
        parts = [(whole, np.zeros(len(whole), np.int64), self.count[self.heads[whole]], self.key[whole])]
        for some in np.array_split(split, max(1, 8 * len(split) * RUN // CHUNK)):
            n = self.count[self.heads[some]]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            around = self.grams[np.repeat(self.heads_at(some), n)[:, None] + nth[:, None] + np.arange(WINDOW - GRAM + 1)]
            keys = np.zeros(len(around), dtype=np.uint64)
            for _ in range(3):
                least = around.min(axis=1) if len(around) else keys
                keys = mixed(keys ^ mixed(least))
                around[around == least[:, None]] = LAST
            segment = np.repeat(some, n)
            starts = np.flatnonzero((nth == 0) | np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
            parts.append((segment[starts], nth[starts], np.diff(np.concatenate([starts, [len(keys)]])), keys[starts]))
        segment, first, windows, key = (np.concatenate(x) for x in zip(*parts, strict=True))
        bucket = shard_of(key, self.buckets)
        order = np.argsort(bucket, kind="stable")
        return segment[order], first[order], windows[order], bucket[order]

    def heads_at(self, some: np.ndarray) -> np.ndarray:
        return self.at[self.heads[some]]

    def transforms(self, roles: np.ndarray):
        """(bucket, packed transform of its entries)."""
        segment, first, windows, bucket = self.entries(roles)
        if not len(segment):
            return
        begin, size = self.heads_at(segment) + first, windows + WINDOW - 1
        text, left, entry = spread(self.line, begin, size)
        order = suffix_order(text, left, entry, bucket[entry])
        last, start = text[order - 1], (left == np.repeat(size, size + 1))[order]
        owners = self.low[segment]
        named, heads = np.unique(bucket, return_index=True)
        ends = np.cumsum(size + 1)[np.concatenate([heads[1:], [len(bucket)]]) - 1]
        for k, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
            mine = slice(heads[k], heads[k + 1] if k + 1 < len(heads) else len(bucket))
            yield int(named[k]), packed([np.flatnonzero(start[a:b]).astype(np.int32), owners[mine]], last[a:b].tobytes())


def spread(line: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts line[begin:begin+size] one after the other, a divider behind each: bytes, bytes left of the part, part."""
    width = size + 1
    entry = np.repeat(np.arange(len(size)), width)
    left = np.repeat(np.cumsum(width), width) - np.arange(width.sum()) - 1
    text = line[np.repeat(begin + size, width) - left].copy()
    text[left == 0] = 0
    return text, left, entry


def suffix_order(text: np.ndarray, left: np.ndarray, entry: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Suffixes of parts in order, bucket by bucket: a part ends below all bytes, and equal suffixes stand in the order of their parts."""
    n = len(text)
    words = np.ndarray((n,), dtype=">u8", buffer=np.concatenate([text, np.zeros(8, np.uint8)]), strides=(1,)).astype(np.uint64)
    short = np.flatnonzero(left < 8)
    words[short] &= ~(LAST >> (8 * left[short]).astype(np.uint64))
    order = np.argsort(words)
    rank = np.zeros(n, dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate([[False], np.diff(words[order]) != 0]))
    # parts come bucket by bucket, and in order; an end settles an order, as the sort is stable
    bucket = np.cumsum(np.concatenate([[False], bucket[1:] != bucket[:-1]]))
    key = (bucket * (int(rank.max()) + 1) + rank) * 9 + np.minimum(left, 8)
    order = np.argsort(key, kind="stable")
    fresh = np.concatenate([[True], np.diff(key[order]) != 0]) | (left[order] < 8)
    some, width = np.arange(n), 8
    while True:
        heads = np.flatnonzero(fresh)
        sizes = np.diff(np.concatenate([heads, [len(some)]]))
        rank[order[some]] = np.repeat(some[heads], sizes)
        some = some[np.repeat(sizes, sizes) > 1]
        if not len(some):
            return order
        # within its group a suffix goes by the rank of what comes ``width`` later, which no end hides
        mine = order[some]
        key = rank[mine] * np.int64(n) + rank[mine + width]
        by = np.argsort(key)
        order[some], fresh = mine[by], np.concatenate([[True], np.diff(key[by]) != 0])
        width *= 2


def merged(pieces: list[tuple[np.ndarray, np.ndarray]], depth: int = WINDOW):
    """The strings of ``depth`` bytes that come twice or more in the parts behind several transforms.

    A transform is (preceding bytes in suffix order, places of the suffixes that start a part); its first
    suffixes are the empty ones, in the order of its parts. Returns (part, bytes left, interval) of each
    suffix that starts such a string, parts counted through all transforms, intervals ascending.
    """
    sizes = [len(b) for b, _ in pieces]
    offsets = np.cumsum([0, *sizes])
    before = np.concatenate([b for b, _ in pieces])
    starts = np.zeros(len(before), dtype=bool)
    back = np.zeros(len(before), dtype=np.int32)
    ends = []
    for (last, start), o in zip(pieces, offsets.tolist(), strict=False):
        starts[o + start] = True
        symbol = last.astype(np.uint16) + 1
        symbol[start] = 0
        back[o + np.argsort(symbol, kind="stable")] = np.arange(o, o + len(last), dtype=np.int32)
        ends.append(np.arange(o, o + len(start)))
    part, left = np.zeros(len(before), dtype=np.int32), np.zeros(len(before), dtype=np.int32)
    at = np.concatenate(ends)
    which, step, size = np.arange(len(at), dtype=np.int32), 0, np.zeros(len(at), dtype=np.int32)
    while len(at):
        part[at], left[at], size[which] = which, step, step
        on = ~starts[at]
        at, which, step = back[at[on]], which[on], step + 1
    # a pass goes one byte back: what stands less than ``depth`` bytes behind its part's start leads to no string
    suffix = np.flatnonzero(left <= size[part] - depth).astype(np.int32)
    interval = np.zeros(len(suffix), dtype=np.int32)
    for _ in range(depth):
        symbol = before[suffix]
        by = np.argsort(symbol, kind="stable")
        symbol, interval = symbol[by], interval[by]
        # where a byte or the former interval changes, the common prefix ends
        new = np.ones(len(by) + 1, dtype=bool)
        new[1:-1] = (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])
        more = ~(new[:-1] & new[1:])
        suffix, interval = back[suffix[by[more]]], np.cumsum(new[:-1], dtype=np.int32)[more]
        if not len(suffix):
            break
    return part[suffix], left[suffix], interval


def roles_of(found: list[tuple[int, bytes]], full: int):
    """(block, packed roles) for one bucket's marks."""
    heads = [unpacked(data, [np.uint32, np.uint64, np.int64, np.int32])[0] for _, data in found]
    key, content, low = (np.concatenate([h[i] for h in heads]) for i in range(3))
    offsets = np.cumsum([0, *[len(h[0]) for h in heads]])
    several = np.zeros(len(key), dtype=bool)
    for h, o in zip(heads, offsets.tolist(), strict=False):
        several[o + h[3]] = True
    order = np.lexsort((low, content, key))
    k, c, who = key[order], content[order], low[order]
    new_key = np.concatenate([[True], k[1:] != k[:-1]])
    new = new_key | np.concatenate([[True], c[1:] != c[:-1]])
    of_key, of_content = np.cumsum(new_key) - 1, np.cumsum(new) - 1
    n = np.bincount(of_key[new], minlength=of_key[-1] + 1)
    first, last = np.minimum.reduceat(who, np.flatnonzero(new_key)), np.maximum.reduceat(who, np.flatnonzero(new_key))
    shared = (first != last) | np.logical_or.reduceat(several[order], np.flatnonzero(new_key))
    copy = who > who[new][of_content]
    role = np.where(~shared[of_key], ALONE, np.where(copy, COPY, np.where(n[of_key] > full, SPLIT, np.where(n[of_key] > 1, MERGED, ALONE)))).astype(np.uint8)
    out = np.zeros(len(key), dtype=np.uint8)
    out[order] = role
    for (block, _), a, b in zip(found, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield block, packed([], out[a:b].tobytes())


FOUND = [np.int32, np.int32, np.int32]


def repeats_of(found: list[tuple[int, bytes]]):
    """(block, packed runs of windows that a smaller owner has too: entry, first, count) for one bucket's transforms."""
    pieces, owners = [], []
    for _, data in found:
        (starts, owner), last = unpacked(data, [np.int32, np.int64])
        pieces.append((np.frombuffer(last, dtype=np.uint8), starts))
        owners.append(owner)
    parts = np.cumsum([0, *map(len, owners)])
    part, left, interval = merged(pieces)
    if not len(part):
        return
    owner = np.concatenate(owners)[part]
    heads = np.flatnonzero(np.diff(interval, prepend=-1))
    late = owner > np.repeat(np.minimum.reduceat(owner, heads), np.diff(np.concatenate([heads, [len(part)]])))
    # windows of an entry stand by the bytes left, the first having most
    order = np.lexsort((-left[late], part[late]))
    part, left = part[late][order], left[late][order]
    new = np.concatenate([[True], (part[1:] != part[:-1]) | (left[1:] != left[:-1] - 1)])[: len(part)]
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(part)]]))
    part, left = part[first], left[first]
    for k, (block, _) in enumerate(found):
        a, b = np.searchsorted(part, parts[k : k + 2])
        if b > a:
            yield block, packed([(part[a:b] - parts[k]).astype(np.int32), left[a:b].astype(np.int32), count[a:b].astype(np.int32)])


ROWS = [np.int64, np.int32, np.int64, np.int64]


def _pack(batches):
    """(block, packed rows: ids, whether there is one, sizes, times, texts) of a batch's rows of each block; rows that are alike are sent once."""
    for batch in batches:
        times: dict[tuple, int] = {}
        for row in zip(*(batch.column(c).to_pylist() for c in ("block", "doc_id", "text")), strict=True):
            times[row] = times.get(row, 0) + 1
        by_block: dict[int, list] = {}
        for (block, doc_id, text), n in times.items():
            by_block.setdefault(block, []).append((doc_id, text or b"", n))
        out = []
        for rows in by_block.values():
            arrays = [np.array([r[0] or 0 for r in rows], np.int64), np.array([r[0] is not None for r in rows], np.int32), np.array([len(r[1]) for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)]
            out.append(packed(arrays, b"".join(r[1] for r in rows)))
        yield pa.RecordBatch.from_arrays([pa.array(list(by_block), pa.int64()), pa.array(out, pa.binary())], ["block", "data"])


def _block(group: pa.Table, buckets: int) -> Block:
    rows = []
    for data in group.column("data").to_pylist():
        (ids, known, sizes, times), tail = unpacked(data, ROWS)
        ends = np.cumsum(sizes).tolist()
        rows += [(i if k else None, tail[a:b], n) for i, k, a, b, n in zip(ids.tolist(), known.tolist(), [0, *ends[:-1]], ends, times.tolist(), strict=True)]
    return Block(rows, buckets)


SENT = "bucket int, block long, kind string, data binary"


def _sent(block: int, rows: list[tuple[int, str, bytes]]) -> pa.Table:
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int64()), "kind": pa.array([r[1] for r in rows], pa.string()), "data": pa.array([r[2] for r in rows], pa.binary())})


def _mark(buckets: int):
    return lambda group: _sent(group.column("block")[0].as_py(), [(b, "mark", data) for b, data in _block(group, buckets).marks()])


def _pairs(found: pa.Table, kind: str) -> list[tuple[int, bytes]]:
    return [(b, data) for b, k, data in zip(*(found.column(c).to_pylist() for c in ("bucket", "kind", "data")), strict=True) if k == kind]


def _transform(buckets: int):
    """Transforms for the buckets, and for the block itself the roles, which pass the buckets by."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _sent(0, [])
        number, block = docs.column("block")[0].as_py(), _block(docs, buckets)
        roles = block.roles(_pairs(found, "mark"))
        return _sent(number, [(number % buckets, "roles", packed([], roles.tobytes())), *((b, "transform", data) for b, data in block.transforms(roles))])

    return run


def _each_bucket(answer, kind: str):
    """Arrow map over rows sorted by bucket: answer's rows for the blocks; rows of another kind pass."""

    def run(batches):
        def done(bucket, held):
            rows = [(block, k, data) for block, k, data in held if k != kind]
            mine = [(block, data) for block, k, data in held if k == kind]
            rows += [(block, kind, data) for block, data in answer(mine)] if mine else []
            return pa.RecordBatch.from_arrays([pa.array([bucket] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "block", "kind", "data"])

        now, held = None, []
        for batch in batches:
            for bucket, block, k, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "kind", "data")), strict=True):
                if bucket != now and held:
                    yield done(now, held)
                    held = []
                now = bucket
                held.append((block, k, data))
        if held:
            yield done(now, held)

    return run


def kept_of(block: Block, roles: np.ndarray, found: list[tuple[int, bytes]]) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept, times) of a block's documents under the buckets' answers."""
    cover = np.zeros(len(block.line) + 1, dtype=np.int32)

    def add(first: np.ndarray, windows: np.ndarray) -> None:
        np.add.at(cover, first, 1)
        np.add.at(cover, first + windows + WINDOW - 1, -1)

    whole = (block.owner > block.low[block.which]) | (roles[block.which] == COPY) if len(block.which) else np.zeros(0, bool)
    add(block.at[whole], block.count[whole])
    if found:
        segment, first, windows, bucket = block.entries(roles)
        spans = []
        for b, data in found:
            (entry, left, count), _ = unpacked(data, FOUND)
            entry = entry + int(np.searchsorted(bucket, b))
            spans.append((segment[entry], first[entry] + windows[entry] + WINDOW - 1 - left, count))
        segment, first, count = (np.concatenate(x) for x in zip(*spans, strict=True))
        order = np.argsort(segment, kind="stable")
        segment, first, count = segment[order], first[order], count[order]
        # the answers hold for the segment's least owner, wherever it has it
        rest = np.flatnonzero(~whole)
        a, b = np.searchsorted(segment, block.which[rest]), np.searchsorted(segment, block.which[rest], side="right")
        n = b - a
        span = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        add(np.repeat(block.at[rest], n) + first[span], count[span])
    gone = np.cumsum(cover[:-1]) > 0
    removed, spans = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(gone & ~np.concatenate([[False], gone[:-1]]))])
    out = []
    for (doc_id, _, times), a, n in zip(block.rows, block.begins.tolist(), block.sizes.tolist(), strict=True):
        lost = int(removed[a + n] - removed[a])
        kept = block.line[a : a + n] if not lost else block.line[a : a + n][~gone[a : a + n]]
        out.append((doc_id, n, lost, int(spans[a + n] - spans[a]), kept.tobytes(), times))
    return out


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, times long"


def _keep(buckets: int):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows:
            block = _block(docs, buckets)
            roles = np.frombuffer(unpacked(_pairs(found, "roles")[0][1], [])[1], dtype=np.uint8)
            rows = kept_of(block, roles, _pairs(found, "transform"))
        kinds = [pa.int64()] * 4 + [pa.binary(), pa.int64()]
        return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], [c.split()[0] for c in KEPT.split(", ")])

    return run


def strip(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, least_buckets: int = LEAST_BUCKETS, full: int = FULL) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) per row of docs: kept is the text's UTF-8 without the bytes
    covered by a 50-byte string that also starts in a document of smaller doc_id.

    A null text is empty, a text of under 50 bytes loses nothing, a text of any length is read whole (a block is at
    least one text). A document without an id loses nothing and takes nothing from others. Rows that share a
    doc_id are one document to the rule: none removes from another, and repeated rows have equal results. Other
    columns are not read, whatever their names. No rows: no rows. Segments of one minimiser are held to be
    equal if 64 bits of their hash are.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, blocks = max(least_buckets, -(-size // bucket_bytes)), max(1, -(-size // block_bytes))
    tasks = min(buckets, MOST_TASKS)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).mapInArrow(_pack, "block long, data binary")

    def answered(sent: DataFrame, answer, kind: str) -> DataFrame:
        return sent.repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket", "block").mapInArrow(_each_bucket(answer, kind), SENT)

    marks = answered(dealt.groupBy("block").applyInArrow(_mark(buckets), SENT), lambda found: roles_of(found, full), "mark")
    sent = dealt.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_transform(buckets), SENT)
    found = answered(sent, repeats_of, "transform")
    kept = dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_keep(buckets), KEPT)
    return kept.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
g AS (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS s FROM d WHERE octet_length(b) >= 50),
k AS (SELECT doc_id, s, array_slice(b, s, s + 49) AS k FROM g),
m AS (SELECT k, min(doc_id) AS least FROM k GROUP BY k),
r AS (SELECT DISTINCT doc_id, s FROM k JOIN m USING (k) WHERE least < doc_id),
i AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER w + 50 OR lag(s) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
n AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS span FROM i),
x AS (SELECT doc_id, span, min(s) AS a, max(s) + 50 AS z FROM n GROUP BY doc_id, span),
e AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS from_ FROM x),
h AS (SELECT e.doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last_, string_agg(hex(array_slice(b, from_, a - 1)), '' ORDER BY a) AS kept FROM e JOIN d ON d.doc_id = e.doc_id GROUP BY e.doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN h.doc_id IS NULL THEN b ELSE unhex(kept || hex(array_slice(b, last_, octet_length(b)))) END) AS kept_sha256
FROM d LEFT JOIN h ON h.doc_id = d.doc_id
"""
