"""Removal of repeated 13-word windows by matching statistics over compressed FM-indexes.

Documents are dealt into blocks by a hash of id and text, and each is cut into segments: runs of windows
that share a minimiser, the 4-word sequence of least hash in the window. Equal windows have equal
minimisers, so the shard that owns a minimiser sees every copy of its windows, and no document has to meet
every shard. A shard's distinct segments, in the order of their first owners and divided by separators, make
one text of word numbers; its Burrows-Wheeler transform goes into a wavelet matrix, and the owners of its
sorted suffixes into another, which tells the least owner of any interval. Segments are then streamed past
that index: backward search gives, from a right end, the longest match that also starts in a document of
smaller id, and the next right end is the last that could still end a match not covered. Matches of 13
words and more are reported as intervals, which go back to the blocks.

Which segments go in: a minimiser that one document alone holds can have no copy elsewhere, so its segments
are neither indexed nor searched; nothing else is left out.

Scale: a block sends a shard one compressed piece with its distinct segments and each one's first and
last owner, so a passage that many documents share is sent, and answered, once a block. Texts are compressed
and shuffled once, by block, and read twice from there. Minimisers are counted in ``CELLS`` cells first: one whose cell is
overfull is split by the second least sequence of the window, so that no shard has to take all windows
around a common phrase.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

WINDOW, MINIMISER = 13, 4
SHARD_CHARS, LEAST_SHARDS, MOST_TASKS = 8_000_000, 16, 100_000
BLOCK_CHARS, MOST_BLOCK_CHARS, PIECE_CHARS = 4_000_000, 16_000_000, 5_000
#: Cells of the minimisers' histogram; a cell with as many segments, and as many times the mean, is overfull.
CELLS, FULL, TIMES = 1 << 16, 60_000, 8
#: Most windows in a segment: longer runs, as repetitive texts have, are cut.
RUN = 32
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x100000001B3
CHUNK = 1 << 20
NOBODY = np.iinfo(np.int64).max
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of BASE and of its inverse modulo 2^64, as many as were asked for."""

    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(n, BASE), _powers(n, pow(BASE, -1, 1 << 64))
        return cls.up, cls.down


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def word_hashes(line: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word line[start:end]; equal words hash alike. It routes, it proves nothing."""
    out = np.zeros(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK)))
        zero, n = starts[at], int(ends[to - 1] - starts[at])
        up, down = _Powers.of(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((line[zero : zero + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        a, b = starts[at:to] - zero, ends[at:to] - zero
        out[at:to] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
        at = to
    return mixed(out)


class Words:
    """The words of texts in one line of bytes, a space behind each: where each starts and ends, the first
    word of each text (and the end of the last)."""

    def __init__(self, texts: list[bytes]) -> None:
        raw = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
        space = IS_SPACE[raw]
        before = np.concatenate([[True], space[:-1]])
        begins = np.flatnonzero(~space & before)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        self.first = np.searchsorted(begins, np.concatenate([[0], np.cumsum(sizes)]))
        line = raw[~space | ~before]
        self.ends = np.flatnonzero(IS_SPACE[line])
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]) if len(self.ends) else self.ends
        line[self.ends] = 0x20
        self.line = line


def segments(words: Words, full: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of windows, key) of each segment; a segment's windows share the key. Only a
    window's words decide its key."""
    n = len(words.starts) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = word_hashes(words.line, words.starts, words.ends)
    grams = np.zeros(len(hashes) - MINIMISER + 1, dtype=np.uint64)
    for k in range(MINIMISER):
        grams = mixed(grams + hashes[k : k + len(grams)])
    least = grams[:n].copy()
    for k in range(1, WINDOW - MINIMISER + 1):
        np.minimum(least, grams[k : k + n], out=least)
    hot = np.flatnonzero(full[cell_of(least)])
    for at in range(0, len(hot), CHUNK):
        some = hot[at : at + CHUNK]
        around = grams[some[:, None] + np.arange(WINDOW - MINIMISER + 1)]
        around[around == least[some, None]] = np.iinfo(np.uint64).max
        least[some] = mixed(least[some] ^ mixed(around.min(axis=1)))
    text = np.searchsorted(words.first, np.arange(n), side="right")
    inside = words.first[text] - np.arange(n) >= WINDOW
    starts = inside & np.concatenate([[True], (least[1:] != least[:-1]) | ~inside[:-1]])
    first = np.flatnonzero(starts)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place = np.arange(n) - first[np.maximum(np.cumsum(starts) - 1, 0)]
    first = np.flatnonzero(starts | (inside & (place % RUN == 0)))
    ends = np.flatnonzero(inside & np.concatenate([~inside[1:], [True]]))
    stops = np.minimum(np.concatenate([first[1:], [n]]), ends[np.searchsorted(ends, first)] + 1)
    return first, stops - first, least[first]


def cell_of(keys: np.ndarray) -> np.ndarray:
    # a least of several hashes is small, so it is mixed before its bits deal it out
    return (mixed(keys) >> np.uint64(48)).astype(np.int64) % CELLS


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(keys ^ MIX) >> np.uint64(16)).astype(np.int64) % shards


class Block:
    """A block's documents, in an order that does not depend on how they came, cut into segments."""

    def __init__(self, rows: list[tuple], full: np.ndarray, shards: int) -> None:
        """rows: (doc_id, text's bytes); documents without id have no segments."""
        self.rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        self.words = words = Words([r[1] for r in self.rows])
        self.ids = np.array([NOBODY if r[0] is None else r[0] for r in self.rows], dtype=np.int64)
        self.size, known = np.diff(words.first), np.array([r[0] is not None for r in self.rows], dtype=bool)
        first, count, key = segments(words, full)
        owner = np.searchsorted(words.first, first, side="right") - 1
        keep = known[owner] if len(owner) else np.zeros(0, bool)
        self.at, self.count, key, self.owner = first[keep], count[keep], key[keep], self.ids[owner[keep]]
        line, number = words.line.tobytes(), {}
        stops = words.ends[self.at + self.count + WINDOW - 2].tolist()
        self.which = np.array([number.setdefault(line[a:b], len(number)) for a, b in zip(words.starts[self.at].tolist(), stops, strict=True)], dtype=np.int64)
        self.contents = list(number)
        # documents come in the order of their ids
        some, heads = np.unique(self.which, return_index=True)
        self.low, self.high = self.owner[heads], np.zeros(len(some), dtype=np.int64)
        self.high[self.which] = self.owner
        self.key = key[heads]
        shard = shard_of(self.key, shards)
        self.order = np.argsort(shard, kind="stable")
        self.shards, self.offsets = np.unique(shard[self.order], return_index=True)

    def pieces(self):
        """(shard, its segments: keys, first owners, places and last owners of those with several, contents)."""
        ends = np.concatenate([self.offsets[1:], [len(self.order)]])
        for shard, a, b in zip(self.shards.tolist(), self.offsets.tolist(), ends.tolist(), strict=True):
            some = self.order[a:b]
            several = np.flatnonzero(self.high[some] != self.low[some]).astype(np.int32)
            yield shard, packed([(self.key[some] & np.uint64(0xFFFFFFFF)).astype(np.uint32), self.low[some], several, self.high[some[several]]], b"\n".join([self.contents[i] for i in some.tolist()]))


def packed(arrays: list[np.ndarray], tail: bytes = b"") -> bytes:
    """Arrays of 4- and 8-byte integers, plane by plane of bytes, and a tail, compressed."""
    sizes = np.array([len(a) for a in arrays], dtype=np.int64).tobytes()
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=6).compress(b"".join([sizes, *planes, tail]))


def unpacked(raw: bytes, kinds: list) -> tuple[list[np.ndarray], bytes]:
    data = zstandard.ZstdDecompressor().decompress(raw)
    sizes, at, out = np.frombuffer(data, dtype=np.int64, count=len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(data, dtype=np.uint8, count=n * width, offset=at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * width
    return out, data[at:]


PIECE = [np.uint32, np.int64, np.int32, np.int64]
ANSWER = [np.int32, np.int64, np.int32, np.int32, np.int32]


class Wavelet:
    """Wavelet matrix of an integer sequence: packed bits and a count for each 64 of them, a level a bit."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.bits, self.n = bits, len(values)
        self.words, self.before, self.zeros = [], [], []
        for level in reversed(range(bits)):
            bit = (values >> level & 1).astype(np.uint8)
            some = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, np.uint8)]), bitorder="little").view(np.uint64)
            self.words.append(some)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(some), dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def ones(self, k: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[k][word] + np.bitwise_count(self.words[k][word] & mask)

    def ranks(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How often symbol stands before each place, plus the same number for all places of a symbol."""
        at = np.concatenate(places).astype(np.int64)
        for k, level in enumerate(reversed(range(self.bits))):
            one = np.tile((symbol >> level & 1).astype(bool), len(places))
            ones = self.ones(k, at)
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return np.split(at, len(places))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value at the places low to high, which are not empty."""
        out = np.zeros(len(low), dtype=np.int64)
        n, at = len(low), np.concatenate([low, high]).astype(np.int64)
        for k, level in enumerate(reversed(range(self.bits))):
            ones = self.ones(k, at)
            zeros = at - ones
            one = zeros[:n] == zeros[n:]
            out |= one.astype(np.int64) << level
            at = np.where(np.tile(one, 2), self.zeros[k] + ones, zeros)
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffixes of text in order, by prefix doubling; each 0, a separator, differs from all others."""
    apart = text == 0
    rank = np.where(apart, np.cumsum(apart) - 1, int(apart.sum()) + text - 1).astype(np.int64)
    width = 1
    while True:
        key = rank * (int(rank.max()) + 2)
        key[: len(key) - width] += rank[width:] + 1
        order = np.argsort(key)
        fresh = np.zeros(len(key), dtype=np.int64)
        fresh[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
        rank, width = fresh, 2 * width
        if rank[order[-1]] == len(rank) - 1 or width >= len(rank):
            return order


class FMIndex:
    """Backward search in a text of integers, in which 0 divides the owners' parts and is in no pattern;
    owner[k] owns the k-th part."""

    def __init__(self, text: np.ndarray, owner: np.ndarray) -> None:
        order = suffix_order(text)
        bits = max(1, int(text.max()).bit_length())
        self.n, self.counts = len(text), np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << bits))]).astype(np.int64)
        self.transform = Wavelet(text[order - 1], bits)
        # what ranks() adds is taken off once and for all
        self.base = self.counts[: 1 << bits] - self.transform.ranks(np.arange(1 << bits), np.zeros(1 << bits, np.int64))[0]
        part = np.minimum(np.cumsum(text == 0) - (text == 0), len(owner) - 1)
        self.owners = Wavelet(owner[part[order]], max(1, int(owner.max()).bit_length()))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = self.transform.ranks(symbol, low, high)
        return self.base[symbol] + low, self.base[symbol] + high

    def find(self, text: np.ndarray, first: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of text[first:end], left as they are once they have no more than ``least`` suffixes."""
        low, high, at = np.zeros(len(first), np.int64), np.full(len(first), self.n, dtype=np.int64), end.copy()
        while len(some := np.flatnonzero((at > first) & (high - low > least))):
            at[some] -= 1
            low[some], high[some] = self.extend(text[at[some]], low[some], high[some])
        return low, high

    def matches(self, text: np.ndarray, first: np.ndarray, end: np.ndarray, bound: np.ndarray, least: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, start, end): the maximal matches of text[first:end] with parts of owners below bound, of
        ``least`` symbols and more; together they cover every stretch of that length that has such a match."""
        found = [], [], []
        which, right = np.arange(len(first)), end.copy()
        at, low, high = right.copy(), np.zeros(len(first), np.int64), np.full(len(first), self.n, dtype=np.int64)
        alive = right - first >= least
        which, right, at, low, high = (x[alive] for x in (which, right, at, low, high))
        while len(which):
            more = np.flatnonzero(at > first[which])
            below, above = self.extend(text[at[more] - 1], low[more], high[more])
            good = above > below
            long = np.flatnonzero(good & (right[more] - at[more] + 1 >= least))
            good[long] = self.owners.least(below[long], above[long]) < bound[which[more[long]]]
            went = more[good]
            low[went], high[went] = below[good], above[good]
            at[went] -= 1
            stuck = np.ones(len(which), dtype=bool)
            stuck[went] = False
            if not stuck.any():
                continue
            hit = stuck & (right - at >= least)
            for out, x in zip(found, (which, at, right), strict=True):
                out.append(x[hit].copy())
            right = np.where(hit, at + least - 1, np.where(stuck, right - 1, right))
            at, low, high = np.where(stuck, right, at), np.where(stuck, 0, low), np.where(stuck, self.n, high)
            alive = right - first[which] >= least
            which, right, at, low, high = (x[alive] for x in (which, right, at, low, high))
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


def repeats(contents: list[bytes], low: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For distinct segments, each with its first owner and whether it has others: which segments its later
    owners repeat in full, and (segment, start, end) of what the first owner repeats of earlier ones."""
    by_owner = np.argsort(low, kind="stable")
    number: dict[bytes, int] = {}
    ids: list[int] = []
    sizes = np.zeros(len(contents), dtype=np.int64)
    for k, i in enumerate(by_owner.tolist()):
        words = contents[i].split()
        sizes[k] = len(words)
        ids += [number.setdefault(w, len(number) + 1) for w in words]
        ids.append(0)
    text = np.array(ids, dtype=np.int64)
    _, owner = np.unique(low[by_owner], return_inverse=True)
    index = FMIndex(text, owner.astype(np.int64))
    starts = np.cumsum(sizes + 1) - sizes - 1
    whole = np.zeros(len(contents), dtype=bool)
    many = np.flatnonzero(several[by_owner])
    pattern, a, b = index.matches(text, starts[many], starts[many] + sizes[many], owner[many] + 1)
    whole[by_owner[many[pattern[b - a == sizes[many[pattern]]]]]] = True
    # what all windows of a segment share has to occur elsewhere, and earlier
    windows = sizes - WINDOW + 1
    core = np.flatnonzero(windows <= WINDOW)
    l, h = index.find(text, starts[core] + windows[core] - 1, starts[core] + WINDOW, 1)
    good = h - l > 1
    good[good] = index.owners.least(l[good], h[good]) < owner[core[good]]
    some = np.concatenate([core[good], np.flatnonzero(windows > WINDOW)])
    pattern, a, b = index.matches(text, starts[some], starts[some] + sizes[some], owner[some])
    return whole, (by_owner[some[pattern]], a - starts[some[pattern]], b - starts[some[pattern]])


def answers(pieces: list[tuple[int, bytes]]):
    """(block, packed answer) for one shard's pieces: of each segment with repeats its place in the piece, its
    first owner, whether later owners repeat it in full, and how many intervals follow for the first one."""
    heads = [unpacked(raw, PIECE)[0] for _, raw in pieces]
    keys = np.concatenate([h[0] for h in heads])
    _, key = np.unique(keys, return_inverse=True)
    low, high = np.concatenate([h[1] for h in heads]), np.concatenate([h[1] for h in heads])
    offsets = np.cumsum([0, *[len(h[0]) for h in heads]])
    for h, o in zip(heads, offsets.tolist(), strict=False):
        high[o + h[2]] = h[3]
    first, last = np.full(int(key.max(initial=-1)) + 1, NOBODY), np.full(int(key.max(initial=-1)) + 1, np.iinfo(np.int64).min)
    np.minimum.at(first, key, low)
    np.maximum.at(last, key, high)
    shared = (first != last)[key]
    if not shared.any():
        return
    number: dict[bytes, int] = {}
    which = np.zeros(len(keys), dtype=np.int64)
    for (_, raw), o in zip(pieces, offsets.tolist(), strict=False):
        lines = unpacked(raw, PIECE)[1].split(b"\n")
        some = np.flatnonzero(shared[o : o + len(lines)])
        which[o + some] = [number.setdefault(lines[i], len(number)) for i in some.tolist()]
    at = np.flatnonzero(shared)
    least, most = np.full(len(number), NOBODY), np.full(len(number), np.iinfo(np.int64).min)
    np.minimum.at(least, which[at], low[at])
    np.maximum.at(most, which[at], high[at])
    whole, (segment, a, b) = repeats(list(number), least, most > least)
    by_segment = np.argsort(segment, kind="stable")
    a, b = a[by_segment].astype(np.int32), b[by_segment].astype(np.int32)
    ends = np.searchsorted(segment[by_segment], np.arange(len(number) + 1))
    for k, (block, _) in enumerate(pieces):
        some = at[(at >= offsets[k]) & (at < offsets[k + 1])]
        w = which[some]
        parts = np.where(low[some] == least[w], ends[w + 1] - ends[w], 0).astype(np.int32)
        some_go = np.flatnonzero((whole[w] & (high[some] > least[w])) | (parts > 0))
        if not len(some_go):
            continue
        w, parts = w[some_go], parts[some_go]
        spans = np.concatenate([np.arange(ends[x], ends[x] + n) for x, n in zip(w.tolist(), parts.tolist(), strict=True)])
        yield block, packed([(some[some_go] - offsets[k]).astype(np.int32), np.where(whole[w], least[w], NOBODY), parts, a[spans], b[spans]])


ROWS = [np.int64, np.int32, np.int64]


def _pack(batches):
    """(block, packed rows: ids, whether there is one, sizes, texts) of a batch's rows of each block."""
    for batch in batches:
        block = batch.column("block").to_numpy()
        ids, texts = batch.column("doc_id"), [t or b"" for t in batch.column("text").to_pylist()]
        known, numbers = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int32), ids.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.argsort(block, kind="stable")
        heads = np.flatnonzero(np.diff(block[order], prepend=-1))
        out = []
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(order)], strict=True):
            some = order[a:b]
            held = [texts[i] for i in some.tolist()]
            out.append(packed([numbers[some], known[some], np.fromiter(map(len, held), dtype=np.int64, count=len(held))], b"".join(held)))
        yield pa.RecordBatch.from_arrays([pa.array(block[order][heads]), pa.array(out, pa.binary())], ["block", "data"])


def _rows(group: pa.Table) -> list[tuple]:
    rows = []
    for data in group.column("data").to_pylist():
        (numbers, known, sizes), tail = unpacked(data, ROWS)
        ends = np.cumsum(sizes).tolist()
        rows += [(i if k else None, tail[a:b]) for i, k, a, b in zip(numbers.tolist(), known.tolist(), [0, *ends[:-1]], ends, strict=True)]
    return rows


def _cut(full, shards: int):
    def run(group: pa.Table) -> pa.Table:
        number = group.column("block")[0].as_py()
        block = Block(_rows(group), full.value, shards)
        found = list(block.pieces())
        return pa.table({"shard": pa.array([s for s, _ in found], pa.int32()), "block": pa.array([number] * len(found), pa.int64()), "data": pa.array([d for _, d in found], pa.binary())})

    return run


def _search(batches):
    def done(shard, held):
        found = list(answers(held))
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int64()), pa.array([shard] * len(found), pa.int32()), pa.array([d for _, d in found], pa.binary())], ["block", "shard", "data"])

    now, held = None, []
    for batch in batches:
        for shard, block, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "block", "data")), strict=True):
            if shard != now and held:
                yield done(now, held)
                held = []
            now = shard
            held.append((block, data))
    if held:
        yield done(now, held)


def kept_of(block: Block, found: list[tuple[int, bytes]]) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept) of a block's documents under a shard's answers each."""
    words = block.words
    owner = np.full(len(block.contents), NOBODY)
    begin, n_spans, spans_a, spans_b, held = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64), [], [], 0
    for shard, data in found:
        (place, least, parts, a, b), _ = unpacked(data, ANSWER)
        which = block.order[block.offsets[np.searchsorted(block.shards, shard)] + place]
        owner[which], n_spans[which] = least, parts
        begin[which] = held + np.cumsum(parts) - parts
        held += len(a)
        spans_a.append(a)
        spans_b.append(b)
    cover = np.zeros(len(words.starts) + 1, dtype=np.int64)
    whole = owner[block.which] < block.owner
    np.add.at(cover, block.at[whole], 1)
    np.add.at(cover, block.at[whole] + block.count[whole] + WINDOW - 1, -1)
    if held:
        a, b = np.concatenate(spans_a), np.concatenate(spans_b)
        # the segment's first owner in the block is its first owner anywhere, or no spans came
        part = np.flatnonzero(~whole & (n_spans[block.which] > 0) & (block.owner == block.low[block.which]))
        n = n_spans[block.which[part]]
        span = np.repeat(begin[block.which[part]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        at = np.repeat(block.at[part], n)
        np.add.at(cover, at + a[span], 1)
        np.add.at(cover, at + b[span], -1)
    gone = np.cumsum(cover[:-1]) > 0
    stays = np.repeat(~gone, np.diff(words.ends, prepend=-1))
    begins = np.concatenate([[0], words.ends + 1])[words.first]
    removed = np.concatenate([[0], np.cumsum(gone)])[words.first]
    out = []
    for k, (doc_id, _) in enumerate(block.rows):
        a, b = begins[k], begins[k + 1]
        out.append((doc_id, int(block.size[k]), int(removed[k + 1] - removed[k]), words.line[a:b][stays[a:b]].tobytes()[:-1]))
    return out


KEPT = "doc_id long, n_words long, n_removed long, kept string"


def _keep(full, shards: int):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        block = Block(_rows(docs), full.value, shards)
        rows = kept_of(block, list(zip(found.column("shard").to_pylist(), found.column("data").to_pylist(), strict=True)))
        return pa.table(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3].decode(errors="replace") for r in rows], pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"],
        )

    return run


def _count(batches):
    """Segments by the cell of their minimiser; cell -1 counts the bytes."""
    total, size, none = np.zeros(CELLS, dtype=np.int64), 0, np.zeros(CELLS, dtype=bool)

    def count(texts: list[bytes]) -> None:
        np.add.at(total, cell_of(segments(Words(texts), none)[2]), 1)

    for batch in batches:
        held, chars = [], 0
        for text in batch.column("text").to_pylist():
            held.append(text or b"")
            chars += len(held[-1])
            if chars >= BLOCK_CHARS:
                count(held)
                size, held, chars = size + chars, [], 0
        if held:
            count(held)
        size += chars
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *cells.tolist()], pa.int32()), pa.array([size, *total[cells].tolist()], pa.int64())], ["cell", "n"])


def strip(docs: DataFrame, shard_chars: int = SHARD_CHARS, least_shards: int = LEAST_SHARDS, block_chars: int = BLOCK_CHARS, full: int = FULL) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) per row of docs: kept joins the words left by one space.

    A null text has no words, an empty or a short one loses nothing; a text of any length is read whole. A
    document without an id loses nothing and takes nothing from others. Rows that share a doc_id are one
    document to the rule: none removes from another, and repeated rows have equal results. Other columns are
    not read, whatever their names. No rows: no rows.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    cells = rows.select("text").mapInArrow(_count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, n = cells.column("cell").to_numpy(), cells.column("n").to_numpy()
    chars, n, cell = int(n[cell < 0].sum()), n[cell >= 0], cell[cell >= 0]
    overfull = np.zeros(CELLS, dtype=bool)
    overfull[cell[n > max(full, TIMES * n.sum() / CELLS)]] = True
    overfull = sc.broadcast(overfull)
    shards = max(least_shards, -(-chars // shard_chars))
    blocks = max(1, -(-chars // min(max(block_chars, PIECE_CHARS * shards), max(block_chars, MOST_BLOCK_CHARS))))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).mapInArrow(_pack, "block long, data binary")
    pieces = dealt.groupBy("block").applyInArrow(_cut(overfull, shards), "shard int, block long, data binary")
    tasks = min(shards, MOST_TASKS)
    found = pieces.repartitionById(tasks, F.col("shard") % tasks).sortWithinPartitions("shard").mapInArrow(_search, "block long, shard int, data binary")
    return dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_keep(overfull, shards), KEPT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS s FROM d WHERE len(ws) >= 13),
k AS (SELECT doc_id, s, array_to_string(ws[s : s + 12], ' ') AS k FROM g),
m AS (SELECT k, min(doc_id) AS least FROM k GROUP BY k),
r AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS q FROM k JOIN m USING (k) WHERE least < doc_id),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS q FROM d),
x AS (SELECT w.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY w.q) AS kept FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND r.q = w.q WHERE r.q IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN x ON x.doc_id = d.doc_id
"""
