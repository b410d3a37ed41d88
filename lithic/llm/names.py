"""Client and vendor names at a Damerau-Levenshtein distance of at most one.

Client names are summed up, name by name, and put into a sharded trie; a vendor's misspelt name runs through its
shards by a universal automaton: its states are sets of (places ahead, errors, transposition begun) relative to the
letters read, its input the bits of where the letter stands around that place of the vendor's name, so one
table, built once, serves all names. All vendors of a shard walk its trie level by level together.

Routing: an edit cannot change both ends of a name. Names of one distance share their first k letters or their
last k, with k by the length of the vendor's name (``SIZES``), so each vendor goes to the shard of its beginning and to that of
its end, in a trie of reversed names, and a pair that shares both is taken from the first. What has no such ends, the exchange of two
letters and the change of one, has keys of its own.

Scale: names are distinct before they are shuffled, keys without a vendor are dropped by their counts, and a key of
more than a part's names on either side is divided into parts of both sides that meet each other. No side is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, heavy_keys, spread_join, table

#: Letters at an end that a vendor's name is routed by: the largest k with 2 k + 1 letters or less.
SIZES = (1, 2, 3, 4, 6, 8)
#: Most names of a side in a part of a key, and the share of all that a part may hold.
PART, PARTS = 20_000, 1_024
#: Rows that a task matches at once, whole keys.
AT_ONCE = 50_000
START, DEAD = 0, -1


def universal() -> tuple[np.ndarray, np.ndarray]:
    """The automaton for one error with transpositions: (next state by state and bits, distance by state and rest).

    A position is (offset, errors, begun): ``offset + letters read`` letters of the pattern are used up, and in a
    begun exchange the next letter has to be the one passed over. Bit k of an input says that the letter read stands
    at place ``letters read - 1 + k`` of the pattern. The rest is what the pattern is longer than the word.
    """

    def after(position: tuple, bits: tuple) -> set:
        offset, errors, begun = position
        here, ahead = bits[offset + 1], bits[offset + 2] if offset < 1 else False
        if begun:
            return {(offset + 1, 1, False)} if here else set()
        out = {(offset, errors, False)} if here else set()
        if errors == 0:
            out |= {(offset - 1, 1, False), (offset, 1, False)}  # a letter too many, a letter changed
            if ahead:
                out |= {(offset + 1, 1, False), (offset - 1, 1, True)}  # a letter missing, an exchange begun
        return out

    start = frozenset({(0, 0, False)})
    number, waiting, steps = {start: START}, [start], []
    for state in waiting:
        row = []
        for k in range(8):
            to = frozenset(p for position in state for p in after(position, (k & 1, k >> 1 & 1, k >> 2 & 1)))
            if to and to not in number:
                number[to] = len(number)
                waiting.append(to)
            row.append(number[to] if to else DEAD)
        steps.append(row)
    ends = np.full((len(number), 3), 2, dtype=np.int64)
    for state, k in number.items():
        for offset, errors, begun in state:
            for rest in (-1, 0, 1):
                if not begun and rest - offset >= 0:
                    ends[k, rest + 1] = min(ends[k, rest + 1], errors + rest - offset)
    return np.array(steps, dtype=np.int64), ends


STEPS, ENDS = universal()


def distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance."""
    begin = 0
    while begin < min(len(a), len(b)) and a[begin] == b[begin]:
        begin += 1
    a, b = a[begin:], b[begin:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    most = len(a) + len(b)
    table = {(-1, -1): most}
    for i in range(len(a) + 1):
        table[i, -1], table[i, 0] = most, i
    for j in range(len(b) + 1):
        table[-1, j], table[0, j] = most, j
    seen: dict[str, int] = {}
    for i in range(1, len(a) + 1):
        last = 0
        for j in range(1, len(b) + 1):
            k, m = seen.get(b[j - 1], 0), last
            if a[i - 1] == b[j - 1]:
                last = j
            table[i, j] = min(
                table[i - 1, j - 1] + (a[i - 1] != b[j - 1]), table[i, j - 1] + 1, table[i - 1, j] + 1,
                table[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1) if k and m else most,
            )
        seen[a[i - 1]] = i
    return table[len(a), len(b)]


class Letters:
    """Texts as one line of code points."""

    def __init__(self, texts: list[str]) -> None:
        self.line = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        self.size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.begin = np.cumsum(self.size) - self.size
        self.line = np.concatenate([self.line, [-2]])

    def at(self, which: np.ndarray, place: np.ndarray) -> np.ndarray:
        """A text's letter at a place, -2 beyond its ends."""
        inside = (place >= 0) & (place < self.size[which])
        return self.line[np.where(inside, self.begin[which] + place, len(self.line) - 1)]


def walk(names: list[tuple], patterns: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, name): the patterns, each in a trie of the names of its key, that reach a name within one error.

    Both are (key, text), the names sorted, without repeats. A trie node is a range of sorted names; its children, a level on,
    are the runs of names with the same next letter, found once for all patterns that come by.
    """
    heads = [k for k in range(len(names)) if not k or names[k][0] != names[k - 1][0]]
    number = {names[k][0]: i for i, k in enumerate(heads)}
    line, own = Letters([n[1] for n in names]), Letters([p[1] for p in patterns])
    which = np.array([k for k, p in enumerate(patterns) if p[0] in number], dtype=np.int64)
    low, high = np.array(heads, dtype=np.int64), np.array([*heads[1:], len(names)], dtype=np.int64)
    node = np.array([number[patterns[k][0]] for k in which.tolist()], dtype=np.int64)
    state, depth, found = np.zeros(len(which), dtype=np.int64), 0, []
    while len(which):
        # a name that ends here stands first in its node
        over = line.size[low[node]] == depth
        rest = own.size[which] - depth
        near = np.flatnonzero(over & (abs(rest) <= 1))
        near = near[ENDS[state[near], rest[near] + 1] <= 1]
        found.append((which[near], low[node[near]]))
        live, of = np.unique(node, return_inverse=True)
        first = low[live] + (line.size[low[live]] == depth)
        width = high[live] - first
        place = np.repeat(first - np.cumsum(width) + width, width) + np.arange(width.sum())
        letter = line.at(place, np.full(len(place), depth))
        parent = np.repeat(np.arange(len(live)), width)
        new = np.concatenate([[True], (letter[1:] != letter[:-1]) | (parent[1:] != parent[:-1])])[: len(place)]
        child = np.flatnonzero(new)
        children = np.bincount(parent[child], minlength=len(live))
        low, high = place[child], place[child] + np.diff(np.concatenate([child, [len(place)]]))
        before = np.cumsum(children) - children
        n = children[of]
        node = np.repeat(before[of] - np.cumsum(n) + n, n) + np.arange(n.sum())
        which, state = np.repeat(which, n), np.repeat(state, n)
        read = letter[child][node]
        bits = sum((own.at(which, np.full(len(which), depth - 1 + k)) == read).astype(np.int64) << k for k in range(3))
        state = STEPS[state, bits]
        on = state != DEAD
        which, node, state, depth = which[on], node[on], state[on], depth + 1
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def end_size(n: int) -> int:
    """Letters that a name of n is routed by."""
    return max((k for k in SIZES if 2 * k + 1 <= n), default=1)


def _end_size(n: Column) -> Column:
    size = F.lit(SIZES[0])
    for k in SIZES[1:]:
        size = F.when(n >= 2 * k + 1, F.lit(k)).otherwise(size)
    return size


def _key(kind: str, text: Column) -> Column:
    return F.concat(F.lit(kind), text)


def _ends(name: Column, size: Column, k: int) -> list[Column]:
    """Keys of a name's first and last k letters; the letter before tells the tries apart."""
    return [F.when(size >= k, _key(f"b{k} ", F.substr(name, F.lit(1), F.lit(k)))), F.when(size >= k, _key(f"e{k} ", F.substr(name, size - k + 1, F.lit(k))))]


def client_keys(name: Column) -> Column:
    """Keys of a client's name: one for each length of a vendor's name within one letter of its own."""
    size = F.char_length(name)
    keys = [F.when((_end_size(size - 1) == k) | (_end_size(size) == k) | (_end_size(size + 1) == k), key) for k in SIZES for key in _ends(name, size, k)]
    return F.array_compact(F.array(*keys, F.when(size == 1, F.lit("one"))))


def vendor_keys(name: Column) -> Column:
    """Keys of a vendor's name. Of two letters, exchanged ones share no end; of one letter, a changed one shares nothing."""
    size = F.char_length(name)
    keys = [F.when(_end_size(size) == k, key) for k in SIZES for key in _ends(name, size, k)]
    return F.array_compact(F.array(*keys, F.when(size == 2, _key("b1 ", F.substr(name, F.lit(2), F.lit(1)))), F.when(size == 1, F.lit("one"))))


def _mine(key: str, pattern: str, name: str) -> bool:
    """Whether a pair is taken from the trie of this key, of those that it may be found in."""
    if key == "one":
        return pattern != name
    k = end_size(len(pattern))
    begins = pattern[:k] == name[:k]
    if key[0] == "b":
        return begins or len(pattern) == 2 and name == pattern[::-1]
    return not begins and pattern[-k:] == name[-k:] and not (len(pattern) == 2 and name == pattern[::-1])


MATCHED = "vendor_name string, distance int, n long, first long, crc decimal(38,0)"


def _match(batches):
    """Arrow map over rows sorted by part of a key: the verified pairs, summed up by vendor's name and distance."""

    def done(held: list[tuple]) -> pa.RecordBatch:
        clients, vendors = [r for r in held if not r[1]], [r for r in held if r[1]]
        clients.sort(key=lambda r: (r[0], r[2]))
        turned = [((r[0], r[2][::-1]), r) for r in clients if r[0][1][0] == "e"]
        turned.sort(key=lambda x: x[0])
        found: dict[tuple, list] = {}
        for names, rows, back in (([(r[0], r[2]) for r in clients if r[0][1][0] != "e"], [r for r in clients if r[0][1][0] != "e"], False), ([x[0] for x in turned], [x[1] for x in turned], True)):
            patterns = [r for r in vendors if (r[0][1][0] == "e") == back]
            pairs = walk(names, [(r[0], r[2][::-1] if back else r[2]) for r in patterns])
            for v, c in zip(*(x.tolist() for x in pairs), strict=True):
                pattern, (key, _, name, n, first, crc) = patterns[v], rows[c]
                if _mine(key[1], pattern[2], name) and (apart := distance(pattern[2], name)) <= 1:
                    now = found.setdefault((pattern[2], apart), [0, None, 0])
                    now[0] += n
                    now[1] = first if now[1] is None else now[1] if first is None else min(first, now[1])
                    now[2] += int(crc or 0)
        rows = [(name, apart, *x) for (name, apart), x in found.items()]
        kinds = pa.string(), pa.int32(), pa.int64(), pa.int64()
        sums = pa.array([str(r[4]) for r in rows], pa.string()).cast(pa.decimal128(38, 0))
        return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)), sums], [c.split()[0] for c in MATCHED.split(", ")])

    held: list[tuple] = []
    for batch in batches:
        for key, client_part, vendor_part, vendor, *rest in zip(*(batch.column(c).to_pylist() for c in ("key", "client_part", "vendor_part", "vendor", "name", "n", "first", "crc")), strict=True):
            part = ((client_part, vendor_part), key)
            if len(held) >= AT_ONCE and held[-1][0] != part:
                yield done(held)
                held = []
            held.append((part, vendor, *rest))
    if held:
        yield done(held)


def misspelt(name: Column, vendor_id: Column) -> Column:
    """The name with two neighbouring letters exchanged, if the id's checksum is even; it tells where."""
    hash_, size = F.crc32(vendor_id.cast("string").cast("binary")), F.char_length(name)
    at = F.pmod(hash_, F.greatest(size - 1, F.lit(1)).cast("long")).cast("int")
    swapped = F.concat(F.substr(name, F.lit(1), at), F.substr(name, at + 2, F.lit(1)), F.substr(name, at + 1, F.lit(1)), F.substr(name, at + 3))
    return F.when((hash_ % 2 == 0) & (size >= 2), swapped).otherwise(name)


def links(clients: DataFrame, vendors: DataFrame, part: int = PART) -> DataFrame:
    """(vendor_id, distance, n_clients, first_client_id, clients_crc) of vendors (vendor_id, name) and clients
    (client_id, name) whose names are apart by 0 or 1 edits of code points or exchanges of neighbours.

    Null and empty names take no part; a vendor without an id is one vendor, a client without one counts and adds nothing to
    the checksum. Repeated rows of a client count each; those of a vendor, with one name, once. Names of any length are compared
    whole. Other columns are not read, whatever their names. No rows on either side: no rows.
    """
    named = (F.col("name").isNotNull()) & (F.col("name") != "")
    names = clients.select("client_id", F.col("name").cast("string").alias("name")).where(named).groupBy("name").agg(
        F.count("*").alias("n"), F.min(F.col("client_id").cast("long")).alias("first"), F.sum(F.crc32(F.col("client_id").cast("string").cast("binary")).cast("decimal(20,0)")).cast("decimal(38,0)").alias("crc"))
    sellers = cut(vendors.select(F.col("vendor_id").cast("long"), F.col("name").cast("string").alias("name")).where(named).distinct())
    wanted = sellers.select(F.col("name").alias("vendor_name")).distinct()
    ours = cut(names.select(F.explode(client_keys(F.col("name"))).alias("key"), F.lit(False).alias("vendor"), "name", "n", "first", "crc"))
    theirs = cut(wanted.select(F.explode(F.array_distinct(vendor_keys(F.col("vendor_name")))).alias("key"), F.lit(True).alias("vendor"), F.col("vendor_name").alias("name"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("decimal(38,0)").alias("crc")))
    sizes = ours.select("key", "vendor").unionByName(theirs.select("key", "vendor")).groupBy("key").agg(F.count_if(~F.col("vendor")).alias("clients"), F.count_if("vendor").alias("vendors"))
    sizes = cut(sizes.where("clients > 0 AND vendors > 0"))
    most = min(part, max(200, (sizes.agg(F.sum("clients")).first()[0] or 0) // PARTS))
    parts = sizes.select("key", F.ceil(F.col("clients") / most).alias("client_parts"), F.ceil(F.col("vendors") / most).alias("vendor_parts"))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in its own part, once for each part of the other side."""
        rows = spread_join(rows, parts, "key", heavy_keys(sizes.select("key", F.col(f"{own}s").alias("n")), "key", "n"))
        return rows.withColumn(f"{own}_part", F.pmod(F.xxhash64("name"), F.col(f"{own}_parts"))).withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_parts") - 1)))

    columns = ["key", "client_part", "vendor_part", "vendor", "name", "n", "first", "crc"]
    shards = dealt(ours, "client", "vendor").select(columns).unionByName(dealt(theirs, "vendor", "client").select(columns))
    found = shards.repartition("key", "client_part", "vendor_part").sortWithinPartitions("key", "client_part", "vendor_part").mapInArrow(_match, MATCHED)
    found = found.groupBy("vendor_name", "distance").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("crc").alias("crc"))
    found = found.groupBy("vendor_name").agg(F.collect_list(F.struct("distance", "n", "first", "crc")).alias("found"))
    counts = sellers.groupBy(F.col("name").alias("vendor_name")).agg(F.count("*").alias("n"))
    joined = spread_join(sellers.withColumnRenamed("name", "vendor_name"), found, "vendor_name", heavy_keys(counts, "vendor_name", "n"))
    rows = joined.select("vendor_id", F.inline("found"))
    return rows.groupBy("vendor_id", "distance").agg(F.sum("n").alias("n_clients"), F.min("first").alias("first_client_id"), F.sum("crc").cast("long").alias("clients_crc"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vendors = table(spark, sf_dir, "vendors").withColumn("name", misspelt(F.col("name"), F.col("vendor_id")))
    return links(table(spark, sf_dir, "clients"), vendors)


#: The CRC-32 of a decimal number, a bit at a time.
CRC = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST({} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda u, b: list_reduce(list_concat([xor(u, b)], range(8)), lambda w, k: xor(w >> 1, 3988292384 * (w & 1)))), 4294967295)"""
#: Two names of distance 1 share all letters but those of one edit at their begin and end (p and s letters).
ORACLE = rf"""
WITH h AS (SELECT DISTINCT vendor_id, name, {CRC.format('vendor_id')} AS h FROM vendors WHERE name <> ''),
v AS (SELECT vendor_id, CASE WHEN h % 2 = 0 AND length(name) >= 2 THEN left(name, h % (length(name) - 1)) || substr(name, h % (length(name) - 1) + 2, 1) || substr(name, h % (length(name) - 1) + 1, 1)
  || substr(name, h % (length(name) - 1) + 3) ELSE name END AS a FROM h),
c AS (SELECT client_id, name AS b FROM clients WHERE name <> ''),
x AS (SELECT DISTINCT a, b FROM (SELECT DISTINCT a FROM v) JOIN (SELECT DISTINCT b FROM c) ON abs(length(a) - length(b)) <= 1),
y AS (SELECT a, b, length(a) AS m, length(b) AS n, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: left(a, i) = left(b, i))) AS p,
  len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: right(a, i) = right(b, i))) AS s FROM x),
z AS (SELECT a, b, CASE WHEN a = b THEN 0 ELSE 1 END AS distance FROM y WHERE a = b OR m = n AND p + s >= m - 1 OR m <> n AND p + s >= least(m, n)
  OR m = n AND p + s = m - 2 AND substr(a, p + 1, 1) = substr(b, p + 2, 1) AND substr(a, p + 2, 1) = substr(b, p + 1, 1))
SELECT vendor_id, distance, count(*) AS n_clients, min(client_id) AS first_client_id, CAST(sum({CRC.format('client_id')}) AS BIGINT) AS clients_crc
FROM v JOIN z ON z.a = v.a JOIN c ON c.b = z.b GROUP BY vendor_id, distance
"""
