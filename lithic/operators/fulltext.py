"""A persisted full-text index of immutable segments, shared by sessions and updated by what changed.

A segment holds a row per lexeme and document with the lexeme's places, in folders by lexeme bucket, sorted by
lexeme and range inside: a query reads the buckets of its own words and no text. Ranges part a segment's
documents by their length, and for every lexeme and range the highest count is kept, so that a search for the best can leave
out ranges that cannot reach them. A document that changed or went is marked in ``gone``, and its new text is in a
new segment; when there are many, segments are merged without reading a text. The tables live in a snapshot store: a
search has one snapshot, and two writers cannot both win.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.functions import text as T
from lithic.settings import DEFAULTS
from lithic.sources import workspace
from lithic.sources.snapshots import Snapshot, Store, Transaction

#: Fixed value: places of a lexeme in a document that a rank counts; the index has all, as phrases need them.
MOST_PLACES = 255
#: Characters of text behind a file of postings, buckets at most, documents of a range at most, segments before a merge.
FILE_CHARS, MOST_BUCKETS, RANGE_DOCS, MOST_SEGMENTS = 4_000_000, 512, 2_048, 8
#: Told apart in the folder's name: an index of another layout is another index.
LAYOUT = "3"
#: A range's number is its documents' length class times this, and a count.
CLASS = 1 << 40
#: Characters of texts that are turned into postings at once.
AT_ONCE = 4_000_000


@dataclass(frozen=True)
class Index:
    """A snapshot of an index, and the name of the documents' key."""

    at: Snapshot
    key: str

    @property
    def segments(self) -> list[dict]:
        return self.at.notes.get("segments", [])

    @property
    def ranges(self) -> int:
        return sum(s["ranges"] for s in self.segments)

    @property
    def size(self) -> int:
        """Documents in all segments, those that are gone too."""
        return sum(s["docs"] for s in self.segments)

    def _alive(self, rows: DataFrame) -> DataFrame:
        """rows (key, segment) of documents as they are now."""
        if "gone" not in self.at.tables:
            return rows
        gone = self.at.table("gone").groupBy(self.key).agg(F.max("segment").alias("gone_"))
        return rows.join(gone, self.key, "left").where(F.col("gone_").isNull() | (F.col("gone_") < F.col("segment"))).drop("gone_")

    def _read(self, table: str, part: str, lexemes: list[str] | None) -> list[tuple[dict, DataFrame]]:
        """Each segment and its rows of a table, of some lexemes alone: their buckets are all that is read."""
        found = []
        for s in self.segments:
            rows = self.at.table(table, parts=[s[part]])
            if lexemes is not None:
                buckets = sorted({zlib.crc32(x.encode()) % s["buckets"] for x in lexemes})
                rows = rows.where(F.col("bucket").isin(buckets) & F.col("lexeme").isin(lexemes))
            found.append((s, rows.withColumn("segment", F.lit(s["id"]))))
        return found

    def blocks(self, lexemes: list[str]) -> DataFrame:
        """(segment, range, lexeme, most): how often a document of the range has the lexeme at most."""
        rows = [r.select("segment", "range", "lexeme", "most") for _, r in self._read("blocks", "blocks", lexemes)]
        return _union(rows)

    def postings(self, lexemes: list[str], ranges: list[tuple[int, int]] | DataFrame | None = None) -> DataFrame:
        """(key, lexeme, places) of these lexemes, in all or some of the ranges (segment, range)."""
        found = []
        for s, rows in self._read("postings", "part", lexemes):
            if isinstance(ranges, list):
                rows = rows.where(F.col("range").isin([r for segment, r in ranges if segment == s["id"]]))
            found.append(rows.select(self.key, "lexeme", "places", "segment", "range"))
        rows = _union(found)
        if isinstance(ranges, DataFrame):
            rows = rows.join(ranges, ["segment", "range"], "left_semi")
        return self._alive(rows).select(self.key, "lexeme", "places")

    def all_postings(self) -> DataFrame:
        """(key, lexeme, places, n) of the whole index."""
        return self._alive(_union([r for _, r in self._read("postings", "part", None)])).select(self.key, "lexeme", "places", "n")

    def documents(self) -> DataFrame:
        """(key, digest, segment) of the documents as they are now."""
        return self._alive(self.at.table("docs"))

    def keys(self) -> DataFrame:
        return self.documents().select(self.key)


def _union(found: list[DataFrame]) -> DataFrame:
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows


def _bucket(buckets: int) -> Column:
    return (F.crc32(F.col("lexeme").cast("binary")) % buckets).cast("int")


def _range(key: str, length: Column, parts: dict[int, int]) -> Column:
    """A range's number by length class, and by a hash where a class has more documents than a range may."""
    many = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])
    return length.cast("long") * CLASS + F.pmod(F.xxhash64(key), F.element_at(many, length))


def _class(chars: Column) -> Column:
    """Four classes for each doubling of a text's length."""
    return F.floor(4 * F.log2(1 + chars)).cast("int")


def _put(change: Transaction, rows: DataFrame, key: str, segment: int, chars: int, parts: dict[int, int], docs: int) -> dict:
    """Write postings (lexeme, key, places, n, range) as a segment, with its blocks."""
    files = max(1, -(-chars // FILE_CHARS))
    buckets = min(MOST_BUCKETS, max(8, files))
    dealt = rows.withColumn("bucket", _bucket(buckets)).withColumn("file_", F.pmod("range", F.lit(-(-files // buckets))))
    part = change.append("postings", dealt.repartition("bucket", "file_").sortWithinPartitions("bucket", "lexeme", "range", key).drop("file_"), by=["bucket"])
    written = Snapshot(change.base.store, -1, {"postings": change.schemas["postings"] | {"parts": [part]}}, {}, {}).table("postings")
    most = written.groupBy("bucket", "lexeme", "range").agg(F.max("n").alias("most")).repartition("bucket")
    return {"id": segment, "part": part, "blocks": change.append("blocks", most, by=["bucket"]), "buckets": buckets, "ranges": sum(parts.values()), "docs": docs}


def _postings(batches):
    """Batches (key, range, words), words joined by blanks, as batches (lexeme, key, range, places, n). A text's words
    lie in one row, so no postings have to meet others."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def some(part):
        lists = pc.split_pattern(part.column(2), " ")
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        doc = np.repeat(np.arange(len(lengths)), lengths)
        place = (np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1).astype(np.int32)
        both = doc * len(words.dictionary) + words.indices.to_numpy()
        order = np.argsort(both, kind="stable")
        both = both[order]
        starts = np.concatenate([[0], np.flatnonzero(both[1:] != both[:-1]) + 1])
        ends = np.append(starts[1:], len(both))
        of = pa.array(doc[order[starts]])
        places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(both)).astype(np.int32)), pa.array(place[order]))
        lexeme = words.dictionary.take(pa.array(both[starts] % len(words.dictionary)))
        return pa.RecordBatch.from_arrays([lexeme, part.column(0).take(of), part.column(1).take(of), places, pa.array(ends - starts)], ["lexeme", "key", "range", "places", "n"])

    for batch in batches:
        chars = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(chars, (chars[at - 1] if at else 0) + AT_ONCE, "right")))
            yield some(batch.slice(at, upto - at))
            at = upto


def _add(change: Transaction, docs: DataFrame, key: str, text: str, segment: int) -> dict:
    """docs (key, digest, text) as a segment. Of a text, the index has its first half million characters; of a
    lexeme in a document, its places and how often it comes. The words are written once, for all that is read of them."""
    capped = docs.select(key, "digest", F.left(F.col(text), F.lit(DEFAULTS.index_chars)).alias("text_"))
    chars = F.char_length(F.coalesce("text_", F.lit("")))
    capped = change.stage(capped.select(key, "digest", chars.alias("chars_"), _class(chars).alias("class_"), T.joined_lexemes(F.col("text_")).alias("words_")))
    told = capped.groupBy(F.col("class_").alias("class")).agg(F.count("*").alias("n"), F.sum("chars_").alias("chars")).collect()
    parts = {r["class"]: -(-r["n"] // RANGE_DOCS) for r in told} or {0: 1}
    ranged = capped.where("words_ <> ''").select(F.col(key).alias("key"), _range(key, F.col("class_"), parts).alias("range"), "words_")
    rows = ranged.mapInArrow(_postings, f"lexeme string, key {capped.schema[key].dataType.simpleString()}, range bigint, places array<int>, n bigint")
    change.append("docs", capped.select(key, "digest", F.lit(segment).alias("segment")))
    return _put(change, rows.withColumnRenamed("key", key), key, segment, sum(r["chars"] for r in told), parts, sum(r["n"] for r in told))


def refresh(change: Transaction, docs: DataFrame, key: str, text: str) -> None:
    """Bring an index to what docs are now: only documents that are new or have another text are read into a new
    segment; those that went or changed are marked in the older ones. The key has to be unique."""
    digested = docs.select(key, text, F.coalesce(F.md5(F.col(text)), F.lit("")).alias("digest"))
    if not change.has("docs"):
        change.notes["segments"] = [_add(change, digested, key, text, 0)]
        return
    index = Index(change.base, key)
    known = index.documents().select(key, F.col("digest").alias("known_"))
    both = change.stage(digested.select(key, "digest").join(known, key, "full"))
    fresh = both.where("digest is not null and not (digest <=> known_)").select(key)
    segment = 1 + max(s["id"] for s in index.segments)
    change.append("gone", both.where("known_ is not null and not (digest <=> known_)").select(key, F.lit(segment - 1).alias("segment")))
    change.notes["segments"] = [*index.segments, _add(change, digested.join(fresh, key, "left_semi"), key, text, segment)]


def merge(change: Transaction, key: str) -> None:
    """All segments as one, without what is gone; no text is read."""
    index, segment = Index(change.base, key), 0
    change.reads |= {"docs", "gone", "postings", "blocks"}
    docs = change.stage(index.documents().select(key, "digest", F.lit(segment).alias("segment")))
    rows = index._alive(_union([r for _, r in index._read("postings", "part", None)]))
    length = F.floor(F.col("range") / CLASS).cast("int")
    classes = rows.select(key, length.alias("class")).distinct().groupBy("class").agg(F.count("*").alias("n")).collect()  # under a hundred
    parts = {r["class"]: -(-r["n"] // RANGE_DOCS) for r in classes} or {0: 1}
    rows = rows.select("lexeme", key, "places", "n", _range(key, length, parts).alias("range"))
    chars = 6 * (rows.agg(F.sum("n")).first()[0] or 0)  # about, to size files by
    change.replace("docs", docs)
    for name in ("postings", "blocks"):
        change.replaced.add(name)
    change.notes["segments"] = [_put(change, rows, key, segment, chars, parts, docs.count())]
    if "gone" in change.base.tables:
        change.replace("gone", change.base.table("gone").limit(0))


def build(docs: DataFrame, key: str, text: str, folder: str) -> Index:
    """The index in a folder, brought to what docs are now."""
    return Index(Store(docs.sparkSession, folder).run(lambda change: refresh(change, docs, key, text)), key)


def of_path(docs: DataFrame, key: str, text: str, path: str) -> Index:
    """The index of documents that come from a path: every session shares it, and it is refreshed when the files there are
    others than those that it was made from."""
    spark: SparkSession = docs.sparkSession
    store = Store(spark, workspace.lasting(spark, "text-index", LAYOUT, path, key, text))
    files = workspace.fingerprint(spark, path)
    now = store.snapshot()
    if now.notes.get("files") != files:

        def work(change: Transaction) -> None:
            if change.base.notes.get("files") != files:
                refresh(change, docs, key, text)
                change.notes["files"] = files

        now = store.run(work)
        if len(now.notes["segments"]) > MOST_SEGMENTS:
            now = store.run(lambda change: merge(change, key))
    return Index(now, key)
