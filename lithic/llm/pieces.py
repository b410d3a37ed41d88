"""SentencePiece BPE encoding by a prefix table, and decoding.

A merge-type vocabulary gives every prefix of a text one last token: the only token that ends
there and stands, as a merge would leave it, behind the last token of the prefix before it. An
Aho-Corasick automaton over the pieces yields the tokens that end at each place; a pair is
compatible if merging its two pieces' characters gives the same two pieces back. The table is
filled from left to right and the ids are read from its end backwards, in time linear in the text
for tokens of bounded length.

Texts fall apart where no piece can cross: before a space mark that follows another character,
around line feeds, and between a letter or digit and a sign that no piece has behind one. Segments
recur, so their results are kept in a table of bounded size.
"""

from __future__ import annotations

import functools
import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import alone, table

SPACE = "▁"
#: Segments and pairs whose results a Python worker keeps: when half as many are new, those not met since go.
SEGMENTS_KEPT, LONGEST_KEPT, PAIRS_KEPT = 440_000, 64, 400_000


class PieceModel:
    """A ``.model`` file of type BPE with byte fallback and the identity normaliser."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as format_

        proto = format_.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        rules = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback and leading space marks are supported")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or not rules.add_dummy_prefix:
            raise ValueError("only the identity normaliser with a leading space is supported")
        if any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.surface = [p.piece for p in proto.pieces]
        self.kind = [p.type for p in proto.pieces]
        self.byte_ids = [0] * 256
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.byte_ids[int(p.piece[3:-1], 16)] = i
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.end = next(i for i, p in enumerate(proto.pieces) if p.piece == "</s>")
        self.unknown_surface = proto.trainer_spec.unk_surface
        self.shown = [None if p.type in (2, 3, 6) else p.piece.replace(SPACE, " ") for p in proto.pieces]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if len(piece) > 1 and self.merge(piece) == [piece]:
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.segments = re.compile(self.pattern())
        self.pairs: dict[int, bool] = {}
        self.kept: dict[str, tuple[int, str, str]] = {}
        self.older_pairs: dict[int, bool] = {}
        self.older: dict[str, tuple[int, str, str]] = {}

    def pattern(self) -> str:
        """A regular expression whose matches cover a text and end only where no piece crosses."""
        pairs = {p[i - 1 : i + 1] for p in self.score for i in range(1, len(p))}
        if any(x[1] == SPACE != x[0] for x in pairs):
            return r"(?s).+"
        if any("\n" in x for x in pairs):
            return f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"
        signs = {c for p in self.score for c in p if not c.isalnum() and c not in (SPACE, "_")} - {x[1] for x in pairs if x[0].isalnum()}
        cut = f"{SPACE}*+[^\\W_]++(?=[{''.join(map(re.escape, sorted(signs)))}])|" if signs else ""
        return f"\n|{cut}{SPACE}*+[^{SPACE}\n]++|{SPACE}++"

    def merge(self, text: str) -> list[str]:
        """BPE by its definition, for short strings: join the best-scored pair, leftmost first."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str, key: int) -> bool:
        fits = self.older_pairs.get(key)
        if fits is None:
            fits = self.merge(a + b) == [a, b]
        if len(self.pairs) >= PAIRS_KEPT // 2:
            self.older_pairs, keep = dict(self.pairs), self.pairs
            keep.clear()  # the loop over a text holds on to this table
        self.pairs[key] = fits
        return fits

    def tokens(self, text: str) -> list[str]:
        """The pieces of a segment, single characters outside the vocabulary included."""
        ends: list[list[tuple[int, int]] | None] = [None] * len(text)
        for end, token in self.automaton.iter(text):  # the longest first
            if ends[end] is None:
                ends[end] = [token]
            else:
                ends[end].append(token)
        size, name, known = [0], [0], self.pairs.get
        for at, char in enumerate(text):
            alone = (1, ord(char) + (1 << 24))
            for token in (*ends[at], alone) if ends[at] else (alone,):
                start = at + 1 - token[0]
                if start == 0:
                    break
                key = name[start] << 32 | token[1]
                fits = known(key)
                if fits is None:
                    fits = self.compatible(text[start - size[start] : start], text[start : at + 1], key)
                if fits:
                    break
            else:
                raise AssertionError(f"no last token for a prefix of {text!r}")
            size.append(token[0])
            name.append(token[1])
        out, at = [], len(text)
        while at:
            out.append(text[at - size[at] : at])
            at -= size[at]
        return out[::-1]

    def segment(self, text: str) -> tuple[int, str, str]:
        """(number of ids, the ids as decimals joined by spaces, their decoded text)."""
        found = self.kept.get(text)
        if found is None:
            found = self.older.get(text)
            if found is None:
                ids = self.ids_of(self.tokens(text))
                found = len(ids), " ".join(map(str, ids)), self.surface_of(ids)
            if len(text) <= LONGEST_KEPT:
                if len(self.kept) >= SEGMENTS_KEPT // 2:
                    self.older, self.kept = self.kept, {}
                self.kept[text] = found
        return found

    def ids_of(self, pieces: list[str]) -> list[int]:
        ids: list[int] = []
        for piece in pieces:
            known = self.ids.get(piece)
            ids += [self.byte_ids[b] for b in piece.encode()] if known is None else [known]
        return ids

    def split(self, text: str) -> list[str]:
        return self.segments.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for part in self.split(text) for i in self.ids_of(self.tokens(part))]

    def surface_of(self, ids: list[int]) -> str:
        """Text of ids without the rule for the first space; bytes that are no UTF-8 become U+FFFD."""
        shown = [self.shown[i] for i in ids]
        if None not in shown:
            return "".join(shown)
        out, raw = [], bytearray()
        for i in [*ids, -1]:
            if i >= 0 and (byte := self.byte_of.get(i)) is not None:
                raw.append(byte)
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            if i >= 0 and self.kind[i] != 3:
                out.append(self.unknown_surface if self.kind[i] == 2 else self.shown[i])
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.surface_of(ids)
        first = next((i for i in ids if self.kind[i] != 3), None)
        return text[1:] if first is not None and self.kind[first] == 1 and self.surface[first].startswith(SPACE) else text


def _utf8(raw: bytes) -> str:
    """raw as text; every byte that starts no whole character becomes one U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as wrong:
            out.append(raw[at : at + wrong.start].decode() + "�")
            at += wrong.start + 1
    return "".join(out)


@functools.lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def _digests(path: str):
    def run(batches):
        alone("pieces", load.cache_clear)
        model = load(path)
        segment, end = model.segment, model.end
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in batch.column("text").to_pylist():
                parts = [segment(p) for p in model.split(text or "")]
                counts.append(sum(p[0] for p in parts) + 1)
                ids.append(hashlib.sha256(" ".join([*(p[1] for p in parts), str(end)]).encode()).hexdigest())
                back = "".join([p[2] for p in parts])
                decoded.append(hashlib.sha256((back[1:] if parts else back).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _round_trip(path: str):
    def run(batches):
        alone("pieces", load.cache_clear)
        model = load(path)
        for batch in batches:
            ids = [[*model.encode(t or ""), model.end] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([model.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) per row of docs: the ids with the end id, and their decoded text.

    Null text counts as empty: the end id alone. A text of any length is encoded whole, and of merges that tie
    the leftmost is first, as in the library. Repeated rows and null ids pass through; other columns are not
    read, whatever their names. No rows: no rows.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_round_trip(path), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row of docs; rows as in :func:`encode`."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_model())
