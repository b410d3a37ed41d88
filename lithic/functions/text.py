"""Text expressions: extraction, tokens, chunks, sentences, languages."""

from __future__ import annotations

import re
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lithic.settings import DEFAULTS

#: The frequent words by which a language is guessed.
STOP_WORDS = {
    "pt": "de que e o a do da em um para com não uma os no se na por mais as dos como mas foi ao".split(),
    "en": "the of and to in is that for it as with was on be at by this are from or an not have".split(),
    "es": "de la que el en y los del las un por con una su para es al lo como más pero sus".split(),
    "fr": "de la le et les des en un une du que qui dans pour pas sur au ce il est plus".split(),
    "de": "der die und in den von zu das mit sich auf für ist im dem nicht ein eine als auch".split(),
}


#: The elements that stay, by whether their text stands apart from what is around it.
APART = "p ul ol li h1 h2 h3 h4 table tr td th pre blockquote".split()
INLINE = "a b i em strong code".split()
#: HTML 4's character references by name, as the standard library has them.
REFERENCES = {name: chr(point) for name, point in sorted(name2codepoint.items())}
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z0-9]{2,8});"


def _referred(reference: Column) -> Column:
    """What a character reference stands for; itself if it stands for nothing."""
    body = F.substr(reference, F.lit(2), F.length(reference) - 2)
    point = F.when(body.rlike("^#[xX]"), F.conv(F.substr(body, F.lit(3)), 16, 10)).when(body.startswith("#"), F.substr(body, F.lit(2))).cast("int")
    by_point = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
    known = F.create_map(*[F.lit(x) for pair in REFERENCES.items() for x in pair])
    sound = point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF)
    return F.coalesce(F.when(body.startswith("#"), F.when(sound, by_point)).otherwise(F.try_element_at(known, body)), reference)


def decode_references(text: Column) -> Column:
    """text with its character references decoded, once each; most texts have none and stay as they are."""
    found = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), _referred)
    woven = F.array_join(F.zip_with(F.split(text, REFERENCE, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(text.rlike(REFERENCE), woven).otherwise(text)


def sanitize(html: Column) -> Column:
    """HTML with the elements of APART and INLINE only: attributes go but for links' http and https targets; scripts,
    styles and comments go with what they hold, other tags alone."""
    bare = F.regexp_replace(html, DROPPED, "")
    link = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']?(https?://[^\s\"'>]*)[^>]*>"
    marked = F.regexp_replace(bare, link, "\x02a href=\"$1\" rel=\"nofollow\"\x03")
    marked = F.regexp_replace(marked, rf"(?is)<(/?)({'|'.join(APART + INLINE)})(?=[\s/>])[^>]*>", "\x02$1$2\x03")
    return F.translate(F.regexp_replace(marked, r"(?s)</?[a-zA-Z!?][^>]*>", ""), "\x02\x03", "<>")


#: What goes with all that it holds.
DROPPED = r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->"


def strip_html(html: Column) -> Column:
    """Text of HTML: no scripts, styles and comments; the tags that part texts are blanks, other tags nothing;
    character references decoded, white space collapsed."""
    bare = F.regexp_replace(html, DROPPED, "")
    bare = F.regexp_replace(bare, rf"(?is)</?(?:{'|'.join(APART)})(?=[\s/>])[^>]*>", " ")
    bare = decode_references(F.regexp_replace(bare, r"(?s)<[^>]*>", ""))
    return F.trim(F.regexp_replace(bare, r"[ \t\n\r\f\x0B\u00A0]+", " "))


def enough_text(text: Column, least: int = DEFAULTS.min_text_chars) -> Column:
    return F.coalesce(F.length(text) >= least, F.lit(False))


def lexemes(text: Column) -> Column:
    """Lower-case runs of letters and digits of the whole text; no stemming and no stop words, as the corpus has many
    languages. Only the full-text index caps texts."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def joined_lexemes(text: Column) -> Column:
    """The same, joined by blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def chunks(text: Column, tokens: int = DEFAULTS.chunk_tokens, overlap_percent: int = DEFAULTS.chunk_overlap_percent) -> Column:
    """Overlapping pieces of tokens * 4 characters; the last one reaches the end. None of a blank text."""
    size = tokens * 4
    step = max(1, size - size * overlap_percent // 100)
    n = F.when(F.length(text) <= size, F.lit(1)).otherwise(F.ceil((F.length(text) - size) / F.lit(step)).cast("int") + 1)
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(text, i * step + 1, F.lit(size)))
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.array().cast("array<string>")).otherwise(pieces)


def language(text: Column) -> Column:
    """struct(code, confidence) by stop-word shares, or null: under twelve words or no clear winner.
    Equal shares go to the first code by alphabet."""

    def guess(words: Column) -> Column:
        shares = [F.struct((F.size(_those(words, stop)) / F.greatest(F.size(words), F.lit(1))).alias("share"), F.lit(code).alias("code")) for code, stop in sorted(STOP_WORDS.items())]
        order = lambda a, b: F.when(a["share"] > b["share"], -1).when(a["share"] < b["share"], 1).when(a["code"] < b["code"], -1).otherwise(1)

        def judged(ranked: Column) -> Column:
            confidence = 2 * ranked[0]["share"] - ranked[1]["share"]
            return F.when((F.size(words) >= 12) & (confidence >= 0.55), F.struct(ranked[0]["code"].alias("code"), F.least(F.lit(1.0), confidence).alias("confidence")))

        return let(F.array_sort(F.array(*shares), order), judged)

    return let(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)), guess)


def _those(words: Column, wanted: list[str]) -> Column:
    return F.filter(words, lambda w: w.isin(wanted))


def language_code(code: Column) -> Column:
    bare = F.lower(F.trim(code))
    return F.when(F.coalesce(bare, F.lit("")) == "", "und").when(F.length(bare) > 3, F.left(bare, F.lit(2))).otherwise(bare)


def let(value: Column, use) -> Column:
    """use(value) with value computed once: an expression named in a lambda would run for each element."""
    return F.transform(F.array(value), use)[0]


#: Rows of an Arrow batch that are Python objects at a time.
SLICE = 128


def by_slices(one, columns: list[pa.Array], kind: pa.DataType) -> pa.Array:
    """one(...) of each row. Only a slice's rows are Python objects at a time; all others stay in Arrow's memory, so a batch
    of many rows costs about its bytes."""
    done = []
    for at in range(0, len(columns[0]), SLICE):
        done.append(pa.array([one(*row) for row in zip(*[c.slice(at, SLICE).to_pylist() for c in columns], strict=True)], kind))
    return pa.concat_arrays(done) if done else pa.array([], kind)


#: Where sentences end: white space behind a closing sign, and line ends.
ENDS = re.compile(r"(?<=[.!?])[ \t\n\x0b\f\r]+|(?:\r\n|[\n\x0b\f\r\x85\u2028\u2029])+")
BLANKS, DIGITS = re.compile(r"[ \t\n\x0b\f\r]+"), re.compile("[0-9]+")


def sentences(text: str | None) -> dict[str, str]:
    """A text's sentences in order, white space collapsed: the first wording by key; keys ignore case and digits."""
    found: dict[str, str] = {}
    for part in ENDS.split(text or ""):
        wording = BLANKS.sub(" ", part).strip(" ")
        if wording:
            found.setdefault(DIGITS.sub("#", wording.lower()), wording)
    return found


CHANGES = StructType([StructField("added", ArrayType(StringType())), StructField("removed", ArrayType(StringType()))])


@F.arrow_udf(CHANGES)
def sentence_changes(old: pa.Array, new: pa.Array) -> pa.Array:
    """Wordings of the sentences that only the new text has, and that only the old one had, in order. Sets of
    keys are compared, so a pair costs what its texts are long."""

    def one(a: str | None, b: str | None) -> dict:
        a, b = sentences(a), sentences(b)
        return {"added": [w for k, w in b.items() if k not in a], "removed": [w for k, w in a.items() if k not in b]}

    return by_slices(one, [old, new], pa.struct({"added": pa.list_(pa.string()), "removed": pa.list_(pa.string())}))


def changed_chars(added: Column, removed: Column) -> Column:
    return F.aggregate(F.concat(added, removed), F.lit(0), lambda n, s: n + F.length(s))


def snippet(text: Column, most: int = DEFAULTS.snippet_chars) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.length(whole) > most, F.concat(F.left(whole, F.lit(most)), F.lit("…"))).otherwise(whole)


def strip_source_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)</?source\b[^>]*>", "")


def tokens_floor(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def tokens_ceil(text: Column) -> Column:
    return F.floor((F.length(text) + 3) / 4)


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def name_uuid(name: Column) -> Column:
    """The name-based (version 3) UUID of a string without a name space."""
    h = F.md5(name)
    variant = F.substr(F.lit("89ab"), (F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat(F.substr(h, F.lit(1), F.lit(8)), F.lit("-"), F.substr(h, F.lit(9), F.lit(4)), F.lit("-3"), F.substr(h, F.lit(14), F.lit(3)), F.lit("-"), variant, F.substr(h, F.lit(18), F.lit(3)), F.lit("-"), F.substr(h, F.lit(21), F.lit(12)))
