"""Surrogates for personal data: keyed, type-consistent, distinct and coreferent. DataFrame functions only.

Detected: e-mail addresses, phone and card numbers, IPv4 addresses, social security numbers, IBANs,
access keys, values of password and token assignments, and names behind a title together with their later
and earlier mentions in the text. Every entity has a
canonical form (digits of a number, lower-case address, one name word), and its surrogate is drawn from
a keyed digest of that form, so that an entity is replaced alike wherever and however it is written. The
surrogate keeps the type's shape: digits stay digits in the written layout, letters keep their case,
hex stays hex, a card keeps its issuer digit and whether its check digit holds, a name keeps its title,
its script and the gender that the title tells.

Collision check: two entities of a type that drew one surrogate, or a surrogate that is itself an
entity of the corpus, are found on the table of distinct entities, and all but the first are drawn anew
until none is left. So distinct entities stay distinct and no text comes to name another's entity.

Scale: texts are scanned in place; only distinct entities are shuffled. Texts with entities join their
replacements by the text's digest, which copies share; all other texts never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, heavy_keys, spread_join, table

KEY = "surrogate-key-1"
MOST_DRAWS = 24

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "г-жа"]
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н"]
NEUTRAL = ["Dr", "Doctor", "Docteur", "Doktor", "Prof", "Professor", "Professeur", "Rev", "Mx", "д-р", "проф"]
TITLE = "(?:" + "|".join(sorted(FEMALE + MALE + NEUTRAL, key=lambda t: (-len(t), t))) + r")\.?"
TITLES = rf"{TITLE}(?:\s{TITLE}(?=\s))*"
#: A capitalised word, and what is no part of a name at its end.
WORD, TAIL = r"(?<!\p{L})\p{Lu}[\p{L}'-]+", r"(?:'s|['-])+$"
#: Type and pattern, in the order in which they are tried at a place; no pattern matches the empty text.
#: An address gives back a full stop behind it; a host name has at most 127 labels. A secret's key may have any prefix (access_token).
PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9_][\w.%+-]*+@[A-Za-z0-9](?:[A-Za-z0-9-]*+\.){1,127}[A-Za-z]{2,24}",
    "secret": r"(?=[pstaPSTA])(?i:password|passwd|secret|token|api_key)\s?[=:]\s?[\"']?[^\s\"',;]{6,}",
    "access": r"\bAKIA[A-Z0-9]{16}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)",
    "card": r"(?<![\d-])(?:\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}|3[47]\d{13})(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]\d{4}(?![\d-])|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)",
    "name": rf"(?<!\p{{L}}){TITLES}\s\p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+){{0,2}}",
}
#: A secret's value.
SECRET = r"[=:]\s?[\"']?([^\s\"',;]{6,})$"


def _either(*kinds: str) -> str:
    return "|".join(f"(?:{PATTERNS[k]})" for k in kinds)


#: Any of them, in that order, each asked only where its first character and the one before allow it: inside a
#: word only a secret's key can begin, and what begins with a digit, sign or bracket is none of the others.
ANY = (
    rf"(?<![A-Za-z])(?:{_either('email')}|(?=[A-Z])(?:{_either('access', 'iban')})|(?=[{''.join(sorted({t[0] for t in FEMALE + MALE + NEUTRAL}))}]){_either('name')})"
    rf"|(?=[0-9(+])(?:{_either('ip', 'card', 'ssn', 'phone')})|(?=[pP][aA]|[sS][eE]|[tT][oO]|[aA][pP]){_either('secret')}"
)


def _type(surface: Column) -> Column:
    # what stands around a match is not seen here, so look-behinds hold trivially
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        kind = F.when(surface.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(kind)
    return kind


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _one_of(titles: list[str]) -> str:
    return r"(?<!\S)(?:" + "|".join(titles) + r")(?!\p{L})"


def _name(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, TAIL, ""))


def mentions(docs: DataFrame) -> DataFrame:
    """(digest, surface, type, n) of the distinct matches of each distinct text, which n rows have."""
    found = docs.select("text").select(F.md5("text").alias("digest"), F.array_distinct(F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("found"))
    counted = found.where(F.size("found") > 0).select("digest", F.explode("found").alias("surface")).groupBy("digest", "surface").agg(F.count("*").alias("n"))
    return counted.withColumn("type", F.coalesce(_type(F.col("surface")), F.lit("other")))


def parts(surfaces: DataFrame) -> DataFrame:
    """(surface, type, n, kind, canon): a surface's entities; a name has one per word, others one.

    ``kind`` is the space in which surrogates must differ; a name word's tells gender and script.
    """
    s = F.col("surface")
    value = (
        F.when(F.col("type") == "email", F.lower(s))
        .when(F.col("type") == "secret", F.regexp_extract(s, SECRET, 1))
        .when(F.col("type") == "phone", F.right(_digits(s), F.lit(10)))
        .when(F.col("type").isin("card", "ssn"), _digits(s))
        .when(F.col("type") == "iban", F.replace(s, F.lit(" "), F.lit("")))
        .otherwise(s)
    )
    words = F.split(F.regexp_replace(s, rf"^{TITLES}\s", ""), " ")
    title = F.regexp_extract(s, rf"^{TITLES}\s", 0)
    gender = F.when(title.rlike(_one_of(FEMALE)), "f").when(title.rlike(_one_of(MALE)), "m").otherwise("n")
    script = F.when(s.rlike(r"\p{IsCyrillic}$"), "cyrillic").when(s.rlike(r"\p{IsGreek}$"), "greek").otherwise("latin")
    names = F.transform(words, lambda w, i: F.struct(F.concat(F.when(i == F.size(words) - 1, "last").otherwise(F.concat(F.lit("first_"), gender)), F.lit("_"), script).alias("kind"), _name(w).alias("canon")))
    one = F.array(F.struct(F.col("type").alias("kind"), value.alias("canon")))
    return surfaces.select("surface", "type", F.posexplode(F.when(F.col("type") == "name", names).otherwise(one)).alias("n", "e")).select("surface", "type", "n", "e.kind", "e.canon")


#: Characters of a surrogate by the digest byte at their place; b(i) is that byte.
_SHAPE = """
transform(split({text}, ''), (c, i) -> CASE
  WHEN {text} rlike '^(?=.*[a-f])[0-9a-f]{{16,}}$' THEN substr('0123456789abcdef', b_(i) % 16 + 1, 1)
  WHEN c rlike '[0-9]' THEN substr('0123456789', b_(i) % 10 + 1, 1)
  WHEN c rlike '[a-z]' THEN substr('abcdefghijklmnopqrstuvwxyz', b_(i) % 26 + 1, 1)
  WHEN c rlike '[A-Z]' THEN substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', b_(i) % 26 + 1, 1)
  WHEN c rlike '[\\\\p{{IsCyrillic}}&&\\\\p{{Lu}}]' THEN substr('АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ', b_(i) % 27 + 1, 1)
  WHEN c rlike '\\\\p{{IsCyrillic}}' THEN substr('абвгдежзиклмнопрстуфхцчшэюя', b_(i) % 27 + 1, 1)
  WHEN c rlike '[\\\\p{{IsGreek}}&&\\\\p{{Lu}}]' THEN substr('ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ', b_(i) % 24 + 1, 1)
  WHEN c rlike '\\\\p{{IsGreek}}' THEN substr('αβγδεζηθικλμνξοπρστυφχψω', b_(i) % 24 + 1, 1)
  WHEN c rlike '\\\\p{{IsHan}}' THEN substr('的一是不了人我在有他这中大来上国个到说们为子和你地出道也时年', b_(i) % 30 + 1, 1)
  WHEN c rlike '\\\\p{{L}}' THEN substr('abcdefghijklmnopqrstuvwxyz', b_(i) % 26 + 1, 1)
  WHEN kind = 'secret' AND draw > 0 AND c rlike '[^\\\\p{{L}}]' THEN substr('!#$%&*+-/?^_~|', b_(i) % 14 + 1, 1)
  ELSE c END)
"""
#: From the draw after PATIENCE on, each draw has one more character or syllable to choose.
PATIENCE = 2


def _with_bytes(sql: str, digest: str) -> str:
    return sql.replace("b_(i)", f"cast(conv(substr({digest}, 2 * (i % 64) + 1, 2), 16, 10) as int)")


def _digest(*columns: Column) -> Column:
    keyed = F.concat_ws("|", F.lit(KEY), *columns)
    return F.concat(F.sha2(F.concat(keyed, F.lit("|0")), 256), F.sha2(F.concat(keyed, F.lit("|1")), 256))


def _draw(entities: DataFrame) -> DataFrame:
    """entities (kind, canon, draw) with their surrogate of that draw."""
    e = entities.withColumn("d", _digest(F.col("kind"), F.col("canon"), F.col("draw").cast("string"))).withColumn("host", F.regexp_extract("canon", "@(.*)[.][^.]*$", 1))
    e = e.withColumn("dh", _digest(F.lit("host"), F.col("host")))
    shaped = f"array_join({_with_bytes(_SHAPE.format(text='canon'), 'd')}, '')"
    local = f"array_join({_with_bytes(_SHAPE.format(text="substring_index(canon, '@', 1)"), 'd')}, '')"
    host = f"array_join({_with_bytes(_SHAPE.format(text='host'), 'dh')}, '')"
    more = f"greatest(draw - {PATIENCE}, 0)"
    tail = "CASE WHEN {0} = 0 THEN '' ELSE array_join(transform(sequence(33, 32 + {0}), i -> substr('{1}', b_(i) % {2} + 1, 1)), '') END"
    letters = F.expr(_with_bytes(tail.format(more, "abcdefghijklmnopqrstuvwxyz", 26), "d"))
    digits = F.expr(_with_bytes(tail.format(more, "0123456789", 10), "d"))
    octets = _with_bytes("array_join(transform(sequence(0, 3), i -> cast(1 + b_(i) % 254 as string)), '.')", "d")
    phone = "concat(substr('23456789', try_cast(substr(shaped, 1, 1) as int) % 8 + 1, 1), substr(shaped, 2))"
    # syllables: consonant and vowel by turns, as many as the word is long and some more in late draws, and an ending of its gender
    syllables = _with_bytes("array_join(transform(sequence(0, least(greatest(cast(length(canon) / 2 as int), 2), 6) + more_ - 1), i -> concat(substr('bdfgklmnprstvz', b_(i) % 14 + 1, 1), substr('aeiou', cast(b_(i) / 14 as int) % 5 + 1, 1))), '')".replace("more_", more), "d")
    luhn = "(aggregate(sequence(1, length({0}) - 1), 0, (s, i) -> s + CASE WHEN (length({0}) - i) % 2 = 1 THEN 2 * try_cast(substr({0}, i, 1) as int) - CASE WHEN substr({0}, i, 1) > '4' THEN 9 ELSE 0 END ELSE try_cast(substr({0}, i, 1) as int) END) * 9 % 10)"
    e = e.withColumn("shaped", F.expr(shaped))
    e = e.withColumn("card", F.when(F.col("kind") == "card", F.expr("concat(left(canon, 1), substr(shaped, 2))")).otherwise(F.lit("00")))
    check = F.expr(f"cast(({luhn.format('card')} + CASE WHEN {luhn.format('canon')} = try_cast(right(canon, 1) as int) THEN 0 ELSE 1 END) % 10 as string)")
    e = e.withColumn("word", F.expr(syllables))
    e = e.withColumn("word", F.when(F.col("kind").startswith("first_f"), F.concat("word", F.lit("na"))).when(F.col("kind").startswith("first_m"), F.concat("word", F.lit("n"))).when(F.col("kind").startswith("first_n"), F.concat("word", F.lit("l"))).otherwise(F.concat("word", F.lit("r"))))
    letters_of = {"cyrillic": "бдфгклмнпрствзаеиоу", "greek": "βδφγκλμνπρστξζαεηου"}
    written = F.col("word")
    for script, alphabet in letters_of.items():
        written = F.when(F.col("kind").endswith(script), F.translate("word", "bdfgklmnprstvzaeiou", alphabet)).otherwise(written)
    e = e.withColumn("word", written)
    surrogate = (
        F.when(F.col("kind") == "email", F.concat(F.expr(local), letters, F.lit("@"), F.expr(host), F.lit("."), F.substring_index("canon", ".", -1)))
        .when(F.col("kind") == "ip", F.expr(octets))
        .when(F.col("kind") == "phone", F.concat(F.expr(phone), digits))
        .when(F.col("kind") == "card", F.concat(F.expr("left(card, length(card) - 1)"), check))
        .when(F.col("kind") == "access", F.concat(F.lit("AKIA"), F.expr("substr(shaped, 5)")))
        .when(F.col("kind") == "iban", F.concat(F.expr("left(canon, 2)"), F.expr("substr(shaped, 3)")))
        .when(F.col("kind").rlike("^(first|last)_"), F.col("word"))
        .when(F.col("kind") == "secret", F.concat("shaped", letters))
        .otherwise(F.col("shaped"))
    )
    return e.select("kind", "canon", "draw", surrogate.alias("surrogate"))


def distinct_surrogates(entities: DataFrame) -> DataFrame:
    """(kind, canon, surrogate) for distinct (kind, canon): no surrogate twice in a kind, none that is an
    entity of its kind. Late draws choose among ever longer names, addresses, secrets and phone numbers; the
    other kinds keep their fixed length, of 10^9 forms and more. Raises if these run out."""
    drawn = cut(_draw(entities.select("kind", "canon").distinct().withColumn("draw", F.lit(0))))
    for _ in range(MOST_DRAWS):
        order = Window.partitionBy("kind", "surrogate").orderBy("draw", "canon")
        own = drawn.select(F.col("kind").alias("k"), F.col("canon").alias("c"))
        ranked = drawn.withColumn("place", F.row_number().over(order))
        checked = ranked.join(own, (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("c")), "left").withColumn("clash", (F.col("place") > 1) | F.col("c").isNotNull()).select(*drawn.columns, "clash")
        if not checked.where("clash").limit(1).count():
            return drawn.select("kind", "canon", "surrogate")
        checked = cut(checked)
        again = _draw(checked.where("clash").select("kind", "canon", (F.col("draw") + 1).alias("draw")))
        drawn = cut(checked.where("not clash").drop("clash").unionByName(again))
    raise RuntimeError("surrogates of some shape have run out")


def _laid_out(digits: str) -> str:
    """SQL: the surface with its digits replaced, in order, by those of a column; what it has more comes behind."""
    return f"aggregate(split(surface, ''), named_struct('s', '', 'k', 1), (a, c) -> CASE WHEN c rlike '[0-9]' THEN named_struct('s', concat(a.s, substr({digits}, a.k, 1)), 'k', a.k + 1) ELSE named_struct('s', concat(a.s, c), 'k', a.k) END, a -> concat(a.s, substr({digits}, a.k)))"


def replacements(surfaces: DataFrame) -> DataFrame:
    """(surface, replacement, words) for distinct (surface, type); words has (canon, place, surrogate) of a name's words."""
    entities = parts(surfaces)
    drawn = distinct_surrogates(entities)
    named = entities.join(drawn, ["kind", "canon"]).groupBy("surface", "type").agg(F.array_sort(F.collect_list(F.struct("n", "surrogate", "canon", "kind"))).alias("s"))
    named = named.withColumn("own", F.regexp_extract("surface", SECRET, 1)).withColumn("one", F.col("s")[0]["surrogate"]).withColumn("number", F.concat(F.expr("left(regexp_replace(surface, '[^0-9]', ''), greatest(length(regexp_replace(surface, '[^0-9]', '')) - 10, 0))"), F.col("one")))
    own = F.split(F.regexp_replace("surface", rf"^{TITLES}\s", ""), " ")
    written = F.array_join(F.zip_with("s", own, lambda x, w: F.concat(F.initcap(x["surrogate"]), F.regexp_extract(w, TAIL, 0))), " ")
    place = lambda kind: F.when(kind.startswith("last_"), 0).when(kind.startswith("first_n"), 2).otherwise(1)
    words = F.transform(F.filter("s", lambda x: F.col("type") == "name"), lambda x: F.struct(x["canon"].alias("canon"), place(x["kind"]).alias("place"), F.initcap(x["surrogate"]).alias("surrogate")))
    signs = F.expr("aggregate(split(surface, ''), named_struct('s', '', 'k', 1), (a, c) -> CASE WHEN c <> ' ' THEN named_struct('s', concat(a.s, substr(one, a.k, 1)), 'k', a.k + 1) ELSE named_struct('s', concat(a.s, c), 'k', a.k) END).s")
    replacement = (
        F.when(F.col("type") == "phone", F.expr(_laid_out("number")))
        .when(F.col("type").isin("card", "ssn"), F.expr(_laid_out("one")))
        .when(F.col("type") == "iban", signs)
        .when(F.col("type") == "secret", F.concat(F.expr("left(surface, length(surface) - length(own))"), F.col("one")))
        .when(F.col("type") == "name", F.concat(F.regexp_extract("surface", rf"^{TITLES}\s", 0), written))
        .when(F.col("type") == "email", F.expr("array_join(transform(split(one, ''), (c, i) -> CASE WHEN substr(surface, i + 1, 1) rlike '[A-Z]' THEN upper(c) ELSE c END), '')"))
        .otherwise(F.col("one"))
    )
    return named.select("surface", replacement.alias("replacement"), words.alias("words"))


def _renamed(word: Column) -> Column:
    """A capitalised word as names_ has it, whole or by its parts at hyphens and apostrophes."""
    whole = F.concat(F.element_at("names_", _name(word)), F.regexp_extract(word, TAIL, 0))
    parts = F.transform(F.split(word, "(?<=['-])|(?=['-])"), lambda p: F.when(p.rlike(r"^\p{Lu}"), F.coalesce(F.element_at("names_", F.lower(p)), p)).otherwise(p))
    return F.coalesce(whole, F.array_join(parts, ""))


def _mentioned_again(text: Column) -> Column:
    """text with the words of names_ in it replaced."""
    swapped = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: _renamed(w))
    return F.array_join(F.zip_with(F.split(text, WORD, -1), swapped, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def replace(docs: DataFrame, count: str | None = "n_entities") -> DataFrame:
    """docs with every entity in ``text`` replaced, all columns kept, and n_entities (or what ``count`` says), the
    number of replaced places; none if ``count`` is None. The words of a name found behind a title are replaced wherever they come again in the
    text as capitalised words.

    A null text stays null with 0 entities, an empty one empty. A text without entities is returned
    unchanged, one of any length is read whole. Equal entities get equal surrogates across all rows, repeated
    rows included; of two first names that one name word has in a text, that of a gendered title stands. A
    column of docs that is called as the count is overwritten, no other name clashes. If docs has ``n_chars`` it
    follows the text. No rows: no rows.
    """
    found = cut(mentions(docs))
    per_surface, per_text = (found.groupBy(c).agg(n.alias("n")) for c, n in (("surface", F.count("*")), ("digest", F.max("n"))))
    surrogate = cut(replacements(found.select("surface", "type").distinct()))
    swaps = spread_join(found.select("digest", "surface"), surrogate, "surface", heavy_keys(per_surface, "surface", "n"))
    by_text = swaps.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("surface", "replacement"))).alias("swap_"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("words")))).alias("words_"))
    firsts = F.expr("filter(words_, (x, i) -> i = 0 OR x.canon <> words_[greatest(i - 1, 0)].canon)")
    by_text = by_text.select("digest", "swap_", F.map_from_entries(F.transform(firsts, lambda x: F.struct(x["canon"], x["surrogate"]))).alias("names_"))
    marked = F.coalesce(F.col("text").rlike(ANY), F.lit(False))
    heavy = heavy_keys(per_text, "digest", "n")
    columns = [c for c in docs.columns if c != count]
    bare = docs.where(~marked).select(*[F.col(f"`{c}`") for c in columns], *([F.lit(0).cast("long").alias(count)] if count else []))
    whole = [F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row_"), F.col("text").alias("text_"), F.md5("text").alias("digest")]
    rows = docs.where(marked & ~F.md5("text").isin(heavy)).select(*whole).join(by_text.where(~F.col("digest").isin(heavy)), "digest", "left")
    if heavy:  # these are known to have an entity
        rows = rows.unionByName(docs.where(F.md5("text").isin(heavy)).select(*whole).join(F.broadcast(by_text.where(F.col("digest").isin(heavy))), "digest", "left"))
    rows = rows.withColumn("at_", F.regexp_extract_all("text_", F.lit(ANY), F.lit(0))).withColumn("gaps_", F.split("text_", ANY, -1))
    # a title without gender does not tell which kind of first name it is: the text's other mentions do
    title = lambda x: F.regexp_extract(x, rf"^{TITLES}\s", 0)
    open_ = lambda x: (title(x) != "") & ~title(x).rlike(_one_of(FEMALE + MALE))
    lost = F.raise_error(F.lit("an entity has no surrogate"))
    swapped = F.transform("at_", lambda x: F.when(open_(x), F.concat(title(x), _mentioned_again(F.regexp_replace(x, rf"^{TITLES}\s", "")))).otherwise(F.coalesce(F.element_at("swap_", x), lost)))
    again = F.transform("gaps_", lambda g: F.size(F.filter(F.regexp_extract_all(g, F.lit(WORD), F.lit(0)), lambda w: _renamed(w) != w)))
    n_again = F.when(F.size("names_") > 0, F.aggregate(again, F.lit(0), lambda n, k: n + k)).otherwise(F.lit(0))
    gaps = F.when(F.size("names_") > 0, F.transform("gaps_", _mentioned_again)).otherwise(F.col("gaps_"))
    # there is a gap more than there are entities
    woven = F.zip_with(gaps, swapped, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    rows = rows.withColumn("new_", F.array_join(woven, "")).withColumn("n_", (F.size("at_") + n_again).cast("long"))
    put = {"text": F.col("new_")}
    if "n_chars" in columns:
        put["n_chars"] = F.length("new_").cast(docs.schema["n_chars"].dataType)
    return bare.unionByName(rows.select(*[put.get(c, F.col("row_").getField(c)).alias(c) for c in columns], *([F.col("n_").alias(count)] if count else [])))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(table(spark, sf_dir, "documents").select("doc_id", "text"))
