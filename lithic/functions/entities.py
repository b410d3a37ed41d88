"""Pattern entities with checksums, their keys and their merging."""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from lithic.settings import DEFAULTS

#: Type, pattern and confidence of each rule, in order; and the alphabets of the checksums.
RULES = (
    ("crypto_wallet", r"(?<![A-Za-z0-9])[13][1-9A-HJ-NP-Za-km-z]{25,34}(?![A-Za-z0-9])", 1.0, "base58"),
    ("crypto_wallet", r"(?<![A-Za-z0-9])(?:bc1|BC1)[02-9ac-hj-np-zAC-HJ-NP-Z]{11,71}(?![A-Za-z0-9])", 1.0, "bech32"),
    ("crypto_wallet", r"(?<![A-Za-z0-9])0x[0-9a-fA-F]{40}(?![A-Za-z0-9])", 0.9, None),
    ("crypto_wallet", r"(?<![A-Za-z0-9])[48][0-9AB][1-9A-HJ-NP-Za-km-z]{93}(?![A-Za-z0-9])", 0.8, None),
    ("onion_service", r"(?i)(?<![A-Za-z0-9])[a-z2-7]{56}\.onion(?![A-Za-z0-9])", 1.0, "onion"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9])", 0.9, None),
    ("pgp_fingerprint", r"(?<![0-9A-Fa-fxX])(?:[0-9A-Fa-f]{4} ?){9}[0-9A-Fa-f]{4}(?![0-9A-Fa-f])", 0.9, None),
)
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_GENERATORS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
BECH32_ENDS = (1, 0x2BC830A3)
NAMED = ("person", "organization", "location", "technology")


def valid_base58(address: str) -> bool:
    """25 bytes, version 0 or 5, closed by four bytes of their double SHA-256."""
    number = 0
    for c in address:
        at = BASE58.find(c)
        if at < 0:
            return False
        number = number * 58 + at
    body = number.to_bytes((number.bit_length() + 7) // 8, "big")
    raw = bytes(len(address) - len(address.lstrip("1"))) + body
    if len(raw) != 25 or raw[0] not in (0, 5):
        return False
    return hashlib.sha256(hashlib.sha256(raw[:21]).digest()).digest()[:4] == raw[21:]


def valid_bech32(address: str) -> bool:
    """One letter case, and a checksum that closes on either of the two published constants."""
    if address.lower() != address and address.upper() != address:
        return False
    human, _, data = address.lower().rpartition("1")
    values = [BECH32.find(c) for c in data]
    if not human or len(values) < 6 or -1 in values:
        return False
    check = 1
    for v in [*(ord(c) >> 5 for c in human), 0, *(ord(c) & 31 for c in human), *values]:
        top, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ v
        for i, generator in enumerate(BECH32_GENERATORS):
            if top >> i & 1:
                check ^= generator
    return check in BECH32_ENDS


def valid_onion(host: str) -> bool:
    """35 bytes of base 32: a key, two bytes of checksum, version 3."""
    import base64

    raw = base64.b32decode(host[:56].upper())
    key, check, version = raw[:32], raw[32:34], raw[34]
    return version == 3 and hashlib.sha3_256(b".onion checksum" + key + bytes([version])).digest()[:2] == check


CHECKS = {"base58": valid_base58, "bech32": valid_bech32, "onion": valid_onion}


@F.pandas_udf(BooleanType())
def checksum_holds(value: pd.Series, rule: pd.Series) -> pd.Series:
    """Whether a value passes a rule's check; one without a check passes."""
    return pd.Series([r is None or CHECKS[r](v) for v, r in zip(value, rule, strict=True)], dtype="boolean")


@F.pandas_udf(StringType())
def without_marks(value: pd.Series) -> pd.Series:
    return value.map(lambda v: None if v is None else "".join(c for c in unicodedata.normalize("NFD", v) if not unicodedata.combining(c)))


def fold(value: Column) -> Column:
    """Lower case without accents, white space collapsed. ASCII never leaves the JVM."""
    plain = F.when(value.rlike(r"^\p{ASCII}*$"), value).otherwise(without_marks(value))
    return F.trim(F.regexp_replace(F.lower(plain), r"\s+", " "))


def entity_key(kind: Column, display: Column) -> Column:
    """The form by which mentions of an entity meet. Names are expected folded already."""
    value = F.trim(display)
    return (
        F.when(kind == "crypto_wallet", F.when(F.lower(value).startswith("bc1") | value.startswith("0x"), F.lower(value)).otherwise(value))
        .when(kind.isin("onion_service", "email"), F.lower(value))
        .when(kind == "pgp_fingerprint", F.upper(F.regexp_replace(value, r"\s+", "")))
        .otherwise(F.trim(F.regexp_replace(F.lower(value), r"\s+", " ")))
    )


def pattern_entities(docs: DataFrame, key: str, text: str, types: tuple[str, ...] = ()) -> DataFrame:
    """(key, pos, type, entity_key, display, confidence): valid matches in rule order, then in text order; of the named
    types only, if any are named."""
    rules = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(kind).alias("type"), F.lit(conf).alias("confidence"), F.lit(check).cast("string").alias("check"), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)).alias("found")) for i, (kind, p, conf, check) in enumerate(RULES) if not types or kind in types])
    rows = docs.select(key, F.explode(F.filter(rules, lambda r: F.size(r["found"]) > 0)).alias("r")).select(key, "r.*").select(key, "rule", "type", "confidence", "check", F.posexplode("found").alias("at", "display"))
    if any(check for kind, _, _, check in RULES if not types or kind in types):
        rows = rows.where(checksum_holds("display", "check"))
    return rows.select(key, (F.col("rule") * 1_000_000 + F.col("at")).alias("pos"), "type", entity_key(F.col("type"), F.col("display")).alias("entity_key"), "display", "confidence")


def merge_entities(rows: DataFrame, key: str, most: int = DEFAULTS.max_entities) -> DataFrame:
    """Per key and entity the mention of highest confidence at the place of the first; the first ``most``."""
    from pyspark.sql import Window

    merged = rows.groupBy(key, "type", "entity_key").agg(F.min("pos").alias("pos"), F.max_by(F.struct("display", "confidence"), F.struct("confidence", -F.col("pos"))).alias("top"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("pos", "type", "entity_key"))
    return merged.withColumn("place", place).where(F.col("place") <= most).select(key, "place", "type", "entity_key", "top.display", "top.confidence")


def valid_named(entities: Column, floor: float = DEFAULTS.min_entity_confidence) -> Column:
    """A model's named entities of known type, usable value and enough confidence."""
    return F.filter(entities, lambda e: F.lower(e["type"]).isin(*NAMED) & (F.length(F.trim(e["value"])) > 0) & (F.length(e["value"]) <= 200) & (e["confidence"] >= floor))


def of_documents(patterns: DataFrame, named: DataFrame, key: str, model: Column) -> DataFrame:
    """(key, status, entities) of documents: pattern entities of whole texts and the model's named ones, merged.
    ``model`` says how the model's call ended: if it failed the pattern entities stay and the step has failed; if
    only quota was missing nothing is kept and the document waits. named: (key, entities or null, and what
    ``model`` reads)."""
    named = named.withColumn("model_", model)
    good = named.where("model_ = 'ok'").select(key, F.posexplode(valid_named(F.col("entities"))).alias("at", "e"))
    good = good.select(key, (F.lit(len(RULES) * 1_000_000) + F.col("at")).alias("pos"), F.lower("e.type").alias("type"), fold(F.col("e.value")).alias("entity_key"), F.trim("e.value").alias("display"), F.col("e.confidence").alias("confidence"))
    merged = merge_entities(patterns.unionByName(good), key)
    lists = merged.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "type", "entity_key", "display", "confidence"))).alias("entities_"))
    rows = named.select(key, "model_").join(lists, key, "left")
    status = F.when(F.col("model_") == "ok", "processed").when(F.col("model_") == "quota", "waiting").otherwise("failed")
    return rows.select(key, status.alias("status"), F.when(F.col("model_") != "quota", F.coalesce("entities_", F.array().cast(lists.schema["entities_"].dataType))).alias("entities"))


def label(kind: Column) -> Column:
    """crypto_wallet as CryptoWallet."""
    return F.replace(F.initcap(F.replace(F.lower(kind), F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
