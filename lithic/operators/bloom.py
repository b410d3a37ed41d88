"""Keys that were surely not seen, told by a bit array before the exact question is asked.

The array is an aggregate: seen keys set bits in blocks of 32,768, partial arrays are merged by OR on both sides of the
shuffle, and a key's bits all lie in the block that its hash names. A key with a bit unset is new for sure and is not
shuffled; only the others, the seen ones and a few more, meet the seen keys in an anti-join. So the answer is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a block, which Spark's bitmaps fix; bits a key; bits that are set for it; blocks at most, 64 MB together.
BLOCK, BITS, SET, MOST_BLOCKS = 32_768, 16, 4, 16_384


@dataclass(frozen=True)
class Filter:
    """(block, bits) of the blocks that hold a key, no more than ``blocks``."""

    rows: DataFrame
    blocks: int

    def split(self, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        """(rows that may have been seen, rows that were not)."""
        # MOST_BLOCKS blocks of 4 KB at most
        told = rows.withColumn("block_", _block(F.col(key), self.blocks)).join(F.broadcast(self.rows.withColumnRenamed("block", "block_")), "block_", "left")
        maybe = F.col("bits").isNotNull()
        for k in range(SET):
            at = _bit(F.col(key), k)
            byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            maybe = maybe & (F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1)
        told = told.withColumn("maybe_", F.coalesce(maybe, F.lit(False)))
        return told.where("maybe_").select(rows.columns), told.where("not maybe_").select(rows.columns)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: Column, k: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(k)), F.lit(BLOCK)).cast("int")


def of_keys(seen: DataFrame, key: str, count: int | None = None) -> Filter:
    """The filter of a table's keys; ``count``, if known, sizes it. More keys than MOST_BLOCKS is made for let more pass, and none
    too few."""
    n = seen.count() if count is None else count
    blocks = min(MOST_BLOCKS, max(1, -(-n * BITS // BLOCK)))
    bits = seen.where(F.col(key).isNotNull()).select(_block(F.col(key), blocks).alias("block"), F.explode(F.array(*[_bit(F.col(key), k) for k in range(SET)])).alias("bit"))
    return Filter(bits.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")), blocks)


def unseen(rows: DataFrame, seen: DataFrame, key: str, by: Filter | None = None) -> DataFrame:
    """rows whose key is not among the seen ones, as an anti-join gives them; a null key is never seen."""
    maybe, new = (by or of_keys(seen, key)).split(rows, key)
    return new.unionByName(maybe.join(seen.select(key).distinct(), key, "left_anti"))
