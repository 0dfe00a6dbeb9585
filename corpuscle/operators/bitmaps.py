"""Which rows may have one of many keys, told by a bitmap of the keys' hashes: a broadcast of bounded size, so rows that have none needn't be shuffled to find out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Longs of a bitmap, which is a broadcast of as many rows at most.
LONGS = 1 << 17


def _at(key: str) -> tuple[Column, Column]:
    """The long of a key, and its bit in there."""
    h = F.xxhash64(key)
    return F.shiftrightunsigned(h, 6).bitwiseAND(LONGS - 1), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))


def bitmap(keys: DataFrame, key: str) -> DataFrame:
    """(word, bits): the bitmap of a column of keys."""
    word, bit = _at(key)
    return stored(keys.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")), "bitmap")


def marked(rows: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """rows with `marked`: false where the key is certainly none of the bitmap's."""
    word, bit = _at(key)
    return rows.join(F.broadcast(bits), word == F.col("word"), "left").withColumn("marked", F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False))).select(*rows.columns, "marked")  # LONGS rows at most
