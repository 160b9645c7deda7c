"""Bloom filters as tables of 64-bit words: built by one aggregation, probed by one join, both inside the JVM."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 10


@dataclass(frozen=True)
class Shape:
    """bits in all and bits set for each key."""

    bits: int
    hashes: int

    @classmethod
    def of(cls, keys: int, bits_per_key: int = BITS_PER_KEY) -> Shape:
        return cls(max(64, keys * bits_per_key), min(30, max(1, round(bits_per_key * math.log(2)))))


def places(key: Column, shape: Shape) -> Column:
    """The bits of a key, by double hashing."""
    a, b = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(shape.bits)) for seed in (0, 1))
    return F.array_distinct(F.array(*[F.pmod(a + b * i, F.lit(shape.bits)) for i in range(shape.hashes)]))


def build(keys: DataFrame, shape: Shape, key: str = "key") -> DataFrame:
    """(word, bits): the words that are not zero."""
    at = keys.select(F.explode(places(F.col(key), shape)).alias("p"))
    bit = F.expr("shiftleft(1L, CAST(p % 64 AS INT))")
    return at.select(F.floor(F.col("p") / 64).cast("long").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def may_contain(probes: DataFrame, words: DataFrame, shape: Shape, key: str = "key") -> DataFrame:
    """The different probe keys, each with may: false only if it was never added."""
    each = probes.select(F.col(key).alias("key")).distinct().select("key", F.explode(places(F.col("key"), shape)).alias("p"))
    each = each.withColumn("word", F.floor(F.col("p") / 64).cast("long"))
    hit = each.join(words, "word", "left").select("key", F.coalesce(F.expr("shiftrightunsigned(bits, CAST(p % 64 AS INT)) & 1L") == 1, F.lit(False)).alias("set"))
    return hit.groupBy("key").agg(F.bool_and("set").alias("may"))
