"""Bloom filters as sets of bit positions.

A key's 32-bit hash is the first half-word of its MD5, so other engines can state the same bits;
``probe_sketch`` is the compact JVM sketch for production pruning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U32 = 0xFFFFFFFF
# Fixed values of the filter's shape: ln 2 as written there, hash functions for each bit a key, bounds of
# their number, the least number of bits, and how far a hash is rotated for its second hash.
LN2 = 0.69314718056
HASHES_PER_BIT = 0.69
LEAST_HASHES, MOST_HASHES = 1, 30
LEAST_BITS = 64
ROTATION = 17


def bits_per_key(false_positive: float) -> int:
    """Bits a key for a rate of false positives."""
    return math.ceil(-math.log(false_positive) / LN2**2)


def sizing(n: int, per_key: int) -> tuple[int, int]:
    """Number of hash functions and of bits (whole bytes, 64 at least)."""
    k = min(max(int(per_key * HASHES_PER_BIT), LEAST_HASHES), MOST_HASHES)
    return k, (max(LEAST_BITS, n * per_key) + 7) // 8 * 8


def key_hash(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def positions(h: Column, k: int, n_bits: int) -> Column:
    """Bits of a hash: repeatedly adding it rotated to the right."""
    delta = F.shiftright(h, ROTATION).bitwiseOR(F.shiftleft(h, 32 - ROTATION).bitwiseAND(F.lit(U32)))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (h + i * delta).bitwiseAND(F.lit(U32)) % n_bits)


def build(keys: DataFrame, per_key: int) -> tuple[DataFrame, int, int]:
    """The distinct set bits of all keys, and the filter's shape."""
    k, n_bits = sizing(keys.count(), per_key)
    return keys.select(F.explode(positions(key_hash(F.col("key")), k, n_bits)).alias("bit")).distinct(), k, n_bits


def probe(keys: DataFrame, bits: DataFrame, k: int, n_bits: int) -> DataFrame:
    """key, may_contain: whether all bits of a key are set.  One key in the filter is never missed."""
    asked = keys.select("key").distinct().select("key", F.explode(F.array_distinct(positions(key_hash(F.col("key")), k, n_bits))).alias("bit"))
    hits = asked.join(bits.withColumn("hit", F.lit(1)), "bit", "left")
    return hits.groupBy("key").agg((F.count("*") == F.count("hit")).alias("may_contain"))


def probe_sketch(keys: DataFrame, expected: int, false_positive: float):
    """The JVM's Bloom filter of a key column, built in one aggregation."""
    return keys._jdf.stat().bloomFilter("key", expected, false_positive)
