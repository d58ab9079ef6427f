"""Pairs of near-equal 64-bit SimHash values, by combined blocks."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcspark.functions.text import hamming
from arcspark.storage import materialize

#: Values that one key should hold at most on average; rows of a key that meet in one task.
A_KEY, A_TILE = 64, 2048


def _cut(blocks: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each block of a 64-bit value."""
    ends = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def keys_of(h: Column, distance: int, blocks: int) -> Column:
    """One key for each choice of ``blocks - distance`` blocks: values that differ in ``distance`` bits share one."""
    part = [F.shiftrightunsigned(h, a).bitwiseAND(F.lit((1 << n) - 1)) for a, n in _cut(blocks)]
    return F.array(*(F.xxhash64(F.lit(i), *(part[b] for b in chosen)) for i, chosen in enumerate(combinations(range(blocks), blocks - distance))))


def blocks_for(n: int, distance: int) -> int:
    """Blocks so that a key has the bits to tell about n / A_KEY values apart; more blocks mean longer keys, and more of them."""
    bits = math.log2(max(2, n / A_KEY))
    return next((b for b in range(distance + 1, distance + 5) if 64 * (b - distance) // b >= bits), distance + 4)


def simhash_pairs(df: DataFrame, id_col: str, hash_col: str, distance: int = 3) -> DataFrame:
    """(a, b, distance) of hash values at most ``distance`` bits apart, by their least ids.

    Equal values are one, so copies never multiply (``simhash_classes`` has
    them). A key that holds many values is dealt into tiles, block against
    block, so that no task pairs more than two of them. A pair is reported
    from its first shared key alone.
    """
    values = df.where(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("h")).agg(F.min(id_col).alias("id"))
    values = materialize(values, "simhash-values")  # read three times, hashed once
    blocks = blocks_for(values.count(), distance)
    keyed = values.select("id", "h", F.posexplode(keys_of(F.col("h"), distance, blocks)).alias("nth", "key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / A_TILE).cast("int").alias("tiles"))
    keyed = keyed.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("h"), F.col("tiles")).cast("int"))
    left = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("key", "nth", F.col("own").alias("i"), F.col("other").alias("j"), F.col("id").alias("a"), F.col("h").alias("ha"))
    right = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("key", F.col("other").alias("i"), F.col("own").alias("j"), F.col("id").alias("b"), F.col("h").alias("hb"))
    near = left.join(right, ["key", "i", "j"]).where((F.col("a") < F.col("b")) & (hamming(F.col("ha"), F.col("hb")) <= distance))
    # the first choice of blocks in which two values agree
    first = F.array_position(F.zip_with(keys_of(F.col("ha"), distance, blocks), keys_of(F.col("hb"), distance, blocks), lambda x, y: x == y), True) - 1
    return near.where(first == F.col("nth")).select("a", "b", hamming(F.col("ha"), F.col("hb")).alias("distance"))


def simhash_classes(df: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    """(h, id, class_id): each row's class, the least id of equal values."""
    rows = df.where(F.col(hash_col).isNotNull()).select(F.col(hash_col).alias("h"), F.col(id_col).alias("id"))
    return rows.join(rows.groupBy("h").agg(F.min("id").alias("class_id")), "h")
