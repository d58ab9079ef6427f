"""Sets of longs as tables of bitmap words, and sketches that are stored and merged.

A set is rows (keys, block, bits): a block holds 64 neighbouring numbers as
the bits of a long, so that a set never has more rows than numbers, however
far apart they lie. Adding is an OR that Spark combines before it shuffles;
sets of days become those of weeks by the same OR. Membership is a join on the
block, and iteration unpacks the bits. All of it is built-in functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of a set that are broadcast: a few longs each.
BROADCAST_BLOCKS = 1 << 18


def _block(value: Column) -> Column:
    return F.shiftright(value.cast("long"), 6)


def _place(value: Column) -> Column:
    return value.cast("long").bitwiseAND(F.lit(63)).cast("int")


def long_set(rows: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, block, bits) of the different values of each key; nulls are left out, negative numbers are numbers."""
    own = rows.where(F.col(value).isNotNull()).withColumn("block", _block(F.col(value)))
    return own.groupBy(*keys, "block").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _place(F.col(value)))).alias("bits"))


def union(*sets: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The numbers that any of the sets has, by key."""
    return reduce(DataFrame.unionByName, (s.select(*keys, "block", "bits") for s in sets)).groupBy(*keys, "block").agg(F.bit_or("bits").alias("bits"))


def intersection(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The numbers that both sets have, by key."""
    both = union(a, keys=keys).unionByName(union(b, keys=keys)).groupBy(*keys, "block").agg(F.bit_and("bits").alias("bits"), F.count("*").alias("_n"))
    return both.where((F.col("_n") == 2) & (F.col("bits") != 0)).drop("_n")


def cardinality(s: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n): how many numbers each set holds."""
    return s.groupBy(*keys).agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).alias("n"))


def _bits(bits: Column, place: Column, mask: int) -> Column:
    """The bits from ``place`` on that the mask has, counted from the lowest."""
    return F.call_function("shiftright", bits, place).bitwiseAND(F.lit(mask))


def contains(rows: DataFrame, value: str, s: DataFrame, keys: tuple[str, ...] = (), name: str = "there") -> DataFrame:
    """``rows`` and whether each value is in the set (of the row's key); null for null. No column name clashes."""
    v = F.col(f"`{value}`")
    asked = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_row"), *(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)), _block(v).alias("_block"), _place(v).alias("_place"))
    side = s.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)), F.col("block").alias("_block"), "bits")
    side = F.broadcast(side) if s.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS else side
    met = asked.join(side, [*(f"_k{i}" for i in range(len(keys))), "_block"], "left")
    return met.select("_row.*", F.when(F.col("_place").isNotNull(), F.coalesce(_bits(F.col("bits"), F.col("_place"), 1) == 1, F.lit(False))).alias(name))


def members(s: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, value): the numbers of each set, a row each."""
    # bytes with any bit first: most words of a sparse set have one
    byte = s.select(*keys, "block", "bits", F.explode(F.filter(F.sequence(F.lit(0), F.lit(56), F.lit(8)), lambda i: _bits(F.col("bits"), i, 255) != 0)).alias("at"))
    bit = byte.select(*keys, "block", F.explode(F.filter(F.sequence(F.col("at"), F.col("at") + 7), lambda i: _bits(F.col("bits"), i, 1) == 1)).alias("i"))
    return bit.select(*keys, F.shiftleft("block", 6).bitwiseOR(F.col("i").cast("long")).alias("value"))


def distinct_sketches(rows: DataFrame, keys: list[str], value: str, log_k: int = 12) -> DataFrame:
    """(keys, sketch): HyperLogLog sketches of the different values, to be stored; off by some 1.6 in 100 with 2^12 cells."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(value, log_k).alias("sketch"))


def merged_distinct(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): how many different values the stored sketches of each key have seen together."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


def quantile_sketches(rows: DataFrame, keys: list[str], value: str, k: int = 400) -> DataFrame:
    """(keys, sketch): KLL sketches of a number's distribution, to be stored; ranks are off by some 0.7 in 100."""
    return rows.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def merged_quantiles(sketches: DataFrame, keys: list[str], ranks: list[float]) -> DataFrame:
    """(keys, quantiles): of all values that the stored sketches of each key have seen."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select(*keys, F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, ranks))).alias("quantiles"))
