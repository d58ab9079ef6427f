"""Bloom filters of any size as tables of blocks: built by one aggregation, probed by a join.

A value falls into one block of eight words of 32 bits and sets one bit in
each. A block is a row, so a filter is as large as it need be and passes
through no single task; setting bits is an OR that Spark combines before the
shuffle. A small filter is broadcast, a large one joined by block. All of it
is built-in functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a block, and their bits.
WORDS, WORD_BITS = 8, 32
#: Bytes of a block as a row, and of the filters that are broadcast.
BLOCK_BYTES, BROADCAST_BYTES = 48, 32 << 20
_NAMES = [f"w{i}" for i in range(WORDS)]


def blocks_for(n: int, bits_a_value: float) -> int:
    """Blocks of a filter for ``n`` values."""
    return max(1, round(n * bits_a_value / (WORDS * WORD_BITS)))


def _block(value: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(blocks))


def _masks(value: Column) -> list[Column]:
    """A bit for each word, five bits of a second hash telling which."""
    h = F.xxhash64(value, F.lit("bits"))
    one = F.lit(1)
    return [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(WORDS)]


def bloom_table(rows: DataFrame, column: str, n: int, bits_a_value: float = 12.0) -> DataFrame:
    """(block, w0 to w7) of a filter for about ``n`` different values; nulls are left out.

    With 12 bits a value some 6 in 1000 values that are not there are taken for
    such that are; half of that with 14. Filters of the same number of blocks
    are joined by ``merge``.
    """
    value = F.col(column)
    own = rows.where(value.isNotNull()).select(_block(value, blocks_for(n, bits_a_value)).alias("block"), *(m.alias(w) for w, m in zip(_NAMES, _masks(value), strict=True)))
    return own.groupBy("block").agg(*(F.bit_or(w).alias(w) for w in _NAMES))


def merge(*filters: DataFrame) -> DataFrame:
    """The filter of the values of several; all must have been built for the same ``n`` and bits."""
    return reduce(DataFrame.unionByName, filters).groupBy("block").agg(*(F.bit_or(w).alias(w) for w in _NAMES))


def with_membership(rows: DataFrame, column: str, table: DataFrame, n: int, bits_a_value: float = 12.0, name: str = "maybe", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` and whether each value may be in the filter; null for null. ``n`` and bits as it was built.

    The columns of ``rows`` are carried packed, so no name clashes.
    """
    blocks = blocks_for(n, bits_a_value)
    value = F.col(f"`{column}`")
    asked = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_row"), _block(value, blocks).alias("block"), *(m.alias(f"m{i}") for i, m in enumerate(_masks(value))), value.isNull().alias("_null"))
    # by its size, not by what of it happens to be filled
    side = F.broadcast(table) if blocks * BLOCK_BYTES <= broadcast_bytes else table
    met = asked.join(side, "block", "left")
    every = reduce(Column.__and__, (F.col(w).bitwiseAND(F.col(f"m{i}")) != 0 for i, w in enumerate(_NAMES)))
    return met.select("_row.*", F.when(~F.col("_null"), F.coalesce(every, F.lit(False))).alias(name))
