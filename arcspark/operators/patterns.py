"""Very many prefixes or suffixes at once: a join on the lengths that occur.

Patterns are a table. Each different value is cut at every length that a
pattern has, the cuts are joined with the patterns, and the longest or the
shortest that met is the value's. The work grows with the values and with the
number of lengths, not with the number of patterns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns that are broadcast; bytes of them at most.
BROADCAST_PATTERNS, BROADCAST_BYTES = 200_000, 16 << 20


def match_patterns(rows: DataFrame, column: str, patterns: DataFrame, pattern: str = "pattern", suffix: bool = False, which: str = "longest", name: str = "match") -> DataFrame:
    """``rows`` and the pattern that each value begins with (ends with, for ``suffix``); null where none does.

    ``which`` is longest, shortest or all (an array by length). Equal patterns
    are one, null ones none; an empty pattern fits every value. Null values
    match nothing. Values that repeat are looked up once.
    """
    if which not in ("longest", "shortest", "all"):
        raise ValueError("longest, shortest or all")
    known = patterns.select(F.col(pattern).cast("string").alias("p")).where("p IS NOT NULL").distinct()
    stats = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("p")), F.lit(0)).alias("bytes"), F.array_sort(F.collect_set(F.char_length("p"))).alias("lengths")).first()
    value = F.col("_value")
    values = rows.select(F.col(f"`{column}`").cast("string").alias("_value")).where("_value IS NOT NULL").distinct()
    length = F.explode(F.filter(F.array(*map(F.lit, stats["lengths"])), lambda n: n <= F.char_length(value))) if stats["lengths"] else F.explode(F.array().cast("array<int>"))
    cuts = values.select("_value", length.alias("n")).select("_value", "n", (F.right(value, F.col("n")) if suffix else F.left(value, F.col("n"))).alias("p"))
    side = F.broadcast(known) if stats["n"] <= BROADCAST_PATTERNS and stats["bytes"] <= BROADCAST_BYTES else known
    met = cuts.join(side, "p").groupBy("_value")
    if which == "all":
        # no more than the lengths that occur
        found = met.agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "p"))), lambda x: x["p"]).alias(name))
    else:
        found = met.agg((F.max_by if which == "longest" else F.min_by)("p", "n").alias(name))
    packed = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_row"), F.col(f"`{column}`").cast("string").alias("_value"))
    return packed.join(found, "_value", "left").select("_row.*", name)
