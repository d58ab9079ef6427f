"""Connected components of a graph of (a, b) edges, all in joins.

Rounds of large-star and small-star turn every component into a star around
its least node. Neighbour lists are never gathered: each round is a minimum
by node, which Spark combines before shuffling, and a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspark.llm.common import materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def stars(edges: DataFrame, scope: str | None = None) -> DataFrame:
    """(node, root) for every node that is not itself the least of its component."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", scope)
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large-star", scope)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "small-star", scope)
        mark, before = _mark(now), mark
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
