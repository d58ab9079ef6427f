"""Sorting, merging, pages and row positions of key/value data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def external_sort(df: DataFrame, *keys: Column | str) -> DataFrame:
    """A global order by any expressions; Spark samples ranges, spills and merges."""
    return df.orderBy(*keys)


def merge_sorted(parts: list[DataFrame], *keys: Column | str) -> DataFrame:
    """All rows of several sorted inputs, duplicates too, in one order."""
    return reduce(DataFrame.unionByName, parts).orderBy(*keys)


def merge_combined(parts: list[DataFrame], keys: list[str], **how: Column) -> DataFrame:
    """A merge in which rows of equal keys become one; no row is lost, however many inputs there are."""
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(*(c.alias(n) for n, c in how.items())).orderBy(*keys)


#: Rows up to the end of a page that one task may sort out; pages further on go by row position.
NEAR_ROWS = 100_000


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number``, from 0; out of range it is empty. Reverse the order for pages from the end."""
    if (number + 1) * size <= NEAR_ROWS:
        return df.orderBy(*order).offset(number * size).limit(size)
    rows = with_row_index(df, order, "_row")
    return seek(rows, number * size, (number + 1) * size, "_row").select(*df.columns)


def with_row_index(df: DataFrame, order: list[str | Column], index: str = "row_idx") -> DataFrame:
    """Adds each row's position, from 0, in the global order.

    Rows are sorted in ranges; only the ranges' sizes, one number each, come
    to the driver, so no range is ranked by a single task.
    """
    spark = df.sparkSession
    ranked = df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    ranked = ranked.withColumn("_at", F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33))
    from arcspark.storage import materialize

    ranked = materialize(ranked, "row-index")
    sizes = sorted((r["_part"], r["count"]) for r in ranked.groupBy("_part").count().collect())
    base, total = [], 0
    for part, n in sizes:
        base.append((part, total))
        total += n
    bases = spark.createDataFrame(base or [(0, 0)], "_part int, _base long")
    return ranked.join(F.broadcast(bases), "_part").withColumn(index, F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")


def seek(indexed: DataFrame, first: int, last: int, index: str = "row_idx") -> DataFrame:
    """Rows at positions first to last - 1; a filter that Parquet's statistics prune."""
    return indexed.where((F.col(index) >= first) & (F.col(index) < last)).orderBy(index)


def distinct_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def newest_by(df: DataFrame, keys: list[str], ts: str, values: list[str], ttl: str | None = None, now: Column | None = None) -> DataFrame:
    """Each key's values at its latest time; with a time to live, only those not yet expired."""
    out = df.groupBy(*keys).agg(F.max(F.struct(ts, *values, *([ttl] if ttl else []))).alias("x")).select(*keys, "x.*")
    return out.where(F.col(ts) + F.col(ttl) > now).drop(ttl) if ttl and now is not None else out


def merge_structs(base: Column, peer: Column, fields: list[str]) -> Column:
    """Fields that the peer has set replace the base's."""
    return F.struct(*(F.coalesce(peer[f], base[f]).alias(f) for f in fields))
