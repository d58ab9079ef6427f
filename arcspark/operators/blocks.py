"""Sorted results in blocks, with one index entry a block: a page reads the blocks it lies in.

No row carries its position. The files are sorted and follow each other; the
index has each block's file, first position, number of rows and least and
greatest key. A page finds its blocks there, reads their files with the keys
as bounds, so that Parquet skips all other row groups, and counts positions
from where a block begins in its file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a block, which is a row group of its file; rows of a page that one task sorts.
BLOCK_ROWS, PAGE_ROWS = 8192, 100_000


def write_blocks(rows: DataFrame, keys: list[str], path: str, block_rows: int = BLOCK_ROWS) -> None:
    """``rows`` sorted by ``keys``, in ascending order with nulls first, below ``path``, and the index of their blocks.

    Keys need not be unique. An empty result has no blocks. No column may be
    named ``_metadata``.
    """
    spark = rows.sparkSession
    rows.orderBy(*keys).write.mode("overwrite").option("parquet.block.row.count.limit", block_rows).parquet(f"{path}/rows")
    at = spark.read.schema(rows.schema).parquet(f"{path}/rows").select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), F.struct(*keys).alias("key"))
    blocks = at.groupBy("file", F.floor(F.col("row") / block_rows).alias("block")).agg(F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("greatest"))
    # files are named in the order of their ranges; there are as many sums as files
    order = Window.orderBy(F.regexp_extract("file", r"part-(\d+)", 1).cast("int"), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy("file").agg(F.sum("n").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    out = blocks.join(F.broadcast(files.select("file", "before")), "file").withColumn("first", F.col("before") + F.col("block") * block_rows)
    out.select("file", "block", "first", "n", "before", "least", "greatest").repartitionByRange("first").sortWithinPartitions("first").write.mode("overwrite").parquet(f"{path}/blocks")


def _bound(keys: list[str], key, lower: bool) -> Column:
    """The keys are not before (not after) ``key``, in the order of the sort: column by column, nulls first."""
    out = F.lit(True)
    for k in reversed(keys):
        c, v = F.col(f"`{k}`"), key[k]
        same, beyond = (c.isNull(), c.isNotNull() if lower else F.lit(False)) if v is None else (c == F.lit(v), c > F.lit(v) if lower else c.isNull() | (c < F.lit(v)))
        out = beyond | (same & out)
    return out


def read_rows(spark: SparkSession, path: str, first: int, last: int, index: str = "row_idx") -> DataFrame:
    """Rows at positions first to last - 1, with their positions, in order; beyond the end there are none."""
    hits = spark.read.parquet(f"{path}/blocks").where((F.col("first") < last) & (F.col("first") + F.col("n") > first)).orderBy("first").collect()
    rows = spark.read.parquet(f"{path}/rows")
    names = rows.columns
    if not hits:
        return rows.where("false").withColumn(index, F.lit(0).cast("long"))
    keys = [f for f in hits[0]["least"].asDict()]
    # the blocks of a page follow each other, so each file has one range of keys
    parts = []
    for file in dict.fromkeys(h["file"] for h in hits):
        own = [h for h in hits if h["file"] == file]
        found = spark.read.schema(rows.schema).parquet(f"{path}/rows/{file}").where(_bound(keys, own[0]["least"], True) & _bound(keys, own[-1]["greatest"], False))
        found = found.select(*(F.col(f"`{c}`") for c in names), (F.col("_metadata.row_index") + own[0]["before"]).alias(index))
        parts.append(found.where((F.col(index) >= first) & (F.col(index) < last)))
    found = reduce(DataFrame.unionByName, parts)
    # the rows of a page are few: one task sorts them, where a sort in ranges would read them twice to find the ranges
    return found.coalesce(1).sortWithinPartitions(index) if last - first <= PAGE_ROWS else found.orderBy(index)


def total(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/blocks").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def page(spark: SparkSession, path: str, number: int, size: int, descending: bool = False) -> DataFrame:
    """Page ``number``, from 0, with positions; counted from the end and turned round if ``descending``."""
    if not descending:
        return read_rows(spark, path, number * size, (number + 1) * size)
    end = max(total(spark, path) - number * size, 0)
    return read_rows(spark, path, max(end - size, 0), end).orderBy(F.desc("row_idx"))


def position_of(spark: SparkSession, path: str, *key: object) -> int:
    """How many rows have a lesser key: the position at which the key is, or would be."""
    blocks = spark.read.parquet(f"{path}/blocks")
    names = blocks.schema["least"].dataType.fieldNames()
    wanted = F.struct(*(F.lit(v).cast(blocks.schema["least"].dataType[n].dataType).alias(n) for n, v in zip(names, key, strict=True)))
    hit = blocks.where(F.col("greatest") >= wanted).orderBy("first").first()
    if hit is None:
        return total(spark, path)
    rows = read_rows(spark, path, hit["first"], hit["first"] + hit["n"])
    return hit["first"] + rows.where(F.struct(*(F.col(f"`{n}`").alias(n) for n in names)) < wanted).count()
