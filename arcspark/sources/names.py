"""Name tables (host, address, time to live, canonical name) as comma-separated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcspark.functions import net


def read_names(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """(host, ip, ttl, cname, last_touched) of a dump: ``host,/ip,ttl,cname,touched,...`` lines.

    Lines of fewer than four parts, or whose address or time is no number, are
    left out; a cname of "null" is null; without a sixth part nothing says
    when the host was last touched (-1). ``keep`` filters.
    """
    parts = F.split("value", ",")
    at = lambda i: F.get(parts, F.lit(i))
    rows = spark.read.text(path).where(F.size(parts) >= 4)
    touched = F.when(F.size(parts) > 5, at(4).try_cast("long")).otherwise(-1)
    rows = rows.select(at(0).alias("host"), net.ipv4_int(F.substr(at(1), F.lit(2))).alias("ip"), at(2).try_cast("long").alias("ttl"), F.nullif(at(3), F.lit("null")).alias("cname"), touched.alias("last_touched"))
    rows = rows.where(F.col("ip").isNotNull() & F.col("ttl").isNotNull())
    return rows if keep is None else rows.where(keep)


def write_names(names: DataFrame, path: str, keep: Column | None = None) -> None:
    """A dump that ``read_names`` reads: one line a host."""
    rows = names if keep is None else names.where(keep)
    line = F.concat_ws(",", "host", F.concat(F.lit("/"), net.ipv4_text(F.col("ip"))), F.col("ttl").cast("string"), F.coalesce("cname", F.lit("null")), F.coalesce(F.col("last_touched"), F.lit(-1)).cast("string"), F.lit(""))
    rows.select(line.alias("value")).write.mode("overwrite").text(path)
