"""Streaming forms: archives as they arrive, rates by window, values that expire."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def arc_stream(spark: SparkSession, path: str, item: bool = False, max_file_age: str = "30d", files_per_trigger: int | None = None, **options: object) -> DataFrame:
    """Rows of archive files as new files come, each file once, also over restarts.

    Spark's own log of files says which were read: a file counts by its name,
    so one that shows up late or is moved in with an older time is read too,
    unless it is ``max_file_age`` older than the newest. Only names come from
    there; tasks read the files as a scan does.
    """
    from arcspark.sources.arc import read_named

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", options.pop("pathGlobFilter", "*arc.gz")).option("recursiveFileLookup", "true").option("maxFileAge", max_file_age)
    if files_per_trigger:
        files = files.option("maxFilesPerTrigger", files_per_trigger)
    return read_named(files.load(path).select("path"), item, **options)


def event_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def rate_by_window(events: DataFrame, ts: str = "ts", key: str = "event_type", value: str = "value", width: str = "1 second", late: str = "10 minutes") -> DataFrame:
    """Count and sum by window and key. Zone-less times are cast: watermarks need an instant."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark(ts, late)
    out = stamped.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), key, "n", "total")


def first_seen(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each key's first event; on a stream, within the watermark."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return stamped.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else stamped.dropDuplicates(keys)
