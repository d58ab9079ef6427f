"""A session with the settings the library expects, and the knobs of a batch job by Spark's names."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Job settings by the names batch users know -> Spark configuration keys.
KNOBS = {
    "reducers": "spark.sql.shuffle.partitions",
    "compress_map_output": "spark.shuffle.compress",
    "codec": "spark.sql.parquet.compression.codec",
    "speculation": "spark.speculation",
    "max_attempts": "spark.task.maxFailures",
    "min_split_bytes": "spark.sql.files.maxPartitionBytes",
    "speculation_share": "spark.speculation.quantile",
    "reuse_workers": "spark.python.worker.reuse",
    "skip_bad_files": "spark.sql.files.ignoreCorruptFiles",
    "batch_rows": "spark.sql.execution.arrow.maxRecordsPerBatch",
    "broadcast_bytes": "spark.sql.autoBroadcastJoinThreshold",
    "temp_dir": "spark.local.dir",
    "queue": "spark.scheduler.pool",
}


def session(name: str = "arcspark", master: str | None = None, **knobs: object) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.python.filterPushdown.enabled", "true")
    if master:
        builder = builder.master(master)
    for knob, value in knobs.items():
        builder = builder.config(KNOBS[knob], str(value).lower() if isinstance(value, bool) else value)
    spark = builder.getOrCreate()
    from arcspark.sources.arc import ArcDataSource

    spark.dataSource.register(ArcDataSource)
    return spark
