"""Key/value sequence files of text, through Spark's own reader and writer of the format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcspark.functions.text import escaped_text

_TEXT = "org.apache.hadoop.io.Text"


def read_sequence(spark: SparkSession, path: str, escape_lines: bool = False) -> DataFrame:
    """(key, value) of text sequence files; ``path`` may list several, which come one after the other.

    With ``escape_lines`` each value becomes one line: carriage returns turn
    into blanks, the ends are trimmed, line feeds and tabs are escaped.
    """
    rows = spark.sparkContext.sequenceFile(path, _TEXT, _TEXT)
    out = spark.createDataFrame(rows, "key string, value string")
    return out.withColumn("value", escaped_text(F.col("value"))) if escape_lines else out


def write_sequence(rows: DataFrame, path: str, key: str = "key", value: str = "value", codec: str | None = None) -> None:
    """Two text columns as sequence files, in blocks compressed by ``codec`` (a Hadoop class name) if given."""
    pairs = rows.select(F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(value).cast("string"), F.lit(""))).rdd.map(tuple)
    pairs.saveAsNewAPIHadoopFile(path, "org.apache.hadoop.mapreduce.lib.output.SequenceFileOutputFormat", _TEXT, _TEXT, conf={"mapreduce.output.fileoutputformat.compress": str(codec is not None).lower(), **({"mapreduce.output.fileoutputformat.compress.codec": codec, "mapreduce.output.fileoutputformat.compress.type": "BLOCK"} if codec else {})})
