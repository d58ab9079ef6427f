"""A training corpus from raw documents, in five stages.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame. A stage's result is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of
``documents``.

Each stage takes any rows: null, empty and very long texts, rows without an
id, rows that repeat, rows that repeat an id with other texts, empty tables
and further columns of any name, which are kept. What a stage does with them
stands in its docstring.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcspark.llm.common import new_scope, scratch, sweep, table
from arcspark.llm.decontamination import decontaminate
from arcspark.llm.jaccard import one_of_each
from arcspark.llm.lines import without_repeats
from arcspark.llm.packing import pack
from arcspark.llm.toxicity import reject_toxic

SCOPE = "pipeline"


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the text now is."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go.

    Null and empty texts stay; equal texts are judged alike; without labels of
    both kinds, and on an empty table, nothing goes.
    """
    return reject_toxic(docs, table(spark, sf_dir, "labels"), scope=SCOPE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document or line has, or has but for one edit, are cut; a document with nothing left goes.

    Null texts, empty texts and rows without an id stay as they are. Rows that
    repeat an id and its text keep the same lines. ``n_chars`` follows the text.
    """
    sweep(spark, SCOPE)
    return _sized(without_repeats(docs, scope=SCOPE))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8) the document with the least id stays.

    Texts without words and rows without an id stay; of rows that repeat an id
    and its text one stays.
    """
    sweep(spark, SCOPE)
    return one_of_each(docs, width=5, percent=80, scope=SCOPE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with two or more benchmark items go; others lose the words hit.

    Null texts and texts without hits stay as they are; with an empty benchmark
    all do. ``n_chars`` follows the text.
    """
    sweep(spark, SCOPE)
    return _sized(decontaminate(docs, table(spark, sf_dir, "benchmark"), scope=SCOPE))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed into sequences of 1024 tokens.

    A null or empty text is one token; every row is packed, repeated ones too.
    An empty table gives no rows.
    """
    sweep(spark, SCOPE)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express the models, the tokenizer and the bin search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last. A stage's table goes when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        own = new_scope("stage")
        path = scratch(spark, f"stage-{name}", own)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            sweep(spark, before)
        docs, before = spark.read.parquet(path), own
    packed = STAGES[-1][1](spark, docs, sf_dir)
    sweep(spark, before)  # the pieces are written: nothing reads the last table any more
    return packed
