"""The registered queries of the training-data operators, and their SQL.

Each applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcspark.llm import audit, chat, decontamination, negatives
from arcspark.llm.common import table
from arcspark.llm.jaccard import jaccard_components
from arcspark.llm.language import identify
from arcspark.llm.lines import line_report
from arcspark.llm.media import media_columns
from arcspark.llm.packing import pack
from arcspark.llm.pieces import piece_report
from arcspark.llm.suffix import suffix_dedup
from arcspark.llm.token_counts import token_counts
from arcspark.llm.toxicity import score_toxicity


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(table(spark, sf_dir, "conversations"))


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector's label is moved on by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label=label)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_report(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def chat_quoted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10's operator over all conversations after some of their replies were made to quote."""
    return chat.format_chat(chat.with_quotes(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_suffix_array_dedup,
        op3_benchmark_decontamination,
        op4_language_id,
        op5_token_counts,
        op6_media_columns,
        op7_line_dedup,
        op8_toxicity,
        op9_best_fit_packing,
        op10_chat_formatting,
        op11_filter_interaction_audit,
        op12_hard_negative_mining,
        op13_sentencepiece,
        chat_quoted_replies,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_benchmark_decontamination": decontamination.REPORT_SQL,
    "op10_chat_formatting": chat.FORMAT_SQL,
    "op11_filter_interaction_audit": audit.AUDIT_SQL,
    "op12_hard_negative_mining": negatives.MINED_SQL,
    "chat_quoted_replies": chat.QUOTED_SQL,
}
