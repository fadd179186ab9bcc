"""Queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from skeinflow.llm import chat, embedding_dedup, minhash_dedup, mixing, substring_dedup, warc
from skeinflow.llm.bpe import encode_documents
from skeinflow.llm.common import table
from skeinflow.llm.minhash_dedup import near_duplicates
from skeinflow.llm.quality_classifier import quality_scores
from skeinflow.llm.quality_rules import quality
from skeinflow.llm.toxicity import toxicity


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(chat.EXTRA, turns.schema)
    return chat.read_back(chat.format_conversations(turns.union(extra)))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_derivatives(table(spark, sf_dir, "pages"))


def op7_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(corpus_pipeline.VOCABULARY), public_tokenizers.PATTERN
    return encode_documents(table(spark, sf_dir, "documents"), path, pattern, with_ids=False)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_chat_formatting, op2_quality_classifier, op3_mixing, op4_embedding_near_dedup, op5_substring_dedup, op6_warc, op7_byte_level_bpe, op8_toxicity,
        op9_quality_rules, op10_minhash_near_dedup, pipeline,
    )
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_formatting": chat.ORACLE, "op3_mixing": mixing.ORACLE, "op4_embedding_near_dedup": embedding_dedup.ORACLE,
        "op5_substring_dedup": substring_dedup.ORACLE, "op10_minhash_near_dedup": minhash_dedup.ORACLE,
    }
