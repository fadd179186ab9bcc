"""The document pipeline: quality rules, near-dedup, substring dedup, mixing, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; the runner writes it as Parquet and the next stage reads it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.llm import mixing, substring_dedup
from skeinflow.llm.bpe import encode_documents
from skeinflow.llm.common import drop_stage, stage, stage_alone, table
from skeinflow.llm.minhash_dedup import near_duplicates
from skeinflow.llm.quality_rules import quality_filter

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Least similarity of near copies in the pipeline (op10 has its own).
PERCENT = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.  Null and empty texts go; ids of any type, null or repeated, are not looked at; an empty
    table gives no rows; all columns come through unchanged."""
    return quality_filter(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, one with the smallest id (null after all others); ids need not be unique, nor numbers.

    Null and empty texts are no copies of anything and stay; ties in id go to the row read first; an empty table gives no rows;
    all columns come through unchanged.  Groups are found on a key of each row, written once so that every use sees the same keys.
    """
    key = F.monotonically_increasing_id()
    rows = stage(docs.select(key.alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), "keyed")
    found = near_duplicates(rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), PERCENT)
    found = found.select(F.col("doc_id").alias("key"), "component_id").join(rows.select("key", F.col("row.doc_id").alias("doc_id")), "key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key"))
    kept = found.groupBy("component_id").agg(first.alias("first")).select("first.key")
    return rows.join(kept, "key", "left_semi").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur elsewhere too (cases as in ``substring_dedup.strip_repeats``)."""
    return substring_dedup.strip_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often, and with as many words, as it takes of them (cases as in ``mixing.mix_documents``)."""
    return mixing.mix_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with their count and digests, and the digest of the decoded bytes (cases as in
    ``encode_documents``)."""
    return encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("mixing", mixing_stage),
    ("byte_level_bpe", bpe_stage),
]

#: The perplexity bands and the merges have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; tables that no later stage reads are deleted."""
    docs, written = table(spark, sf_dir, "documents"), None
    for name, f in STAGES[:-1]:
        docs = stage_alone(lambda f=f, docs=docs: f(spark, docs, sf_dir), f"pipeline-{name}")
        if written is not None:
            drop_stage(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
