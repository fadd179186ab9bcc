"""Shared plumbing: stage tables in the folder all executors share, and column hygiene."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.stages import drop, drop_settled, made, settled, shared_dir

__all__ = ["drop_stage", "labelled_sample", "remainder", "shared_dir", "stage", "stage_alone", "table"]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    return settled(df, name)


def drop_stage(*tables: DataFrame) -> None:
    """Delete stage tables that nothing reads any more."""
    drop_settled(*tables)


def stage_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The stage table of what ``make`` gives, and none of the tables that it made on the way."""
    before = set(made)
    out = stage(make(), name)
    mine = made[-1]
    drop(out.sparkSession, *(p for p in list(made) if p not in before and p != mine))
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as stored; one of fewer partitions than there are cores is dealt out, as Python would use one core of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def remainder(ident: Column, by: int) -> Column:
    """crc32 of an id as text, modulo ``by``; 0 for a null id."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % by, F.lit(0)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int) -> DataFrame:
    """(place, label, text) of at most ``rows`` labelled documents for which ``learn`` (of doc_id) holds.

    The sample is the labels with the least hashes of their ids, so it is the same each time; only it is broadcast, and
    its size is bounded by ``rows``.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label")).where("_id IS NOT NULL AND label IN (0, 1)")
    known = known.withColumnRenamed("_id", "doc_id").where(learn).withColumn("place", F.xxhash64("doc_id", F.lit(label)))
    known = known.orderBy("place", "doc_id", "label").limit(rows)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").select("place", "label", "text")
