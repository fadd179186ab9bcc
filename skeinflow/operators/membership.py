"""Lookups between tables: hash lookup, dictionary remap, membership, counts of given values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.operators.frame import RID


def find_indices(keys: DataFrame, key: str, table: DataFrame, column: str, position: str = RID, out: str = "pos") -> DataFrame:
    """Position in ``table`` of each key, the last one where it occurs more than once, -1 if it doesn't."""
    known = table.groupBy(F.col(column).alias(key)).agg(F.max(position).alias(out))
    return keys.join(known, key, "left").withColumn(out, F.coalesce(out, F.lit(-1)))


def remap(df: DataFrame, column: str, table: DataFrame, old: str, new: str, out: str | None = None) -> DataFrame:
    """Values looked up in a table, those without an entry kept (as the new type)."""
    kind = table.schema[new].dataType
    known = table.groupBy(F.col(old).alias("_old")).agg(F.max(new).alias("_new"))
    joined = df.join(known, df[column] == known["_old"], "left")
    return joined.withColumn(out or column, F.coalesce("_new", F.col(column).cast(kind))).drop("_old", "_new")


def oneof(df: DataFrame, column: str, values: DataFrame, value: str, out: str = "member") -> DataFrame:
    """0/1 membership of each row's value in a table."""
    known = values.select(F.col(value).alias("_v")).where("_v IS NOT NULL").distinct().withColumn("_hit", F.lit(1))
    return df.join(known, df[column] == known["_v"], "left").withColumn(out, F.coalesce("_hit", F.lit(0))).drop("_v", "_hit")


def semi(df: DataFrame, column: str, values: DataFrame, value: str) -> DataFrame:
    return df.join(values.select(F.col(value).alias("_v")), df[column] == F.col("_v"), "left_semi")


def anti(df: DataFrame, column: str, values: DataFrame, value: str) -> DataFrame:
    return df.join(values.select(F.col(value).alias("_v")), df[column] == F.col("_v"), "left_anti")


def count_occurrences(df: DataFrame, column: str, values: DataFrame, value: str, out: str = "n") -> DataFrame:
    """How often each given value occurs, zeros kept."""
    counts = df.groupBy(F.col(column).alias(value)).agg(F.count("*").alias(out))
    return values.select(value).distinct().join(counts, value, "left").withColumn(out, F.coalesce(out, F.lit(0)))
