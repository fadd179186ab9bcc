"""Whitespace-delimited, CSV and TSV text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.operators import frame

_CASTS = {"int": "int", "long": "int", "short": "smallint", "char": "smallint", "float": "double", "string": "string"}


def read_ascii(spark: SparkSession, path: str, *specs: str) -> DataFrame:
    """Whitespace-separated columns by ``name:type:column`` (type float and the next column by default).

    Without specs the first line ``# a b c`` names the columns, all floats.  A line with too few columns is an error.
    """
    lines = spark.read.text(path)
    if not specs:
        head = lines.where(F.trim("value").startswith("#")).first()
        if head is None:
            raise ValueError("no column names: give specs or a # line")
        specs = tuple(head["value"].strip().lstrip("#").split())
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.trim("value").startswith("#") & (F.trim("value") != "")).select(parts.alias("p"))
    out = []
    for i, spec in enumerate(specs):
        name, kind, at = (spec.split(":") + ["", ""])[:3]
        at = int(at) if at else i
        value = F.when(F.size("p") > at, F.get("p", F.lit(at))).otherwise(F.raise_error(F.lit(f"column {at} is missing")))
        kind = _CASTS[kind or "float"]
        out.append((value.cast("double").cast(kind) if kind in ("int", "smallint") else value.cast(kind)).alias(name))
    return rows.select(*out)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", rows: Column | None = None, names: list[str] | None = None) -> None:
    frame.dump(df, path, sep=sep, rows=rows, names=names)


def write_tsv(df: DataFrame, path: str) -> None:
    frame.dump(df, path, sep="\t")


def write_values(df: DataFrame, column: str, path: str, kind: str | None = None) -> None:
    """One column's values, cast if asked, a value a line."""
    v = F.col(column).cast(_CASTS[kind]) if kind else F.col(column)
    df.select(v.cast("string").alias("value")).write.mode("overwrite").text(path)
