"""Mapping user code over units of work, with errors as rows."""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def map_units(spark: SparkSession, n: int, work: Callable[[int, Any, int], Any], setup: Callable[[], Any] | None = None, workers: int | None = None, seed: int = 0) -> DataFrame:
    """(unit, result, error) of ``work(unit, state, seed of the unit)`` for units 0 .. n-1.

    ``setup`` runs once in each task; a unit that raises gives its error and no result, and the others go on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = setup() if setup else None
        for pdf in batches:
            rows = []
            for unit in pdf["id"].tolist():
                try:
                    rows.append((unit, str(work(unit, state, seed + unit)), None))
                except Exception:
                    rows.append((unit, None, traceback.format_exc(limit=1)))
            yield pd.DataFrame(rows, columns=["unit", "result", "error"])

    units = spark.range(0, n, 1, workers or min(n, spark.sparkContext.defaultParallelism) or 1)
    return units.mapInPandas(run, "unit long, result string, error string")


def map_groups(spark: SparkSession, n: int, work: Callable[[int, Any, int], pd.DataFrame], schema: str, setup: Callable[[], Any] | None = None, workers: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The rows that all units return, with their unit, and the errors (unit, error)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = setup() if setup else None
        for pdf in batches:
            for unit in pdf["id"].tolist():
                try:
                    yield work(unit, state, seed + unit).assign(unit=unit, error=None)
                except Exception:
                    yield pd.DataFrame({"unit": [unit], "error": [traceback.format_exc(limit=1)]})

    def shaped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in run(batches):
            yield pdf.reindex(columns=names)

    units = spark.range(0, n, 1, workers or min(n, spark.sparkContext.defaultParallelism) or 1)
    full = f"{schema}, unit long, error string"
    names = [f.name for f in spark.createDataFrame([], full).schema]
    out = units.mapInPandas(shaped, full)
    return out.where("error IS NULL").drop("error"), out.where("error IS NOT NULL").select("unit", "error")


def reduce_groups(df: DataFrame, keys: list[str], value: str, f: Callable[[pd.Series], float], out: str = "value") -> DataFrame:
    """A reducer given as a Python function, per group; only the values of one group are in memory at once."""
    agg = F.pandas_udf(f, "double") if not hasattr(f, "returnType") else f
    return df.groupBy(*keys).agg(agg(F.col(value)).alias(out))
