"""Relational databases: JDBC on the executors, sqlite files on the driver."""

from __future__ import annotations

import sqlite3
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class Connection:
    """A JDBC database; its driver must be on the class path."""

    def __init__(self, spark: SparkSession, url: str, **properties: str):
        self.spark, self.url, self.properties = spark, url, properties

    def query(self, sql: str, split: str | None = None, lower: int = 0, upper: int = 0, partitions: int = 1) -> DataFrame:
        """Rows of a statement; with ``split``, a numeric column, read in ranges by several executors."""
        reader = self.spark.read.format("jdbc").options(url=self.url, **self.properties)
        if split:
            return reader.options(dbtable=f"({sql}) q", partitionColumn=split, lowerBound=lower, upperBound=upper, numPartitions=partitions).load()
        return reader.option("query", sql).load()

    def write(self, df: DataFrame, table: str, mode: str = "append") -> None:
        df.write.format("jdbc").options(url=self.url, dbtable=table, **self.properties).mode(mode).save()


def sqlite_query(spark: SparkSession, path: str, sql: str, params: tuple = (), schema: str | None = None) -> DataFrame:
    """Rows of a statement on a sqlite file, read by the driver: for files of a driver's size."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        cur = db.execute(sql, params)
        rows: list[tuple[Any, ...]] = cur.fetchall()
        names = [c[0] for c in cur.description]
    return spark.createDataFrame(rows, schema or names)
