"""Matrices: as lists of lists within a row, or as (i, j, v) rows for sizes beyond a row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinflow.functions import lists
from skeinflow.types import array, struct


def _c(x: Column | str) -> Column:
    return x if isinstance(x, Column) else F.col(x)


# --- within a row


def identity(n: int) -> Column:
    at = F.sequence(F.lit(0), F.lit(n - 1))
    return F.transform(at, lambda i: F.transform(at, lambda j: (i == j).cast("double")))


def zeros(rows: int, columns: int) -> Column:
    return F.array_repeat(F.array_repeat(F.lit(0.0), columns), rows)


def urand(rows: int, columns: int, seed: int) -> Column:
    return lists.reshape(lists.urand(F.lit(rows * columns), seed), F.lit(rows), F.lit(columns))


def zrand(rows: int, columns: int, seed: int) -> Column:
    return lists.reshape(lists.zrand(F.lit(rows * columns), seed), F.lit(rows), F.lit(columns))


def dims(m) -> Column:
    m = _c(m)
    return F.array(F.size(m), F.coalesce(F.size(F.get(m, F.lit(0))), F.lit(0)))


def transpose(m) -> Column:
    return lists.transpose(_c(m), F.lit(0.0))


def diag(m) -> Column:
    return F.transform(_c(m), lambda r, i: F.get(r, i))


def elementwise(f, a, b) -> Column:
    """f of corresponding cells, or of each cell and a number."""
    a = _c(a)
    if isinstance(b, int | float):
        return F.transform(a, lambda r: F.transform(r, lambda x: f(x, F.lit(float(b)))))
    b = _c(b)
    return F.transform(a, lambda r, i: F.transform(r, lambda x, j: f(x, F.get(F.get(b, i), j))))


def matmul(a, b) -> Column:
    """Product of two small matrices of a row."""
    a, bt = _c(a), transpose(b)
    return F.transform(a, lambda r: F.transform(bt, lambda c: F.aggregate(F.zip_with(r, c, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)))


def row_sums(m) -> Column:
    return F.transform(_c(m), lists.total)


def col_sums(m) -> Column:
    return lists.column_sums(_c(m))


def row_means(m) -> Column:
    return F.transform(_c(m), lists.mean)


def col_means(m) -> Column:
    return lists.column_means(_c(m))


def center_rows(m, by) -> Column:
    by = _c(by)
    return F.transform(_c(m), lambda r, i: F.transform(r, lambda x: x - F.get(by, i)))


def center_cols(m, by) -> Column:
    by = _c(by)
    return F.transform(_c(m), lambda r: F.transform(r, lambda x, j: x - F.get(by, j)))


def _square(v) -> np.ndarray:
    return np.array([list(r) for r in v], dtype=float)


@F.pandas_udf(array(T.DoubleType(), 2))
def inverse(m: pd.Series) -> pd.Series:
    """Null where the matrix is singular."""
    def one(v):
        try:
            return np.linalg.inv(_square(v)).tolist()
        except np.linalg.LinAlgError:
            return None

    return m.map(one)


@F.pandas_udf(T.DoubleType())
def det(m: pd.Series) -> pd.Series:
    return m.map(lambda v: float(np.linalg.det(_square(v))))


@F.pandas_udf(struct(lu=array(T.DoubleType(), 2), order=array(T.IntegerType()), sign=T.IntegerType()))
def ludcmp(m: pd.Series) -> pd.DataFrame:
    """LU decomposition with partial pivoting: unit lower and upper triangle in one matrix, row order, parity."""
    rows = []
    for v in m:
        a = _square(v)
        n, sign, order = len(a), 1, list(range(len(a)))
        for k in range(n):
            p = k + int(np.argmax(np.abs(a[k:, k])))
            if p != k:
                a[[k, p]] = a[[p, k]]
                order[k], order[p] = order[p], order[k]
                sign = -sign
            if a[k, k] != 0:
                a[k + 1 :, k] /= a[k, k]
                a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
        rows.append((a.tolist(), order, sign))
    return pd.DataFrame(rows, columns=["lu", "order", "sign"])


# --- (i, j, v) rows


def to_cells(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    return df.select(*keys, F.posexplode(column).alias("i", "_r")).select(*keys, "i", F.posexplode("_r").alias("j", "v"))


def cells_matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product by a join on the inner index and a sum."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("_j"), F.col("v").alias("_w"))
    left = a.select("i", F.col("j").alias("k"), "v")
    return left.join(right, "k").groupBy("i", F.col("_j").alias("j")).agg(F.sum(F.col("v") * F.col("_w")).alias("v"))


def cells_elementwise(f, a: DataFrame, b: DataFrame) -> DataFrame:
    other = b.select("i", "j", F.col("v").alias("_w"))
    return a.join(other, ["i", "j"]).select("i", "j", f(F.col("v"), F.col("_w")).alias("v"))


def cells_sums(a: DataFrame, axis: str) -> DataFrame:
    return a.groupBy(axis).agg(F.sum("v").alias("v"))


def cells_means(a: DataFrame, axis: str) -> DataFrame:
    return a.groupBy(axis).agg(F.avg("v").alias("v"))


def cells_center(a: DataFrame, axis: str) -> DataFrame:
    """Less the mean of each row (axis i) or column (axis j)."""
    return a.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy(axis)))


def covariance(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sample covariance of every two columns, in one pass: (i, j, v)."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    one = df.agg(*(F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs))
    cells = [F.struct(F.lit(columns[a]).alias("i"), F.lit(columns[b]).alias("j"), F.col(f"c{i}_{j}").alias("v")) for i, j in pairs for a, b in {(i, j), (j, i)}]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
