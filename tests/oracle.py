"""Comparison of a Spark result with DuckDB SQL on the same tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def connect(data: str):
    con = duckdb.connect()
    for f in sorted(os.listdir(data)):
        path = f"{data}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    out = {}
    for c in sorted(df.columns):
        v = df[c]
        if v.map(lambda x: isinstance(x, float)).all() or str(v.dtype).startswith("float"):
            out[c] = v.astype(float).round(4) + 0.0
        else:
            out[c] = v.map(lambda x: "null" if x is None or x is pd.NaT or x is pd.NA or x != x else str(int(x)) if isinstance(x, float) and x == int(x) else str(x))
    return pd.DataFrame(out).sort_values(sorted(df.columns)).reset_index(drop=True)


def same(spark_df, con, sql: str) -> None:
    a, b = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    a, b = _plain(a), _plain(b)
    for c in a.columns:
        if a[c].dtype != b[c].dtype:
            a[c], b[c] = (x.map(lambda v: "null" if v == "null" or v != v else f"{float(v):.4f}") for x in (a[c], b[c]))
    a, b = (x.sort_values(list(x.columns)).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9, atol=1.1e-4)
