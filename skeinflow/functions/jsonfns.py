"""JSON text: building, parsing, paths and types."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _field(name: str):
    return lambda e: e[name]


def _c(x: Column | str) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def to_json(x) -> Column:
    """A struct, map or list as text."""
    return F.to_json(_c(x))


def value_json(x) -> Column:
    """Any value as text; a scalar too."""
    return F.regexp_replace(F.to_json(F.array(_c(x))), r"^\[|\]$", "")


def from_json(x, schema: str | T.DataType) -> Column:
    return F.from_json(_c(x), schema)


def valid(x) -> Column:
    return F.coalesce(F.try_parse_json(_c(x)).isNotNull(), F.lit(False))


def _path(path: str) -> str:
    parts = [p for p in path.split(".") if p]
    return "$" + "".join(f"[{p}]" if re.fullmatch(r"\d+", p) else f"['{p}']" for p in parts)


def get(x, path: str) -> Column:
    """Text at a dotted path, whose numbers index lists; "" if missing."""
    return F.coalesce(F.get_json_object(_c(x), _path(path)), F.lit(""))


def kind(x, path: str = "") -> Column:
    """object, array, string, number, boolean, null; "" for what isn't there or isn't JSON."""
    v = F.try_variant_get(F.try_parse_json(_c(x)), _path(path), "variant") if path else F.try_parse_json(_c(x))
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), "").when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").otherwise("number")
    )


def rows_json(df: DataFrame, out: str = "json") -> DataFrame:
    """Each row as an object, nulls left out."""
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias(out))


def columns_json(df: DataFrame, order: str, out: str = "json") -> DataFrame:
    """A (small) table as one object of columns, {name: [...]}, in order."""
    names = [c for c in df.columns if c != order]
    packed = df.agg(F.array_sort(F.collect_list(F.struct(order, *names))).alias("l"))
    return packed.select(F.to_json(F.struct(*(F.transform("l", _field(c)).alias(c) for c in names))).alias(out))


def hybrid_json(df: DataFrame, order: str, name: str, out: str = "json") -> DataFrame:
    """{name, rows: [scalars and places in arrays], arrays: {column: [...]}} of a (small) table."""
    scalars = [f.name for f in df.schema if f.name != order and not isinstance(f.dataType, T.ArrayType)]
    nested = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    packed = df.agg(F.array_sort(F.collect_list(F.struct(order, *scalars, *nested))).alias("l"))
    rows = F.transform("l", lambda e, i: F.struct(*(e[c].alias(c) for c in scalars), *(i.alias(c) for c in nested)))
    arrays = F.struct(*(F.transform("l", _field(c)).alias(c) for c in nested)) if nested else F.create_map()
    return packed.select(F.to_json(F.struct(F.lit(name).alias("name"), rows.alias("rows"), arrays.alias("arrays"))).alias(out))
