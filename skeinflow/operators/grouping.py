"""Dense grouping: every cell of the cross product of key values, empty ones too; and the ranking codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.operators.frame import RID, running_total, with_rid

#: Cells above which a dense grid is refused unless asked for.
MOST_CELLS = 1_000_000
#: Distinct values up to which one task may order them.
SMALL = 500_000


def grid(df: DataFrame, *keys: str, most: int = MOST_CELLS) -> DataFrame:
    """All combinations of the distinct values of each key, the first key varying fastest."""
    values = [df.select(k).distinct() for k in keys]
    cells = 1
    for n in df.agg(*(F.approx_count_distinct(k) for k in keys)).first():
        cells *= n
    if cells > most:
        raise ValueError(f"a grid of about {cells} cells; group sparsely, or raise most")
    return reduce(lambda a, b: a.crossJoin(b), reversed(values)).select(*keys)


def given_grid(df: DataFrame, values: dict[str, list]) -> DataFrame:
    """All combinations of supplied key values."""
    spark = df.sparkSession
    parts = [spark.createDataFrame([(v,) for v in vs], [k]).select(F.col(k).cast(df.schema[k].dataType)) for k, vs in values.items()]
    return reduce(lambda a, b: a.crossJoin(b), reversed(parts)).select(*values)


def _filled(cells: DataFrame, groups: DataFrame, keys: list[str], fills: dict[str, object]) -> DataFrame:
    on = reduce(lambda a, b: a & b, [cells[k].eqNullSafe(groups[k]) for k in keys])
    out = cells.join(groups, on, "left")
    values = [F.coalesce(groups[c], F.lit(fills.get(c, 0))).alias(c) if fills.get(c, 0) is not None else groups[c] for c in groups.columns if c not in keys]
    return out.select(*(cells[k] for k in keys), *values)


def dense_agg(df: DataFrame, keys: list[str], aggs: dict[str, Column], fills: dict[str, object] | None = None, values: dict[str, list] | None = None) -> DataFrame:
    """Aggregates on every cell; an empty cell has 0 (or its fill, None for null)."""
    groups = df.groupBy(*keys).agg(*(a.alias(n) for n, a in aggs.items()))
    cells = given_grid(df, values) if values else grid(df, *keys)
    return _filled(cells, groups, keys, fills or {})


def sorted_by(df: DataFrame, keys: list[str], value: str, order: str = RID, values: dict[str, list] | None = None) -> DataFrame:
    """Each cell's values as a list in row order, empty cells an empty list."""
    groups = df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda p: p["v"]).alias(value))
    cells = given_grid(df, values) if values else grid(df, *keys)
    on = reduce(lambda a, b: a & b, [cells[k].eqNullSafe(groups[k]) for k in keys])
    empty = F.array().cast(groups.schema[value].dataType)
    return cells.join(groups, on, "left").select(*(cells[k] for k in keys), F.coalesce(groups[value], empty).alias(value))


def split(df: DataFrame, key: str, value: str, order: str = RID) -> DataFrame:
    """Group-split by one key, groups by key and values in row order."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda p: p["v"]).alias(value))


def cross(*tables: DataFrame) -> DataFrame:
    """Cross product of small tables."""
    return reduce(lambda a, b: a.crossJoin(b), tables)


def unique_cross(df: DataFrame, *keys: str) -> DataFrame:
    return grid(df, *keys)


def _numbered(values: DataFrame, column: str, out: str) -> DataFrame:
    """Distinct values with their place in order, by one task if they are few, else by ranges."""
    if values.agg(F.approx_count_distinct(column)).first()[0] > SMALL:
        return with_rid(values, column).withColumn(out, F.col(RID).cast("int")).drop(RID)
    return values.withColumn(out, (F.row_number().over(Window.orderBy(column)) - 1).cast("int"))


def _matched(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of ``df`` with the other columns of the row of ``other`` that has the same keys, null being a value like others."""
    named = other.withColumnsRenamed({k: f"_m{i}" for i, k in enumerate(keys)})
    on = reduce(lambda a, b: a & b, [df[k].eqNullSafe(named[f"_m{i}"]) for i, k in enumerate(keys)])
    return df.join(named, on, "left").drop(*(f"_m{i}" for i in range(len(keys))))


def recode(df: DataFrame, column: str, out: str = "code") -> DataFrame:
    """Position of each value among the sorted distinct ones, -1 for null; only the distinct values are ordered."""
    codes = _numbered(df.select(column).where(F.col(column).isNotNull()).distinct(), column, out)
    return _matched(df, codes, [column]).withColumn(out, F.coalesce(out, F.lit(-1)))


def recode_from(df: DataFrame, column: str, reference: DataFrame, value: str, out: str = "code") -> DataFrame:
    """Codes against another table's distinct values, -1 for others."""
    ranked = _numbered(reference.select(F.col(value).alias("_v")).distinct(), "_v", out)
    return df.join(ranked, df[column] == ranked["_v"], "left").drop("_v").withColumn(out, F.coalesce(out, F.lit(-1)))


def midrank(df: DataFrame, column: str, *within: str, out: str = "midrank") -> DataFrame:
    """0-based ranks, ties sharing their mean; from counts of distinct values, so equal values cost one row.

    A null has no rank (null) and takes no place; a null group is a group.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*within, column).agg(F.count("*").alias("_n"))
    if within or df.agg(F.approx_count_distinct(column)).first()[0] <= SMALL:
        upto = counts.withColumn("_u", F.sum("_n").over(Window.partitionBy(*within).orderBy(column).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        upto = running_total(counts, [column], F.col("_n"), "_u")
    ranks = upto.withColumn(out, F.col("_u") - F.col("_n") + (F.col("_n") - 1) / 2.0).drop("_n", "_u")
    return _matched(df, ranks, [*within, column])


def occurrence_index(df: DataFrame, column: str, order: str = RID, out: str = "nth") -> DataFrame:
    """How often a row's value has occurred before it."""
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(column).orderBy(order)) - 1).cast("int"))


def cut(x: Column, breaks: list[float]) -> Column:
    """i for breaks[i] < x <= breaks[i + 1], else -1."""
    out = F.lit(-1)
    for i in reversed(range(len(breaks) - 1)):
        out = F.when((x > breaks[i]) & (x <= breaks[i + 1]), F.lit(i)).otherwise(out)
    return out


def histogram(df: DataFrame, column: str, lo: float, hi: float, n: int, *within: str) -> DataFrame:
    """Counts of n equal bins [from, to), zeros kept, values outside dropped; (within..., bin, count); a null group is a group."""
    width = (hi - lo) / n
    x = F.col(column)
    counts = df.where((x >= lo) & (x < hi)).groupBy(*within, F.floor((x - lo) / width).cast("int").alias("bin")).agg(F.count("*").alias("count"))
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    cells = df.select(*within).distinct().crossJoin(every) if within else every
    return _matched(cells, counts, [*within, "bin"]).withColumn("count", F.coalesce("count", F.lit(0)))
