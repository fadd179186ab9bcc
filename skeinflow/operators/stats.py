"""Aggregate expressions with the list rules: empty gives 0, fewer than two values have no variance, no interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.operators.grouping import midrank


def _c(x: Column | str) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def total(x) -> Column:
    return F.coalesce(F.sum(_c(x)), F.lit(0))


def product(x) -> Column:
    return F.coalesce(F.product(_c(x)), F.lit(1.0))


def mean(x) -> Column:
    """NaN adds nothing to the sum and counts."""
    x = _c(x).cast("double")
    return F.coalesce(F.sum(F.nanvl(x, F.lit(0.0))) / F.when(F.count(x) > 0, F.count(x)), F.lit(0.0))


def variance(x) -> Column:
    return F.coalesce(F.var_samp(_c(x)), F.lit(0.0))


def std(x) -> Column:
    return F.coalesce(F.stddev_samp(_c(x)), F.lit(0.0))


def sem(x) -> Column:
    x = _c(x)
    return F.coalesce(F.stddev_samp(x) / F.sqrt(F.count(x)), F.lit(0.0))


def ci95(x) -> Column:
    return 1.96 * sem(x)


def median(x) -> Column:
    return F.coalesce(F.percentile(_c(x), F.lit(0.5)), F.lit(0.0))


def percentile_nearest(df: DataFrame, keys: list[str], value: str, p: float, out: str = "pct") -> DataFrame:
    """Element int(n * p / 100 + 0.5) of the sorted values, at most the last; from counts of distinct values."""
    from pyspark.sql import Window

    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    within = Window.partitionBy(*keys)
    upto = F.sum("_n").over(within.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    n = F.sum("_n").over(within)
    at = F.lit(0) if p <= 0 else n - 1 if p >= 100 else F.least(n - 1, F.floor(n * p / 100 + 0.5))
    return counts.withColumn("_upto", upto).withColumn("_at", at).where("_upto > _at").groupBy(*keys).agg(F.min(value).alias(out))


def arg_min(x, order) -> Column:
    """Ordinal of the first minimum."""
    return F.min(F.struct(_c(x).alias("x"), _c(order).alias("o")))["o"]


def arg_max(x, order) -> Column:
    """Ordinal of the first maximum."""
    return F.max(F.struct(_c(x).alias("x"), (-_c(order)).alias("o")))["o"] * -1


def any_true(x) -> Column:
    return F.coalesce(F.max((_c(x) != 0).cast("int")), F.lit(0))


def all_true(x) -> Column:
    return F.coalesce(F.min((_c(x) != 0).cast("int")), F.lit(1))


def pearson(x, y) -> Column:
    return F.corr(_c(x), _c(y))


def spearman(df: DataFrame, x: str, y: str, *within: str) -> DataFrame:
    """Correlation of mid-ranks, by group if given."""
    ranked = midrank(midrank(df.select(*within, x, y), x, *within, out="_rx"), y, *within, out="_ry")
    return ranked.groupBy(*within).agg(F.corr("_rx", "_ry").alias("spearman"))


def lsfit(x, y) -> list[Column]:
    """slope, intercept and r2 of y on x; 0, mean(y) and 1 where either doesn't vary."""
    x, y = _c(x).cast("double"), _c(y).cast("double")
    flat = (F.var_pop(x) == 0) | (F.var_pop(y) == 0) | F.var_pop(x).isNull()
    return [
        F.when(flat, F.lit(0.0)).otherwise(F.regr_slope(y, x)).alias("slope"),
        F.when(flat, F.avg(y)).otherwise(F.regr_intercept(y, x)).alias("intercept"),
        F.when(flat, F.lit(1.0)).otherwise(F.regr_r2(y, x)).alias("r2"),
    ]


def column_stats(df: DataFrame, column: str, aggs: dict[str, Column]) -> DataFrame:
    """Aggregates of position j across all list rows: ``aggs`` are over column ``v``."""
    return df.select(F.posexplode(column).alias("pos", "v")).groupBy("pos").agg(*(a.alias(n) for n, a in aggs.items()))


def box(x) -> list[Column]:
    """Five numbers behind a box and whisker plot."""
    x = _c(x)
    return [F.min(x).alias("low"), F.percentile(x, F.lit(0.25)).alias("q1"), F.percentile(x, F.lit(0.5)).alias("middle"), F.percentile(x, F.lit(0.75)).alias("q3"), F.max(x).alias("high")]


def cumulative(df: DataFrame, column: str, *within: str) -> DataFrame:
    """Share of values at or below each distinct value."""
    from pyspark.sql import Window

    counts = df.groupBy(*within, column).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*within)
    upto = F.sum("_n").over(w.orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(*within, column, (upto / F.sum("_n").over(w)).alias("share"))
