"""Ordered operators on rows: running sums, lags, gradients, crossings, fills and convolution, by window per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series(keys: list[str], order: list[str]) -> WindowSpec:
    """The window of a series: ``order`` must be total within the keys for reruns to agree."""
    return Window.partitionBy(*keys).orderBy(*order)


def _c(x: Column | str) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def cumsum(x, w: WindowSpec) -> Column:
    return F.sum(_c(x)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def cumprod(x, w: WindowSpec) -> Column:
    """Running product by logarithms of magnitudes, with sign and zeros counted apart."""
    x = _c(x).cast("double")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    size = F.exp(F.sum(F.when(x != 0, F.log(F.abs(x))).otherwise(0.0)).over(run))
    minus = F.sum((x < 0).cast("int")).over(run) % 2
    return F.when(F.sum((x == 0).cast("int")).over(run) > 0, F.lit(0.0)).otherwise(F.when(minus == 1, -size).otherwise(size))


def shift(x, w: WindowSpec, k: int, fill) -> Column:
    """Moved down by k rows (up if negative), gaps filled."""
    return F.lag(_c(x), k, fill).over(w) if k >= 0 else F.lead(_c(x), -k, fill).over(w)


def diff(x, w: WindowSpec, k: int = 1) -> Column:
    """x minus x of k rows before; null (to be dropped) in the first k."""
    return _c(x) - F.lag(_c(x), k).over(w)


def gradient(x, w: WindowSpec) -> Column:
    """Central differences, one-sided at the ends, 0 for a single row."""
    x = _c(x)
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    return F.when(before.isNull() & after.isNull(), F.lit(0.0)).when(before.isNull(), after - x).when(after.isNull(), x - before).otherwise((after - before) / 2)


def zero_crossings(x, w: WindowSpec) -> Column:
    """1 on the row after a turn from - to +, -1 from + to -; a zero between counts; 0 on the first row."""
    x = _c(x)
    before, earlier = F.lag(x).over(w), F.lag(x, 2).over(w)
    origin = F.when(before == 0, earlier).otherwise(before)
    return F.when((origin < 0) & (x > 0), 1).when((origin > 0) & (x < 0), -1).otherwise(0)


def unique_adjacent(df: DataFrame, column: str, w: WindowSpec) -> DataFrame:
    """Rows that differ from the one before."""
    first = F.row_number().over(w) == 1
    return df.withColumn("_k", first | ~F.col(column).eqNullSafe(F.lag(column).over(w))).where("_k").drop("_k")


def forward_fill(x, w: WindowSpec) -> Column:
    return F.last(_c(x), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def fill_grid(df: DataFrame, keys: list[str], time: str, value: str, start: float, stop: float, step: float) -> DataFrame:
    """Values on a regular grid per key: the last at or before each point, the first one before all.

    Points and samples are merged and filled forward in one sort per key, so the cost is in rows and points.
    """
    n = int((stop - start) // step) + 1
    points = df.select(*keys).distinct().withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    points = points.select(*keys, (F.lit(float(start)) + F.col("_i") * float(step)).alias("_t"), F.lit(None).cast(df.schema[value].dataType).alias("_v"), F.lit(1).alias("_point"))
    samples = df.select(*keys, F.col(time).cast("double").alias("_t"), F.col(value).alias("_v"), F.lit(0).alias("_point"))
    w = Window.partitionBy(*keys).orderBy("_t", "_point")
    filled = samples.union(points).withColumn("_back", F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # Only points before all samples look ahead, and to the first sample of all: one frame for the whole key, read once.
    filled = filled.withColumn("_ahead", F.first("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return filled.where("_point = 1").select(*keys, F.col("_t").alias(time), F.coalesce("_back", "_ahead").alias(value))


def conv(x, kernel: list[float], w: WindowSpec) -> Column:
    """Zero-padded correlation with a kernel of odd length."""
    if len(kernel) % 2 == 0:
        raise ValueError("kernel length must be odd")
    half = len(kernel) // 2
    x = _c(x)
    taps = [k * F.coalesce(F.lag(x, half - j).over(w) if j < half else F.lead(x, j - half).over(w) if j > half else x, F.lit(0.0)) for j, k in enumerate(kernel)]
    out = taps[0]
    for t in taps[1:]:
        out = out + t
    return out


def speed(h, v, t, w: WindowSpec) -> Column:
    """Speed by central differences, one-sided at the ends, 0 where time does not advance."""
    def span(c: Column | str) -> Column:
        c = _c(c)
        return F.coalesce(F.lead(c).over(w), c) - F.coalesce(F.lag(c).over(w), c)

    dt = span(t)
    return F.when(dt > 0, F.sqrt(F.pow(span(h), F.lit(2)) + F.pow(span(v), F.lit(2))) / F.when(dt > 0, dt)).otherwise(0.0)


def crosscorr(a: DataFrame, b: DataFrame, keys: list[str], index: str, value: str, lags: list[int]) -> DataFrame:
    """Dot product of a with b shifted by each lag: rows join on key and shifted index, by lag."""
    spread = a.withColumn("lag", F.explode(F.array(*(F.lit(k) for k in lags)))).withColumn("_at", F.col(index) + F.col("lag"))
    other = b.select(*keys, F.col(index).alias("_at"), F.col(value).alias("_other"))
    hits = spread.join(other, [*keys, "_at"]).groupBy(*keys, "lag").agg(F.sum(F.col(value) * F.col("_other")).alias("dot"))
    every = a.select(*keys).distinct().withColumn("lag", F.explode(F.array(*(F.lit(k) for k in lags))))
    return every.join(hits, [*keys, "lag"], "left").withColumn("dot", F.coalesce("dot", F.lit(0.0)))
