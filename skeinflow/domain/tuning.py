"""Discrimination and tuning of responses: ROC areas, selectivity measures, broadness tests."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def roc(df: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """(keys, threshold, fa, hr): rates of scores above each distinct value, in one pass over counts of distinct values.

    The point (1, 1) has a null threshold; the greatest value gives (0, 0).
    """
    counts = df.groupBy(*keys, F.col(score).alias("threshold")).agg(F.sum((F.col(positive) == 0).cast("long")).alias("_n"), F.sum((F.col(positive) != 0).cast("long")).alias("_p"))
    w = Window.partitionBy(*keys)
    below = w.orderBy("threshold").rowsBetween(Window.unboundedPreceding, 0)

    def rate(c: str):
        return 1 - F.sum(c).over(below) / F.sum(c).over(w)

    points = counts.select(*keys, "threshold", rate("_n").alias("fa"), rate("_p").alias("hr"))
    start = df.select(*keys).distinct().select(*keys, F.lit(None).cast(df.schema[score].dataType).alias("threshold"), F.lit(1.0).alias("fa"), F.lit(1.0).alias("hr"))
    return start.union(points)


def roc_area(df: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """Area under the curve by trapezoids; null where a class is missing."""
    points = roc(df, keys, score, positive)
    w = Window.partitionBy(*keys).orderBy(F.col("threshold").asc_nulls_first())
    part = (F.lag("fa").over(w) - F.col("fa")) * (F.lag("hr").over(w) + F.col("hr")) / 2
    return points.withColumn("_a", part).groupBy(*keys).agg(F.sum("_a").alias("area"))


def rates(trials: DataFrame, times: str, align: str, start: float, stop: float) -> DataFrame:
    """Trials with rate: times strictly within (align + start, align + stop), a second (times are milliseconds)."""
    inside = F.filter(times, lambda t: (t > F.col(align) + start) & (t < F.col(align) + stop))
    return trials.withColumn("rate", F.size(inside) / (stop - start) * 1000.0)


def tag_rates(rated: DataFrame, keys: list[str], tag: str) -> DataFrame:
    return rated.groupBy(*keys, tag).agg(F.avg("rate").alias("r"))


def index(a: float, b: float) -> float:
    return (a - b) / (a + b) if a + b else 0.0


def selectivity(by_tag: DataFrame, keys: list[str]) -> DataFrame:
    """Measures over the tags' mean rates r: best_worst, breadth, depth, ranked_area, sparseness and kurtosis."""
    w = Window.partitionBy(*keys)
    down = w.orderBy(F.col("r").desc())
    n, total = F.count("*").over(w), F.sum("r").over(w)
    cum = F.sum("r").over(down.rowsBetween(Window.unboundedPreceding, 0))
    x = by_tag.withColumn("_n", n).withColumn("_before", F.when(total > 0, (cum - F.col("r")) / total)).withColumn("_after", F.when(total > 0, cum / total))
    x = x.withColumn("_lo", F.min("r").over(w)).withColumn("_hi", F.max("r").over(w)).withColumn("_m", F.avg("r").over(w))
    x = x.withColumn("_norm", F.when(F.col("_hi") > F.col("_lo"), (F.col("r") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))))
    hi, lo, count = F.max("_hi"), F.min("_lo"), F.max("_n")
    sd = F.stddev_samp("r")
    return x.groupBy(*keys).agg(
        F.when(hi + lo > 0, (hi - lo) / (hi + lo)).otherwise(0.0).alias("best_worst"),
        (1 - F.percentile("_norm", F.lit(0.5))).alias("breadth"),
        F.when((hi > 0) & (count > 1), (count - F.sum("r") / F.when(hi > 0, hi)) / F.when(count > 1, count - 1)).otherwise(0.0).alias("depth"),
        F.sum((F.col("_before") + F.col("_after")) / 2 / F.col("_n")).alias("ranked_area"),
        F.when(F.avg(F.col("r") * F.col("r")) > 0, F.pow(F.avg("r"), F.lit(2)) / F.avg(F.col("r") * F.col("r"))).otherwise(0.0).alias("sparseness"),
        F.when(sd > 0, F.avg(F.pow(F.col("r") - F.col("_m"), F.lit(4))) / F.pow(F.when(sd > 0, sd), F.lit(4)) - 3).otherwise(0.0).alias("kurtosis"),
    )


def wilcoxon_p(a: np.ndarray, b: np.ndarray) -> float:
    """Two-sided rank-sum test by the normal approximation, ties corrected."""
    x = np.concatenate([a, b])
    ranks = pd.Series(x).rank().to_numpy()
    n, m = len(a), len(b)
    if not n or not m:
        return 1.0
    ties = pd.Series(x).value_counts().to_numpy()
    var = n * m / 12 * ((n + m + 1) - (ties**3 - ties).sum() / ((n + m) * (n + m - 1))) if n + m > 1 else 0
    if var <= 0:
        return 1.0
    z = (ranks[:n].sum() - n * (n + m + 1) / 2) / math.sqrt(var)
    return 2 * (1 - NormalDist().cdf(abs(z)))


def welch_t(a: np.ndarray, b: np.ndarray) -> float:
    """Welch's t; 0 if neither varies."""
    if len(a) < 2 or len(b) < 2:
        return 0.0
    s = a.var(ddof=1) / len(a) + b.var(ddof=1) / len(b)
    return float((a.mean() - b.mean()) / math.sqrt(s)) if s > 0 else 0.0


def broadness(rated: DataFrame, keys: list[str], tag: str, baseline: str, test: str = "wilcoxon", level: float = 0.05) -> DataFrame:
    """Share of tags that respond: rate against baseline by rank-sum or t, mean above ``level`` of the best, or above the
    mean baseline by ``level`` standard deviations."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        best = pdf.groupby(tag)["rate"].mean().max()
        passed = []
        for _, g in pdf.groupby(tag):
            a, b = g["rate"].to_numpy(dtype=float), g[baseline].to_numpy(dtype=float)
            if test == "wilcoxon":
                passed.append(wilcoxon_p(a, b) < level)
            elif test == "t":
                passed.append(abs(welch_t(a, b)) > NormalDist().inv_cdf(1 - level / 2))
            elif test == "max":
                passed.append(a.mean() >= level * best)
            else:
                passed.append(a.mean() > b.mean() + level * b.std(ddof=1) if len(b) > 1 else False)
        head = pdf.iloc[:1][keys].copy()
        head["broadness"] = float(np.mean(passed))
        return head

    schema = ", ".join([*(f"{k} {rated.schema[k].dataType.simpleString()}" for k in keys), "broadness double"])
    return rated.groupBy(*keys).applyInPandas(one, schema)
