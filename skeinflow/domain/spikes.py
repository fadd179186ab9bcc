"""Spike trains: alignment, rasters, correlograms, and joining spikes of other recordings to trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.functions import lists
from skeinflow.operators import grouping, signal


def _field(name: str):
    return lambda e: e[name]


def align(trials: DataFrame, times: str, at: str, pre: float, post: float, out: str = "aligned") -> DataFrame:
    """Times relative to each trial's alignment, those in [pre, post] kept."""
    moved = F.transform(times, lambda t: t - F.col(at))
    return trials.withColumn(out, F.filter(moved, lambda t: (t >= pre) & (t <= post)))


def rasters(trials: DataFrame, times: str, keys: list[str]) -> DataFrame:
    """Trials' times by the cells of up to two sort keys, dense; (keys, trials as a list of lists)."""
    return grouping.sorted_by(trials, keys, times)


def smoothed(trials: DataFrame, times: str, keys: list[str], pre: float, post: float, sd: float, nsd: float = 3.0) -> DataFrame:
    """Mean density (times 1000: a second) per cell of the keys, from trials that are aligned already."""
    cells = rasters(trials, times, keys)
    return cells.withColumn("rate", F.transform(signal.sdf_mean(F.col(times), pre, post, sd, nsd), lambda x: x * 1000.0))


def onset(trials: DataFrame, times: str, keys: list[str]) -> DataFrame:
    """Mean of the first time of each trial that has one."""
    first = trials.where(F.size(times) > 0).withColumn("_first", F.array_min(times))
    return first.groupBy(*keys).agg(F.avg("_first").alias("onset"))


def response(trials: DataFrame, times: str, keys: list[str], lo: float, hi: float) -> DataFrame:
    """Mean and standard error of the rate in [lo, hi), a second."""
    rate = F.size(F.filter(times, lambda t: (t >= lo) & (t < hi))) / (hi - lo) * 1000.0
    return trials.withColumn("_r", rate).groupBy(*keys).agg(F.avg("_r").alias("rate"), F.coalesce(F.stddev_samp("_r") / F.sqrt(F.count("_r")), F.lit(0.0)).alias("sem"))


def train(times: Column, length: int) -> Column:
    """0/1 per millisecond."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.exists(times, lambda t: F.floor(t) == i).cast("int"))


def cross_correlogram(trials: DataFrame, keys: list[str], trial: str, a: str, b: str, length: int, lags: int) -> DataFrame:
    """(keys, lag, raw, shuffled, corrected): coincidences of two trains, averaged over trials, and of a with the next
    trial's b, each over the overlap at that lag times the geometric mean rate.

    Spikes join on trial and shifted time, so the work is in the spikes and lags, not in the samples.
    """
    t = trials.withColumn("_next", F.lead(F.col(b)).over(Window.partitionBy(*keys).orderBy(trial)))
    first = F.first(F.col(b)).over(Window.partitionBy(*keys).orderBy(trial).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    t = t.withColumn("_next", F.coalesce("_next", first))
    whole = lambda c: F.array_distinct(F.filter(F.transform(c, lambda x: F.floor(x).cast("int")), lambda x: (x >= 0) & (x < length)))
    t = t.select(*keys, trial, whole(F.col(a)).alias("a"), whole(F.col(b)).alias("b"), whole(F.col("_next")).alias("s"))
    at_lag = lambda other: lambda k: F.size(F.array_intersect(F.transform("a", lambda x: x + k), F.col(other)))
    steps = F.sequence(F.lit(-lags), F.lit(lags))
    t = t.withColumn("_l", F.arrays_zip(steps.alias("lag"), F.transform(steps, at_lag("b")).alias("raw"), F.transform(steps, at_lag("s")).alias("shuffled")))
    stats = t.groupBy(*keys).agg(F.count("*").alias("_n"), F.sqrt(F.avg(F.size("a")) * F.avg(F.size("b"))).alias("_rate"))
    rows = t.select(*keys, F.explode("_l").alias("_l")).select(*keys, "_l.*").groupBy(*keys, "lag").agg(F.avg("raw").alias("raw"), F.avg("shuffled").alias("shuffled"))
    rows = rows.join(stats, keys)
    scale = (length - F.abs("lag")) * F.col("_rate") / length
    norm = lambda c: F.when(scale > 0, F.col(c) / F.when(scale > 0, scale)).otherwise(0.0)
    return rows.select(*keys, "lag", norm("raw").alias("raw"), norm("shuffled").alias("shuffled"), (norm("raw") - norm("shuffled")).alias("corrected"))


def smooth5(values: Column) -> Column:
    """Five-tap mean of a list."""
    return lists.conv(values, F.array(*(F.lit(0.2) for _ in range(5))))


def add_spikes(trials: DataFrame, spikes: DataFrame, obs: str, order: str) -> DataFrame:
    """The first trial of each observation gets its spikes as lists, the others empty ones and a pointer to that trial.

    ``spikes`` has obs, time, unit, depth; ``order`` numbers the trials.
    """
    packed = spikes.groupBy(obs).agg(F.array_sort(F.collect_list(F.struct("time", "unit", "depth"))).alias("_s"))
    w = Window.partitionBy(obs).orderBy(order)
    t = trials.withColumn("_nth", F.row_number().over(w)).withColumn("spike_src_trial", F.first(order).over(w)).join(packed, obs, "left")
    held = F.when((F.col("_nth") == 1) & F.col("_s").isNotNull(), F.col("_s"))

    def part(field: str, kind: str) -> Column:
        return F.coalesce(F.transform(held, lambda e: e[field].cast(kind)), F.array().cast(f"array<{kind}>"))

    return t.withColumns({"spike_times": part("time", "double"), "spike_unit": part("unit", "int"), "spike_depth": part("depth", "double")}).drop("_nth", "_s")


def add_unit_metadata(trials: DataFrame, units: DataFrame, order: str) -> DataFrame:
    """Lists of unit metadata on the first row only, empty ones elsewhere."""
    packed = units.agg(F.array_sort(F.collect_list(F.struct("unit", "depth", "label"))).alias("_u"))
    first = trials.agg(F.min(order).alias("_first"))
    t = trials.crossJoin(first.crossJoin(packed))
    here = F.col(order) == F.col("_first")
    made = {f"unit_list_{c}": F.when(here, F.transform("_u", _field(c))).otherwise(F.slice(F.transform("_u", _field(c)), 1, 0)) for c in ("unit", "depth", "label")}
    return t.withColumns(made).drop("_u", "_first")


def unit_depths(units: DataFrame, sites: DataFrame) -> DataFrame:
    """Units with the depth of their site, whose key is the number in its name; null without a site."""
    s = sites.select(F.regexp_replace("site", r"\D", "").try_cast("int").alias("channel"), "depth")
    return units.join(s, "channel", "left").orderBy("unit")
