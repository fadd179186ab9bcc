"""Observation sessions: rows from a BEGIN event to its END, per log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _field(name: str):
    return lambda e: e[name]


def sessionise(events: DataFrame, keys: list[str], order: list[str], begin: Column, end: Column, time: str) -> DataFrame:
    """Rows of complete observations with obs (from 0) and time since the begin event.

    An observation runs from a begin event to the first end event after it.  A begin event inside an open observation stops
    the reading of its log, as the log is broken from there; what comes after an end and before the next begin is outside.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    df = events.withColumn("_b", F.coalesce(begin, F.lit(False)).cast("int")).withColumn("_e", F.coalesce(end, F.lit(False)).cast("int"))
    df = df.withColumn("_n", F.sum("_b").over(run))
    inside = Window.partitionBy(*keys, "_n").orderBy(*order)
    df = df.withColumn("_ended", F.coalesce(F.sum("_e").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = Window.partitionBy(*keys, "_n")
    df = df.withColumn("_whole", F.max("_e").over(whole)).withColumn("_t0", F.min(F.when(F.col("_b") == 1, F.col(time))).over(whole))
    # The last observation of a log may be open without harm; an open one before another begin breaks the log there.
    df = df.withColumn("_broken", F.max(F.when((F.col("_n") > 0) & (F.col("_whole") == 0), 1).otherwise(0)).over(run))
    kept = df.where("_n > 0 AND _ended = 0 AND _whole = 1 AND _broken = 0")
    return kept.withColumn("obs", (F.col("_n") - 1).cast("long")).withColumn("obs_time", F.col(time) - F.col("_t0")).drop("_b", "_e", "_n", "_ended", "_whole", "_t0", "_broken")


def observations(rows: DataFrame, keys: list[str], order: list[str], nested: list[str]) -> DataFrame:
    """One row per observation, the ``nested`` columns as lists in order."""
    entry = F.struct(*(F.col(o).alias(f"_o{i}") for i, o in enumerate(order)), *nested)
    packed = rows.groupBy(*keys, "obs").agg(F.array_sort(F.collect_list(entry)).alias("_l"))
    return packed.select(*keys, "obs", *(F.transform("_l", _field(c)).alias(c) for c in nested))


def gap_sessions(events: DataFrame, keys: list[str], time: str, order: str, gap_seconds: float) -> DataFrame:
    """Sessions split where the time since the row before exceeds a gap."""
    w = Window.partitionBy(*keys).orderBy(time, order)
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    new = F.when(seconds - F.lag(seconds).over(w) <= gap_seconds, 0).otherwise(1)
    return events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")
