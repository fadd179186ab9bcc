"""Live feeds: subscription by name pattern, every n-th update, observations as they close, recording and a value bus."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def name_matches(column: Column | str, pattern: str) -> Column:
    """Whether a name fits a glob pattern."""
    c = F.col(column) if isinstance(column, str) else column
    return c.rlike(f"^(?:{re.sub(r'^\\(\\?s:|\\)\\\\[zZ]$', '', fnmatch.translate(pattern))})$")


class Matches:
    """Subscriptions of a feed: pattern -> every n-th update; a feed is rebuilt when they change."""

    def __init__(self) -> None:
        self.every: dict[str, int] = {}

    def add(self, pattern: str, every: int = 1) -> None:
        self.every[pattern] = every

    def remove(self, pattern: str) -> None:
        self.every.pop(pattern, None)

    def all(self) -> dict[str, int]:
        return dict(self.every)

    def apply(self, df: DataFrame, name: str = "varname") -> DataFrame:
        """Rows of ``df`` that a subscription matches, with ``every`` (the least of those that match)."""
        which = [F.when(name_matches(name, p), F.lit(n)) for p, n in self.every.items()]
        least = F.least(*which, F.lit(None).cast("int")) if which else F.lit(None).cast("int")
        return df.withColumn("every", least).where("every IS NOT NULL")


def decimate(matched: DataFrame, name: str, order: str, value: str) -> DataFrame:
    """Every n-th update (column ``every``) of each name, the first one too; counters are kept in the state store."""
    kinds = {f.name: f.dataType.simpleString() for f in matched.schema}
    schema = f"{name} {kinds[name]}, {order} {kinds[order]}, {value} {kinds[value]}"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        for pdf in batches:
            pdf = pdf.sort_values(order, kind="stable")
            places = pd.RangeIndex(seen, seen + len(pdf))
            keep = places.to_numpy() % pdf["every"].to_numpy() == 0
            seen += len(pdf)
            yield pdf[keep][[name, order, value]]
        state.update((seen,))

    return matched.groupBy(name).applyInPandasWithState(run, schema, "seen long", "append", GroupStateTimeout.NoTimeout)


def decimate_batch(matched: DataFrame, name: str, order: str) -> DataFrame:
    """The same on a table at rest."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return matched.withColumn("_n", nth).where("_n % every = 0").drop("_n")


def observations(events: DataFrame, key: str, time: str, kind: str, begin: Any, end: Any) -> DataFrame:
    """(key, obs, start, duration, n): one row for each observation when it closes.

    Open observations wait in the state store, as a start, a count and a number, whatever their length.  A begin event in
    an open observation drops it.  Events of a key come in time order across batches; within one they are sorted.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    schema = f"{key} {kinds[key]}, obs long, start {kinds[time]}, duration double, n long"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        is_open, start, n, obs = state.get if state.exists else (False, 0.0, 0, 0)
        out = []
        for pdf in batches:
            pdf = pdf.sort_values(time, kind="stable")
            for t, what in zip(pdf[time].tolist(), pdf[kind].tolist(), strict=True):
                if what == begin:
                    is_open, start, n = True, t, 1
                elif is_open:
                    n += 1
                    if what == end:
                        out.append((k[0], obs, start, float(t - start), n))
                        is_open, obs = False, obs + 1
        state.update((is_open, float(start), n, obs))
        yield pd.DataFrame(out, columns=[key, "obs", "start", "duration", "n"])

    return events.groupBy(key).applyInPandasWithState(run, schema, "is_open boolean, start double, n long, obs long", "append", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, time: str, late: str, size: str, slide: str | None, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Aggregates of event-time windows, tumbling or sliding; rows later than ``late`` are dropped by the watermark."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = events.withWatermark(time, late).groupBy(w, *keys).agg(*(a.alias(n) for n, a in aggs.items()))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *aggs)


def dispatch(df: DataFrame, column: str, handlers: dict[Any, Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that gives each handler its kind of rows."""
    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        for kind, f in handlers.items():
            f(batch.where(F.col(column) == kind), number)
        batch.unpersist()

    return run


def parse_event(line: Column | str) -> Column:
    """An event line ``type subtype time param param ...`` as a struct."""
    p = F.split(F.trim(F.col(line) if isinstance(line, str) else line), r"\s+")
    return F.struct(F.get(p, F.lit(0)).try_cast("int").alias("type"), F.get(p, F.lit(1)).try_cast("int").alias("subtype"), F.get(p, F.lit(2)).try_cast("long").alias("time"), F.slice(p, F.lit(4), F.greatest(F.size(p) - 3, F.lit(0))).alias("params"))


class Recorder:
    """Records a feed to Parquet: start, pause (stop with the offsets kept), start again."""

    def __init__(self, df: DataFrame, path: str, checkpoint: str, matches: Matches | None = None, name: str = "varname"):
        self.df = matches.apply(df, name).drop("every") if matches else df
        self.path, self.checkpoint = path, checkpoint
        self.query: StreamingQuery | None = None

    def start(self, once: bool = False) -> StreamingQuery:
        w = self.df.writeStream.format("parquet").option("path", self.path).option("checkpointLocation", self.checkpoint)
        self.query = (w.trigger(availableNow=True) if once else w).start()
        return self.query

    def pause(self) -> None:
        if self.query:
            self.query.processAllAvailable()
            self.query.stop()
            self.query = None

    close = pause


class Bus:
    """Named values, the last one set winning, as a table of updates: get, set, touch, mirror."""

    SCHEMA = "name string, n long, value string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.n = spark, path, 0

    def set(self, name: str, value: str) -> None:
        self.spark.createDataFrame([(name, self.n, value)], self.SCHEMA).write.mode("append").parquet(self.path)
        self.n += 1

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).groupBy("name").agg(F.max_by("value", "n").alias("value"))

    def get(self, name: str) -> str | None:
        row = self.table().where(F.col("name") == name).first()
        return row["value"] if row else None

    def touch(self, name: str) -> None:
        self.set(name, self.get(name) or "")

    def mirror(self, path: str) -> "Bus":
        self.spark.read.schema(self.SCHEMA).parquet(self.path).write.mode("overwrite").parquet(path)
        other = Bus(self.spark, path)
        other.n = self.n
        return other

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.SCHEMA).parquet(self.path)
