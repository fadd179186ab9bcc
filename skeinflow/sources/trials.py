"""Trial files: header, observations, events, samples and spikes as nested rows, kept as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.operators import asof

#: One row per observation.
SCHEMA = (
    "file string, obs int, title string, comment string, status int, start int, duration int, "
    "events array<struct<tag: int, t: int, params: array<int>>>, eye struct<rate: double, start: int, h: array<double>, v: array<double>>, "
    "spikes array<struct<channel: int, times: array<double>>>"
)


class Trials:
    """Open trial tables by handle."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.open_tables: dict[str, DataFrame] = {}

    def open(self, path: str) -> str:
        handle = f"trials{len(self.open_tables)}"
        self.open_tables[handle] = self.spark.read.schema(SCHEMA).parquet(path)
        return handle

    def loaded(self) -> list[str]:
        return list(self.open_tables)

    def close(self, handle: str) -> None:
        del self.open_tables[handle]

    def write(self, handle: str, path: str, kind: str = "parquet") -> None:
        """Parquet, or JSON lines for ``kind`` text."""
        df = self.open_tables[handle]
        df.write.mode("overwrite").json(path) if kind == "text" else df.write.mode("overwrite").parquet(path)

    def get(self, handle: str, field: str, obs: int | None = None) -> DataFrame:
        df = self.open_tables[handle]
        return (df.where(F.col("obs") == obs) if obs is not None else df).select("obs", F.col(field).alias("value"))

    def set(self, handle: str, field: str, value: Column, obs: int | None = None) -> None:
        df = self.open_tables[handle]
        if "." in field:
            top, inner = field.split(".", 1)
            made = F.col(top).withField(inner, value)
            field = top
        else:
            made = value.cast(df.schema[field].dataType)
        self.open_tables[handle] = df.withColumn(field, F.when(F.col("obs") == obs, made).otherwise(F.col(field)) if obs is not None else made)

    def events(self, handle: str) -> DataFrame:
        """One row per event: obs, n, tag, t, params."""
        return self.open_tables[handle].select("obs", F.posexplode("events").alias("n", "e")).select("obs", "n", "e.*")

    def spikes(self, handle: str, channel: int, start: Column, stop: Column, offset: Column) -> DataFrame:
        times = F.flatten(F.transform(F.filter("spikes", lambda s: s["channel"] == channel), lambda s: s["times"]))
        return self.open_tables[handle].select("obs", asof.in_window(times, start, stop, offset).alias("times"))

    def eye(self, handle: str, start: Column, stop: Column, base_start: Column, base_stop: Column) -> DataFrame:
        """Time, horizontal and vertical samples [start, stop), less the mean of the baseline samples."""
        df = self.open_tables[handle]
        h = asof.baseline_subtracted(F.col("eye.h"), start, stop, base_start, base_stop)
        v = asof.baseline_subtracted(F.col("eye.v"), start, stop, base_start, base_stop)
        t = F.transform(h, lambda x, i: F.col("eye.start") + (start + i) * F.col("eye.rate"))
        return df.select("obs", t.alias("t"), h.alias("h"), v.alias("v"))
