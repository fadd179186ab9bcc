"""Datapoint logs: a header, then records of name, microseconds, flags, type and bytes; as table, stream and observations."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from skeinflow.operators import sessions

# Fixed values of the format.
HEADER = 16
LOG_VERSION = 3
TYPES = ["byte", "string", "float", "double", "short", "int", "group", "script", "trigger", "event", "none", "unknown"]
BEGIN_OBS, END_OBS = 19, 20
_CODES = {"byte": "B", "float": "f", "double": "d", "short": "h", "int": "i"}

SCHEMA = "file string, n long, varname string, micros long, seconds double, dtype string, e_type int, e_subtype int, e_puttype string, numbers array<double>, text string"


class Datapoint(NamedTuple):
    varname: str
    micros: int
    flags: int
    kind: int
    data: bytes

    @property
    def dtype(self) -> int:
        return self.kind & 0xFF


def event_kind(etype: int, subtype: int, puttype: str = "int") -> int:
    """The type word of an event."""
    return TYPES.index("event") | etype << 8 | subtype << 16 | TYPES.index(puttype) << 24


def write_log(path: str, opened: int, points: list[Datapoint]) -> None:
    with open(path, "wb") as f:
        f.write(b"dslog" + bytes([LOG_VERSION, 0, 0]) + struct.pack("<Q", opened))
        for p in points:
            name = p.varname.encode()
            f.write(struct.pack("<H", len(name)) + name + struct.pack("<QIII", p.micros, p.flags, p.kind, len(p.data)) + p.data)


def read_points(data: bytes, at: int = HEADER) -> Iterator[tuple[int, Datapoint]]:
    """(offset after it, datapoint) of every whole record; a record cut short ends the reading."""
    while at + 2 <= len(data):
        n = struct.unpack_from("<H", data, at)[0]
        head = at + 2 + n
        if head + 20 > len(data):
            return
        micros, flags, kind, size = struct.unpack_from("<QIII", data, head)
        if head + 20 + size > len(data):
            return
        at = head + 20 + size
        yield at, Datapoint(data[head - n : head].decode("utf-8", "replace"), micros, flags, kind, data[head + 20 : at])


def opened_at(data: bytes) -> int:
    if data[:5] != b"dslog" or not data[5:6].strip(b"\0"):
        raise ValueError("not a datapoint log")
    return struct.unpack_from("<Q", data, 8)[0]


def values(kind: str, data: bytes) -> tuple[list[float], str]:
    """Numbers and text of a datapoint's bytes."""
    if kind in _CODES:
        size = struct.calcsize(_CODES[kind])
        return [float(v) for v in struct.unpack(f"<{len(data) // size}{_CODES[kind]}", data[: len(data) // size * size])], ""
    return [], data.decode("utf-8", "replace") if kind in ("string", "script", "trigger") else ""


def row(file: str, n: int, opened: int, p: Datapoint) -> tuple:
    name = TYPES[p.dtype] if p.dtype < len(TYPES) else "unknown"
    if name == "event":
        put = TYPES[min(p.kind >> 24 & 0xFF, len(TYPES) - 1)]
        numbers, text = values(put, p.data)
        return file, n, p.varname, p.micros, (p.micros - opened) / 1e6, name, p.kind >> 8 & 0xFF, p.kind >> 16 & 0xFF, put, numbers, text
    numbers, text = values(name, p.data)
    return file, n, p.varname, p.micros, (p.micros - opened) / 1e6, name, None, None, None, numbers, text


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All datapoints of the logs under ``path``: varname, seconds since the log was opened, and values."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.float64()), pa.string()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                opened, held = opened_at(data), []
                for n, (_, p) in enumerate(read_points(data)):
                    held.append(row(file, n, opened, p))
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(kinds)], names)
                        held = []
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(kinds)], names)

    return files.mapInArrow(run, SCHEMA)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """One row per observation of each log: nested event types, subtypes, times (ms from its start) and parameters."""
    points = read_log(spark, path).where("dtype = 'event'")
    begin, end = F.col("e_type") == BEGIN_OBS, F.col("e_type") == END_OBS
    rows = sessions.sessionise(points, ["file"], ["n"], begin, end, "micros")
    rows = rows.withColumn("e_times", F.floor(F.col("obs_time") / 1000).cast("int")).withColumn("start", F.col("micros") - F.col("obs_time"))
    nested = rows.withColumnsRenamed({"e_type": "e_types", "e_subtype": "e_subtypes", "numbers": "e_params"})
    packed = sessions.observations(nested, ["file"], ["n"], ["e_types", "e_subtypes", "e_times", "e_params"])
    first = rows.groupBy("file", "obs").agg(F.min("start").alias("start"))
    zero = first.groupBy("file").agg(F.min("start").alias("zero"))
    times = first.join(zero, "file").select("file", "obs", F.floor((F.col("start") - F.col("zero")) / 1000).cast("int").alias("obs_times"))
    return packed.join(times, ["file", "obs"])


class LogStream(SimpleDataSourceStreamReader):
    """Datapoints of a growing log; the offset is a byte position, so a restart goes on where it stopped."""

    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def initialOffset(self) -> dict[str, Any]:
        return {"at": HEADER, "n": 0}

    def read(self, start: dict[str, Any]) -> tuple[Iterator[tuple], dict[str, Any]]:
        if not os.path.exists(self.path):
            return iter(()), start
        rows, end, n, most = [], 0, start["n"], self.most
        with open(self.path, "rb") as f:
            opened = opened_at(f.read(HEADER))
            # A datapoint larger than the limit needs a longer read, else the stream would stand still before it.
            while not rows:
                f.seek(start["at"])
                data = f.read(most)
                for end, p in read_points(data, 0):
                    rows.append(row(self.path, n, opened, p))
                    n += 1
                if len(data) < most:
                    break
                most *= 2
        return iter(rows), {"at": start["at"] + end, "n": n}

    def readBetweenOffsets(self, start: dict[str, Any], end: dict[str, Any]) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            opened = opened_at(f.read(HEADER))
            f.seek(start["at"])
            data = f.read(end["at"] - start["at"])
        return iter([row(self.path, start["n"] + i, opened, p) for i, (_, p) in enumerate(read_points(data, 0))])


class LogSource(DataSource):
    """``spark.readStream.format("skein_log").option("path", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "skein_log"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema: Any) -> LogStream:
        return LogStream(self.options["path"], int(self.options.get("maxBytes", 1 << 24)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogSource)
