"""Arrow IPC streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema


def to_arrow(df: DataFrame) -> bytes:
    """A (small) DataFrame as the bytes of an IPC stream."""
    table = df.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def from_arrow(spark: SparkSession, data: bytes) -> DataFrame:
    return spark.createDataFrame(pa.ipc.open_stream(data).read_all())


def write_arrow(df: DataFrame, path: str) -> None:
    with open(path, "wb") as f:
        f.write(to_arrow(df))


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all IPC stream files under ``path`` (any store Spark reads), decoded on the executors."""
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = from_arrow_schema(pa.ipc.open_stream(bytes(files.first()["content"])).schema)
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                for b in pa.ipc.open_stream(data):
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, kinds, strict=True)], kinds.names)

    return files.mapInArrow(run, schema)


def rectangular(df: DataFrame) -> bool:
    """Whether every leaf has one plain type, as the format asks."""
    def plain(t: T.DataType) -> bool:
        return plain(t.elementType) if isinstance(t, T.ArrayType) else not isinstance(t, T.MapType | T.StructType | T.VariantType)

    return all(plain(f.dataType) for f in df.schema)
