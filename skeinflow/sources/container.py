"""The binary group container: a tagged stream of named, typed, nested lists; plain, gzip or LZ4 frame.

A file holds one group.  Rows of the resulting DataFrame are list positions, with their ordinal; short lists are filled.
"""

from __future__ import annotations

import base64
import gzip
import io
import struct
import zlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinflow.operators.frame import RID
from skeinflow.types import default

# Fixed values of the format: magic number, version, and tags by the structure they stand in.
MAGIC = b"\x21\x12\x36\x63"
VERSION = 1.0
END = 255
TOP = {"version": 0, "group": 1}
GROUP = {"name": 0, "n": 1, "list": 2}
LIST = {"name": 0, "increment": 1, "data": 2, "string": 3, "char": 4, "short": 5, "int": 6, "float": 7, "list": 8, "sublist": 9, "flags": 10}

_CODES = {"char": ("b", 1), "short": ("h", 2), "int": ("i", 4), "float": ("f", 4)}
_KIND_OF = {v: k for k, v in LIST.items() if k in ("string", "char", "short", "int", "float", "list")}
_SPARK = {"char": T.ShortType(), "short": T.ShortType(), "int": T.IntegerType(), "float": T.FloatType(), "string": T.StringType()}


class TypedList(NamedTuple):
    """A list with its element type; the elements of a list of lists are TypedLists."""

    kind: str
    values: list


class Group(NamedTuple):
    name: str
    columns: dict[str, TypedList]


# --- writing


def _text(s: str) -> bytes:
    raw = s.encode() + b"\0"
    return struct.pack("<i", len(raw)) + raw


def _list(tag: int, name: str, col: TypedList) -> bytes:
    out = [bytes([tag, LIST["name"]]), _text(name), bytes([LIST["increment"]]), struct.pack("<i", 10), bytes([LIST["flags"]]), struct.pack("<i", 0), bytes([LIST["data"], LIST[col.kind]]), struct.pack("<i", len(col.values))]
    if col.kind == "list":
        out += [_list(LIST["sublist"], "", v) for v in col.values]
    elif col.kind == "string":
        out += [_text(v) for v in col.values]
    else:
        out.append(struct.pack(f"<{len(col.values)}{_CODES[col.kind][0]}", *col.values))
    return b"".join([*out, bytes([END])])


def encode(group: Group) -> bytes:
    parts = [MAGIC, bytes([TOP["version"]]), struct.pack("<f", VERSION), bytes([TOP["group"], GROUP["name"]]), _text(group.name), bytes([GROUP["n"]]), struct.pack("<i", len(group.columns))]
    parts += [_list(GROUP["list"], k, c) for k, c in group.columns.items()]
    return b"".join([*parts, bytes([END])])


# --- reading


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at, self.order = data, 0, "<"

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("the container is cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self, code: str) -> Any:
        return struct.unpack(self.order + code, self.take(struct.calcsize(code)))[0]

    def text(self) -> str:
        return self.take(self.number("i")).rstrip(b"\0").decode("utf-8", "replace")


def _read_list(c: _Cursor) -> tuple[str, TypedList]:
    name, out = "", TypedList("int", [])
    while (tag := c.byte()) != END:
        if tag == LIST["name"]:
            name = c.text()
        elif tag in (LIST["increment"], LIST["flags"]):
            c.number("i")
        elif tag == LIST["data"]:
            continue
        elif tag in _KIND_OF:
            kind, n = _KIND_OF[tag], c.number("i")
            if kind == "string":
                out = TypedList(kind, [c.text() for _ in range(n)])
            elif kind == "list":
                subs = []
                for _ in range(n):
                    if c.byte() != LIST["sublist"]:
                        raise ValueError("a sublist expected")
                    subs.append(_read_list(c)[1])
                out = TypedList(kind, subs)
            else:
                code, size = _CODES[kind]
                out = TypedList(kind, list(struct.unpack(f"{c.order}{n}{code}", c.take(n * size))))
        else:
            raise ValueError(f"unknown tag {tag} in a list")
    return name, out


def decode(data: bytes) -> Group:
    """A group from plain, gzip or LZ4 bytes; the version number tells the byte order."""
    data = expand(data)
    if data[:4] != MAGIC:
        raise ValueError("not a group container")
    c = _Cursor(data)
    c.take(4)
    name, columns = "", {}
    while c.at < len(data) and (tag := c.byte()) != END:
        if tag == TOP["version"]:
            raw = c.take(4)
            c.order = "<" if struct.unpack("<f", raw)[0] == VERSION else ">"
            if struct.unpack(c.order + "f", raw)[0] != VERSION:
                raise ValueError("unknown version")
        elif tag == TOP["group"]:
            while (inner := c.byte()) != END:
                if inner == GROUP["name"]:
                    name = c.text()
                elif inner == GROUP["n"]:
                    c.number("i")
                elif inner == GROUP["list"]:
                    k, col = _read_list(c)
                    columns[k] = col
                else:
                    raise ValueError(f"unknown tag {inner} in a group")
        else:
            raise ValueError(f"unknown tag {tag}")
    return Group(name, columns)


def expand(data: bytes) -> bytes:
    if data[:2] == b"\x1f\x8b":
        try:
            return gzip.decompress(data)
        except (EOFError, zlib.error) as e:
            raise ValueError("the container is cut short") from e
    if data[:4] == b"\x04\x22\x4d\x18":
        return pa.CompressedInputStream(pa.BufferReader(data), "lz4").read()
    return data


def lz4_frame(data: bytes) -> bytes:
    """An LZ4 frame that states its content size, as readers of the format ask."""
    head = bytes([0x68, 0x70]) + struct.pack("<Q", len(data))
    out = [b"\x04\x22\x4d\x18", head, bytes([xxhash.xxh32(head).intdigest() >> 8 & 0xFF])]
    codec = pa.Codec("lz4_raw")
    for lo in range(0, len(data), 1 << 22):
        block = data[lo : lo + (1 << 22)]
        small = codec.compress(block, asbytes=True)
        out.append(struct.pack("<I", len(small)) + small if len(small) < len(block) else struct.pack("<I", len(block) | 1 << 31) + block)
    return b"".join([*out, struct.pack("<I", 0)])


def packed(data: bytes, suffix: str) -> bytes:
    return gzip.compress(data, mtime=0) if suffix == ".dgz" else lz4_frame(data) if suffix == ".lz4" else data


def to_base64(group: Group) -> str:
    return base64.b64encode(encode(group)).decode()


def from_base64(text: str) -> Group:
    return decode(base64.b64decode(text))


def list_to_base64(col: TypedList) -> str:
    return to_base64(Group("", {"list": col}))


def list_from_base64(text: str) -> TypedList:
    return from_base64(text).columns["list"]


# --- DataFrames


def _type(col: TypedList) -> T.DataType:
    if col.kind != "list":
        return _SPARK[col.kind]
    inner = [_type(v) for v in col.values if v.values or v.kind != "int"] or [_type(v) for v in col.values]
    kinds = {t.json() for t in inner}
    if len(kinds) > 1:
        raise ValueError("sublists of different types make no column")
    return T.ArrayType(inner[0] if inner else T.IntegerType())


def _plain(col: TypedList) -> list:
    return [_plain(v) for v in col.values] if col.kind == "list" else col.values


def group_schema(group: Group) -> T.StructType:
    return T.StructType([T.StructField(RID, T.LongType()), *(T.StructField(k, _type(c)) for k, c in group.columns.items())])


def group_rows(group: Group, schema: T.StructType) -> list[tuple]:
    columns = {k: _plain(c) for k, c in group.columns.items()}
    n = max((len(c) for c in columns.values()), default=0)
    fills = {f.name: default(f.dataType) for f in schema}
    return [tuple(i if f.name == RID else columns[f.name][i] if i < len(columns[f.name]) else fills[f.name] for f in schema) for i in range(n)]


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all containers under ``path`` (any store Spark reads), with file and ordinal; one schema for all.

    Suffixes don't matter, the bytes tell the packing; a path without a suffix that isn't there is tried with .dg and .dgz.
    """
    files = None
    for p in [path] if path.rsplit("/", 1)[-1].count(".") else [path, f"{path}.dg", f"{path}.dgz"]:
        try:
            files = spark.read.format("binaryFile").load(p).select("path", "content")
            break
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    if files is None:
        raise FileNotFoundError(path)
    schema = group_schema(decode(bytes(files.first()["content"])))
    full = T.StructType([T.StructField("file", T.StringType()), *schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(full)
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                group = decode(data)
                if group_schema(group) != schema:
                    raise ValueError(f"{file} has another schema")
                rows = [(file, *r) for r in group_rows(group, schema)]
                for lo in range(0, len(rows), 4096):
                    part = rows[lo : lo + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], f.type) for i, f in enumerate(kinds)], kinds.names)

    return files.mapInArrow(run, full)


def _typed(values: list, kind: T.DataType) -> TypedList:
    if isinstance(kind, T.ArrayType):
        return TypedList("list", [_typed(v or [], kind.elementType) for v in values])
    if isinstance(kind, T.StringType):
        return TypedList("string", [v or "" for v in values])
    if isinstance(kind, T.FloatType | T.DoubleType):
        return TypedList("float", [float(v or 0) for v in values])
    if isinstance(kind, T.ShortType | T.ByteType):
        return TypedList("short", [int(v or 0) for v in values])
    return TypedList("int", [int(v or 0) for v in values])


def to_group(df: DataFrame, name: str = "group") -> Group:
    """A (small) DataFrame as a group on the driver; ints become 32-bit and doubles 32-bit floats, as the format has them."""
    rows = (df.orderBy(RID) if RID in df.columns else df).collect()
    return Group(name, {f.name: _typed([r[f.name] for r in rows], f.dataType) for f in df.schema if f.name != RID})


def write_group(df: DataFrame, path: str, name: str = "group") -> None:
    """One container file of a (small) DataFrame; the suffix says .dg plain, .dgz gzip, .lz4 LZ4.  Large tables: Parquet."""
    suffix = "." + path.rsplit(".", 1)[-1]
    with open(path, "wb") as f:
        f.write(packed(encode(to_group(df, name)), suffix))


def encode_rows(df: DataFrame, key: str, value: str, out: str = "payload") -> DataFrame:
    """Each row's list column as container bytes."""
    kind = df.schema[value].dataType

    @F.pandas_udf("binary")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda v: encode(Group("", {"list": _typed([] if v is None else list(v), kind.elementType)})))

    return df.select(key, run(value).alias(out))


def stream_of(data: bytes) -> io.BytesIO:
    return io.BytesIO(expand(data))
