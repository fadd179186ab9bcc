"""Sound and image files by their headers and samples."""

from __future__ import annotations

import io
import struct
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinflow.types import array
from skeinflow.types import struct as fields


@F.pandas_udf(fields(rate=T.IntegerType(), channels=T.IntegerType(), width=T.IntegerType(), samples=array(T.IntegerType())))
def wav_samples(content: pd.Series) -> pd.DataFrame:
    """PCM samples, channels interleaved; 8-bit ones are unsigned less 128."""
    rows = []
    for data in content:
        with wave.open(io.BytesIO(data)) as w:
            raw, width = w.readframes(w.getnframes()), w.getsampwidth()
            if width == 3:
                b = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
                x = (b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8
            else:
                x = np.frombuffer(raw, dtype={1: "u1", 2: "<i2", 4: "<i4"}[width]).astype(np.int32) - (128 if width == 1 else 0)
            rows.append((w.getframerate(), w.getnchannels(), width, x.tolist()))
    return pd.DataFrame(rows, columns=["rate", "channels", "width", "samples"])


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", wav_samples("content").alias("w")).select("path", "w.*")


def wav_bytes(samples: list[int], rate: int, channels: int = 1) -> bytes:
    """16-bit PCM."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(samples, -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def image_size(data: bytes) -> tuple[str, int, int]:
    """Format, width and height by the header; ("", 0, 0) if unknown."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "png", *struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "gif", *struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM":
        w, h = struct.unpack("<ii", data[18:26])
        return "bmp", w, abs(h)
    if data[:2] in (b"P5", b"P6"):
        words = [x for line in data[:256].split(b"\n") for x in line.split(b"#")[0].split()]
        return "pnm", int(words[1]), int(words[2])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            if data[at + 1] in (*range(0xC0, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return "jpeg", w, h
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return "", 0, 0


def read_image_sizes(spark: SparkSession, path: str) -> DataFrame:
    @F.pandas_udf("struct<format: string, width: int, height: int>")
    def run(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([image_size(bytes(d)) for d in content], columns=["format", "width", "height"])

    return spark.read.format("binaryFile").load(path).select("path", run("content").alias("i")).select("path", "i.*")
