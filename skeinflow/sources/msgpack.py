"""MessagePack: a small encoder and decoder, and tables in the two layouts that JSON has."""

from __future__ import annotations

import json
import struct
from typing import Any

from pyspark.sql import DataFrame

from skeinflow.functions import jsonfns


def _sized(n: int, fix: tuple[int, int] | None, *wide: tuple[int, str]) -> bytes:
    if fix and n <= fix[1]:
        return bytes([fix[0] | n])
    for tag, code in wide:
        if n < 1 << 8 * struct.calcsize(code):
            return bytes([tag]) + struct.pack(f">{code}", n)
    raise ValueError("too long")


def pack(x: Any) -> bytes:
    if x is None:
        return b"\xc0"
    if isinstance(x, bool):
        return b"\xc3" if x else b"\xc2"
    if isinstance(x, int):
        if 0 <= x < 128 or -32 <= x < 0:
            return struct.pack("b", x) if x < 0 else bytes([x])
        if x >= 0:
            return _sized(x, None, (0xCC, "B"), (0xCD, "H"), (0xCE, "I"), (0xCF, "Q"))
        for tag, code in ((0xD0, "b"), (0xD1, "h"), (0xD2, "i"), (0xD3, "q")):
            if x >= -(1 << 8 * struct.calcsize(code) - 1):
                return bytes([tag]) + struct.pack(f">{code}", x)
        raise ValueError("too small")
    if isinstance(x, float):
        return b"\xcb" + struct.pack(">d", x)
    if isinstance(x, str):
        raw = x.encode()
        return _sized(len(raw), (0xA0, 31), (0xD9, "B"), (0xDA, "H"), (0xDB, "I")) + raw
    if isinstance(x, bytes | bytearray):
        return _sized(len(x), None, (0xC4, "B"), (0xC5, "H"), (0xC6, "I")) + bytes(x)
    if isinstance(x, dict):
        return _sized(len(x), (0x80, 15), (0xDE, "H"), (0xDF, "I")) + b"".join(pack(k) + pack(v) for k, v in x.items())
    return _sized(len(x), (0x90, 15), (0xDC, "H"), (0xDD, "I")) + b"".join(map(pack, x))


def unpack(data: bytes) -> Any:
    value, at = _unpack(data, 0)
    if at != len(data):
        raise ValueError("bytes left over")
    return value


_NUMBERS = {0xCC: "B", 0xCD: "H", 0xCE: "I", 0xCF: "Q", 0xD0: "b", 0xD1: "h", 0xD2: "i", 0xD3: "q", 0xCA: "f", 0xCB: "d"}
_LENGTHS = {0xD9: "B", 0xDA: "H", 0xDB: "I", 0xC4: "B", 0xC5: "H", 0xC6: "I", 0xDC: "H", 0xDD: "I", 0xDE: "H", 0xDF: "I"}


def _unpack(d: bytes, at: int) -> tuple[Any, int]:
    tag = d[at]
    at += 1
    if tag < 0x80:
        return tag, at
    if tag >= 0xE0:
        return tag - 256, at
    if tag in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[tag], at
    if tag in _NUMBERS:
        size = struct.calcsize(_NUMBERS[tag])
        return struct.unpack_from(f">{_NUMBERS[tag]}", d, at)[0], at + size
    if tag in _LENGTHS:
        n = struct.unpack_from(f">{_LENGTHS[tag]}", d, at)[0]
        at += struct.calcsize(_LENGTHS[tag])
    else:
        n = tag & (0x1F if 0xA0 <= tag < 0xC0 else 0x0F)
    if 0xA0 <= tag < 0xC0 or tag in (0xD9, 0xDA, 0xDB):
        return d[at : at + n].decode(), at + n
    if tag in (0xC4, 0xC5, 0xC6):
        return d[at : at + n], at + n
    if 0x90 <= tag < 0xA0 or tag in (0xDC, 0xDD):
        out = []
        for _ in range(n):
            v, at = _unpack(d, at)
            out.append(v)
        return out, at
    pairs = {}
    for _ in range(n):
        k, at = _unpack(d, at)
        pairs[k], at = _unpack(d, at)
    return pairs, at


def table(df: DataFrame, order: str) -> bytes:
    """A (small) table as {column: [values]}."""
    return pack(json.loads(jsonfns.columns_json(df, order).first()["json"]))


def hybrid_table(df: DataFrame, order: str, name: str) -> bytes:
    return pack(json.loads(jsonfns.hybrid_json(df, order, name).first()["json"]))


def write(data: bytes, path: str) -> None:
    with open(path, "wb") as f:
        f.write(data)
