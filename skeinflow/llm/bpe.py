"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank vocabulary.

Each byte stands for one printable character, so every token of the vocabulary is a string; its score is the negative of
its rank, and the normaliser is the identity.  Merging the best-scored neighbours first is then merging the least rank
first.  The vocabulary's order is the order of the pieces, so ids are ranks.  Each match of the pre-token pattern is encoded
by itself; one that is a token already keeps that id.  Decoding looks the bytes of every id up.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens whose ids a worker remembers in each of two generations, and the longest that it remembers.
CACHE, CACHE_CHARS = 120_000, 48
#: Bytes of texts that are encoded together, one text at least, and pieces that the model gets at once: a call for a few costs more
#: than their encoding.
TOGETHER, PIECES = 1 << 20, 1000
#: Bytes of strings that are put together at once, as far as the longest string of all tells.
BLOCK = 1 << 24
#: Classes that patterns are made of.
CLASSES = (r"\p{L}", r"\p{N}", r"\s")
#: The pattern that has a faster form, the same but for groups, that plain ``re`` knows once the classes are written out.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FASTER = r"""'(?:[stmd]|re|ve|ll)| ?[\p{L}]+| ?[\p{N}]+| ?[^\s\p{L}\p{N}]+|[\s]+(?![^\s])|[\s]+"""


def parse_ranks(data: bytes) -> list[bytes]:
    """Tokens by rank, from lines of base64 token and rank."""
    found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, data.splitlines()) if token}
    return [found[i] for i in range(len(found))]


def byte_characters() -> str:
    """A printable character for each byte: itself where Latin-1 prints it, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b if b in plain else next(rest)) for b in range(256))


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _int(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def model_bytes(tokens: list[bytes]) -> bytes:
    """The serialised model; the unknown piece that the format asks for comes after all tokens."""
    chars = byte_characters()
    pieces = []
    for rank, token in enumerate(tokens):
        text = token.decode("latin-1").translate(chars).encode()
        pieces.append(_bytes(1, _bytes(1, text) + _varint(2 << 3 | 5) + struct.pack("<f", -rank) + _int(3, 1)))
    pieces.append(_bytes(1, _bytes(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0) + _int(3, 2)))
    trainer = _int(3, 2) + _int(4, len(pieces)) + _int(40, len(tokens)) + _int(41, -1) + _int(42, -1) + _int(43, -1)
    normaliser = _bytes(1, b"identity") + _int(3, 0) + _int(4, 0) + _int(5, 0)
    return b"".join(pieces) + _bytes(2, trainer) + _bytes(3, normaliser)


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """The matches of ``pattern`` in a text; in Latin-1 texts by plain ``re`` if the pattern has a form for it."""
    general = regex.compile(pattern).findall
    if pattern != PATTERN:
        return general
    faster = FASTER
    for name in CLASSES:
        faster = faster.replace(name, "".join(f"\\x{i:02x}" for i in range(256) if regex.fullmatch(name, chr(i))))
    latin = re.compile(faster).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return general(text)
        return latin(text)

    return split


class Strings:
    """Strings of bytes, end to end."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.size = np.array([len(x) for x in strings], dtype=np.int32)
        self.start = np.cumsum(self.size, dtype=np.int32) - self.size
        self.step = max(1, BLOCK // max(self.size, default=1))

    def joined(self, ids: np.ndarray) -> bytes:
        """The strings of these numbers, one after the other."""
        out = []
        for lo in range(0, len(ids), self.step):
            x = ids[lo : lo + self.step]
            size = self.size[x]
            end = np.cumsum(size, dtype=np.int32)
            at = np.repeat(self.start[x] - end + size, size)
            at += np.arange(len(at), dtype=np.int32)
            out.append(self.data[at].tobytes())
        return b"".join(out)


class Remembered:
    """Ids of strings, as the bytes of 32-bit integers, by what ``learn`` gives for new ones.

    Those of a generation that is full stay until the next one is.
    """

    def __init__(self, learn: Callable[[set[str]], dict[str, bytes]]):
        self.learn = learn
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, keys: Iterable[str]) -> dict[str, bytes]:
        """A table with the ids of all ``keys``, good until the next call."""
        keys = set(keys)
        new = keys.difference(self.young)
        if not new:
            return self.young
        old = self.old
        found = {k: old[k] for k in new if k in old} if old else {}
        found |= self.learn(new.difference(found) if found else new)
        long = [k for k in found if len(k) > CACHE_CHARS]
        full = len(self.young) + len(found) - len(long) > CACHE
        if not full and not long:
            self.young |= found
            return self.young
        table = found | {k: self.young[k] for k in keys.difference(new)}
        if full:
            self.old, self.young = self.young, {}
        if len(found) - len(long) <= CACHE:
            self.young |= found
            for k in long:
                del self.young[k]
        return table


class Codec:
    """Encoder and decoder of one vocabulary and pre-token pattern."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = Strings(tokens)
        self.decimals = Strings([b"%d," % i for i in range(len(tokens))])
        self.whole = {t: array("I", [i]).tobytes() for i, t in enumerate(tokens)}
        self.split = splitter(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(tokens))
        self.chars = byte_characters()
        self.known = Remembered(self._learn)

    def _learn(self, new: Iterable[str]) -> dict[str, bytes]:
        found, ask, raws = {}, [], []
        whole = self.whole.get
        for p in new:
            raw = p.encode("utf-8", "surrogatepass")
            ids = whole(raw)
            if ids is None:
                ask.append(p)
                raws.append(raw)
            else:
                found[p] = ids
        for lo in range(0, len(ask), PIECES):
            # No UTF-8 holds the byte 255.
            pieces = b"\xff".join(raws[lo : lo + PIECES]).decode("latin-1").translate(self.chars).split(self.chars[255])
            for p, ids in zip(ask[lo : lo + PIECES], self.model.encode(pieces, out_type=int, num_threads=1), strict=True):
                found[p] = array("I", ids).tobytes()
        return found

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        parts = [self.split(x) for x in texts]
        ids = self.known.of(chain.from_iterable(parts)).__getitem__
        for of_text in parts:
            yield b"".join(map(ids, of_text))

    def encode(self, text: str) -> list[int]:
        (ids,) = self.encode_all([text])
        return array("I", ids).tolist()

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        return self.tokens.joined(np.asarray(ids, dtype=np.int64))


def _together(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ends of slices of ``TOGETHER`` bytes, or of one longer text; an empty one if there are no texts."""
    lo = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if i > lo and size + n > TOGETHER:
            yield lo, i
            lo, size = i, 0
        size += n
    yield lo, len(column)


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(vocabulary, pattern: str) -> Codec:
    key = (hash(vocabulary.value), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(parse_ranks(vocabulary.value), pattern)
    return _codecs[key]


def _run(vocabulary, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary, pattern)
        for whole in batches:
            texts = whole.column("text")
            for lo, hi in _together(texts):
                n, coded, decoded, ids = [], [], [], []
                for x in codec.encode_all([x or "" for x in texts.slice(lo, hi - lo).to_pylist()]):
                    found = np.frombuffer(x, dtype=np.uint32)
                    n.append(len(found))
                    coded.append(hashlib.sha256(codec.decimals.joined(found)[:-1]).hexdigest())
                    decoded.append(hashlib.sha256(codec.decode(found)).hexdigest())
                    if with_ids:
                        ids.append(found.astype(np.int32))
                made = [whole.column("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    made.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(made, names)

    return run


def encode_documents(docs: DataFrame, vocabulary_path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (of the bytes that the ids decode to) and, if asked for, ids.

    ``vocabulary_path`` is read on the driver and broadcast (about 1 MB, as large as the vocabulary).  A null text is empty
    and has no ids; every row gives one row, repeated ones too, whatever the type of its id; very long texts are encoded whole; merges
    tied in rank don't occur, as ranks differ; an empty table gives no rows; other columns, whatever their names, are not looked at.
    """
    with open(vocabulary_path, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_run(vocabulary, pattern, with_ids), schema)


def decode_documents(coded: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded text of each row's ``ids`` (null ids: empty; bytes that are not UTF-8 become U+FFFD); an empty table gives
    no rows, and other columns, whatever their names, are not looked at."""
    with open(vocabulary_path, "rb") as f:
        vocabulary = coded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary, pattern)
        for batch in batches:
            text = [codec.decode(x or []).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
