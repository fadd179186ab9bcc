"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashes of a text's words and their beginnings (so that inflected forms share some), of neighbouring
pairs and of pairs with one word between.  Training runs in one task over a bounded sample of labelled documents, in an order
fixed by a hash; per-coordinate learning rates and an L1 penalty leave few non-zero weights.  These are broadcast (at most
2**BITS entries), and every whole text is scored.

The settings below were picked by cross-validation within the labelled rows that may be learnt from, the held-out rows unseen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.llm import kernels as K
from skeinflow.llm.common import labelled_sample, remainder

BITS = 20
#: Labelled documents to learn from at most, passes over them, and the weight of a toxic one.
TRAIN_ROWS, EPOCHS, POSITIVE = 12_000, 8, 4.0
ALPHA, BETA, L1, L2 = 1.0, 1.0, 15.0, 0.01
#: Words are runs of bytes other than white space and ASCII punctuation, A-Z lower-cased.
BREAKS = K.SEPARATOR.copy()
BREAKS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
#: Bytes of the beginnings of words that count as words too, for languages that inflect.
STEMS = (3, 4, 5, 6, 7, 8)
_SKIP = np.uint64(0xA0761D6478BD642F)
_SHIFT = np.uint64(64 - BITS)


def features(t: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word, beginning, pair and skip-pair of a run, repeats included."""
    data = K.LOWER[t.data]
    w = K.spans(t._replace(data=data), BREAKS)
    h = K.span_hashes(data, w.start, w.end, seed=3)
    rows = w.rows()
    pair = rows[1:] == rows[:-1]
    skip = rows[2:] == rows[:-2]
    bi = K.mix(h[:-1] * _SKIP + h[1:])[pair]
    sk = K.mix((h[:-2] ^ _SKIP) * _SKIP + h[2:])[skip]
    of, found = [rows, rows[1:][pair], rows[2:][skip]], [h, bi, sk]
    for size in STEMS:
        longer = w.end - w.start > size
        of.append(rows[longer])
        found.append(K.span_hashes(data, w.start[longer], w.start[longer] + size, seed=4))
    return np.concatenate(of), (np.concatenate(found) >> _SHIFT).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal; the last coordinate is the bias, without penalty."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.size = size

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == self.size, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y) * (POSITIVE if y else 1.0)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = 1 << BITS
    seen: list[tuple[np.ndarray, int]] = []
    for batch in batches:
        y = batch.column("label").to_pylist()
        for t in K.texts(batch.column("text")):
            rows, f = features(t)
            order = np.argsort(rows, kind="stable")
            ends = np.searchsorted(rows[order], np.arange(t.hi - t.lo + 1))
            f = f[order].astype(np.int32)
            seen += [(np.append(np.unique(f[a:b]), size).astype(np.int32), y[t.lo + i]) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]
    model = Ftrl(size)
    for _ in range(EPOCHS):
        for at, label in seen:
            model.learn(at, label)
    w = model.weights(np.arange(size + 1))
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()]), pa.array([w[at].astype(np.float32).tobytes()])], ["at", "weight"])


def fit(sample: DataFrame) -> tuple[bytes, bytes]:
    """Indices and values of the non-zero weights."""
    one = sample.repartition(1).sortWithinPartitions("place", "label", "text").select("label", "text")
    rows = one.mapInArrow(_train, "at binary, weight binary").collect()
    return (bytes(rows[0]["at"]), bytes(rows[0]["weight"])) if rows else (b"", b"")


_dense: dict[int, np.ndarray] = {}


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weight = model.value
        key = hash((at, weight))
        if key not in _dense:
            _dense.clear()
            _dense[key] = np.zeros((1 << BITS) + 1, dtype=np.float32)
            _dense[key][np.frombuffer(at, dtype=np.int32)] = np.frombuffer(weight, dtype=np.float32)
        w = _dense[key]
        for batch in batches:
            total = np.full(batch.num_rows, float(w[-1]))
            for t in K.texts(batch.column("text")):
                rows, f = features(t)
                hit = np.flatnonzero(w[f])
                pairs = np.unique((rows[hit].astype(np.int64) << BITS) | f[hit])
                total[t.lo : t.hi] += np.bincount(pairs >> BITS, w[pairs & ((1 << BITS) - 1)], t.hi - t.lo)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5) of every row of ``docs``.

    Learns from labels of ids whose crc32 modulo 5 is not 0; lang, source and doc_id are no inputs of a score.  Null and
    empty texts get the score of the bias; a null doc_id is held out, as its remainder counts as 0; labels other than 0 and
    1 are passed over; without labels all scores are 0.5; repeated rows and ties score alike; very long texts are worked on whole,
    in memory of some 100 times the longest; an empty table gives no rows; other columns, whatever their names, are not looked at.
    """
    apart = remainder(F.col("doc_id"), 5)
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled_sample(docs, labels, "toxic", apart != 0, TRAIN_ROWS)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_score(model), f"doc_id {kind}, score double")
    return scored.select("doc_id", (apart == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
