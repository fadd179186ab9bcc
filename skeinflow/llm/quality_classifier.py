"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Tokens are runs of letters, of digits or of punctuation, hashed to 2**BITS places.  Each place has a fixed sparse random
index vector (one +1 and one -1), and its word vector is the sum of the index vectors of the neighbours, up to two tokens
away, of all its occurrences in all documents, brought to unit length.  Tasks add vectors up in numpy and pass on the places that
they have seen; these are summed in two rounds, in streams, in whole numbers, so reruns agree to the bit.  The result is broadcast
(32 MB at most, whatever the corpus).

A document is the mean and the mean square of its tokens' vectors.  The network learns in numpy on the driver, from the
pooled vectors of a bounded sample of labelled documents; a temperature, fitted on a part of the sample that it has not
seen, calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.llm import kernels as K
from skeinflow.llm.common import labelled_sample, remainder

BITS, DIM, REACH = 18, 32, 2
#: Labelled documents to learn from at most; one in HELD of them fits the temperature.
TRAIN_ROWS, HELD = 12_000, 5
HIDDEN, EPOCHS, RATE, DECAY = 24, 60, 5e-3, 1e-4
#: Slices of the vector table that travel as one row, partitions of documents whose sums are added up together first, and tasks that do so.
SLICES, TOGETHER, SUMMING = 32, 8, 256

_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[K.SEPARATOR] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_place = np.random.default_rng(5)
_PLUS = _place.integers(0, DIM, 1 << BITS)
_MINUS = (_PLUS + _place.integers(1, DIM, 1 << BITS)) % DIM


def tokens(t: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Place of every token of a run, and the index of each row's first."""
    kind = _CLASS[t.data]
    n = len(kind)
    edge = np.ones(n, dtype=bool)
    edge[1:] = kind[1:] != kind[:-1]
    heads = t.offsets[:-1]
    edge[heads[heads < n]] = True
    cut = np.flatnonzero(edge)
    ends = np.append(cut[1:], n)
    use = kind[cut] > 0
    start, end = cut[use], ends[use]
    h = K.span_hashes(t.data, start, end, seed=7)
    return (h >> np.uint64(64 - BITS)).astype(np.int64), np.searchsorted(start, t.offsets)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(DIM << BITS, dtype=np.int32)
    for batch in batches:
        for t in K.texts(batch.column("text")):
            b, first = tokens(t)
            rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
            for reach in range(1, REACH + 1):
                same = rows[reach:] == rows[:-reach]
                x, y = b[:-reach][same], b[reach:][same]
                for to, of in ((x * DIM, y), (y * DIM, x)):
                    np.add.at(total, to + _PLUS[of], 1)
                    np.subtract.at(total, to + _MINUS[of], 1)
    yield _slices(dict(enumerate(total.reshape(SLICES, -1, DIM))))


def _slices(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    """The places of each slice that hold anything, and their sums, in 32 bits as counted and 64 as summed."""
    some = {i: np.flatnonzero(v.any(axis=1)).astype(np.int32) for i, v in held.items()}
    some = {i: at for i, at in some.items() if len(at)}
    columns = [pa.array(list(some), pa.int32()), pa.array([at.tobytes() for at in some.values()], pa.binary()), pa.array([held[i][at].tobytes() for i, at in some.items()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["slice", "places", "sums"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, places, sums in zip(batch.column("slice").to_pylist(), batch.column("places"), batch.column("sums"), strict=True):
            at = np.frombuffer(places.as_buffer(), dtype=np.int32)
            kind = np.int32 if sums.as_buffer().size == 4 * DIM * len(at) else np.int64
            held.setdefault(i, np.zeros(((1 << BITS) // SLICES, DIM), dtype=np.int64))[at] += np.frombuffer(sums.as_buffer(), dtype=kind).reshape(-1, DIM)
    yield _slices(held)


_SUMS = "slice int, places binary, sums binary"


def partial_sums(docs: DataFrame) -> DataFrame:
    """Sums of the index vectors of neighbours by slice, each over some TOGETHER partitions of ``docs``."""
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_gather, _SUMS)
    return rows.withColumn("salt", F.floor(F.spark_partition_id() / TOGETHER)).repartition(SUMMING, "slice", "salt").drop("salt").mapInArrow(_sum, _SUMS)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit word vector of every place, zero where nothing was seen, from all ``docs``."""
    found = partial_sums(docs).repartition(SLICES, "slice").mapInArrow(_sum, _SUMS).collect()
    table = np.zeros((SLICES, (1 << BITS) // SLICES, DIM), dtype=np.float32)
    for r in found:
        sums = np.frombuffer(bytes(r["sums"]), dtype=np.int64).reshape(-1, DIM).astype(np.float64)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        table[r["slice"], np.frombuffer(bytes(r["places"]), dtype=np.int32)] = sums / np.where(length > 0, length, 1)
    return table.reshape(1 << BITS, DIM)


def pooled(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """Mean and mean square of the word vectors of each text; zeros for a text without tokens."""
    out = np.zeros((len(column), 2 * DIM), dtype=np.float32)
    for t in K.texts(column):
        b, first = tokens(t)
        for i in range(t.hi - t.lo):
            lo, hi = first[i], first[i + 1]
            if hi > lo:
                v = table[b[lo:hi]]
                out[t.lo + i, :DIM] = v.mean(axis=0)
                out[t.lo + i, DIM:] = np.einsum("ij,ij->j", v, v) / (hi - lo)
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64) / self.temperature, -35, 35)))


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Fit by Adam on mini-batches; then the temperature by golden section on the part left out."""
    rng = np.random.default_rng(11)
    scale = x.std(axis=0) if len(x) else np.ones(x.shape[1])
    net = Network(
        x.mean(axis=0) if len(x) else np.zeros(x.shape[1]), np.where(scale > 1e-8, scale, 1).astype(np.float32),
        rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0,
    )
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        net.w2 = np.zeros(HIDDEN)
        net.b2 = float(np.log(share / (1 - share)))
        return net
    z = (x - net.mean) / net.scale
    out = np.arange(len(x)) % HELD == 0
    fit_x, fit_y = z[~out], y[~out].astype(np.float64)
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(fit_x))
        rate = RATE * (1 - epoch / EPOCHS)
        for lo in range(0, len(order), 64):
            at = order[lo : lo + 64]
            hidden = np.tanh(fit_x[at] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -35, 35)))
            d = (p - fit_y[at]) / len(at)
            back = d[:, None] * params[2] * (1 - hidden**2)
            grads = [fit_x[at].T @ back + DECAY * params[0], back.sum(axis=0), hidden.T @ d + DECAY * params[2], np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    logits, truth = net.logits(x[out]).astype(np.float64), y[out]

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        return float(np.mean(np.logaddexp(0, s) - truth * s))

    lo, hi, ratio = np.log(0.25), np.log(8.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    net.temperature = float(np.exp((lo + hi) / 2))
    return net


def _pool(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column("text"), model.value)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * (2 * DIM)), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("label"), flat], ["place", "label", "x"])

    return run


def _score(vectors, net):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = net.value.probabilities(pooled(batch.column("text"), vectors.value))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5) of every row of ``docs``.

    Learns from labels of ids whose crc32 modulo 3 is not 1; lang, source and doc_id are no inputs of a score.  Null and
    empty texts pool to zeros and score as such; a null doc_id isn't held out, as its remainder counts as 0, nor learnt
    from; labels other than 0 and 1 are passed over; without labels of both kinds all scores are their smoothed share (0.5
    without any); repeated rows and ties score alike; very long texts are worked on whole, in memory of some 100 times the longest;
    an empty table gives no rows; other columns, whatever their names, are not looked at.
    """
    context = docs.sparkSession.sparkContext
    apart = remainder(F.col("doc_id"), 3)
    # Every broadcast is a file on each executor, so the table goes out once.
    vectors = context.broadcast(word_vectors(docs))
    sample = labelled_sample(docs, labels, "quality", apart != 1, TRAIN_ROWS)
    rows = sample.mapInArrow(_pool(vectors), "place long, label int, x array<float>").toArrow().sort_by([("place", "ascending"), ("label", "ascending")])
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, 2 * DIM) if rows.num_rows else np.zeros((0, 2 * DIM), np.float32)
    net = train(x, rows.column("label").to_numpy())
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = scored.mapInArrow(_score(vectors, context.broadcast(net)), f"doc_id {kind}, score double")
    return scored.select("doc_id", (apart == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
