"""Near-duplicate embeddings by lattice hashing: projections decoded to E8, several tables, neighbouring cells probed.

A table projects a unit vector to one or more groups of eight random orthonormal directions and decodes the point of each group
to the nearest one of the E8 lattice; these lattice points together are its cell.  A vector is stored in its cell and probes the
neighbouring cells (some group moved by one of the 240 minimal vectors) closest to its point.  Members of a bucket (label,
table, cell) are compared by matrix products in blocks, cosines in double precision, those stored there with all others; a
pair met in several buckets counts in the first only, which both ends can tell from their own keys, so no pair is ever written
out.  A block gives the links it adds to each member, and spanning links for the components.

The number of groups follows the number of vectors of a label (LEVELS): with one more group the share of unlike vectors that
meet falls by a factor of some 40 to 100 a table while the tables needed for the same recall grow by less than 2, so the vectors
that one meets by chance stay few and the work grows with about the power 1.1 of the rows.

Equal vectors of a label are one class with a number of its own, so a group of copies costs one vector; ids are looked at in
the end only, so rows that repeat an id don't mix.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.llm import kernels as K
from skeinflow.llm.common import drop_stage, stage
from skeinflow.llm.components import components

COSINE = 0.93


class Level(NamedTuple):
    """Tables, groups of eight directions in each, length of a unit vector's mean projection, neighbours of each group that
    probes are made of, and probes."""

    tables: int
    groups: int
    scale: float
    near: int
    probes: int


#: Distinct vectors of a label up to which each level is used.  Each finds 99 % or more of the random pairs whose cosine is
#: exactly COSINE, at 4 to 256 dimensions (measured), and more of closer ones.
LEVELS: list[tuple[float, Level]] = [
    (1_500, Level(10, 1, 2.8, 8, 8)),
    (60_000, Level(14, 2, 1.7, 5, 8)),
    (4_000_000, Level(26, 3, 1.5, 3, 8)),
    (float("inf"), Level(48, 4, 1.4, 3, 10)),
]
#: Members that one task compares with as many others at once, and rows of a product.
BLOCK, ROWS = 512, 64


@cache
def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((1, -1), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest point with integer coordinates of even sum."""
    near = np.round(x)
    off = x - near
    worst = np.abs(off).argmax(axis=1)
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    w = worst[odd]
    near[odd, w] += np.where(off[odd, w] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: E8 is D8 and D8 moved by a half in every coordinate."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    closer = ((x - b) ** 2).sum(axis=1) < ((x - a) ** 2).sum(axis=1)
    return np.where(closer[:, None], b, a)


@cache
def projections(dim: int, level: Level) -> np.ndarray:
    """tables x dim x (8 * groups); orthonormal columns where the dimension allows."""
    wide = 8 * level.groups
    rng = np.random.default_rng(dim)
    return np.stack([np.linalg.qr(rng.normal(size=(max(dim, wide), wide)))[0][:dim] for _ in range(level.tables)]) * (level.scale * (max(dim, wide) / 8) ** 0.5)


@cache
def _choices(level: Level) -> np.ndarray:
    """Every choice of a neighbour (0: none) for each group, that of none first."""
    return np.array(list(product(range(level.near + 1), repeat=level.groups)))


def cells(unit: np.ndarray, label: np.ndarray, level: Level) -> np.ndarray:
    """Keys of the cell of each vector in each table and of its probes: n x tables x (1 + probes)."""
    n, groups = len(unit), level.groups
    out = np.empty((n, level.tables, 1 + level.probes), dtype=np.int64)
    near, choices = minimal_vectors(), _choices(level)
    mult = np.random.default_rng(groups).integers(1, 2**63, (groups, 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    seed = K.mix(label.astype(np.int64).view(np.uint64) * np.uint64(4096) + np.uint64(groups))
    # Hash of a move is added to that of the point: both are sums over doubled coordinates, which are integers.
    moves = [((2 * near).astype(np.int64).view(np.uint64) * m).sum(axis=1, dtype=np.uint64) for m in mult]
    for t, p in enumerate(projections(unit.shape[1], level)):
        z = (unit @ p).reshape(n, groups, 8)
        point = decode(z.reshape(-1, 8)).reshape(n, groups, 8)
        base = ((2 * point).astype(np.int64).view(np.uint64) * mult).sum(axis=(1, 2), dtype=np.uint64)
        cost, shift = np.zeros((n, groups, level.near + 1)), np.zeros((n, groups, level.near + 1), dtype=np.uint64)
        for g in range(groups):
            gain = -2 * (z[:, g] - point[:, g]) @ near.T
            some = np.argpartition(gain, level.near, axis=1)[:, : level.near]
            order = np.lexsort((some, np.take_along_axis(gain, some, axis=1)))
            some = np.take_along_axis(some, order, axis=1)
            cost[:, g, 1:] = 2 + np.take_along_axis(gain, some, axis=1)
            shift[:, g, 1:] = moves[g][some]
        total = sum(cost[:, g, choices[:, g]] for g in range(groups))
        pick = np.argpartition(total[:, 1:], level.probes - 1, axis=1)[:, : level.probes] + 1
        pick = np.concatenate([np.zeros((n, 1), dtype=np.int64), pick], axis=1)
        moved = sum(np.take_along_axis(shift[:, g], choices[pick, g], axis=1) for g in range(groups))
        out[:, t] = K.signed(K.mix((base[:, None] + moved) ^ (seed + np.uint64(t))[:, None]))
    return out


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the lists of a column (null: 0) and all their values (null: NaN), in order."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return size, column.flatten().to_numpy(zero_copy_only=False)


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of each vector, null if it can link with nothing."""
    for batch in batches:
        column = batch.column("embedding")
        size, x = _flat(column)
        x = x + 0.0
        ends = np.cumsum(size)
        first = ends - size
        place = np.arange(len(x)) - np.repeat(first, size)
        bits = K.mix(np.ascontiguousarray(x).view(np.uint64) + (place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

        def sums(v: np.ndarray, first: np.ndarray = first, ends: np.ndarray = ends) -> np.ndarray:
            total = np.concatenate([np.zeros(1, v.dtype), np.cumsum(v)])
            return total[ends] - total[first]

        good = (sums((~np.isfinite(x)).astype(np.int64)) == 0) & (sums((x != 0).astype(np.int64)) > 0)
        good &= pc.and_(batch.column("vec_id").is_valid(), batch.column("label").is_valid()).to_numpy(zero_copy_only=False)
        hashes = [pa.array(K.signed(sums(h)), mask=~good) for h in (bits, K.mix(bits ^ np.uint64(0x5851F42D4C957F2D)))]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), column, *hashes], ["vec_id", "label", "embedding", "k1", "k2"])


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows brought to length 1, without overflow for very large or small components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(levels: list[tuple[float, Level]]):
    """The unit vector of each class and its keys, those of a table together, the cell's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                size, x = _flat(batch.column("embedding"))
                first = np.cumsum(size) - size
                label, at_level = batch.column("label").to_numpy(), batch.column("level").to_numpy()
                units: list[bytes] = [b""] * len(size)
                keys: list[np.ndarray] = [first[:0]] * len(size)
                for dim, k in {*zip(size.tolist(), at_level.tolist(), strict=True)}:
                    at = np.flatnonzero((size == dim) & (at_level == k))
                    unit = unit_rows(x[first[at][:, None] + np.arange(dim)])
                    found = cells(unit, label[at], levels[k][1])
                    for i, u, f in zip(at.tolist(), unit, found, strict=True):
                        units[i], keys[i] = u.tobytes(), f.reshape(-1)
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                made = [pa.array(units, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cls", "n", "label", "level")), *made], ["cls", "n", "label", "level", "unit", "keys"])

    return run


def _first_bucket(x: np.ndarray, y: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Key of the first bucket in which rows x[i] and y[i] meet; x[i] is the one with the lower number."""
    out = np.zeros(len(x), dtype=np.int64)
    todo = np.arange(len(x))
    for t in range(keys.shape[1]):
        a, b = keys[x[todo], t], keys[y[todo], t]
        mine, theirs = (a[:, 1:] == b[:, :1]).any(axis=1), (b[:, 1:] == a[:, :1]).any(axis=1)
        same = a[:, 0] == b[:, 0]
        met = same | mine | theirs
        out[todo[met]] = np.where(same | ~mine, a[:, 0], b[:, 0])[met]
        todo = todo[~met]
        if not len(todo):
            break
    return out


def _settle(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least row that each row is linked with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(levels: list[tuple[float, Level]], key: tuple, rows: list[tuple]) -> list[tuple[int, int, int]]:
    """(class, links added, root) for the members that link in this block."""
    bucket, i, j = key
    rows.sort(key=lambda r: r[0])
    out: list[tuple[int, int, int]] = []
    # One bucket holds one label, level and dimension, but for what hashes may mix up.
    for kind in {r[3:5] + (len(r[6]),) for r in rows}:
        some = [r for r in rows if r[3:5] + (len(r[6]),) == kind]
        if len(some) < 2:
            continue
        number, weight, part = (np.array([r[k] for r in some]) for k in (0, 1, 2))
        stored = np.array([r[5] for r in some], dtype=bool)
        level = levels[kind[1]][1]
        unit, keys = np.stack([np.frombuffer(r[6]) for r in some]), np.stack([r[7] for r in some]).reshape(len(some), level.tables, -1)
        here, there = part == i, part == j
        # Those stored here with all others, two that are stored once only.
        tasks = [(stored, stored, True), (stored, ~stored, False)] if i == j else [(stored & here, there, False), (stored & there, here & ~stored, False)]
        links, pairs = np.zeros(len(some), dtype=np.int64), []
        for left, right, rising in tasks:
            left, right = np.flatnonzero(left), np.flatnonzero(right)
            for lo in range(0, len(left), ROWS):
                at = left[lo : lo + ROWS]
                x, y = np.nonzero(unit[at] @ unit[right].T >= COSINE)
                x, y = at[x], right[y]
                if rising:
                    x, y = x[x < y], y[x < y]
                low, high = np.minimum(x, y), np.maximum(x, y)
                mine = _first_bucket(low, high, keys) == bucket
                x, y = low[mine], high[mine]
                links += np.bincount(x, weight[y], len(some)).astype(np.int64) + np.bincount(y, weight[x], len(some)).astype(np.int64)
                pairs.append((x, y))
        if links.any():
            root = _settle(len(some), *(np.concatenate(c) for c in zip(*pairs, strict=True)))
            out += [(int(number[k]), int(links[k]), int(number[root[k]])) for k in np.flatnonzero(links)]
    return out


def _blocks(levels: list[tuple[float, Level]]):
    """Rows of one (bucket, i, j) come together; gives what their comparison adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def batch_of(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], ["cls", "links", "root"])

        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                found: list[tuple[int, int, int]] = []
                size, flat = _flat(batch.column("keys"))
                keys = np.split(flat, np.cumsum(size)[:-1])
                plain = (batch.column(c).to_pylist() for c in ("bucket", "i", "j", "cls", "n", "part", "label", "level", "stored", "unit"))
                for bucket, i, j, *row in zip(*plain, keys, strict=True):
                    if (bucket, i, j) != key:
                        found += _compare(levels, key, rows) if len(rows) > 1 else []
                        key, rows = (bucket, i, j), []
                    rows.append(tuple(row))
                yield batch_of(found)
        yield batch_of(_compare(levels, key, rows) if len(rows) > 1 else [])

    return run


def near_vectors(vectors: DataFrame, levels: list[tuple[float, Level]] = LEVELS) -> DataFrame:
    """vec_id, n_links, component_id (smallest vec_id linked, itself included), kept (vec_id = component_id).

    Vectors that are null, empty or zero, that hold null or non-finite components, or whose label or vec_id is null link
    with nothing; vectors of different lengths do not link.  A null vec_id has a null component and is kept.  Rows that
    repeat an id are vectors of their own: each has its own links, equal ones link with each other, and two rows of one id
    are in one component only if links join them.  Cosines tied with the bound link.  Very long vectors take memory for a block
    of them (512).  An empty table gives no rows; other columns, whatever their names, are not looked at.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    named = stage(rows.mapInArrow(_usable, "vec_id long, label long, embedding array<double>, k1 long, k2 long"), "vectors")
    group = ["label", "k1", "k2"]
    classes = named.where("k1 IS NOT NULL").groupBy(*group).agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    # Numbers of the classes, fixed by being written.
    classes = stage(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    level = F.lit(len(levels) - 1)
    for k, (most, _) in reversed(list(enumerate(levels[:-1]))):
        level = F.when(F.col("in_label") <= most, F.lit(k)).otherwise(level)
    sizes = classes.groupBy("label").agg(F.count("*").alias("in_label")).select("label", level.alias("level"))
    ready = classes.select("cls", "n", "label", "embedding").join(sizes, "label")
    hashed = stage(ready.mapInArrow(_hashed(levels), "cls long, n long, label long, level int, unit binary, keys array<long>"), "cells")

    probes = F.element_at(F.array(*(F.lit(x.probes + 1) for _, x in levels)), F.col("level") + 1)
    entries = hashed.select("cls", F.posexplode("keys").alias("pos", "bucket"), probes.alias("probes"))
    entries = entries.select("cls", "bucket", (F.col("pos") % F.col("probes") == 0).alias("stored"))
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("m"), F.max("stored").alias("held")).where("m > 1 AND held")
    sizes = sizes.select("bucket", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts"))
    met = entries.join(sizes, "bucket").select("bucket", "cls", "stored", "parts", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int").alias("part"))
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(F.col("part"), p).alias("i"), F.greatest(F.col("part"), p).alias("j")))
    met = met.withColumn("k", F.explode(others)).select("bucket", "k.i", "k.j", "cls", "part", "stored")
    full = met.join(hashed, "cls").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "cls")
    full = full.select("bucket", "i", "j", "cls", "n", "part", "label", "level", "stored", "unit", "keys")
    found = stage(full.mapInArrow(_blocks(levels), "cls long, links long, root long"), "found")

    roots = components(found.where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    known = classes.select(*group, "cls", "n", "least").join(counts, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    known = stage(known.select(*group, "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cls").alias("root")), "known")
    drop_stage(classes, hashed, found)
    lowest = known.groupBy("root").agg(F.min("least").alias("component"))
    out = named.select("vec_id", *group).join(known.join(lowest, "root").select(*group, "n_links", "component"), group, "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id").isNull() | (component == F.col("vec_id"))).alias("kept"))


#: DuckDB SQL for the same rows, by brute force.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN n USING (vec_id)
"""
