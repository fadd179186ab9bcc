"""Coherent noise in two to four dimensions: gradient noise on the simplex grid, seeded, in [-1, 1]."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reach of a corner's influence (squared) and the scale to unit range, by dimension.
_REACH = 0.5
_SCALE = {2: 99.0, 3: 76.0, 4: 62.0}


def _gradients(cells: np.ndarray, seed: int) -> np.ndarray:
    """A unit vector for each integer cell, from a hash."""
    h = np.full(len(cells), (seed * 2 + 1) & (2**64 - 1), dtype=np.uint64)
    for d in range(cells.shape[1]):
        h = (h ^ cells[:, d].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    out = np.empty(cells.shape)
    for d in range(cells.shape[1]):
        h = h * np.uint64(0xD6E8FEB86659FD93) + np.uint64(d + 1)
        u1 = ((h >> np.uint64(11)).astype(float) + 1) / (2**53 + 1)
        h ^= h >> np.uint64(31)
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        u2 = (h >> np.uint64(11)).astype(float) / 2**53
        out[:, d] = np.sqrt(-2 * np.log(u1)) * np.cos(2 * np.pi * u2)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def simplex(points: np.ndarray, seed: int = 0) -> np.ndarray:
    """Noise at each row of an n x d array."""
    n, d = points.shape
    skew, back = ((d + 1) ** 0.5 - 1) / d, (1 - 1 / (d + 1) ** 0.5) / d
    cell = np.floor(points + points.sum(axis=1, keepdims=True) * skew)
    local = points - (cell - cell.sum(axis=1, keepdims=True) * back)
    order = np.argsort(-local, axis=1, kind="stable")
    corner = np.zeros((n, d))
    total = np.zeros(n)
    for k in range(d + 1):
        offset = local - corner + k * back
        near = np.maximum(_REACH - (offset**2).sum(axis=1), 0)
        total += near**4 * (offset * _gradients(cell + corner, seed)).sum(axis=1)
        if k < d:
            corner = corner.copy()
            corner[np.arange(n), order[:, k]] = 1
    return np.clip(_SCALE[d] * total, -1, 1)


def noise(*coordinates: Column, seed: int = 0) -> Column:
    """Noise of two, three or four coordinate columns."""

    @F.pandas_udf("double")
    def run(*cs: pd.Series) -> pd.Series:
        return pd.Series(simplex(np.column_stack([c.to_numpy(dtype=float) for c in cs]), seed))

    if not 2 <= len(coordinates) <= 4:
        raise ValueError("two to four coordinates")
    return run(*(c.cast("double") for c in coordinates))
