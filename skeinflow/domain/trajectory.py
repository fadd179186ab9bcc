"""Trajectories in the plane: turns, density maps, peaks, comparison, and motion models."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.functions import lists


def turns(points, threshold: float = 0.5) -> Column:
    """Interior points (structs x, y) at which the heading changes by more than ``threshold`` radians."""
    p = F.col(points) if isinstance(points, str) else points

    def angle(i: Column) -> Column:
        a, b, c = F.get(p, i - 1), F.get(p, i), F.get(p, i + 1)
        ux, uy, wx, wy = b["x"] - a["x"], b["y"] - a["y"], c["x"] - b["x"], c["y"] - b["y"]
        sizes = F.sqrt(ux * ux + uy * uy) * F.sqrt(wx * wx + wy * wy)
        return F.when(sizes > 1e-20, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * wx + uy * wy) / F.when(sizes > 1e-20, sizes)))))

    inner = F.filter(lists.upto(F.size(p)), lambda i: (i > 0) & (i < F.size(p) - 1))
    return F.transform(F.filter(inner, lambda i: angle(i) > threshold), lambda i: F.get(p, i))


def cells(df: DataFrame, width: int, height: int, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Centres (gx, gy, cx, cy) of a grid over (x0, x1, y0, y1): width * height rows."""
    x0, x1, y0, y1 = bounds
    grid = df.sparkSession.range(width * height).select((F.col("id") % width).cast("int").alias("gx"), F.floor(F.col("id") / width).cast("int").alias("gy"))
    return grid.withColumn("cx", x0 + (F.col("gx") + 0.5) * ((x1 - x0) / width)).withColumn("cy", y0 + (F.col("gy") + 0.5) * ((y1 - y0) / height))


def kde(points: DataFrame, bounds: tuple[float, float, float, float], width: int = 100, height: int = 100, bandwidth: float = 5.0, block: int = 4096) -> DataFrame:
    """Mean Gaussian at the cell centres: (gx, gy, cx, cy, density).

    A Gaussian is a product over the axes, so each task reduces its points to one small matrix product per batch; partial
    grids of fixed size are summed.
    """
    x0, x1, y0, y1 = bounds
    cx = x0 + (np.arange(width) + 0.5) * (x1 - x0) / width
    cy = y0 + (np.arange(height) + 0.5) * (y1 - y0) / height

    def run(batches):
        total, n = np.zeros((height, width)), 0
        for pdf in batches:
            for lo in range(0, len(pdf), block):
                part = pdf.iloc[lo : lo + block]
                gx = np.exp(-((cx[None, :] - part["x"].to_numpy()[:, None]) ** 2) / (2 * bandwidth**2))
                gy = np.exp(-((cy[None, :] - part["y"].to_numpy()[:, None]) ** 2) / (2 * bandwidth**2))
                total += gy.T @ gx
            n += len(pdf)
        if n:
            yield pd.DataFrame({"gx": np.tile(np.arange(width), height), "gy": np.repeat(np.arange(height), width), "v": total.reshape(-1), "n": n})

    parts = points.select(F.col("x").cast("double"), F.col("y").cast("double")).mapInPandas(run, "gx int, gy int, v double, n long")
    scale = 2 * math.pi * bandwidth * bandwidth
    summed = parts.groupBy("gx", "gy").agg((F.sum("v") / F.sum("n") / scale).alias("density"))
    return cells(points, width, height, bounds).join(summed, ["gx", "gy"], "left").withColumn("density", F.coalesce("density", F.lit(0.0)))


def directional_variance(headings: DataFrame, bounds: tuple[float, float, float, float], width: int, height: int, radius: float) -> DataFrame:
    """1 - length of the mean heading of the points (x, y, angle) within ``radius`` of each cell centre; 0 without any.

    Points meet the cells of a coarse grid around theirs, an equi-join.
    """
    grid = cells(headings, width, height, bounds)
    near = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    h = headings.withColumn("bx", F.floor(F.col("x") / radius)).withColumn("by", F.floor(F.col("y") / radius))
    g = grid.withColumn("o", F.explode(near)).withColumn("bx", F.floor(F.col("cx") / radius) + F.col("o.i")).withColumn("by", F.floor(F.col("cy") / radius) + F.col("o.j"))
    met = g.join(h.select("bx", "by", "x", "y", "angle"), ["bx", "by"]).where((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2 <= radius * radius)
    v = met.groupBy("gx", "gy").agg((1 - F.sqrt(F.pow(F.avg(F.cos("angle")), F.lit(2)) + F.pow(F.avg(F.sin("angle")), F.lit(2)))).alias("variance"))
    return grid.join(v, ["gx", "gy"], "left").withColumn("variance", F.coalesce("variance", F.lit(0.0)))


def combined(density: DataFrame, variance: DataFrame, weight: float = 1.0) -> DataFrame:
    """density * (1 + weight * variance) by cell."""
    return density.join(variance.select("gx", "gy", "variance"), ["gx", "gy"]).withColumn("density", F.col("density") * (1 + weight * F.col("variance")))


def saturated(x: Column, kind: str, strength: float = 1.0) -> Column:
    """power: x ** strength; log: log(1 + strength * x); sigmoid: 1 / (1 + exp(-strength * x))."""
    return {"power": lambda: F.pow(x, F.lit(strength)), "log": lambda: F.log1p(strength * x), "sigmoid": lambda: 1 / (1 + F.exp(-strength * x))}[kind]()


def peaks(grid: DataFrame, width: int, height: int, threshold: float = 0.01) -> DataFrame:
    """Inner cells of at least ``threshold`` that no neighbour exceeds."""
    near = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j))
    around = grid.withColumn("o", F.explode(near)).select((F.col("gx") + F.col("o.i")).alias("gx"), (F.col("gy") + F.col("o.j")).alias("gy"), "density")
    most = around.groupBy("gx", "gy").agg(F.max("density").alias("around"))
    inner = F.col("gx").between(1, width - 2) & F.col("gy").between(1, height - 2)
    return grid.where(inner & (F.col("density") >= threshold)).join(most, ["gx", "gy"]).where("around <= density").drop("around")


def compare(a: DataFrame, b: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    """Difference a - b and ratio a / (b + epsilon) by cell."""
    right = b.select("gx", "gy", F.col("density").alias("_b"))
    return a.join(right, ["gx", "gy"]).select("gx", "gy", (F.col("density") - F.col("_b")).alias("difference"), (F.col("density") / (F.col("_b") + epsilon)).alias("ratio"))


def spatial_correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pearson over cells, 0 where either hardly varies."""
    both = a.join(b.select("gx", "gy", F.col("density").alias("_b")), ["gx", "gy"])
    n = F.count("*")
    flat = (F.var_pop("density") * n < 1e-10) | (F.var_pop("_b") * n < 1e-10)
    return both.agg(F.when(flat, F.lit(0.0)).otherwise(F.coalesce(F.corr("density", "_b"), F.lit(0.0))).alias("correlation"))


def object_density(objects: DataFrame, bounds: tuple[float, float, float, float], width: int, height: int, bandwidth: float = 1.0) -> DataFrame:
    """Sum over rotated rectangles (x, y, w, h, rotation) of an oriented Gaussian that is nine parts round: (gx, gy, density).

    Tasks add their objects up on a grid of fixed size; the partial grids are summed.
    """
    x0, x1, y0, y1 = bounds
    cx, cy = np.meshgrid(x0 + (np.arange(width) + 0.5) * (x1 - x0) / width, y0 + (np.arange(height) + 0.5) * (y1 - y0) / height)

    def run(batches):
        total, any_rows = np.zeros((height, width)), False
        for pdf in batches:
            for x, y, w, h, angle in pdf.itertuples(index=False):
                any_rows = True
                mean = (w + h) / 2
                sx, sy = ((0.9 * mean + 0.1 * side) / 2 * bandwidth for side in (w, h))
                lx = (cx - x) * np.cos(angle) + (cy - y) * np.sin(angle)
                ly = (cy - y) * np.cos(angle) - (cx - x) * np.sin(angle)
                total += np.exp(-(lx**2 / (2 * sx**2) + ly**2 / (2 * sy**2)))
        if any_rows:
            yield pd.DataFrame({"gx": np.tile(np.arange(width), height), "gy": np.repeat(np.arange(height), width), "v": total.reshape(-1)})

    rows = objects.select(*(F.col(c).cast("double") for c in ("x", "y", "w", "h", "rotation")))
    return rows.mapInPandas(run, "gx int, gy int, v double").groupBy("gx", "gy").agg(F.sum("v").alias("density"))


def in_rectangle(x: Column, y: Column, cx: Column, cy: Column, w: Column, h: Column, rotation: Column) -> Column:
    dx, dy = x - cx, y - cy
    lx, ly = dx * F.cos(rotation) + dy * F.sin(rotation), -dx * F.sin(rotation) + dy * F.cos(rotation)
    return (F.abs(lx) <= w / 2) & (F.abs(ly) <= h / 2)


def resample(points: np.ndarray, spacing: float) -> np.ndarray:
    """Points at equal distances along a path, with its first and last point."""
    step = np.hypot(*np.diff(points, axis=0).T)
    at = np.concatenate([[0], np.cumsum(step)])
    keep = np.concatenate([[True], step > 1e-10])
    want = np.arange(0, at[-1] + 1e-12, spacing)
    out = np.column_stack([np.interp(want, at[keep], points[keep, k]) for k in (0, 1)])
    return np.vstack([out, points[-1:]])


def resampled(points: Column, spacing: float) -> Column:
    @F.pandas_udf("array<struct<x: double, y: double>>")
    def run(s: pd.Series) -> pd.Series:
        def one(v):
            if len(v) < 2:
                return []
            return [{"x": float(a), "y": float(b)} for a, b in resample(np.array([[q["x"], q["y"]] for q in v], dtype=float), spacing)]

        return s.map(one)

    return run(points)


# --- motion models: position and velocity at time t in closed form

def ballistic(t: Column, x0, y0, vx, vy, gravity) -> tuple[Column, Column, Column, Column]:
    """x, y, vx, vy under constant acceleration."""
    return x0 + vx * t, y0 + vy * t - 0.5 * gravity * t * t, F.lit(0.0) + vx, vy - gravity * t


def linear(t: Column, x0, y0, vx, vy) -> tuple[Column, Column, Column, Column]:
    return x0 + vx * t, y0 + vy * t, F.lit(0.0) + vx, F.lit(0.0) + vy


def pendulum(t: Column, x0, y0, length, amplitude, gravity, phase=0.0) -> tuple[Column, Column, Column, Column]:
    """Small swings of a bob below (x0, y0)."""
    w = F.sqrt(F.lit(0.0) + gravity / length)
    a = amplitude * F.cos(w * t + phase)
    da = -amplitude * w * F.sin(w * t + phase)
    return x0 + length * F.sin(a), y0 - length * F.cos(a), length * F.cos(a) * da, length * F.sin(a) * da


def sample(df: DataFrame, key: str, model, duration: Column, dt: float) -> DataFrame:
    """(key, t, x, y) on a time grid, the end point included; ``model`` maps a time column to x, y, vx, vy."""
    steps = F.sequence(F.lit(0), F.ceil(duration / dt - 1e-9).cast("int"))
    rows = df.withColumn("_i", F.explode(steps)).withColumn("t", F.least(F.col("_i") * dt, duration))
    x, y, _, _ = model(F.col("t"))
    return rows.select(key, "t", x.alias("x"), y.alias("y"))
