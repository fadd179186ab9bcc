"""Spike density, adaptive densities and Fourier transforms on list columns, by numpy in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinflow.types import array, struct


def kernel(sd: float, nsd: float) -> np.ndarray:
    """Half of a Gaussian kernel (centre first), as long as nsd * sd rounded, made odd; both halves sum to 1."""
    size = int(nsd * sd + 0.5)
    size += size % 2 == 0
    k = np.exp(-(np.arange(size) ** 2) / (sd * sd))
    return k / (2.0 * k.sum())


def _spread(at: np.ndarray, half: np.ndarray, n: int) -> np.ndarray:
    """Sum of kernels centred at integer places, clipped to n samples."""
    reach = len(half)
    counts = np.zeros(n + 2 * reach)
    ok = (at > -reach) & (at < n + reach)
    np.add.at(counts, at[ok] + reach, 1)
    full = np.concatenate([half[:0:-1], half])
    return np.convolve(counts, full, mode="same")[reach : reach + n]


def density(times: np.ndarray, start: float, stop: float, sd: float, nsd: float = 3.0, step: int = 1) -> np.ndarray:
    """Fixed-kernel density at start, start + step, ... stop."""
    n = int(stop - start) + 1
    if not len(times):
        return np.zeros(n)[::step]
    return _spread(np.trunc(times - start).astype(int), kernel(sd, nsd), n)[::step]


def adaptive(times: np.ndarray, start: float, stop: float, pilot: float, nsd: float = 3.0, step: int = 1) -> np.ndarray:
    """Adaptive density: each time's kernel is the pilot's over the square root of the pilot density relative to its
    geometric mean, between 2 and a quarter of the duration."""
    duration = int(stop - start)
    n = duration + 1
    if not len(times) or not duration:
        return np.zeros(n)[::step]
    first = density(times, start, stop, pilot, nsd)
    mu = np.exp(np.log(first[first > 0]).sum() / n)
    with np.errstate(divide="ignore"):
        sds = np.where(first > 0, np.clip(pilot / np.sqrt(first / mu), 2.0, duration / 4.0), 2.0)
    out = np.zeros(n)
    at = np.trunc(times - start).astype(int)
    for width, where in pd.Series(at).groupby(sds[np.clip(at, 0, n - 1)]):
        out += _spread(where.to_numpy(), kernel(float(width), nsd), n)
    return out[::step]


def sdf(times: Column, start: float, stop: float, sd: float, nsd: float = 3.0, step: int = 1) -> Column:
    """Density of one list of times."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: density(np.asarray(v, dtype=float), start, stop, sd, nsd, step).tolist())

    return run(times)


def sdfs(times: Column, start: float, stop: float, sd: float, nsd: float = 3.0, step: int = 1) -> Column:
    """Density of every sublist, kept apart."""

    @F.pandas_udf("array<array<double>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: [density(np.asarray(x, dtype=float), start, stop, sd, nsd, step).tolist() for x in v])

    return run(times)


def sdf_mean(times: Column, start: float, stop: float, sd: float, nsd: float = 3.0, step: int = 1) -> Column:
    """Mean of the sublists' densities."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        n = len(range(0, int(stop - start) + 1, step))
        return s.map(lambda v: np.mean([density(np.asarray(x, dtype=float), start, stop, sd, nsd, step) for x in v], axis=0).tolist() if len(v) else [0.0] * n)

    return run(times)


def sdf_full(times: Column, sd: float, nsd: float = 3.0, step: int = 1) -> Column:
    """Density from the least to the greatest time of each list."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        def one(v):
            x = np.asarray(v, dtype=float)
            return density(x, x.min(), x.max(), sd, nsd, step).tolist() if len(x) else []

        return s.map(one)

    return run(times)


def parzen(times: Column, start: float, stop: float, pilot: float, nsd: float = 3.0, step: int = 1) -> Column:
    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: adaptive(np.asarray(v, dtype=float), start, stop, pilot, nsd, step).tolist())

    return run(times)


def sdf_asym(times: Column, start: float, stop: float, before_sd: float, after_sd: float, nsd: float = 3.0) -> Column:
    """Density with a Gaussian of one width on the near side of a time and of another on the far side, of unit sum."""
    n = int(np.ceil(nsd * max(before_sd, after_sd)))
    t = np.arange(-n, n + 1)
    k = np.exp(-((t / np.where(t < 0, before_sd, after_sd)) ** 2))
    k = k / k.sum()

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        length = int(stop - start) + 1

        def one(v):
            at = np.trunc(np.asarray(v, dtype=float) - start).astype(int)
            counts = np.zeros(length + 2 * n)
            ok = (at >= -n) & (at < length + n)
            np.add.at(counts, at[ok] + n, 1)
            return np.correlate(counts, k, mode="valid").tolist()

        return s.map(one)

    return run(times)


@F.pandas_udf(struct(re=array(T.DoubleType(), 2), im=array(T.DoubleType(), 2)))
def fft2(m: pd.Series) -> pd.DataFrame:
    out = [np.fft.fft2(np.array([list(r) for r in v], dtype=float)) for v in m]
    return pd.DataFrame({"re": [x.real.tolist() for x in out], "im": [x.imag.tolist() for x in out]})


@F.pandas_udf(array(T.DoubleType(), 2))
def ifft2(re: pd.Series, im: pd.Series) -> pd.Series:
    """Real part of the inverse transform."""
    return pd.Series([np.fft.ifft2(np.array([list(r) for r in a]) + 1j * np.array([list(r) for r in b])).real.tolist() for a, b in zip(re, im, strict=True)])


def _tapers(n: int, k: int) -> np.ndarray:
    """k orthonormal sine tapers of n samples."""
    t = np.arange(1, n + 1)
    return np.array([np.sqrt(2 / (n + 1)) * np.sin(np.pi * (j + 1) * t / (n + 1)) for j in range(k)])


def spectrum(x: np.ndarray, rate: float, tapers: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and power, the mean over tapers of re**2 + im**2."""
    f = np.fft.rfft(_tapers(len(x), tapers) * x, axis=1)
    return np.fft.rfftfreq(len(x), 1 / rate), (np.abs(f) ** 2).mean(axis=0)


def coherence(x: np.ndarray, y: np.ndarray, rate: float, tapers: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies, size of cross / sqrt(Sx * Sy), and phase."""
    w = _tapers(len(x), tapers)
    a, b = np.fft.rfft(w * x, axis=1), np.fft.rfft(w * y, axis=1)
    cross = (a * b.conj()).mean(axis=0)
    power = np.sqrt((np.abs(a) ** 2).mean(axis=0) * (np.abs(b) ** 2).mean(axis=0))
    c = np.where(power > 0, cross / np.where(power > 0, power, 1), 0)
    return np.fft.rfftfreq(len(x), 1 / rate), np.abs(c), np.angle(c)


def spectra(df: DataFrame, key: str, column: str, rate: float, tapers: int = 3) -> DataFrame:
    """(key, freq, power) of each list of samples."""

    @F.pandas_udf("array<struct<freq: double, power: double>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: [{"freq": float(f), "power": float(p)} for f, p in zip(*spectrum(np.asarray(v, dtype=float), rate, tapers), strict=True)] if len(v) else [])

    return df.select(key, F.explode(run(F.col(column))).alias("s")).select(key, "s.*")


def coherences(df: DataFrame, key: str, x: str, y: str, rate: float, tapers: int = 3) -> DataFrame:
    """(key, freq, coherence, phase) of two lists of samples of equal length."""

    @F.pandas_udf("array<struct<freq: double, coherence: double, phase: double>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(u, v):
            return [dict(zip(("freq", "coherence", "phase"), map(float, r), strict=True)) for r in zip(*coherence(np.asarray(u, dtype=float), np.asarray(v, dtype=float), rate, tapers), strict=True)] if len(u) else []

        return pd.Series([one(u, v) for u, v in zip(a, b, strict=True)])

    return df.select(key, F.explode(run(F.col(x), F.col(y))).alias("s")).select(key, "s.*")


def spectrogram(df: DataFrame, key: str, column: str, rate: float, width: int, hop: int, tapers: int = 3) -> DataFrame:
    """(key, start, freq, power) of successive stretches of each list."""
    starts = F.sequence(F.lit(0), F.size(column) - width, F.lit(hop))
    cut = df.where(F.size(column) >= width).select(key, F.col(column).alias("_x"), F.explode(starts).alias("start"))
    cut = cut.select(F.struct(key, "start").alias("_k"), F.slice("_x", F.col("start") + 1, width).alias("_x"))
    return spectra(cut, "_k", "_x", rate, tapers).select("_k.*", "freq", "power")


def lowess(x: np.ndarray, y: np.ndarray, f: float = 2 / 3, steps: int = 3, delta: float = 0.0) -> np.ndarray:
    """Locally weighted regression of y on ascending x: each point's line fits its nearest share f of the points with tricube
    weights, then ``steps`` times again with weights that fall with the residuals.  Points nearer than delta to a fitted one
    are interpolated."""
    n = len(x)
    if n < 3:
        return y.astype(float)
    k = max(2, min(n, int(f * n + 1e-7)))
    at = [0]
    for i in range(1, n):
        if x[i] > x[at[-1]] + delta or i == n - 1:
            at.append(i)
    at = np.unique(at)
    robust, fit = np.ones(n), np.zeros(n)
    for _ in range(steps + 1):
        for i in at:
            d = np.abs(x - x[i])
            reach = np.partition(d, k - 1)[k - 1]
            u = np.clip(d / reach, 0, 1) if reach > 0 else (d > 0).astype(float)
            w = (1 - u**3) ** 3 * robust
            s = w.sum()
            if s <= 0:
                fit[i] = y[i]
                continue
            mx, my = (w * x).sum() / s, (w * y).sum() / s
            var = (w * (x - mx) ** 2).sum()
            fit[i] = my + ((w * (x - mx) * (y - my)).sum() / var * (x[i] - mx) if var > 1e-12 * s else 0)
        fit = np.interp(x, x[at], fit[at])
        off = np.abs(y - fit)
        scale = 6 * np.median(off)
        robust = np.clip(1 - (off / scale) ** 2, 0, 1) ** 2 if scale > 0 else np.ones(n)
    return fit


def lowess_rows(df: DataFrame, keys: list[str], x: str, y: str, f: float = 2 / 3, steps: int = 3, delta: float = 0.0) -> DataFrame:
    """(keys, x, y, fit) by group; a group is fitted within one task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([x, y], kind="stable")
        return pdf.assign(fit=lowess(pdf[x].to_numpy(dtype=float), pdf[y].to_numpy(dtype=float), f, steps, delta))

    some = df.select(*keys, F.col(x).cast("double"), F.col(y).cast("double"))
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), f"`{x}` double, `{y}` double, fit double"])
    return some.groupBy(*keys).applyInPandas(one, schema)
