"""Temporal filters: regressors of slow drifts removed from every series.

The regressors depend on time only, so each series is one row of values and a
batch of series is filtered by one matrix product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cosine_basis(n: int, cutoff: float) -> np.ndarray:
    """Discrete cosines with periods of ``cutoff`` samples or more, and the constant."""
    k = int(2 * n / cutoff)
    t = np.arange(n)
    return np.column_stack([np.ones(n)] + [np.cos(np.pi * (2 * t + 1) * i / (2 * n)) for i in range(1, k + 1)])


def fourier_basis(n: int, pairs: int) -> np.ndarray:
    t = np.arange(n) / n
    return np.column_stack([np.ones(n)] + [f(2 * np.pi * i * t) for i in range(1, pairs + 1) for f in (np.sin, np.cos)])


def polynomial_basis(n: int, degree: int) -> np.ndarray:
    return np.polynomial.legendre.legvander(np.linspace(-1, 1, n), degree)


def as_series(df: DataFrame, by: list[str], t: str, x: str) -> DataFrame:
    """One row a series: its values in the order of t."""
    s = F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(x).cast("double").alias("x"))))
    return df.groupBy(*by).agg(s.alias("s")).select(*by, F.col("s.t").alias("ts"), F.col("s.x").alias("values"))


def remove_drifts(series: DataFrame, kind: str = "cosine", size: float = 64) -> DataFrame:
    """The series with the drifts of a basis removed and their mean kept; a bad value is left out of the fit and stays."""
    build = {"cosine": cosine_basis, "fourier": lambda n, k: fourier_basis(n, int(k)), "polynomial": lambda n, k: polynomial_basis(n, int(k))}[kind]

    def run(it):
        bases: dict[int, np.ndarray] = {}
        for pdf in it:
            out = []
            for v in pdf["values"]:
                y = np.array([np.nan if x is None else x for x in v], float)
                X = bases.setdefault(y.size, build(y.size, size))
                ok = np.isfinite(y)
                if ok.sum() > X.shape[1]:
                    b = np.linalg.lstsq(X[ok], y[ok], rcond=None)[0]
                    y = y - X @ b + y[ok].mean()
                out.append(y.tolist())
            yield pdf.assign(values=out)

    return series.mapInPandas(run, series.schema)


def power_spectrum(series: DataFrame, by: list[str], width: int) -> DataFrame:
    """by, frequency bin and power: Welch's average over half-overlapping Hann-weighted pieces."""
    schema = ", ".join(f"`{c}` {series.schema[c].dataType.simpleString()}" for c in by) + ", bin int, power double"

    def run(it):
        for pdf in it:
            rows = []
            for _, r in pdf.iterrows():
                y = np.nan_to_num(np.array(r["values"], float))
                n = min(width, y.size)
                w = np.hanning(n + 1)[:n] if n > 1 else np.ones(n)
                parts = [y[i : i + n] for i in range(0, max(1, y.size - n + 1), max(1, n // 2))]
                p = np.mean([np.abs(np.fft.rfft((q - q.mean()) * w)) ** 2 for q in parts], axis=0) / max((w * w).sum(), 1e-12)
                rows.append(pd.DataFrame({**{c: [r[c]] * p.size for c in by}, "bin": np.arange(p.size, dtype=np.int32), "power": p}))
            yield pd.concat(rows) if rows else pd.DataFrame(columns=[*by, "bin", "power"])

    return series.mapInPandas(run, schema)


def resample(series: DataFrame, factor: int) -> DataFrame:
    """Every ``factor`` values as their mean: an anti-aliased lower rate."""
    n = F.floor(F.size("values") / factor).cast("int")
    mean = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.aggregate(F.slice("values", i * factor + 1, factor), F.lit(0.0), lambda a, v: a + v) / factor)
    return series.withColumn("values", F.when(n > 0, mean).otherwise(F.array().cast("array<double>"))).withColumn("ts", F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at("ts", (i - 1) * factor + 1)))


def _per_series(series: DataFrame, kernel) -> DataFrame:
    """Every series' values through ``kernel(array) -> array``; batches of rows, no shuffle."""

    def run(it):
        for pdf in it:
            yield pdf.assign(values=[kernel(np.array([np.nan if x is None else x for x in v], float)).tolist() for v in pdf["values"]])

    return series.mapInPandas(run, series.schema)


def band_pass(series: DataFrame, low: float, high: float) -> DataFrame:
    """The part of each series with frequencies (cycles a sample) in [low, high]; bad values count as the mean."""

    def kernel(y):
        m = np.nanmean(y) if np.isfinite(y).any() else 0.0
        f = np.fft.rfft(np.where(np.isfinite(y), y, m))
        w = np.fft.rfftfreq(y.size)
        return np.fft.irfft(np.where((w >= low) & (w <= high), f, 0), y.size) if y.size else y

    return _per_series(series, kernel)


def butterworth_gain(freq: np.ndarray, cutoff: float, order: int) -> np.ndarray:
    return 1 / np.sqrt(1 + (freq / cutoff) ** (2 * order))


def low_pass(series: DataFrame, cutoff: float, order: int = 4) -> DataFrame:
    """A zero-phase low pass with the Butterworth gain."""

    def kernel(y):
        m = np.nanmean(y) if np.isfinite(y).any() else 0.0
        f = np.fft.rfft(np.where(np.isfinite(y), y, m))
        return np.fft.irfft(f * butterworth_gain(np.fft.rfftfreq(y.size), cutoff, order), y.size) if y.size else y

    return _per_series(series, kernel)


def shift(series: DataFrame, by_samples: float) -> DataFrame:
    """Values at times moved by a part of a sample (slice-time correction): linear interpolation, ends held."""

    def kernel(y):
        t = np.arange(y.size)
        ok = np.isfinite(y)
        return np.interp(t + by_samples, t[ok], y[ok]) if ok.any() else y

    return _per_series(series, kernel)


def despike(series: DataFrame, limit: float = 5.0) -> DataFrame:
    """Values whose step from both neighbours exceeds ``limit`` robust deviations become the neighbours' mean."""

    def kernel(y):
        if y.size < 3:
            return y
        d = np.diff(y)
        s = np.nanmedian(np.abs(d - np.nanmedian(d))) / 0.6745
        bad = np.zeros(y.size, bool)
        bad[1:-1] = (np.abs(d[:-1]) > limit * s) & (np.abs(d[1:]) > limit * s) & (d[:-1] * d[1:] < 0)
        out = y.copy()
        at = np.flatnonzero(bad)
        out[at] = (y[at - 1] + y[at + 1]) / 2
        return out

    return _per_series(series, kernel)


def best_lag(pairs: DataFrame, key: str, a: str, b: str, most: int) -> DataFrame:
    """key, lag and r: the shift of series b against series a (within ``most`` samples) of the largest correlation, the smallest shift of ties."""

    def run(it):
        for pdf in it:
            rows = []
            for k, x, y in zip(pdf[key], pdf[a], pdf[b], strict=True):
                x, y = np.asarray(x, float), np.asarray(y, float)
                best = (-2.0, 0)
                for lag in sorted(range(-most, most + 1), key=abs):
                    u, v = (x[lag:], y[: y.size - lag]) if lag >= 0 else (x[: x.size + lag], y[-lag:])
                    n = min(u.size, v.size)
                    if n > 2 and u[:n].std() > 0 and v[:n].std() > 0:
                        r = float(np.corrcoef(u[:n], v[:n])[0, 1])
                        if r > best[0] + 1e-12:
                            best = (r, lag)
                rows.append((k, best[1], best[0]))
            yield pd.DataFrame(rows, columns=[key, "lag", "r"])

    return pairs.mapInPandas(run, f"`{key}` {pairs.schema[key].dataType.simpleString()}, lag int, r double")
