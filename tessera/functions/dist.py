"""Distribution functions as Arrow-batched column functions: normal, t, F, beta and gamma.

Spark has no tail areas, so these are numpy kernels over whole batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

# fixed values: the Lanczos coefficients (g = 7, n = 9)
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def ln_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0."""
    x = np.asarray(x, float) - 1
    a = np.full_like(x, _LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        a = a + c / (x + i)
    t = x + 7.5
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * np.log(t) - t + np.log(a)


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    x = np.clip(x, 0, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h *= c * d
        if np.nanmax(np.abs(c * d - 1), initial=0) < 1e-15:
            break
    out = np.where((x <= 0) | np.isnan(front), 0.0, front * h)
    return np.where(flip, 1 - out, out)


def gamma_inc(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised lower incomplete gamma function."""
    a, x = (np.array(v, float) for v in np.broadcast_arrays(a, x))
    out = np.zeros_like(x)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.exp(-x + a * np.log(x) - ln_gamma(a))
        term = 1 / a
        total = term.copy()
        for n in range(1, 1000):
            term = term * x / (a + n)
            total += term
            if np.nanmax(term / total, initial=0) < 1e-16:
                break
        low = front * total
        tiny = 1e-300
        b = x + 1 - a
        c = np.full_like(x, 1 / tiny)
        d = 1 / np.where(b == 0, tiny, b)
        h = d.copy()
        for i in range(1, 1000):
            an = -i * (i - a)
            b = b + 2
            d = 1 / np.where(np.abs(an * d + b) < tiny, tiny, an * d + b)
            c = b + an / c
            h *= d * c
            if np.nanmax(np.abs(d * c - 1), initial=0) < 1e-15:
                break
        high = 1 - front * h
    out = np.where(x < a + 1, low, high)
    return np.where(x <= 0, 0.0, out)


def t_cdf_np(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return np.where(t > 0, 1 - tail, tail)


def t_upper_np(t, df):
    """P(T > t), exact far out in the tail."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return np.where(t > 0, tail, 1 - tail)


def t_inv_np(p, df):
    """The quantile of the t distribution, by bisection."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    lo, hi = np.full(p.shape, -1e3), np.full(p.shape, 1e3)
    for _ in range(80):
        mid = (lo + hi) / 2
        below = t_cdf_np(mid, df) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def f_upper_np(f, d1, d2):
    f = np.maximum(np.asarray(f, float), 0)
    return beta_inc(np.asarray(d2, float) / 2, np.asarray(d1, float) / 2, d2 / (d2 + d1 * f))


_erfc = np.vectorize(math.erfc, otypes=[float])


@pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return pd.Series(0.5 * _erfc(-x.to_numpy(float) / math.sqrt(2)), index=x.index)


@pandas_udf(DoubleType())
def t_cdf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_cdf_np(t, df), index=t.index)


@pandas_udf(DoubleType())
def t_two_tailed(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(2 * t_upper_np(np.abs(t), df), index=t.index)


@pandas_udf(DoubleType())
def t_inv(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_inv_np(p, df), index=p.index)


@pandas_udf(DoubleType())
def f_upper(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_upper_np(f, d1.to_numpy(float), d2.to_numpy(float)), index=f.index)


@pandas_udf(DoubleType())
def beta_cdf(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(beta_inc(a, b, x), index=x.index)


@pandas_udf(DoubleType())
def gamma_cdf(x: pd.Series, h: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series(gamma_inc(h, x * rate), index=x.index)


@pandas_udf(DoubleType())
def gamma_pdf(x: pd.Series, h: pd.Series, rate: pd.Series) -> pd.Series:
    with np.errstate(divide="ignore", invalid="ignore"):
        v = np.exp(h * np.log(rate) + (h - 1) * np.log(x) - rate * x - ln_gamma(h))
    return pd.Series(np.where(x > 0, v, 0.0), index=x.index)


@pandas_udf(DoubleType())
def map_p(v: pd.Series, kind: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Signed two-tailed p of a statistic: kind 1 t, 2 r, 4 F, 12 z."""
    v, kind, d1, d2 = (x.to_numpy(float) for x in (v, kind, d1, d2))
    with np.errstate(all="ignore"):
        t = np.where(kind == 2, v * np.sqrt(d1 / np.maximum(1 - v * v, 1e-300)), v)
        p = np.where(kind == 4, f_upper_np(v, d1, d2), np.where(kind == 12, _erfc(np.abs(v) / math.sqrt(2)), 2 * t_upper_np(np.abs(t), np.maximum(d1, 1e-9))))
    return pd.Series(np.where((v < 0) & (kind != 4), -p, p))
