"""Matrices in array columns (row by row), as Arrow-batched functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType


def _square(a: np.ndarray) -> np.ndarray:
    """Rows of an array as square matrices."""
    n = int(round(a.shape[1] ** 0.5))
    if n * n != a.shape[1]:
        raise ValueError("not a square matrix")
    return a.reshape(-1, n, n)


def _alike(f: Callable, *columns: pd.Series, by: pd.Series | None = None) -> pd.Series:
    """``f`` of the matrices' values, once for all rows whose matrices have equal sizes (and equal ``by``, its last argument); rows with a null give null."""
    out = np.full(len(columns[0]), None, object)
    places: dict[tuple, list[int]] = {}
    for i, v in enumerate(zip(*columns, strict=True)):
        if all(x is not None for x in v):
            places.setdefault((*map(len, v), *([] if by is None else [int(by.iloc[i])])), []).append(i)
    for sizes, rows in places.items():
        got = f(*[np.array([c.iat[i] for i in rows], float).reshape(len(rows), -1) for c in columns], *sizes[len(columns) :])
        for i, x in zip(rows, got.reshape(len(rows), -1) if got.ndim > 1 else got, strict=True):
            out[i] = x
    return pd.Series(out)


@pandas_udf(ArrayType(DoubleType()))
def inverse(m: pd.Series) -> pd.Series:
    """The (pseudo-)inverse; null stays null."""

    def some(v):
        a = _square(v)
        if a.shape[1] != 2:
            return np.linalg.pinv(a)
        det = a[:, 0, 0] * a[:, 1, 1] - a[:, 0, 1] * a[:, 1, 0]
        size = (a * a).sum(axis=(1, 2))
        largest = (size + np.sqrt(np.maximum(size * size - 4 * det * det, 0))) / 2  # the square of the larger singular value
        out = np.stack([a[:, 1, 1], -a[:, 0, 1], -a[:, 1, 0], a[:, 0, 0]], axis=1)
        flat = ~(np.abs(det) > 1e-15 * largest)
        out /= np.where(flat, 1.0, det)[:, None]
        if flat.any():
            out[flat] = np.linalg.pinv(a[flat]).reshape(-1, 4)
        return out

    return _alike(some, m)


@pandas_udf(ArrayType(DoubleType()))
def product(a: pd.Series, b: pd.Series) -> pd.Series:
    return _alike(lambda x, y: _square(x) @ _square(y), a, b)


@pandas_udf(ArrayType(DoubleType()))
def gram(a: pd.Series, rows: pd.Series) -> pd.Series:
    """A'A of a matrix with that number of rows."""

    def some(v, n):
        x = v.reshape(len(v), n, -1)
        return x.transpose(0, 2, 1) @ x

    return _alike(some, a, by=rows)


@pandas_udf(ArrayType(DoubleType()))
def square_root(m: pd.Series) -> pd.Series:
    """The root of a symmetric matrix without negative eigenvalues."""

    def some(v):
        w, q = np.linalg.eigh(_square(v))
        return (q * np.sqrt(np.maximum(w, 0))[:, None, :]) @ q.transpose(0, 2, 1)

    return _alike(some, m)


@pandas_udf(DoubleType())
def determinant(m: pd.Series) -> pd.Series:
    return _alike(lambda a: np.linalg.det(_square(a)), m).astype(float)


@pandas_udf(DoubleType())
def anisotropy(m: pd.Series) -> pd.Series:
    """Fractional anisotropy of a symmetric 3 x 3 tensor; 0 for the zero tensor."""

    def some(v):
        w = np.linalg.eigvalsh(_square(v))
        size = (w * w).sum(axis=1)
        return np.sqrt(1.5 * ((w - w.mean(axis=1, keepdims=True)) ** 2).sum(axis=1) / np.where(size > 0, size, np.inf))

    return _alike(some, m).astype(float)
