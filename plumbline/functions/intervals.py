"""Exact binomial (Clopper-Pearson) bounds.

There is no built-in for the inverse incomplete beta, so this is the library's
one vectorised UDF. It is applied to aggregated (k, n) rows only.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

_log_gamma = np.vectorize(math.lgamma, otypes=[float])


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta, modified Lentz, run to convergence."""
    floor = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < floor, floor, d)
    h = d
    limit = int(200 + 20 * np.sqrt(np.max(a + b)))
    for m in range(1, limit):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < floor, floor, d)
            c = 1.0 + term / np.where(np.abs(c) < floor, floor, c)
            step = d * c
            h = h * step
        if np.all(np.abs(step - 1.0) < 1e-14):
            break
    return h


def beta_cdf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    x = np.clip(x, 1e-300, 1.0 - 1e-16)
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(x) + b * np.log1p(-x))
    swap = x >= (a + 1.0) / (a + b + 2.0)
    a1, b1, x1 = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    tail = front * _beta_fraction(a1, b1, x1) / a1
    return np.where(swap, 1.0 - tail, tail)


def _beta_ppf(q: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lo, hi = np.zeros_like(a), np.ones_like(a)
    for _ in range(60):
        mid = 0.5 * (lo + hi)
        under = beta_cdf(a, b, mid) < q
        lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
    return 0.5 * (lo + hi)


def binomial_bounds(k: np.ndarray, n: np.ndarray, alpha: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    k, n = k.astype("float64"), n.astype("float64")
    some = n > 0
    safe_n = np.where(some, n, 1.0)
    inner_lo, inner_hi = some & (k > 0), some & (k < n)
    lo = _beta_ppf(alpha / 2, np.where(inner_lo, k, 1.0), np.where(inner_lo, safe_n - k + 1.0, 1.0))
    hi = _beta_ppf(1 - alpha / 2, np.where(inner_hi, k + 1.0, 1.0), np.where(inner_hi, safe_n - k, 1.0))
    lo, hi = np.where(inner_lo, lo, 0.0), np.where(inner_hi, hi, 1.0)
    return np.where(some, lo, np.nan), np.where(some, hi, np.nan)


def _bounds_series(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    lo, hi = binomial_bounds(k.fillna(0).to_numpy(), n.fillna(0).to_numpy())
    return pd.DataFrame({"lo": lo, "hi": hi})


def clopper_pearson(df: DataFrame, k: str, n: str, prefix: str) -> DataFrame:
    """Add {prefix}_lo, {prefix}_hi to aggregated rows; NULL for n = 0."""
    bounds = F.pandas_udf(_bounds_series, "lo double, hi double")
    out = df.withColumn("__ci", bounds(F.col(k).cast("double"), F.col(n).cast("double")))
    for side in ("lo", "hi"):
        value = F.col(f"__ci.{side}")
        out = out.withColumn(f"{prefix}_{side}", F.when(~F.isnan(value), value))
    return out.drop("__ci")
