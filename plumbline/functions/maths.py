"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPS_RECORD = 1e-6  # probability clamp of the record-side calibration
EPS_FIT = 1e-7  # probability clip of the fitting side
MIN_TEMPERATURE = 1e-3
WILSON_Z = 1.959963984540054


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def clamp(x, lo: float, hi: float) -> Column:
    """Value held in [lo, hi]; NULL stays NULL (greatest and least skip NULL)."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x)))


def clamp_prob(p, eps: float = EPS_RECORD) -> Column:
    return clamp(p, eps, 1.0 - eps)


def sigmoid(z) -> Column:
    """Stable on both tails: exp is only taken of a non-positive number."""
    z = col(z)
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, F.lit(1.0) / (F.lit(1.0) + e)).otherwise(e / (F.lit(1.0) + e))


def logit(p, eps: float = EPS_RECORD) -> Column:
    pc = clamp_prob(p, eps)
    return F.ln(pc / (F.lit(1.0) - pc))


def tempered(z, t) -> Column:
    """sigmoid(z / max(T, 1e-3))."""
    t = t if isinstance(t, Column) else F.lit(float(t))
    return sigmoid(col(z) / F.greatest(t, F.lit(MIN_TEMPERATURE)))


def binary_nll(y, p, eps: float = EPS_FIT) -> Column:
    y, pc = col(y), clamp(p, eps, 1.0 - eps)
    return -(y * F.ln(pc) + (F.lit(1.0) - y) * F.ln(F.lit(1.0) - pc))


def softplus(x) -> Column:
    x = col(x)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def ratio(num, den) -> Column:
    """num / den, NULL where den is 0: undefined metrics are NULL here, not NaN."""
    den = col(den)
    return F.when(den != 0, col(num).cast("double") / den.cast("double"))


def floored_ratio(num, den) -> Column:
    """num / max(den, 1)."""
    return col(num).cast("double") / F.greatest(col(den), F.lit(1)).cast("double")


def half_even(x) -> Column:
    """Round half to even to an integer; x is at most a few decimals wide."""
    return F.bround(col(x), 0).cast("bigint")


def half_up(x) -> Column:
    return F.floor(col(x) + F.lit(0.5)).cast("bigint")


def wilson(k, n) -> tuple[Column, Column]:
    """Wilson score interval of k successes in n; NULL for n = 0."""
    k, n = col(k).cast("double"), col(n).cast("double")
    z2 = WILSON_Z * WILSON_Z
    p = k / n
    den = 1.0 + F.lit(z2) / n
    mid = (p + F.lit(z2) / (2.0 * n)) / den
    half = F.lit(WILSON_Z) * F.sqrt(p * (1.0 - p) / n + F.lit(z2) / (4.0 * n * n)) / den
    some = n > 0
    return (F.when(some, F.greatest(F.lit(0.0), mid - half)), F.when(some, F.least(F.lit(1.0), mid + half)))


def linspace_edges(bins: int = 10) -> list[float]:
    """Edges as floating multiples of 1/bins, the way a linspace lays them out."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def edge_bin(p, edges: list[float]) -> Column:
    """Half-open bin index on literal edges, last bin closed; NULL outside."""
    p = col(p)
    n = len(edges) - 1
    out = F.when((p >= F.lit(edges[n - 1])) & (p <= F.lit(edges[n])), F.lit(n - 1))
    for i in range(n - 2, -1, -1):
        out = F.when((p >= F.lit(edges[i])) & (p < F.lit(edges[i + 1])), F.lit(i)).otherwise(out)
    return out
