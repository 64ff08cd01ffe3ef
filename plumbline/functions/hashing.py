"""Deterministic draws keyed by row identity.

rand() depends on partition layout, so a re-run task or another cluster size
would change a split. Every draw here is a function of (key, seed) only: the
first 8 hex digits of md5(seed|key) over 2^32.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

TWO_32 = float(2**32)


def hex_unit(digits: Column) -> Column:
    """8 hex digits -> uniform double in [0, 1)."""
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / F.lit(TWO_32)


def _as_col(part) -> Column:
    return part if isinstance(part, Column) else F.col(part)


def unit(seed, *key) -> Column:
    """Uniform draw in [0, 1) of the key columns under a seed (text or column)."""
    seed_col = seed if isinstance(seed, Column) else F.lit(str(seed))
    return hex_unit(F.substring(F.md5(F.concat_ws("|", seed_col, *[_as_col(k) for k in key])), 1, 8))


def poisson_cuts(n: int = 10) -> list[float]:
    """P(X <= k), k < n, of a Poisson(1) variable."""
    term, total, cuts = math.exp(-1.0), 0.0, []
    for k in range(n):
        total += term
        cuts.append(total)
        term /= k + 1
    return cuts


def poisson_weight(digits: Column) -> Column:
    """Poisson(1) draw of 8 hex digits by inverse distribution function.

    Fixed-width lower-case hex sorts like the number it spells, so the draw is
    compared as text against each cut and never converted.
    """
    out = F.lit(0)
    for cut in poisson_cuts():
        out = out + (digits >= F.lit(f"{math.ceil(cut * TWO_32):08x}")).cast("int")
    return out


#: Means below this are drawn by inversion, others by rejection.
SMALL_MEAN = 10
#: Proposals of a rejection draw; each is accepted nine times in ten, so all fail once in about 10 ** 8 draws.
PROPOSALS = 8


def poisson_table(mean: int) -> list[float]:
    """P(X <= n), n = 0, 1, ... of a Poisson variable, until 32 bits cannot tell it from one."""
    term, total, cuts = math.exp(-mean), 0.0, []
    while len(cuts) <= mean or term > 2.0**-33:
        total += term
        cuts.append(total)
        term *= mean / len(cuts)
    return cuts


def _proposal(mean: Column, draw_u: Column, draw_v: Column) -> Column:
    """One step of the transformed rejection method of Hoermann (1993): a count, or NULL where it is rejected."""
    b = F.lit(0.931) + F.lit(2.53) * F.sqrt(mean)
    a = F.lit(-0.059) + F.lit(0.02483) * b
    u = draw_u - F.lit(0.5)
    us = F.lit(0.5) - F.abs(u)
    n = F.floor((F.lit(2.0) * a / us + b) * u + mean + F.lit(0.43)).cast("double")
    x = F.greatest(n, F.lit(0.0)) + F.lit(1.0)  # ln n! by Stirling's series
    log_fact = (x - F.lit(0.5)) * F.ln(x) - x + F.lit(0.9189385332046727) + F.lit(1.0) / (F.lit(12.0) * x) - F.lit(1.0) / (F.lit(360.0) * x * x * x)
    inside = (us >= F.lit(0.07)) & (draw_v <= F.lit(0.9277) - F.lit(3.6224) / (b - F.lit(2.0)))
    outside = (n < F.lit(0.0)) | ((us < F.lit(0.013)) & (draw_v > us))
    height = F.ln(draw_v) + F.ln(F.lit(1.1239) + F.lit(1.1328) / (b - F.lit(3.4))) - F.ln(a / (us * us) + b)
    return F.when(inside | (~outside & (height <= n * F.ln(mean) - mean - log_fact)), n)


def poisson_count(mean: Column, seed, *key) -> Column:
    """Poisson draw of a whole-number mean of at least one, a function of (key, seed).

    The sum of the Poisson(1) weights of `mean` rows has this distribution, so equal rows need one draw together. Means below ten
    are inverted from a table; others take the first accepted proposal, two from an md5, at a cost that does not depend on the mean.
    """
    def halves(i: int) -> list[Column]:
        digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[_as_col(k) for k in key], F.lit(str(i))))
        return [hex_unit(F.substring(digest, 1 + 8 * j, 8)) + F.lit(0.5 / TWO_32) for j in range(4)]

    first = halves(0)
    tables = F.array(*[F.array(*[F.lit(c) for c in poisson_table(m)]) for m in range(1, SMALL_MEAN)])
    small = F.size(F.filter(F.element_at(tables, mean.cast("int")), lambda cut: first[0] >= cut)).cast("double")
    as_double = mean.cast("double")
    tries = [_proposal(as_double, u, v) for i in range(PROPOSALS // 2) for u, v in zip(*[iter(halves(i))] * 2)]
    return F.when(mean < SMALL_MEAN, small).otherwise(F.coalesce(*tries, as_double)).cast("long")
