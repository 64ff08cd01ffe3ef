"""Exact ranks and running totals without one-task groups.

A window over (label) or over nothing at all puts a third of the table, or all
of it, in one task. Here every ordered group is first cut into value buckets by
a deterministic monotone function, so

    rank in group = rows in lower buckets + rank inside the bucket

holds exactly. The inner window runs per (group, bucket); the bucket totals are
one small aggregated row each. Both are plain shuffles, nothing is sampled, and
a re-run task recomputes the same buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.hashing import unit
from plumbline.functions.maths import col

UNIT_BUCKETS = 16384
STEPS_PER_OCTAVE = 4096
ID_STEPS = 1 << 20
BEYOND = 1 << 29


def unit_bucket(u, buckets: int = UNIT_BUCKETS) -> Column:
    """Monotone bucket of a value that is uniform on [0, 1)."""
    return F.floor(col(u) * F.lit(float(buckets))).cast("int")


def value_bucket(x, steps: int = STEPS_PER_OCTAVE) -> Column:
    """Monotone bucket of any number: octave by exponent, cut into equal steps.

    Between a half and one it is the distance to one that is cut so, since confident
    scores crowd there. log2 may be off by one next to a power of two. The formula is continuous in
    the exponent, so the bucket order still follows the value order. Values below
    2^-40 in magnitude share the zero bucket. Infinities and NaN have buckets of
    their own beyond the finite ones, NaN last as in a sort; NULL has none.
    """
    whole = col(x).cast("double")
    finite = ~F.isnan(whole) & (F.abs(whole) < F.lit(float("inf")))
    x = F.when(finite, whole)
    tiny, n = 2.0**-40, F.lit(float(steps))
    a = F.abs(x)

    def cut(v: Column) -> tuple[Column, Column]:
        """Octave of a value and its step in it."""
        e = F.floor(F.log2(v))
        return e, F.floor((v / F.pow(F.lit(2.0), e.cast("double")) - F.lit(1.0)) * n)

    octave, step = cut(a)
    below = (octave + F.lit(40.0)) * n + step
    gap, back = cut(F.greatest(F.lit(1.0) - a, F.lit(tiny)))
    near_one = (F.lit(38.0) - gap) * n + (n - F.lit(1.0) - back)
    mag = F.when(a < F.lit(0.5), below).when(a < F.lit(1.0), near_one).otherwise(below + F.lit(40.0) * n)
    mag = F.greatest(mag, F.lit(0.0)) + F.lit(1.0)
    inside = F.when(F.abs(x) < F.lit(tiny), F.lit(0)).otherwise(F.signum(x) * mag).cast("int")
    beyond = F.when(F.isnan(whole), F.lit(2 * BEYOND)).when(whole > 0, F.lit(BEYOND)).otherwise(F.lit(-BEYOND))
    return F.when(finite, inside).when(whole.isNotNull(), beyond)


def id_bucket(x) -> Column:
    """Bucket of row ids and other dense whole numbers: a million steps an octave."""
    return value_bucket(x, ID_STEPS)


def _null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys that may be NULL, keeping one copy of each key column."""
    marked = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    joined = left.join(marked, _null_safe(left, marked, [(k, f"__r_{k}") for k in keys]), how)
    return joined.drop(*[f"__r_{k}" for k in keys])


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    sums: dict[str, Column | str],
    descending: bool = False,
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Inclusive running sums of `sums` per `keys` in `order`, exact over all buckets.

    `bucket` must be monotone in the leading order column. Adds the columns named
    in `sums`, and for `totals` (sum name -> column name) the whole group's sum,
    which rides on the same join. `order` has to be total where the caller needs it.
    """
    totals = totals or {}
    keys = list(keys)
    base = df.withColumn("__b", bucket)
    for name, value in sums.items():
        base = base.withColumn(f"__v_{name}", col(value))
    per_bucket = base.groupBy(*keys, "__b").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    step = F.col("__b").desc() if descending else F.col("__b").asc()
    before = Window.partitionBy(*keys).orderBy(step) if keys else Window.partitionBy(F.lit(0)).orderBy(step)
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offsets = per_bucket.select(
        *keys,
        "__b",
        *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums],
        *[F.sum(f"__t_{n}").over(whole).alias(out) for n, out in totals.items()],
    )
    ordering = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    inside = (
        Window.partitionBy(*keys, "__b").orderBy(*ordering).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = base
    for n in sums:
        local = local.withColumn(f"__l_{n}", F.sum(f"__v_{n}").over(inside))
    out = attach(local, offsets, [*keys, "__b"])
    for n in sums:
        out = out.withColumn(n, F.col(f"__l_{n}") + F.col(f"__o_{n}"))
    return out.drop("__b", *[f"{p}{n}" for n in sums for p in ("__v_", "__l_", "__o_")])


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    name: str = "rn",
    descending: bool = False,
    size: str | None = None,
) -> DataFrame:
    """Exact 1-based row_number per `keys` in `order`; `size` names the group size."""
    return running_totals(
        df, keys, order, bucket, {name: F.lit(1)}, descending, {name: size} if size else None
    )


def shuffled_rank(
    df: DataFrame, keys: Sequence[str], seed, ident: Sequence[str], name: str = "rn", size: str | None = None
) -> DataFrame:
    """Rank rows of each group in the order of their keyed draw (ties by identity)."""
    drawn = df.withColumn("__u", unit(seed, *ident))
    return ranked(drawn, keys, ["__u", *ident], unit_bucket("__u"), name, size=size).drop("__u")
