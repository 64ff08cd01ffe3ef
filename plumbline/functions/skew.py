"""Joins of a big table to a one-row-per-key table when one key may be huge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

ROWS_PER_TASK = 1_000_000


def skew_attach(
    left: DataFrame,
    right: DataFrame,
    key: str | Sequence[str],
    ident: Sequence[str],
    count: str,
    how: str = "inner",
    rows_per_task: int = ROWS_PER_TASK,
    nulls: bool = True,
) -> DataFrame:
    """Join `right` (one row per key, `count` = rows of the key in `left`) to `left`.

    Keys above `rows_per_task` are spread: their right row is repeated once per
    salt and their left rows draw a salt from their identity. The list of such
    keys has at most rows(left) / rows_per_task entries, since each stands for more
    than rows_per_task rows; Spark broadcasts it, or not, by its measured size. All other keys join unsalted.
    Key columns may be NULL unless `nulls` is false; then equality is plain, which
    Spark plans much faster. `right` is read twice, so a caller whose `right` has a
    long plan settles it first. `count` is dropped from the result.
    """
    keys = [key] if isinstance(key, str) else list(key)
    salts = (F.floor(F.col(count) / F.lit(rows_per_task)) + 1).cast("int")
    hot = right.filter(F.col(count) > F.lit(rows_per_task)).select(
        *[F.col(k).alias(f"__hot_{k}") for k in keys], salts.alias("__salts")
    )
    same = (lambda a, b: a.eqNullSafe(b)) if nulls else (lambda a, b: a == b)
    same_hot, same_key = F.lit(True), F.lit(True)
    for k in keys:
        same_hot = same_hot & same(left[k], hot[f"__hot_{k}"])
    spread = left.join(hot, same_hot, "left").withColumn(
        "__salt", F.pmod(F.xxhash64(*ident), F.coalesce("__salts", F.lit(1))).cast("int")
    )
    repeated = right.withColumn("__salt_r", F.explode(F.sequence(F.lit(0), salts - 1)))
    for k in keys:
        repeated = repeated.withColumnRenamed(k, f"__key_{k}")
        same_key = same_key & same(spread[k], repeated[f"__key_{k}"])
    out = spread.join(repeated, same_key & (spread["__salt"] == repeated["__salt_r"]), how)
    return out.drop("__salts", "__salt", "__salt_r", count, *[f"__hot_{k}" for k in keys], *[f"__key_{k}" for k in keys])
