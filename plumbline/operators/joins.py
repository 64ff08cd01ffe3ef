"""Join operators that are more than one call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def alignment_join(features: DataFrame, scores: DataFrame, key: str = "id", columns: Sequence[str] = ("label", "source")) -> DataFrame:
    """One row of mismatch counts between two tables that must agree on `columns` per key.

    Both sides are tagged, unioned and grouped: one shuffle of narrow rows, no
    full outer join.
    """
    tagged = features.select(key, F.lit(0).alias("__side"), *columns).unionByName(
        scores.select(key, F.lit(1).alias("__side"), *columns)
    )
    left, right = F.col("__side") == 0, F.col("__side") == 1
    per = tagged.groupBy(key).agg(
        F.count_if(left).alias("l"),
        F.count_if(right).alias("r"),
        *[
            (
                ~F.max(F.when(left, F.col(c))).eqNullSafe(F.max(F.when(right, F.col(c))))
                | ~F.min(F.when(left, F.col(c))).eqNullSafe(F.min(F.when(right, F.col(c))))
            ).alias(f"__d_{c}")
            for c in columns
        ],
    )
    both = (F.col("l") > 0) & (F.col("r") > 0)
    return per.agg(
        F.count_if(both).alias("n_matched"),
        F.count_if(F.col("r") == 0).alias("n_only_features"),
        F.count_if(F.col("l") == 0).alias("n_only_scores"),
        F.count_if((F.col("l") > 1) | (F.col("r") > 1)).alias("n_repeated"),
        *[F.count_if(both & F.col(f"__d_{c}")).alias(f"n_{c}_differs") for c in columns],
    )


def assert_aligned(features: DataFrame, scores: DataFrame, key: str = "id", columns: Sequence[str] = ("label", "source")) -> None:
    row = alignment_join(features, scores, key, columns).first().asDict()
    bad = {k: v for k, v in row.items() if k != "n_matched" and v}
    if bad:
        raise ValueError(f"score table does not align with features: {bad}")


def paired_scores(a: DataFrame, b: DataFrame, key: str = "id", score: str = "logit") -> DataFrame:
    """Both configurations' scores on the same evaluation rows."""
    return a.join(b.select(key, F.col(score).alias(f"{score}_b")), key)


def with_params(df: DataFrame, params: DataFrame) -> DataFrame:
    """Apply a one-row parameter table to every row through scalar subqueries.

    A second parameter row makes the query fail instead of multiplying rows.
    """
    for name in params.columns:
        df = df.withColumn(name, params.select(name).scalar())
    return df
