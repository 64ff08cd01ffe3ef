"""Seeded, partition-independent splits and samples.

Membership is decided by a row's keyed draw and its exact rank in the stratum,
so a split is the same on any cluster and after any task retry. Ranks come from
the bucketed ranking, never from one window per stratum.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.hashing import unit
from plumbline.functions.ranking import id_bucket, ranked, running_totals, shuffled_rank, unit_bucket
from plumbline.functions.skew import skew_attach


def calibration_split(
    df: DataFrame, strata: Sequence[str], frac: float = 0.20, seed: int = 7, ident: str = "id"
) -> DataFrame:
    """Add role 'cal' / 'eval': per stratum max(1, round_half_even(n * frac)), 0 if n = 1."""
    r = shuffled_rank(df, strata, seed, [ident], "__rn", "__n")
    n_cal = F.when(
        F.col("__n") > 1, F.greatest(F.lit(1), F.bround(F.col("__n") * F.lit(frac), 0).cast("bigint"))
    ).otherwise(F.lit(0))
    return r.withColumn("role", F.when(F.col("__rn") <= n_cal, "cal").otherwise("eval")).drop("__rn", "__n")


def class_quotas(df: DataFrame, label: str, frac: float, extra: Sequence[str] = ()) -> DataFrame:
    """Rows per class of a stratified test set of ceil(frac * n): largest remainder, smaller label first."""
    counts = df.groupBy(*extra, label).agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*extra) if extra else Window.partitionBy(F.lit(0))
    total = F.sum("__n").over(whole)
    share = F.ceil(total * F.lit(frac)) * F.col("__n") / total
    parts = (
        counts.withColumn("__size", F.ceil(total * F.lit(frac)))
        .withColumn("__base", F.floor(share))
        .withColumn("__rest", share - F.floor(share))
    )
    turn = F.row_number().over(whole.orderBy(F.col("__rest").desc(), F.col(label)))
    short = F.col("__size") - F.sum("__base").over(whole)
    quota = (F.col("__base") + (turn <= short).cast("bigint")).alias("__quota")
    return parts.select(*extra, label, quota, F.col("__n").alias("__rows"))


def stratified_split(
    df: DataFrame, label: str = "label", test_frac: float = 0.2, seed: int | str = 7, ident: str = "id"
) -> DataFrame:
    """Add role 'test' / 'train' with the class shares kept."""
    r = shuffled_rank(df, [label], seed, [ident], "__rn")
    out = skew_attach(r, class_quotas(df, label, test_frac), label, [ident], "__rows")
    return out.withColumn("role", F.when(F.col("__rn") <= F.col("__quota"), "test").otherwise("train")).drop(
        "__rn", "__quota"
    )


def nested_doses(
    pool: DataFrame, doses: Sequence[int | None], label: str = "label", seed: int = 7, ident: str = "id"
) -> DataFrame:
    """Long (dose, row) table; each dose is a prefix of one per-class order, so larger contains smaller.

    A dose of None takes the whole pool and is named 'ALL'.
    """
    sizes = pool.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col(label) == 1).cast("bigint")), F.lit(0)).alias("pos")
    )
    r = (
        shuffled_rank(pool, [label], seed, [ident], "__rn", "__size")
        .withColumn("__all", sizes.select("n").scalar())
        .withColumn("__pos", sizes.select("pos").scalar())
    )
    taken = []
    for dose in doses:
        if dose is None:
            taken.append(F.lit("ALL"))
            continue
        npos = F.least(
            F.bround(F.lit(float(dose)) * (F.col("__pos") / F.col("__all")), 0).cast("bigint"), F.col("__pos")
        )
        quota = F.when(F.col(label) == 1, npos).otherwise(F.least(F.lit(dose) - npos, F.col("__size")))
        taken.append(F.when(F.col("__rn") <= quota, F.lit(str(dose))))
    return r.withColumn("dose", F.explode(F.array_compact(F.array(*taken)))).drop("__rn", "__size", "__all", "__pos")


def two_class_sources(df: DataFrame, source: str = "source", label: str = "label") -> DataFrame:
    """Sources that hold both classes; the others are skipped as test folds."""
    return df.groupBy(source).agg(F.min(label).alias("__lo"), F.max(label).alias("__hi")).filter(
        (F.col("__lo") == 0) & (F.col("__hi") == 1)
    ).select(source)


def lodo_folds(
    df: DataFrame, source: str = "source", label: str = "label", group: str = "grp", ident: str = "id"
) -> DataFrame:
    """Leave-one-source-out as a long (fold, row, role) table.

    role is 'test' for the fold's own rows, 'train' for the rest and 'leak' for
    train rows whose group (>= 0) also has a member in the fold. A group's
    sources travel as one array, so no pair of rows is ever formed.
    """
    folds = two_class_sources(df, source, label).agg(F.array_sort(F.collect_set(source)).alias("f"))
    members = df.filter(F.col(group) >= 0).groupBy(group).agg(
        F.collect_set(source).alias("__sources"), F.count(F.lit(1)).alias("__rows")
    )
    tagged = skew_attach(df, members, group, [ident], "__rows", "left")
    each = tagged.withColumn("fold", F.explode(folds.scalar()))
    role = (
        F.when(F.col(source) == F.col("fold"), "test")
        .when(F.coalesce(F.array_contains("__sources", F.col("fold")), F.lit(False)), "leak")
        .otherwise("train")
    )
    return each.withColumn("role", role).drop("__sources")


def leak_guard(train: DataFrame, held_out: DataFrame, group: str = "grp") -> DataFrame:
    """Drop train rows whose group (>= 0) also appears in the held-out set; group < 0 never matches."""
    seen = held_out.filter(F.col(group) >= 0).select(F.col(group).alias("__g")).distinct()
    return train.join(seen, train[group] == seen["__g"], "left_anti")


def stratified_kfold(df: DataFrame, k: int, label: str = "label", seed: int = 7, ident: str = "id") -> DataFrame:
    r = shuffled_rank(df, [label], seed, [ident], "__rn")
    return r.withColumn("fold", ((F.col("__rn") - 1) % k).cast("int")).drop("__rn")


def stratified_group_kfold(
    df: DataFrame, k: int, label: str = "label", group: str = "grp", seed: int = 7, ident: str = "id",
    within: Sequence[str] = (),
) -> DataFrame:
    """No group spans folds: groups are dealt round-robin within their majority-label stratum.

    `within` adds columns that are constant inside a group to the stratum, so every
    source gets its own k folds in one pass.
    """
    groups = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("__rows"), F.avg(label).alias("__share"), *[F.min(c).alias(c) for c in within]
    )
    groups = groups.withColumn("__major", (F.col("__share") >= 0.5).cast("int"))
    dealt = shuffled_rank(groups, [*within, "__major"], seed, [group], "__rn").select(
        group, "__rows", ((F.col("__rn") - 1) % k).cast("int").alias("fold")
    )
    return skew_attach(df, dealt, group, [ident], "__rows")


def grouped_half_split(df: DataFrame, group: str = "grp", seed: int = 0, ident: str = "id") -> DataFrame:
    """First half of the distinct groups, in draw order, is 'a', the rest 'b'."""
    groups = df.groupBy(group).agg(F.count(F.lit(1)).alias("__rows"))
    r = shuffled_rank(groups, [], seed, [group], "__rn", "__n")
    half = F.when(F.col("__rn") <= F.floor(F.col("__n") / 2), "a").otherwise("b").alias("half")
    return skew_attach(df, r.select(group, "__rows", half), group, [ident], "__rows")


def parity_split(df: DataFrame, label: str = "label", order: str = "id") -> DataFrame:
    """Within each class, even position -> CAL, odd -> TST."""
    r = ranked(df, [label], [order], id_bucket(order), "__rn")
    return r.withColumn("half", F.when((F.col("__rn") - 1) % 2 == 0, "CAL").otherwise("TST")).drop("__rn")


def sample_per_class(
    df: DataFrame, stratum: str, quotas: Mapping[object, int], seed: int | str = 7, ident: Sequence[str] = ("id",)
) -> DataFrame:
    """Fixed number of rows per stratum, drawn without replacement; unlisted strata give none."""
    listed = df.filter(F.col(stratum).isin(list(quotas)))
    quota: Column = F.lit(0)
    for value, k in quotas.items():
        quota = F.when(F.col(stratum) == F.lit(value), F.lit(k)).otherwise(quota)
    return shuffled_rank(listed, [stratum], seed, list(ident), "__rn").filter(F.col("__rn") <= quota).drop("__rn")


def cap_per_stratum(df: DataFrame, strata: Sequence[str], cap: int, seed: int | str = 7, ident: str = "id") -> DataFrame:
    return shuffled_rank(df, strata, seed, [ident], "__rn").filter(F.col("__rn") <= cap).drop("__rn")


def recal_splits(
    df: DataFrame, keys: Sequence[str], n_splits: int = 20, cal_frac: float = 0.2, label: str = "label",
    ident: str = "id", seed: int = 7,
) -> DataFrame:
    """n_splits stratified cal/eval splits as a dimension; each split has its own draw.

    Rows are spread over `split` before ranking, so strata are (keys, split, class).
    Cal holds n - ceil((1 - cal_frac) n) rows per stratum.
    """
    each = df.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    drawn = each.withColumn("__u", unit(seed, "split", ident))
    r = ranked(drawn, [*keys, "split", label], ["__u", ident], unit_bucket("__u"), "__rn", size="__n")
    n_eval = F.ceil(F.col("__n") * F.lit(1.0 - cal_frac))
    return r.withColumn("role", F.when(F.col("__rn") <= n_eval, "eval").otherwise("cal")).drop("__rn", "__n", "__u")


def permute_labels(df: DataFrame, perm: int, label: str = "label", ident: str = "id") -> DataFrame:
    """Seeded global permutation: the i-th row of one draw order takes the i-th label of another."""
    rows = shuffled_rank(df, [], f"row{perm}", [ident], "__i")
    labels = shuffled_rank(df.select(ident, label), [], f"lab{perm}", [ident], "__i").select(
        "__i", F.col(label).alias("permuted")
    )
    return rows.join(labels, "__i").drop("__i")


def oof_coverage(expected: DataFrame, folds: DataFrame, ident: str = "id") -> DataFrame:
    """Out-of-fold assembly check: every expected row scored exactly once."""
    want = expected.select(ident, F.lit(1).alias("w"), F.lit(0).alias("g"))
    got = folds.select(ident, F.lit(0).alias("w"), F.lit(1).alias("g"))
    per = want.unionByName(got).groupBy(ident).agg(F.sum("w").alias("w"), F.sum("g").alias("g"))
    return per.agg(
        F.coalesce(F.sum("w"), F.lit(0)).alias("n_expected"),
        F.count_if((F.col("w") > 0) & (F.col("g") == 0)).alias("n_missing"),
        F.count_if(F.col("g") > 1).alias("n_repeated"),
        F.count_if((F.col("w") == 0) & (F.col("g") > 0)).alias("n_foreign"),
    ).withColumn(
        "complete", (F.col("n_missing") == 0) & (F.col("n_repeated") == 0) & (F.col("n_foreign") == 0)
    )


def random_baseline_scores(cells: DataFrame, seed: int | str = 7, ident: Sequence[str] = ("id", "pos")) -> DataFrame:
    """Uniform score per cell as a floor for localisation."""
    return cells.withColumn("random", unit(seed, *ident))


def disjoint(pool: DataFrame, test: DataFrame, ident: str = "id") -> DataFrame:
    """One row: number of shared ids and whether the sets are disjoint."""
    both = pool.select(ident).intersect(test.select(ident))
    return both.agg(F.count(F.lit(1)).alias("n_shared")).withColumn("disjoint", F.col("n_shared") == 0)


def fresh_groups(base: DataFrame, added: DataFrame, group: str = "grp", ident: str = "id") -> DataFrame:
    """Append rows under group ids past the existing maximum, one new group per added row."""
    top = base.agg(F.coalesce(F.max(group), F.lit(-1)).alias("m"))
    numbered = running_totals(added, [], [ident], id_bucket(ident), {"__rn": F.lit(1)})
    renamed = numbered.withColumn(group, (F.col("__rn") + top.scalar()).cast("bigint")).drop("__rn")
    return base.unionByName(renamed, allowMissingColumns=True)
