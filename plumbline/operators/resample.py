"""Bootstraps, permutation checks and source-reliance statistics.

Replicates are Poisson(1) weights keyed by (row or group, replicate). Rows are
exchanged by score bucket, once for each 200 replicates, and weighted in matrices
inside the task (`functions/replicates.py`), so the replicate dimension never
crosses the network. What leaves a bucket is one partial row per replicate.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plumbline.functions import replicates as R
from plumbline.functions.hashing import poisson_count
from plumbline.functions.intervals import clopper_pearson
from plumbline.functions.maths import ratio
from plumbline.functions.ranking import attach, running_totals, value_bucket
from plumbline.functions.skew import skew_attach
from plumbline.operators import metrics as M
from plumbline.operators import splits as S
from plumbline.session import settle

#: Rows of a score bucket whose replicates one group of work takes whole.
ROWS_PER_SHARE = 4_096
#: Score buckets per octave of a replicated rank metric: each returns a row per replicate, so fewer than for plain ranks.
REPLICATE_STEPS = 4


def _schema(df: DataFrame, keys: Sequence[str], more: str) -> T.StructType:
    """Types of the key columns, then those of `more`."""
    return T.StructType([*[df.schema[k] for k in keys], *T.StructType.fromDDL(more)])


def _task_count(df: DataFrame) -> int:
    """Tasks of a step whose rows are few bytes and much work, so their number must not follow the bytes."""
    spark = df.sparkSession
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _drawn_rows(df: DataFrame, keys: Sequence[str], score: str, label: str, seed, draw_keys: Sequence[str], copies: str | None) -> DataFrame:
    """Rows (keys, name of the draws, score, y, k, score bucket) of a replicated rank metric. NULL and NaN scores are left out."""
    name = F.concat_ws("|", F.lit(str(seed)), *draw_keys).alias("name")
    k = F.lit(1).cast("bigint") if copies is None else F.col(copies).cast("bigint")
    y = F.coalesce(F.col(label) == 1, F.lit(False)).alias("y")
    rows = df.select(*keys, name, F.col(score).cast("double").alias("score"), y, k.alias("k"))
    return rows.filter(F.col("score").isNotNull() & ~F.isnan("score")).withColumn("__b", value_bucket("score", REPLICATE_STEPS))


def _by_slice(rows: DataFrame, keys: Sequence[str], n_boot: int):
    """Rows grouped by (keys, bucket, slice of replicates): each row once a slice, a slice being 200 replicates."""
    dims = [*keys, "__b", "__s"]
    each = rows.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(R.slices(n_boot) - 1))))
    return dims, each.repartition(_task_count(rows), *dims).groupBy(*dims)


def _by_bucket(rows: DataFrame, keys: Sequence[str], n_boot: int):
    """Rows grouped by (keys, bucket, share of the replicates): a bucket crosses once for each ROWS_PER_SHARE of its rows, up to once a slice."""
    dims = [*keys, "__b"]
    share = F.least(F.lit(R.slices(n_boot)), (F.floor(F.count(F.lit(1)) / ROWS_PER_SHARE) + 1)).cast("int")
    sized = attach(rows, rows.groupBy(*dims).agg(share.alias("__shares")), dims)
    each = sized.withColumn("__s", F.explode(F.sequence(F.lit(0), F.col("__shares") - 1)))
    dims = [*dims, "__shares", "__s"]
    return dims, each.repartition(_task_count(rows), *dims).groupBy(*dims)


def _with_keys(key: tuple, names: Sequence[str], out: pd.DataFrame) -> pd.DataFrame:
    """`out` with the key's values before its columns."""
    head = pd.DataFrame({n: pd.Series([v] * len(out), dtype="object", index=out.index) for n, v in zip(names, key)}, index=out.index)
    return pd.concat([head, out], axis=1)


def replicate_sums(
    df: DataFrame, keys: Sequence[str], values: dict[str, Column], n_boot: int, seed, draw_keys: Sequence[str]
) -> DataFrame:
    """(keys, rep, w, one weighted sum per value) of every replicate; a batch of rows leaves one row per key and replicate."""
    name = F.concat_ws("|", F.lit(str(seed)), *draw_keys).alias("name")
    rows = df.select(*keys, name, *[v.cast("double").alias(n) for n, v in values.items()])
    rows = rows.repartition(_task_count(df), "name")
    rows = rows.sortWithinPartitions(*keys) if keys else rows
    schema = _schema(df, keys, ", ".join(["rep int", "w double", *[f"{n} double" for n in values]]))
    keys, names = list(keys), list(values)

    def sums(batches):
        for batch in batches:
            for _, part in batch.groupby(keys, dropna=False, sort=False) if keys else [((), batch)]:
                out = R.value_sums(part, names, n_boot)[["rep", "w", *names]]
                yield _with_keys(tuple(part[k].iloc[0] for k in keys), keys, out.reset_index(drop=True))

    each = rows.mapInPandas(sums, schema).filter((F.col("w") > 0) & (F.col("rep") < n_boot))
    return each.groupBy(*keys, "rep").agg(*[F.sum(c).alias(c) for c in ("w", *names)])


def interval(df: DataFrame, keys: Sequence[str], value: str, prefix: str, level: float = 0.95) -> list[Column]:
    """2.5 % and 97.5 % points over replicates; a group has at most n_boot rows."""
    tail = (1.0 - level) / 2.0
    return [
        F.percentile(value, F.lit(tail)).alias(f"{prefix}_lo"),
        F.percentile(value, F.lit(1.0 - tail)).alias(f"{prefix}_hi"),
    ]


def replicate_auc(
    df: DataFrame, keys: Sequence[str], score: str, label: str, n_boot: int, seed, draw_keys: Sequence[str], name: str = "auc",
) -> DataFrame:
    """(keys, rep, auc): weighted AUC of every replicate, NULL for a single-class one.

    A task takes the rows of a score bucket, for all replicates or, if they are many, for a share of them; one row per replicate leaves it.
    """
    rows, keys = _drawn_rows(df, keys, score, label, seed, draw_keys, None), list(keys)
    dims, grouped = _by_bucket(rows, keys, n_boot)
    n_slices = R.slices(n_boot)

    def part(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        shares, share = int(key[-2]), int(key[-1])
        first, end = (n_slices * s // shares for s in (share, share + 1))
        return _with_keys(key[:-2], dims[:-2], R.auc_part(group, first, end - first))

    parts = grouped.applyInPandas(part, _schema(rows, [*keys, "__b"], "rep int, part double, n_pos bigint, n_neg bigint"))
    return M.combine_auc_parts(parts.filter(F.col("rep") < n_boot), [*keys, "rep"], name=name).select(*keys, "rep", name)


def bootstrap_auc_ci(
    df: DataFrame, keys: Sequence[str], score: str = "logit", label: str = "label", n_boot: int = 2000, seed=11,
    ident: str = "id",
) -> DataFrame:
    """AUC with its row-bootstrap interval; single-class replicates are skipped."""
    reps = replicate_auc(df, keys, score, label, n_boot, seed, [ident])
    ci = reps.filter(F.col("auc").isNotNull()).groupBy(*keys).agg(*interval(reps, keys, "auc", "auc"))
    point = M.auc(df, keys, score, label)
    return attach(point, ci, keys, "left") if keys else point.join(ci, how="left")


def replicate_roc(
    df: DataFrame, score: str, label: str, n_boot: int, seed, draw_keys: Sequence[str], fpr_max: float, spec: float
) -> DataFrame:
    """(rep, auc, pauc, sens_at_spec) of every replicate with both classes.

    Two passes over the rows by score bucket: class totals of the buckets, then the curve inside each, which starts where the
    higher buckets end. Between them lies one row per bucket and replicate, whatever the number of rows.
    """
    keys = [*draw_keys, F.col(score).cast("double").alias("score"), F.col(label).alias("label")]
    cells = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))
    rows = _drawn_rows(cells, [], "score", "label", seed, draw_keys, "k")
    dims, grouped = _by_slice(rows, [], n_boot)

    def totals(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return _with_keys(key, dims, R.auc_part(group, int(key[-1]))[["rep", "n_pos", "n_neg"]])

    parts = grouped.applyInPandas(totals, "__b int, __s int, rep int, n_pos bigint, n_neg bigint")
    whole = Window.partitionBy("rep")
    higher = whole.orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(
        "__b", "__s", "rep",
        F.coalesce(F.sum("n_pos").over(higher), F.lit(0)).alias("tp"), F.coalesce(F.sum("n_neg").over(higher), F.lit(0)).alias("fp"),
        F.sum("n_pos").over(whole).alias("all_pos"), F.sum("n_neg").over(whole).alias("all_neg"),
    )

    def curve(key: tuple, group: pd.DataFrame, offsets: pd.DataFrame) -> pd.DataFrame:
        return R.roc_part(group, offsets, int(key[-1]), fpr_max, 1.0 - spec)

    starts = before.repartition(_task_count(rows), *dims).groupBy(*dims)
    steps = grouped.cogroup(starts).applyInPandas(
        curve, "rep int, won double, area double, sens double, all_pos bigint, all_neg bigint"
    )
    low = 0.5 * fpr_max * fpr_max
    found = F.max(F.when(~F.isnan("sens"), F.col("sens")))
    return steps.filter(F.col("rep") < n_boot).groupBy("rep").agg(
        ratio(F.sum("won"), F.max("all_pos").cast("double") * F.max("all_neg")).alias("auc"),
        (F.lit(0.5) * (F.lit(1.0) + (F.sum("area") - low) / (fpr_max - low))).alias("pauc"),
        F.coalesce(found, F.lit(1.0)).alias("sens_at_spec"),
    )


def group_bootstrap(
    df: DataFrame, group: str = "grp", score: str = "logit", label: str = "label", n_boot: int = 2000, seed=11,
    fpr_max: float = 0.2, spec: float = 0.7,
) -> DataFrame:
    """Resample groups: AUC, partial AUC and sens@spec with intervals and the group count."""
    both = replicate_roc(df, score, label, n_boot, seed, [group], fpr_max, spec)
    ci = both.filter(F.col("auc").isNotNull()).agg(
        *interval(both, [], "auc", "auc"), *interval(both, [], "pauc", "pauc"), *interval(both, [], "sens_at_spec", "sens")
    )
    plain = M.roc_steps(df, [], score, label)
    point = M.auc(df, [], score, label).join(M.partial_auc(plain, [], fpr_max).select("pauc")).join(
        M.sens_at_spec_interp(plain, [], spec)
    )
    return point.join(df.agg(F.count_distinct(group).alias("n_groups"))).join(ci)


def bootstrap_rate_ci(
    df: DataFrame, keys: Sequence[str], hit: Column, base: Column, n_boot: int = 2000, seed=1, ident: str | None = None
) -> DataFrame:
    """Rate of `hit` among `base` rows with its interval.

    Every row draws its own weights, named by `ident`. Rows without an identity are alike but for the hit: they are counted and
    each count takes one Poisson draw a replicate.
    """
    rows = df.filter(base).withColumn("__h", hit.cast("int"))
    known = F.sum(F.when(F.col("__h").isNotNull(), F.col("__k")))
    if ident is None:
        rows = rows.groupBy(*keys, "__h").agg(F.count(F.lit(1)).alias("__k"))
        each = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
        each = each.withColumn("w", poisson_count(F.col("__k"), seed, *keys, "__h", "rep")).filter("w > 0")
        reps = each.groupBy(*keys, "rep").agg((F.sum(F.col("w") * F.col("__h")) / F.sum("w")).alias("rate"))
    else:
        rows = rows.withColumn("__k", F.lit(1))
        sums = replicate_sums(rows, keys, {"__h": F.coalesce("__h", F.lit(0))}, n_boot, seed, [ident])
        reps = sums.select(*keys, "rep", (F.col("__h") / F.col("w")).alias("rate"))
    ci = reps.groupBy(*keys).agg(*interval(reps, keys, "rate", "rate"))
    point = rows.groupBy(*keys).agg((F.sum(F.col("__k") * F.col("__h")) / known).alias("rate"))
    return attach(point, ci, keys) if keys else point.join(ci)


def bootstrap_mean_ci(
    df: DataFrame, keys: Sequence[str], value: str, n_boot: int = 1000, seed=7, ident: str = "id"
) -> DataFrame:
    """Mean of the non-NULL values with its interval."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, ident, F.col(value).cast("double").alias("__v"))
    reps = replicate_sums(rows, keys, {"__v": F.col("__v")}, n_boot, seed, [ident]).withColumn("mean", F.col("__v") / F.col("w"))
    ci = reps.groupBy(*keys).agg(*interval(reps, keys, "mean", "mean"))
    point = rows.groupBy(*keys).agg(F.avg("__v").alias("mean"), F.count(F.lit(1)).alias("n"))
    return attach(point, ci, keys) if keys else point.join(ci)


def paired_bootstrap_delta(
    df: DataFrame, score_a: str, score_b: str, thr_a: Column, label: str = "label", n_boot: int = 2000, seed=2,
    ident: str = "id", thr_b: Column | None = None,
) -> DataFrame:
    """Intervals of AUC and specificity differences (b - a) on the same resampled rows."""
    a = replicate_auc(df, [], score_a, label, n_boot, seed, [ident], "auc_a")
    b = replicate_auc(df, [], score_b, label, n_boot, seed, [ident], "auc_b")
    auc_d = a.join(b, "rep").select("rep", (F.col("auc_b") - F.col("auc_a")).alias("d_auc"))
    flags = thr_a.cast("int") - (thr_b if thr_b is not None else thr_a).cast("int")
    neg = df.filter(F.col(label) == 0).withColumn("__d", F.coalesce(flags, F.lit(0)))
    spec_d = replicate_sums(neg, [], {"__d": F.col("__d")}, n_boot, seed, [ident]).select("rep", (F.col("__d") / F.col("w")).alias("d_spec"))
    both = auc_d.filter(F.col("d_auc").isNotNull()).join(spec_d, "rep", "left")
    return both.agg(*interval(both, [], "d_auc", "d_auc"), *interval(both, [], "d_spec", "d_spec"))


def recalibrated_operating_point(
    df: DataFrame, keys: Sequence[str], score: str = "p", label: str = "label", n_splits: int = 20,
    cal_frac: float = 0.2, target: float = 0.95, floor: int = 8, ident: str = "id", method: str = "roc",
) -> DataFrame:
    """Threshold refitted on a cal slice, judged on the rest, over n_splits splits.

    Returns median and quartiles of sensitivity, median specificity and the split
    nearest the median (first on ties) with its exact binomial interval. Groups under `floor` per class are left out.
    """
    big = df.groupBy(*keys).agg(F.count_if(F.col(label) == 1).alias("__p"), F.count_if(F.col(label) == 0).alias("__q"))
    big = big.filter((F.col("__p") >= floor) & (F.col("__q") >= floor))
    big = big.select(*keys, (F.col("__p") + F.col("__q")).alias("__rows"))
    dims = [*keys, "split"]
    # n_splits rows for each row, ranked once: the curve, its thresholds and the counts all read this table
    rows = S.recal_splits(skew_attach(df, settle(big), keys, [ident], "__rows"), keys, n_splits, cal_frac, label, ident)
    rows = settle(rows.select(*dims, ident, score, label, "role"))
    cal = rows.filter("role = 'cal'")
    if method == "roc":
        thr = M.threshold_for_sensitivity_roc(M.roc_steps(cal, dims, score, label), dims, target)
    else:
        thr = M.threshold_for_sensitivity_quantile(cal, dims, score, label, target)
    held = rows.filter("role = 'eval'")
    sized = settle(attach(held.groupBy(*dims).agg(F.count(F.lit(1)).alias("__rows")), thr, dims))
    ev = skew_attach(held, sized, dims, [ident], "__rows")
    hot, pos = F.col(score) >= F.col("threshold"), F.col(label) == 1
    per = ev.groupBy(*dims).agg(
        ratio(F.count_if(hot & pos), F.count_if(pos)).alias("sens"),
        ratio(F.count_if(~hot & ~pos), F.count_if(~pos)).alias("spec"),
        F.count_if(hot & pos).alias("tp"),
        F.count_if(pos).alias("n_pos"),
    ).filter(F.col("sens").isNotNull() & F.col("spec").isNotNull())
    mids = per.groupBy(*keys).agg(
        F.percentile("sens", F.lit(0.5)).alias("sens_median"),
        F.percentile("sens", F.lit(0.25)).alias("sens_q25"),
        F.percentile("sens", F.lit(0.75)).alias("sens_q75"),
        F.percentile("spec", F.lit(0.5)).alias("spec_median"),
        F.count(F.lit(1)).alias("n_splits"),
        F.collect_list(F.struct("split", "sens", "tp", "n_pos")).alias("__all"),
    )
    near = F.array_min(
        F.transform(
            "__all",
            lambda s: F.struct(F.abs(s["sens"] - F.col("sens_median")).alias("d"), s["split"].alias("split"), s["tp"].alias("tp"), s["n_pos"].alias("n_pos")),
        )
    )
    out = mids.withColumn("__near", near).select(
        *keys, "sens_median", "sens_q25", "sens_q75", "spec_median", "n_splits",
        F.col("__near.split").alias("median_split"), F.col("__near.tp").alias("median_tp"), F.col("__near.n_pos").alias("median_n_pos"),
    )
    return clopper_pearson(out, "median_tp", "median_n_pos", "median")


def pearson_within_class(df: DataFrame, z: str = "logit", source: str = "source", label: str = "label") -> DataFrame:
    """Correlation of the score with each source indicator inside each class.

    corr with a 0/1 indicator needs only sums, so one aggregate per (class, source)
    and one per class are enough. Zero variance gives no row.
    """
    x = F.col(z)
    per = df.groupBy(label, source).agg(F.count(F.lit(1)).cast("double").alias("k"), F.sum(x).alias("sx"))
    whole = df.groupBy(label).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd")
    )
    share = F.col("k") / F.col("n")
    r = (F.col("sx") / F.col("n") - F.col("mean") * share) / (F.col("sd") * F.sqrt(share * (1.0 - share)))
    return (
        attach(per, whole, [label])
        .filter((F.col("sd") > 0) & (F.col("k") < F.col("n")))
        .select(label, source, r.alias("r"))
    )


def spearman_rank(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Rank correlation of two score maps per item, tie-averaged; an item is a fixed-size map."""

    def mean_rank(c: str) -> Column:
        at_or_below = F.count(F.lit(1)).over(
            Window.partitionBy(*keys).orderBy(c).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        )
        ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, c))
        return at_or_below - (ties - 1) / F.lit(2.0)

    ranked = df.withColumn("__ra", mean_rank(a)).withColumn("__rb", mean_rank(b))
    return ranked.groupBy(*keys).agg(F.corr("__ra", "__rb").alias("rho"))


def ols_residuals(df: DataFrame, y: str, covariates: Sequence[str], name: str = "residual") -> DataFrame:
    """Residual of y on the covariates (normal equations, one pass over the rows)."""
    packed = VectorAssembler(inputCols=list(covariates), outputCol="__x").transform(
        df.withColumns({c: F.col(c).cast("double") for c in covariates})
    )
    fit = LinearRegression(featuresCol="__x", labelCol=y, predictionCol="__p", solver="normal", regParam=0.0).fit(packed)
    return fit.transform(packed).withColumn(name, F.col(y) - F.col("__p")).drop("__x", "__p")


def source_separability(df: DataFrame, score: str, source: str = "source") -> DataFrame:
    """One-vs-rest AUC of a scalar per source, direction-free.

    For source s against the rest, concordance = (pairs won against everyone) minus
    (pairs inside s), so one histogram by (score, source) gives every source:
    no row is copied per source. The all-rows running total and the own-source
    running total are both bucketed.
    """
    hist = df.select(F.col(score).cast("double").alias("score"), F.col(source).alias("source")).groupBy("source", "score").agg(
        F.count(F.lit(1)).alias("k")
    )
    level = hist.groupBy("score").agg(F.sum("k").alias("all_k"))
    below = running_totals(level, [], ["score"], value_bucket("score"), {"upto": "all_k"}, totals={"upto": "n"})
    own = running_totals(hist, ["source"], ["score"], value_bucket("score"), {"own_upto": "k"}, totals={"own_upto": "m"})
    joined = own.join(below, "score")
    rest_below = (F.col("upto") - F.col("all_k")) - (F.col("own_upto") - F.col("k"))
    rest_tied = F.col("all_k") - F.col("k")
    won = F.sum(F.col("k") * (rest_below + rest_tied / F.lit(2.0)))
    rest = F.max("n") - F.max("m")
    auc = ratio(won, F.max("m").cast("double") * rest)
    return joined.groupBy("source").agg(auc.alias("auc"), F.max("m").alias("n_rows")).filter("auc IS NOT NULL").withColumn(
        "separability", F.greatest(F.col("auc"), 1.0 - F.col("auc"))
    )


def source_reliance(df: DataFrame, z: str, covariates: Sequence[str], source: str = "source", label: str = "label") -> DataFrame:
    """Raw and residual separability, their gap and the verdict on the residual excess."""
    resid = ols_residuals(df.withColumn("__label", F.col(label).cast("double")), z, [*covariates, "__label"])
    raw = source_separability(df, z, source).agg(F.avg("separability").alias("raw"))
    res = source_separability(resid, "residual", source).agg(F.avg("separability").alias("residual"))
    return raw.join(res).withColumn("gap", F.col("raw") - F.col("residual")).withColumn(
        "verdict", reliance_verdict(F.col("residual"))
    )


def reliance_verdict(residual: Column) -> Column:
    excess = residual - 0.5
    return F.when(excess <= 0.05, "PASS").when(excess <= 0.20, "WATCH").otherwise("FAIL")


def permutation_verdict(aucs: DataFrame, value: str = "auc", cut: float = 0.60) -> DataFrame:
    """Mean and range of permuted-label AUCs; PASS while the mean stays under the cut."""
    mean = F.avg(value)
    return aucs.agg(
        F.count(F.lit(1)).alias("n_perms"), mean.alias("mean_auc"), F.min(value).alias("lo"), F.max(value).alias("hi"),
        F.when(mean < cut, "PASS").otherwise("FAIL").alias("verdict"),
    )


