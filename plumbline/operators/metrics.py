"""Classification metrics over (keys, score, label) tables.

Everything rank-based goes through one histogram: rows are combined map-side to
one row per (keys, distinct score) holding its positives and negatives, and the
running totals over it are cut into value buckets, so no task sees a whole
group. `weight` carries replicate weights; unweighted counts are weight 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.maths import (
    col,
    edge_bin,
    floored_ratio,
    linspace_edges,
    ratio,
    wilson,
)
from plumbline.functions.ranking import attach, running_totals, value_bucket


def _count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(cond.cast("bigint")), F.lit(0)).cast("bigint")


def score_histogram(df: DataFrame, keys: Sequence[str], score="score", label="label", weight=None) -> DataFrame:
    """One row per (keys, score): n_pos, n_neg. NULL and NaN scores are left out."""
    w = F.lit(1).cast("bigint") if weight is None else col(weight)
    kept = df.select(
        *keys, col(score).cast("double").alias("score"), (col(label) == 1).alias("__y"), w.alias("__w")
    ).filter(F.col("score").isNotNull() & ~F.isnan("score"))
    zero = F.lit(0).cast("bigint")
    return kept.groupBy(*keys, "score").agg(
        F.sum(F.when(F.col("__y"), F.col("__w")).otherwise(zero)).alias("n_pos"),
        F.sum(F.when(F.col("__y"), zero).otherwise(F.col("__w"))).alias("n_neg"),
    )


def bucket_auc_parts(hist: DataFrame, keys: Sequence[str], bucket: str = "__b") -> DataFrame:
    """Per (keys, bucket): concordance inside the bucket and class totals."""
    inside = Window.partitionBy(*keys, bucket).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("n_neg").over(inside), F.lit(0))
    return (
        hist.withColumn("__part", F.col("n_pos") * (below + F.col("n_neg") / F.lit(2.0)))
        .groupBy(*keys, bucket)
        .agg(F.sum("__part").alias("part"), F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))
    )


def combine_auc_parts(parts: DataFrame, keys: Sequence[str], bucket: str = "__b", name: str = "auc") -> DataFrame:
    """Fold bucket parts to one AUC per keys; NULL when a class is absent."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(bucket)
    below = F.coalesce(F.sum("n_neg").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        parts.withColumn("__c", F.col("part") + F.col("n_pos") * below)
        .groupBy(*keys)
        .agg(
            ratio(F.sum("__c"), F.sum("n_pos").cast("double") * F.sum("n_neg").cast("double")).alias(name),
            F.sum("n_pos").alias("n_pos"),
            F.sum("n_neg").alias("n_neg"),
        )
    )


def auc(df: DataFrame, keys: Sequence[str], score="score", label="label", weight=None, name: str = "auc") -> DataFrame:
    """Mann-Whitney AUC with tie-averaged ranks: keys, auc, n_pos, n_neg."""
    hist = score_histogram(df, keys, score, label, weight).withColumn("__b", value_bucket("score"))
    return combine_auc_parts(bucket_auc_parts(hist, keys), keys, name=name)


def roc_steps(df: DataFrame, keys: Sequence[str], score="score", label="label", weight=None) -> DataFrame:
    """Every step of the undropped ROC curve, highest score first.

    One row per distinct score with the cumulative tp, fp at that threshold, the
    counts before it (tp0, fp0), the class totals and the rates. A step carries
    its own predecessor, so areas and interpolations need no further ordering.
    """
    hist = score_histogram(df, keys, score, label, weight)
    run = running_totals(
        hist,
        keys,
        ["score"],
        value_bucket("score"),
        {"tp": "n_pos", "fp": "n_neg"},
        descending=True,
        totals={"tp": "all_pos", "fp": "all_neg"},
    )
    return run.select(
        *keys,
        "score",
        "n_pos",
        "n_neg",
        "tp",
        "fp",
        (F.col("tp") - F.col("n_pos")).alias("tp0"),
        (F.col("fp") - F.col("n_neg")).alias("fp0"),
        "all_pos",
        "all_neg",
        ratio("tp", "all_pos").alias("tpr"),
        ratio("fp", "all_neg").alias("fpr"),
        ratio(F.col("tp") - F.col("n_pos"), "all_pos").alias("tpr0"),
        ratio(F.col("fp") - F.col("n_neg"), "all_neg").alias("fpr0"),
    )


def roc_curve(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """fpr, tpr, threshold including the (0, 0, +inf) start of each curve."""
    body = steps.select(*keys, "fpr", "tpr", F.col("score").alias("threshold"))
    start = steps.select(*keys).distinct() if keys else steps.agg(F.count(F.lit(1)).alias("__n")).filter("__n > 0")
    start = start.select(
        *keys, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold")
    )
    return start.unionByName(body)


def average_precision(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Step-wise average precision: sum of recall gains times precision."""
    gain = ratio("n_pos", "all_pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return steps.groupBy(*keys).agg(F.sum(gain).alias("average_precision"))


def threshold_for_sensitivity_roc(steps: DataFrame, keys: Sequence[str], target: float = 0.95) -> DataFrame:
    """Highest score whose recall reaches the target; 0.5 when there is none."""
    hit = F.max(F.when(F.col("tpr") >= F.lit(target), F.col("score")))
    return steps.groupBy(*keys).agg(F.coalesce(hit, F.lit(0.5)).alias("threshold"))


def order_statistic(
    df: DataFrame, keys: Sequence[str], score: str, position: Column, name: str, size: str = "__n"
) -> DataFrame:
    """Value at a 1-based position of each group; `position` may use column `size`.

    Runs on the distinct-score histogram, so copies of one score are one row. NULL and
    NaN are no values: they take no position and do not count. Infinities keep their order.
    """
    some = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    hist = df.filter(some).groupBy(*keys, score).agg(F.count(F.lit(1)).alias("__c"))
    run = running_totals(
        hist, keys, [score], value_bucket(score), {"__cum": "__c"}, totals={"__cum": size}
    ).withColumn("__k", position)
    here = (F.col("__k") <= F.col("__cum")) & (F.col("__k") > F.col("__cum") - F.col("__c"))
    return run.groupBy(*keys).agg(F.max(F.when(here, F.col(score))).alias(name), F.max(size).alias(size))


def threshold_for_sensitivity_quantile(
    df: DataFrame, keys: Sequence[str], score="score", label="label", target: float = 0.95
) -> DataFrame:
    """Positives ascending, index max(0, floor((1 - target) n)); 0.5 with no positives."""
    pos = df.filter(col(label) == 1).select(*keys, col(score).alias("__s"))
    k = F.greatest(F.lit(0), F.floor(F.lit(1.0 - target) * F.col("__n"))) + 1
    found = order_statistic(pos, keys, "__s", k, "threshold").drop("__n")
    if not keys:
        return found.select(F.coalesce("threshold", F.lit(0.5)).alias("threshold"))
    everyone = df.select(*keys).distinct()
    return attach(everyone, found, keys, "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))


def confusion(df: DataFrame, keys: Sequence[str], score="score", label="label", thr=0.5) -> DataFrame:
    """tp, fp, tn, fn at score >= thr (inclusive)."""
    hot, pos = col(score) >= (thr if isinstance(thr, Column) else F.lit(thr)), col(label) == 1
    return df.groupBy(*keys).agg(
        _count_if(hot & pos).alias("tp"),
        _count_if(hot & ~pos).alias("fp"),
        _count_if(~hot & ~pos).alias("tn"),
        _count_if(~hot & pos).alias("fn"),
    )


def sens_spec(counts: DataFrame) -> DataFrame:
    """Sensitivity and specificity from confusion columns, NULL where undefined."""
    return counts.withColumn("sens", ratio("tp", F.col("tp") + F.col("fn"))).withColumn(
        "spec", ratio("tn", F.col("tn") + F.col("fp"))
    )


def wilson_columns(df: DataFrame, k, n, prefix: str) -> DataFrame:
    lo, hi = wilson(k, n)
    return df.withColumn(f"{prefix}_lo", lo).withColumn(f"{prefix}_hi", hi)


def verdict_metrics(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items (label, verdict, score, halted): halted first, then abstain, then decided.

    AUC uses every non-halted item with a score, abstentions included.
    """
    halted = F.coalesce(F.col("halted"), F.lit(False))
    abstain = ~halted & (F.col("verdict").isNull() | (F.col("verdict") == "abstain"))
    decided = ~halted & ~F.coalesce(abstain, F.lit(True))
    pos, hot = F.col("label") == 1, F.col("verdict") == "tb"
    base = items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        _count_if(halted).alias("n_halted"),
        _count_if(abstain).alias("n_abstain"),
        _count_if(decided & hot & pos).alias("tp"),
        _count_if(decided & hot & ~pos).alias("fp"),
        _count_if(decided & ~hot & ~pos).alias("tn"),
        _count_if(decided & ~hot & pos).alias("fn"),
    )
    ranked_auc = auc(items.filter(~halted & F.col("score").isNotNull()), keys).drop("n_pos", "n_neg")
    n_decided = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    out = sens_spec(base.withColumn("n_decided", n_decided)).withColumn(
        "accuracy", ratio(F.col("tp") + F.col("tn"), "n_decided")
    )
    return attach(out, ranked_auc, keys, "left") if keys else out.join(ranked_auc, how="left")


def ece(df: DataFrame, keys: Sequence[str], p="p", label="label", bins: int = 10) -> DataFrame:
    """Expected calibration error; the bins are one small row each after map-side combine."""
    per = reliability_bins(df, keys, p, label, bins)
    gap = F.abs(F.col("mean_p") - F.col("mean_y")) * F.col("n")
    return per.groupBy(*keys).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def reliability_bins(df: DataFrame, keys: Sequence[str], p="p", label="label", bins: int = 10) -> DataFrame:
    """Per bin: n, mean p, mean y."""
    return (
        df.select(*keys, edge_bin(p, linspace_edges(bins)).alias("bin"), col(p).alias("__p"), col(label).alias("__y"))
        .filter(F.col("bin").isNotNull())
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("__p").alias("mean_p"), F.avg("__y").alias("mean_y"))
    )


def with_bin(df: DataFrame, p, bins: int = 10) -> DataFrame:
    """Add the bin index once, ahead of an aggregation that uses it many times."""
    return df.withColumn("__bin", edge_bin(p, linspace_edges(bins)))


def ece_from_sums(p, label, bins: int = 10) -> Column:
    """ECE as one aggregate expression over `with_bin` rows, next to other aggregates of the same pass."""
    b = F.col("__bin")
    total = F.lit(0.0)
    for i in range(bins):
        total = total + F.abs(F.coalesce(F.sum(F.when(b == i, col(p) - col(label))), F.lit(0.0)))
    return total / F.count(b)


def brier(p, label) -> Column:
    d = col(p) - col(label)
    return F.avg(d * d)


def locked_metrics(
    df: DataFrame, keys: Sequence[str], p="p", label="label", thr: float = 0.5, low: float = 0.2
) -> DataFrame:
    """Metrics at a frozen operating point, the abstain band [low, thr) excluded from sens/spec.

    One aggregation carries the counts, ECE and Brier; the AUC comes from the histogram.
    """
    pc = col(p)
    hot, pos = pc >= F.lit(thr), col(label) == 1
    abstain = (pc >= F.lit(low)) & ~hot
    miss = ~hot & ~abstain
    base = with_bin(df, p).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        _count_if(pos).alias("n_pos"),
        _count_if(~pos).alias("n_neg"),
        _count_if(hot & pos).alias("tp"),
        _count_if(miss & pos).alias("fn"),
        _count_if(hot & ~pos).alias("fp"),
        _count_if(miss & ~pos).alias("tn"),
        _count_if(abstain).alias("n_abstain"),
        _count_if(abstain & pos).alias("n_abstain_pos"),
        F.avg(abstain.cast("double")).alias("abstain_rate"),
        ece_from_sums(p, label).alias("ece"),
        brier(p, label).alias("brier"),
    )
    out = (
        base.withColumn("sens", floored_ratio("tp", F.col("tp") + F.col("fn")))
        .withColumn("spec", floored_ratio("tn", F.col("tn") + F.col("fp")))
        .withColumn("spec_all_rows", ratio(F.col("n_neg") - F.col("fp"), "n_neg"))
        .withColumn("effective_sens", ratio(F.col("tp") + F.col("n_abstain_pos"), "n_pos"))
    )
    ranks = auc(df, keys, p, label).drop("n_pos", "n_neg")
    return attach(out, ranks, keys, "left") if keys else out.join(ranks, how="left")


def spec_at_sens(steps: DataFrame, keys: Sequence[str], target: float = 0.90) -> DataFrame:
    """1 - fpr at the first step whose tpr reaches the target."""
    ok = F.col("tpr") >= F.lit(target)
    return steps.groupBy(*keys).agg(
        (1.0 - F.min(F.when(ok, F.col("fpr")))).alias("spec_at_sens"),
        F.max(F.when(ok, F.col("score"))).alias("threshold"),
    )


def sens_at_spec_last(steps: DataFrame, keys: Sequence[str], target: float = 0.70) -> DataFrame:
    """tpr at the last step whose 1 - fpr still reaches the target."""
    ok = (1.0 - F.col("fpr")) >= F.lit(target)
    return steps.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(ok, F.col("tpr"))), F.lit(0.0)).alias("sens_at_spec"),
        F.coalesce(F.min(F.when(ok, F.col("score"))), F.lit(float("inf"))).alias("threshold"),
    )


def sens_at_spec_interp(steps: DataFrame, keys: Sequence[str], target: float = 0.70) -> DataFrame:
    """Linear interpolation of tpr at fpr = 1 - target; NULL when a class is absent."""
    x = F.lit(1.0 - target)
    inside = (F.col("fpr0") <= x) & (F.col("fpr") > x)
    slope = (F.col("tpr") - F.col("tpr0")) / (F.col("fpr") - F.col("fpr0"))
    at = F.col("tpr0") + slope * (x - F.col("fpr0"))
    defined = (F.max("all_pos") > 0) & (F.max("all_neg") > 0)
    return steps.groupBy(*keys).agg(
        F.when(defined, F.coalesce(F.max(F.when(inside, at)), F.lit(1.0))).alias("sens_at_spec")
    )


def partial_auc(steps: DataFrame, keys: Sequence[str], fpr_max: float = 0.2) -> DataFrame:
    """Area up to fpr_max with an interpolated end, raw and standardised to [0.5, 1]."""
    if not 0.0 < fpr_max <= 1.0:
        raise ValueError("fpr_max must lie in (0, 1]")
    end = F.least(F.col("fpr"), F.lit(fpr_max))
    wide = F.col("fpr") > F.col("fpr0")
    t1 = F.when(
        wide,
        F.col("tpr0")
        + (F.col("tpr") - F.col("tpr0")) * (end - F.col("fpr0")) / (F.col("fpr") - F.col("fpr0")),
    ).otherwise(F.col("tpr0"))
    area = F.when(
        wide & (F.col("fpr0") < F.lit(fpr_max)), (end - F.col("fpr0")) * (F.col("tpr0") + t1) / 2.0
    ).otherwise(F.lit(0.0))
    low = 0.5 * fpr_max * fpr_max
    both = (F.max("all_pos") > 0) & (F.max("all_neg") > 0)
    return (
        steps.groupBy(*keys)
        .agg(F.when(both, F.sum(area)).alias("pauc_raw"))
        .withColumn("pauc", 0.5 * (1.0 + (F.col("pauc_raw") - low) / (fpr_max - low)))
    )


def ppv_npv(df: DataFrame, sens: str, spec: str, prevalences: Sequence[float]) -> DataFrame:
    """PPV, NPV and confirmatory tests per flagged case, one row per prevalence."""
    out = df.withColumn("prevalence", F.explode(F.array(*[F.lit(float(p)) for p in prevalences])))
    se, sp, pr = F.col(sens), F.col(spec), F.col("prevalence")
    tp, fn, tn, fp = se * pr, (1.0 - se) * pr, sp * (1.0 - pr), (1.0 - sp) * (1.0 - pr)
    return (
        out.withColumn("ppv", F.when(tp + fp > 0, tp / (tp + fp)))
        .withColumn("npv", F.when(tn + fn > 0, tn / (tn + fn)))
        .withColumn("tests_per_case", F.when(tp > 0, (tp + fp) / tp))
    )


def youden_threshold(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Threshold of the largest tpr - fpr, highest score on ties."""
    j = F.col("tpr") - F.col("fpr")
    best = F.max(F.when(j.isNotNull(), F.struct(j.alias("j"), F.col("score").alias("threshold"))))
    return steps.groupBy(*keys).agg(best.alias("__m")).select(*keys, "__m.j", "__m.threshold")


def score_quantiles(df: DataFrame, keys: Sequence[str], score="score", qs=(0.25, 0.5, 0.75)) -> DataFrame:
    """Exact linear-interpolated quantiles per group.

    Built on the running totals of the distinct-score histogram: percentile() keeps
    one group's whole value map in one task, this does not. Position h = q (n - 1)
    falls between the order statistics floor(h) and floor(h) + 1.
    """
    vals = df.select(*keys, col(score).cast("double").alias("__s")).filter(F.col("__s").isNotNull())
    hist = vals.groupBy(*keys, "__s").agg(F.count(F.lit(1)).alias("__c"))
    run = running_totals(hist, keys, ["__s"], value_bucket("__s"), {"__cum": "__c"}, totals={"__cum": "__n"})
    aggs = []
    for i, q in enumerate(qs):
        h = F.lit(float(q)) * (F.col("__n") - 1)
        for tag, k in (("lo", F.floor(h) + 1), ("hi", F.least(F.floor(h) + 2, F.col("__n")))):
            here = (k <= F.col("__cum")) & (k > F.col("__cum") - F.col("__c"))
            aggs.append(F.max(F.when(here, F.col("__s"))).alias(f"__{tag}{i}"))
    out = run.groupBy(*keys).agg(F.max("__n").alias("n"), *aggs)
    cols = []
    for i, q in enumerate(qs):
        h = F.lit(float(q)) * (F.col("n") - 1)
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        cols.append((lo + (hi - lo) * (h - F.floor(h))).alias(f"q{int(round(q * 1000)):03d}"))
    return out.select(*keys, "n", *cols)


def confident_misses(df: DataFrame, p="p", label="label", cut: float = 0.20) -> DataFrame:
    """Positives scored under the cut."""
    return df.filter((col(label) == 1) & (col(p) < F.lit(cut)))


def top_rows(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Report feature: the first k rows in order (runs as a per-partition top-k)."""
    return df.orderBy(*order).limit(k)


def mean_by_tag(rows: DataFrame, tag: str, measures: Sequence[str]) -> DataFrame:
    return rows.groupBy(tag).agg(F.count(F.lit(1)).alias("k"), *[F.avg(m).alias(f"mean_{m}") for m in measures])


