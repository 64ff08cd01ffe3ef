"""Stratified audits, gates and run-over-run checks.

Subgroups are a membership table (item, subgroup): they may overlap and a hot
subgroup is a map-side combined aggregate like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline import constants as K
from plumbline.functions.intervals import clopper_pearson
from plumbline.functions.maths import floored_ratio, ratio, wilson
from plumbline.operators import arrays as G
from plumbline.operators import metrics as M
from plumbline.operators import resample as R
from plumbline.operators.rules import evidence_fires
from plumbline.session import settle

HIGH_SCORE = 0.95


def build_subgroups(wide: DataFrame, ident: str, columns: Sequence[str], none_name: str = "no_finding") -> DataFrame:
    """0/1 columns -> (item, subgroup); items with none flagged get `none_name`."""
    on = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in columns]))
    names = F.when(F.size(on) == 0, F.array(F.lit(none_name))).otherwise(on)
    return wide.select(ident, F.explode(names).alias("subgroup"))


def stratified_fpr(
    scores: DataFrame, membership: DataFrame, subgroups: DataFrame, thr: float, ident: str = "id", p: str = "p",
    label: str = "label", exact: bool = False,
) -> DataFrame:
    """Per named subgroup: n, n_fp, FPR over its negatives with interval, mean, tail share, Brier, ECE.

    `subgroups` lists the names to report; an empty one keeps a row of NULLs. The
    interval is Wilson, or Clopper-Pearson with `exact`.
    """
    hot, neg = F.col(p) >= F.lit(thr), F.col(label) == 0
    per = M.with_bin(membership.join(scores.select(ident, p, label), ident), p).groupBy("subgroup").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(neg).alias("n_neg"),
        F.count_if(hot & neg).alias("n_fp"),
        F.avg(p).alias("mean_score"),
        F.avg((F.col(p) >= HIGH_SCORE).cast("double")).alias("frac_high"),
        M.brier(p, label).alias("brier"),
        M.ece_from_sums(p, label).alias("ece"),
    )
    out = subgroups.select("subgroup").join(per, "subgroup", "left").fillna(0, ["n", "n_neg", "n_fp"])
    out = out.withColumn("fpr", ratio("n_fp", "n_neg"))
    if exact:
        return clopper_pearson(out, "n_fp", "n_neg", "fpr")
    return M.wilson_columns(out, "n_fp", "n_neg", "fpr")


def unknown_members(membership: DataFrame, scores: DataFrame, ident: str = "id") -> DataFrame:
    """Membership rows that point to no item."""
    return membership.join(scores.select(ident), ident, "left_anti")


def assert_members_known(membership: DataFrame, scores: DataFrame, ident: str = "id") -> None:
    if unknown_members(membership, scores, ident).limit(1).count():
        raise ValueError("subgroup membership refers to items outside the scored set")


def min_n_filter(rows: DataFrame, n: str = "n", floor: int = K.STRESS_MIN_N) -> DataFrame:
    return rows.filter(F.col(n) >= floor)


def ranked_findings(rows: DataFrame, tag: Column) -> DataFrame:
    """Report order: FPR descending, NULL last."""
    return rows.withColumn("tag", tag).orderBy(F.desc_nulls_last("fpr"), F.asc("subgroup"))


def fpr_spec_block(df: DataFrame, keys: Sequence[str], p: str, thr: float) -> DataFrame:
    """Negatives only: FPR with Wilson interval and its reflection as specificity."""
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(p) >= F.lit(thr)).alias("n_fp"),
        F.avg(p).alias("mean_score"),
        F.avg((F.col(p) >= HIGH_SCORE).cast("double")).alias("frac_high"),
    )
    lo, hi = wilson("n_fp", "n")
    out = counts.withColumn("fpr", ratio("n_fp", "n")).withColumn("fpr_lo", lo).withColumn("fpr_hi", hi)
    return out.withColumns(
        {"spec": 1.0 - F.col("fpr"), "spec_lo": 1.0 - F.col("fpr_hi"), "spec_hi": 1.0 - F.col("fpr_lo")}
    )


def abstain_mask(p: str, box: str, path: str, thr: float) -> Column:
    base = F.when(F.col(p) < F.lit(thr), F.lit("no_tb")).otherwise(F.lit("tb"))
    return evidence_fires(base, p, box, path)


def abstain_audit_by_source(df: DataFrame, keys: Sequence[str], p: str, abstain: Column, thr: float, label: str = "label") -> DataFrame:
    """Abstain rates, strict and effective rates, catch, cost and their ratio."""
    pos, hot = F.col(label) == 1, F.col(p) >= F.lit(thr)
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(pos).alias("n_pos"),
        F.count_if(~pos).alias("n_neg"),
        F.count_if(abstain).alias("n_abstain"),
        F.count_if(abstain & pos).alias("catch"),
        F.count_if(abstain & ~pos).alias("cost"),
        F.count_if(hot & pos).alias("tp"),
        F.count_if(~hot & ~abstain & pos).alias("fn"),
        F.count_if(hot & ~pos).alias("fp"),
        F.count_if(~hot & ~abstain & ~pos).alias("tn"),
    )
    return out.withColumns(
        {
            "abstain_rate": floored_ratio("n_abstain", "n"),
            "abstain_rate_pos": floored_ratio("catch", "n_pos"),
            "abstain_rate_neg": floored_ratio("cost", "n_neg"),
            "strict_sens": floored_ratio("tp", F.col("tp") + F.col("fn")),
            "strict_spec": floored_ratio("tn", F.col("tn") + F.col("fp")),
            "effective_sens": floored_ratio(F.col("tp") + F.col("catch"), "n_pos"),
            "catch_cost_ratio": floored_ratio("catch", "cost"),
        }
    )


def abstain_audit_by_finding(df: DataFrame, membership: DataFrame, abstain: Column, signals: Sequence[str], baseline: str, ident: str = "id") -> DataFrame:
    """Abstain rate per finding, its multiple of the baseline finding's rate, mean signals.

    A zero baseline gives +inf where anything abstained and 0 elsewhere.
    """
    marked = df.select(ident, *signals, abstain.alias("__a"))
    per = membership.join(marked, ident).groupBy("finding").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("__a")).alias("n_abstain"),
        *[F.avg(s).alias(f"mean_{s}") for s in signals],
    ).withColumn("abstain_rate", ratio("n_abstain", "n"))
    base = F.coalesce(per.filter(F.col("finding") == baseline).select("abstain_rate").scalar(), F.lit(0.0))
    multiple = (
        F.when(base > 0, F.col("abstain_rate") / base)
        .when(F.col("n_abstain") > 0, F.lit(float("inf")))
        .otherwise(F.lit(0.0))
    )
    return per.withColumn("multiplier", multiple)


def fairness_gate(source_rows: DataFrame, finding_rows: DataFrame) -> DataFrame:
    """FAIL for a multiple > 5, WATCH for > 3 or a catch/cost ratio < 1, else PASS; floors of 10 apply."""
    big = F.col("n") >= K.GATE_MIN_N
    flags = finding_rows.agg(
        F.count_if(big & (F.col("multiplier") > K.GATE_FAIL_MULTIPLIER)).alias("n_failing"),
        F.count_if(
            big & (F.col("multiplier") > K.GATE_PASS_MULTIPLIER) & (F.col("multiplier") <= K.GATE_FAIL_MULTIPLIER)
        ).alias("n_elevated_findings"),
    )
    costly = source_rows.agg(
        F.count_if((F.col("n_pos") >= K.GATE_MIN_N) & (F.col("catch_cost_ratio") < 1.0)).alias("n_costly_sources")
    )
    watch = (F.col("n_elevated_findings") > 0) | (F.col("n_costly_sources") > 0)
    return flags.join(costly).withColumn(
        "verdict", F.when(F.col("n_failing") > 0, "FAIL").when(watch, "WATCH").otherwise("PASS")
    )


def lodo_report(folds: DataFrame, keys: Sequence[str], remix: Sequence[str], thr: float, p: str = "p", label: str = "label") -> DataFrame:
    """Per fold: n, AUC, ECE, cold-start sens/spec at the frozen threshold, leakage-prone flag."""
    base = M.with_bin(folds, p).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("pos"), M.ece_from_sums(p, label).alias("ece")
    )
    cold = M.sens_spec(M.confusion(folds, keys, p, label, thr)).select(*keys, "sens", "spec")
    ranks = M.auc(folds, keys, p, label).select(*keys, "auc")
    return base.join(cold, list(keys)).join(ranks, list(keys)).withColumn("remix", F.col(keys[0]).isin(list(remix)))


def lodo_report_full(
    folds: DataFrame, key: str, remix: Sequence[str], thr: float, p: str = "p", label: str = "label", n_boot: int = 2000, ident: str = "id"
) -> DataFrame:
    """`lodo_report` with the bootstrap interval of the AUC, the median recalibrated point and a row 'mean' over the folds.

    Folds with too few rows of a class for recalibration have NULL there. The mean row sums n and pos and is no remix.
    """
    folds = settle(folds.select(key, ident, p, label))  # a narrow table; report, interval and recalibration each read it several times
    report = lodo_report(folds, [key], remix, thr, p, label)
    span = R.bootstrap_auc_ci(folds, [key], p, label, n_boot, ident=ident).select(key, "auc_lo", "auc_hi")
    again = R.recalibrated_operating_point(folds, [key], p, label, ident=ident).select(
        key, F.col("sens_median").alias("recal_sens"), F.col("spec_median").alias("recal_spec"), F.col("median_lo").alias("recal_lo"),
        F.col("median_hi").alias("recal_hi"),
    )
    full = report.join(span, key, "left").join(again, key, "left")
    totals = {c: F.sum(c) if c in ("n", "pos") else F.avg(c) for c in ("n", "pos", "ece", "sens", "spec", "auc", "recal_sens", "recal_spec")}
    mean = full.agg(*[e.alias(c) for c, e in totals.items()]).select(F.lit("mean").alias(key), "*", F.lit(False).alias("remix"))
    return full.unionByName(mean, allowMissingColumns=True)


def worst_clean_fold(report: DataFrame, fold: str = "source") -> DataFrame:
    """Mean AUC over all folds and the non-remix fold of the lowest sensitivity."""
    clean = ~F.col("remix") & F.col("sens").isNotNull()
    worst = F.min(F.when(clean, F.struct(F.col("sens"), F.col(fold).alias("fold"))))
    return report.agg(F.avg("auc").alias("mean_auc"), worst.alias("__w")).select(
        "mean_auc", F.col("__w.fold").alias("worst_fold"), F.col("__w.sens").alias("worst_sens")
    )


def nonbox_mean(report: DataFrame, n_boxes: str = "n_boxes") -> DataFrame:
    return report.filter(F.col(n_boxes) == 0).agg(F.avg("auc").alias("nonbox_auc"), F.count(F.lit(1)).alias("n_folds"))


def ablation_ladder(df: DataFrame, rungs: dict[str, str], label: str = "label", thr: float = K.LOCKED_THR, low: float = K.LOCKED_LOW) -> DataFrame:
    """Locked metrics of several probability columns on one surface, with deltas to the first rung."""
    first = next(iter(rungs))
    stacked = df.select(
        label, F.explode(F.array(*[F.struct(F.lit(r).alias("rung"), F.col(c).alias("p")) for r, c in rungs.items()])).alias("__r")
    ).select(label, "__r.*")
    out = M.locked_metrics(stacked, ["rung"], "p", label, thr, low).select(
        "rung", "n", "auc", "sens", "spec", "ece", "abstain_rate"
    )
    base = out.filter(F.col("rung") == first)
    for m in ("auc", "sens", "spec"):
        out = out.withColumn(f"d_{m}", F.col(m) - base.select(m).scalar())
    return out


def miss_diagnosis(
    df: DataFrame, zones: str = "zones", findings: str = "findings", p: str = "p", label: str = "label", cut: float = 0.20,
    n_zones: int = 4, n_findings: int = 5,
) -> DataFrame:
    """Positives scored under the cut with their highest zones and findings (top_zones, top_findings: key and value).

    `zones` and `findings` are maps of scores; a NULL map has no top. Equal values go by key.
    """
    tops = {"top_zones": G.top_k_map(zones, n_zones), "top_findings": G.top_k_map(findings, n_findings)}
    return M.confident_misses(df, p, label, cut).withColumns(tops)


def localization_report(
    scores: dict[str, DataFrame], floor: str = "random", n_boot: int = 1000, seed=7, ident: str = "id"
) -> DataFrame:
    """Per evidence map: hit rate and both mean IoUs with bootstrap intervals, and their lift over the map `floor`.

    scores: map name -> rows of `localization_scores` (ident, hit, iou_topk, iou_fixed). An item without an IoU is left out of its
    mean and interval. All maps and measures of an item share its draws. The lifts
    of `floor` itself are 0; without that map they are NULL.
    """
    measures, rows = {"hit": F.col("hit").cast("double"), "miou_topk": F.col("iou_topk"), "miou_fixed": F.col("iou_fixed")}, None
    for name, one in scores.items():
        part = one.select(F.lit(name).alias("map"), ident, *[c.alias(m) for m, c in measures.items()])
        rows = part if rows is None else rows.unionByName(part)
    rows = settle(rows)  # a narrow row per item and map; draws, means and each lift read it
    sums = {m: F.coalesce(m, F.lit(0.0)) for m in measures} | {f"some_{m}": F.col(m).isNotNull() for m in measures}
    each = R.replicate_sums(rows, ["map"], sums, n_boot, seed, [ident]).select(
        "map", "rep", *[ratio(m, f"some_{m}").alias(m) for m in measures]
    )
    spans = each.groupBy("map").agg(*[c for m in measures for c in R.interval(each, ["map"], m, m)])
    point = rows.groupBy("map").agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in measures])
    point = settle(point)
    base = point.filter(F.col("map") == floor)
    lifted = point.select("*", *[(F.col(m) - base.select(m).scalar()).alias(f"{m}_lift") for m in measures])
    return lifted.join(spans, "map", "left").withColumnRenamed("hit", "hit_rate")


def dose_response(doses: DataFrame, test: DataFrame, score_of_dose: Column, label: str = "label") -> DataFrame:
    """Per dose: training sizes and the test curve of that dose's scores.

    doses: (dose, label) rows of the nested training sets. test rows are scored for
    every dose by `score_of_dose` over column dose_n (training rows of the dose).
    """
    sizes = doses.groupBy("dose").agg(
        F.count(F.lit(1)).alias("dose_n"),
        F.count_if(F.col(label) == 1).alias("n_pos"),
        F.count_if(F.col(label) == 0).alias("n_neg"),
    )
    listed = sizes.agg(F.array_sort(F.collect_list(F.struct("dose", "dose_n"))).alias("d"))
    scored = test.withColumn("__d", F.explode(listed.scalar())).select("*", "__d.*").withColumn("score", score_of_dose)
    steps = M.roc_steps(scored, ["dose"], "score", label)
    tied = F.sum(F.col("n_pos") * (F.col("all_neg") - F.col("fp") + F.col("n_neg") / F.lit(2.0)))
    aucs = steps.groupBy("dose").agg(ratio(tied, F.max("all_pos").cast("double") * F.max("all_neg")).alias("auc"))
    return (
        sizes.join(aucs, "dose")
        .join(M.spec_at_sens(steps, ["dose"]).select("dose", "spec_at_sens"), "dose")
        .join(M.sens_at_spec_last(steps, ["dose"]).select("dose", "sens_at_spec"), "dose")
    )


def forgetting_check(sens: Column, floor: float = K.FORGETTING_FLOOR) -> Column:
    return F.when(sens >= F.lit(floor), "OK").otherwise("WATCH")


def confound_gate(within: Column, cross_source: Column, cross_site: Column, flag: float = 0.98) -> Column:
    return (
        F.when(within >= F.lit(flag), "CONFOUND")
        .when((within > cross_source) & (cross_source > cross_site), "WATCH")
        .otherwise("CLEAR")
    )


def material_gain_gate(df: DataFrame, auc_cols: dict[str, tuple[str, str]], pool_auc: str, ceiling: float = K.DEPLOYED_AUC, margin: float = K.GAIN_MARGIN) -> DataFrame:
    """STOP iff the best branch clears ceiling + margin and its lower bound clears the ceiling.

    auc_cols: branch -> (auc column, lower-bound column). The gate is flagged as
    misspecified when the branches collapse while the pooled probe recovers.
    """
    best = F.greatest(
        *[F.struct(F.col(a).alias("auc"), F.lit(-i).alias("i"), F.lit(b).alias("branch"), F.col(lo).alias("lo")) for i, (b, (a, lo)) in enumerate(auc_cols.items())]
    )
    out = df.withColumn("__b", best)
    higher = (F.col("__b.auc") >= ceiling + margin) & (F.col("__b.lo") > ceiling)
    valid = ~((F.col("__b.auc") < ceiling - margin) & (F.col(pool_auc) >= ceiling))
    return out.withColumns(
        {
            "best_branch": F.col("__b.branch"),
            "best_auc": F.col("__b.auc"),
            "decision": F.when(higher, "STOP").otherwise("PROCEED"),
            "gate_valid": valid,
            "label": F.when(valid, "PROCEED").otherwise("INCONCLUSIVE (gate misspecified)"),
        }
    ).drop("__b")


def artifact_synthesis(wins_lodo: Column, robust_holds: Column, norm_survives: Column, graceful: Column) -> Column:
    """Struct(verdict, n_signals) of the four artifact checks."""
    n = sum((c.cast("int") for c in (wins_lodo, robust_holds, norm_survives, graceful)), F.lit(0))
    verdict = (
        F.when(wins_lodo & robust_holds & norm_survives, "REAL")
        .when(~robust_holds & ~norm_survives, "ARTIFACT")
        .when(~wins_lodo & robust_holds & norm_survives, "MIXED-NOT-MAX")
        .when(~wins_lodo, "ARTIFACT-LEANING")
        .otherwise("MIXED")
    )
    return F.struct(verdict.alias("verdict"), n.alias("n_signals"))


def go_no_go_local_gain(deltas: DataFrame, arm: str = "arm", delta: str = "delta", noise: float = 0.01) -> DataFrame:
    """GO when an arm improves a source by more than the noise and no source falls by more."""
    up, down = F.bool_or(F.col(delta) > noise), F.bool_or(F.col(delta) < -noise)
    return deltas.groupBy(arm).agg(
        F.count_if(F.col(delta) > noise).alias("n_improved"), F.count_if(F.col(delta) < -noise).alias("n_regressed"),
        F.when(up & ~down, "GO").otherwise("NO-GO").alias("decision"),
    )


def drift_tripwires(runs: DataFrame, order: str, auc_jump: float = 0.05, perm_cut: float = 0.60, ece_rise: float = 0.02) -> DataFrame:
    """Run-over-run flags over a ledger (mean_auc, worst_sens, permuted_auc, ece), one row per run.

    The ledger is a log of runs, a bounded table, so its window is a plain one.
    """
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    prev = {c: F.lag(c).over(w) for c in ("mean_auc", "worst_sens", "ece")}
    jump = F.coalesce(F.col("mean_auc") - prev["mean_auc"] > auc_jump, F.lit(False))
    hidden = F.coalesce(
        (F.col("mean_auc") > prev["mean_auc"]) & (F.col("worst_sens") < prev["worst_sens"]), F.lit(False)
    )
    shortcut = F.coalesce(F.col("permuted_auc") >= perm_cut, F.lit(False))
    rise = F.coalesce(F.col("ece") - prev["ece"] > ece_rise, F.lit(False))
    return runs.select(
        "*", jump.alias("auc_jump"), hidden.alias("worst_fold_hidden"), shortcut.alias("shortcut"), rise.alias("ece_rise"),
        (jump | hidden | shortcut | rise).alias("drift"),
    )


def verdict_flips(a: DataFrame, b: DataFrame, key: str = "id", verdict: str = "verdict") -> DataFrame:
    joined = a.join(b.select(key, F.col(verdict).alias("__v")), key)
    return joined.agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if(~F.col(verdict).eqNullSafe(F.col("__v"))).alias("n_flips")
    )


def ab_gate(df: DataFrame, p_a: str, p_b: str, p_b2: str, cut: float, label: str = "label", rescue_share: float = 0.75, flip_share: float = 2 / 23) -> DataFrame:
    """Arm B against A: rescues of A's misses, new false positives, flips between B's two seeds."""
    pos, a, b, b2 = F.col(label) == 1, F.col(p_a) >= cut, F.col(p_b) >= cut, F.col(p_b2) >= cut
    out = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(pos & ~a).alias("n_misses"),
        F.count_if(pos & ~a & b).alias("n_rescued"),
        F.count_if(~pos & ~a & b).alias("n_new_fp"),
        F.count_if(b != b2).alias("n_flips"),
    )
    go = (
        (F.col("n_rescued") >= F.col("n_misses") * rescue_share)
        & (F.col("n_new_fp") == 0)
        & (F.col("n_flips") <= F.col("n") * flip_share)
    )
    return out.withColumn("decision", F.when(go, "GO").otherwise("NO-GO"))


def invariant_checks(df: DataFrame, numbers: Sequence[str], label: str, expected_label: str) -> DataFrame:
    """Non-finite counts and label mismatches of a feature table, one row."""
    bad = sum(
        ((F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).cast("bigint") for c in numbers), F.lit(0).cast("bigint")
    )
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(bad), F.lit(0)).alias("n_non_finite"),
        F.count_if(~F.col(label).eqNullSafe(F.col(expected_label))).alias("n_label_mismatch"),
    )


def hard_negative_compare(df: DataFrame, p_base: str, p_fixed: str, probe: Column, thr: float, label: str = "label") -> DataFrame:
    """FPR on the probe rows and sens/spec on the rest, before and after, with deltas."""
    def rates(p: str, tag: str) -> list[Column]:
        hot, pos = F.col(p) >= F.lit(thr), F.col(label) == 1
        return [
            ratio(F.count_if(probe & hot), F.count_if(probe)).alias(f"fpr_{tag}"),
            ratio(F.count_if(~probe & pos & hot), F.count_if(~probe & pos)).alias(f"sens_{tag}"),
            ratio(F.count_if(~probe & ~pos & ~hot), F.count_if(~probe & ~pos)).alias(f"spec_{tag}"),
        ]

    out = df.agg(*rates(p_base, "base"), *rates(p_fixed, "fixed"))
    return out.withColumns({f"d_{m}": F.col(f"{m}_fixed") - F.col(f"{m}_base") for m in ("fpr", "sens", "spec")})


def domain_contrast(df: DataFrame, site: str, a: str, b: str, p: str, label: str, thr: float) -> DataFrame:
    """One metric row per site pair, side by side."""
    def at(name: str) -> list[Column]:
        here = F.col(site) == name
        neg = here & (F.col(label) == 0)
        return [
            F.count_if(here).alias(f"n_{name}"),
            ratio(F.count_if(neg & (F.col(p) >= thr)), F.count_if(neg)).alias(f"fpr_{name}"),
            F.avg(F.when(here, F.col(p))).alias(f"mean_{name}"),
        ]

    return df.agg(*at(a), *at(b)).withColumn("fpr_gap", F.col(f"fpr_{a}") - F.col(f"fpr_{b}"))


def overall_and_by_group(df: DataFrame, key: str, measures: dict[str, Column]) -> DataFrame:
    """Overall row (key NULL) and per-group rows from one pass."""
    return df.rollup(key).agg(*[c.alias(n) for n, c in measures.items()])
