"""One-way decision rules as pure column expressions.

A rule may raise a verdict from no_tb to abstain, never clear one. All rules are
narrow projections: they run inside whole-stage codegen in batch and streaming.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import constants as K
from plumbline.functions.maths import clamp, col, floored_ratio, half_up

_SEVERITY = ("no_tb", "abstain", "tb")


def band_verdict(p, thr: float = K.LOCKED_THR, low: float = K.LOCKED_LOW) -> Column:
    p = col(p)
    return F.when(p >= F.lit(thr), "TB").when(p >= F.lit(low), "ABSTAIN").otherwise("NO_TB")


def conformal_verdict(p, tau_low, tau_high) -> Column:
    p, lo, hi = col(p), col(tau_low), col(tau_high)
    return F.when(p >= hi, "tb").when(p < lo, "no_tb").otherwise("abstain")


def screening_policy(p, u) -> Column:
    """Low bar to flag, high bar to clear."""
    p, u = col(p), col(u)
    clear = (p <= F.lit(K.POLICY_CLEAR)) & (u <= F.lit(K.POLICY_CLEAR_U))
    return F.when(p >= F.lit(K.POLICY_FLAG), "tb").when(clear, "no_tb").otherwise("abstain")


def severity(verdict) -> Column:
    """0 no_tb, 1 abstain or unknown, 2 tb."""
    v = col(verdict)
    return F.when(v == "no_tb", 0).when(v == "tb", 2).otherwise(1)


def most_cautious(*verdicts) -> Column:
    codes = [severity(v) for v in verdicts]
    top = F.greatest(*codes) if len(codes) > 1 else codes[0]
    return F.element_at(F.array(*map(F.lit, _SEVERITY)), top + 1)


def screen_to_verdict(screen) -> Column:
    s = col(screen)
    return F.when(s == "screen_positive", "tb").when(s == "screen_negative", "no_tb").otherwise("abstain")


def verdict_to_screen(verdict) -> Column:
    v = col(verdict)
    return F.when(v == "tb", "screen_positive").when(v == "no_tb", "screen_negative").otherwise("abstain")


def _sure(cond: Column) -> Column:
    """A condition with a missing input does not fire."""
    return F.coalesce(cond, F.lit(False))


def scar_fires(verdict, p, s_inactive, high=K.BORDERLINE_HIGH) -> Column:
    p, s = col(p), col(s_inactive)
    hi = high if isinstance(high, Column) else F.lit(high)
    return _sure(
        (col(verdict) == "no_tb") & (p >= F.lit(K.BORDERLINE_LOW)) & (p < hi) & (s >= F.lit(K.SCAR_ESCALATE))
    )


def evidence_fires(
    verdict, p, box_max, path_max,
    p_low=K.EVIDENCE_P_LOW, box_high=K.EVIDENCE_BOX_HIGH, path_high=K.EVIDENCE_PATH_HIGH,
) -> Column:
    cuts = [c if isinstance(c, Column) else F.lit(float(c)) for c in (p_low, box_high, path_high)]
    return _sure(
        (col(verdict) == "no_tb") & (col(p) < cuts[0]) & (col(box_max) >= cuts[1]) & (col(path_max) >= cuts[2])
    )


def scar_tag_match(tags) -> Column:
    """Any element contains, ignoring case, any of the scar tags."""

    def hit(tag: Column) -> Column:
        out = F.lit(False)
        for t in K.SCAR_TAGS:
            out = out | F.contains(F.lower(tag), F.lit(t))
        return out

    return _sure(F.exists(col(tags), hit))


def record_scar_fires(verdict, score, scar_score, tags) -> Column:
    scar = _sure(col(scar_score) >= F.lit(K.RECORD_SCAR_CUT)) | scar_tag_match(tags)
    return _sure((col(verdict) == "no_tb") & (col(score) > F.lit(K.RECORD_SCORE_FLOOR)) & scar)


def raised(verdict, fires: Column) -> Column:
    return F.when(fires, "abstain").otherwise(col(verdict))


def activity_verdict(p, s, tau_low, tau_high, seq_high: float = K.SEQ_HIGH) -> Column:
    """Struct (verdict, activity): the second score can raise NO to UNDETERMINED, never clear."""
    p, s, lo, hi = col(p), col(s), col(tau_low), col(tau_high)
    verdict = (
        F.when(p >= hi, "YES").when((p >= lo) | (s >= F.lit(seq_high)), "UNDETERMINED").otherwise("NO")
    )
    activity = (
        F.when(verdict == "YES", "active-suspect")
        .when(verdict == "NO", "none-on-screen")
        .otherwise("indeterminate")
    )
    return F.struct(verdict.alias("verdict"), activity.alias("activity"))


def review_band_escalation(df: DataFrame, keys: Sequence[str], p: str, s: str, tau_high: float) -> DataFrame:
    """Negatives only: over-calls moved to review in [tau_high, min(.95, tau_high + .25)) and the FPR left."""
    top = min(0.95, tau_high + 0.25)
    called = F.col(p) >= F.lit(tau_high)
    moved = called & (F.col(p) < F.lit(top)) & (F.col(s) >= F.lit(0.5))
    return (
        df.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(called).alias("n_fp"),
            F.count_if(moved).alias("n_escalated"),
        )
        .withColumn("fpr", floored_ratio("n_fp", "n"))
        .withColumn("net_fpr", floored_ratio(F.col("n_fp") - F.col("n_escalated"), "n"))
    )


def verifier_trigger_local(p, s_inactive) -> Column:
    p = col(p)
    return _sure(p.between(K.VERIFIER_LOW, K.VERIFIER_HIGH)) | _sure(col(s_inactive) >= F.lit(K.SCAR_ESCALATE))


def verifier_trigger_record(band, tags, score) -> Column:
    return (
        _sure(col(band) == "low") | scar_tag_match(tags) | _sure(col(score).between(K.VERIFIER_LOW, K.VERIFIER_HIGH))
    )


def confidence_ramp(p, thr) -> Column:
    """round(clamp(50 + distance / span * 45, 5, 95)), halves up."""
    p, t = col(p), col(thr)
    span = F.greatest(F.lit(0.001), F.when(p >= t, F.lit(1.0) - t).otherwise(t))
    return half_up(clamp(F.lit(50.0) + (p - t) / span * F.lit(45.0), 5, 95))


def confidence_band_score(band, score) -> Column:
    b, s = col(band), col(score)
    base = F.when(b == "high", 75.0).when(b == "medium", 55.0).otherwise(35.0)
    return F.greatest(F.lit(0), F.least(F.lit(90), half_up(base + F.abs(s - 0.5) * 2.0 * 15.0)))


def band_uncertainty(band) -> Column:
    b = col(band)
    return F.when(b == "low", 0.3).when(b == "medium", 0.15).otherwise(0.05)


def guardrail_reasons(confidence, std, top1, disagreement, fallbacks) -> Column:
    """Array of tripped guardrails; a missing nearest neighbour counts as similarity 1."""
    near = F.coalesce(col(top1), F.lit(1.0))
    return F.array_compact(
        F.array(
            F.when(col(confidence) < K.GUARD_MIN_CONFIDENCE, "confidence"),
            F.when(col(std) > K.GUARD_MAX_STD, "std"),
            F.when((near < K.GUARD_MIN_TOP1) & (col(disagreement) > K.GUARD_MAX_DISAGREE), "retrieval"),
            F.when(col(fallbacks) >= K.GUARD_MAX_FALLBACKS, "replicate"),
        )
    )


def ensemble_stats(members: DataFrame, key: str, prob: str = "prob") -> DataFrame:
    """Mean, population std and spread over present members of each item."""
    n = F.count(prob)
    return members.groupBy(key).agg(
        n.alias("n_members"),
        F.avg(prob).alias("mean_prob"),
        F.coalesce(F.stddev_pop(prob), F.lit(0.0)).alias("std"),
        F.when(n > 1, F.max(prob) - F.min(prob)).otherwise(F.lit(0.0)).alias("disagreement"),
    )


def rule_threshold_sweep(
    df: DataFrame, p: str, box: str, path: str, label: str, grid: Sequence[tuple[float, float, float]],
) -> DataFrame:
    """Catch and false-abstain counts per (p_low, box_high, path_high); combined map-side per grid cell."""
    cells = F.array(
        *[F.struct(F.lit(a).alias("p_low"), F.lit(b).alias("box_high"), F.lit(c).alias("path_high")) for a, b, c in grid]
    )
    each = df.select(p, box, path, label, F.explode(cells).alias("g")).select("*", "g.*")
    fires = (F.col(p) < F.col("p_low")) & (F.col(box) >= F.col("box_high")) & (F.col(path) >= F.col("path_high"))
    return each.groupBy("p_low", "box_high", "path_high").agg(
        F.count_if(fires & (F.col(label) == 1)).alias("catch"),
        F.count_if(fires & (F.col(label) == 0)).alias("false_abstain"),
    )


def severity_bucket(v) -> Column:
    v = col(v)
    return F.when(v >= 0.5, "high").when(v >= 0.2, "mid").otherwise("low")


def triad(v) -> Column:
    """Zone colour class of a clamped score."""
    s = clamp(v, 0, 1)
    return F.when(s < 0.2, "no_tb").when(s < 0.5, "abstain").otherwise("tb")


def fallback_rate(df: DataFrame, keys: Sequence[str], fell_back: Column, selected: Column) -> DataFrame:
    rate = F.avg(F.when(selected, fell_back.cast("double")))
    return df.groupBy(*keys).agg(F.coalesce(rate, F.lit(0.0)).alias("fallback_rate"))


def classify_failure(status, body) -> Column:
    """State tag of a failed call from its status code and body text."""
    s, low = col(status), F.lower(col(body))
    retired = s.isin(400, 404, 410) & (
        F.contains(low, F.lit("model not supported by provider"))
        | F.contains(low, F.lit("no longer supported"))
        | F.contains(low, F.lit("model not found"))
        | F.contains(low, F.lit("deprecated"))
    )
    return (
        F.when(s.isin(401, 403), "unauthorized")
        .when(s == 429, "rate-limited")
        .when(_sure(retired), "model-unsupported")
        .otherwise("other-error")
    )


def combine_local(df: DataFrame) -> DataFrame:
    """Engine verdict -> verifier check -> scar rule -> evidence rule.

    Reads verdict, safety_net, verifier_screen (NULL = none ran), tb_prob,
    s_inactive, box_max, path_max, threshold. Adds final_verdict, confidence,
    auto_abstained, reasons and abstain_reason.
    """
    base_screen = verdict_to_screen("verdict")
    disagreed = _sure(F.col("verifier_screen").isNotNull() & (F.col("verifier_screen") != base_screen))
    staged = df.withColumn("__disagreed", disagreed).withColumn("__v1", raised("verdict", F.col("__disagreed")))
    staged = staged.withColumn("__scar", scar_fires("__v1", "tb_prob", "s_inactive"))
    staged = staged.withColumn("__v2", raised("__v1", F.col("__scar")))
    staged = staged.withColumn("__evidence", evidence_fires("__v2", "tb_prob", "box_max", "path_max"))
    final = raised("__v2", F.col("__evidence"))
    reasons = F.array_compact(
        F.array(
            F.when(F.length("safety_net") > 0, F.concat(F.lit("server safety net: "), F.col("safety_net"))),
            F.when(
                F.col("__disagreed"),
                F.concat(
                    F.lit("gpt verifier disagreed (local="), base_screen,
                    F.lit(", verifier="), F.col("verifier_screen"), F.lit(")"),
                ),
            ),
            F.when(F.col("__scar"), F.lit(f"client safety net escalated: {K.SCAR_REASON}")),
            F.when(F.col("__evidence"), F.lit(f"client safety net escalated: {K.EVIDENCE_REASON}")),
        )
    )
    out = staged.withColumn("final_verdict", final).withColumn("reasons", reasons)
    return _finish(out, "verdict", "safety net or verifier flagged for review").withColumn(
        "confidence", confidence_ramp("tb_prob", "threshold")
    )


def combine_record(df: DataFrame) -> DataFrame:
    """Record verdict -> verifier check -> stated limitation -> scar rule.

    Reads screen, verifier_screen (NULL = none ran), limitation, score, scar_score,
    tags, band. Adds model_verdict, final_verdict, confidence, auto_abstained,
    reasons, abstain_reason.
    """
    disagreed = _sure(F.col("verifier_screen").isNotNull() & (F.col("verifier_screen") != F.col("screen")))
    limited = _sure(F.length("limitation") > 0)
    staged = df.withColumn("model_verdict", screen_to_verdict("screen")).withColumn("__disagreed", disagreed)
    v1 = raised("model_verdict", F.col("__disagreed"))
    staged = staged.withColumn("__limited", limited).withColumn("__v1", v1)
    staged = staged.withColumn(
        "__v2", F.when(F.col("__limited"), most_cautious("__v1", F.lit("abstain"))).otherwise(F.col("__v1"))
    )
    staged = staged.withColumn("__scar", record_scar_fires("__v2", "score", "scar_score", "tags"))
    reasons = F.array_compact(
        F.array(
            F.when(
                F.col("__disagreed"),
                F.concat(
                    F.lit("consistency check disagreed (primary="), F.col("screen"),
                    F.lit(", verifier="), F.col("verifier_screen"), F.lit(")"),
                ),
            ),
            F.when(F.col("__limited"), F.concat(F.lit("VLM limitation: "), F.col("limitation"))),
            F.when(F.col("__scar"), F.lit(K.RECORD_SCAR_REASON)),
        )
    )
    out = staged.withColumn("final_verdict", raised("__v2", F.col("__scar"))).withColumn("reasons", reasons)
    return _finish(out, "model_verdict", "weak or uncertain evidence").withColumn(
        "confidence", confidence_band_score("band", "score")
    )


def _finish(df: DataFrame, base: str, fallback_reason: str) -> DataFrame:
    final = F.col("final_verdict")
    text = F.array_join("reasons", "; ")
    said = F.when(F.length(text) > 0, text).otherwise(F.lit(fallback_reason))
    out = df.withColumn("auto_abstained", (final == "abstain") & (F.col(base) != "abstain")).withColumn(
        "abstain_reason", F.when(final == "abstain", F.concat(F.lit("Refer: "), said, F.lit(".")))
    )
    return out.drop(*[c for c in out.columns if c.startswith("__")])
