"""Calibration, fusion and conformal bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import constants as K
from plumbline.functions.hashing import unit
from plumbline.functions.maths import clamp_prob, logit, sigmoid, tempered
from plumbline.functions.ranking import attach
from plumbline.operators import calibrate as C
from plumbline.operators import splits as S
from plumbline.plans.common import SP, T, rounded, with_p
from plumbline.plans.q_splits import srank
from plumbline.plans.registry import query
from plumbline.plans.views import ssig, su


def snll(y: str, p: str, eps: str = "1e-7") -> str:
    pc = f"greatest({eps}, least(1-{eps}, {p}))"
    return f"(-({y}*ln({pc}) + (1-{y})*ln(1-{pc})))"


def slogit(p: str) -> str:
    pc = f"greatest(1e-6, least(1-1e-6, {p}))"
    return f"ln({pc}/(1-{pc}))"


@query("sigmoid_logit", f"""SELECT id, round({ssig('logit')}, 8) AS p, round({slogit(ssig('logit'))}, 6) AS z,
greatest(1e-6, least(1-1e-6, logit)) AS clamped FROM scored""", "scored")
def _sig(v):
    out = v.scored.select("id", sigmoid("logit").alias("p"), logit(sigmoid("logit")).alias("z"),
                          clamp_prob("logit").alias("clamped"))
    return rounded(rounded(out, "p", digits=8), "z")


@query("apply_temperature", f"SELECT id, round({ssig(f'logit/{T}')}, 8) AS p, round({ssig('logit/1e-3')}, 8) AS p_floor FROM scored",
       "scored")
def _temp(v):
    out = v.scored.select("id", tempered("logit", K.LOCKED_T).alias("p"), tempered("logit", 1e-9).alias("p_floor"))
    return rounded(out, "p", "p_floor", digits=8)


@query("nll", f"SELECT lang, round(avg({snll('label', 'p')}), 6) AS nll FROM sp GROUP BY lang", "scored", SP)
def _nll(v):
    return rounded(C.nll(with_p(v.scored), ["lang"]), "nll")


@query("fit_temperature_grid", """SELECT site, round(arg_min(t, (nll, t)), 6) AS temperature, round(min(nll), 6) AS nll FROM per GROUP BY site""",
       "scored", f"""per AS (SELECT site, t, avg({snll('label', ssig('logit/t'))}) AS nll FROM scored,
       (SELECT i*(4.5e0/90)+0.5e0 AS t FROM range(91) r(i)) GROUP BY site, t)""")
def _tgrid(v):
    return rounded(C.fit_temperature_grid(v.scored, ["site"]), "temperature", "nll")


def refine_sql(table: str, key: str, z: str, eps: str) -> str:
    out, prev = [], f"(SELECT DISTINCT {key}, 0.05e0 AS lo, 20e0 AS hi FROM {table})"
    for i in range(C.REFINE_LEVELS):
        out.append(f"""g{i} AS (SELECT {key}, lo, hi, lo + i*(hi-lo)/100e0 AS t, avg({snll('label', ssig(f'({z})/(lo + i*(hi-lo)/100e0)'), eps)}) AS nll
        FROM {table} JOIN {prev} USING ({key}), range(101) r(i) GROUP BY ALL)""")
        out.append(f"""f{i} AS (SELECT {key}, arg_min(t, (nll, t)) AS temperature, min(nll) AS nll,
        greatest(0.05e0, arg_min(t, (nll, t)) - any_value(hi-lo)/100e0) AS lo, least(20e0, arg_min(t, (nll, t)) + any_value(hi-lo)/100e0) AS hi
        FROM g{i} GROUP BY {key})""")
        prev = f"f{i}"
    return ", ".join(out)


@query("fit_temperature_bounded", "SELECT site, round(temperature, 3) AS temperature, round(nll, 6) AS nll FROM f2", "scored",
       refine_sql("scored", "site", "logit", "1e-7"))
def _tbound(v):
    return rounded(rounded(C.fit_temperature_bounded(v.scored, ["site"]), "nll"), "temperature", digits=3)


@query("fit_platt")
def _platt(v):
    rows = []
    for m in K.MEMBER_WEIGHTS:
        rows.append((m, *C.fit_platt(v.member_probs.filter(F.col("member") == m))))
    return rounded(v.spark.createDataFrame(rows, "member string, a double, b double"), "a", "b", digits=4)


@query("select_calibration")
def _select(v):
    return rounded(C.select_calibration(v.member_probs), "t", "a", "b", "nll_raw", "nll_cal", digits=3)


@query("apply_calibration", f"""SELECT id, member, round({ssig(f"CASE WHEN member = 'vlm' THEN 0.9e0*({slogit('prob')}) - 0.2e0 ELSE ({slogit('prob')})/1.3e0 END")}, 8) AS p
FROM member_probs""", "member_probs")
def _apply(v):
    method = F.when(F.col("member") == "vlm", "platt").otherwise("temperature")
    p = C.apply_calibration("prob", method, F.lit(0.9), F.lit(-0.2), F.lit(1.3))
    return rounded(v.member_probs.select("id", "member", p.alias("p")), "p", digits=8)


W = "CASE member WHEN 'tb' THEN 0.2e0 WHEN 'vlm' THEN 0.8e0 ELSE 0e0 END"


@query("effective_weights", f"""SELECT id, member, round(w / CASE WHEN sum(w) OVER (PARTITION BY id) = 0 THEN 1 ELSE sum(w) OVER (PARTITION BY id) END, 6) AS weight
FROM (SELECT id, member, {W} AS w FROM member_probs)""", "member_probs")
def _weights(v):
    out = C.effective_weights(v.member_probs, "id", K.MEMBER_WEIGHTS).select("id", "member", "weight")
    return rounded(out, "weight")


FUSED = f"""fz AS (SELECT id, count(*) AS n_members, sum({W}*({slogit('prob')})) / CASE WHEN sum({W}) = 0 THEN 1 ELSE sum({W}) END AS z,
any_value(label) AS label FROM member_probs GROUP BY id), fused AS (SELECT id, n_members, label, {ssig('z')} AS fused FROM fz)"""


@query("fuse_log_odds", "SELECT id, n_members, round(fused, 6) AS fused FROM fused", "member_probs", FUSED)
def _fuse(v):
    return rounded(C.fuse_log_odds(v.member_probs, "id", K.MEMBER_WEIGHTS), "fused")


@query("fit_fusion_weights")
def _fusion(v):
    weights, bias = C.fit_fusion_weights(v.member_probs)
    rows = [*weights.items(), ("bias", bias)]
    return rounded(v.spark.createDataFrame(rows, "term string, weight double"), "weight", digits=4)


@query("late_fusion_gain", f"""SELECT id, round(logit + CASE WHEN {su('has', 'id')} < 0.7e0 THEN ln(1+exp(0.4e0))*4e0*({su('clin', 'id')}-0.5e0) ELSE 0 END, 6) AS fused_logit
FROM scored""", "scored")
def _late(v):
    clin = 4.0 * (unit("clin", "id") - 0.5)
    out = C.late_fusion_gain("logit", clin, F.lit(0.4), unit("has", "id") < 0.7)
    return rounded(v.scored.select("id", out.alias("fused_logit")), "fused_logit")


@query("log_odds_blend", """SELECT a.id, round(ln(1+exp(0.5e0))*a.logit + ln(1+exp(-0.3e0))*b.logit, 6) AS blended
FROM scored a JOIN scored_b b USING (id)""", "scored scored_b")
def _blend(v):
    d = v.scored.select("id", "logit").join(v.scored_b.select("id", F.col("logit").alias("logit_b")), "id")
    return rounded(d.select("id", C.log_odds_blend([(F.col("logit"), 0.5), (F.col("logit_b"), -0.3)]).alias("blended")),
                   "blended")


def band_sql(table: str, key: str, s: str, alpha: str = "0.92e0", gamma: str = "0.1e0", name: str = "band") -> str:
    return f"""{name}o AS (SELECT {key} AS k, label, {s} AS s, row_number() OVER (PARTITION BY {key}, label ORDER BY {s}) AS rn,
    count(*) OVER (PARTITION BY {key}, label) AS n FROM {table}),
    {name}b AS (SELECT k, coalesce(max(s) FILTER (label=1 AND rn = floor((1-{alpha})*(n+1))), 0e0) AS lo,
    coalesce(max(s) FILTER (label=0 AND floor({gamma}*(n+1)) > 0 AND rn = n - floor({gamma}*(n+1)) + 1), 1e0) AS hi,
    coalesce(max(n) FILTER (label=1), 0) AS n_pos, coalesce(max(n) FILTER (label=0), 0) AS n_neg FROM {name}o GROUP BY k),
    {name} AS (SELECT k, greatest(0, least(1, lo)) AS tau_low, greatest(0, least(1, greatest(hi, lo))) AS tau_high, n_pos, n_neg,
    n_pos < 20 OR n_neg < 20 AS incomplete FROM {name}b)"""


@query("conformal_thresholds", """SELECT k AS lang, round(tau_low, 6) AS tau_low, round(tau_high, 6) AS tau_high, n_pos, n_neg, incomplete FROM band""",
       "scored", SP + ", " + band_sql("sp", "lang", "p"))
def _conformal(v):
    return rounded(C.conformal_thresholds(with_p(v.scored), ["lang"], "p"), "tau_low", "tau_high")


@query("conformal_thresholds_fused", """SELECT round(tau_low, 6) AS tau_low, round(tau_high, 6) AS tau_high, n_pos, n_neg, incomplete FROM band""",
       "member_probs", FUSED + ", " + band_sql("fused", "0", "fused", "0.9e0"))
def _conformal_fused(v):
    labels = v.member_probs.select("id", "label").distinct()
    fused = C.fuse_log_odds(v.member_probs, "id", K.MEMBER_WEIGHTS).join(labels, "id")
    return rounded(C.conformal_thresholds(fused, [], "fused", alpha=0.9), "tau_low", "tau_high")


@query("vlm_safety_threshold", """SELECT member, round(CASE WHEN n >= 20 THEN s ELSE 0.5e0 END, 6) AS threshold, n AS n_pos FROM (
SELECT member, prob AS s, row_number() OVER (PARTITION BY member ORDER BY prob) AS rn, count(*) OVER (PARTITION BY member) AS n
FROM member_probs WHERE label = 1) WHERE rn = greatest(1, floor((1-0.92e0)*(n+1)))""", "member_probs")
def _safety(v):
    return rounded(C.safety_threshold(v.member_probs, ["member"], "prob"), "threshold")


@query("fit_calibration")
def _fit(v):
    out = C.fit_calibration(v.member_probs)
    return rounded(out, "t", "a", "b", "weight", "bias", "tau_low", "tau_high", "safety_threshold", digits=3)


@query("lock_protocol", f"""SELECT {T} AS t, {K.LOCKED_THR!r}e0 AS thr_at_95sens, 0.2e0 AS borderline_low, 0.7126e0 AS s_inactive_escalate,
0.88e0 AS asymmetric_evidence_thr, 7 AS seed, 0.2e0 AS cal_frac, count(*) FILTER (rn <= q) AS n_cal, count(*) FILTER (rn > q) AS n_eval FROM (
SELECT rn, CASE WHEN n > 1 THEN greatest(1, round_even(n*0.2e0, 0)) ELSE 0 END AS q FROM (SELECT {srank('source, label', '7')},
count(*) OVER (PARTITION BY source, label) AS n FROM scored))""", "scored")
def _lock(v):
    split = S.calibration_split(v.scored, ["source", "label"])
    return C.lock_protocol(split, K.LOCKED_T, K.LOCKED_THR, K.LOCKED_LOW, K.LOCKED_SEED, K.LOCKED_CAL_FRAC)


@query("undetermined_rate", """SELECT lang, round(avg((p >= tau_low AND p < tau_high)::INT), 6) AS undetermined_rate
FROM sp JOIN band ON lang = k GROUP BY lang""", "scored", SP + ", " + band_sql("sp", "lang", "p"))
def _undetermined(v):
    d = with_p(v.scored)
    band = C.conformal_thresholds(d, ["lang"], "p").select("lang", "tau_low", "tau_high")
    return rounded(C.undetermined_rate(attach(d, band, ["lang"]), ["lang"], "p", "tau_low", "tau_high"), "undetermined_rate")


@query("softmax_weighted_pool", """SELECT id, gx, round(sum(exp(s-m)*x)/sum(exp(s-m)), 6) AS pooled FROM (
SELECT id, gx, x, s, max(s) OVER (PARTITION BY id, gx) AS m FROM (SELECT *, sum(x) OVER (PARTITION BY id, gy) AS s FROM cells)) GROUP BY id, gx""",
       "cells")
def _softmax(v):
    from pyspark.sql import Window

    scored = v.cells.withColumn("s", F.sum("x").over(Window.partitionBy("id", "gy")))
    return rounded(C.softmax_weighted_pool(scored, ["id", "gx"], "s", "x"), "pooled")


@query("gated_soft_or", f"""SELECT id, round(max(m) + ln(sum(exp(g-m))), 6) AS soft_or FROM (SELECT id, g, max(g) OVER (PARTITION BY id) AS m FROM (
SELECT id, (0.25e0 + 0.75e0*{ssig("(gy-3)::DOUBLE")})*sum(x) AS g FROM cells GROUP BY id, gy)) GROUP BY id""", "cells")
def _soft_or(v):
    zones = v.cells.groupBy("id", "gy").agg(F.sum("x").alias("zl")).withColumn("gate", (F.col("gy") - 3).cast("double"))
    return rounded(C.gated_soft_or(zones, "id", "zl", "gate"), "soft_or")


PASSES = f"""passes AS (SELECT id, pass, CASE WHEN {su('pfail', 'id', 'pass')} >= 0.05e0 THEN {ssig(f"logit + 0.5e0*({su('pn', 'id', 'pass')}-0.5e0)")} END AS prob
FROM scored, range({{k}}) r(pass))"""


def passes(v, k: int):
    each = v.scored.select("id", "logit", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("pass"))
    noisy = sigmoid(F.col("logit") + 0.5 * (unit("pn", "id", "pass") - 0.5))
    return each.select("id", "pass", F.when(unit("pfail", "id", "pass") >= 0.05, noisy).alias("prob"))


@query("tta_mean", """SELECT id, count(prob) AS n_passes, round(CASE WHEN count(prob) = 5 THEN avg(prob) END, 6) AS mean_prob,
count(prob) = 5 AS complete FROM passes GROUP BY id""", "scored", PASSES.format(k=5))
def _tta(v):
    return rounded(C.tta_mean(passes(v, 5), "id"), "mean_prob")


@query("self_consistency", """SELECT id, count(prob) AS n_ok, round(avg(prob), 6) AS mean_prob, round(stddev_pop(prob), 6) AS std,
count(prob) = 0 AS failed FROM passes GROUP BY id""", "scored", PASSES.format(k=3))
def _selfc(v):
    return rounded(C.self_consistency(passes(v, 3), "id"), "mean_prob", "std")
