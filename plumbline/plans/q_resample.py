"""Resampling and inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import constants as K
from plumbline.functions.hashing import poisson_cuts, unit
from plumbline.operators import joins as J
from plumbline.operators import metrics as M
from plumbline.operators import resample as B
from plumbline.operators import splits as S
from plumbline.plans.common import ROC, SP, THR, exact_bounds, rounded, with_p
from plumbline.plans.q_metrics import AUC_OF
from plumbline.plans.q_splits import RECAL, srank
from plumbline.plans.registry import query
from plumbline.plans.views import su

N_BOOT = 2000
N_BOOT_MEAN = 1000


def reps_sql(table: str, columns: str, key: str, seed: int, n: int = N_BOOT, name: str = "rb") -> str:
    """Poisson replicate weights of `table`."""
    u = f"(('0x' || substr(md5('{seed}|' || {key} || '|' || (rep // 4)), 1 + 8*(rep % 4), 8))::BIGINT / 4294967296::DOUBLE)"
    w = " + ".join(f"(u >= {c!r}e0)::INT" for c in poisson_cuts())
    return f"""{name} AS MATERIALIZED (SELECT * FROM (SELECT {columns}, rep, {w.replace('u >=', 'u >=')} AS w FROM (
    SELECT {columns}, rep, {u} AS u FROM {table}, range({n}) r(rep))) WHERE w > 0)"""


def rep_roc(table: str, k: str, s: str, name: str = "") -> str:
    """Weighted ROC steps per (k, rep)."""
    return f"""h{name} AS (SELECT {k} AS k, rep, {s} AS s, sum(w) FILTER (label=1) AS np0, sum(w) FILTER (label=0) AS nn0 FROM {table} GROUP BY ALL),
    c{name} AS (SELECT k, rep, s, coalesce(np0,0)::BIGINT AS np, coalesce(nn0,0)::BIGINT AS nn FROM h{name}),
    d{name} AS (SELECT *, sum(np) OVER up AS tp, sum(nn) OVER up AS fp, sum(np) OVER (PARTITION BY k, rep) AS allp, sum(nn) OVER (PARTITION BY k, rep) AS alln
      FROM c{name} WINDOW up AS (PARTITION BY k, rep ORDER BY s DESC)),
    w{name} AS MATERIALIZED (SELECT k, rep, np::BIGINT AS np, nn::BIGINT AS nn, fp::BIGINT AS fp, allp::BIGINT AS allp, alln::BIGINT AS alln,
      tp::DOUBLE/nullif(allp,0) AS tpr, fp::DOUBLE/nullif(alln,0) AS fpr, (tp-np)::DOUBLE/nullif(allp,0) AS tpr0, (fp-nn)::DOUBLE/nullif(alln,0) AS fpr0 FROM d{name}),
    a{name} AS (SELECT k, rep, sum(np*(alln-fp+nn/2e0))/nullif(max(allp)::DOUBLE*max(alln),0) AS auc FROM w{name} GROUP BY k, rep)"""


def ci(value: str, prefix: str) -> str:
    return f"round(quantile_cont({value}, 0.025), 6) AS {prefix}_lo, round(quantile_cont({value}, 0.975), 6) AS {prefix}_hi"


@query("bootstrap_auc_ci", f"""SELECT lang, n_pos, n_neg, round(p0.auc, 6) AS auc, auc_lo, auc_hi FROM (
SELECT k AS lang, max(allp) AS n_pos, max(alln) AS n_neg, {AUC_OF} AS auc FROM roc GROUP BY k) p0
JOIN (SELECT k AS lang, {ci('auc', 'auc')} FROM a1 WHERE auc IS NOT NULL GROUP BY k) USING (lang)""", "scored",
       SP + ", " + ROC.format(k="lang", s="logit", t="sp") + ", " + reps_sql("scored", "id, lang, label, logit", "id", 11) + ", " + rep_roc("rb", "lang", "logit", "1"))
def _auc_ci(v):
    return rounded(B.bootstrap_auc_ci(v.scored, ["lang"], n_boot=N_BOOT), "auc", "auc_lo", "auc_hi")


@query("group_bootstrap", f"""SELECT n_pos, n_neg, n_groups, round(auc, 6) AS auc, round(pauc, 6) AS pauc, round(sens_at_spec, 6) AS sens_at_spec,
auc_lo, auc_hi, pauc_lo, pauc_hi, sens_lo, sens_hi FROM (SELECT max(allp) AS n_pos, max(alln) AS n_neg, {AUC_OF} AS auc,
0.5e0*(1+(coalesce(sum((least(fpr,0.2e0)-fpr0)*(tpr0 + tpr0 + (tpr-tpr0)*(least(fpr,0.2e0)-fpr0)/(fpr-fpr0))/2e0) FILTER (fpr > fpr0 AND fpr0 < 0.2e0), 0)-0.02e0)/0.18e0) AS pauc,
coalesce(max(tpr0 + (tpr-tpr0)/(fpr-fpr0)*((1-0.7e0)-fpr0)) FILTER (fpr0 <= 1-0.7e0 AND fpr > 1-0.7e0), 1e0) AS sens_at_spec FROM roc),
(SELECT count(DISTINCT grp) AS n_groups FROM scored),
(SELECT {ci('auc', 'auc')}, {ci('pauc', 'pauc')}, {ci('sens', 'sens')} FROM (SELECT rep, sum(np*(alln-fp+nn/2e0))/nullif(max(allp)::DOUBLE*max(alln),0) AS auc,
0.5e0*(1+(coalesce(sum((least(fpr,0.2e0)-fpr0)*(tpr0 + tpr0 + (tpr-tpr0)*(least(fpr,0.2e0)-fpr0)/(fpr-fpr0))/2e0) FILTER (fpr > fpr0 AND fpr0 < 0.2e0), 0)-0.02e0)/0.18e0) AS pauc,
coalesce(max(tpr0 + (tpr-tpr0)/(fpr-fpr0)*((1-0.7e0)-fpr0)) FILTER (fpr0 <= 1-0.7e0 AND fpr > 1-0.7e0), 1e0) AS sens FROM w1 GROUP BY rep) WHERE auc IS NOT NULL)""",
       "scored", SP + ", " + ROC.format(k="0", s="logit", t="sp") + ", " + reps_sql("scored", "grp, label, logit", "grp", 11) + ", " + rep_roc("rb", "0", "logit", "1"))
def _group(v):
    out = B.group_bootstrap(v.scored, n_boot=N_BOOT)
    return rounded(out, "auc", "pauc", "sens_at_spec", "auc_lo", "auc_hi", "pauc_lo", "pauc_hi", "sens_lo", "sens_hi")


@query("bootstrap_rate_ci", f"""SELECT site, round(p0.rate, 6) AS rate, rate_lo, rate_hi FROM (SELECT site, avg((p >= {THR})::INT) AS rate FROM sp WHERE label = 1 GROUP BY site) p0
JOIN (SELECT site, {ci('rate', 'rate')} FROM (SELECT site, rep, sum(w*h)::DOUBLE/sum(w) AS rate FROM rb GROUP BY ALL) GROUP BY site) USING (site)""", "scored",
       SP + f", ph AS (SELECT site, id, (p >= {THR})::INT AS h FROM sp WHERE label = 1), " + reps_sql("ph", "site, id, h", "id", 1))
def _rate(v):
    out = B.bootstrap_rate_ci(with_p(v.scored), ["site"], F.col("p") >= K.LOCKED_THR, F.col("label") == 1, N_BOOT, ident="id")
    return rounded(out, "rate", "rate_lo", "rate_hi")


@query("bootstrap_mean_ci", f"""SELECT lang, n, round(p0.mean, 6) AS mean, mean_lo, mean_hi FROM (SELECT lang, avg(x) AS mean, count(*) AS n FROM mv GROUP BY lang) p0
JOIN (SELECT lang, {ci('mean', 'mean')} FROM (SELECT lang, rep, sum(w*x)/sum(w) AS mean FROM rb GROUP BY ALL) GROUP BY lang) USING (lang)""", "scored",
       f"mv AS (SELECT lang, id, logit AS x FROM scored WHERE {su('gap', 'id')} >= 0.2e0), " + reps_sql("mv", "lang, id, x", "id", 7, N_BOOT_MEAN))
def _mean(v):
    d = v.scored.withColumn("x", F.when(unit("gap", "id") >= 0.2, F.col("logit")))
    return rounded(B.bootstrap_mean_ci(d, ["lang"], "x", N_BOOT_MEAN), "mean", "mean_lo", "mean_hi")


PAIR = "pr AS (SELECT a.id, a.label, a.logit, b.logit AS logit_b FROM scored a JOIN scored_b b USING (id))"


@query("paired_bootstrap_delta", f"""SELECT * FROM (SELECT {ci('b.auc - a.auc', 'd_auc')} FROM a1 a JOIN a2 b USING (rep) WHERE a.auc IS NOT NULL),
(SELECT {ci('d', 'd_spec')} FROM (SELECT rep, sum(w*((logit >= 0.5e0)::INT - (logit_b >= 0.5e0)::INT))::DOUBLE/sum(w) AS d FROM rb WHERE label = 0 GROUP BY rep))""",
       "scored scored_b", PAIR + ", " + reps_sql("pr", "id, label, logit, logit_b", "id", 2) + ", " + rep_roc("rb", "0", "logit", "1") + ", " + rep_roc("rb", "0", "logit_b", "2"))
def _paired(v):
    d = J.paired_scores(v.scored, v.scored_b)
    out = B.paired_bootstrap_delta(d, "logit", "logit_b", F.col("logit") >= 0.5, n_boot=N_BOOT, thr_b=F.col("logit_b") >= 0.5)
    return rounded(out, "d_auc_lo", "d_auc_hi", "d_spec_lo", "d_spec_hi")


THR_ROC = """SELECT site, split, coalesce(max(p) FILTER (tpr >= 0.95e0), 0.5e0) AS threshold FROM (SELECT site, split, p,
 sum(np) OVER (PARTITION BY site, split ORDER BY p DESC)::DOUBLE / nullif(sum(np) OVER (PARTITION BY site, split), 0) AS tpr
 FROM (SELECT site, split, p, count(*) FILTER (label=1) AS np FROM resplit WHERE role = 'cal' GROUP BY ALL)) GROUP BY ALL"""
THR_QUANTILE = """SELECT site, split, coalesce(max(p) FILTER (label = 1 AND rn = greatest(0, floor((1 - 0.95e0)*n))::BIGINT + 1), 0.5e0) AS threshold
 FROM (SELECT site, split, label, p, row_number() OVER (PARTITION BY site, split, label ORDER BY p) AS rn, count(*) OVER (PARTITION BY site, split, label) AS n
 FROM resplit WHERE role = 'cal') GROUP BY site, split"""


def recal_steps(thr: str) -> str:
    """Sensitivity and specificity of every split of the big sites at the threshold that `thr` selects from its cal rows."""
    return f"""big AS (SELECT site FROM sp GROUP BY site HAVING count(*) FILTER (label=1) >= 8 AND count(*) FILTER (label=0) >= 8),
bigrows AS (SELECT * FROM sp WHERE site IN (SELECT site FROM big)),
{RECAL.format(t='bigrows')},
thr AS ({thr}),
per AS (SELECT site, split, (count(*) FILTER (p >= threshold AND label=1))::DOUBLE/nullif(count(*) FILTER (label=1),0) AS sens,
 (count(*) FILTER (p < threshold AND label=0))::DOUBLE/nullif(count(*) FILTER (label=0),0) AS spec, count(*) FILTER (p >= threshold AND label=1) AS tp,
 count(*) FILTER (label=1) AS n_pos FROM resplit JOIN thr USING (site, split) WHERE role = 'eval' GROUP BY ALL),
mids AS (SELECT site, quantile_cont(sens, 0.5) AS m, quantile_cont(sens, 0.25) AS q25, quantile_cont(sens, 0.75) AS q75, quantile_cont(spec, 0.5) AS ms, count(*) AS n_splits
 FROM per GROUP BY site)"""


RECAL_STEPS = recal_steps(THR_ROC)
MEDIAN_SPLIT = """near AS (SELECT site, arg_min(split, (abs(sens - m), split))::INT AS median_split, arg_min(tp, (abs(sens - m), split)) AS median_tp,
arg_min(n_pos, (abs(sens - m), split)) AS median_n_pos FROM per JOIN mids USING (site) GROUP BY site), """


@query("recalibrated_operating_point", """SELECT site, round(m, 6) AS sens_median, round(q25, 6) AS sens_q25, round(q75, 6) AS sens_q75, round(ms, 6) AS spec_median, n_splits,
median_split, median_tp, median_n_pos, round(lo, 6) AS median_lo, round(hi, 6) AS median_hi FROM mids JOIN near USING (site) LEFT JOIN exact ON k = median_tp AND n = median_n_pos""",
       "scored", SP + ", " + RECAL_STEPS + ", " + MEDIAN_SPLIT + exact_bounds("SELECT median_tp AS k, median_n_pos AS n FROM near"))
def _recal(v):
    out = B.recalibrated_operating_point(with_p(v.scored), ["site"])
    return rounded(out, "sens_median", "sens_q25", "sens_q75", "spec_median", "median_lo", "median_hi")


@query("recalibrated_threshold_locked", "SELECT site, round(m, 6) AS sens_median, round(ms, 6) AS spec_median, n_splits FROM mids", "scored",
       SP + ", " + recal_steps(THR_QUANTILE))
def _recal_locked(v):
    """The temperature stays the locked one; only the threshold is refitted, at a quantile of the cal slice's positives."""
    out = B.recalibrated_operating_point(with_p(v.scored), ["site"], method="quantile")
    return rounded(out.select("site", "sens_median", "spec_median", "n_splits"), "sens_median", "spec_median")


PERMUTED = ", ".join(
    f"""pm{k} AS (SELECT {k} AS perm, logit, permuted AS label FROM (SELECT logit, {srank('', f'row{k}')} FROM scored) JOIN (SELECT label AS permuted, {srank('', f'lab{k}')} FROM scored) USING (rn))"""
    for k in range(3)) + ", pm AS (SELECT * FROM pm0 UNION ALL SELECT * FROM pm1 UNION ALL SELECT * FROM pm2)"


@query("permutation_check", f"""SELECT count(*) AS n_perms, round(avg(auc), 6) AS mean_auc, round(min(auc), 6) AS lo, round(max(auc), 6) AS hi,
CASE WHEN avg(auc) < 0.6 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT k, {AUC_OF} AS auc FROM roc GROUP BY k)""", "scored",
       PERMUTED + ", " + ROC.format(k="perm", s="logit", t="pm"))
def _perm(v):
    rows = None
    for k in range(3):
        one = S.permute_labels(v.scored, k).select(F.lit(k).alias("perm"), "logit", "permuted")
        rows = one if rows is None else rows.unionByName(one)
    return rounded(B.permutation_verdict(M.auc(rows, ["perm"], "logit", "permuted")), "mean_auc", "lo", "hi")


@query("pearson_within_class", """SELECT label, source, round(corr(logit, z), 6) AS r FROM (SELECT label, logit, (s.source = o.source)::INT AS z, o.source
FROM scored s JOIN (SELECT DISTINCT label, source FROM scored) o USING (label)) GROUP BY label, source""", "scored")
def _pearson(v):
    return rounded(B.pearson_within_class(v.scored), "r")


@query("spearman_rank", f"""SELECT round(avg(rho), 6) AS mean_rho, count(*) AS n FROM (SELECT id, corr(ra, rb) AS rho FROM (SELECT id,
count(*) OVER (PARTITION BY id ORDER BY x) - (count(*) OVER (PARTITION BY id, x) - 1)/2e0 AS ra,
count(*) OVER (PARTITION BY id ORDER BY u) - (count(*) OVER (PARTITION BY id, u) - 1)/2e0 AS rb FROM (SELECT id, x, {su('7', 'id', 'pos')} AS u FROM cells)) GROUP BY id)""", "cells")
def _spearman(v):
    d = S.random_baseline_scores(v.cells)
    out = B.spearman_rank(d, ["id"], "x", "random").agg(F.avg("rho").alias("mean_rho"), F.count(F.lit(1)).alias("n"))
    return rounded(out, "mean_rho")


@query("ols_residuals", """SELECT id, round(logit - (a + b*label), 6) AS residual FROM scored, (SELECT regr_slope(logit, label) AS b, regr_intercept(logit, label) AS a FROM scored)""",
       "scored")
def _ols(v):
    return rounded(B.ols_residuals(v.scored.select("id", "logit", "label"), "logit", ["label"]).select("id", "residual"), "residual")


@query("source_separability", """SELECT source, round(auc, 6) AS auc, n_rows, round(greatest(auc, 1-auc), 6) AS separability FROM (SELECT k AS source, max(allp) AS n_rows, """ + AUC_OF + """ AS auc
FROM roc GROUP BY k)""", "scored", "sx AS (SELECT o.source, logit, (s.source = o.source)::INT AS label FROM scored s, (SELECT DISTINCT source FROM scored) o), " + ROC.format(k="source", s="logit", t="sx"))
def _sep(v):
    return rounded(B.source_separability(v.scored, "logit"), "auc", "separability")


@query("source_reliance")
def _reliance(v):
    d = v.scored.withColumn("c1", unit("c1", "id")).withColumn("c2", unit("c2", "id"))
    return rounded(B.source_reliance(d, "logit", ["c1", "c2"]), "raw", "residual", "gap")
