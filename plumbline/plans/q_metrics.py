"""Classification metrics, thresholds and ROC."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import constants as K
from plumbline.functions import intervals
from plumbline.functions.hashing import unit
from plumbline.operators import metrics as M
from plumbline.plans.common import LOW, ROC, SP, THR, exact_bounds, rounded, with_p
from plumbline.plans.registry import query
from plumbline.plans.views import su

LANG = ["lang"]
ROC_LANG = SP + ", " + ROC.format(k="lang", s="logit", t="sp")
ROC_P = SP + ", " + ROC.format(k="lang", s="p", t="sp")
AUC_OF = "sum(np * (alln - fp + nn/2e0)) / (max(allp)::DOUBLE * max(alln))"

LOCKED_SQL = f"""
SELECT lang, n, n_pos, n_neg, tp, fn, fp, tn, n_abstain, n_abstain_pos, round(abstain_rate, 6) AS abstain_rate,
  round(ece, 6) AS ece, round(brier, 6) AS brier, round(tp / greatest(tp+fn, 1)::DOUBLE, 6) AS sens,
  round(tn / greatest(tn+fp, 1)::DOUBLE, 6) AS spec, round((n_neg - fp)::DOUBLE / nullif(n_neg, 0), 6) AS spec_all_rows,
  round((tp + n_abstain_pos)::DOUBLE / nullif(n_pos, 0), 6) AS effective_sens, round(auc, 6) AS auc
FROM (SELECT lang, count(*) AS n, count(*) FILTER (label=1) AS n_pos, count(*) FILTER (label=0) AS n_neg,
  count(*) FILTER (label=1 AND p >= {THR}) AS tp, count(*) FILTER (label=1 AND p < {LOW}) AS fn,
  count(*) FILTER (label=0 AND p >= {THR}) AS fp, count(*) FILTER (label=0 AND p < {LOW}) AS tn,
  count(*) FILTER (p >= {LOW} AND p < {THR}) AS n_abstain,
  count(*) FILTER (p >= {LOW} AND p < {THR} AND label=1) AS n_abstain_pos,
  avg((p >= {LOW} AND p < {THR})::INT) AS abstain_rate, avg((p - label) * (p - label)) AS brier FROM sp GROUP BY lang)
JOIN (SELECT lang, sum(n * abs(mp - my)) / sum(n) AS ece FROM (SELECT lang, {{bin}} AS b, count(*) AS n, avg(p) AS mp,
  avg(label) AS my FROM sp GROUP BY ALL) GROUP BY lang) USING (lang)
JOIN (SELECT k AS lang, {AUC_OF} AS auc FROM roc GROUP BY k) USING (lang)"""


def sbin(p: str, bins: int = 10) -> str:
    """SQL bin index on literal linspace edges."""
    step = 1.0 / bins
    arms = " ".join(
        f"WHEN {p} >= {i * step!r}e0 AND {p} < {(i + 1) * step if i < bins - 1 else 1.0!r}e0 THEN {i}"
        for i in range(bins - 1)
    )
    return f"CASE {arms} WHEN {p} >= {(bins - 1) * step!r}e0 AND {p} <= 1e0 THEN {bins - 1} END"


@query("locked_metrics", LOCKED_SQL.format(bin=sbin("p")), "scored", ROC_P)
def _locked(v):
    out = M.locked_metrics(with_p(v.scored), LANG, "p", "label", K.LOCKED_THR, K.LOCKED_LOW)
    return rounded(out, "abstain_rate", "ece", "brier", "sens", "spec", "spec_all_rows", "effective_sens", "auc")


@query("auc", f"SELECT k AS lang, max(allp) AS n_pos, max(alln) AS n_neg, round({AUC_OF}, 6) AS auc FROM roc GROUP BY k",
       "scored", ROC_LANG)
def _auc(v):
    return rounded(M.auc(v.scored, LANG, "logit"), "auc")


@query("confusion", f"""SELECT source, count(*) FILTER (p >= {THR} AND label=1) AS tp, count(*) FILTER (p >= {THR} AND label=0) AS fp,
count(*) FILTER (p < {THR} AND label=0) AS tn, count(*) FILTER (p < {THR} AND label=1) AS fn FROM sp GROUP BY source""",
       "scored", SP)
def _confusion(v):
    return M.confusion(with_p(v.scored), ["source"], "p", "label", K.LOCKED_THR)


ITEMS = f"""items AS (SELECT lang, label, {su('halt', 'id')} < 0.05e0 AS halted,
  CASE WHEN {su('noscore', 'id')} >= 0.1e0 THEN p END AS score,
  CASE WHEN {su('noverdict', 'id')} < 0.05e0 THEN NULL WHEN p >= {THR} THEN 'tb' WHEN p >= {LOW} THEN 'abstain' ELSE 'no_tb' END AS verdict
  FROM sp)"""


def items(v):
    """Validation items: verdict, score and halted flag with gaps."""
    p = F.col("p")
    verdict = (
        F.when(unit("noverdict", "id") < 0.05, F.lit(None).cast("string"))
        .when(p >= K.LOCKED_THR, "tb")
        .when(p >= K.LOCKED_LOW, "abstain")
        .otherwise("no_tb")
    )
    return with_p(v.scored).select(
        "lang",
        "label",
        (unit("halt", "id") < 0.05).alias("halted"),
        F.when(unit("noscore", "id") >= 0.1, p).alias("score"),
        verdict.alias("verdict"),
    )


@query("verdict_metrics", """
SELECT lang, total, n_halted, n_abstain, tp, fp, tn, fn, tp+fp+tn+fn AS n_decided,
  round(tp::DOUBLE/nullif(tp+fn,0),6) AS sens, round(tn::DOUBLE/nullif(tn+fp,0),6) AS spec,
  round((tp+tn)::DOUBLE/nullif(tp+fp+tn+fn,0),6) AS accuracy, round(auc, 6) AS auc
FROM (SELECT lang, count(*) AS total, count(*) FILTER (halted) AS n_halted,
  count(*) FILTER (NOT halted AND (verdict IS NULL OR verdict = 'abstain')) AS n_abstain,
  count(*) FILTER (NOT halted AND verdict = 'tb' AND label = 1) AS tp,
  count(*) FILTER (NOT halted AND verdict = 'tb' AND label = 0) AS fp,
  count(*) FILTER (NOT halted AND verdict = 'no_tb' AND label = 0) AS tn,
  count(*) FILTER (NOT halted AND verdict = 'no_tb' AND label = 1) AS fn FROM items GROUP BY lang)
LEFT JOIN (SELECT k AS lang, """ + AUC_OF.replace("max(alln))", "nullif(max(alln),0))") + """ AS auc FROM roc GROUP BY k) USING (lang)""",
       "scored", SP + ", " + ITEMS + ", iscored AS (SELECT * FROM items WHERE NOT halted AND score IS NOT NULL), "
       + ROC.format(k="lang", s="score", t="iscored"))
def _verdict_metrics(v):
    return rounded(M.verdict_metrics(items(v), LANG), "sens", "spec", "accuracy", "auc")


@query("average_precision",
       "SELECT k AS lang, round(sum(np::DOUBLE/allp * tp/(tp+fp)), 6) AS average_precision FROM roc GROUP BY k",
       "scored", ROC_LANG)
def _ap(v):
    return rounded(M.average_precision(M.roc_steps(v.scored, LANG, "logit"), LANG), "average_precision")


@query("roc_curve", """SELECT lang, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round(threshold, 6) AS threshold FROM (
SELECT k AS lang, fpr, tpr, s AS threshold FROM roc UNION ALL
SELECT DISTINCT k, 0e0, 0e0, 'inf'::DOUBLE FROM roc)""", "scored", ROC_LANG)
def _roc(v):
    return rounded(M.roc_curve(M.roc_steps(v.scored, LANG, "logit"), LANG), "fpr", "tpr", "threshold")


@query("threshold_for_sensitivity_roc",
       "SELECT k AS lang, round(coalesce(max(s) FILTER (tpr >= 0.95e0), 0.5e0), 6) AS threshold FROM roc GROUP BY k",
       "scored", ROC_P)
def _thr_roc(v):
    return rounded(M.threshold_for_sensitivity_roc(M.roc_steps(with_p(v.scored), LANG, "p"), LANG), "threshold")


@query("threshold_for_sensitivity_quantile", """
SELECT lang, round(coalesce(max(p) FILTER (label = 1 AND rn = greatest(0, floor((1 - 0.95e0)*n))::BIGINT + 1), 0.5e0), 6) AS threshold
FROM (SELECT *, row_number() OVER (PARTITION BY lang, label ORDER BY p) AS rn, count(*) OVER (PARTITION BY lang, label) AS n FROM sp)
GROUP BY lang""", "scored", SP)
def _thr_q(v):
    return rounded(M.threshold_for_sensitivity_quantile(with_p(v.scored), LANG, "p"), "threshold")


@query("sens_spec_at", f"""SELECT lang, tp, fn, round(tp::DOUBLE/nullif(tp+fn,0),6) AS sens, round(tn::DOUBLE/nullif(tn+fp,0),6) AS spec FROM (
SELECT lang, count(*) FILTER (p >= {THR} AND label=1) AS tp, count(*) FILTER (p >= {THR} AND label=0) AS fp,
count(*) FILTER (p < {THR} AND label=0) AS tn, count(*) FILTER (p < {THR} AND label=1) AS fn FROM sp GROUP BY lang)""",
       "scored", SP)
def _sens_spec(v):
    out = M.sens_spec(M.confusion(with_p(v.scored), LANG, "p", "label", K.LOCKED_THR))
    return rounded(out.select("lang", "tp", "fn", "sens", "spec"), "sens", "spec")


@query("clopper_pearson", """SELECT lang, tp, n_pos, round(tp::DOUBLE / nullif(n_pos, 0), 6) AS sens, round(lo, 6) AS sens_lo, round(hi, 6) AS sens_hi
FROM kn LEFT JOIN exact ON k = tp AND n = n_pos""", "scored", SP + f""", kn AS (SELECT lang, count(*) FILTER (p >= {THR} AND label = 1) AS tp,
count(*) FILTER (label = 1) AS n_pos FROM sp GROUP BY lang), """ + exact_bounds("SELECT tp AS k, n_pos AS n FROM kn"))
def _clopper(v):
    counts = M.sens_spec(M.confusion(with_p(v.scored), LANG, "p", "label", K.LOCKED_THR))
    counts = counts.withColumn("n_pos", F.col("tp") + F.col("fn"))
    out = intervals.clopper_pearson(counts, "tp", "n_pos", "sens")
    return rounded(out.select("lang", "tp", "n_pos", "sens", "sens_lo", "sens_hi"), "sens", "sens_lo", "sens_hi")


@query("spec_all_rows", f"""SELECT lang, round((count(*) FILTER (label=0) - count(*) FILTER (label=0 AND p >= {THR}))::DOUBLE
/ nullif(count(*) FILTER (label=0), 0), 6) AS spec_all_rows FROM sp GROUP BY lang""", "scored", SP)
def _spec_all(v):
    out = M.locked_metrics(with_p(v.scored), LANG, "p", "label", K.LOCKED_THR, K.LOCKED_LOW)
    return rounded(out.select("lang", "spec_all_rows"), "spec_all_rows")


@query("effective_sensitivity", f"""SELECT site, round((count(*) FILTER (label=1 AND p >= {LOW}))::DOUBLE
/ nullif(count(*) FILTER (label=1), 0), 6) AS effective_sens FROM sp GROUP BY site""", "scored", SP)
def _eff(v):
    out = M.locked_metrics(with_p(v.scored), ["site"], "p", "label", K.LOCKED_THR, K.LOCKED_LOW)
    return rounded(out.select("site", "effective_sens"), "effective_sens")


@query("spec_at_sens", """SELECT k AS lang, round(1 - min(fpr) FILTER (tpr >= 0.9e0), 6) AS spec_at_sens,
round(max(s) FILTER (tpr >= 0.9e0), 6) AS threshold FROM roc GROUP BY k""", "scored", ROC_LANG)
def _spec_at(v):
    return rounded(M.spec_at_sens(M.roc_steps(v.scored, LANG, "logit"), LANG), "spec_at_sens", "threshold")


@query("sens_at_spec_last", """SELECT k AS lang, round(coalesce(max(tpr) FILTER (1 - fpr >= 0.7e0), 0), 6) AS sens_at_spec,
round(coalesce(min(s) FILTER (1 - fpr >= 0.7e0), 'inf'::DOUBLE), 6) AS threshold FROM roc GROUP BY k""", "scored", ROC_LANG)
def _sens_last(v):
    return rounded(M.sens_at_spec_last(M.roc_steps(v.scored, LANG, "logit"), LANG), "sens_at_spec", "threshold")


@query("sens_at_spec_interp", """SELECT k AS lang, round(coalesce(max(tpr0 + (tpr-tpr0)/(fpr-fpr0)*((1-0.7e0)-fpr0))
FILTER (fpr0 <= 1-0.7e0 AND fpr > 1-0.7e0), 1e0), 6) AS sens_at_spec FROM roc GROUP BY k""", "scored", ROC_LANG)
def _sens_interp(v):
    return rounded(M.sens_at_spec_interp(M.roc_steps(v.scored, LANG, "logit"), LANG), "sens_at_spec")


@query("partial_auc", """SELECT k AS lang, round(a, 6) AS pauc_raw, round(0.5e0*(1+(a-0.02e0)/(0.2e0-0.02e0)), 6) AS pauc FROM (
SELECT k, coalesce(sum((least(fpr,0.2e0)-fpr0)*(tpr0 + tpr0 + (tpr-tpr0)*(least(fpr,0.2e0)-fpr0)/(fpr-fpr0))/2e0)
FILTER (fpr > fpr0 AND fpr0 < 0.2e0), 0) AS a FROM roc GROUP BY k)""", "scored", ROC_LANG)
def _pauc(v):
    return rounded(M.partial_auc(M.roc_steps(v.scored, LANG, "logit"), LANG, 0.2), "pauc_raw", "pauc")


BINS_SQL = f"bins AS (SELECT site, {sbin('p')} AS bin, count(*) AS n, avg(p) AS mean_p, avg(label) AS mean_y FROM sp GROUP BY ALL)"


@query("ece", "SELECT site, round(sum(n*abs(mean_p-mean_y))/sum(n), 6) AS ece FROM bins GROUP BY site", "scored",
       SP + ", " + BINS_SQL)
def _ece(v):
    return rounded(M.ece(with_p(v.scored), ["site"]), "ece")


@query("reliability_bins", "SELECT site, bin, n, round(mean_p, 6) AS mean_p, round(mean_y, 6) AS mean_y FROM bins", "scored",
       SP + ", " + BINS_SQL)
def _bins(v):
    return rounded(M.reliability_bins(with_p(v.scored), ["site"]), "mean_p", "mean_y")


@query("brier", "SELECT lang, round(avg((p-label)*(p-label)), 6) AS brier FROM sp GROUP BY lang", "scored", SP)
def _brier(v):
    return rounded(with_p(v.scored).groupBy("lang").agg(M.brier("p", "label").alias("brier")), "brier")


PPV = """round(CASE WHEN sens*pr + (1-spec)*(1-pr) > 0 THEN sens*pr/(sens*pr + (1-spec)*(1-pr)) END, 6) AS ppv,
round(CASE WHEN spec*(1-pr) + (1-sens)*pr > 0 THEN spec*(1-pr)/(spec*(1-pr) + (1-sens)*pr) END, 6) AS npv,
round(CASE WHEN sens*pr > 0 THEN (sens*pr + (1-spec)*(1-pr))/(sens*pr) END, 6) AS tests_per_case"""
SS = f"""ss AS (SELECT site, (count(*) FILTER (p >= {THR} AND label=1))::DOUBLE/nullif(count(*) FILTER (label=1),0) AS sens,
(count(*) FILTER (p < {THR} AND label=0))::DOUBLE/nullif(count(*) FILTER (label=0),0) AS spec FROM sp GROUP BY site)"""
PREV = "(VALUES (0.01e0),(0.02e0),(0.09e0),(0.12e0),(0.15e0)) q(pr)"


@query("ppv_npv", f"SELECT site, pr AS prevalence, {PPV} FROM ss, {PREV}", "scored", SP + ", " + SS)
def _ppv(v):
    ss = M.sens_spec(M.confusion(with_p(v.scored), ["site"], "p", "label", K.LOCKED_THR))
    out = M.ppv_npv(ss.select("site", "sens", "spec"), "sens", "spec", K.PREVALENCES).drop("sens", "spec")
    return rounded(out, "ppv", "npv", "tests_per_case")


@query("prevalence_table", f"SELECT pr AS prevalence, {PPV} FROM (SELECT avg(sens) AS sens, avg(spec) AS spec FROM ss "
       f"WHERE site <> 's3' AND sens IS NOT NULL AND spec IS NOT NULL), {PREV}", "scored", SP + ", " + SS)
def _prevalence(v):
    ss = M.sens_spec(M.confusion(with_p(v.scored), ["site"], "p", "label", K.LOCKED_THR))
    clean = ss.filter((F.col("site") != "s3") & F.col("sens").isNotNull() & F.col("spec").isNotNull())
    mean = clean.agg(F.avg("sens").alias("sens"), F.avg("spec").alias("spec"))
    return rounded(M.ppv_npv(mean, "sens", "spec", K.PREVALENCES).drop("sens", "spec"), "ppv", "npv", "tests_per_case")


def swilson(k: str, n: str) -> tuple[str, str]:
    """SQL text of the Wilson bounds."""
    z = "1.959963984540054e0"
    mid = f"((({k})::DOUBLE/({n})) + {z}*{z}/(2*({n})))/(1+{z}*{z}/({n}))"
    half = f"{z}*sqrt((({k})::DOUBLE/({n}))*(1-({k})::DOUBLE/({n}))/({n}) + {z}*{z}/(4e0*({n})*({n})))/(1+{z}*{z}/({n}))"
    return f"greatest(0, {mid} - {half})", f"least(1, {mid} + {half})"


@query("wilson_ci", f"SELECT source, k, n, round({swilson('k', 'n')[0]}, 6) AS sens_lo, round({swilson('k', 'n')[1]}, 6) AS sens_hi "
       f"FROM (SELECT source, count(*) FILTER (p >= {THR}) AS k, count(*) AS n FROM sp WHERE label = 1 GROUP BY source)",
       "scored", SP)
def _wilson(v):
    counts = with_p(v.scored).filter("label = 1").groupBy("source").agg(
        F.count_if(F.col("p") >= K.LOCKED_THR).alias("k"), F.count(F.lit(1)).alias("n"))
    return rounded(M.wilson_columns(counts, "k", "n", "sens"), "sens_lo", "sens_hi")


@query("youden_threshold", """SELECT k AS lang, round(max(tpr-fpr), 6) AS j, round(arg_max(s, (tpr-fpr, s)), 6) AS threshold
FROM roc GROUP BY k""", "scored", ROC_LANG)
def _youden(v):
    return rounded(M.youden_threshold(M.roc_steps(v.scored, LANG, "logit"), LANG), "j", "threshold")


@query("score_quantiles_by_class", """SELECT label, count(*) AS n, round(quantile_cont(p, 0.25), 6) AS q250,
round(quantile_cont(p, 0.5), 6) AS q500, round(quantile_cont(p, 0.75), 6) AS q750 FROM sp GROUP BY label""", "scored", SP)
def _quantiles(v):
    return rounded(M.score_quantiles(with_p(v.scored), ["label"], "p"), "q250", "q500", "q750")


@query("confident_misses", "SELECT id, source, round(p, 6) AS p FROM sp WHERE label = 1 AND p < 0.35e0", "scored", SP)
def _misses(v):
    return rounded(M.confident_misses(with_p(v.scored), cut=0.35).select("id", "source", "p"), "p")


@query("confident_misses_top", """SELECT id, lang, round(p, 6) AS p FROM sp WHERE label = 1 AND p < """ + THR +
       " ORDER BY p, id LIMIT 50", "scored", SP)
def _misses_top(v):
    missed = M.confident_misses(with_p(v.scored), cut=K.LOCKED_THR).select("id", "lang", "p")
    return rounded(M.top_rows(missed, [F.col("p"), F.col("id")], 50), "p")


TAG_SQL = "CASE WHEN finding IN ('toxic', 'long') THEN 'mimic' WHEN finding = 'no_finding' THEN 'easy' ELSE 'other' END"
FIND_SQL = f"""fr AS (SELECT finding, {TAG_SQL} AS tag, count(*) AS n,
(count(*) FILTER (p >= {THR} AND label = 0))::DOUBLE / nullif(count(*) FILTER (label=0), 0) AS fpr,
avg((p-label)*(p-label)) AS brier FROM findings JOIN sp USING (id) GROUP BY finding)"""


def finding_rows(v):
    """fpr and Brier per finding with its tag."""
    f = F.col("finding")
    tag = F.when(f.isin("toxic", "long"), "mimic").when(f == "no_finding", "easy").otherwise("other")
    rows = v.findings.join(with_p(v.scored).select("id", "p", "label"), "id").groupBy("finding").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("p") >= K.LOCKED_THR) & (F.col("label") == 0)).alias("n_fp"),
        F.count_if(F.col("label") == 0).alias("n_neg"),
        M.brier("p", "label").alias("brier"))
    return rows.select("finding", tag.alias("tag"), "n", M.ratio("n_fp", "n_neg").alias("fpr"), "brier")


@query("mean_by_tag", """SELECT tag, count(*) AS k, round(avg(fpr), 6) AS mean_fpr, round(avg(brier), 6) AS mean_brier
FROM fr GROUP BY tag""", "scored findings", SP + ", " + FIND_SQL)
def _by_tag(v):
    return rounded(M.mean_by_tag(finding_rows(v), "tag", ["fpr", "brier"]), "mean_fpr", "mean_brier")
