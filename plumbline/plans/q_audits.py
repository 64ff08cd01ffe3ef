"""Stratified audits and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import constants as K
from plumbline.functions.hashing import unit
from plumbline.operators import audits as A
from plumbline.operators import metrics as M
from plumbline.operators import splits as S
from plumbline.plans.common import ROC, SP, THR, exact_bounds, rounded, with_p
from plumbline.plans.q_metrics import AUC_OF, LOCKED_SQL, SS, sbin, swilson
from plumbline.plans.q_resample import MEDIAN_SPLIT, N_BOOT, RECAL_STEPS, ci, rep_roc, reps_sql
from plumbline.plans.q_splits import quota_sql, srank
from plumbline.plans.registry import query
from plumbline.plans.views import ssig, su

NAMES = ("toxic", "lang_fr", "lang_de", "lang_es", "short", "long", "no_finding", "never_seen")
LIST = "names AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in NAMES) + "]) AS subgroup)"
ECE_FIND = f"""fe AS (SELECT finding, sum(n*abs(mp-my))/sum(n) AS ece FROM (SELECT finding, {sbin('p')} AS b, count(*) AS n, avg(p) AS mp, avg(label) AS my
FROM findings JOIN sp USING (id) GROUP BY ALL) GROUP BY finding),
fg AS (SELECT finding, count(*) AS n, count(*) FILTER (label=0) AS n_neg, count(*) FILTER (label=0 AND p >= {THR}) AS n_fp, avg(p) AS mean_score,
avg((p >= 0.95e0)::INT) AS frac_high, avg((p-label)*(p-label)) AS brier FROM findings JOIN sp USING (id) GROUP BY finding),
strat AS (SELECT subgroup, coalesce(n, 0) AS n, coalesce(n_neg, 0) AS n_neg, coalesce(n_fp, 0) AS n_fp, round(n_fp::DOUBLE/nullif(n_neg,0), 6) AS fpr,
round(CASE WHEN n_neg > 0 THEN {swilson('n_fp', 'n_neg')[0]} END, 6) AS fpr_lo, round(CASE WHEN n_neg > 0 THEN {swilson('n_fp', 'n_neg')[1]} END, 6) AS fpr_hi,
round(mean_score, 6) AS mean_score, round(frac_high, 6) AS frac_high, round(brier, 6) AS brier, round(ece, 6) AS ece
FROM names LEFT JOIN fg ON subgroup = fg.finding LEFT JOIN fe ON subgroup = fe.finding)"""


def strat(v, exact: bool = False):
    names = v.spark.createDataFrame([(n,) for n in NAMES], "subgroup string")
    members = v.findings.withColumnRenamed("finding", "subgroup")
    out = A.stratified_fpr(with_p(v.scored), members, names, K.LOCKED_THR, exact=exact)
    return rounded(out, "fpr", "fpr_lo", "fpr_hi", "mean_score", "frac_high", "brier", "ece")


@query("stratified_fpr", "SELECT * FROM strat", "scored findings", SP + ", " + LIST + ", " + ECE_FIND)
def _strat(v):
    return strat(v)


@query("stratified_fpr_exact_ci", """SELECT strat.* REPLACE (round(lo, 6) AS fpr_lo, round(hi, 6) AS fpr_hi) FROM strat LEFT JOIN exact ON exact.k = n_fp AND exact.n = n_neg""",
       "scored findings", SP + ", " + LIST + ", " + ECE_FIND + ", " + exact_bounds("SELECT n_fp AS k, n_neg AS n FROM strat"))
def _strat_exact(v):
    return strat(v, exact=True)


@query("build_subgroups", """SELECT id, finding AS subgroup FROM findings""", "findings")
def _subgroups(v):
    docs = v.table("documents").select("doc_id", "lang", "n_chars").join(v.table("labels"), "doc_id")
    wide = docs.select(
        F.col("doc_id").alias("id"), F.col("toxic"), *[(F.col("lang") == x).cast("int").alias(f"lang_{x}") for x in ("fr", "de", "es")],
        (F.col("n_chars") < 400).cast("int").alias("short"), (F.col("n_chars") > 3000).cast("int").alias("long"))
    return A.build_subgroups(wide, "id", ["toxic", "lang_fr", "lang_de", "lang_es", "short", "long"])


@query("min_n_filter", "SELECT * FROM strat WHERE n >= 50", "scored findings", SP + ", " + LIST + ", " + ECE_FIND)
def _min_n(v):
    return A.min_n_filter(strat(v))


@query("ranked_findings", """SELECT subgroup, n, fpr, CASE WHEN subgroup IN ('toxic', 'long') THEN 'mimic' WHEN subgroup = 'no_finding' THEN 'easy' ELSE 'other' END AS tag
FROM strat""", "scored findings", SP + ", " + LIST + ", " + ECE_FIND)
def _ranked(v):
    s = F.col("subgroup")
    tag = F.when(s.isin("toxic", "long"), "mimic").when(s == "no_finding", "easy").otherwise("other")
    return A.ranked_findings(strat(v).select("subgroup", "n", "fpr"), tag)


@query("fpr_spec_block", f"""SELECT lang, n, n_fp, round(mean_score, 6) AS mean_score, round(frac_high, 6) AS frac_high, round(n_fp::DOUBLE/n, 6) AS fpr, round({swilson('n_fp', 'n')[0]}, 6) AS fpr_lo,
round({swilson('n_fp', 'n')[1]}, 6) AS fpr_hi, round(1-n_fp::DOUBLE/n, 6) AS spec, round(1-({swilson('n_fp', 'n')[1]}), 6) AS spec_lo, round(1-({swilson('n_fp', 'n')[0]}), 6) AS spec_hi
FROM (SELECT lang, count(*) AS n, count(*) FILTER (p >= {THR}) AS n_fp, avg(p) AS mean_score, avg((p >= 0.95e0)::INT) AS frac_high FROM sp WHERE label = 0 GROUP BY lang)""", "scored", SP)
def _block(v):
    out = A.fpr_spec_block(with_p(v.scored).filter("label = 0"), ["lang"], "p", K.LOCKED_THR)
    return rounded(out, "mean_score", "frac_high", "fpr", "fpr_lo", "fpr_hi", "spec", "spec_lo", "spec_hi")


# Labelled signals; the rule fires often enough to audit with widened cuts on the same columns.
SIGL = f"""sigl AS (SELECT s.id, s.source, o.label, s.tb_prob / 2e0 AS tb_prob, sqrt(s.box_max) AS box_max, s.path_max,
 s.tb_prob / 2e0 < {THR} AND s.tb_prob / 2e0 < 0.2e0 AND sqrt(s.box_max) >= 0.88e0 AND s.path_max >= 0.44e0 AS ab FROM signals s JOIN scored o USING (id))"""


def labelled_signals(v):
    s = v.signals.select("id", "source", (F.col("tb_prob") / 2.0).alias("tb_prob"), F.sqrt("box_max").alias("box_max"), "path_max")
    return s.join(v.scored.select("id", "label"), "id")


BY_SOURCE = f"""bs AS (SELECT source, count(*) AS n, count(*) FILTER (label=1) AS n_pos, count(*) FILTER (label=0) AS n_neg, count(*) FILTER (ab) AS n_abstain,
count(*) FILTER (ab AND label=1) AS catch, count(*) FILTER (ab AND label=0) AS cost, count(*) FILTER (tb_prob >= {THR} AND label=1) AS tp,
count(*) FILTER (tb_prob < {THR} AND NOT ab AND label=1) AS fn, count(*) FILTER (tb_prob >= {THR} AND label=0) AS fp,
count(*) FILTER (tb_prob < {THR} AND NOT ab AND label=0) AS tn FROM sigl GROUP BY source)"""


def by_source(v):
    return A.abstain_audit_by_source(labelled_signals(v), ["source"], "tb_prob",
                                     A.abstain_mask("tb_prob", "box_max", "path_max", K.LOCKED_THR), K.LOCKED_THR)


@query("abstain_audit_by_source", """SELECT *, round(n_abstain::DOUBLE/greatest(n,1),6) AS abstain_rate, round(catch::DOUBLE/greatest(n_pos,1),6) AS abstain_rate_pos,
round(cost::DOUBLE/greatest(n_neg,1),6) AS abstain_rate_neg, round(tp::DOUBLE/greatest(tp+fn,1),6) AS strict_sens, round(tn::DOUBLE/greatest(tn+fp,1),6) AS strict_spec,
round((tp+catch)::DOUBLE/greatest(n_pos,1),6) AS effective_sens, round(catch::DOUBLE/greatest(cost,1),6) AS catch_cost_ratio FROM bs""", "signals scored", SIGL + ", " + BY_SOURCE)
def _by_source(v):
    return rounded(by_source(v), "abstain_rate", "abstain_rate_pos", "abstain_rate_neg", "strict_sens", "strict_spec", "effective_sens", "catch_cost_ratio")


BY_FINDING = """bf0 AS (SELECT finding, count(*) AS n, count(*) FILTER (ab) AS n_abstain, avg(tb_prob) AS mean_tb_prob, avg(box_max) AS mean_box_max,
count(*) FILTER (ab)::DOUBLE/count(*) AS abstain_rate FROM findings JOIN sigl USING (id) GROUP BY finding),
bf AS (SELECT *, CASE WHEN base > 0 THEN abstain_rate/base WHEN n_abstain > 0 THEN 'inf'::DOUBLE ELSE 0e0 END AS multiplier FROM bf0,
(SELECT coalesce(max(abstain_rate) FILTER (finding = 'no_finding'), 0) AS base FROM bf0))"""


def by_finding(v):
    return A.abstain_audit_by_finding(labelled_signals(v), v.findings, A.abstain_mask("tb_prob", "box_max", "path_max", K.LOCKED_THR),
                                      ["tb_prob", "box_max"], "no_finding")


@query("abstain_audit_by_finding", """SELECT finding, n, n_abstain, round(mean_tb_prob,6) AS mean_tb_prob, round(mean_box_max,6) AS mean_box_max, round(abstain_rate,6) AS abstain_rate,
round(multiplier,6) AS multiplier FROM bf""", "signals scored findings", SIGL + ", " + BY_FINDING)
def _by_finding(v):
    return rounded(by_finding(v), "mean_tb_prob", "mean_box_max", "abstain_rate", "multiplier")


@query("fairness_gate", """SELECT f.*, c.*, CASE WHEN n_failing > 0 THEN 'FAIL' WHEN n_elevated_findings > 0 OR n_costly_sources > 0 THEN 'WATCH' ELSE 'PASS' END AS verdict FROM (
SELECT count(*) FILTER (n >= 10 AND multiplier > 5) AS n_failing, count(*) FILTER (n >= 10 AND multiplier > 3 AND multiplier <= 5) AS n_elevated_findings FROM bf) f,
(SELECT count(*) FILTER (n_pos >= 10 AND catch::DOUBLE/greatest(cost,1) < 1) AS n_costly_sources FROM bs) c""", "signals scored findings", SIGL + ", " + BY_SOURCE + ", " + BY_FINDING)
def _gate(v):
    return A.fairness_gate(by_source(v), by_finding(v))


ROC_SITE = SP + ", " + ROC.format(k="site", s="p", t="sp")
REPORT = f"""eb AS (SELECT site, {sbin('p')} AS b, count(*) AS n, avg(p) AS mp, avg(label) AS my FROM sp GROUP BY ALL),
report AS (SELECT site, n, pos, ece, sens, spec, auc, site IN ('s3') AS remix FROM (SELECT site, count(*) AS n, count(*) FILTER (label=1) AS pos FROM sp GROUP BY site)
JOIN (SELECT site, sum(n*abs(mp-my))/sum(n) AS ece FROM eb GROUP BY site) USING (site) JOIN ss USING (site) JOIN (SELECT k AS site, {AUC_OF.replace('max(alln))', 'nullif(max(alln),0))')} AS auc FROM roc GROUP BY k) USING (site))"""


def report(v):
    return A.lodo_report(with_p(v.scored), ["site"], ["s3"], K.LOCKED_THR)


@query("lodo_report", "SELECT site, n, pos, round(ece,6) AS ece, round(sens,6) AS sens, round(spec,6) AS spec, round(auc,6) AS auc, remix FROM report", "scored",
       ROC_SITE + ", " + SS + ", " + REPORT)
def _report(v):
    return rounded(report(v), "ece", "sens", "spec", "auc")


FULL = f"""ci AS (SELECT k AS site, {ci('auc', 'auc')} FROM a1 WHERE auc IS NOT NULL GROUP BY k),
recal AS (SELECT site, m AS recal_sens, ms AS recal_spec, lo AS recal_lo, hi AS recal_hi FROM mids JOIN near USING (site) LEFT JOIN exact ON k = median_tp AND n = median_n_pos),
lfull AS (SELECT * FROM report LEFT JOIN ci USING (site) LEFT JOIN recal USING (site))"""


@query("lodo_report_full", """SELECT site, n, pos, round(ece,6) AS ece, round(sens,6) AS sens, round(spec,6) AS spec, round(auc,6) AS auc, remix, auc_lo, auc_hi,
round(recal_sens,6) AS recal_sens, round(recal_spec,6) AS recal_spec, round(recal_lo,6) AS recal_lo, round(recal_hi,6) AS recal_hi FROM (SELECT * FROM lfull UNION ALL BY NAME
SELECT 'mean' AS site, sum(n)::BIGINT AS n, sum(pos)::BIGINT AS pos, avg(ece) AS ece, avg(sens) AS sens, avg(spec) AS spec, avg(auc) AS auc, false AS remix,
avg(recal_sens) AS recal_sens, avg(recal_spec) AS recal_spec FROM lfull)""", "scored",
       ROC_SITE + ", " + SS + ", " + REPORT + ", " + reps_sql("sp", "id, site, label, p", "id", 11) + ", " + rep_roc("rb", "site", "p", "1") + ", " + RECAL_STEPS + ", "
       + MEDIAN_SPLIT + exact_bounds("SELECT median_tp AS k, median_n_pos AS n FROM near") + ", " + FULL)
def _report_full(v):
    out = A.lodo_report_full(with_p(v.scored), "site", ["s3"], K.LOCKED_THR, n_boot=N_BOOT)
    return rounded(out, "ece", "sens", "spec", "auc", "auc_lo", "auc_hi", "recal_sens", "recal_spec", "recal_lo", "recal_hi")


@query("worst_clean_fold", """SELECT round(avg(auc),6) AS mean_auc, arg_min(site, (sens, site)) FILTER (NOT remix) AS worst_fold, round(min(sens) FILTER (NOT remix),6) AS worst_sens FROM report""",
       "scored", ROC_SITE + ", " + SS + ", " + REPORT)
def _worst(v):
    return rounded(A.worst_clean_fold(report(v), "site"), "mean_auc", "worst_sens")


@query("nonbox_mean", "SELECT round(avg(auc),6) AS nonbox_auc, count(*) AS n_folds FROM report WHERE pos % 2 = 0", "scored", ROC_SITE + ", " + SS + ", " + REPORT)
def _nonbox(v):
    return rounded(A.nonbox_mean(report(v).withColumn("n_boxes", F.col("pos") % 2)), "nonbox_auc")


RUNGS = f"""rg AS (SELECT 'A' AS lang, a.label, {ssig('a.logit')} AS p FROM scored a UNION ALL SELECT 'B', b.label, {ssig('b.logit')} FROM scored_b b
UNION ALL SELECT 'C', a.label, {ssig('a.logit*0.5e0')} FROM scored a)"""
LADDER = LOCKED_SQL.format(bin=sbin("p")).replace("FROM sp", "FROM rg")


@query("ablation_ladder", f"""SELECT lang AS rung, n, auc, sens, spec, ece, abstain_rate, round(auc - max(auc) FILTER (lang = 'A') OVER (), 5) AS d_auc,
round(sens - max(sens) FILTER (lang = 'A') OVER (), 5) AS d_sens, round(spec - max(spec) FILTER (lang = 'A') OVER (), 5) AS d_spec FROM ({LADDER})""",
       "scored scored_b", RUNGS + ", " + ROC.format(k="lang", s="p", t="rg"))
def _ladder(v):
    from plumbline.functions.maths import sigmoid

    d = v.scored.select("id", "label", sigmoid("logit").alias("pa"), sigmoid(F.col("logit") * 0.5).alias("pc")).join(
        v.scored_b.select("id", sigmoid("logit").alias("pb")), "id")
    out = A.ablation_ladder(d, {"A": "pa", "B": "pb", "C": "pc"})
    out = rounded(out, "auc", "sens", "spec", "ece", "abstain_rate")
    return rounded(out, "d_auc", "d_sens", "d_spec", digits=5)


DOSE = f"""split AS (SELECT id, label, logit, CASE WHEN rn <= q THEN 'test' ELSE 'pool' END AS role FROM (SELECT id, label, logit, {srank('label', 'pool')} FROM scored) JOIN quota USING (label)),
pool AS (SELECT * FROM split WHERE role = 'pool'),
dz AS (SELECT dose, id, label FROM (SELECT id, label, {srank('label', '7')}, count(*) OVER () AS n, sum(label) OVER () AS np FROM pool), (VALUES ('50', 50), ('100', 100), ('ALL', 0)) d(dose, k)
WHERE dose = 'ALL' OR rn <= CASE WHEN label = 1 THEN least(round_even(k*(np::DOUBLE/n), 0), np) ELSE least(k - least(round_even(k*(np::DOUBLE/n), 0), np), n - np) END),
sizes AS (SELECT dose, count(*) AS dose_n, count(*) FILTER (label=1) AS n_pos, count(*) FILTER (label=0) AS n_neg FROM dz GROUP BY dose),
tested AS (SELECT dose, label, logit + 200e0/dose_n*({su('dz', 'id')}-0.5e0) AS s FROM split, sizes WHERE role = 'test')"""


@query("dose_response", f"""SELECT dose, dose_n, n_pos, n_neg, auc, spec_at_sens, sens_at_spec FROM sizes JOIN (SELECT k AS dose, round({AUC_OF}, 6) AS auc,
round(1 - min(fpr) FILTER (tpr >= 0.9e0), 6) AS spec_at_sens, round(coalesce(max(tpr) FILTER (1 - fpr >= 0.7e0), 0), 6) AS sens_at_spec FROM roc GROUP BY k) USING (dose)""",
       "scored", quota_sql("scored", "0.4e0") + ", " + DOSE + ", " + ROC.format(k="dose", s="s", t="tested"))
def _dose(v):
    s = S.stratified_split(v.scored, test_frac=0.4, seed="pool")
    doses = S.nested_doses(s.filter("role = 'train'"), (50, 100, None))
    score = F.col("logit") + F.lit(200.0) / F.col("dose_n") * (unit("dz", "id") - 0.5)
    out = A.dose_response(doses.select("dose", "label"), s.filter("role = 'test'").select("id", "label", "logit"), score)
    return rounded(out, "auc", "spec_at_sens", "sens_at_spec")


@query("material_gain_gate", """SELECT site, CASE WHEN auc >= auc_b THEN 'cls' ELSE 'fused' END AS best_branch, round(greatest(auc, auc_b), 6) AS best_auc,
CASE WHEN greatest(auc, auc_b) >= 0.781e0+0.05e0 AND CASE WHEN auc >= auc_b THEN auc ELSE auc_b END - 0.05e0 > 0.781e0 THEN 'STOP' ELSE 'PROCEED' END AS decision,
NOT (greatest(auc, auc_b) < 0.781e0-0.05e0 AND auc >= 0.781e0) AS gate_valid FROM
(SELECT k AS site, """ + AUC_OF + """ AS auc FROM roc GROUP BY k HAVING max(alln) > 0) JOIN (SELECT k AS site, """ + AUC_OF + """ AS auc_b FROM rocb GROUP BY k HAVING max(alln) > 0) USING (site)""",
       "scored scored_b", ROC.format(k="site", s="logit", t="scored") + ", " + ROC.format(k="site", s="logit", t="scored_b").replace("hist", "histb").replace("cum AS", "cumb AS").replace("FROM cum)", "FROM cumb)").replace("roc AS", "rocb AS"))
def _gain(v):
    a = M.auc(v.scored, ["site"], "logit").filter("auc IS NOT NULL").select("site", "auc")
    b = M.auc(v.scored_b, ["site"], "logit").filter("auc IS NOT NULL").select("site", F.col("auc").alias("auc_b"))
    d = a.join(b, "site").withColumn("lo", F.col("auc") - 0.05).withColumn("lo_b", F.col("auc_b") - 0.05)
    out = A.material_gain_gate(d, {"cls": ("auc", "lo"), "fused": ("auc_b", "lo_b")}, "auc")
    return rounded(out.select("site", "best_branch", "best_auc", "decision", "gate_valid"), "best_auc")


@query("artifact_synthesis", """SELECT id, CASE WHEN a AND b AND c THEN 'REAL' WHEN NOT b AND NOT c THEN 'ARTIFACT' WHEN NOT a AND b AND c THEN 'MIXED-NOT-MAX'
WHEN NOT a THEN 'ARTIFACT-LEANING' ELSE 'MIXED' END AS verdict, a::INT+b::INT+c::INT+d::INT AS n_signals FROM (
SELECT id, tb_prob > 0.5e0 AS a, s_inactive > 0.5e0 AS b, box_max > 0.5e0 AS c, path_max > 0.5e0 AS d FROM signals)""", "signals")
def _artifact(v):
    flags = [F.col(c) > 0.5 for c in ("tb_prob", "s_inactive", "box_max", "path_max")]
    return v.signals.select("id", A.artifact_synthesis(*flags).alias("s")).select("id", "s.*")


@query("go_no_go_local_gain", """SELECT lang AS arm, count(*) FILTER (delta > 0.01) AS n_improved, count(*) FILTER (delta < -0.01) AS n_regressed,
CASE WHEN bool_or(delta > 0.01) AND NOT bool_or(delta < -0.01) THEN 'GO' ELSE 'NO-GO' END AS decision FROM (
SELECT a.lang, a.source, avg(b.logit - a.logit) AS delta FROM scored a JOIN scored_b b USING (id) GROUP BY ALL) GROUP BY lang""", "scored scored_b")
def _go(v):
    d = v.scored.join(v.scored_b.select("id", F.col("logit").alias("lb")), "id").groupBy(F.col("lang").alias("arm"), "source").agg(
        F.avg(F.col("lb") - F.col("logit")).alias("delta"))
    return A.go_no_go_local_gain(d)


LEDGER = """ledger AS (SELECT date_trunc('day', ts) AS day, avg(value)/100e0 AS mean_auc, min(value)/100e0 AS worst_sens,
avg(value) FILTER (event_type = 'error')/60e0 AS permuted_auc, stddev_pop(value)/200e0 AS ece FROM events GROUP BY 1)"""


@query("drift_tripwires", """SELECT day, coalesce(mean_auc - lag(mean_auc) OVER w > 0.005, false) AS auc_jump,
coalesce(mean_auc > lag(mean_auc) OVER w AND worst_sens < lag(worst_sens) OVER w, false) AS worst_fold_hidden, coalesce(permuted_auc >= 0.6, false) AS shortcut,
coalesce(ece - lag(ece) OVER w > 0.002, false) AS ece_rise FROM ledger WINDOW w AS (ORDER BY day)""", "", LEDGER)
def _drift(v):
    v_ = F.col("value")
    runs = v.table("events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(
        (F.avg(v_) / 100.0).alias("mean_auc"), (F.min(v_) / 100.0).alias("worst_sens"),
        (F.avg(F.when(F.col("event_type") == "error", v_)) / 60.0).alias("permuted_auc"), (F.stddev_pop(v_) / 200.0).alias("ece"))
    out = A.drift_tripwires(runs, "day", auc_jump=0.005, ece_rise=0.002)
    return out.select("day", "auc_jump", "worst_fold_hidden", "shortcut", "ece_rise")


@query("verdict_flips", f"""SELECT count(*) AS n_items, count(*) FILTER ((a.logit >= 0.5) <> (b.logit >= 0.5)) AS n_flips FROM scored a JOIN scored_b b USING (id)""", "scored scored_b")
def _flips(v):
    def verdicts(d):
        return d.select("id", F.when(F.col("logit") >= 0.5, "tb").otherwise("no_tb").alias("verdict"))

    return A.verdict_flips(verdicts(v.scored), verdicts(v.scored_b))


@query("ab_gate", f"""SELECT n, n_misses, n_rescued, n_new_fp, n_flips, CASE WHEN n_rescued >= n_misses*0.75 AND n_new_fp = 0 AND n_flips <= n*2e0/23 THEN 'GO' ELSE 'NO-GO' END AS decision FROM (
SELECT count(*) AS n, count(*) FILTER (label=1 AND a.logit < 0.2) AS n_misses, count(*) FILTER (label=1 AND a.logit < 0.2 AND b.logit >= 0.2) AS n_rescued,
count(*) FILTER (label=0 AND a.logit < 0.2 AND b.logit >= 0.2) AS n_new_fp, count(*) FILTER ((b.logit >= 0.2) <> (b.logit + {su('b2', 'id')} - 0.5e0 >= 0.2)) AS n_flips
FROM scored a JOIN (SELECT id, logit FROM scored_b) b USING (id))""", "scored scored_b")
def _ab(v):
    d = v.scored.join(v.scored_b.select("id", F.col("logit").alias("pb")), "id").withColumn("pb2", F.col("pb") + unit("b2", "id") - 0.5)
    return A.ab_gate(d, "logit", "pb", "pb2", 0.2)


@query("invariant_checks", """SELECT count(*) AS n, count(*) FILTER (s.id % 9 = 0)::BIGINT AS n_non_finite, count(*) FILTER (s.id % 10 = 0) AS n_label_mismatch FROM scored s""", "scored")
def _invariant(v):
    d = v.scored.select(
        F.when(F.col("id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("logit")).alias("x"), "label",
        F.when(F.col("id") % 10 == 0, 1 - F.col("label")).otherwise(F.col("label")).alias("expected"))
    return A.invariant_checks(d, ["x"], "label", "expected")


@query("hard_negative_compare", f"""SELECT round(fb,6) AS fpr_base, round(sb,6) AS sens_base, round(pb,6) AS spec_base, round(ff,6) AS fpr_fixed, round(sf,6) AS sens_fixed, round(pf,6) AS spec_fixed,
round(ff-fb,6) AS d_fpr, round(sf-sb,6) AS d_sens, round(pf-pb,6) AS d_spec FROM (SELECT
avg((logit >= 0)::INT) FILTER (pr) AS fb, avg((logit >= 0)::INT) FILTER (NOT pr AND label=1) AS sb, avg((logit < 0)::INT) FILTER (NOT pr AND label=0) AS pb,
avg((lb >= 0)::INT) FILTER (pr) AS ff, avg((lb >= 0)::INT) FILTER (NOT pr AND label=1) AS sf, avg((lb < 0)::INT) FILTER (NOT pr AND label=0) AS pf
FROM (SELECT a.logit, b.logit AS lb, a.label, a.label = 0 AND a.id % 2 = 0 AS pr FROM scored a JOIN scored_b b USING (id)))""", "scored scored_b")
def _hard(v):
    d = v.scored.join(v.scored_b.select("id", F.col("logit").alias("lb")), "id")
    out = A.hard_negative_compare(d, "logit", "lb", (F.col("label") == 0) & (F.col("id") % 2 == 0), 0.0)
    return rounded(out, *out.columns)


@query("domain_contrast", f"""SELECT n_s1, round(fpr_s1,6) AS fpr_s1, round(mean_s1,6) AS mean_s1, n_s2, round(fpr_s2,6) AS fpr_s2, round(mean_s2,6) AS mean_s2, round(fpr_s1-fpr_s2,6) AS fpr_gap FROM (SELECT
count(*) FILTER (site='s1') AS n_s1, avg((p >= {THR})::INT) FILTER (site='s1' AND label=0) AS fpr_s1, avg(p) FILTER (site='s1') AS mean_s1,
count(*) FILTER (site='s2') AS n_s2, avg((p >= {THR})::INT) FILTER (site='s2' AND label=0) AS fpr_s2, avg(p) FILTER (site='s2') AS mean_s2 FROM sp)""", "scored", SP)
def _contrast(v):
    out = A.domain_contrast(with_p(v.scored), "site", "s1", "s2", "p", "label", K.LOCKED_THR)
    return rounded(out, "fpr_s1", "mean_s1", "fpr_s2", "mean_s2", "fpr_gap")


@query("overall_and_by_group", "SELECT lang, count(*) AS n, round(avg(p), 6) AS mean_p FROM sp GROUP BY ROLLUP (lang)", "scored", SP)
def _rollup(v):
    return rounded(A.overall_and_by_group(with_p(v.scored), "lang", {"n": F.count(F.lit(1)), "mean_p": F.avg("p")}), "mean_p")


@query("forgetting_check", f"""SELECT site, round(sens, 6) AS sens, CASE WHEN sens >= 0.846e0 THEN 'OK' ELSE 'WATCH' END AS status FROM ss""", "scored", SP + ", " + SS)
def _forget(v):
    ss = M.sens_spec(M.confusion(with_p(v.scored), ["site"], "p", "label", K.LOCKED_THR))
    return rounded(ss.select("site", "sens", A.forgetting_check(F.col("sens")).alias("status")), "sens")


