"""Decision rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import constants as K
from plumbline.functions.hashing import unit
from plumbline.operators import rules as R
from plumbline.plans.common import LOW, THR, rounded
from plumbline.plans.registry import query
from plumbline.plans.views import su

BASE = f"CASE WHEN tb_prob >= {THR} THEN 'tb' ELSE 'no_tb' END"


def base_verdict(p="tb_prob"):
    return F.when(F.col(p) >= K.LOCKED_THR, "tb").otherwise("no_tb")


@query("band_verdict", f"""SELECT id, CASE WHEN tb_prob >= {THR} THEN 'TB' WHEN tb_prob >= {LOW} THEN 'ABSTAIN' ELSE 'NO_TB' END AS verdict,
CASE WHEN tb_prob >= {THR} THEN 'TB' WHEN tb_prob >= 0.35e0 THEN 'ABSTAIN' ELSE 'NO_TB' END AS verdict_wide FROM signals""", "signals")
def _band(v):
    return v.signals.select("id", R.band_verdict("tb_prob").alias("verdict"),
                            R.band_verdict("tb_prob", low=0.35).alias("verdict_wide"))


@query("conformal_verdict", """SELECT id, CASE WHEN tb_prob >= 0.61e0 THEN 'tb' WHEN tb_prob < 0.305e0 THEN 'no_tb' ELSE 'abstain' END AS verdict
FROM signals""", "signals")
def _conf(v):
    return v.signals.select("id", R.conformal_verdict("tb_prob", F.lit(0.305), F.lit(0.61)).alias("verdict"))


POLICY = "CASE WHEN tb_prob >= 0.3e0 THEN 'tb' WHEN tb_prob <= 0.15e0 AND path_max <= 0.15e0 THEN 'no_tb' ELSE 'abstain' END"


@query("screening_policy", f"SELECT id, {POLICY} AS verdict FROM signals", "signals")
def _policy(v):
    return v.signals.select("id", R.screening_policy("tb_prob", "path_max").alias("verdict"))


SEV = "CASE {v} WHEN 'no_tb' THEN 0 WHEN 'tb' THEN 2 ELSE 1 END"


@query("most_cautious", f"""SELECT id, (['no_tb','abstain','tb'])[greatest({SEV.format(v='a')}, {SEV.format(v='b')}) + 1] AS verdict
FROM (SELECT id, {POLICY} AS a, {BASE} AS b FROM signals)""", "signals")
def _cautious(v):
    d = v.signals.select("id", R.screening_policy("tb_prob", "path_max").alias("a"), base_verdict().alias("b"))
    return d.select("id", R.most_cautious("a", "b").alias("verdict"))


@query("sequelae_escalation", f"""SELECT id, CASE WHEN {BASE} = 'no_tb' AND tb_prob >= 0.35e0 AND tb_prob < 0.6105e0 AND s_inactive >= 0.7126e0
THEN 'abstain' ELSE {BASE} END AS verdict FROM signals""", "signals")
def _scar(v):
    d = v.signals.withColumn("base", base_verdict())
    return d.select("id", R.raised("base", R.scar_fires("base", "tb_prob", "s_inactive")).alias("verdict"))


# Records: screen results with gaps and free tags, derived per document.
RECORDS = f"""records AS (SELECT doc_id AS id,
 (['screen_positive','screen_negative','screen_negative','abstain'])[(floor({su('sc', 'doc_id')}*4))::INT + 1] AS screen,
 CASE WHEN {su('ver', 'doc_id')} < 0.4e0 THEN (['screen_positive','screen_negative'])[(floor({su('vs', 'doc_id')}*2))::INT + 1] END AS verifier_screen,
 CASE WHEN {su('lim', 'doc_id')} < 0.1e0 THEN 'limited view of ' || source END AS limitation,
 {su('score', 'doc_id')} AS score, {su('scar', 'doc_id')} AS scar_score,
 CASE WHEN {su('tag', 'doc_id')} < 0.2e0 THEN ['Apical_Fibrosis', lang] ELSE [lang, 'nodule'] END AS tags,
 (['low','medium','high'])[(floor({su('band', 'doc_id')}*3))::INT + 1] AS band FROM documents)"""


def records(v):
    def pick(values, seed):
        return F.element_at(F.array(*map(F.lit, values)), (F.floor(unit(seed, "doc_id") * len(values)) + 1).cast("int"))

    return v.table("documents").select(
        F.col("doc_id").alias("id"),
        pick(("screen_positive", "screen_negative", "screen_negative", "abstain"), "sc").alias("screen"),
        F.when(unit("ver", "doc_id") < 0.4, pick(("screen_positive", "screen_negative"), "vs")).alias("verifier_screen"),
        F.when(unit("lim", "doc_id") < 0.1, F.concat(F.lit("limited view of "), "source")).alias("limitation"),
        unit("score", "doc_id").alias("score"),
        unit("scar", "doc_id").alias("scar_score"),
        F.when(unit("tag", "doc_id") < 0.2, F.array(F.lit("Apical_Fibrosis"), "lang"))
        .otherwise(F.array("lang", F.lit("nodule"))).alias("tags"),
        pick(("low", "medium", "high"), "band").alias("band"),
    )


SCR2V = "CASE screen WHEN 'screen_positive' THEN 'tb' WHEN 'screen_negative' THEN 'no_tb' ELSE 'abstain' END"
TAGGED = "(len(list_filter(tags, lambda t: lower(t) LIKE '%fibrosis%' OR lower(t) LIKE '%scar%' OR lower(t) LIKE '%pleural_thickening%')) > 0)"


@query("scar_tag_match", f"SELECT id, {TAGGED} AS tagged FROM records", "", RECORDS)
def _tags(v):
    return records(v).select("id", R.scar_tag_match("tags").alias("tagged"))


@query("vlm_escalation", f"""SELECT id, CASE WHEN {SCR2V} = 'no_tb' AND score > 0.25e0 AND (scar_score >= 0.5e0 OR {TAGGED})
THEN 'abstain' ELSE {SCR2V} END AS verdict FROM records""", "", RECORDS)
def _vlm_esc(v):
    d = records(v).withColumn("base", R.screen_to_verdict("screen"))
    return d.select("id", R.raised("base", R.record_scar_fires("base", "score", "scar_score", "tags")).alias("verdict"))


@query("asymmetric_evidence", f"""SELECT id, CASE WHEN {BASE} = 'no_tb' AND tb_prob < 0.2e0 AND box_max >= 0.88e0 AND path_max >= 0.44e0
THEN 'abstain' ELSE {BASE} END AS verdict FROM signals""", "signals")
def _evidence(v):
    d = v.signals.withColumn("base", base_verdict())
    return d.select("id", R.raised("base", R.evidence_fires("base", "tb_prob", "box_max", "path_max")).alias("verdict"))


@query("activity_verdict", """SELECT id, verdict, CASE verdict WHEN 'YES' THEN 'active-suspect' WHEN 'NO' THEN 'none-on-screen'
ELSE 'indeterminate' END AS activity FROM (SELECT id, CASE WHEN tb_prob >= 0.61e0 THEN 'YES' WHEN tb_prob >= 0.305e0 OR s_inactive >= 0.5e0
THEN 'UNDETERMINED' ELSE 'NO' END AS verdict FROM signals)""", "signals")
def _activity(v):
    return v.signals.select(
        "id", R.activity_verdict("tb_prob", "s_inactive", F.lit(0.305), F.lit(0.61)).alias("a")).select("id", "a.*")


@query("review_band_escalation", f"""SELECT lang, n, n_fp, n_escalated, round(n_fp::DOUBLE/greatest(n,1), 6) AS fpr,
round((n_fp-n_escalated)::DOUBLE/greatest(n,1), 6) AS net_fpr FROM (SELECT lang, count(*) AS n, count(*) FILTER (tb_prob >= {THR}) AS n_fp,
count(*) FILTER (tb_prob >= {THR} AND tb_prob < least(0.95e0, {THR}+0.25e0) AND s_inactive >= 0.5e0) AS n_escalated FROM signals GROUP BY lang)""",
       "signals")
def _review(v):
    return rounded(R.review_band_escalation(v.signals, ["lang"], "tb_prob", "s_inactive", K.LOCKED_THR), "fpr", "net_fpr")


@query("verifier_trigger_local", "SELECT id, (tb_prob BETWEEN 0.2e0 AND 0.65e0) OR s_inactive >= 0.7126e0 AS fires FROM signals", "signals")
def _trigger(v):
    return v.signals.select("id", R.verifier_trigger_local("tb_prob", "s_inactive").alias("fires"))


@query("verifier_trigger_vlm", f"SELECT id, band = 'low' OR {TAGGED} OR score BETWEEN 0.2e0 AND 0.65e0 AS fires FROM records", "", RECORDS)
def _trigger_r(v):
    return records(v).select("id", R.verifier_trigger_record("band", "tags", "score").alias("fires"))


LOCALS = f"""locals AS (SELECT s.id, {BASE} AS verdict, CASE WHEN {su('net', 's.id')} < 0.1e0 THEN 'server note' END AS safety_net,
 verifier_screen, tb_prob, s_inactive, CASE WHEN {su('nobox', 's.id')} >= 0.1e0 THEN box_max END AS box_max, path_max,
 0.6105e0 AS threshold FROM signals s JOIN records r USING (id)),
st1 AS (SELECT *, CASE verdict WHEN 'tb' THEN 'screen_positive' WHEN 'no_tb' THEN 'screen_negative' ELSE 'abstain' END AS screen0 FROM locals),
st2 AS (SELECT *, coalesce(verifier_screen <> screen0, false) AS dis FROM st1),
st3 AS (SELECT *, CASE WHEN dis THEN 'abstain' ELSE verdict END AS v1 FROM st2),
st4 AS (SELECT *, v1 = 'no_tb' AND tb_prob >= 0.35e0 AND tb_prob < 0.6105e0 AND s_inactive >= 0.7126e0 AS sc FROM st3),
st5 AS (SELECT *, CASE WHEN sc THEN 'abstain' ELSE v1 END AS v2 FROM st4),
st6 AS (SELECT *, coalesce(v2 = 'no_tb' AND tb_prob < 0.2e0 AND box_max >= 0.88e0 AND path_max >= 0.44e0, false) AS ev FROM st5),
st7 AS (SELECT *, CASE WHEN ev THEN 'abstain' ELSE v2 END AS final_verdict, array_to_string(list_filter([
  'server safety net: ' || safety_net, CASE WHEN dis THEN 'gpt verifier disagreed (local=' || screen0 || ', verifier=' || verifier_screen || ')' END,
  CASE WHEN sc THEN 'client safety net escalated: {K.SCAR_REASON}' END,
  CASE WHEN ev THEN 'client safety net escalated: {K.EVIDENCE_REASON}' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM st6)"""


def locals_(v):
    rec = records(v).select("id", "verifier_screen")
    return v.signals.join(rec, "id").select(
        "id", base_verdict().alias("verdict"), F.when(unit("net", "id") < 0.1, "server note").alias("safety_net"),
        "verifier_screen", "tb_prob", "s_inactive", F.when(unit("nobox", "id") >= 0.1, F.col("box_max")).alias("box_max"),
        "path_max", F.lit(K.BORDERLINE_HIGH).alias("threshold"))


@query("combine_local", """SELECT id, final_verdict, reasons, final_verdict = 'abstain' AND verdict <> 'abstain' AS auto_abstained,
CASE WHEN final_verdict = 'abstain' THEN 'Refer: ' || CASE WHEN reasons <> '' THEN reasons ELSE 'safety net or verifier flagged for review' END || '.' END
AS abstain_reason, floor(greatest(5, least(95, 50 + (tb_prob-threshold)/greatest(0.001e0, CASE WHEN tb_prob >= threshold
THEN 1-threshold ELSE threshold END)*45)) + 0.5e0)::BIGINT AS confidence FROM st7""", "signals", RECORDS + ", " + LOCALS)
def _combine_local(v):
    out = R.combine_local(locals_(v))
    return out.select("id", "final_verdict", F.array_join("reasons", "; ").alias("reasons"), "auto_abstained",
                      "abstain_reason", "confidence")


CR = f"""cr1 AS (SELECT *, {SCR2V} AS mv, coalesce(verifier_screen <> screen, false) AS dis FROM records),
cr2 AS (SELECT *, CASE WHEN limitation IS NOT NULL AND (dis OR mv <> 'tb') THEN 'abstain' WHEN dis THEN 'abstain' ELSE mv END AS v2 FROM cr1),
cr3 AS (SELECT *, v2 = 'no_tb' AND score > 0.25e0 AND (scar_score >= 0.5e0 OR {TAGGED}) AS sc FROM cr2),
cr4 AS (SELECT *, CASE WHEN sc THEN 'abstain' ELSE v2 END AS final_verdict, array_to_string(list_filter([
 CASE WHEN dis THEN 'consistency check disagreed (primary=' || screen || ', verifier=' || verifier_screen || ')' END,
 'VLM limitation: ' || limitation, CASE WHEN sc THEN '{K.RECORD_SCAR_REASON}' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM cr3)"""


@query("combine_vlm", """SELECT id, mv AS model_verdict, final_verdict, reasons, final_verdict = 'abstain' AND mv <> 'abstain' AS auto_abstained,
CASE WHEN final_verdict = 'abstain' THEN 'Refer: ' || CASE WHEN reasons <> '' THEN reasons ELSE 'weak or uncertain evidence' END || '.' END AS abstain_reason,
greatest(0, least(90, floor(CASE band WHEN 'high' THEN 75e0 WHEN 'medium' THEN 55e0 ELSE 35e0 END + abs(score-0.5e0)*2*15 + 0.5e0)))::BIGINT AS confidence
FROM cr4""", "", RECORDS + ", " + CR)
def _combine_record(v):
    return R.combine_record(records(v)).select(
        "id", "model_verdict", "final_verdict", F.array_join("reasons", "; ").alias("reasons"), "auto_abstained",
        "abstain_reason", "confidence")


@query("confidence_ramp", """SELECT id, floor(greatest(5, least(95, 50 + (tb_prob-0.6105e0)/greatest(0.001e0, CASE WHEN tb_prob >= 0.6105e0
THEN 1-0.6105e0 ELSE 0.6105e0 END)*45)) + 0.5e0)::BIGINT AS confidence FROM signals""", "signals")
def _ramp(v):
    return v.signals.select("id", R.confidence_ramp("tb_prob", F.lit(K.BORDERLINE_HIGH)).alias("confidence"))


@query("confidence_band_score", """SELECT id, greatest(0, least(90, floor(CASE band WHEN 'high' THEN 75e0 WHEN 'medium' THEN 55e0 ELSE 35e0 END
+ abs(score-0.5e0)*2*15 + 0.5e0)))::BIGINT AS confidence FROM records""", "", RECORDS)
def _band_score(v):
    return records(v).select("id", R.confidence_band_score("band", "score").alias("confidence"))


@query("guardrail_abstain", f"""SELECT id, array_to_string(list_filter([CASE WHEN tb_prob*100 < 75 THEN 'confidence' END,
CASE WHEN s_inactive > 0.2e0 THEN 'std' END, CASE WHEN coalesce(top1, 1) < 0.6e0 AND path_max > 0.3e0 THEN 'retrieval' END,
CASE WHEN id % 4 >= 2 THEN 'replicate' END], lambda x: x IS NOT NULL), ',') AS reasons FROM (
SELECT *, CASE WHEN {su('top', 'id')} < 0.8e0 THEN box_max END AS top1 FROM signals)""", "signals")
def _guard(v):
    d = v.signals.withColumn("top1", F.when(unit("top", "id") < 0.8, F.col("box_max")))
    reasons = R.guardrail_reasons(F.col("tb_prob") * 100, "s_inactive", "top1", "path_max", F.col("id") % 4)
    return d.select("id", F.array_join(reasons, ",").alias("reasons"))


@query("ensemble_stats", """SELECT id, count(*) AS n_members, round(avg(prob), 6) AS mean_prob, round(stddev_pop(prob), 6) AS std,
round(max(prob)-min(prob), 6) AS disagreement FROM member_probs GROUP BY id""", "member_probs")
def _ens(v):
    return rounded(R.ensemble_stats(v.member_probs, "id"), "mean_prob", "std", "disagreement")


GRID = [(a, b, c) for a in (0.1, 0.2, 0.35) for b in (0.8, 0.88) for c in (0.44, 0.6)]


@query("rule_threshold_sweep", """SELECT a AS p_low, b AS box_high, c AS path_high,
count(*) FILTER (tb_prob < a AND box_max >= b AND path_max >= c AND label = 1) AS catch,
count(*) FILTER (tb_prob < a AND box_max >= b AND path_max >= c AND label = 0) AS false_abstain
FROM signals JOIN scored USING (id), (VALUES (0.1e0),(0.2e0),(0.35e0)) x(a), (VALUES (0.8e0),(0.88e0)) y(b), (VALUES (0.44e0),(0.6e0)) z(c)
GROUP BY ALL""", "signals scored")
def _sweep(v):
    d = v.signals.join(v.scored.select("id", "label"), "id")
    return R.rule_threshold_sweep(d, "tb_prob", "box_max", "path_max", "label", GRID)


@query("severity_bucket", """SELECT id, CASE WHEN tb_prob >= 0.5e0 THEN 'high' WHEN tb_prob >= 0.2e0 THEN 'mid' ELSE 'low' END AS bucket,
CASE WHEN tb_prob < 0.2e0 THEN 'no_tb' WHEN tb_prob < 0.5e0 THEN 'abstain' ELSE 'tb' END AS triad FROM signals""", "signals")
def _sev(v):
    return v.signals.select("id", R.severity_bucket("tb_prob").alias("bucket"), R.triad("tb_prob").alias("triad"))


@query("fallback_rate", """SELECT run_id, round(coalesce(avg((status = 'fallback')::INT) FILTER (stage <> 's0'), 0), 6) AS fallback_rate
FROM runs GROUP BY run_id""", "runs")
def _fallback(v):
    out = R.fallback_rate(v.runs, ["run_id"], F.col("status") == "fallback", F.col("stage") != "s0")
    return rounded(out, "fallback_rate")


HTTP = """http AS (SELECT event_id AS id, ([401,403,429,400,404,410,500])[(event_id % 7) + 1] AS code,
(['Model not supported by provider x','NOT FOUND','model not found','deprecated route','no longer supported',''])[(event_id % 6) + 1] AS body FROM events)"""


@query("classify_failure", """SELECT id, CASE WHEN code IN (401, 403) THEN 'unauthorized' WHEN code = 429 THEN 'rate-limited'
WHEN code IN (400, 404, 410) AND (lower(body) LIKE '%model not supported by provider%' OR lower(body) LIKE '%no longer supported%'
OR lower(body) LIKE '%model not found%' OR lower(body) LIKE '%deprecated%') THEN 'model-unsupported' ELSE 'other-error' END AS state FROM http""",
       "", HTTP)
def _classify(v):
    def nth(values, m):
        return F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % m + 1).cast("int"))

    code = nth((401, 403, 429, 400, 404, 410, 500), 7)
    body = nth(("Model not supported by provider x", "NOT FOUND", "model not found", "deprecated route",
                "no longer supported", ""), 6)
    return v.table("events").select(F.col("event_id").alias("id"), R.classify_failure(code, body).alias("state"))


@query("self_consistency_join", """SELECT id, screen, verifier_screen, coalesce(verifier_screen <> screen, false) AS disagreed
FROM records""", "", RECORDS)
def _self(v):
    verifier = records(v).filter("verifier_screen IS NOT NULL").select("id", "verifier_screen")
    return records(v).select("id", "screen").join(verifier, "id", "left").withColumn(
        "disagreed", F.coalesce(F.col("verifier_screen") != F.col("screen"), F.lit(False)))


