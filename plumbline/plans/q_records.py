"""Record normalisation, validation and parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plumbline.functions.hashing import unit
from plumbline.operators import records as R
from plumbline.plans.common import rounded
from plumbline.plans.q_ingest import nested_runs
from plumbline.plans.registry import query
from plumbline.plans.views import su

# Raw submissions: JSON text per document with missing, mistyped and out-of-range fields.
QUALITIES = ("diagnostic", "diagnostic", "diagnostic", "limited", "blurry")
PROJECTIONS = ("pa_ap", "pa_ap", "lateral", "unknown", "side")
SCREENS = ("screen_positive", "screen_negative", "abstain", "maybe")
BANDS = ("low", "medium", "high", "high", "sure")
SCORES = ("0.4", "1.7", "-2", '"0.9"', "0.85")
FEATURES = ('["scar","x"]', '["a",1]', "[]", '"scar"')


def _nth(values, key: str, m: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % m % len(values) + 1).cast("int"))


def _snth(values, key: str, m: int) -> str:
    quoted = ", ".join("'" + x.replace("'", "''") + "'" for x in values)
    return f"([{quoted}])[({key} % {m} % {len(values)}) + 1]"


def submissions(v):
    q = F.lit('"')
    return v.table("documents").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 37 == 0, F.lit("not json")).otherwise(F.concat(
            F.lit('{"image_quality":"'), _nth(QUALITIES, "doc_id", 7), F.lit('","projection":"'), _nth(PROJECTIONS, "doc_id", 11),
            F.lit('","tb_screen_result":"'), _nth(SCREENS, "doc_id", 13), F.lit('","confidence_band":"'), _nth(BANDS, "doc_id", 17),
            F.lit('","tb_score_uncalibrated":'), _nth(SCORES, "doc_id", 19), F.lit(',"mimic_features_present":'),
            _nth(FEATURES, "doc_id", 23), F.lit(',"short_rationale":'),
            F.when(F.col("doc_id") % 5 == 0, F.lit('""')).otherwise(F.concat(q, "source", q)), F.lit("}"))).alias("raw"))


SUBS = f"""subs AS (SELECT doc_id AS id, CASE WHEN doc_id % 37 = 0 THEN NULL ELSE doc_id END AS k, {_snth(QUALITIES, 'doc_id', 7)} AS q0,
 {_snth(PROJECTIONS, 'doc_id', 11)} AS p0, {_snth(SCREENS, 'doc_id', 13)} AS s0, {_snth(BANDS, 'doc_id', 17)} AS b0,
 {_snth(SCORES, 'doc_id', 19)} AS t0, {_snth(FEATURES, 'doc_id', 23)} AS f0, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS r0 FROM documents),
n1 AS (SELECT id, CASE WHEN k IS NOT NULL AND q0 IN ('diagnostic','limited','nondiagnostic') THEN q0 ELSE 'limited' END AS image_quality,
 CASE WHEN k IS NOT NULL AND p0 IN ('pa_ap','lateral','unknown') THEN p0 ELSE 'unknown' END AS projection,
 CASE WHEN k IS NOT NULL AND s0 IN ('screen_positive','screen_negative','abstain') THEN s0 ELSE 'abstain' END AS scr,
 CASE WHEN k IS NOT NULL AND b0 IN ('low','medium','high') THEN b0 ELSE 'low' END AS confidence_band,
 CASE WHEN k IS NULL OR t0 LIKE '"%' THEN 0e0 ELSE greatest(0, least(1, t0::DOUBLE)) END AS tb_score,
 CASE WHEN k IS NOT NULL AND f0 = '["scar","x"]' THEN 'scar,x' ELSE '' END AS mimic_features,
 coalesce(CASE WHEN k IS NOT NULL THEN r0 END, '(no rationale returned)') AS why FROM subs),
n2 AS (SELECT *, array_to_string(list_filter([CASE WHEN image_quality <> 'diagnostic' THEN 'image_quality=' || image_quality END,
 CASE WHEN projection = 'unknown' AND scr = 'screen_positive' THEN 'projection=unknown with positive screen' END,
 CASE WHEN confidence_band = 'low' THEN 'confidence_band=low' END], lambda x: x IS NOT NULL), ', ') AS reasons FROM n1)"""


@query("normalize_submission", """SELECT id, image_quality, projection, confidence_band, tb_score, mimic_features,
CASE WHEN reasons <> '' THEN 'abstain' ELSE scr END AS screen,
CASE WHEN reasons <> '' AND scr <> 'abstain' THEN '[forced abstain: ' || reasons || '] ' || why ELSE why END AS rationale FROM n2""", "", SUBS)
def _norm(v):
    out = R.normalize_submission(submissions(v), "raw")
    return out.select("id", "image_quality", "projection", "confidence_band", "tb_score",
                      F.array_join("mimic_features", ",").alias("mimic_features"), "screen", "rationale")


VERDICTS = ("tb", "no_tb", "abstain", "YES")
PROBS = ("0.4", "0.61", '"high"', "1e-3")
NETS = ("null", '"scar"', "3")
MAPS = ('{"Effusion":0.2}', '{"Effusion":1.2}', '{"Effusion":"x"}', "{}")


def engine_rows(v):
    cell = F.when(F.col("doc_id") % 6 == 0, F.lit("1.5")).otherwise(F.lit("0.25"))
    row = F.concat(F.lit("["), F.array_join(F.array_repeat(cell, 8), ","), F.lit("]"))
    grid = F.concat(F.lit("["), F.array_join(F.array_repeat(row, 8), ","), F.lit("]"))
    return v.table("documents").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 41 == 0, F.lit("[1,2]")).otherwise(F.concat(
            F.lit('{"tb_prob":'), _nth(PROBS, "doc_id", 7), F.lit(',"tb_logit":0.1,"s_inactive":0.2,"verdict":"'), _nth(VERDICTS, "doc_id", 11),
            F.lit('","decided_at_threshold":0.61,"safety_net_applied":'), _nth(NETS, "doc_id", 13),
            F.lit(',"image_quality":{"warnings":[]},"latency_ms":{"total":3},"audit":{"model_id":"m","model_sha":"s","git_sha":"g"}'),
            F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(',"box_evidence_grid":'), grid)).otherwise(F.lit("")),
            F.lit(',"txrv_pathologies":'), _nth(MAPS, "doc_id", 17), F.lit("}"))).alias("raw"))


ENGINE = f"""eng AS (SELECT doc_id AS id, doc_id % 41 = 0 AS bad, {_snth(PROBS, 'doc_id', 7)} AS p0, {_snth(VERDICTS, 'doc_id', 11)} AS v0,
{_snth(NETS, 'doc_id', 13)} AS s0, {_snth(MAPS, 'doc_id', 17)} AS m0 FROM documents)"""


@query("validate_engine_result", """SELECT id, NOT bad AND violations = '' AS valid, CASE WHEN bad THEN
'object,tb_prob,tb_logit,s_inactive,verdict,decided_at_threshold,safety_net_applied,warnings,latency_ms,audit' ELSE violations END AS violations FROM (
SELECT id, bad, array_to_string(list_filter([CASE WHEN p0 LIKE '"%' THEN 'tb_prob' END, CASE WHEN v0 = 'YES' THEN 'verdict' END,
CASE WHEN s0 = '3' THEN 'safety_net_applied' END, CASE WHEN id % 6 = 0 THEN 'box_evidence_grid' END,
CASE WHEN m0 LIKE '%1.2%' OR m0 LIKE '%"x"%' THEN 'txrv_pathologies' END], lambda x: x IS NOT NULL), ',') AS violations FROM eng)""", "", ENGINE)
def _validate(v):
    out = R.validate_engine_result(engine_rows(v), "raw")
    return out.select("id", "valid", F.array_join("violations", ",").alias("violations"))


STATEMENTS = ('{"statement":"s1","likelihood":"primary"}', '{"statement":"","likelihood":"primary"}', '{"statement":"s2","likelihood":"sure"}', "7")


def reports(v):
    items = F.array_join(F.array(*[_nth(STATEMENTS[i:] + STATEMENTS[:i], "doc_id", 7) for i in (0, 1, 2, 0, 2, 2)]), ",")
    return v.table("documents").select(
        F.col("doc_id").alias("id"),
        F.concat(
            F.lit('{"headline":'), F.when(F.col("doc_id") % 3 == 0, F.lit("null")).otherwise(F.concat(F.lit('"h '), "lang", F.lit('"'))),
            F.lit(',"findings":{"pleura":"effusion"},"impression":['), items, F.lit('],"key_regions":["upper_r","nowhere","hilar"],"limitations":'),
            F.when(F.col("doc_id") % 4 == 0, F.lit('["SINGLE-VIEW FRONTAL RADiograph only"]')).otherwise(F.lit('["x",2]')),
            F.lit(',"support_devices":["","tube"]}')).alias("raw"))


REP = f"""rep AS (SELECT doc_id AS id, lang, {', '.join(f"{_snth(STATEMENTS[i:] + STATEMENTS[:i], 'doc_id', 7)} AS i{j}" for j, i in enumerate((0, 1, 2, 0, 2, 2)))}
FROM documents)"""


@query("normalize_report", """SELECT id, CASE WHEN id % 3 = 0 THEN 'Chest radiograph reviewed; see impression below.' ELSE 'h ' || lang END AS headline,
'effusion' AS pleura, 'The cardiomediastinal silhouette is unremarkable.' AS cardiomediastinum,
array_to_string(list_slice(list_filter(list_transform([i0,i1,i2,i3,i4,i5], lambda x: CASE WHEN x LIKE '%s1%' THEN 's1/primary' WHEN x LIKE '%s2%' THEN 's2/less_likely' END),
lambda y: y IS NOT NULL), 1, 4), ';') AS impression, 'upper_r,hilar' AS key_regions, 'tube' AS support_devices,
CASE WHEN id % 4 = 0 THEN 2 ELSE 2 END AS n_limitations FROM rep""", "", REP)
def _report(v):
    out = R.normalize_report(reports(v), "raw")
    imp = F.array_join(F.transform("impression", lambda d: F.concat_ws("/", d["statement"], d["likelihood"])), ";")
    return out.select("id", "headline", "pleura", "cardiomediastinum", imp.alias("impression"),
                      F.array_join("key_regions", ",").alias("key_regions"),
                      F.array_join("support_devices", ",").alias("support_devices"), F.size("limitations").alias("n_limitations"))


BOXES = ("none", "[]", "{'xmin': 1, 'ymin': 2, 'width': 3, 'height': 4}", '[{"xmin": 1.5, "ymin": 2, "width": 3, "height": 4}, {"xmin": "bad", "ymin": 2, "width": 3, "height": 4}]',
         "garbage", '[{"xmin": 5, "ymin": 2}, {"xmin": "7", "ymin": 1, "width": 1, "height": 1}]')


@query("parse_bbox", """SELECT doc_id AS id, ([0, 0, 1, 1, 0, 1])[(doc_id % 6) + 1] AS n_boxes,
([NULL, NULL, 1.0, 1.5, NULL, 7.0])[(doc_id % 6) + 1]::DOUBLE AS xmin FROM documents""")
def _bbox(v):
    raw = F.element_at(F.array(*map(F.lit, BOXES)), (F.col("doc_id") % 6 + 1).cast("int"))
    d = v.table("documents").select(F.col("doc_id").alias("id"), R.parse_bbox(raw).alias("b"))
    return d.select("id", F.size("b").alias("n_boxes"), F.get("b", F.lit(0))["xmin"].alias("xmin"))


XYXY = ('{"boxes":[{"xmin":1,"ymin":2,"xmax":5,"ymax":8,"label":"l"}]}', '{"predictions":[{"xmin":0,"ymin":0,"xmax":2,"ymax":2},{"xmin":"1"}],"boxes":[{"xmin":1,"ymin":1,"xmax":3,"ymax":3}]}',
        '[{"xmin":1,"ymin":1,"xmax":2,"ymax":4}]', "oops")


@query("parse_boxes_xyxy", """SELECT doc_id AS id, ([1, 2, 1, 0])[(doc_id % 4) + 1] AS n_boxes, ([4.0, 2.0, 1.0, NULL])[(doc_id % 4) + 1]::DOUBLE AS w,
([6.0, 2.0, 3.0, NULL])[(doc_id % 4) + 1]::DOUBLE AS h FROM documents""")
def _xyxy(v):
    raw = F.element_at(F.array(*map(F.lit, XYXY)), (F.col("doc_id") % 4 + 1).cast("int"))
    d = v.table("documents").select(F.col("doc_id").alias("id"), R.parse_boxes_xyxy(raw).alias("b"))
    first = F.get("b", F.lit(0))
    return d.select("id", F.coalesce(F.size("b"), F.lit(0)).alias("n_boxes"), first["w"].alias("w"), first["h"].alias("h"))


@query("parse_embedding", """SELECT id, CASE id % 6 WHEN 5 THEN 0 ELSE 64 END AS dims, round(CASE id % 6 WHEN 5 THEN NULL ELSE v[1]::DOUBLE END, 6) AS first_value
FROM vecs""", "vecs")
def _emb(v):
    flat = F.concat(F.lit("["), F.array_join(F.transform("v", lambda x: x.cast("double").cast("string")), ","), F.lit("]"))
    shape = F.col("id") % 6
    raw = (
        F.when(shape == 0, flat)
        .when(shape == 1, F.concat(F.lit("["), flat, F.lit(","), flat, F.lit("]")))
        .when(shape == 2, F.concat(F.lit("[["), flat, F.lit("],["), flat, F.lit("]]")))
        .when(shape == 3, F.concat(F.lit('{"embedding":'), flat, F.lit("}")))
        .when(shape == 4, F.concat(F.lit('{"data":[{"embedding":'), flat, F.lit("}]}")))
        .otherwise(F.lit('{"other":1}'))
    )
    d = v.vecs.select("id", R.parse_embedding(raw).alias("e"))
    return rounded(d.select("id", F.size("e").alias("dims"), F.get("e", F.lit(0)).alias("first_value")), "first_value")


@query("extract_json_from_text", """SELECT doc_id AS id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE '{"a": ' || doc_id || ', "b": {"c": 1}}' END AS body FROM documents""")
def _extract(v):
    body = F.concat(F.lit('{"a": '), "doc_id", F.lit(', "b": {"c": 1}}'))
    shape = F.col("doc_id") % 3
    raw = (
        F.when(shape == 0, F.concat(F.lit("Sure:\n```JSON\n"), body, F.lit("\n```\nbye")))
        .when(shape == 1, F.concat(F.lit("text "), body, F.lit(" more")))
        .otherwise(F.lit("no } json { here"))
    )
    return v.table("documents").select(F.col("doc_id").alias("id"), R.extract_json_from_text(raw).alias("body"))


@query("quality_gate", """SELECT doc_id AS id, lang <> 'en' OR n_chars < 100 AS halted,
CASE WHEN lang <> 'en' OR n_chars < 100 THEN CASE WHEN doc_id % 2 = 0 THEN 'lang ' || lang ELSE 'Image rejected by quality gate.' END END AS halt_reason
FROM documents""")
def _gate(v):
    quality = F.when(F.col("n_chars") < 100, "unreadable").otherwise("ok")
    reason = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("lang "), "lang"))
    out = R.quality_gate(v.table("documents"), F.col("lang") == "en", quality, reason)
    return out.select(F.col("doc_id").alias("id"), "halted", "halt_reason")


@query("content_fingerprint", """SELECT item_id AS id, lower(printf('%08x', list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split(text, ''),
lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295))) AS fnv, sha256(text) AS sha FROM benchmark""")
def _finger(v):
    return v.table("benchmark").select(F.col("item_id").alias("id"), R.content_fingerprint("text").alias("fnv"),
                                       F.sha2("text", 256).alias("sha"))


@query("percentile_clip_normalize", """SELECT event_id AS id, round((least(greatest(value, lo), lo + CASE WHEN hi <= lo THEN 1 ELSE hi - lo END) - lo)
/ CASE WHEN hi <= lo THEN 1 ELSE hi - lo END, 6) AS scaled FROM events JOIN (SELECT event_type, quantile_cont(value, 0.01) AS lo,
quantile_cont(value, 0.99) AS hi FROM events GROUP BY event_type) USING (event_type)""")
def _clip(v):
    ev = v.table("events").select(F.col("event_id").alias("id"), "event_type", "value")
    return rounded(R.percentile_clip_normalize(ev, ["event_type"], "value").select("id", "scaled"), "scaled")


@query("filter_by_source_label_finding", """SELECT id, source, label FROM scored WHERE label = 1 AND lang = 'en'
AND id IN (SELECT id FROM findings WHERE finding = 'no_finding')""", "scored findings")
def _filter(v):
    clean = v.findings.filter("finding = 'no_finding'").select("id")
    return v.scored.filter("label = 1 AND lang = 'en'").join(clean, "id", "left_semi").select("id", "source", "label")


@query("harvest_calibration_samples", f"""SELECT s.id, s.label, m AS member_probs, round(CASE WHEN has THEN {su('unc', 's.id')} END, 6) AS vlm_uncertainty,
m IS NULL AS halted FROM scored s LEFT JOIN (SELECT id, string_agg(member || '=' || round(prob, 4), ',' ORDER BY member) AS m, bool_or(member = 'vlm') AS has
FROM member_probs GROUP BY id) USING (id)""", "scored member_probs")
def _harvest(v):
    out = R.harvest_calibration_samples(nested_runs(v))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("member_probs")),
                                    lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"], 4))), ",")
    return rounded(out.select("id", "label", text.alias("member_probs"), "vlm_uncertainty", "halted"), "vlm_uncertainty")


@query("probe_pool_select", f"""SELECT id, 1 AS label, 'sequelae' AS source FROM scored WHERE label = 0 AND {su('probe', 'id')} < 0.5e0
UNION ALL SELECT id, 0, source FROM scored WHERE label = 1 AND source = 'src1'""", "scored")
def _probe(v):
    d = v.scored.select("id", "label", "source")
    return R.probe_pool_select(d.filter((F.col("label") == 0) & (unit("probe", "id") < 0.5)), d, "src1")
