"""Pooling, geometry and localisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.hashing import unit
from plumbline.functions.maths import sigmoid
from plumbline.operators import arrays as G
from plumbline.operators import audits as A
from plumbline.plans.common import rounded, with_p
from plumbline.plans.q_resample import N_BOOT_MEAN, ci, reps_sql
from plumbline.plans.registry import query
from plumbline.plans.views import ssig, su

KINDS = ("max", "mean", "p95", "top8mean", "lse", "wmax")


@query("pool_tokens", """SELECT id, gx, round(max(x),6) AS max, round(avg(x),6) AS mean, round(quantile_cont(x,0.95),6) AS p95,
round(avg(x) FILTER (rn <= 3),6) AS top8mean, round(max(x) + 0.1e0*ln(avg(exp((x-m)/0.1e0))),6) AS lse, round(least(max(x), quantile_cont(x,0.98)),6) AS wmax
FROM (SELECT *, max(x) OVER (PARTITION BY id, gx) AS m, row_number() OVER (PARTITION BY id, gx ORDER BY x DESC) AS rn FROM cells) GROUP BY id, gx""", "cells")
def _pool(v):
    return rounded(G.pool_tokens(v.cells, ["id", "gx"], "x", KINDS, top=3), *KINDS)


@query("l2norm_tokens", "SELECT id, pos, round(x / CASE WHEN n < 1e-8 THEN 1 ELSE n END, 6) AS u FROM (SELECT *, sqrt(sum(x*x) OVER (PARTITION BY id)) AS n FROM cells)", "cells")
def _l2(v):
    out = v.vecs.select("id", F.posexplode(G.l2norm_tokens("v")).alias("pos", "u"))
    return rounded(out, "u")


@query("apical_pool", "SELECT id, gx, round(avg(x), 6) AS pooled FROM cells WHERE gy < 3 GROUP BY id, gx", "cells")
def _apical(v):
    return rounded(G.apical_pool(v.cells, ["id", "gx"], "x"), "pooled")


@query("feature_concat", "SELECT id, len(v)*2 AS dims, round(v[1]::DOUBLE, 6) AS first_value, round(v[64]::DOUBLE, 6) AS last_value FROM vecs", "vecs")
def _concat(v):
    d = v.vecs.withColumn("f", G.feature_concat("v", "v"))
    return rounded(d.select("id", F.size("f").cast("bigint").alias("dims"), F.get("f", F.lit(64)).alias("first_value"),
                            F.get("f", F.lit(127)).alias("last_value")), "first_value", "last_value")


@query("scale_boxes", "SELECT id, box, round(x*1024e0/greatest(1, least(y1-y0, x1-x0)), 6) AS x, round(h*1024e0/greatest(1, least(y1-y0, x1-x0)), 6) AS h FROM boxes", "boxes")
def _scale(v):
    d = v.boxes.withColumn("bs", F.array(F.struct("x", "y", "w", "h")))
    out = d.select("id", "box", F.explode(G.scale_boxes("bs", F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))).alias("b"))
    return rounded(out.select("id", "box", "b.x", "b.h"), "x", "h")


@query("letterbox_params", """SELECT id, box, greatest(y1-y0, x1-x0) AS side, (greatest(y1-y0, x1-x0) - (x1-x0)) // 2 AS pad_x,
(greatest(y1-y0, x1-x0) - (y1-y0)) // 2 AS pad_y FROM boxes""", "boxes")
def _letter(v):
    return v.boxes.select("id", "box", G.letterbox_params("y0", "y1", "x0", "x1").alias("l")).select("id", "box", "l.*")


@query("map_crop_to_original", """SELECT id, box, round_even(x0*(2500/1024e0), 0)::BIGINT AS cx, round_even(y0*(2000/900e0), 0)::BIGINT AS cy,
round_even((x1-x0)*(2500/1024e0), 0)::BIGINT AS cw, round_even((y1-y0)*(2000/900e0), 0)::BIGINT AS ch FROM boxes""", "boxes")
def _crop(v):
    c = G.map_crop_to_original("y0", "y1", "x0", "x1", F.lit(1024), F.lit(900), F.lit(2500), F.lit(2000))
    return v.boxes.select("id", "box", c.alias("c")).select(
        "id", "box", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), F.col("c.w").alias("cw"), F.col("c.h").alias("ch"))


RAST = """rb0 AS (SELECT *, greatest(y1-y0, x1-x0)::DOUBLE AS side, (greatest(y1-y0, x1-x0) - (x1-x0)) // 2 AS pad_x, (greatest(y1-y0, x1-x0) - (y1-y0)) // 2 AS pad_y FROM boxes),
rb1 AS (SELECT id, box, side, pad_x, pad_y, greatest(0e0, least(1024e0, x) - x0) AS cx0, least((x1-x0)::DOUBLE, least(1024e0, x+w) - x0) AS cx1,
 greatest(0e0, least(1024e0, y) - y0) AS cy0, least((y1-y0)::DOUBLE, least(1024e0, y+h) - y0) AS cy1 FROM rb0),
rb2 AS (SELECT id, (cx0+pad_x)/side*8 AS gx0, (cx1+pad_x)/side*8 AS gx1, (cy0+pad_y)/side*8 AS gy0, (cy1+pad_y)/side*8 AS gy1 FROM rb1 WHERE cx1 > cx0 AND cy1 > cy0),
rb3 AS (SELECT id, gy::INT AS gy, gx::INT AS gx, least(gy+1e0, gy1) - greatest(gy, gy0) AS oy, least(gx+1e0, gx1) - greatest(gx, gx0) AS ox FROM rb2, range(8) a(gy), range(8) b(gx)),
rast AS (SELECT id, gy, gx, greatest(0, least(1, max(ox*oy))) AS value FROM rb3 WHERE ox > 0 AND oy > 0 GROUP BY ALL)"""


@query("rasterize_boxes", "SELECT id, gy, gx, round(value, 6) AS value FROM rast", "boxes", RAST)
def _rast(v):
    return rounded(G.rasterize_boxes(v.boxes), "value")


@query("rasterize_boxes_hard", "SELECT id, gy, gx, 1e0 AS value FROM rast", "boxes", RAST)
def _rast_hard(v):
    return G.rasterize_boxes(v.boxes, mode="hard")


@query("box_grid_overlap", "SELECT id, count(*) AS n_cells, round(sum(value), 6) AS coverage FROM rast GROUP BY id", "boxes", RAST)
def _overlap(v):
    return rounded(G.rasterize_boxes(v.boxes).groupBy("id").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("value").alias("coverage")), "coverage")


@query("grid_max", "SELECT id, round(max(x), 6) AS peak FROM cells GROUP BY id", "cells")
def _gmax(v):
    rows = F.array(*[F.slice(F.transform("v", lambda x: x.cast("double")), 1 + 8 * i, 8) for i in range(8)])
    return rounded(v.vecs.select("id", G.grid_max(rows).alias("peak")), "peak")


@query("grid_argmax", """SELECT id, round(x,6) AS peak, gy, gx, CASE WHEN gy < 2 THEN 'upper' WHEN gy < 5 THEN 'mid' ELSE 'lower' END || ' ' ||
CASE WHEN gx < 4 THEN 'right' ELSE 'left' END AS region FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY x DESC, pos) AS rn FROM cells) WHERE rn = 1""", "cells")
def _argmax(v):
    return rounded(G.grid_argmax(v.cells), "peak")


MAPS = "'Effusion', v[1]::DOUBLE), ('Lung Lesion', CASE WHEN id % 3 = 0 THEN v[2]::DOUBLE END), ('Mass', v[3]::DOUBLE), ('Edema', v[4]::DOUBLE), ('Hernia', v[5]::DOUBLE), ('Nodule', v[6]::DOUBLE"
ENTRIES = f"ent AS (SELECT id, k, x FROM vecs, LATERAL (VALUES ({MAPS})) t(k, x) WHERE x IS NOT NULL)"


def finding_maps(v):
    def at(i):
        return F.get("v", F.lit(i)).cast("double")

    base = F.create_map(F.lit("Effusion"), at(0), F.lit("Mass"), at(2), F.lit("Edema"), at(3), F.lit("Hernia"), at(4), F.lit("Nodule"), at(5))
    lesion = F.when(F.col("id") % 3 == 0, F.map_concat(base, F.create_map(F.lit("Lung Lesion"), at(1)))).otherwise(base)
    return v.vecs.select("id", lesion.alias("m"), "v")


@query("top_relevant_pathology", "SELECT id, round(max(x) FILTER (k IN ('Effusion', 'Lung Lesion')), 6) AS top FROM ent GROUP BY id", "vecs", ENTRIES)
def _relevant(v):
    return rounded(finding_maps(v).select("id", G.top_relevant("m").alias("top")), "top")


@query("top_k_map", "SELECT id, string_agg(k, ',' ORDER BY x DESC, k) AS keys, round(sum(x), 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY x DESC, k) AS rn FROM ent) WHERE rn <= 5 GROUP BY id", "vecs", ENTRIES)
def _topk(v):
    d = finding_maps(v).select("id", G.top_k_map("m", 5).alias("t"))
    return rounded(d.select("id", F.array_join(F.transform("t", lambda e: e["key"]), ",").alias("keys"),
                            F.aggregate("t", F.lit(0.0), lambda a, e: a + e["value"]).alias("total")), "total")


@query("evidence_digest", r"""SELECT id, 'verdict: ' || CASE WHEN tb_prob >= 0.6105e0 THEN 'tb' ELSE 'no_tb' END || chr(10) || 'tb_prob (calibrated under T=1.591): ' || printf('%.4f', tb_prob) || chr(10) ||
'decided_at_threshold: 0.6105' || chr(10) || 's_inactive (under T_seq=1.131): ' || printf('%.4f', s_inactive) ||
CASE WHEN id % 4 = 0 THEN chr(10) || 'safety_net_applied: scar' ELSE '' END || chr(10) || 'per-zone probabilities:' || chr(10) || CASE WHEN box_max > path_max OR box_max = path_max AND 'hilar' < 'upper_r'
THEN '  hilar: ' || printf('%.4f', box_max) || chr(10) || '  upper_r: ' || printf('%.4f', path_max) ELSE '  upper_r: ' || printf('%.4f', path_max) || chr(10) || '  hilar: ' || printf('%.4f', box_max) END ||
CASE WHEN id % 5 <> 0 THEN chr(10) || 'top-5 findings:' || (SELECT string_agg(chr(10) || '  ' || k || ': ' || printf('%.4f', x), '' ORDER BY x DESC, k) FROM (
SELECT k, x FROM (VALUES ('Effusion', tb_prob), ('Fibrosis', s_inactive), ('Mass', box_max), ('Nodule', path_max), ('Edema', 1 - tb_prob), ('Hernia', 1 - box_max)) e(k, x)
ORDER BY x DESC, k LIMIT 5)) ELSE '' END || CASE WHEN id % 3 = 0 THEN chr(10) || 'preprocessing warnings:' || chr(10) || '  - ' || lang ELSE '' END AS digest FROM signals""", "signals")
def _digest(v):
    d = v.signals.select(
        "id", F.when(F.col("tb_prob") >= 0.6105, "tb").otherwise("no_tb").alias("verdict"), F.lit(1.5914955557).alias("t"), F.lit(1.1313).alias("t_seq"),
        "tb_prob", F.lit(0.6105).alias("threshold"), "s_inactive", F.when(F.col("id") % 4 == 0, "scar").alias("safety_net"),
        F.create_map(F.lit("hilar"), "box_max", F.lit("upper_r"), "path_max").alias("zones"),
        F.when(F.col("id") % 5 != 0, F.create_map(
            F.lit("Effusion"), "tb_prob", F.lit("Fibrosis"), "s_inactive", F.lit("Mass"), "box_max", F.lit("Nodule"), "path_max",
            F.lit("Edema"), 1 - F.col("tb_prob"), F.lit("Hernia"), 1 - F.col("box_max"),
        )).otherwise(F.expr("cast(map() as map<string,double>)")).alias("findings"),
        F.when(F.col("id") % 3 == 0, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("warnings"))
    return d.select("id", G.evidence_digest(d).alias("digest"))


LOC = f"""loc AS MATERIALIZED (SELECT c.id, c.pos, {ssig('x*4')} AS ev, {su('7', 'c.id', 'pos')} AS rnd, coalesce(r.value, 0) AS gt FROM cells c JOIN (SELECT DISTINCT id FROM rast) USING (id)
LEFT JOIN rast r ON r.id = c.id AND r.gy = c.gy AND r.gx = c.gx)"""


def loc_sql(e: str, tag: str, name: str) -> str:
    return f"""{name} AS (SELECT id, arg_max(gt, ({e}, -pos)) > 0.5 AS hit, CASE WHEN max(k) > 0 THEN count(*) FILTER (rn <= k AND gt > 0.5)::DOUBLE / count(*) FILTER (rn <= k OR gt > 0.5) END AS iou_topk,
    CASE WHEN max(k) > 0 THEN count(*) FILTER ({e} >= 0.5 AND gt > 0.5)::DOUBLE / count(*) FILTER ({e} >= 0.5 OR gt > 0.5) END AS iou_fixed FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY {e} DESC, pos) AS rn, sum((gt > 0.5)::INT) OVER (PARTITION BY id) AS k FROM loc) GROUP BY id),
    {name}s AS (SELECT '{tag}' AS map, count(*) AS n, avg(hit::INT) AS hit_rate, avg(iou_topk) AS miou_topk, avg(iou_fixed) AS miou_fixed FROM {name})"""


def located(v):
    grid = G.rasterize_boxes(v.boxes).select("id", "gy", "gx", F.col("value").alias("gt"))
    boxed = grid.select("id").distinct()
    d = v.cells.join(boxed, "id", "left_semi").join(grid, ["id", "gy", "gx"], "left")
    return d.select("id", "pos", "gy", "gx", sigmoid(F.col("x") * 4).alias("ev"), unit("7", "id", "pos").alias("rnd"), F.coalesce("gt", F.lit(0.0)).alias("gt"))


@query("pointing_game", "SELECT id, hit FROM la", "cells boxes", RAST + ", " + LOC + ", " + loc_sql("ev", "model", "la"))
def _pointing(v):
    return G.pointing_game(located(v))


@query("iou_topk", "SELECT id, round(iou_topk, 6) AS iou_topk FROM la", "cells boxes", RAST + ", " + LOC + ", " + loc_sql("ev", "model", "la"))
def _ioutopk(v):
    return rounded(G.iou_scores(located(v)).select("id", "iou_topk"), "iou_topk")


@query("iou_fixed", "SELECT id, round(iou_fixed, 6) AS iou_fixed FROM la", "cells boxes", RAST + ", " + LOC + ", " + loc_sql("ev", "model", "la"))
def _ioufixed(v):
    return rounded(G.iou_scores(located(v)).select("id", "iou_fixed"), "iou_fixed")


LIFTS = ", ".join(f"round({c} - max({c}) FILTER (map = 'random') OVER (), 6) AS {m}_lift" for m, c in (("hit", "hit_rate"), ("miou_topk", "miou_topk"), ("miou_fixed", "miou_fixed")))


def span_sql(tag: str, reps: str) -> str:
    """Intervals of one map over its replicates."""
    iou = ", ".join(f"sum(w*{c})/sum(w) FILTER ({c} IS NOT NULL) AS {c}" for c in ("iou_topk", "iou_fixed"))
    return f"""SELECT '{tag}' AS map, {ci('hit', 'hit')}, {ci('iou_topk', 'miou_topk')}, {ci('iou_fixed', 'miou_fixed')}
FROM (SELECT rep, sum(w*hit::INT)::DOUBLE/sum(w) AS hit, {iou} FROM {reps} GROUP BY rep)"""


@query("localization_report", f"""SELECT map, n, round(hit_rate,6) AS hit_rate, round(miou_topk,6) AS miou_topk, round(miou_fixed,6) AS miou_fixed, {LIFTS},
hit_lo, hit_hi, miou_topk_lo, miou_topk_hi, miou_fixed_lo, miou_fixed_hi FROM (SELECT * FROM las UNION ALL SELECT * FROM lrs)
JOIN ({span_sql('model', 'ra')} UNION ALL {span_sql('random', 'rr')}) USING (map)""", "cells boxes",
       ", ".join((RAST, LOC, loc_sql("ev", "model", "la"), loc_sql("rnd", "random", "lr"), *(
           reps_sql(t, "id, hit, iou_topk, iou_fixed", "id", 7, N_BOOT_MEAN, r) for t, r in (("la", "ra"), ("lr", "rr"))))))
def _report(v):
    d = located(v)
    scores = {tag: G.localization_scores(d, evidence=column) for tag, column in (("model", "ev"), ("random", "rnd"))}
    out, spans = A.localization_report(scores, n_boot=N_BOOT_MEAN), ("hit", "miou_topk", "miou_fixed")
    return rounded(out, "hit_rate", "miou_topk", "miou_fixed", *(f"{m}_{e}" for m in spans for e in ("lift", "lo", "hi")))


MISSED = f"""missed AS (SELECT id, {ssig('logit / 1.5914955557015147e0')} AS p FROM scored WHERE label = 1),
zone AS (SELECT id, gy, max(x) AS x FROM cells GROUP BY id, gy),
zt AS (SELECT id, string_agg('row_' || gy, ',' ORDER BY x DESC, 'row_' || gy) AS zones, round(max(x), 6) AS zone_top FROM (
SELECT *, row_number() OVER (PARTITION BY id ORDER BY x DESC, 'row_' || gy) AS rn FROM zone) WHERE rn <= 4 GROUP BY id),
ft AS (SELECT id, string_agg(k, ',' ORDER BY x DESC, k) AS findings, round(max(x), 6) AS finding_top FROM (
SELECT *, row_number() OVER (PARTITION BY id ORDER BY x DESC, k) AS rn FROM ent) WHERE rn <= 5 GROUP BY id)"""


@query("confident_misses_evidence", """SELECT id, round(p, 6) AS p, zones, zone_top, findings, finding_top FROM missed LEFT JOIN zt USING (id) LEFT JOIN ft USING (id)
WHERE p < 0.35e0""", "scored cells vecs", ENTRIES + ", " + MISSED)
def _missed(v):
    rows = v.cells.groupBy("id", "gy").agg(F.max("x").alias("x"))
    # a grid has a fixed number of rows, so the map of an item is small
    zones = rows.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("row_"), "gy"), "x"))).alias("zones"))
    scores = with_p(v.scored).join(zones, "id", "left").join(finding_maps(v).select("id", F.col("m").alias("findings")), "id", "left")
    out = A.miss_diagnosis(scores, cut=0.35)
    tops = [c for name in ("zone", "finding") for c in (
        F.array_join(F.transform(f"top_{name}s", lambda e: e["key"]), ",").alias(f"{name}s"), F.get(f"top_{name}s", F.lit(0))["value"].alias(f"{name}_top"))]
    return rounded(out.select("id", "p", *tops), "p", "zone_top", "finding_top")


@query("cell_pos_weight", "SELECT round(greatest(1e0, (count(*) - count(*) FILTER (gt > 0.5))::DOUBLE / greatest(1, count(*) FILTER (gt > 0.5))), 6) AS pos_weight FROM loc", "cells boxes", RAST + ", " + LOC)
def _posw(v):
    return rounded(G.cell_pos_weight(located(v)), "pos_weight")


@query("class_weight", "SELECT site, round(greatest(1, count(*) FILTER (label=0))::DOUBLE / greatest(1, count(*) FILTER (label=1)), 6) AS weight FROM scored GROUP BY site", "scored")
def _classw(v):
    return rounded(G.class_weight(v.scored, ["site"]), "weight")


@query("total_variation", """SELECT id, round(avg(d) + avg(a), 6) AS tv FROM (SELECT id, abs(x - lag(x) OVER (PARTITION BY id, gx ORDER BY gy)) AS d,
abs(x - lag(x) OVER (PARTITION BY id, gy ORDER BY gx)) AS a FROM cells) GROUP BY id""", "cells")
def _tv(v):
    return rounded(G.total_variation(v.cells), "tv")


@query("attention_com_row", "SELECT id, round(sum(abs(x)*gy)/sum(abs(x)), 6) AS com_row FROM cells GROUP BY id", "cells")
def _com(v):
    return rounded(G.attention_com_row(v.cells.withColumn("w", F.abs("x"))), "com_row")
