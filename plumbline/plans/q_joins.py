"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import constants as K
from plumbline.functions.maths import tempered
from plumbline.operators import joins as J
from plumbline.plans.common import LOW, THR, T, rounded
from plumbline.plans.registry import query
from plumbline.plans.views import ssig


@query("alignment_join", """SELECT count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS n_matched, count(*) FILTER (b.id IS NULL) AS n_only_features,
count(*) FILTER (a.id IS NULL) AS n_only_scores, 0::BIGINT AS n_repeated, count(*) FILTER (a.label <> b.label) AS n_label_differs,
count(*) FILTER (a.source <> b.source) AS n_source_differs FROM (SELECT * FROM scored WHERE lang <> 'fr') a FULL JOIN
(SELECT id, CASE WHEN id % 10 = 0 THEN 1 - label ELSE label END AS label, source FROM scored_b WHERE site <> 's3') b ON a.id = b.id""", "scored scored_b")
def _align(v):
    scores = v.scored_b.filter("site <> 's3'").withColumn(
        "label", F.when(F.col("id") % 10 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    return J.alignment_join(v.scored.filter("lang <> 'fr'"), scores)


@query("paired_score_join", "SELECT a.id, a.label, round(b.logit - a.logit, 6) AS delta FROM scored a JOIN scored_b b USING (id)", "scored scored_b")
def _paired(v):
    d = J.paired_scores(v.scored, v.scored_b)
    return rounded(d.select("id", "label", (F.col("logit_b") - F.col("logit")).alias("delta")), "delta")


@query("params_broadcast", f"""SELECT id, CASE WHEN {ssig(f'logit/{T}')} >= {THR} THEN 'TB' WHEN {ssig(f'logit/{T}')} >= {LOW} THEN 'ABSTAIN' ELSE 'NO_TB' END AS verdict
FROM scored""", "scored")
def _params(v):
    params = v.spark.createDataFrame([(K.LOCKED_T, K.LOCKED_THR, K.LOCKED_LOW)], "t double, thr double, low double")
    d = J.with_params(v.scored, params)
    p = tempered("logit", F.col("t"))
    return d.select("id", F.when(p >= F.col("thr"), "TB").when(p >= F.col("low"), "ABSTAIN").otherwise("NO_TB").alias("verdict"))
