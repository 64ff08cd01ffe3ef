"""Retrieval and linear probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import audits as A
from plumbline.operators import probes as P
from plumbline.operators import retrieval as N
from plumbline.operators import splits as S
from plumbline.plans.common import rounded
from plumbline.plans.registry import query

COS = "list_dot_product({a}.v::DOUBLE[], {b}.v::DOUBLE[]) / (sqrt(list_dot_product({a}.v::DOUBLE[], {a}.v::DOUBLE[])) * sqrt(list_dot_product({b}.v::DOUBLE[], {b}.v::DOUBLE[])))"


@query("cosine_similarity", f"SELECT a.id, round({COS.format(a='a', b='b')}, 6) AS similarity FROM vecs a JOIN vecs b ON b.id = a.id + 1", "vecs")
def _cos(v):
    nxt = v.vecs.select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
    return rounded(v.vecs.join(nxt, "id").select("id", N.cosine_similarity("v", "w").alias("similarity")), "similarity")


NN = f"""nn AS (SELECT query_id, id, greatest(0, least(1, s)) AS similarity, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM (
SELECT a.id AS query_id, b.id, {COS.format(a='a', b='b')} AS s FROM vecs a JOIN vecs b ON a.id <> b.id)) WHERE rank <= 5)"""


def neighbours(v):
    return N.knn(v.vecs, v.vecs, exclude_same=True)


@query("knn", "SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM nn", "vecs", NN)
def _knn(v):
    return rounded(neighbours(v), "similarity")


@query("knn_vote", "SELECT query_id, count(*) AS n, sum(label)::BIGINT AS n_pos, round(max(similarity), 6) AS top1 FROM nn JOIN vecs USING (id) GROUP BY query_id", "vecs", NN)
def _vote(v):
    return rounded(N.neighbour_vote(neighbours(v), v.vecs), "top1")


def features(v):
    return P.as_features(v.vecs).persist()


@query("linear_probe")
def _probe(v):
    d = features(v)
    return rounded(P.linear_probe(d).score(d).select("id", "label", "score"), "score", digits=3)


@query("probe_lodo")
def _lodo(v):
    return rounded(P.probe_lodo(v.vecs), "auc", digits=4)


@query("probe_lodo_means")
def _means(v):
    return rounded(P.lodo_means(P.probe_lodo(v.vecs)), "macro", "by_rows", "by_groups", digits=4)


@query("probe_within_source")
def _within(v):
    return rounded(P.probe_within_source(v.vecs), "auc", digits=4)


@query("probe_cross_site")
def _cross(v):
    d = features(v)
    return rounded(P.probe_cross_site(d.filter("source <> 's3'"), d.filter("source = 's3'")), "auc", digits=4)


@query("site_prediction")
def _site(v):
    out = P.site_prediction(features(v))
    return rounded(out, "cv_accuracy", "cv_std", "balanced_accuracy", "majority_chance", digits=4)


@query("site_vs_rest")
def _rest(v):
    return rounded(P.site_vs_rest(features(v), "s3"), "auc", digits=4)


@query("fit_population_sensitivity")
def _population(v):
    d = features(v)
    out = P.fit_population_sensitivity(d.filter("source <> 's3'"), d.filter("source = 's0'"), d.filter("source = 's3'"))
    return rounded(out, "auc", digits=4)


@query("channel_ablation")
def _ablation(v):
    d = features(v)
    return rounded(P.channel_ablation(d.filter("source <> 's3'"), d.filter("source = 's3'")), "auc", "retained", digits=4)


@query("confound_gate")
def _confound(v):
    d = features(v)
    within = P.probe_within_source(v.vecs).agg(F.avg("auc").alias("within"))
    lodo = P.probe_lodo(v.vecs, balanced=False).agg(F.avg("auc").alias("cross_source"))
    site = P.probe_cross_site(d.filter("source <> 's3'"), d.filter("source = 's3'")).select(F.col("auc").alias("cross_site"))
    out = within.join(lodo).join(site)
    gate = A.confound_gate(F.col("within"), F.col("cross_source"), F.col("cross_site"))
    return rounded(out.withColumn("verdict", gate), "within", "cross_source", "cross_site", digits=4)


@query("permutation_refit")
def _permutation(v):
    return rounded(P.permutation_check(v.vecs), "mean_auc", "lo", "hi", digits=4)


@query("permutation_refit_groups")
def _permutation_groups(v):
    """Whole groups keep one label; with the guard off, as the operator's user would to see whether groups leak."""
    return rounded(P.permutation_check(v.vecs, by="grp", guard=False), "mean_auc", "lo", "hi", digits=4)


@query("dose_refit")
def _dose(v):
    site = S.stratified_split(v.vecs.filter("source = 's3'"), test_frac=0.4, seed="pool")
    out = P.dose_refit(v.vecs.filter("source <> 's3'"), site.filter("role = 'train'"), site.filter("role = 'test'"))
    return rounded(out, "temperature", "threshold", "auc", "ece", "spec_at_sens", "sens_at_spec", "sens", "known_auc", "known_sens", digits=3)
