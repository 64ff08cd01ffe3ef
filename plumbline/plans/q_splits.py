"""Splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import splits as S
from plumbline.plans.common import rounded
from plumbline.plans.registry import query
from plumbline.plans.views import su


def srank(strata: str, seed: str, ident: str = "id", name: str = "rn") -> str:
    part = f"PARTITION BY {strata} " if strata else ""
    return f"row_number() OVER ({part}ORDER BY {su(seed, ident)}, {ident}) AS {name}"


@query("calibration_split", f"""SELECT id, CASE WHEN rn <= CASE WHEN n > 1 THEN greatest(1, round_even(n*0.2e0, 0)) ELSE 0 END
THEN 'cal' ELSE 'eval' END AS role FROM (SELECT id, {srank('source, label', '7')}, count(*) OVER (PARTITION BY source, label) AS n FROM scored)""",
       "scored")
def _cal(v):
    return S.calibration_split(v.scored, ["source", "label"]).select("id", "role")


def quota_sql(table: str, frac: str) -> str:
    return f"""cq AS (SELECT label, n, sum(n) OVER () AS tot, ceil(sum(n) OVER () * {frac}) * n / sum(n) OVER ()::DOUBLE AS share FROM (
    SELECT label, count(*) AS n FROM {table} GROUP BY label)),
    quota AS (SELECT label, floor(share) + (row_number() OVER (ORDER BY share - floor(share) DESC, label)
      <= ceil(tot * {frac}) - sum(floor(share)) OVER ())::INT AS q FROM cq)"""


@query("stratified_split", f"""SELECT id, CASE WHEN rn <= q THEN 'test' ELSE 'train' END AS role
FROM (SELECT id, label, {srank('label', '7')} FROM scored) JOIN quota USING (label)""", "scored", quota_sql("scored", "0.2e0"))
def _strat(v):
    return S.stratified_split(v.scored).select("id", "role")


@query("holdout_pool_split", f"""SELECT id, CASE WHEN rn <= q THEN 'test' ELSE 'pool' END AS role
FROM (SELECT id, label, {srank('label', 'pool')} FROM scored) JOIN quota USING (label)""", "scored", quota_sql("scored", "0.4e0"))
def _pool(v):
    out = S.stratified_split(v.scored, test_frac=0.4, seed="pool").select("id", "role")
    return out.replace("train", "pool", "role")


@query("nested_doses", f"""SELECT dose, id, label FROM (SELECT id, label, {srank('label', '7')},
  count(*) OVER () AS n, sum(label) OVER () AS np FROM scored), (VALUES ('50', 50), ('150', 150), ('300', 300), ('ALL', 0)) d(dose, k)
WHERE dose = 'ALL' OR rn <= CASE WHEN label = 1 THEN least(round_even(k*(np::DOUBLE/n), 0), np)
  ELSE least(k - least(round_even(k*(np::DOUBLE/n), 0), np), n - np) END""", "scored")
def _doses(v):
    return S.nested_doses(v.scored, (50, 150, 300, None)).select("dose", "id", "label")


LODO = """folds AS (SELECT site AS fold FROM scored GROUP BY site HAVING count(DISTINCT label) = 2),
lodo AS (SELECT fold, id, label, logit, site, CASE WHEN site = fold THEN 'test'
 WHEN EXISTS (SELECT 1 FROM scored o WHERE o.grp = s.grp AND o.site = fold AND o.grp >= 0) THEN 'leak' ELSE 'train' END AS role
 FROM scored s CROSS JOIN folds)"""


@query("lodo_folds", "SELECT fold, id, role FROM lodo", "scored", LODO)
def _lodo(v):
    return S.lodo_folds(v.scored, "site").select("fold", "id", "role")


@query("stratified_kfold", f"SELECT id, ((rn - 1) % 5)::INT AS fold FROM (SELECT id, {srank('label', '7')} FROM scored)", "scored")
def _kfold(v):
    return S.stratified_kfold(v.scored, 5).select("id", "fold")


@query("stratified_group_kfold", f"""SELECT id, ((rn - 1) % 5)::INT AS fold FROM scored JOIN (
SELECT grp, {srank('major', '7', 'grp')} FROM (SELECT grp, (avg(label) >= 0.5)::INT AS major FROM scored GROUP BY grp)) USING (grp)""",
       "scored")
def _gkfold(v):
    return S.stratified_group_kfold(v.scored, 5).select("id", "fold")


@query("grouped_half_split", f"""SELECT id, CASE WHEN rn <= n // 2 THEN 'a' ELSE 'b' END AS half FROM scored JOIN (
SELECT grp, {srank('', '0', 'grp')}, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM scored)) USING (grp)""", "scored")
def _half(v):
    return S.grouped_half_split(v.scored).select("id", "half")


@query("parity_split", """SELECT id, CASE WHEN (row_number() OVER (PARTITION BY label ORDER BY id) - 1) % 2 = 0
THEN 'CAL' ELSE 'TST' END AS half FROM scored""", "scored")
def _parity(v):
    return S.parity_split(v.scored).select("id", "half")


@query("sample_per_class", f"""SELECT id, lang FROM (SELECT id, lang, {srank('lang', '7')} FROM scored)
WHERE rn <= CASE lang WHEN 'en' THEN 12 WHEN 'fr' THEN 5 WHEN 'de' THEN 4 ELSE 0 END""", "scored")
def _sample(v):
    return S.sample_per_class(v.scored, "lang", {"en": 12, "fr": 5, "de": 4}).select("id", "lang")


@query("cap_per_stratum", f"SELECT id, site, label FROM (SELECT id, site, label, {srank('site, label', '7')} FROM scored) WHERE rn <= 20",
       "scored")
def _cap(v):
    return S.cap_per_stratum(v.scored, ["site", "label"], 20).select("id", "site", "label")


RECAL = f"""resplit AS (SELECT *, CASE WHEN rn <= ceil(n * (1e0 - 0.2e0)) THEN 'eval' ELSE 'cal' END AS role FROM (
SELECT *, row_number() OVER (PARTITION BY site, split, label ORDER BY {su('7', 'split', 'id')}, id) AS rn,
count(*) OVER (PARTITION BY site, split, label) AS n FROM {{t}} CROSS JOIN range(20) r(split)))"""


@query("recal_splits", "SELECT split::INT AS split, site, label, role, count(*) AS n, sum(id)::BIGINT AS id_sum FROM resplit GROUP BY ALL",
       "scored", RECAL.format(t="scored"))
def _recal(v):
    return S.recal_splits(v.scored, ["site"]).groupBy("split", "site", "label", "role").agg(
        F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))


@query("permute_labels", f"""SELECT id, label, permuted FROM (SELECT id, label, {srank('', 'row0')} FROM scored) JOIN (
SELECT label AS permuted, {srank('', 'lab0')} FROM scored) USING (rn)""", "scored")
def _permute(v):
    return S.permute_labels(v.scored, 0).select("id", "label", "permuted")


@query("oof_scores", """SELECT *, n_missing = 0 AS complete FROM (SELECT (SELECT count(*) FROM scored) AS n_expected,
(SELECT count(*) FROM scored WHERE id NOT IN (SELECT id FROM lodo WHERE role = 'test')) AS n_missing,
(SELECT count(*) FROM (SELECT id FROM lodo WHERE role = 'test' GROUP BY id HAVING count(*) > 1)) AS n_repeated,
0::BIGINT AS n_foreign)""", "scored", LODO)
def _oof(v):
    folds = S.lodo_folds(v.scored, "site").filter("role = 'test'")
    return S.oof_coverage(v.scored, folds)


@query("random_baseline_scores", f"SELECT id, pos, round({su('7', 'id', 'pos')}, 8) AS random FROM cells", "cells")
def _random(v):
    return rounded(S.random_baseline_scores(v.cells).select("id", "pos", "random"), "random", digits=8)


@query("disjointness_assert", "SELECT 0::BIGINT AS n_shared, true AS disjoint")
def _disjoint(v):
    s = S.stratified_split(v.scored, test_frac=0.4, seed="pool")
    return S.disjoint(s.filter("role = 'train'"), s.filter("role = 'test'"))


@query("leak_guard", """SELECT id, site, grp FROM scored s WHERE site <> 's1' AND NOT EXISTS (
SELECT 1 FROM scored o WHERE o.site = 's1' AND o.grp = s.grp AND o.grp >= 0)""", "scored")
def _leak(v):
    return S.leak_guard(v.scored.filter("site <> 's1'"), v.scored.filter("site = 's1'")).select("id", "site", "grp")


@query("corpus_union_fresh_groups", """SELECT id, source, grp FROM scored UNION ALL
SELECT id, 'added' AS source, (SELECT max(grp) FROM scored) + row_number() OVER (ORDER BY id) AS grp FROM vecs WHERE label = 1""",
       "scored vecs")
def _fresh(v):
    added = v.vecs.filter("label = 1").select("id", F.lit("added").alias("source"))
    return S.fresh_groups(v.scored.select("id", "source", "grp"), added)


@query("fold_sizes", """SELECT fold, role, label, count(*) AS n FROM lodo GROUP BY ALL""", "scored", LODO)
def _fold_sizes(v):
    return S.lodo_folds(v.scored, "site").groupBy("fold", "role", "label").agg(F.count(F.lit(1)).alias("n"))


