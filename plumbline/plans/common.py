"""Small helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.constants import LOCKED_LOW, LOCKED_T, LOCKED_THR
from plumbline.functions.maths import tempered
from plumbline.plans.views import ssig

DIGITS = 6

# Scored rows with the probability at the locked temperature.
SP = f"sp AS MATERIALIZED (SELECT *, {ssig(f'logit / {LOCKED_T!r}e0')} AS p FROM scored)"
THR, LOW, T = f"{LOCKED_THR!r}e0", f"{LOCKED_LOW!r}e0", f"{LOCKED_T!r}e0"

# ROC steps of sp per key {k} on score {s}.
ROC = """hist AS (SELECT {k} AS k, {s} AS s, count(*) FILTER (label = 1) AS np, count(*) FILTER (label = 0) AS nn
  FROM {t} GROUP BY ALL),
cum AS (SELECT k, s, np, nn, sum(np) OVER up AS tp, sum(nn) OVER up AS fp, sum(np) OVER (PARTITION BY k) AS allp,
  sum(nn) OVER (PARTITION BY k) AS alln FROM hist WINDOW up AS (PARTITION BY k ORDER BY s DESC)),
roc AS (SELECT k, s, np::BIGINT AS np, nn::BIGINT AS nn, tp::BIGINT AS tp, fp::BIGINT AS fp, allp::BIGINT AS allp,
  alln::BIGINT AS alln, tp::DOUBLE / nullif(allp, 0) AS tpr, fp::DOUBLE / nullif(alln, 0) AS fpr,
  (tp - np)::DOUBLE / nullif(allp, 0) AS tpr0, (fp - nn)::DOUBLE / nullif(alln, 0) AS fpr0 FROM cum)"""


def with_p(df: DataFrame) -> DataFrame:
    return df.withColumn("p", tempered("logit", LOCKED_T))


def rnd(c, name: str | None = None, digits: int = DIGITS) -> Column:
    c = F.col(c) if isinstance(c, str) and name is None else c
    if name is None:
        raise ValueError("name a computed column")
    return F.round(F.col(c) if isinstance(c, str) else c, digits).alias(name)


def rounded(df: DataFrame, *names: str, digits: int = DIGITS) -> DataFrame:
    """Round the named columns in place."""
    for n in names:
        df = df.withColumn(n, F.round(n, digits))
    return df


def exact_bounds(pairs: str, name: str = "exact") -> str:
    """CTEs {name}(k, n, lo, hi): Clopper-Pearson bounds of the (k, n) of `pairs`, by bisection over binomial tails."""
    term = "exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p) + (n - j) * ln(1 - p))"
    return f"""{name}_kn AS (SELECT DISTINCT k, n FROM ({pairs}) WHERE n > 0),
{name}_cut(k, n, side, lo, hi, i) AS (SELECT k, n, side, 0e0, 1e0, 0 FROM {name}_kn, (VALUES ('lo'), ('hi')) s(side) UNION ALL
SELECT k, n, side, CASE WHEN low THEN p ELSE lo END, CASE WHEN low THEN hi ELSE p END, i + 1 FROM (SELECT *, CASE WHEN side = 'lo'
THEN (SELECT sum({term}) FROM range(k, n + 1) r(j)) < 0.025e0 ELSE (SELECT sum({term}) FROM range(0, k + 1) r(j)) > 0.025e0 END AS low
FROM (SELECT *, (lo + hi) / 2 AS p FROM {name}_cut WHERE i < 50))),
{name} AS (SELECT k, n, max(CASE WHEN k = 0 THEN 0e0 ELSE lo END) FILTER (side = 'lo') AS lo,
max(CASE WHEN k = n THEN 1e0 ELSE lo END) FILTER (side = 'hi') AS hi FROM {name}_cut WHERE i = 50 GROUP BY k, n)"""
