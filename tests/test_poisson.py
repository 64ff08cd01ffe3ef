"""Poisson(k) draws of combined cells: distribution, and rates against row-wise replicates."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions.hashing import poisson_count
from plumbline.operators import resample as B

N = 40_000


@pytest.mark.parametrize("mean", [1, 4, 9, 10, 11, 30, 1000, 10**9])
def test_moments_and_frequencies(spark, mean):
    draws = spark.range(N).select(poisson_count(F.lit(mean).cast("long"), "seed", "id").alias("w"))
    counts = {r["w"]: r["count"] for r in draws.groupBy("w").count().collect()}
    average = sum(w * c for w, c in counts.items()) / N
    variance = sum((w - average) ** 2 * c for w, c in counts.items()) / N
    assert abs(average - mean) < 5 * math.sqrt(mean / N)
    assert abs(variance / mean - 1) < 5 * math.sqrt((2 + 1 / mean) / N)
    if mean <= 30:
        expected = {w: N * math.exp(w * math.log(mean) - mean - math.lgamma(w + 1)) for w in range(4 * mean + 20)}
        usual = [w for w, e in expected.items() if e >= 8]
        chi = sum((counts.get(w, 0) - expected[w]) ** 2 / expected[w] for w in usual)
        assert chi < len(usual) + 5 * math.sqrt(2 * len(usual))


def test_draws_do_not_depend_on_partitions(spark):
    rows = spark.range(500).withColumn("k", F.col("id") % 40 + 1)
    a, b = (sorted(map(tuple, x.select("id", poisson_count(F.col("k"), 3, "id").alias("w")).collect())) for x in (rows.repartition(1), rows.repartition(7)))
    assert a == b and len({w for _, w in a}) > 20


def test_rate_interval_of_many_equal_rows(spark):
    rows = spark.range(60_000).selectExpr("'s' || (id % 3) AS site", "id % 10 < 3 AS hit", "id % 2 AS label")
    got = B.bootstrap_rate_ci(rows, ["site"], F.col("hit"), F.col("label") == 1, 500)
    exact = {r["site"]: r["rate"] for r in rows.filter("label = 1").groupBy("site").agg(F.avg(F.col("hit").cast("int")).alias("rate")).collect()}
    for r in got.collect():
        p = exact[r["site"]]
        sd = math.sqrt(p * (1 - p) / 10_000)
        assert r["rate"] == pytest.approx(p) and r["rate_lo"] == pytest.approx(p - 1.96 * sd, abs=0.6 * sd) and r["rate_hi"] == pytest.approx(p + 1.96 * sd, abs=0.6 * sd)
    assert B.bootstrap_rate_ci(rows.filter("false"), ["site"], F.col("hit"), F.lit(True), 10).count() == 0
