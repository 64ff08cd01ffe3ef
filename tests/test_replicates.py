"""Replicated metrics against plain loops over the same md5 draws, and the rows that they exchange."""

import hashlib

import numpy as np
import pandas as pd
import pytest

from plumbline.functions import replicates as P
from plumbline.functions.hashing import TWO_32, poisson_cuts
from plumbline.operators import audits as A
from plumbline.operators import resample as B
from pyspark.sql import functions as F

N_BOOT = 230  # two slices, the second not full
ROWS = [(i, i // 3, "s%d" % (i % 2), i % 5 % 2, (i * 37 % 23) / 10 - 1) for i in range(60)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id long, grp long, site string, label int, logit double")


def weight(seed, key, rep):
    u = int(hashlib.md5(f"{seed}|{key}|{rep // 4}".encode()).hexdigest()[8 * (rep % 4) :][:8], 16) / TWO_32
    return sum(u >= c for c in poisson_cuts())


def plain_auc(rows, w, score=lambda r: r[4]):
    pos, neg = [[(score(r), w(r)) for r in rows if r[3] == y] for y in (1, 0)]
    pairs = sum(a * b for _, a in pos for _, b in neg)
    won = sum(a * b * ((x > y) + (x == y) / 2) for x, a in pos for y, b in neg)
    return won / pairs if pairs else None


def span(values):
    values = [v for v in values if v is not None]
    return [np.percentile(values, q) for q in (2.5, 97.5)]


def exchanged(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_that_span_pieces_stay_together():
    rows = pd.DataFrame({"name": [f"1|{i}" for i in range(1500)], "score": [0.5] * 1300 + [0.1] * 200, "y": [i % 2 == 0 for i in range(1500)], "k": 1})
    pieces = list(P.score_sums(rows, 0))
    p, n = (np.vstack(x) for x in zip(*pieces))
    w = P.weights(list(rows["name"]), 0)
    assert p.shape == (2, 200) and (p[1] == w[:1300:2].sum(axis=0)).all() and (n[0] == w[1301::2].sum(axis=0)).all()


def test_group_bootstrap_equals_plain_replicates(table):
    got = B.group_bootstrap(table, n_boot=N_BOOT).first()
    lo, hi = span([plain_auc(ROWS, lambda r, rep=rep: weight(11, r[1], rep)) for rep in range(N_BOOT)])
    assert (got.auc_lo, got.auc_hi) == pytest.approx((lo, hi))
    assert "poisson" not in exchanged(B.replicate_roc(table, "logit", "label", N_BOOT, 11, ["grp"], 0.2, 0.7)).lower()


def test_group_bootstrap_rows_do_not_multiply_by_replicates(table):
    """Before, 2,000 replicates of a row crossed the exchange and the offsets of all of them went to the driver for a broadcast."""
    rows = B._drawn_rows(table, [], "logit", "label", 11, ["grp"], None)
    dims, _ = B._by_slice(rows, [], 2000)
    assert dims == ["__b", "__s"] and P.slices(2000) == 10
    plan = exchanged(B.replicate_roc(table, "logit", "label", 2000, 11, ["grp"], 0.2, 0.7))
    assert "FlatMapCoGroupsInPandas" in plan and "Broadcast" not in plan


def test_auc_interval_equals_plain_replicates(table):
    got = {r["site"]: r for r in B.bootstrap_auc_ci(table, ["site"], n_boot=N_BOOT).collect()}
    for site, r in got.items():
        rows = [x for x in ROWS if x[2] == site]
        lo, hi = span([plain_auc(rows, lambda x, rep=rep: weight(11, x[0], rep)) for rep in range(N_BOOT)])
        assert (r["auc_lo"], r["auc_hi"]) == pytest.approx((lo, hi))
    assert "FlatMapGroupsInPandas" in exchanged(B.replicate_auc(table, ["site"], "logit", "label", N_BOOT, 11, ["id"]))


def test_auc_interval_leaves_out_null_and_nan_scores_and_keeps_a_null_key(spark, table):
    odd = spark.createDataFrame([(100, 1, None, 1, 0.5), (101, 1, None, 0, 0.1), (102, 1, "s0", 1, None), (103, 1, "s0", 0, float("nan"))], table.schema)
    clean, more = (B.bootstrap_auc_ci(d, ["site"], n_boot=N_BOOT).collect() for d in (table, table.unionByName(odd)))
    assert set(clean) == {r for r in more if r["site"] is not None}
    assert [(r["auc_lo"], r["auc_hi"]) for r in more if r["site"] is None] == [(1.0, 1.0)]


def test_rate_interval_draws_every_row(table):
    got = B.bootstrap_rate_ci(table, ["site"], F.col("logit") >= 0.5, F.col("label") == 1, N_BOOT, ident="id").collect()
    assert len(got) == 2
    for r in got:
        rows = [(x[0], x[4] >= 0.5) for x in ROWS if x[2] == r["site"] and x[3] == 1]
        w = [[weight(1, i, rep) for i, _ in rows] for rep in range(N_BOOT)]
        lo, hi = span([sum(a * h for a, (_, h) in zip(v, rows)) / sum(v) for v in w if sum(v)])
        assert (r["rate_lo"], r["rate_hi"]) == pytest.approx((lo, hi))


def test_rate_query_states_a_draw_per_row_in_sql():
    import __spark_entry__ as entry

    sql = entry.oracle_sql()["bootstrap_rate_ci"]
    assert "md5('1|' || id ||" in sql and "GROUP BY ALL), tries" not in sql


def test_full_fold_report_has_the_row_bootstrap_interval(table):
    """The interval of each fold is that of its rows' own draws; its AUCs come from score buckets, not from a row per replicate."""
    rows = table.withColumn("p", F.col("logit") / 4 + 0.5)
    got = {r["site"]: r for r in A.lodo_report_full(rows, "site", [], 0.5, n_boot=N_BOOT).collect()}
    assert set(got) == {"s0", "s1", "mean"} and got["mean"]["auc_lo"] is None
    for site in ("s0", "s1"):
        fold = [x for x in ROWS if x[2] == site]
        lo, hi = span([plain_auc(fold, lambda x, rep=rep: weight(11, x[0], rep)) for rep in range(N_BOOT)])
        assert (got[site]["auc_lo"], got[site]["auc_hi"]) == pytest.approx((lo, hi))
    assert "FlatMapGroupsInPandas" in exchanged(A.lodo_report_full(rows, "site", [], 0.5, n_boot=N_BOOT))


def test_paired_deltas_use_the_same_draws_for_both_scores(table):
    other = lambda r: (r[0] * 11 % 19) / 9 - 1
    two = table.withColumn("logit_b", (F.col("id") * 11 % 19) / 9 - 1)
    got = B.paired_bootstrap_delta(two, "logit", "logit_b", F.col("logit") >= 0.5, n_boot=N_BOOT, thr_b=F.col("logit_b") >= 0.5)
    plan, r = exchanged(got), got.first()
    auc, spec = [], []
    for rep in range(N_BOOT):
        w = lambda x, rep=rep: weight(2, x[0], rep)
        auc.append(plain_auc(ROWS, w, other) - plain_auc(ROWS, w))
        neg = [(w(x), (x[4] >= 0.5) - (other(x) >= 0.5)) for x in ROWS if x[3] == 0]
        spec.append(sum(a * d for a, d in neg) / sum(a for a, _ in neg))
    assert (r.d_auc_lo, r.d_auc_hi, r.d_spec_lo, r.d_spec_hi) == pytest.approx((*span(auc), *span(spec)))
    assert plan.count("FlatMapGroupsInPandas") == 2 and "MapInPandas" in plan


def test_weights_in_arrays_are_those_of_the_single_hashes():
    """Before, every hash was a call of its own. Names of several lengths, one past a block, and slices whose numbers have one to three digits."""
    names = [f"11|{i}" for i in range(80, 130)] + [f"seed|é{i}" for i in range(40)] + ["x" * 60]
    got = P.weights(names, 0, 3)
    assert got.shape == (len(names), 600) and (got[:, 400:] == P.weights(names, 2)).all()
    for i in (0, 19, 20, 49, 50, 89, 90):
        u = [hashlib.md5(f"{names[i]}|{rep // 4}".encode()).hexdigest()[8 * (rep % 4) :][:8] for rep in range(600)]
        assert got[i].tolist() == [sum(int(x, 16) / TWO_32 >= c for c in poisson_cuts()) for x in u]


def test_a_small_bucket_crosses_once_for_all_replicates(table):
    """Before, every row crossed once for each 200 replicates, in ten groups of work. A bucket of many rows is still dealt out."""
    rows = B._drawn_rows(table, ["site"], "logit", "label", 11, ["id"], None)
    dims, grouped = B._by_bucket(rows, ["site"], 2000)
    sizes = grouped.count()
    assert dims == ["site", "__b", "__shares", "__s"] and sizes.agg(F.sum("count")).first()[0] == len(ROWS)
    many = rows.withColumn("__b", F.lit(7)).withColumn("site", F.lit(None).cast("string")).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(100))))
    assert sorted(r["__s"] for r in B._by_bucket(many, ["site"], 2000)[1].count().collect()) == [0, 1]


def test_shares_of_replicates_are_complete(table, monkeypatch):
    whole = sorted(B.replicate_auc(table, ["site"], "logit", "label", 430, 11, ["id"]).collect())
    monkeypatch.setattr(B, "ROWS_PER_SHARE", 2)
    assert sorted(B.replicate_auc(table, ["site"], "logit", "label", 430, 11, ["id"]).collect()) == whole and len(whole) == 860


def test_paired_deltas_send_a_row_of_a_small_bucket_once(table):
    """Before, each row crossed ten times for each of the two scores."""
    rows = B._drawn_rows(table, [], "logit", "label", 2, ["id"], None)
    dims, grouped = B._by_bucket(rows, [], 2000)
    assert dims == ["__b", "__shares", "__s"] and grouped.count().agg(F.sum("count")).first()[0] == len(ROWS)


def test_splits_are_ranked_once(table):
    """Before, every reader of the twenty splits (curve, thresholds, counts, twice each) ranked the repeated rows anew."""
    rows = table.withColumn("p", F.col("logit") / 4 + 0.5)
    for got in (B.recalibrated_operating_point(rows, ["site"]), A.lodo_report_full(rows, "site", [], 0.5, n_boot=N_BOOT)):
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "explode(sequence(0, 19" not in plan and "explode(org.apache" not in plan and "__rn" not in plan
