"""Fits of many tasks at once against Newton steps, one task after the other."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_fits import newton

from plumbline.operators import multifit as MF
from plumbline.operators import probes as P

SCHEMA = "id long, label int, other int, source string, grp long, cell int, part int, v array<double>"


def table(n=240, size=5, seed=5):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, size)) * [1, 4, 0.3, 1, 2] + [0, 100, 1, 0, -3]
    y = (draw.random(n) < 1 / (1 + np.exp(-(x[:, 0] + 0.4 * (x[:, 1] - 100))))).astype(int)
    z = draw.integers(0, 2, n)
    return x, y, z


def frame(spark, x, y, z, parts=3):
    rows = [(i, int(y[i]), int(z[i]), f"s{i % 4}", i // 2, i % 4, i % 3, [float(v) for v in x[i]]) for i in range(len(x))]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def alone(x, y, used, balanced=False):
    """Decision values of all rows by a fit on the used ones."""
    n, y = used.sum(), y.astype(float)
    mean, dev = x[used].mean(axis=0), x[used].std(axis=0, ddof=1)
    w = np.where(y == 1, n / (2 * y[used].sum()), n / (2 * (n - y[used].sum()))) if balanced else np.ones(len(y))
    beta = newton((x[used] - mean) / dev, y[used], w[used], (n - 1) / n**2)
    return ((x - mean) / dev) @ beta[:-1] + beta[-1]


@pytest.mark.parametrize("balanced,one_partition", [(False, True), (True, False)])
def test_every_task_is_its_own_fit(spark, monkeypatch, balanced, one_partition):
    if not one_partition:
        monkeypatch.setattr(MF, "PRODUCTS_PER_PARTITION", 2000)
    monkeypatch.setattr(MF, "CELLS_PER_PRODUCT", 200)
    x, y, z = table()
    at = np.arange(len(x))
    df = frame(spark, x, y, z)
    rows = MF.task_rows(df, "v", ["label", "other"], scope=F.col("part"), bars=F.array("cell", (F.col("cell") + 1) % 4), level=F.col("id") % 5)
    tasks = MF.Tasks.of([(-1, 2, 9, 0), (-1, -1, 9, 1), (-1, -1, 2, 0), (1, 3, 9, 0), (2, -1, 3, 1)])
    fits = MF.fit_many(rows, tasks, balanced=balanced)
    barred = lambda c: (at % 4 == c) | ((at + 1) % 4 == c)
    used = [~barred(2), at >= 0, at % 5 <= 2, (at % 3 == 1) & ~barred(3), (at % 3 == 2) & (at % 5 <= 3)]
    for t, mask in enumerate(used):
        label = z if tasks.variant[t] else y
        want = alone(x, label, mask, balanced)
        assert fits.n[t] == mask.sum() and fits.n_pos[t] == label[mask].sum()
        assert np.abs(x @ fits.coef[:, t] + fits.intercept[t] - want).max() < 5e-3
    got = {(r.id, r.variant): r.score for r in fits.score(rows, ["id"]).collect()}
    want = alone(x, y, used[0], balanced)
    own = {i for i in at if i % 4 == 2}
    assert {i for i, k in got if i in own} == own
    assert max(abs(got[i, 0] - want[i]) for i in own) < 5e-3
    assert {i for i, k in got if i not in own} == {i for i in at if i % 4 == 3 and i % 3 == 1}
    whole = fits.score(rows, ["id"], held_out=False).groupBy("level").count().collect()
    assert {r.level: r["count"] for r in whole} == {9: 240, 2: 240, 3: 80}


def test_rows_without_numbers_and_tasks_without_classes(spark):
    x, y, z = table(60)
    bad = [(90, 1, 0, None, 1, 0, 0, None), (91, 1, 0, "s1", 1, 0, 0, [1.0, None, 0.0, 0.0, 0.0]),
           (92, 1, 0, "s1", 1, 0, 0, [float("nan")] * 5), (93, None, 0, "s1", 1, 0, 0, [0.0] * 5)]
    df = frame(spark, x, y, z).unionByName(spark.createDataFrame(bad, SCHEMA)).withColumn("v", F.transform("v", lambda e: e * 1.0))
    rows = MF.task_rows(df, "v", ["label"], bars=F.array("cell"))
    fits = MF.fit_many(rows, MF.Tasks.of([(-1, 1, 0, 0), (7, -1, 0, 0)]))
    assert list(fits.n) == [45, 0] and list(fits.fitted) == [True, False]
    assert fits.score(rows, ["id"]).count() == 15
    none = MF.fit_many(rows.filter("false"), MF.Tasks.of([(-1, 1, 0, 0)]))
    assert none.score(rows.filter("false"), ["id"]).count() == 0
    assert fits.score(rows.filter("false"), ["id"]).count() == 0
    constant = MF.fit_many(MF.task_rows(df.withColumn("v", F.array(F.lit(2.0), F.element_at("v", 1))).filter("id < 60")), MF.Tasks.of([(-1, -1, 0, 0)]))
    assert constant.coef[0, 0] == 0 and constant.coef[1, 0] != 0


def test_lodo_and_within_match_single_fits(spark):
    x, y, z = table()
    df = frame(spark, x, y, z)
    got = {r.source: r for r in P.probe_lodo(df, balanced=False).collect()}
    for s in range(4):
        mine = np.arange(len(x)) % 4 == s
        score = alone(x, y, ~mine)[mine]
        pos, neg = score[y[mine] == 1], score[y[mine] == 0]
        auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
        assert got[f"s{s}"].auc == pytest.approx(auc, abs=2e-3)
        assert (got[f"s{s}"].n, got[f"s{s}"].n_groups) == (60, 60)
    within = {r.source: r.auc for r in P.probe_within_source(df).collect()}
    assert len(within) == 4 and min(within.values()) > 0.7


def test_a_thousand_sources(spark):
    draw = np.random.default_rng(1)
    rows = [(i, i % 2, f"s{i // 4:04d}", i, [float(i % 2 + draw.normal()), float(draw.normal())]) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, label int, source string, grp long, v array<double>")
    out = P.probe_lodo(df)
    assert out.count() == 1000
    assert out.agg(F.avg("auc")).first()[0] == pytest.approx(0.76, abs=0.04)


def test_refit_on_permuted_labels_shows_groups_that_leak(spark):
    draw = np.random.default_rng(2)
    centre = draw.normal(size=(80, 48))
    rows = [(2 * g + k, g % 2, f"s{(g + k) % 4}", g, [float(v) for v in centre[g] + 0.01 * draw.normal(size=48)]) for g in range(80) for k in range(2)]
    df = spark.createDataFrame(rows, "id long, label int, source string, grp long, v array<double>")
    leaky = P.permutation_check(df, by="grp", guard=False).first()
    tight = P.permutation_check(df, by="grp").first()
    assert (leaky.verdict, leaky.n_perms) == ("FAIL", 3) and leaky.mean_auc > 0.8
    assert tight.verdict == "PASS" and tight.mean_auc < 0.6
    drawn = P.permuted_labels(df, 2, by="grp").collect()
    assert len(drawn) == 80 and all(sum(r[f"__y{k}"] for r in drawn) == 40 for k in range(2))


def test_dose_curve_trains_on_its_prefix(spark):
    x, y, z = table(400)
    df = frame(spark, x, y, z)
    corpus, site = df.filter("source <> 's3'"), df.filter("source = 's3'")
    out = {r.dose: r for r in P.dose_refit(corpus, site.filter("id < 240"), site.filter("id >= 240"), (20, None)).collect()}
    assert [(d, out[d].dose_n) for d in ("0", "20", "ALL")] == [("0", 0), ("20", 20), ("ALL", 60)]
    at = np.arange(400)
    test = (at % 4 == 3) & (at >= 240)
    for dose, used in (("0", at % 4 != 3), ("ALL", (at % 4 != 3) | (at < 240))):
        score = alone(x, y, used)[test]
        pos, neg = score[y[test] == 1], score[y[test] == 0]
        assert out[dose].auc == pytest.approx(np.mean([(a > b) for a in pos for b in neg]), abs=5e-3)
        p = 1 / (1 + np.exp(-score / out[dose].temperature))
        assert out[dose].sens == pytest.approx(np.mean(p[y[test] == 1] >= out[dose].threshold), abs=0.051)
    assert all(r.known_auc > 0.8 and r.forgetting == ("OK" if r.known_sens >= 0.846 else "WATCH") for r in out.values())
