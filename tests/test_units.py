"""Literal fixtures: small inputs with known results."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import intervals, ranking
from plumbline.functions.maths import edge_bin, linspace_edges, logit, sigmoid
from plumbline.functions.skew import skew_attach
from plumbline.operators import arrays as G
from plumbline.operators import audits as A
from plumbline.operators import calibrate as C
from plumbline.operators import integrity as D
from plumbline.operators import metrics as M
from plumbline.operators import records as R
from plumbline.operators import resample as B
from plumbline.operators import retrieval as N
from plumbline.operators import rules as U
from plumbline.operators import splits as S


def scored(spark, y, s):
    return spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(s, y))], "id long, score double, label int")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_value_bucket_is_monotone(spark):
    rng = random.Random(5)
    xs = sorted([rng.uniform(-50, 50) for _ in range(500)] + [2.0**k for k in range(-45, 20)] + [-(2.0**k) for k in range(-45, 20)] + [0.0, 1 - 1e-16, 1 + 1e-15])
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(ranking.value_bucket("x")).collect()]
    assert got == sorted(got)


def test_ranked_equals_row_number(spark):
    rows = [(i, i % 3 if i % 7 else None, ((i * 37) % 101) / 3.0) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k int, x double")
    got = {r["id"]: (r["rn"], r["n"]) for r in ranking.ranked(df, ["k"], ["x", "id"], ranking.value_bucket("x"), size="n").collect()}
    for key in (None, 0, 1, 2):
        own = sorted((x, i) for i, k, x in rows if k == key)
        for place, (_, i) in enumerate(own, 1):
            assert got[i] == (place, len(own))


def test_skew_attach_keeps_every_row(spark):
    left = spark.createDataFrame([(i, 0 if i < 60 else i) for i in range(100)], "id long, k long")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    out = skew_attach(left, right, "k", ["id"], "n", rows_per_task=5).collect()
    assert len(out) == 100 and {r["first"] for r in out if r["k"] == 0} == {0}


def test_auc_ties_and_mirror(spark):
    y, s = [0, 1, 0, 1, 1, 0], [0.1, 0.1, 0.2, 0.2, 0.9, 0.3]
    want = np.mean([(a > b) + 0.5 * (a == b) for a, la in zip(s, y) if la for b, lb in zip(s, y) if not lb])
    df = scored(spark, y, s)
    a = one(M.auc(df, [])).auc
    mirrored = one(M.auc(df.withColumn("score", -F.col("score")), [])).auc
    assert a == pytest.approx(want) and a + mirrored == pytest.approx(1)


def test_single_class_auc_is_null(spark):
    assert one(M.auc(scored(spark, [1, 1], [0.1, 0.2]), [])).auc is None


def test_partial_auc_and_interp_of_separable(spark):
    steps = M.roc_steps(scored(spark, [0, 0, 0, 0, 1, 1, 1, 1], [0, 0.1, 0.2, 0.3, 0.7, 0.8, 0.9, 1]), [])
    assert one(M.partial_auc(steps, [])).pauc == pytest.approx(1)
    steps = M.roc_steps(scored(spark, [0, 0, 0, 1, 1, 1], [0.1, 0.2, 0.3, 0.7, 0.8, 0.9]), [])
    assert one(M.sens_at_spec_interp(steps, [], 0.7)).sens_at_spec == pytest.approx(1)


def test_group_bootstrap_counts_groups(spark):
    rows = [(i, i % 2, 0.9 if lab else 0.1, lab) for i, lab in enumerate([0, 0, 1, 0, 1, 1])]
    df = spark.createDataFrame(rows, "id long, grp long, logit double, label int")
    r = one(B.group_bootstrap(df, n_boot=20))
    assert (r.n_groups, r.n_pos + r.n_neg) == (2, 6) and r.auc == 1.0


def test_ece_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.3, 0.6, 0.7, 1.0)], "p double")
    got = [r[0] for r in df.select(edge_bin("p", linspace_edges())).collect()]
    edges = [i * 0.1 for i in range(10)] + [1.0]
    assert got == [max(i for i in range(10) if x >= edges[i]) for x in (0.0, 0.3, 0.6, 0.7, 1.0)]


def test_quantiles_match_linear_interpolation(spark):
    rng = np.random.default_rng(3)
    xs = rng.normal(size=101).round(1)
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    r = one(M.score_quantiles(df, [], "x", (0.01, 0.25, 0.99)))
    assert [r.q010, r.q250, r.q990] == pytest.approx(np.percentile(xs, [1, 25, 99]).tolist())


def test_clopper_pearson_solves_the_binomial_tails():
    """At the lower bound P(X >= k) is 2.5 %, at the upper bound P(X <= k) is 2.5 %."""
    cases = [(117, 139), (3, 40), (250, 260)]
    lo, hi = intervals.binomial_bounds(np.array([k for k, _ in cases]), np.array([n for _, n in cases]))
    for (k, n), a, b in zip(cases, lo, hi):
        def tail(p, ks):
            return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in ks)

        assert tail(a, range(k, n + 1)) == pytest.approx(0.025, abs=1e-8)
        assert tail(b, range(0, k + 1)) == pytest.approx(0.025, abs=1e-8)
    assert (round(lo[0], 3), round(hi[0], 3)) == (0.770, 0.898)
    edge_lo, edge_hi = intervals.binomial_bounds(np.array([0, 5, 0]), np.array([10, 5, 0]))
    assert edge_lo[0] == 0 and edge_hi[1] == 1 and math.isnan(edge_lo[2])


def test_calibration_split_sizes(spark):
    rng = random.Random(1)
    rows = [(i, f"s{rng.randrange(4)}", rng.randrange(2)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, source string, label int")
    first = {r.id: r.role for r in S.calibration_split(df, ["source", "label"]).collect()}
    again = {r.id: r.role for r in S.calibration_split(df.repartition(5), ["source", "label"]).collect()}
    n_cal = sum(v == "cal" for v in first.values())
    assert first == again and len(first) == 1000 and 195 <= n_cal <= 205


def test_doses_are_nested(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "id long, label int")
    got: dict[str, set] = {}
    for r in S.nested_doses(df, (20, 60, None)).collect():
        got.setdefault(r.dose, set()).add(r.id)
    assert got["20"] < got["60"] < got["ALL"] and len(got["20"]) == 20 and len(got["ALL"]) == 200


def test_group_minus_one_never_leaks(spark):
    train = spark.createDataFrame([(1, -1), (2, 5), (3, 6)], "id long, grp long")
    held = spark.createDataFrame([(9, -1), (8, 5)], "id long, grp long")
    assert {r.id for r in S.leak_guard(train, held).collect()} == {1, 3}


def test_conformal_contract(spark):
    rows = [(0.2 + 0.0075 * i, 1) for i in range(100)] + [(0.05 + 0.0055 * i, 0) for i in range(100)]
    df = spark.createDataFrame(rows, "p double, label int")
    r = one(C.conformal_thresholds(df, []))
    assert sum(p >= r.tau_low for p, y in rows if y) >= 92 and r.tau_high >= r.tau_low and not r.incomplete
    none = one(C.conformal_thresholds(df.filter("label = 0"), []))
    assert none.tau_low == 0 and none.incomplete


def test_temperature_above_one_when_overconfident(spark):
    rng = random.Random(2)
    rows = [((3.0 if (i % 2) == (rng.random() > 0.3) else -3.0), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "logit double, label int")
    assert one(C.fit_temperature_bounded(df, [])).temperature > 1


def test_fused_single_member_is_itself(spark):
    df = spark.createDataFrame([(1, "vlm", 0.83)], "id long, member string, prob double")
    assert one(C.fuse_log_odds(df, "id", {"tb": 0.2, "vlm": 0.8})).fused == pytest.approx(0.83)


def test_sigmoid_logit_round_trip(spark):
    df = spark.createDataFrame([(x,) for x in (-800.0, -3.0, 0.0, 4.0, 800.0)], "z double")
    got = [r[0] for r in df.select(logit(sigmoid("z"))).collect()]
    assert got[1:4] == pytest.approx([-3, 0, 4]) and got[0] == pytest.approx(-got[4])


def test_evidence_catch_rows_and_never_clears(spark):
    rows = [(0.040, 0.914, 0.72), (0.009, 0.882, 0.55), (0.003, 0.996, 0.66), (0.019, 0.928, 0.44)]
    df = spark.createDataFrame(rows, "p double, b double, q double")
    for base, want in (("no_tb", "abstain"), ("tb", "tb"), ("abstain", "abstain")):
        got = df.select(U.raised(F.lit(base), U.evidence_fires(F.lit(base), "p", "b", "q")))
        assert {r[0] for r in got.collect()} == {want}
    gap = df.select(U.evidence_fires(F.lit("no_tb"), "p", F.lit(None).cast("double"), "q"))
    assert {r[0] for r in gap.collect()} == {False}


def test_activity_truth_table(spark):
    rows = [(0.95, 0.9), (0.95, 0.1), (0.45, 0.9), (0.10, 0.9), (0.10, 0.1)]
    df = spark.createDataFrame(rows, "p double, s double")
    got = [r[0].verdict for r in df.select(U.activity_verdict("p", "s", F.lit(0.305), F.lit(0.61))).collect()]
    assert got == ["YES", "YES", "UNDETERMINED", "UNDETERMINED", "NO"]


def boxes(spark, crop, box):
    y0, y1, x0, x1 = crop
    x, y, w, h = map(float, box)
    return spark.createDataFrame([(1, x, y, w, h, y0, y1, x0, x1)], "id long, x double, y double, w double, h double, y0 long, y1 long, x0 long, x1 long")


@pytest.mark.parametrize("crop,box,want", [
    ((100, 900, 200, 1000), (200, 100, 100, 100), {(0, 0): 1.0}),
    ((0, 1024, 200, 968), (200, 0, 128, 128), {(0, 1): 1.0}),
    ((0, 1024, 0, 1024), (0, 0, 64, 128), {(0, 0): 0.5}),
    ((500, 900, 500, 900), (0, 0, 50, 50), {}),
])
def test_rasterize(spark, crop, box, want):
    got = {(r.gy, r.gx): r.value for r in G.rasterize_boxes(boxes(spark, crop, box)).collect()}
    assert got == pytest.approx(want)


def test_parse_bbox_forms(spark):
    rows = ["[]", "none", None, '[{"xmin":1,"ymin":2,"width":3,"height":4}]', "{'xmin': 1, 'ymin': 2, 'width': 3, 'height': 4}", '[{"xmin":"x","ymin":2,"width":3,"height":4},{"xmin":1,"ymin":2,"width":3,"height":4}]']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(F.size(R.parse_bbox("s"))).collect()]
    assert got == [0, 0, 0, 1, 1, 1]


def test_subgroups_and_empty_row(spark):
    wide = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (2, 0, 0), (3, 1, 1)], "id long, fibrosis int, nodule int")
    members = A.build_subgroups(wide, "id", ["fibrosis", "nodule"])
    got: dict[str, set] = {}
    for r in members.collect():
        got.setdefault(r.subgroup, set()).add(r.id)
    assert got == {"fibrosis": {0, 3}, "nodule": {1, 3}, "no_finding": {2}}
    scores = spark.createDataFrame([(i, p, 0) for i, p in enumerate((0.0, 0.5, 1.0, 0.2))], "id long, p double, label int")
    names = spark.createDataFrame([("nodule",), ("absent",)], "subgroup string")
    rows = {r.subgroup: r for r in A.stratified_fpr(scores, members, names, 0.5).collect()}
    assert rows["absent"].n == 0 and rows["absent"].fpr is None and rows["nodule"].n_fp == 1
    stray = spark.createDataFrame([(77, "nodule")], "id long, subgroup string")
    with pytest.raises(ValueError):
        A.assert_members_known(stray, scores)


@pytest.mark.parametrize("multiplier,verdict", [(2.0, "PASS"), (4.0, "WATCH"), (6.0, "FAIL")])
def test_fairness_gate(spark, multiplier, verdict):
    src = spark.createDataFrame([("a", 50, 2.0)], "source string, n_pos long, catch_cost_ratio double")
    find = spark.createDataFrame([("f", 100, multiplier), ("tiny", 3, 99.0)], "finding string, n long, multiplier double")
    assert one(A.fairness_gate(src, find)).verdict == verdict


def test_lock_refuses_inverted_band(spark):
    split = spark.createDataFrame([(1, "cal")], "id long, role string")
    with pytest.raises(ValueError):
        C.lock_protocol(split, 1.0, 0.1, 0.2, 7, 0.2)


def brute_components(sigs, t):
    root = {i: i for i in sigs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sigs)
    for a in ids:
        for b in ids:
            if a < b and sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(sigs[a], sigs[b])) <= t:
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("rows_per_task", [3, 1_000_000])
def test_signature_components_match_brute_force(spark, rows_per_task):
    """Chains and dense balls around a centre: pairs 7-12 apart only join through others."""
    rng = random.Random(11)
    sigs, n = {}, 0
    for _ in range(6):
        centre = [rng.getrandbits(64) for _ in range(4)]
        for _ in range(15):
            own = list(centre)
            for bit in rng.sample(range(256), rng.choice((1, 3, 5, 6, 9))):
                own[bit // 64] ^= 1 << (bit % 64)
            sigs[n] = tuple(own)
            n += 1
    walk = [rng.getrandbits(64) for _ in range(4)]
    for _ in range(12):
        for bit in rng.sample(range(256), 6):
            walk[bit // 64] ^= 1 << (bit % 64)
        sigs[n] = tuple(walk)
        n += 1
    signed = {i: tuple(x - 2**64 if x >= 2**63 else x for x in s) for i, s in sigs.items()}
    df = spark.createDataFrame([(i, *s) for i, s in signed.items()], "id long, s0 long, s1 long, s2 long, s3 long")
    reps = D.distinct_signatures(df)
    got = {r.rep: r.root for r in D.signature_components(reps, rows_per_task=rows_per_task).collect()}
    want = brute_components(signed, 6)
    assert {r: want[r] for r in got} == got and len(got) == len(set(signed.values()))


def test_knn_blocks_match_brute_force(spark):
    rng = np.random.default_rng(4)
    vecs = rng.normal(size=(60, 8))
    vecs[7] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "id long, v array<double>")
    got: dict[int, list] = {}
    for r in N.knn(df, df, 5, exclude_same=True, block_rows=17).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    norm = np.linalg.norm(vecs, axis=1)
    sims = np.divide(vecs @ vecs.T, norm[:, None] * norm, out=np.zeros((60, 60)), where=norm[:, None] * norm > 0)
    np.fill_diagonal(sims, -np.inf)
    for q in range(60):
        assert got[q] == sorted(range(60), key=lambda j: (-sims[q, j], j))[:5]


def test_halted_run_stays_halted(spark):
    from plumbline.streaming.runs import fold_runs

    rows = [(1, 1, "halted"), (1, 2, "finish"), (2, 1, "finish"), (3, 1, "stage_status")]
    got = {r.run_id: r.status for r in fold_runs(spark.createDataFrame(rows, "run_id long, seq long, kind string")).collect()}
    assert got == {1: "halted", 2: "done", 3: "running"}


def test_sinks_round_trip(spark, tmp_path):
    from plumbline.sources import tables as T

    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, role string")
    T.write_tables(df, str(tmp_path / "roles"), partition_by=("role",))
    assert spark.read.parquet(str(tmp_path / "roles")).count() == 2
    T.write_once(df.limit(1), str(tmp_path / "lock"))
    with pytest.raises(Exception):
        T.write_once(df.limit(1), str(tmp_path / "lock"))
    for _ in range(2):
        T.append_audit_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    assert T.write_increment(df, str(tmp_path / "parts"), "d1") and not T.write_increment(df, str(tmp_path / "parts"), "d1")
    (tmp_path / "img" / "tb").mkdir(parents=True)
    (tmp_path / "img" / "tb" / "x_1.PNG").write_bytes(b"1")
    (tmp_path / "img" / "note.txt").write_bytes(b"1")
    got = T.scan_file_manifest(spark, str(tmp_path / "img")).collect()
    assert [r.rel for r in got] == ["tb/x_1.PNG"]
    (tmp_path / "labels.csv").write_text("filename,label\nd/a.png,1\na.png,0\nb.png,x\n")
    from plumbline.operators.ingest import read_label_lines

    lines = T.read_label_lines(spark, str(tmp_path / "labels.csv"))
    assert [(r.filename, r.label) for r in read_label_lines(lines).collect()] == [("a.png", 0)]


def test_value_bucket_is_monotone_and_even(spark):
    rng = np.random.default_rng(5)
    edges = [0.0, 0.5, 1.0, 2.0**-40, 2.0**-41, 0.25, 3.0, 1e300, 5e-324]
    near = [np.nextafter(e, t) for e in edges for t in (-np.inf, np.inf)]
    draws = [*rng.normal(size=3000), *rng.random(3000), *(1 - rng.random(3000) * 1e-3), *rng.integers(-9, 9, 200), *edges, *near]
    values = sorted({float(x) for x in [*draws, *[-x for x in draws]]})
    rows = [(x,) for x in [*values, math.inf, -math.inf, math.nan, None]]
    out = spark.createDataFrame(rows, "x double").withColumn("b", ranking.value_bucket("x")).collect()
    of = {repr(r.x): r.b for r in out}
    in_order = [of[repr(x)] for x in [-math.inf, *values, math.inf, math.nan]]
    assert in_order == sorted(in_order) and of["None"] is None
    assert in_order[0] < in_order[1] and in_order[-3] < in_order[-2] < in_order[-1]


def test_crowded_scores_and_ids_have_small_buckets(spark):
    crowded = spark.range(50_000).select(F.when(F.col("id") % 10 > 0, 1 - F.rand(3) * 1e-3).otherwise(F.rand(4)).alias("x"))
    ids = spark.range(10**9, 10**9 + 50_000).select(F.col("id").cast("double").alias("x"))
    for df, bucket, most in ((crowded, ranking.value_bucket("x"), 60), (ids, ranking.id_bucket("x"), 1_100)):
        sizes = df.groupBy(bucket.alias("b")).count()
        assert sizes.agg(F.max("count")).first()[0] <= most


def test_scores_that_are_no_numbers_take_no_position(spark):
    rows = [(i, 0.2 + 0.0075 * i if i < 100 else 0.05 + 0.0055 * (i - 100), int(i < 100)) for i in range(200)]
    plain = spark.createDataFrame(rows, "id long, p double, label int")
    odd = spark.createDataFrame([(300 + i, x, 1) for i, x in enumerate([None, math.nan] * 40)], "id long, p double, label int")
    whole = plain.unionByName(odd)
    assert C.conformal_thresholds(whole, []).collect() == C.conformal_thresholds(plain, []).collect()
    take = lambda df: one(M.threshold_for_sensitivity_quantile(df, [], "p"))
    assert take(whole) == take(plain)
    assert C.safety_threshold(whole, []).collect() == C.safety_threshold(plain, []).collect()
    assert one(M.auc(whole, [], "p")) == one(M.auc(plain, [], "p"))


def test_infinite_scores_keep_their_order(spark):
    rows = [(0, -math.inf, 0), (1, 0.5, 0), (2, 0.7, 1), (3, math.inf, 1), (4, math.inf, 0)]
    df = spark.createDataFrame(rows, "id long, score double, label int")
    assert one(M.auc(df, []))["auc"] == pytest.approx((2 + 2.5) / 6)
    assert one(M.threshold_for_sensitivity_quantile(df, []))["threshold"] == 0.7


def test_text_signatures_of_word_runs_tell_order_apart(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [(1, " ".join(words)), (2, " ".join(reversed(words))), (3, "  ".join(words)), (4, "a b"), (5, "b a"), (6, None), (7, "")]
    rows = {r["id"]: tuple(r)[1:] for r in D.text_signatures(spark.createDataFrame(texts, "id long, text string")).collect()}
    assert rows[1] == rows[3] != rows[2] and rows[4] != rows[5] and rows[6] == rows[7]
    bags = {r["id"]: tuple(r)[1:] for r in D.text_signatures(spark.createDataFrame(texts, "id long, text string"), size=1).collect()}
    assert bags[1] == bags[2] and bags[4] == bags[5]


def test_localization_report_lifts_and_missing_ious(spark):
    kinds = "id long, hit boolean, iou_topk double, iou_fixed double"
    model = spark.createDataFrame([(i, i % 4 > 0, None if i == 0 else 0.5, 0.25) for i in range(40)], kinds)
    chance = spark.createDataFrame([(i, i % 4 == 0, 0.1, None) for i in range(40)], kinds)
    out = {r["map"]: r for r in A.localization_report({"model": model, "random": chance}, n_boot=200).collect()}
    m, c = out["model"], out["random"]
    assert (m["n"], m["hit_rate"], m["hit_lift"]) == (40, 0.75, 0.5)
    assert m["hit_lo"] < 0.75 < m["hit_hi"] and abs(m["miou_topk_lift"] - 0.4) < 1e-9
    assert abs(m["miou_topk_lo"] - 0.5) < 1e-9 and abs(m["miou_topk_hi"] - 0.5) < 1e-9
    assert c["miou_fixed"] is None and c["miou_fixed_lo"] is None and m["miou_fixed_lift"] is None and c["hit_lift"] == 0


def test_miss_diagnosis_orders_by_value_then_key(spark):
    rows = [(1, 1, 0.1, {"a": 0.2, "b": 0.9, "c": 0.9}, {"x": 0.5}), (2, 1, 0.1, None, {}), (3, 1, 0.2, {"a": 1.0}, {}), (4, 0, 0.1, {"a": 1.0}, {}), (5, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, label int, p double, zones map<string,double>, findings map<string,double>")
    out = {r["id"]: r for r in A.miss_diagnosis(df, n_zones=2).collect()}
    assert set(out) == {1, 2}
    assert [(z["key"], z["value"]) for z in out[1]["top_zones"]] == [("b", 0.9), ("c", 0.9)]
    assert out[2]["top_zones"] is None and out[2]["top_findings"] == []


def test_localization_report_reads_its_maps_once(spark):
    """Before, the scores of every map were derived anew for the draws, the means and each of the three lifts."""
    item = spark.range(40).select(F.col("id"), F.explode(F.array(F.lit(1))).alias("hit"), (F.col("id") / 80).alias("iou_topk"), F.lit(0.5).alias("iou_fixed"))
    out = A.localization_report({"model": item, "random": item}, n_boot=200)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 2
