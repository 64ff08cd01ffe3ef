"""The discriminant against densities computed directly, and held-out accuracy."""

import numpy as np
import pytest

from plumbline.llm import quality_classifier as qc


def texts(seed, n):
    draw = np.random.default_rng(seed)
    words = ["lung", "clear", "opacity", "left", "apical", "no", "the", "with", "pleural", "effusion", "mild", "heart"]
    rows = []
    for i in range(n):
        size = int(draw.integers(5, 200))
        if i % 4 == 0:
            kind = draw.integers(3)
            text = " ".join(draw.choice(words, size))
            text = [" ".join(w + "$$$" for w in text.split()), text.upper() + "!!" * size, " ".join(["lung"] * size)][kind]
        else:
            text = ", ".join(" ".join(draw.choice(words, 8)) for _ in range(size // 8 + 1)).capitalize() + "."
        rows.append((i, text, int(i % 4 != 0)))
    return rows


def test_scores_are_the_density_ratio():
    draw = np.random.default_rng(3)
    d = len(qc.STATISTICS)
    factors = [np.linalg.cholesky(np.cov(draw.normal(size=(d, 50)))) for _ in range(2)]
    means, centre, scale = draw.normal(size=(2, d)), draw.normal(size=d), draw.random(d) + 0.5
    dets = np.array([2 * np.log(np.diag(f)).sum() for f in factors])
    model = qc.Discriminant(centre, scale, means, np.array(factors), dets, 0.3)
    x = draw.normal(size=(20, d))
    for row, score in zip(x, model.scores(x), strict=True):
        z = (row - centre) / scale
        logs = []
        for c in range(2):
            cov = factors[c] @ factors[c].T
            away = z - means[c]
            logs.append(-0.5 * (away @ np.linalg.inv(cov) @ away + np.linalg.slogdet(cov)[1]))
        assert score == pytest.approx(1 / (1 + np.exp(-np.clip(0.3 + logs[1] - logs[0], -30, 30))), rel=1e-6)


def test_held_out_accuracy_and_odd_rows(spark):
    rows = texts(1, 600)
    cases = spark.createDataFrame([(i, t, 0.0) for i, t, _ in rows] + [(9000, None, 0.0), (9001, "", 0.0), (None, "x", 0.0)], "id long, rationale string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(1, None), (None, 1)], "id long, label int")
    got = {r["id"]: r for r in qc.score_cases(cases.repartition(3), labels).collect()}
    held = [(y, got[i]["predicted"]) for i, _, y in rows if i % 3 == 0]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values()) and {9000, 9001, None} <= set(got)
    assert got[9000]["score"] == got[9001]["score"]


def test_one_class_no_labels_and_no_rows(spark):
    cases = spark.createDataFrame([(1, "a b c"), (2, "d e f"), (3, "g")], "id long, rationale string")
    one = spark.createDataFrame([(1, 1), (2, 1)], "id long, label int")
    none = spark.createDataFrame([], "id long, label int")
    assert {r["score"] for r in qc.score_cases(cases, one).collect()} == {1.0}
    assert {r["score"] for r in qc.score_cases(cases, none).collect()} == {0.5}
    assert qc.score_cases(cases.limit(0), one).count() == 0
