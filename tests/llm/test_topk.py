"""Top-k against a full sort of every pair."""

import math
import random

from plumbline.llm import topk


def brute(rows, queries, k, scale):
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and usable(v)]
    out = []
    for q, v in whole:
        if q in queries:
            scored = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q]
            scored = [(max(-(2**63), min(2**63 - 1, -s)), i) for s, i in scored]
            scored.sort(key=lambda x: (-x[0], x[1]))
            out += [(q, r, i, s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def cases(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "id long, embedding array<float>, score string")


def run(spark, rows, queries, k=5, scale=1024.0, blocks=3):
    df = cases(spark, rows).repartition(4)
    got = topk.top_cases(df.filter(topk.F.col("id").isin(queries)), df, k, scale, blocks)
    return sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in got.collect())


def test_matches_full_sort(spark, monkeypatch):
    draw = random.Random(1)
    rows = [(i, [draw.choice([-1.5, -0.25, 0.0, 0.5, 2.0]) for _ in range(4)]) for i in range(300)]  # many ties
    queries = [0, 7, 100, 299]
    assert run(spark, rows, queries) == brute(rows, queries, 5, 1024.0)
    monkeypatch.setattr(topk, "MERGE_FAN", 2)
    assert run(spark, rows, queries, blocks=9) == brute(rows, queries, 5, 1024.0)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.5, 0.5]), (5, [0.5, 0.5]), (None, [9.0, 9.0]), (6, [1.0]), (7, [])]
    got = run(spark, rows, [0, 1, 2, 3, 4])
    assert [(r[0], r[2]) for r in got] == [(0, 5), (0, 5), (0, 6), (0, 7)]


def test_values_beyond_doubles(spark):
    rows = [(0, [2.0**52, 1.0]), (1, [2.0**51, 7.0]), (2, [-(2.0**51), 1.0]), (3, [1.0, 1.0])]  # exact as 32-bit floats
    assert run(spark, rows, [0], k=3, scale=1.0) == brute([(i, v) for i, v in rows], [0], 3, 1.0)


def test_no_rows_and_few_rows(spark):
    assert run(spark, [], [0]) == []
    assert run(spark, [(0, [1.0])], [0]) == []
    assert len(run(spark, [(0, [1.0]), (1, [2.0])], [0])) == 1
