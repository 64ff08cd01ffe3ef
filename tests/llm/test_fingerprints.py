"""Threshold sketches against plain shingle sets, and the next case against a sorted list."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import fingerprints
from plumbline.llm.queries import QUERIES


def plain_sketch(text):
    """Retained hashes of one text, shingle by shingle in Python integers."""
    import re

    mask = (1 << 64) - 1

    def mixed(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    points = [ord(c) + 32 if "A" <= c <= "Z" else ord(c) for c in re.sub("[ \t-\r]+", " ", text)]
    if 0 < len(points) < 16:
        points += [0xFFFFFFFF] * (16 - len(points))
    hashes = {mixed(sum(mixed(p + 1) * pow(fingerprints._BASE, 15 - i, 1 << 64) for i, p in enumerate(points[at : at + 16])) & mask) for at in range(len(points) - 15)}
    low = sorted(h for h in hashes if h < 1 << 59)
    return low or sorted(hashes)[:1]


def draw_text(draw, words):
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 9))) for _ in range(words))


def test_sketches_equal_plain_ones(monkeypatch):
    draw = random.Random(5)
    texts = ["", "a", "A  \t b", "é" * 15, "x" * 16, "x" * 500, "\U0001f600 " * 30, " lead", "trail \n", *(draw_text(draw, n) for n in (3, 40, 300))]
    want = [plain_sketch(t) for t in texts]
    assert [s.tolist() for s in fingerprints.sketches(texts)] == want
    monkeypatch.setattr(fingerprints, "POINTS_PER_STEP", 50)  # long texts go in stretches
    assert [s.tolist() for s in fingerprints.sketches(texts)] == want
    assert fingerprints.as_text(np.array([5, 1 << 60], np.uint64)) == "0000000000000005,1000000000000000"


def test_estimates(spark):
    draw = random.Random(6)
    small, rest = draw_text(draw, 400), draw_text(draw, 20_000)
    rows = [(1, small, rest + " " + small, draw_text(draw, 400)), (2, None, "", "abc"), (3, small, small.upper(), small + " " + small)]
    df = spark.createDataFrame(rows, "id long, rationale string, big string, other string")
    df = fingerprints.fingerprint_cases(df, {"rationale": "a", "big": "b", "other": "c"})
    inside, outside, near, same = fingerprints.containment, fingerprints.containment, fingerprints.similarity, fingerprints.similarity
    got = df.select(
        "id", inside(F.col("a"), F.col("b")).alias("inside"), outside(F.col("a"), F.col("c")).alias("outside"), near(F.col("a"), F.col("b")).alias("near"),
        same(F.col("a"), F.col("b")).alias("same"), fingerprints.merged(F.col("a"), F.col("b")).alias("merged"), "a", "b", "c",
    ).collect()
    got = {r["id"]: r for r in got}
    assert got[1]["inside"] > 0.99 and got[1]["outside"] == 0 and got[1]["near"] < 0.05
    assert set(got[1]["merged"].split(",")) == set(got[1]["a"].split(",")) | set(got[1]["b"].split(","))
    assert got[2]["a"] == got[2]["b"] == "" and got[2]["same"] == 1.0 and got[2]["outside"] == 0.0
    assert got[3]["same"] == 1.0 and got[3]["outside"] > 0.95


def test_next_case(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_CELL", 7)
    draw = random.Random(7)
    ids = draw.sample(range(-3000, 90_000), 200) + [10**12]
    rows = [(i, draw_text(draw, draw.randint(0, 5))) for i in ids] + [(ids[0], "same id"), (ids[0], "same id"), (None, "last")]
    cases = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "id long, rationale string, cell int, head int").repartition(4)
    in_order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = sorted(map(repr, ((*r, n[1]) for r, n in zip(in_order, [*in_order[1:], in_order[0]], strict=True))))
    assert sorted(repr(tuple(r)) for r in fingerprints.with_next(cases).collect()) == want


@pytest.mark.parametrize("rows", [[], [(4, "alone")], [(None, None), (None, None)], [(1, None), (2, "")]])
def test_few_cases(spark, rows):
    got = fingerprints.with_next(spark.createDataFrame(rows, "id long, rationale string")).collect()
    assert len(got) == len(rows)
    if len(rows) == 1:
        assert got[0]["next_rationale"] == "alone"


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    docs = sorted(((r["doc_id"], r["text"] or "") for r in docs), reverse=True)
    got = {r["doc_id"]: r for r in QUERIES["op12_fingerprints"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    import hashlib

    for (i, text), (_, after) in zip(docs, [*docs[1:], docs[0]], strict=True):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = (set(plain_sketch(t)) for t in (text, edited, after))
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == ",".join(f"{h:016x}" for h in sorted(a))
        assert r["edited_fingerprint"] == ",".join(f"{h:016x}" for h in sorted(b))
        assert r["near_edited"] == pytest.approx(1.0 if a == b else len(a & b) / len(a | b))
        assert r["near_next"] == pytest.approx(1.0 if a == c else len(a & c) / len(a | c))
