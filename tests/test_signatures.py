"""Signatures against a plain loop, and how often texts are read for them."""

import hashlib
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import __spark_entry__  # noqa: F401
from plumbline.operators import integrity as D
from plumbline.plans import q_integrity as Q
from plumbline.plans.views import Views
from plumbline.session import spread_small

SF_DIR = "/root/testdata/sf0.001"
TEXTS = [None, "", " \n", "a", "a b", "a\x0bb c d e f g", "é ü\xa0x\x1fy  z\n\nq w\fr t", "\n x", "a b c d e", "a b c d e f", " ".join(map(str, range(5000)))]


def plain(text, size):
    words = [w for w in re.split(r"[ \t\n\r\f]+", text or "") if w]
    runs = [" ".join(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))]
    votes = [0] * 256
    for run in runs:
        bits = int.from_bytes(hashlib.sha256(run.encode()).digest(), "big")
        for i in range(256):
            votes[i] += bits >> (255 - i) & 1
    return "".join("1" if 2 * v > len(runs) else "0" for v in votes)


@pytest.mark.parametrize("size", [1, 5])
def test_signature_equals_plain_votes(size):
    for text in TEXTS:
        words = [int(w) % 2**64 for w in D._simhash(text, size)]
        assert "".join(f"{w:064b}" for w in words) == plain(text, size)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_audit_votes_each_text_once(spark):
    """The signatures are settled, so no join of the audit votes them again."""
    assert "EvalPython" not in plan(Q.audit(Views(spark, SF_DIR)))


def test_workers_keep_no_runs_and_get_texts_by_bytes(spark):
    D._digest.cache_clear()
    D._simhash(TEXTS[-1])
    assert D._digest.cache_info().currsize == 0
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    Q.signatures(Views(spark, SF_DIR))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20


def test_self_join_votes_each_text_once(spark):
    sigs = D.distinct_signatures(Q.signatures(Views(spark, SF_DIR), 1))
    assert "EvalPython" not in plan(D.near_dup_join(sigs))


def test_audit_exchanges_no_text(spark):
    """Before, labels too many to broadcast made the audit exchange every text twice more, to take its md5 behind the join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = Q.audit(Views(spark, SF_DIR))
        assert "text" not in plan(out) and "md5(" not in plan(out) and out.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_large_file_of_one_row_group_is_dealt_over_all_cores(spark, tmp_path):
    """Before, such a file had as many splits as cores, so it was left alone, and one task voted all its texts."""
    pq.write_table(pa.table({"id": list(range(4000)), "text": [hashlib.sha256(str(i).encode()).hexdigest() * 200 for i in range(4000)]}), tmp_path / "t.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "16k")
    try:
        df = spark.read.parquet(str(tmp_path / "t.parquet"))
        slots = spark.sparkContext.defaultParallelism
        assert df.rdd.getNumPartitions() >= slots
        held = spread_small(df).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert sum(held) == 4000 and max(held) < 1000
        even = df.repartition(slots * 2, "id")
        assert spread_small(even) is even
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_audit_lists_every_pair_of_items(spark):
    """Before, of the items with one text or signature the least id stood for all, and an exact match named the first train copy alone."""

    def sig(*flipped):
        words = [0x0123456789ABCDEF, 5, 0, 7]
        for bit in flipped:
            words[bit // 64] ^= 1 << bit % 64
        return [w - 2**64 if w >= 2**63 else w for w in words]

    signs = {"x": sig(), "y": sig(0), "z": sig(3, 63, 70, 128, 192, 255), "far": sig(3, 63, 70, 128, 192, 255, 130), "other": sig(*range(0, 256, 9))}
    held = [(1, 0, "x"), (2, 1, "x"), (3, 0, "x"), (None, 0, "x"), (4, 1, "y"), (5, 0, "far"), (5, 1, "other"), (6, 0, None)]
    train = [(11, 1, "x"), (12, 0, "x"), (12, 0, "x"), (13, 0, "z"), (14, 1, "y"), (None, 1, "y"), (15, 0, "far"), (16, 1, None)]

    def frame(rows):
        return spark.createDataFrame([(i, label, text, *signs[text or "other"]) for i, label, text in rows], "id long, label int, md5 string, s0 long, s1 long, s2 long, s3 long")

    def distance(a, b):
        return sum(bin((v ^ w) & (2**64 - 1)).count("1") for v, w in zip(signs[a or "other"], signs[b or "other"], strict=True))

    def copies(rows, text, near):
        return sum(1 for *_, t in rows if (distance(t, text) == 0 if near else t == text))

    wanted = []
    for i, a, x in held:
        for j, b, y in train:
            if x is not None and x == y:
                wanted.append(("md5-exact", 0, i, j, copies(held, x, False), copies(train, y, False), a, b))
            if distance(x, y) <= D.THRESHOLD:
                wanted.append(("near", distance(x, y), i, j, copies(held, x, True), copies(train, y, True), a, b))
    for block in (1, 2, 100):  # blocks of copies on either side are joined each with each
        found = [tuple(r) for r in D.holdout_overlap_audit(frame(held), frame(train), rows_per_block=block).collect()]
        assert sorted(found, key=str) == sorted(wanted, key=str)
    assert {("near", 0, 3, 12, 4, 3, 0, 0), ("near", 6, 2, 13, 4, 1, 1, 0), ("md5-exact", 0, None, 12, 4, 3, 0, 0)} <= set(found)


def test_verdict_counts_without_listing(spark):
    """An equal train text counts once for each holdout item, a near match once for each pair of items; no pair is listed for it."""
    rows = "id long, label int, md5 string, s0 long, s1 long, s2 long, s3 long"
    held = spark.createDataFrame([(i, 0, "x", 1, 2, 3, 4) for i in range(5)], rows)
    train = spark.createDataFrame([(i, 0, "x", 1, 2, 3, 4) for i in range(10, 17)], rows)
    assert tuple(D.overlap_verdict(D.overlap_counts(held, train)).first()) == (5 + 35, "ALARM")
    assert tuple(D.overlap_verdict(D.overlap_counts(held, train.limit(0))).first()) == (0, "CLEAN")
