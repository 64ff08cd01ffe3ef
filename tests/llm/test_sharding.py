"""Resharding: flow against brute force, balance, gapless slots and the rewritten files."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import sharding


def least_moved(old, caps):
    """All ways to keep bytes in place: what exceeds the own new shard has to move."""
    return sum(max(0, b - (caps[i] if i < len(caps) else 0)) for i, b in enumerate(old))


def test_flow_moves_the_fewest_bytes():
    draw = random.Random(5)
    for _ in range(60):
        old = [draw.randint(0, 30) for _ in range(draw.randint(1, 5))]
        n = draw.randint(1, 5)
        caps = [sum(old) // n + (j < sum(old) % n) for j in range(n)]
        flow = sharding.transfer_plan(old, caps)
        assert [sum(r) for r in flow] == old
        assert [sum(r[j] for r in flow) for j in range(n)] == caps
        assert sum(f for i, r in enumerate(flow) for j, f in enumerate(r) if i != j) == least_moved(old, caps)


def test_flow_with_other_costs_matches_enumeration():
    price = [[0, 5, 2], [4, 0, 9]]
    flow = sharding.transfer_plan([3, 2], [1, 2, 2], lambda i, j: price[i][j])
    got = sum(price[i][j] * flow[i][j] for i in range(2) for j in range(3))
    best = min(
        sum(price[i][j] * x for (i, j), x in zip(itertools.product(range(2), range(3)), f, strict=True))
        for f in itertools.product(range(4), repeat=6)
        if sum(f[:3]) == 3 and sum(f[3:]) == 2 and [f[0] + f[3], f[1] + f[4], f[2] + f[5]] == [1, 2, 2]
    )
    assert got == best


def test_refuses_too_little_room():
    with pytest.raises(ValueError):
        sharding.transfer_plan([5], [4])


def cases(spark, n, seed=1):
    draw = random.Random(seed)
    rows = [(i, 0 if draw.random() < 0.4 else draw.randrange(9), draw.choice([1, 5, 40, 900])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, shard int, size long")


def test_balance_and_slots(spark):
    out = sharding.reshard_cases(cases(spark, 3000), 4).toPandas()
    assert sorted(out["id"]) == list(range(3000))
    sizes = out.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 900
    for _, rows in out.groupby("shard"):
        assert sorted(rows["slot"]) == list(range(len(rows)))
    old = [int(out.loc[out["old_shard"] == i, "size"].sum()) for i in range(9)]
    least = least_moved(old, [sum(old) / 4] * 4)
    moved = out.loc[out["moved"], "size"].sum()  # rows are whole, so shards meet their capacity within a row
    assert abs(moved - least) <= 4 * 900


def test_nulls_ties_and_no_rows(spark):
    rows = [(None, None, None), (7, None, 3), (7, None, 3), (7, 1, 3), (8, 2, None)]
    out = sharding.reshard_cases(spark.createDataFrame(rows, "id long, shard int, size long"), 2).toPandas()
    assert len(out) == 5 and sorted(out["size"]) == [0, 0, 3, 3, 3]
    none = spark.createDataFrame([], "id long, shard int, size long")
    assert sharding.reshard_cases(none, 3).count() == 0


def test_one_row_over_many_shards(spark):
    rows = spark.createDataFrame([(1, 0, 10**9, "a")], "id long, shard int, size long, slot string")
    assert sharding.reshard_cases(rows, 8).count() == 1


def test_rewrites_only_what_changes(spark, tmp_path):
    rows = [(i, i % 3 if i < 90 else 3, 10, f"case {i}") for i in range(120)]
    table = spark.createDataFrame(rows, "id long, shard int, size long, rationale string")
    root, target = str(tmp_path / "old"), str(tmp_path / "new")
    table.write.partitionBy("shard").parquet(root)
    kept = sharding.rewrite_shards(spark, root, target, 4)
    assert kept == [0, 1, 2, 3]  # balanced already: nothing is written
    kept = sharding.rewrite_shards(spark, root, str(tmp_path / "more"), 5)
    assert kept == []
    new = spark.read.parquet(str(tmp_path / "more"))
    assert new.select("id", "rationale").exceptAll(table.select("id", "rationale")).count() == 0
    assert new.count() == 120 and [r["n"] for r in new.groupBy("shard").agg(F.count("*").alias("n")).collect()] == [24] * 5


def test_repeated_rows_stay_single_when_rewritten(spark, tmp_path):
    rows = [(None if i % 2 else 7, i % 2 and 3, 10, f"case {i}") for i in range(600)]
    table = spark.createDataFrame(rows, "id long, shard int, size long, rationale string")
    table.write.partitionBy("shard").parquet(f"{tmp_path}/old")
    kept = sharding.rewrite_shards(spark, f"{tmp_path}/old", f"{tmp_path}/new", 5)
    new = spark.read.parquet(f"{tmp_path}/new").collect()
    assert kept == [] and sorted(r["rationale"] for r in new) == sorted(r[3] for r in rows)
    assert sorted({s: sum(r["shard"] == s for r in new) for s in range(5)}.values()) == [120] * 5


def test_query_reads_its_rewritten_files(spark, tmp_path):
    import zlib

    from plumbline.llm.queries import QUERIES

    rows = [(i if i % 9 else None, None if i % 50 == 0 else f"é text {i % 70}" * (1 + i % 5), "en", f"s{i % 4}", 1) for i in range(700)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op1_reshard"](spark, str(tmp_path)).collect()
    plain = [((t or "").encode(), i) for i, t, *_ in rows]
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == sorted((i or -1, len(t) + 1, zlib.crc32(t)) for t, i in plain)
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    totals = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    assert max(totals) - min(totals) <= 3 * max(len(t) + 1 for t, _ in plain)


def test_query_without_documents(spark, tmp_path):
    from plumbline.llm.queries import QUERIES

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op1_reshard"](spark, str(tmp_path)).count() == 0


def test_rewrite_of_an_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([], "id long, size long, text string, shard int")
    rows.write.partitionBy("shard").parquet(f"{tmp_path}/old")
    assert sharding.rewrite_shards(spark, f"{tmp_path}/old", f"{tmp_path}/new", 3, rows.schema) == [0, 1, 2]
    assert spark.read.schema(rows.schema).parquet(f"{tmp_path}/new").count() == 0


def test_rewrite_keeps_columns_of_any_name(spark, tmp_path):
    names = ("file", "row", "block", "stored", "parts", "old_shard", "new_shard", "__row")
    made = spark.range(700).selectExpr("id", "10 + id % 7 AS size", *(f"id + {n} AS `{c}`" for n, c in enumerate(names)), "int(id % 2) AS shard")
    made = made.unionByName(made.filter("id < 5"))  # repeated rows
    made.write.partitionBy("shard").parquet(f"{tmp_path}/old")
    kept = sharding.rewrite_shards(spark, f"{tmp_path}/old", f"{tmp_path}/new", 3)
    assert kept == []
    got = spark.read.parquet(f"{tmp_path}/new")
    columns = ["id", "size", *names]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, made.select(*columns).collect()))
    sizes = [r["b"] for r in got.groupBy("shard").sum("size").withColumnRenamed("sum(size)", "b").collect()]
    assert len(sizes) == 3 and max(sizes) - min(sizes) <= 32
