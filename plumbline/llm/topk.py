"""Exact top-k retrieval over the labelled case corpus by tiled matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

QUERY_TILE = 1_024
CASE_TILE = 4_096
MERGE_FAN = 32
#: Sums of products below this are exact in a double, so BLAS may form them.
EXACT = 2**53

TILE_SCHEMA = "n int, dim int, ids binary, parts binary"
HIT_SCHEMA = "query_id long, id long, score long, part int"


def usable(cases: DataFrame) -> DataFrame:
    """Cases with an id and a vector of finite numbers."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return cases.select("id", "embedding").filter(F.col("id").isNotNull() & F.col("embedding").isNotNull() & good)


def quantised(cases: DataFrame, scale: float) -> DataFrame:
    """`v` = floor(scale * x) of every component, as whole numbers."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return cases.select("id", whole.alias("v"))


def _pack(rows: int):
    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tile(table: pa.Table) -> pa.RecordBatch:
            ids = table.column("id").to_numpy().astype(np.int64)
            lists = table.column("v").combine_chunks()
            lens = np.diff(lists.offsets.to_numpy())
            dim = int(lens.max(initial=0))
            flat = lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
            m = np.zeros((len(ids), dim), np.int64)
            m[np.arange(dim) < lens[:, None]] = flat
            return pa.RecordBatch.from_pydict(
                {"n": pa.array([len(ids)], pa.int32()), "dim": pa.array([dim], pa.int32()), "ids": [ids.tobytes()], "parts": [m.tobytes()]}
            )

        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            if sum(b.num_rows for b in kept) >= rows:
                table = pa.Table.from_batches(kept)
                whole = table.num_rows // rows * rows
                for at in range(0, whole, rows):
                    yield tile(table.slice(at, rows).combine_chunks())
                kept = table.slice(whole).to_batches()
        if sum(b.num_rows for b in kept):
            yield tile(pa.Table.from_batches(kept).combine_chunks())

    return tiles


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: doubles while every sum fits, 64 bits, then Python integers cut to 64 bits."""
    dim = max(q.shape[1], c.shape[1])
    q, c = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in (q, c))
    most = int(np.abs(q.astype(object)).max(initial=0)) if q.size and q.min() == np.iinfo(np.int64).min else int(np.abs(q).max(initial=0))
    other = int(np.abs(c.astype(object)).max(initial=0)) if c.size and c.min() == np.iinfo(np.int64).min else int(np.abs(c).max(initial=0))
    bound = most * other * max(dim, 1)
    if bound < EXACT:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return q @ c.T
    big = q.astype(object) @ c.astype(object).T
    return np.clip(big, -(2**63), 2**63 - 1).astype(np.int64)


def _select(k: int):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qid, cid = (np.frombuffer(row[x], np.int64) for x in ("q_ids", "c_ids"))
                q = np.frombuffer(row["q_parts"], np.int64).reshape(row["q_n"], row["q_dim"])
                c = np.frombuffer(row["c_parts"], np.int64).reshape(row["c_n"], row["c_dim"])
                by_id = np.argsort(cid, kind="stable")  # then equal scores come in the order of their ids
                cid, scores = cid[by_id], _products(q, c[by_id])
                out: dict[str, list[np.ndarray]] = {x: [] for x in ("query_id", "id", "score")}
                for i, s in enumerate(scores):
                    at = np.flatnonzero(cid != qid[i])
                    s = s[at]
                    if len(at) > k:
                        floor = np.partition(s, len(s) - k)[len(s) - k]
                        over, level = np.flatnonzero(s > floor), np.flatnonzero(s == floor)
                        pick = np.concatenate([over, level[: k - len(over)]])
                    else:
                        pick = np.arange(len(at))
                    out["query_id"].append(np.full(len(pick), qid[i]))
                    out["id"].append(cid[at[pick]])
                    out["score"].append(s[pick])
                merged = {x: np.concatenate(v) for x, v in out.items()}
                merged["part"] = np.full(len(merged["id"]), row["part"], np.int32)
                yield pa.RecordBatch.from_pydict(merged)

    return best


def top_cases(queries: DataFrame, cases: DataFrame, k: int = 10, scale: float = 1024.0, blocks: int = 64) -> DataFrame:
    """The k cases with the largest integer inner product for every query.

    queries, cases: `id` long, `embedding` array of numbers. Returns query_id,
    rank (from 1), id, score (long); ties go to the smaller id. Vectors are
    compared as floor(scale * x). A case with the query's own id is no answer.

    Queries are packed into tiles and cases into shards; every query tile meets
    every shard once, a shard's k best per query leave the task, and lists are
    merged by a tree of MERGE_FAN-way merges. Cases are dealt over `blocks`
    groups, each query tile is repeated once per group: the traffic is
    blocks * queries + cases rows, and no task holds more than two tiles.

    Nulls: rows without an id, without a vector or with a null or non-finite
    component take no part. Vectors of unequal length: the shorter one counts
    as padded with zeros. Repeated ids: each row is a candidate of its own.
    Fewer than k candidates: all of them. No query or no case: no rows.
    """
    q = quantised(usable(queries), scale).mapInArrow(_pack(QUERY_TILE), TILE_SCHEMA)
    c = quantised(usable(cases), scale).repartition(blocks, "id").mapInArrow(_pack(CASE_TILE), TILE_SCHEMA)
    q = q.select(*[F.col(x).alias(f"q_{x}") for x in ("n", "dim", "ids", "parts")])
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    c = c.select(*[F.col(x).alias(f"c_{x}") for x in ("n", "dim", "ids", "parts")])
    c = c.withColumn("part", F.pmod(F.xxhash64("c_ids"), F.lit(blocks)).cast("int"))
    hits = q.join(c, "part").mapInArrow(_select(k), HIT_SCHEMA)

    order = F.struct(F.col("score").alias("s"), F.bitwise_not("id").alias("i"))
    groups = blocks
    while True:
        groups = -(-groups // MERGE_FAN)
        hits = hits.withColumn("part", F.floor(F.col("part") / F.lit(MERGE_FAN)).cast("int"))
        lists = hits.groupBy("query_id", "part").agg(F.collect_list(order).alias("all"))
        best = lists.select("query_id", "part", F.posexplode(F.slice(F.sort_array("all", asc=False), 1, k)).alias("at", "hit"))
        hits = best.select("query_id", "part", "at", F.bitwise_not("hit.i").alias("id"), F.col("hit.s").alias("score"))
        if groups <= 1:
            break
    return hits.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "id", "score")
