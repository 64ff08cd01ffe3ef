"""Resharding of case files by minimum-cost flow."""

from __future__ import annotations

import heapq
import json
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from plumbline.llm.common import gapless_rank, settle, spread_count

ROWS_PER_BLOCK = 256
#: Blocks of all old shards together: what the driver gets to plan with.
MAX_BLOCKS = 65_536
MAX_SHARDS = 4_096


def transfer_plan(old: Sequence[int], capacities: Sequence[int], cost=None) -> list[list[int]]:
    """Bytes to send from every old to every new shard: a minimum-cost flow by successive shortest paths.

    old: bytes of the old shards; capacities: bytes of the new ones, at least as much in total.
    cost(i, j) of a byte is 0 where it stays (i == j) and 1 elsewhere, unless given.
    """
    cost = cost or (lambda i, j: int(i != j))
    m, n = len(old), len(capacities)
    if sum(old) > sum(capacities):
        raise ValueError("the new shards cannot hold the old ones")
    source, sink = m + n, m + n + 1
    graph: list[list[int]] = [[] for _ in range(m + n + 2)]  # edge numbers; edge e ^ 1 is its reverse
    to, room, price = [], [], []

    def edge(a: int, b: int, most: int, each: float) -> None:
        for x, y, r, c in ((a, b, most, each), (b, a, 0, -each)):
            graph[x].append(len(to))
            to.append(y), room.append(r), price.append(c)

    for i, size in enumerate(old):
        edge(source, i, size, 0)
        for j in range(n):
            edge(i, m + j, size, cost(i, j))
    for j, size in enumerate(capacities):
        edge(m + j, sink, size, 0)
    potential = [0.0] * len(graph)
    while True:
        far, came = [float("inf")] * len(graph), [-1] * len(graph)
        far[source] = 0.0
        heap = [(0.0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in graph[a]:
                step = d + price[e] + potential[a] - potential[to[e]]
                if room[e] > 0 and step < far[to[e]] - 1e-12:
                    far[to[e]], came[to[e]] = step, e
                    heapq.heappush(heap, (step, to[e]))
        if far[sink] == float("inf"):
            break
        potential = [p + min(f, far[sink]) for p, f in zip(potential, far, strict=True)]
        path, at = [], sink
        while at != source:
            path.append(came[at])
            at = to[came[at] ^ 1]
        most = min(room[e] for e in path)
        for e in path:
            room[e] -= most
            room[e ^ 1] += most
    flow = [[0] * n for _ in range(m)]
    for i in range(m):
        for e in graph[i]:
            if e % 2 == 0 and m <= to[e] < m + n:
                flow[i][to[e] - m] = room[e ^ 1]
    return flow


def place_blocks(blocks: Sequence[tuple[int, int]], quotas: dict[int, int]) -> dict[int, dict[int, int]]:
    """Per block of one old shard where its bytes go: {block: {new shard: bytes}}.

    blocks: (block, bytes), largest first to the new shard with the most room if it
    fits whole; the few that do not are cut over the room that is left.
    """
    room, out, rest = dict(quotas), {}, []
    for block, size in sorted(blocks, key=lambda b: (-b[1], b[0])):
        best = max(room, key=lambda j: (room[j], -j))
        if room[best] >= size:
            room[best] -= size
            out[block] = {best: size}
        else:
            rest.append((block, size))
    for block, size in rest:
        parts = {}
        for j in sorted(room, key=lambda j: (-room[j], j)):
            take = min(size, room[j])
            if take > 0:
                parts[j] = take
                room[j] -= take
                size -= take
        if size:  # only where rounding left no room: keep it with the largest part
            best = max(parts, key=parts.get) if parts else max(room, key=lambda j: (room[j], -j))
            parts[best] = parts.get(best, 0) + size
        out[block] = parts
    return out


def _deal_block(rows: pa.Table) -> pa.Table:
    """Rows of one cut block, largest first, each to the new shard that is furthest from its bytes."""
    rows = rows.sort_by([("size", "descending"), ("id", "ascending")])
    room = [(-most, int(j)) for j, most in json.loads(rows.column("parts")[0].as_py()).items()]
    heapq.heapify(room)
    shards = []
    for size in rows.column("size").to_pylist():
        most, j = room[0]
        heapq.heapreplace(room, (most + size, j))
        shards.append(j)
    return rows.drop_columns("parts").append_column("new_shard", pa.array(shards, pa.int32()))


def _planned(base: DataFrame, n_shards: int, capacities: Sequence[int] | None) -> tuple[Column, DataFrame, int]:
    """The block of a row (id, old_shard, size); a row per block with its new shard or, where it is cut, the parts; the number of rows."""
    spark = base.sparkSession
    totals = {r["old_shard"]: r for r in base.groupBy("old_shard").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).limit(MAX_SHARDS + 1).collect()}
    if len(totals) > MAX_SHARDS:
        raise ValueError(f"more than {MAX_SHARDS} old shards")
    rows, n_old = sum(r["n"] for r in totals.values()), max([*totals, n_shards - 1]) + 1
    old = [totals[i]["b"] if i in totals else 0 for i in range(n_old)]
    whole = sum(old)
    if capacities is None:
        capacities = [whole // n_shards + (j < whole % n_shards) for j in range(n_shards)]
    flow = transfer_plan(old, capacities)
    most = max([r["n"] for r in totals.values()], default=0)
    n_blocks = max(1, min(MAX_BLOCKS // max(1, len(totals)), most // ROWS_PER_BLOCK))
    of_row = F.pmod(F.xxhash64("id", "size"), F.lit(n_blocks)).cast("int")
    sizes: dict[int, list[tuple[int, int]]] = {}
    for r in base.groupBy("old_shard", of_row.alias("block")).agg(F.sum("size").alias("b")).collect():
        sizes.setdefault(r["old_shard"], []).append((r["block"], r["b"]))
    plan = []
    for i, blocks in sizes.items():
        quotas = {j: b for j, b in enumerate(flow[i]) if b > 0} or {min(i, n_shards - 1): 0}
        for block, parts in place_blocks(blocks, quotas).items():
            single = next(iter(parts)) if len(parts) == 1 else None
            plan.append((i, block, single, None if single is not None else json.dumps(parts)))
    return of_row, spark.createDataFrame(plan, "old_shard int, block int, new_shard int, parts string"), rows


def _dealt(cut: DataFrame) -> DataFrame:
    """Rows of the cut blocks (old_shard, block, parts, ...), each with its new shard in place of the parts."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name != "parts")
    return cut.groupBy("old_shard", "block").applyInArrow(_deal_block, f"{kinds}, new_shard int")


def reshard_cases(cases: DataFrame, n_shards: int, capacities: Sequence[int] | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Give every case a new shard so that the fewest bytes move and every shard gets its capacity.

    cases: id, shard (old number, int), size (bytes, long). capacities: bytes of the
    n_shards new shards; equal parts of the total by default. carry: further columns to keep. A new shard takes over the
    files of the old shard of its number; rows that stay there are not moved.

    Sizes are added up per block (old shard and hash of id), the flow is solved over
    shards, whole blocks are given out along it, and only blocks at a cut are dealt
    row by row, so shards meet their capacities to within a few small rows. Returns id,
    size, old_shard, shard (int), slot (long, gapless from 0 in its shard), moved.

    The driver sees at most MAX_BLOCKS block sizes. Nulls: a null shard counts as 0, a null size as 0 bytes, a null id is
    an id of its own. Repeated rows are placed one by one. Columns other than those of `carry` are not
    kept. No cases: no rows. More than MAX_SHARDS old shards are refused.
    """
    base = cases.select(
        "id", F.coalesce(F.col("shard").cast("int"), F.lit(0)).alias("old_shard"), F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"), *carry
    )
    block, planned, rows = _planned(base, n_shards, capacities)
    base = base.withColumn("block", block)
    placed = base.join(F.broadcast(planned), ["old_shard", "block"])  # at most MAX_BLOCKS rows
    dealt = _dealt(placed.filter(F.col("parts").isNotNull()).select(*base.columns, "parts"))
    straight = placed.filter(F.col("parts").isNull())
    names = ("id", "size", "old_shard", *carry, F.col("new_shard").alias("shard"))
    done = settle(straight.select(*names).unionByName(dealt.select(*names)))
    ranked = gapless_rank(done, ["shard"], ["id", "size", "old_shard"], "slot", spread_count(rows // n_shards + 1))
    return ranked.select("id", "size", "old_shard", *carry, "shard", "slot", (F.col("shard") != F.col("old_shard")).alias("moved"))


def rewrite_shards(spark: SparkSession, root: str, target: str, n_shards: int, schema: StructType | None = None, id_col: str = "id", size_col: str = "size") -> list[int]:
    """Reshard a table stored as root/shard=0, shard=1, ... and write the files that change to `target`.

    Only shards that lose or gain a row are written; the numbers returned are those that were kept, whose files under `root` stay
    valid as they are. A rerun writes the same rows. A block that goes to one shard is written straight from the scan; only rows of cut
    blocks are dealt, known by their file and place in it, and joined back. So most texts are never shuffled.

    schema: of the stored table, needed where it may hold no row. Nulls, repeated rows and rows without an id as in `reshard_cases`: they move one
    by one. Very long texts are copied whole. All columns are kept, whatever their names, but for a struct `_metadata`. No rows: `target` is
    an empty table and all shards were kept.
    """
    stored = (spark.read if schema is None else spark.read.schema(schema)).parquet(root)
    # the stored columns travel as one struct, so that none of their names can clash
    row = {"file": F.col("_metadata.file_path"), "row": F.col("_metadata.row_index")}
    shard, size = F.coalesce(F.col("shard").cast("int"), F.lit(0)).alias("old_shard"), F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("size")
    known = stored.select(F.col(id_col).alias("id"), shard, size, *(c.alias(name) for name, c in row.items()), F.struct(*stored.columns).alias("stored"))
    block, planned, rows = _planned(known.drop("stored"), n_shards, None)
    known = known.withColumn("block", block)
    narrow = known.drop("stored")
    if not rows:
        stored.write.mode("overwrite").parquet(target)
        return [*range(n_shards)]
    planned = settle(planned)
    cut = narrow.join(F.broadcast(planned.filter("parts IS NOT NULL")), ["old_shard", "block"])  # at most MAX_BLOCKS rows
    dealt = settle(_dealt(cut.select(*narrow.columns, "parts")).select("file", "row", "old_shard", "new_shard"))
    moves = planned.filter("parts IS NULL").select("old_shard", "new_shard").unionByName(dealt.select("old_shard", "new_shard")).filter("old_shard <> new_shard")
    changed = sorted(r["s"] for r in moves.select(F.explode(F.array("old_shard", "new_shard")).alias("s")).distinct().collect())  # at most as many as shards
    placed = known.filter(F.col("old_shard").isin(changed)).join(F.broadcast(planned), ["old_shard", "block"])
    straight = placed.filter("parts IS NULL").select("stored", "new_shard")
    joined = placed.filter("parts IS NOT NULL").select("stored", "file", "row").join(dealt.select("file", "row", "new_shard"), ["file", "row"]).select("stored", "new_shard")
    others = [F.col(f"stored.`{c}`") for c in stored.columns if c != "shard"]
    straight.unionByName(joined).select(*others, F.col("new_shard").alias("shard")).write.mode("overwrite").partitionBy("shard").parquet(target)
    return [s for s in range(n_shards) if s not in changed]
