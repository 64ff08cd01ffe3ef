"""URL verdicts: longest-prefix rules, and a Bloom filter cascade for listed keys."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import settle

HASHES = 4
BITS_PER_KEY = 8
MAX_LEVELS = 64
#: Largest filter, all levels together, that is sent to every executor. Larger ones are cut by key into shards.
BROADCAST_BYTES = 32 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path (up to ? or #); both empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def match_rules(urls: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Add `rule` (host + path of the longest fitting rule) and `rule_verdict`.

    rules: (verdict, host, path); a rule fits its host and all subdomains of it
    where the path starts with the rule's. Rules are a short list of the caller.
    Length is host and path together; equal lengths go to the first rule listed.
    """
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, host, path in reversed(ordered):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return urls.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def _places(key: str, level: int, bits: int) -> Column:
    """HASHES bit positions of a key at a level, by double hashing."""
    h = F.xxhash64(F.lit(level), F.col(key))
    a, b = h.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(h, 33).bitwiseOR(F.lit(1))
    return F.array(*[F.pmod(a + F.lit(i) * b, F.lit(bits)) for i in range(HASHES)])


def _level(keys: DataFrame, n: int, level: int) -> np.ndarray:
    """Bits of one Bloom filter over n keys. Executors OR the 64-bit words of a key range before anything moves."""
    bits = max(64, n * BITS_PER_KEY)
    at = keys.select(F.explode(_places("key", level, bits)).alias("p"))
    word = F.floor(F.col("p") / F.lit(64)).cast("long")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))
    words = at.groupBy(word.alias("w")).agg(F.bit_or(one).alias("b")).collect()  # at most bits / 64 rows, of one shard
    out = np.zeros(-(-bits // 64), np.uint64)
    for w, b in words:
        out[w] = np.uint64(b & 0xFFFFFFFFFFFFFFFF)
    return out


def _holds(level: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((level[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)).astype(bool).all(axis=1)


def _tester(levels: list[np.ndarray], bits: list[int], sizes: int):
    """Whether keys (their hash per level) are listed: the first level that misses a key tells by its number."""
    m = [max(64, b) for b in bits]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("hashes").flatten().to_numpy().reshape(batch.num_rows, sizes)
            inside = np.full(batch.num_rows, len(levels) % 2 == 1)
            open_ = np.ones(batch.num_rows, bool)
            for i, level in enumerate(levels):
                rows = np.flatnonzero(open_)
                if not len(rows):
                    break
                h = hashes[rows, i].astype(np.uint64)
                a, b = (h & np.uint64(0x7FFFFFFF)).astype(np.int64), (h >> np.uint64(33)).astype(np.int64) | 1
                places = np.stack([(a + j * b) % m[i] for j in range(HASHES)], axis=1)
                missed = rows[~_holds(level, places)]
                inside[missed] = i % 2 == 1
                open_[missed] = False
            yield batch.drop_columns(["hashes"]).append_column("listed", pa.array(inside))

    return listed


class Cascade:
    """Alternating Bloom filters: level 0 holds the listed keys, level 1 the unlisted keys of the
    universe that level 0 lets through, level 2 the listed keys that level 1 lets through, and so on
    until a level lets nothing through. For every key of the universe the answer is exact.
    """

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []
        self.bits: list[int] = []

    @property
    def bytes(self) -> int:
        return sum(x.nbytes for x in self.levels)

    def test(self, rows: DataFrame, key: str = "key", upto: int | None = None) -> DataFrame:
        """rows with `listed`; NULL keys are never listed."""
        n = len(self.levels) if upto is None else upto
        if n == 0:
            return rows.withColumn("listed", F.lit(False))
        hashed = rows.withColumn("hashes", F.array(*[F.xxhash64(F.lit(i), F.col(key)) for i in range(n)]))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", listed boolean"
        out = hashed.mapInArrow(_tester(self.levels[:n], self.bits[:n], n), schema)
        return out.withColumn("listed", F.col("listed") & F.col(key).isNotNull())


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """Cascade of `listed.key` over all keys of `universe.key` (which may repeat, and may miss listed ones).

    Each level costs one pass over what the level before let through. A level
    is at most n * BITS_PER_KEY bits, so what reaches the driver is bounded by the list;
    `listed_keys` cuts lists above BROADCAST_BYTES into shards before this is called.
    """
    ins = listed.select("key").filter(F.col("key").isNotNull()).distinct()
    outs = universe.select("key").filter(F.col("key").isNotNull()).distinct().join(ins, "key", "left_anti")
    ins, outs = settle(ins), settle(outs)
    out, now, other = Cascade(), ins, outs
    for level in range(MAX_LEVELS):
        n = now.count()
        if n == 0:
            break
        out.levels.append(_level(now, n, level))
        out.bits.append(n * BITS_PER_KEY)
        # of the other side, what this level lets through: the answer says "on this level's side"
        through = _through(out, level, other)
        now, other = settle(through), now
    else:
        raise ValueError("a cascade level lets all keys through: hashes of distinct keys are equal")
    return out


def _through(cascade: Cascade, level: int, keys: DataFrame) -> DataFrame:
    only = Cascade()
    only.levels, only.bits = [cascade.levels[level]], [cascade.bits[level]]
    hashed = keys.withColumn("hashes", F.array(F.xxhash64(F.lit(level), F.col("key"))))
    tested = hashed.mapInArrow(_tester(only.levels, only.bits, 1), "key string, listed boolean")
    return tested.filter("listed").select("key")


def listed_keys(rows: DataFrame, listed: DataFrame, shards: int | None = None) -> DataFrame:
    """rows (with `key`) plus `listed`: whether the key is on the list, exactly, without a join.

    The universe is every key of `rows`. A list whose filters would pass BROADCAST_BYTES is cut by
    key hash into shards, one cascade each; a pass over the rows tests one
    shard's keys, so a task holds one shard's filters at a time.
    """
    if shards is None:
        n = listed.count()  # upper bound of distinct keys
        shards = max(1, -(-n * BITS_PER_KEY // 8 * 3 // BROADCAST_BYTES))
    if shards == 1:
        return build_cascade(listed, rows).test(rows)
    out = rows.withColumn("__on", F.lit(False))
    at = F.pmod(F.xxhash64(F.lit("shard"), F.col("key")), F.lit(shards))
    for s in range(shards):
        part = build_cascade(listed.filter(at == s), rows.filter(at == s))
        tested = part.test(out)
        out = tested.withColumn("__on", F.col("__on") | (F.coalesce(at == s, F.lit(False)) & F.col("listed"))).drop("listed")
    return out.withColumnRenamed("__on", "listed")


def judge_urls(urls: DataFrame, rules: Sequence[tuple[str, str, str]], blocked: DataFrame) -> DataFrame:
    """Verdict of every url: the longest fitting rule's, else `block` where its host is on the list.

    urls: `id`, `url`. blocked: `key` (hosts). Returns id, host, path, rule,
    verdict (`allow` or `block`). The reference project keeps no table of web addresses, so this
    operator is general: any table of urls with an id.

    Nulls: a null url, or one without ://, has empty host and path and no rule; an empty host is never listed. Null
    ids, repeated rows and equal urls stay as they are, one row each. Empty tables give empty results.
    Very long urls are read whole. Other columns of the inputs are not carried.
    """
    host, path = host_and_path(F.col("url"))
    parts = match_rules(urls.select("id", host.alias("host"), path.alias("path")), rules)
    keyed = parts.withColumn("key", F.when(F.col("host") != "", F.col("host")))
    tested = listed_keys(keyed, blocked.filter(F.col("key") != ""))
    by_list = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return tested.select("id", "host", "path", "rule", F.coalesce("rule_verdict", by_list).alias("verdict"))
