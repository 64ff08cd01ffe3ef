"""Exact and near duplicates, provenance clusters and overlap audits.

Exact copies share a signature, so everything runs on distinct signatures and
copies only come back as counts or by one keyed join. Near pairs (Hamming <= t)
must agree on at least one of t + 1 disjoint bands; that makes the banded
equi-join exact. Clusters never enumerate the pairs of a dense bucket: a star
to the bucket's most copied signature joins most of it, and only members still
outside the bucket's main component are compared.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.maths import col
from plumbline.functions.ranking import id_bucket, ranked
from plumbline.functions.skew import skew_attach
from plumbline.session import settle, spread_small

WORDS = ("s0", "s1", "s2", "s3")
THRESHOLD = 6
SHINGLE = 5
_BLANKS = re.compile(rb"[ \t\n\r\f]+")
_BLOCK = 2_048
# Items of either side in a block of pairs that are listed by one task.
PAIR_BLOCK = 256
# Texts handed to a Python worker at a time; a batch by rows alone may hold many long ones.
BATCH_BYTES = 4 << 20
# Hex digit widths of the 7 disjoint bands of a 64-digit signature.
BAND_WIDTHS = (10, 9, 9, 9, 9, 9, 9)


@lru_cache(maxsize=1 << 14)
def _digest(word: bytes) -> bytes:
    return hashlib.sha256(word).digest()


def _bits(digests: list[bytes]) -> np.ndarray:
    """Bits of some digests, a row each."""
    return np.unpackbits(np.frombuffer(b"".join(digests), dtype="uint8")).reshape(-1, 256)


def _votes(bits: np.ndarray) -> np.ndarray:
    """Column sums of 0/1 rows; sums of 128 rows fit a byte, which numpy adds fastest."""
    whole = len(bits) // 128 * 128
    return bits[:whole].reshape(-1, 128, 256).sum(axis=1, dtype="uint8").sum(axis=0, dtype="int64") + bits[whole:].sum(axis=0, dtype="int64")


def _simhash(text: str, size: int = SHINGLE) -> np.ndarray:
    """Majority bits of the SHA-256 of every word run, as four big-endian words."""
    data = (text or "").encode()
    words = data.split() if b"\v" not in data else [w for w in _BLANKS.split(data) if w]
    n = max(len(words) - size + 1, 1)
    votes = np.zeros(256)
    if size == 1 and words:
        counts = Counter(words)  # single words repeat, longer runs hardly do
        words, times = list(counts), np.fromiter(counts.values(), "float64", len(counts))
        for at in range(0, len(words), _BLOCK):
            votes += times[at : at + _BLOCK] @ _bits([_digest(w) for w in words[at : at + _BLOCK]]).astype("float64")
    else:
        line = b" ".join(words)
        gaps = np.flatnonzero(np.frombuffer(line, dtype="uint8") == 32)
        starts, ends = np.append(0, gaps + 1), np.append(gaps, len(line))[min(size, len(gaps) + 1) - 1 :]
        sha = hashlib.sha256
        for at in range(0, n, _BLOCK):
            cuts = zip(starts[at : min(at + _BLOCK, n)].tolist(), ends[at : at + _BLOCK].tolist())
            votes += _votes(_bits([sha(line[i:j]).digest() for i, j in cuts]))
    return np.packbits(votes * 2 > n).view(">i8").astype("int64")


def _simhash_batch(size: int):
    def run(texts: pd.Series) -> pd.DataFrame:
        if not len(texts):
            return pd.DataFrame({w: pd.Series(dtype="int64") for w in WORDS})
        return pd.DataFrame(np.stack([_simhash(t, size) for t in texts]), columns=list(WORDS))

    return run


def text_signatures(df: DataFrame, ident: str = "id", text: str = "text", size: int = SHINGLE, digest: str | None = None) -> DataFrame:
    """256-bit SimHash per item as four BIGINT words (ident, s0..s3).

    Every run of `size` consecutive words of the whole text votes with its SHA-256
    bits; a shorter text is one run. Runs of one word tell nothing of their order. Map-only for any input whose splits share its
    rows out evenly: the text does not cross a shuffle, one narrow row per item leaves the task. A long text is voted in blocks, so
    memory does not grow with it. `digest` names a further column for the md5 of the text, for callers that also
    compare texts and would have to read them again.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    df = spread_small(df.select(ident, text))
    hashed = F.pandas_udf(_simhash_batch(size), ", ".join(f"{w} bigint" for w in WORDS))
    more = [] if digest is None else [F.md5(text).alias(digest)]
    return df.select(ident, *more, hashed(F.col(text)).alias("__s")).select(ident, *([] if digest is None else [digest]), "__s.*")


def sign_signatures(df: DataFrame, ident: str = "id", vector: str = "v") -> DataFrame:
    """Sign bits of a 64-wide vector as one BIGINT; the other words are 0."""
    word = F.aggregate(
        F.transform(col(vector), lambda x, i: F.call_function("shiftleft", (x > 0).cast("bigint"), i)),
        F.lit(0).cast("bigint"),
        lambda a, b: a.bitwiseOR(b),
    )
    zero = F.lit(0).cast("bigint")
    return df.select(ident, word.alias("s0"), zero.alias("s1"), zero.alias("s2"), zero.alias("s3"))


def signature_hex() -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(w), 16, "0") for w in WORDS]))


def hamming(a: str = "a_", b: str = "b_") -> Column:
    out = F.lit(0)
    for w in WORDS:
        out = out + F.bit_count(F.col(a + w).bitwiseXOR(F.col(b + w)))
    return out


def distinct_signatures(sigs: DataFrame, ident: str = "id") -> DataFrame:
    """One row per signature: rep = smallest member, copies = members."""
    return sigs.groupBy(*WORDS).agg(F.min(ident).alias("rep"), F.count(F.lit(1)).alias("copies"))


def bands(reps: DataFrame) -> DataFrame:
    """Each signature once per band: band number and its digits."""
    hexed, parts, at = signature_hex(), [], 1
    for i, width in enumerate(BAND_WIDTHS):
        parts.append(F.struct(F.lit(i).alias("band"), F.substring(hexed, at, width).alias("digits")))
        at += width
    return reps.select("*", F.explode(F.array(*parts)).alias("__b")).select(
        "*", F.concat_ws(":", "__b.band", "__b.digits").alias("bucket"), F.col("__b.band").alias("band")
    ).drop("__b")


def _side(df: DataFrame, prefix: str) -> DataFrame:
    return df.select("bucket", "band", *[F.col(c).alias(prefix + c) for c in df.columns if c not in ("bucket", "band")])


def _first_shared_band(band: str) -> Column:
    """True in exactly one shared band of a pair, so no distinct is needed after the join."""
    at, earlier = 1, F.lit(False)

    def digits(prefix: str, start: int, width: int) -> Column:
        h = F.lower(F.concat(*[F.lpad(F.hex(prefix + w), 16, "0") for w in WORDS]))
        return F.substring(h, start, width)

    for i, width in enumerate(BAND_WIDTHS):
        same = digits("a_", at, width) == digits("b_", at, width)
        earlier = earlier | (same & (F.lit(i) < F.col(band)))
        at += width
    return ~earlier


def _near_signatures(left: DataFrame, right: DataFrame | None, threshold: int) -> DataFrame:
    """All pairs of distinct signatures with Hamming <= threshold, with the columns of both sides as a_ and b_."""
    if threshold >= len(BAND_WIDTHS):
        raise ValueError(f"bands are exact up to a distance of {len(BAND_WIDTHS) - 1}")
    left = settle(left) if right is None else left  # both sides read it
    a = _side(bands(left), "a_")
    b = _side(bands(left if right is None else right), "b_").drop("band")
    near = (hamming() <= threshold) & _first_shared_band("band")
    if right is None:
        near = near & (F.col("a_rep") < F.col("b_rep"))
    return a.join(b, (a["bucket"] == b["bucket"]) & near)


def near_dup_join(left: DataFrame, right: DataFrame | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """All pairs of distinct signatures with Hamming <= threshold (a_rep, b_rep, hamming, copies).

    Without `right` it is a self-join with a_rep < b_rep. Candidates are verified
    inside the join condition, so only true pairs leave the join; oversized
    buckets are split by the runtime skew join, which an inner join allows on
    both sides.
    """
    out = _near_signatures(left, right, threshold)
    return out.select("a_rep", "b_rep", hamming().alias("hamming"), "a_copies", "b_copies")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) with root = smallest node of the component, for nodes that have an edge.

    Alternating large-star / small-star contraction. Minimum neighbours are a
    combined aggregate; the join back is split at hub nodes by the runtime skew
    join. A round is one checkpointed table and one row that tells whether it
    moved: count and digest of the edges.
    """
    e = settle(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u")
        e1 = large.select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        # Small star: hang every node and its smaller neighbours below the smallest of them.
        least = e1.groupBy("v").agg(F.min("u").alias("m"))
        below = e1.join(least, "v").select(F.col("m").alias("u"), F.col("u").alias("v"))
        e = settle(below.unionByName(least.select(F.col("m").alias("u"), "v")).filter("u <> v").distinct())
        state = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
    roots = e.select(F.col("u").alias("node")).distinct()
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )


def _star_edges(banded: DataFrame, threshold: int, rows_per_task: int) -> DataFrame:
    """Edges from each bucket member to the bucket's most copied signature, where within reach."""
    pivot = F.max_by(F.struct("rep", *WORDS), F.struct(F.col("copies"), -F.col("rep")))
    heads = banded.groupBy("bucket").agg(pivot.alias("c"), F.count(F.lit(1)).alias("size"))
    heads = heads.filter("size > 1").select("bucket", F.col("c.rep").alias("b_rep"), *[F.col(f"c.{w}").alias(f"b_{w}") for w in WORDS], "size")
    members = banded.select("bucket", F.col("rep").alias("a_rep"), *[F.col(w).alias(f"a_{w}") for w in WORDS])
    joined = skew_attach(members, settle(heads), "bucket", ["a_rep"], "size", rows_per_task=rows_per_task, nulls=False)
    return joined.filter((F.col("a_rep") != F.col("b_rep")) & (hamming() <= threshold)).select(
        F.col("a_rep").alias("a"), F.col("b_rep").alias("b")
    )


def _cross_edges(banded: DataFrame, comps: DataFrame, threshold: int, rows_per_task: int) -> DataFrame:
    """Edges between components that share a bucket.

    Only buckets holding several components are opened. In those, members outside
    the bucket's largest component meet the members of other components. Both
    sides are dealt over salts sized from the bucket, a pair of salts to a group.
    The opened members are written once; both sides read that table.
    """
    roots = comps.select(F.col("node").alias("rep"), "root")
    tagged = banded.select("bucket", "rep", *WORDS).join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    tagged = settle(tagged)
    sizes = tagged.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("k"))
    mixed = sizes.groupBy("bucket").agg(
        F.max_by("root", F.struct(F.col("k"), F.col("root"))).alias("major"),
        F.count(F.lit(1)).alias("n_roots"),
        F.sum("k").alias("size"),
    ).filter("n_roots > 1")
    salts = (F.floor(F.col("size") / F.lit(rows_per_task)) + 1).cast("int")
    mixed = mixed.select("bucket", "major", salts.alias("n_salts"))
    opened = settle(tagged.join(mixed, "bucket"))
    own, every = F.pmod(F.xxhash64("rep"), F.col("n_salts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1))
    keep = ["bucket", "left_salt", "right_salt", "rep", "root", *WORDS]
    minor = opened.filter(F.col("root") != F.col("major")).withColumn("left_salt", own).withColumn("right_salt", every)
    everyone = opened.withColumn("right_salt", own).withColumn("left_salt", every)
    a = minor.select(*[F.col(c).alias("a_" + c) for c in keep])
    b = everyone.select(*[F.col(c).alias("b_" + c) for c in keep])
    hit = F.lit(True)
    for c in keep[:3]:
        hit = hit & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    hit = hit & (F.col("a_root") != F.col("b_root")) & (hamming() <= threshold)
    return a.join(b, hit).select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct()


def signature_components(reps: DataFrame, threshold: int = THRESHOLD, rows_per_task: int = 1_000_000) -> DataFrame:
    """(rep, root) over distinct signatures joined by Hamming <= threshold, exact.

    Any pair within reach shares a bucket. After the stars it is either in one
    component already, or at least one end lies outside that bucket's main
    component and the pair is compared.
    """
    if threshold >= len(BAND_WIDTHS):
        raise ValueError(f"bands are exact up to a distance of {len(BAND_WIDTHS) - 1}")
    banded = settle(bands(reps))
    comps = settle(connected_components(_star_edges(banded, threshold, rows_per_task)))
    bridges = _cross_edges(banded, comps, threshold, rows_per_task)
    upper = connected_components(bridges).select(
        F.col("node").alias("root"), F.col("root").alias("top")
    )
    base = reps.select("rep").join(comps, reps["rep"] == comps["node"], "left").select(
        "rep", F.coalesce("root", "rep").alias("root")
    )
    return base.join(upper, "root", "left").select("rep", F.coalesce("top", "root").alias("root"))


def provenance_clusters(sigs: DataFrame, ident: str = "id", threshold: int = THRESHOLD) -> DataFrame:
    """(ident, cluster): dense ids 0..G-1 in order of each component's smallest member."""
    settled = settle(sigs.select(ident, *WORDS))
    reps = settle(distinct_signatures(settled, ident))
    comps = settle(signature_components(reps, threshold))
    named = reps.join(comps, "rep")
    first = named.groupBy("root").agg(F.min("rep").alias("first"))
    numbered = ranked(first, [], ["first"], id_bucket("first"), "__rn").select(
        "root", (F.col("__rn") - 1).alias("cluster")
    )
    table = named.join(numbered, "root").select(
        F.sha2(signature_hex(), 256).alias("__sig"), "cluster", "copies"
    )
    keyed = settled.select(ident, F.sha2(signature_hex(), 256).alias("__sig"))
    return skew_attach(keyed, settle(table), "__sig", [ident], "copies", nulls=False).select(ident, "cluster")


def dedup_representatives(items: DataFrame, keys: Sequence[str] = ("cluster", "label"), ident: str = "id") -> DataFrame:
    """First item per (cluster, label), combined map-side."""
    others = [c for c in items.columns if c not in keys]
    return items.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col(ident)).alias("__r")).select(*keys, "__r.*")


def label_conflict_clusters(items: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """Clusters that hold more than one label."""
    per = items.groupBy(cluster).agg(
        F.min(label).alias("lo"), F.max(label).alias("hi"), F.count(F.lit(1)).alias("n_items")
    )
    return per.filter(F.col("lo") != F.col("hi")).select(cluster, "n_items")


def dedup_summary(items: DataFrame) -> DataFrame:
    """Readable, kept, collapsed, clusters and conflict clusters in one row.

    Reads (cluster, label). Counts are taken over the per-cluster aggregate.
    """
    per = items.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("k")
    )
    return per.agg(
        F.sum("n").alias("readable"),
        F.sum("k").alias("kept"),
        (F.sum("n") - F.sum("k")).alias("collapsed"),
        F.count(F.lit(1)).alias("clusters"),
        F.count_if(F.col("k") > 1).alias("conflicts"),
    )


def exact_dup_groups(items: DataFrame, text: str = "text", ident: str = "id") -> DataFrame:
    """Each item's first exact copy within the set (NULL when it is the first).

    The text is reduced to its md5 before anything is exchanged.
    """
    keyed = items.select(ident, F.md5(text).alias("md5"))
    firsts = keyed.groupBy("md5").agg(F.min(ident).alias("first"), F.count(F.lit(1)).alias("n"))
    out = skew_attach(keyed, firsts, "md5", [ident], "n")
    return out.select(ident, F.when(F.col("first") != F.col(ident), F.col("first")).alias("copy_of"))


def exact_overlap(holdout: DataFrame, train: DataFrame, text: str = "text", ident: str = "id") -> DataFrame:
    """Holdout rows whose content equals a train row; first train occurrence only."""
    first = train.groupBy(F.md5(text).alias("md5")).agg(
        F.min(ident).alias("train_id"), F.min_by("label", ident).alias("train_label")
    )
    held = holdout.select(F.md5(text).alias("md5"), F.col(ident).alias("holdout_id"), F.col("label").alias("holdout_label"))
    # one train row per text: a text copied many times in the holdout is split by the runtime skew join
    return held.join(first, "md5").drop("md5")


def _near_groups(holdout: DataFrame, train: DataFrame, threshold: int) -> DataFrame:
    """a, b: signatures of the holdout and of train within reach; how many items have each."""
    h, t = (items.groupBy(*WORDS).agg(F.count(F.lit(1)).alias("copies")) for items in (holdout, train))
    a, b = (F.struct(*[F.col(side + w).alias(w) for w in WORDS]).alias(side[0]) for side in ("a_", "b_"))
    return _near_signatures(h, t, threshold).select(
        a, b, hamming().cast("int").alias("hamming"), F.col("a_copies").alias("n_holdout"), F.col("b_copies").alias("n_train")
    )


def _exact_groups(holdout: DataFrame, train: DataFrame) -> DataFrame:
    """a, b: the md5 of a text that both sides have; how many items of each have it."""
    h = holdout.groupBy("md5").agg(F.count(F.lit(1)).alias("n_holdout"))
    t = train.groupBy("md5").agg(F.count(F.lit(1)).alias("n_train"))
    return h.join(t, "md5").select(F.col("md5").alias("a"), F.col("md5").alias("b"), F.lit(0).alias("hamming"), "n_holdout", "n_train")


def _item_pairs(groups: DataFrame, holdout: DataFrame, train: DataFrame, key: Column, ident: str, rows_per_block: int) -> DataFrame:
    """Every pair of a holdout and a train item whose keys are a and b of one of the groups.

    The items of a group are dealt over blocks on either side, and each pair of blocks is joined for itself, so a text
    with many copies on both sides is spread over the cluster: a block makes about rows_per_block squared pairs.
    """

    def blocks(n: str) -> Column:
        return F.ceil(F.col(n) / F.lit(rows_per_block)).cast("int")

    # the numbers of groups and items are drawn once: both sides read the same ones, also after a task is run again
    groups = groups.withColumns({"pair": F.monotonically_increasing_id(), "of_holdout": blocks("n_holdout"), "of_train": blocks("n_train")})
    groups = settle(groups)

    def dealt(items: DataFrame, side: str, own: str, other: str, more: Sequence[str], name: str) -> DataFrame:
        known = groups.select(F.col(side).alias("__key"), "pair", f"of_{own}", f"of_{other}", *more)
        met = items.select(key.alias("__key"), F.col(ident).alias(f"{name}_id"), F.col("label").alias(f"{name}_label")).join(known, "__key")
        met = settle(met.withColumn("__row", F.monotonically_increasing_id()))
        mine = F.pmod(F.xxhash64("__row"), F.col(f"of_{own}")).cast("int").alias(f"at_{own}")
        every = F.explode(F.sequence(F.lit(0), F.col(f"of_{other}") - 1)).alias(f"at_{other}")
        return met.select("pair", mine, every, f"{name}_id", f"{name}_label", *more)

    h = dealt(holdout, "a", "holdout", "train", ["hamming", "n_holdout", "n_train"], "holdout")
    t = dealt(train, "b", "train", "holdout", [], "train")
    return h.join(t, ["pair", "at_holdout", "at_train"])


def holdout_overlap_audit(
    holdout: DataFrame, train: DataFrame, ident: str = "id", threshold: int = THRESHOLD, rows_per_block: int = PAIR_BLOCK
) -> DataFrame:
    """Exact and near matches across sets of (ident, label, md5, s0..s3), as `text_signatures` with a digest gives them.

    A row for every pair of a holdout and a train item with equal texts (md5-exact) or signatures within the threshold (near), with the
    labels of both. An exact pair is reported by both passes, as md5-exact and as near with hamming 0. n_holdout and n_train
    say how many items of each set have the text or the signature of the row. Copies are matched once and then listed pair by pair, so a
    text copied often on both sides makes as many rows as it has pairs; `overlap_counts` has one. Items
    without an id are listed with a null one; an id that occurs in several rows is an item in each. No text is read or exchanged here. The sets are
    read several times, so a caller settles them.
    """

    def listed(kind: str, groups: DataFrame, key: Column) -> DataFrame:
        return _item_pairs(groups, holdout, train, key, ident, rows_per_block).select(
            F.lit(kind).alias("kind"), "hamming", "holdout_id", "train_id", "n_holdout", "n_train", "holdout_label", "train_label"
        )

    exact = listed("md5-exact", _exact_groups(holdout, train), F.col("md5"))
    return exact.unionByName(listed("near", _near_groups(holdout, train, threshold), F.struct(*WORDS)))


def overlap_counts(holdout: DataFrame, train: DataFrame, ident: str = "id", threshold: int = THRESHOLD) -> DataFrame:
    """kind, n_holdout, n_train: how many matches there are, without listing them; a text copied a billion times adds one row.

    A holdout item counts once for an equal train text, whatever copies that has, and once for every near train item. Items without
    an id have no near matches here.
    """
    exact = _exact_groups(holdout, train).select(F.lit("md5-exact").alias("kind"), "n_holdout", F.lit(1).cast("bigint").alias("n_train"))
    known = (items.filter(F.col(ident).isNotNull()) for items in (holdout, train))
    return exact.unionByName(_near_groups(*known, threshold).select(F.lit("near").alias("kind"), "n_holdout", "n_train"))


def overlap_verdict(matches: DataFrame) -> DataFrame:
    """Number of matches and verdict of the counts (n_holdout, n_train) of `overlap_counts`."""
    n = F.coalesce(F.sum(F.col("n_holdout") * F.col("n_train")), F.lit(0))
    return matches.agg(n.alias("n_matches"), F.when(n > 0, "ALARM").otherwise("CLEAN").alias("verdict"))
