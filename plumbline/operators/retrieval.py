"""Exact cosine retrieval."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.maths import col

BLOCK_ROWS = 20_000
# Queries at a time, columns of a maximum, pairs ranked at a time.
CHUNK, GROUP, PAIRS = 256, 64, 50_000
KNN_K = 5


def cosine_similarity(a, b) -> Column:
    """Cosine over the first min(len) dimensions; 0 when either norm is 0."""
    a, b = col(a), col(b)
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)

    def dot(u: Column, w: Column) -> Column:
        prods = F.zip_with(u, w, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(prods, F.lit(0.0), lambda s, p: s + p)

    na, nb = dot(x, x), dot(y, y)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(x, y) / (F.sqrt(na) * F.sqrt(nb)))


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    return np.stack([np.asarray(v[:dims], dtype="float64") for v in vectors])


def _block_top_k(k: int, exclude_same: bool):
    """Per (query block, corpus block): each query's k nearest corpus rows of the block."""

    def run(queries: pd.DataFrame, corpus: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(corpus):
            qlen, clen = queries["v"].map(len), corpus["v"].map(len)
            for dims in sorted({min(a, b) for a in set(qlen) for b in set(clen)}):
                for qd in sorted(set(qlen)):
                    for cd in sorted(set(clen)):
                        if min(qd, cd) != dims:
                            continue
                        out.append(_nearest(queries[qlen == qd], corpus[clen == cd], dims, k, exclude_same))
        if not out:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})
        return pd.concat(out)

    return run


def _unit(m: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Rows of length one in single precision; a row without a length is zero, as its similarities are."""
    return np.divide(m, norm[:, None], out=np.zeros_like(m), where=norm[:, None] > 0).astype("float32")


def _finite(rows: pd.DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and norms; a row with a NULL, NaN or infinite component has no similarity and is left out."""
    m = _matrix(rows["v"], dims)
    good = np.isfinite(m).all(axis=1)
    m = m[good]
    return rows["id"].to_numpy()[good], m, np.sqrt((m * m).sum(axis=1))


def _candidates(sims: np.ndarray, k: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of every entry that may be among its row's k highest, where entries may be off by half the margin.

    The k-th highest of the maxima of column groups is no higher than the k-th highest entry, and takes one pass to find.
    """
    wide = max(1, min(GROUP, sims.shape[1] // (4 * k)))
    maxima = np.maximum.reduceat(sims, np.arange(0, sims.shape[1], wide), axis=1)
    if maxima.shape[1] <= k:
        return np.nonzero(np.isfinite(sims))
    bound = np.partition(maxima, maxima.shape[1] - k, axis=1)[:, -k, None] - np.float32(margin)
    return np.divmod(np.flatnonzero(sims >= np.maximum(bound, np.float32(-2.0))), sims.shape[1])  # an excluded entry is -inf


def _nearest(queries: pd.DataFrame, corpus: pd.DataFrame, dims: int, k: int, exclude_same: bool) -> pd.DataFrame:
    """Exact top k: single precision finds the candidates within its error bound, double precision ranks them."""
    corpus = corpus.sort_values("id")
    ids, c, cn = _finite(corpus, dims)
    if len(ids):
        # Of equal vectors only the smallest ids can be among k; one id more may be the query's own.
        spare = int(pd.Series(ids).value_counts().iloc[0])
        texts = pd.Series([v.tobytes() for v in c])
        first = texts.groupby(texts, sort=False).cumcount().to_numpy() < k + spare
        ids, c, cn = ids[first], c[first], cn[first]
    qids, q, qn = _finite(queries, dims)
    c32, margin = _unit(c, cn).T.copy(), (dims + 8) * 2.5e-7
    found: list[pd.DataFrame] = []
    for start in range(0, len(qids) if len(ids) else 0, CHUNK):
        own = qids[start : start + CHUNK]
        sims = _unit(q[start : start + CHUNK], qn[start : start + CHUNK]) @ c32
        if exclude_same:
            lo, hi = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
            for i in np.flatnonzero(lo < hi):
                sims[i, lo[i] : hi[i]] = -np.inf
        rows, cols = _candidates(sims, k, margin)
        for at in range(0, len(rows), PAIRS):  # a query's candidates may span two cuts; the last ranking below takes care
            r, t = rows[at : at + PAIRS], cols[at : at + PAIRS]
            scale = qn[start + r] * cn[t]
            exact = np.divide(np.einsum("ij,ij->i", q[start + r], c[t]), scale, out=np.zeros(len(r)), where=scale > 0)
            found.append(_top(pd.DataFrame({"query_id": own[r], "__q": start + r, "id": ids[t], "similarity": exact}), k))
    if not found:
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})
    return _top(pd.concat(found), k).drop(columns="__q")


def _top(pairs: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of each query row, ties to the smaller id."""
    pairs = pairs[np.isfinite(pairs["similarity"])]
    pairs = pairs.iloc[np.lexsort((pairs["id"], -pairs["similarity"], pairs["__q"]))]
    return pairs[pairs.groupby("__q").cumcount() < k]


def knn(
    queries: DataFrame, corpus: DataFrame, k: int = KNN_K, exclude_same: bool = False, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Exact k nearest corpus rows per query by cosine (query_id, id, similarity, rank).

    Both sides carry id and v; rows without a vector are left out. The sides are cut
    into hash blocks of about `block_rows` rows and every pair of blocks is one
    cogrouped task: nothing is collected or broadcast, and a task holds two
    blocks whatever the table sizes. A block pair returns k rows per query; the
    merge keeps k of them (Spark trims each partition before that exchange).
    Similarity is clamped to [0, 1]; ties go to the smaller id.
    """
    some = F.coalesce(F.size("v"), F.lit(0)) > 0
    q, c = queries.filter(some).select("id", "v"), corpus.filter(some).select("id", "v")
    nq, nc = (max(1, math.ceil(d.count() / block_rows)) for d in (q, c))

    def cell(own: int, other: int) -> tuple[Column, Column]:
        return F.pmod(F.xxhash64("id"), F.lit(own)), F.explode(F.sequence(F.lit(0), F.lit(other - 1)))

    own, every = cell(nq, nc)
    left = q.withColumn("qb", own.cast("int")).withColumn("cb", every)
    own, every = cell(nc, nq)
    right = c.withColumn("cb", own.cast("int")).withColumn("qb", every)
    near = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(
        _block_top_k(k, exclude_same), "query_id bigint, id bigint, similarity double"
    )
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("id"))
    return (
        near.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .withColumn("similarity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("similarity"))))
    )


def neighbour_vote(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """Per query: positives among its neighbours and the top similarity."""
    return neighbours.join(labels.select("id", "label"), "id").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_pos"), F.max("similarity").alias("top1")
    )


