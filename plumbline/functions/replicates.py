"""Poisson(1) replicate weights as matrices inside a task.

A row and replicate would be two thousand rows for each row of input. Here a task holds the weights of some hundred rows at a
time (rows x replicates) and only sums over rows leave it. The draws are those of `hashing.poisson_weight`: 32 bits of
md5(seed|key|replicate div 4), so they do not depend on the partitioning.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd

from plumbline.functions.hashing import TWO_32, poisson_cuts

DRAWS_PER_HASH = 4
#: Hashes of a row in one group of work, so 200 replicates.
BLOCKS = 50
ROWS = 512
CUTS = np.array([math.ceil(c * TWO_32) for c in poisson_cuts()], dtype="uint32")


#: Hashes that are worth a pass of `_md5` over arrays, and how many it takes at once.
FEW, MANY = 4_000, 50_000
START = tuple(np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
#: Per step of MD5: its word, its constant and the two shifts of its turn.
STEPS = [
    ((i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16, np.uint32(abs(math.sin(i + 1)) * TWO_32), np.uint32(n := TURNS[i // 16][i % 4]), np.uint32(32 - n))
    for i in range(64)
]


def slices(n_boot: int) -> int:
    """Groups of BLOCKS hashes that hold `n_boot` replicates."""
    return math.ceil(n_boot / (BLOCKS * DRAWS_PER_HASH))


def _md5(words: Sequence[np.ndarray], shape: tuple[int, int]) -> list[np.ndarray]:
    """The four words, high byte first, of the MD5 of many one-block messages; `words` are the 16 of the block."""
    a, b, c, d = (np.full(shape, s) for s in START)
    f, t = np.empty(shape, "uint32"), np.empty(shape, "uint32")
    for i, (word, sine, left, right) in enumerate(STEPS):
        if i < 16:
            np.bitwise_xor(np.bitwise_and(np.bitwise_xor(c, d, f), b, f), d, f)
        elif i < 32:
            np.bitwise_xor(np.bitwise_and(np.bitwise_xor(b, c, f), d, f), c, f)
        elif i < 48:
            np.bitwise_xor(np.bitwise_xor(b, c, f), d, f)
        else:
            np.bitwise_xor(np.bitwise_or(np.invert(d, f), b, f), c, f)
        a += f
        a += words[word] + sine
        np.right_shift(a, right, t)
        np.bitwise_or(np.left_shift(a, left, a), t, a)
        a += b
        a, b, c, d = d, a, b, c
    return [np.add(x, s, x).byteswap(inplace=True) for x, s in zip((a, b, c, d), START)]


def _placed(texts: Sequence[bytes], at: int, size: int, close: bool) -> np.ndarray:
    """Texts of `size` bytes at byte `at` of MD5 blocks (words x texts), with the end of the message behind them if `close`."""
    block = np.zeros((len(texts), 64), "uint8")
    block[:, at : at + size] = np.frombuffer(b"".join(texts), "uint8").reshape(-1, size)
    if close:
        block[:, at + size] = 0x80
        block[:, 56:] = np.frombuffer((8 * (at + size)).to_bytes(8, "little"), "uint8")
    return np.ascontiguousarray(block.view("<u4").T)


def _draws(names: Sequence[bytes], blocks: range) -> np.ndarray:
    """Draws (blocks x 4 x names): the four words of md5(name|block)."""
    out = np.empty((len(blocks), DRAWS_PER_HASH, len(names)), "uint32")
    lengths = np.array([len(n) for n in names])
    for size in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == size)
        some = [names[r] for r in rows]
        if len(rows) * len(blocks) < FEW or size + len(b"|%d" % blocks[-1]) > 55:
            found = b"".join([hashlib.md5(n + b"|%d" % b).digest() for b in blocks for n in some])
            out[:, :, rows] = np.frombuffer(found, ">u4").reshape(len(blocks), len(rows), DRAWS_PER_HASH).swapaxes(1, 2)
            continue
        heads, at = _placed(some, 0, size, False), blocks[0]
        while at <= blocks[-1]:
            digits = len(str(at))
            to = min(blocks[-1] + 1, at + max(1, MANY // len(rows)), 10**digits)
            tails = _placed([b"|%d" % b for b in range(at, to)], size, digits + 1, True)
            words = [h[None, :] | t[:, None] if h.any() and t.any() else h[None, :] if h.any() else t[:, None] for h, t in zip(heads, tails)]
            out[at - blocks[0] : to - blocks[0], :, rows] = np.stack(_md5(words, (to - at, len(rows))), axis=1)
            at = to
    return out


def weights(names: Sequence[str], part: int, parts: int = 1) -> np.ndarray:
    """Weights (rows x replicates) of slice `part` and the `parts` - 1 behind it; `names` are seed|key."""
    draws = _draws([n.encode() for n in names], range(part * BLOCKS, (part + parts) * BLOCKS)).reshape(-1, len(names))
    out = np.zeros(draws.shape, "uint8")
    for cut in CUTS:
        out += draws >= cut
    return np.ascontiguousarray(out.T)


def replicates(part: int, parts: int = 1) -> np.ndarray:
    """Numbers of the replicates of slice `part` and the `parts` - 1 behind it."""
    return np.arange(part * BLOCKS * DRAWS_PER_HASH, (part + parts) * BLOCKS * DRAWS_PER_HASH)


def score_sums(rows: pd.DataFrame, part: int, descending: bool = False, parts: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Weighted positives and negatives (distinct scores x replicates) of `rows`, in score order and in pieces.

    `rows` has columns name, score, y (is positive) and k (copies). A score never spans two pieces, however often it occurs.
    """
    order = np.argsort(rows["score"].to_numpy(), kind="stable")
    rows = rows.iloc[order[::-1] if descending else order]
    names, scores = rows["name"].to_numpy(), rows["score"].to_numpy()
    pos, copies = rows["y"].to_numpy(dtype=bool), rows["k"].to_numpy(dtype="int64")
    held = None
    step = max(64, ROWS // parts)
    for at in range(0, len(scores), step):
        cut = slice(at, at + step)
        score = scores[cut]
        starts = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
        w = weights(names[cut], part, parts) * copies[cut, None]
        p = np.where(pos[cut, None], w, 0)
        n = w - p
        if len(starts) < len(w):
            p, n = np.add.reduceat(p, starts), np.add.reduceat(n, starts)
        if held is not None:
            if held[0] == score[0]:
                p[0] += held[1]
                n[0] += held[2]
            else:
                p, n = np.vstack([held[1], p]), np.vstack([held[2], n])
        held = score[-1], p[-1], n[-1]
        if len(p) > 1:
            yield p[:-1], n[:-1]
    if held is not None:
        yield held[1][None, :], held[2][None, :]


def auc_part(rows: pd.DataFrame, part: int, parts: int = 1) -> pd.DataFrame:
    """Per replicate: concordance inside a group of rows and its class totals."""
    reps = replicates(part, parts)
    won, all_pos, below = np.zeros(len(reps)), np.zeros(len(reps), "int64"), np.zeros(len(reps), "int64")
    for p, n in score_sums(rows, part, parts=parts):
        upto = below + np.cumsum(n, axis=0)
        won += (p * (upto - n / 2.0)).sum(axis=0)
        all_pos += p.sum(axis=0)
        below = upto[-1]
    return pd.DataFrame({"rep": reps, "part": won, "n_pos": all_pos, "n_neg": below})


def roc_part(rows: pd.DataFrame, before: pd.DataFrame, part: int, fpr_max: float, x: float) -> pd.DataFrame:
    """Per replicate: a bucket's share of AUC and partial AUC, and the sensitivity where the curve passes x inside it.

    `before` has a row per replicate: positives and negatives of the higher buckets (tp, fp) and of all (all_pos, all_neg).
    """
    before = before.set_index("rep").reindex(replicates(part), fill_value=0)
    tp, fp, all_pos, all_neg = (before[c].to_numpy() for c in ("tp", "fp", "all_pos", "all_neg"))
    won, area, sens = np.zeros(len(before)), np.zeros(len(before)), np.full(len(before), np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        for p, n in score_sums(rows, part, descending=True):
            tps, fps = tp + np.cumsum(p, axis=0), fp + np.cumsum(n, axis=0)
            won += (p * (all_neg - fps + n / 2.0)).sum(axis=0)
            tpr, fpr, tpr0, fpr0 = tps / all_pos, fps / all_neg, (tps - p) / all_pos, (fps - n) / all_neg
            slope = (tpr - tpr0) / (fpr - fpr0)
            end = np.minimum(fpr, fpr_max)
            inside = (fpr > fpr0) & (fpr0 < fpr_max)
            area += np.where(inside, (end - fpr0) * (tpr0 + tpr0 + slope * (end - fpr0)) / 2.0, 0.0).sum(axis=0)
            at = np.where((fpr0 <= x) & (fpr > x), tpr0 + slope * (x - fpr0), np.nan)
            sens = np.fmax(sens, np.fmax.reduce(at, axis=0))
            tp, fp = tps[-1], fps[-1]
    out = pd.DataFrame({"rep": before.index, "won": won, "area": area, "sens": sens, "all_pos": all_pos, "all_neg": all_neg})
    return out[(all_pos > 0) & (all_neg > 0)]


def value_sums(rows: pd.DataFrame, values: Sequence[str], n_boot: int) -> pd.DataFrame:
    """Per replicate: sum of weights (w) and of weight times each of `values`."""
    names, table = rows["name"].to_numpy(), rows[list(values)].to_numpy(dtype="float64")
    table, n = np.column_stack([np.ones(len(table)), table]), slices(n_boot)
    step = max(64, ROWS // n)
    sums = sum(weights(names[at : at + step], 0, n).T @ table[at : at + step] for at in range(0, len(names), step))
    return pd.DataFrame(sums, columns=["w", *values]).assign(rep=replicates(0, n))
