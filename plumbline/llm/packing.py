"""Packing of tokenised case narratives into training sequences by cutting-stock column generation."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.llm.common import gapless_rank, settle, spread_count
from plumbline.llm.word_ids import WordCache, release_memory, text_slices

LENGTH = 2_048
#: Lengths are planned in steps of so many tokens; a pattern always holds the true lengths.
UNIT = 8
END_ID = 1
CACHED_WORDS = 700_000
#: Text encoded at once: a step's words and token numbers take some ten times as much in the worker.
BYTES_PER_STEP = 1_000_000
MAX_PIVOTS = 5_000
#: The linear solution is within this share of the best one: its value over the best pattern's is a lower bound.
GAP = 5e-4

PIECES = "start long, length int, ids_crc32 long, doc_tokens long"

#: Letters of Latin-1 and closing marks behind them are two words to the tokenizer.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]*)")
WORDS_PER_LINE = 2_000


class WordIds:
    """Ids of texts by a tokenizer whose words never cross white space."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.cache = WordCache(self.learn, CACHED_WORDS)

    def _letters(self, stems: list[str]) -> dict[str, bytes]:
        """Words of letters alone, many to a line: each is cut off behind its token that ends a word."""
        if not stems:
            return {}
        lines = [" ".join(stems[i : i + WORDS_PER_LINE]) for i in range(0, len(stems), WORDS_PER_LINE)]
        coded = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.uint32), *coded])
        stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(stops) != len(stems):
            raise ValueError("the tokenizer does not end every word with </w>")
        raw, starts = ids.tobytes(), np.concatenate([[0], stops[:-1]])
        return {w: raw[a:b] for w, a, b in zip(stems, starts.tolist(), stops.tolist(), strict=True)}

    def learn(self, words: list[str]) -> list[bytes]:
        plain = [_PLAIN.fullmatch(w) for w in words]
        stems = [m and m[1].lower() for m in plain]
        letters = self._letters(list(set(filter(None, stems))))
        rest = list({w if m is None else m[2] for w, m in zip(words, plain, strict=True)} - {""})
        coded = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        others = {w: np.array(x.ids, np.uint32).tobytes() for w, x in zip(rest, coded, strict=True)} | {"": b""}
        return [others[w] if m is None else letters[stem] + others[m[2]] for w, m, stem in zip(words, plain, stems, strict=True)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each begins and the last ends."""
        cut = pc.ascii_split_whitespace(texts)
        return self.cache.ids(cut.flatten(), pc.list_value_length(cut).to_numpy())


_tokenizers: dict[str, WordIds] = {}


def cuts(n: int, length: int) -> Iterator[tuple[int, int]]:
    """Whole lengths from the front, then what is left; over half a length it is cut at the half, since such
    pieces cannot share a sequence with their like and would leave it padded.
    """
    for s in range(0, n - length + 1, length):
        yield s, s + length
    s = n - n % length
    if n - s > length // 2:
        yield s, s + length // 2
        s += length // 2
    if s < n:
        yield s, n


def _cut(path: str, length: int, end_id: int, cached_words: int = CACHED_WORDS):
    """A row per piece of each text."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _tokenizers.get(path) or _tokenizers.setdefault(path, WordIds(path))
        words.cache.limit = cached_words
        release_memory(words.cache)
        for batch in batches:
            texts = batch.column("rationale").fill_null("")
            row, start, size, crc, whole = [], [], [], [], []
            for at, some in text_slices(texts, BYTES_PER_STEP):
                ids, ends = words.encode(some)
                raw, ends = memoryview(ids.tobytes()), ends.tolist()
                for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False), at):
                    n = b - a + 1
                    for s, e in cuts(n, length):
                        piece = raw[4 * (a + s) : 4 * min(a + e, b)]
                        code = zlib.crc32(piece) if e < n else zlib.crc32(end, zlib.crc32(piece))
                        row.append(i), start.append(s), size.append(e - s), crc.append(code), whole.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row, pa.int32())), pa.array(start, pa.int64()), pa.array(size, pa.int32()), pa.array(crc, pa.int64()), pa.array(whole, pa.int64())],
                ["id", "start", "length", "ids_crc32", "doc_tokens"],
            )
        release_memory(words.cache)

    return run


def cut_cases(cases: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, cached_words: int = CACHED_WORDS) -> DataFrame:
    """Pieces of every tokenised rationale: id, start, length, ids_crc32, doc_tokens. See `pack_cases`."""
    kind = cases.schema["id"].dataType.simpleString()
    return cases.select("id", "rationale").mapInArrow(_cut(path, length, end_id, cached_words), f"id {kind}, {PIECES}")


def best_pattern(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Knapsack by dynamic programming: the counts of each size that fit in `room` with the largest value."""
    best, take = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(sizes, kind="stable")
    by_size, worth = sizes[order], values[order]
    for c in range(1, room + 1):
        upto = np.searchsorted(by_size, c, side="right")
        best[c] = best[c - 1]
        if upto:
            gain = worth[:upto] + best[c - by_size[:upto]]
            i = int(np.argmax(gain))
            if gain[i] > best[c] + 1e-12:
                best[c], take[c] = gain[i], order[i]
    counts, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            counts[take[c]] += 1
            c -= int(sizes[take[c]])
    return float(best[room]), counts


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, float]]:
    """Fewest bins for `demand` items of each size, as a linear program: (pattern, how often it is used).

    Column generation with a revised simplex method. It starts from bins of one size; the
    duals price a new pattern by the knapsack above, or a surplus column where a dual is
    negative; the basis inverse is updated by each pivot.
    """
    m = len(sizes)
    columns = [np.where(np.arange(m) == i, room // sizes[i], 0) for i in range(m)]
    cost = np.ones(m)
    inverse = np.diag([1.0 / (room // s) for s in sizes])
    demand = demand + 1e-4 * np.arange(1, m + 1) / m  # no two ratios tie, so pivots cannot cycle
    x = np.diag(inverse) * demand
    for _ in range(MAX_PIVOTS):  # ending early costs sequences, never items
        duals = np.einsum("i,ij->j", cost, inverse)
        if (low := int(np.argmin(duals))) >= 0 and duals[low] < -1e-9:
            entering, price = -np.eye(m)[low], 0.0
        else:
            value, entering = best_pattern(duals, sizes, room)
            price = 1.0
            if value <= 1 + GAP:
                break
        step = np.einsum("ij,j->i", inverse, entering)
        ratios = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratios))
        if not np.isfinite(ratios[out]):
            break
        columns[out], cost[out] = entering, price
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        x = np.maximum(np.einsum("ij,j->i", inverse, demand), 0)
    return [(np.asarray(c, np.int64), float(k)) for c, k, p in zip(columns, x, cost, strict=True) if p and k > 1e-9]


def whole_patterns(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Rounded patterns that hold every item: the linear solution rounded down, and what is left by first fit, largest first."""
    if not len(sizes):
        return []
    out, left = [], demand.astype(np.int64).copy()
    for pattern, times in sorted(cutting_stock(sizes, demand.astype(float), room), key=lambda p: (-p[1], p[0].tolist())):
        # the nearest count below that no item exceeds
        k = int(times + 1e-7)
        used = pattern > 0
        if used.any():
            k = min(k, int(-(-left[used] // pattern[used]).min()))
        if k > 0:
            out.append((pattern, k))
            left = np.maximum(left - k * pattern, 0)
    bins: list[tuple[int, np.ndarray]] = []
    for i in np.argsort(-sizes, kind="stable"):
        for _ in range(int(left[i])):
            for b, (free, pattern) in enumerate(bins):
                if free >= sizes[i]:
                    pattern[i] += 1
                    bins[b] = (free - int(sizes[i]), pattern)
                    break
            else:
                pattern = np.zeros(len(sizes), np.int64)
                pattern[i] = 1
                bins.append((room - int(sizes[i]), pattern))
    return out + [(pattern, 1) for _, pattern in bins]


def _places(sizes: np.ndarray, patterns: list[tuple[np.ndarray, int]]) -> tuple[dict[int, tuple[np.ndarray, ...]], int]:
    """Per size the ranks at which a pattern begins to take its items: (first rank, items a bin, first bin, first slot)."""
    table: dict[int, list[tuple[int, int, int, int]]] = {int(s): [] for s in sizes}
    taken, first = np.zeros(len(sizes), np.int64), 0
    for pattern, times in patterns:
        slot = 0
        for i in np.flatnonzero(pattern)[::-1]:
            table[int(sizes[i])].append((int(taken[i]), int(pattern[i]), first, slot))
            slot += int(pattern[i])
            taken[i] += times * pattern[i]
        first += times
    return {s: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for s, rows in table.items() if rows}, first


def _assign(table: dict[int, tuple[np.ndarray, ...]], whole: int, whole_from: int):
    """Sequence and slot of each ranked piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column("units").to_numpy(), batch.column("rank").to_numpy()
            sequence, slot = whole_from + rank, np.zeros(len(rank), np.int64)
            for s in np.unique(size):
                if s != whole:
                    here = np.flatnonzero(size == s)
                    since, each, first, at = table[int(s)]
                    p = np.searchsorted(since, rank[here], side="right") - 1
                    k = rank[here] - since[p]
                    sequence[here], slot[here] = first[p] + k // each[p], at[p] + k % each[p]
            yield batch.append_column("sequence_id", pa.array(sequence)).append_column("slot", pa.array(slot))

    return run


def pack_cases(cases: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, cached_words: int = CACHED_WORDS) -> DataFrame:
    """Pack all narratives into sequences of at most `length` tokens with little padding.

    cases: id, rationale; path: a tokenizer file whose words never cross white space. A case is its ids and then
    `end_id`; it is cut by `cuts` into whole lengths and a remainder. Whole pieces are sequences of their
    own. The others are packed as a cutting-stock problem over their length histogram (at
    most `length` rows on the driver): column generation finds patterns, rounded
    patterns take items of each length by rank. Returns a row per piece: id, start, length,
    ids_crc32, doc_tokens, sequence_id (long), offset (long, gapless from 0 in a sequence).
    `cached_words` bounds the words a worker remembers; fewer cost time, never ids.

    Nulls: a null rationale is an empty text, of one piece with `end_id` alone; null ids stay.
    Repeated rows are packed one by one. Very long texts are cut like all. No cases: no rows. Other columns are not carried.
    """
    # a whole length gets a code of its own: it is never planned
    code = F.when(F.col("length") == length, F.lit(0)).otherwise(F.ceil(F.col("length") / F.lit(UNIT)))
    pieces = settle(cut_cases(cases, path, length, end_id, cached_words).withColumn("units", code.cast("int")))
    histogram = {r["units"]: r["n"] for r in pieces.groupBy("units").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = np.array(sorted(u for u in histogram if u > 0), np.int64)
    patterns = whole_patterns(sizes, np.array([histogram[int(u)] for u in sizes], np.int64), length // UNIT)
    table, bins = _places(sizes, patterns)
    ranked = gapless_rank(pieces, ["units"], ["id", "start", "ids_crc32", "length"], "rank", spread_count(max(histogram.values(), default=0)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    placed = ranked.mapInArrow(_assign(table, 0, bins), f"{kinds}, sequence_id long, slot long")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")
    return placed.select("id", "start", F.col("length").cast("long"), "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))
