"""Alignment of case narratives encoded by two tokenizers: shared cuts, groups of tokens and how often tokens meet."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import shared_folder
from plumbline.llm.word_ids import WordCache, release_memory, text_slices

CACHED_WORDS = 200_000
WORDS_PER_LINE = 2_000
BYTES_PER_STEP = 500_000
#: Rows held back by a writer before they go to disk; links are long, and every core of an executor has a writer.
ROW_GROUP_BYTES = 16 << 20
#: Texts priced together; a longer text is a chunk of its own.
BYTES_PER_CHUNK = 8_000_000
#: Tokens of a stretch that are compared one by one.
NEAR = 6

IS_B, NO_TOKENS = np.uint32(1 << 31), 0xFFFFFFFF
#: A pair of ids in one number, the B id first; A ids are below 2 ** A_BITS.
A_BITS = 16

_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_TWO_SPACES = re.compile(r"\s\s")


def byte_level_bytes() -> dict[str, int]:
    """The byte behind every character of a byte-level vocabulary: visible Latin-1 ones stand for themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def words_at_single_spaces(text: str) -> list[str]:
    """A text cut at every space between two visible characters; neither tokenizer has a token across such a cut."""
    if text[0].isspace() or text[-1].isspace() or _TWO_SPACES.search(text):
        return _SINGLE_SPACE.split(text)
    return text.split(" ")


class TwoTokenizers:
    """Ids of texts by a byte-level BPE (A) and a piece BPE with byte fallback (B), each distinct word once while remembered.

    A word is remembered as its A ids, then its B ids with the highest bit set; NO_TOKENS marks one whose bytes differ.
    """

    def __init__(self, bpe_path: str, piece_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(bpe_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        to_byte, vocab = byte_level_bytes(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        if len(self.a_bytes) > 1 << A_BITS:
            raise ValueError(f"tokenizer A has more than {1 << A_BITS} ids")
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("tokenizer B has pieces across words")
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        self.cache = WordCache(self.learn, CACHED_WORDS)

    def _encode(self, lines: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = self.a.encode_batch_fast([" " + x for x in lines], add_special_tokens=False)
        return [x.ids for x in a], self.b.encode(lines, num_threads=1)

    def _same(self, ids: list[int], coded: list[bytes], line: bytes) -> bool:
        return b"".join(map(coded.__getitem__, ids)) == line

    def _one(self, word: str, a: list[int], b: list[int]) -> bytes:
        line = b" " + word.encode()
        if not (self._same(a, self.a_bytes, line) and self._same(b, self.b_bytes, line)):
            return np.array([NO_TOKENS], np.uint32).tobytes()
        return np.concatenate([np.array(a, np.uint32), np.array(b, np.uint32) | IS_B]).tobytes()

    def learn(self, words: list[str]) -> list[bytes]:
        """Many words to a line, cut again where the bytes of their tokens end; one by one where white space or odd bytes forbid it."""
        known: dict[str, bytes] = {}
        plain = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
        lines = [plain[i : i + WORDS_PER_LINE] for i in range(0, len(plain), WORDS_PER_LINE)]
        for some, a, b in zip(lines, *self._encode([" ".join(x) for x in lines]), strict=True):
            line = (" " + " ".join(some)).encode()
            if not (self._same(a, self.a_bytes, line) and self._same(b, self.b_bytes, line)):
                continue
            a_raw, b_raw = np.array(a, np.uint32), np.array(b, np.uint32)
            stops = np.cumsum([len(w.encode()) + 1 for w in some])
            a_stop = np.searchsorted(np.cumsum(self.a_sizes[a_raw]), stops) + 1
            b_stop = np.searchsorted(np.cumsum(self.b_sizes[b_raw]), stops) + 1
            a_raw, b_raw, i, j = a_raw.tobytes(), (b_raw | IS_B).tobytes(), 0, 0
            for w, x, y in zip(some, (4 * a_stop).tolist(), (4 * b_stop).tolist(), strict=True):
                known[w] = a_raw[i:x] + b_raw[j:y]
                i, j = x, y
        rest = [w for w in words if w not in known]
        known.update((w, self._one(w, a, b)) for w, a, b in zip(rest, *self._encode(rest), strict=True))
        return [known[w] for w in words]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A ids and B ids of all texts in a row, and where each text's begin and the last one's end."""
        words = [words_at_single_spaces(x) if x else [] for x in texts]
        per_text = np.fromiter(map(len, words), np.int64, len(words))
        ids, ends = self.cache.ids(pa.array([w for some in words for w in some], pa.string()), per_text)
        text_of = np.repeat(np.arange(len(texts)), np.diff(ends))
        bad = np.zeros(len(texts), bool)
        bad[text_of[ids == NO_TOKENS]] = True
        of_b = ids >= IS_B
        a, b = ~of_b & ~bad[text_of], of_b & ~bad[text_of]
        stops = [np.concatenate([[0], np.cumsum(np.bincount(text_of[x], minlength=len(texts)))]) for x in (a, b)]
        return ids[a], ids[b] ^ IS_B, *stops


def align(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
    """Groups between common ends of two tokenisations of the same bytes, by diagonal run skipping.

    At the shift j - i of two tokens that start together, end arrays are compared ahead: token by token at first, then in stretches
    of doubling length, the last one halved until the first difference, so a long one-to-one stretch costs the logarithm of
    its length in steps. A difference is walked to the next common end, which gives the new shift.

    Returns first tokens i, first tokens j and lengths of one-to-one stretches, and the last tokens i and j of the other groups.
    """
    run_a, run_b, run_n, odd_a, odd_b = [], [], [], [], []
    i, j, n = 0, 0, len(a_ends)
    a_ends, b_ends = [*a_ends, -1], [*b_ends, -2]  # unequal, so that no stretch passes the end
    while i < n:
        a, b = a_ends[i], b_ends[j]
        if a == b:
            k = 1
            while a_ends[i + k] == b_ends[j + k]:
                k += 1
                if k == NEAR:
                    step = NEAR
                    while a_ends[i + k : i + k + step] == b_ends[j + k : j + k + step]:
                        k += step
                        step *= 2
                    while step := step // 2:
                        if a_ends[i + k : i + k + step] == b_ends[j + k : j + k + step]:
                            k += step
                    break
            run_a.append(i), run_b.append(j), run_n.append(k)
            i, j = i + k, j + k
        else:
            while a != b:
                if a < b:
                    i += 1
                    a = a_ends[i]
                else:
                    j += 1
                    b = b_ends[j]
            odd_a.append(i), odd_b.append(j)
            i, j = i + 1, j + 1
    return run_a, run_b, run_n, odd_a, odd_b


def links_of(a_ends: np.ndarray, b_ends: np.ndarray, a_one: np.ndarray, b_one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of overlapping tokens: those of one-to-one stretches as they are; elsewhere every end of either side closes one pair."""
    a_rest, b_rest = np.ones(len(a_ends), bool), np.ones(len(b_ends), bool)
    a_rest[a_one], b_rest[b_one] = False, False
    a_rest, b_rest = np.flatnonzero(a_rest), np.flatnonzero(b_rest)
    ends = np.unique(np.concatenate([a_ends[a_rest], b_ends[b_rest]]))
    a_odd, b_odd = a_rest[np.searchsorted(a_ends[a_rest], ends)], b_rest[np.searchsorted(b_ends[b_rest], ends)]
    return np.concatenate([a_one, a_odd]), np.concatenate([b_one, b_odd])


def _counted(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every stretch, in a row."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _digits(n: int) -> np.ndarray:
    """Decimal digits of 0 to n - 1 as bytes, zero bytes behind them."""
    return np.array([str(i) for i in range(n)], "S5").view(np.uint8).reshape(n, 5)


def group_text(a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, digits: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """`a1,a2|b1;a3|b2,b3;` of all groups in a row, and where the text of each A token and each B token ends.

    a_last, b_last: whether a token is the last one of its group.
    """
    a_stop, b_stop = np.flatnonzero(a_last) + 1, np.flatnonzero(b_last) + 1
    a_at = np.arange(len(a)) + np.concatenate([[0], b_stop])[np.cumsum(a_last) - a_last]
    b_at = np.arange(len(b)) + a_stop[np.cumsum(b_last) - b_last]
    ids, mark = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
    ids[a_at], ids[b_at] = a, b
    mark[a_at], mark[b_at] = np.where(a_last, ord("|"), ord(",")), np.where(b_last, ord(";"), ord(","))
    cells = np.concatenate([digits[ids], mark[:, None]], axis=1)
    ends = np.cumsum(np.count_nonzero(cells, axis=1))
    return cells[cells != 0].tobytes(), ends[a_at], ends[b_at]


_pairs: dict[tuple[str, str], tuple[TwoTokenizers, np.ndarray]] = {}


def _aligned_texts(texts: list[str], both: TwoTokenizers, digits: np.ndarray) -> Iterator[tuple[int, int, int, int, str, bytes]]:
    """(n_a, n_b, n_groups, n_links, groups_sha256, links) of every text; links: sorted pairs of ids, each less the one before."""
    a, b, a_cut, b_cut = both.encode(texts)
    a_ends, b_ends = np.cumsum(both.a_sizes[a]), np.cumsum(both.b_sizes[b])
    i, j, k, *odd = (np.array(x, np.int64) for x in align(a_ends.tolist(), b_ends.tolist()))
    a_one, b_one = _counted(i, k), _counted(j, k)
    a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
    a_last[a_one], a_last[odd[0]], b_last[b_one], b_last[odd[1]] = True, True, True, True
    raw, _, stops = group_text(a, b, a_last, b_last, digits)
    link_a, link_b = links_of(a_ends, b_ends, a_one, b_one)
    text_of = np.searchsorted(a_cut, link_a, side="right") - 1
    keys = np.sort((text_of << 32) | (b[link_b].astype(np.int64) << A_BITS) | a[link_a])
    cut = np.searchsorted(keys, np.arange(len(texts) + 1) << 32)
    keys = (keys & 0xFFFFFFFF).astype(np.int32)
    groups = np.concatenate([[0], np.cumsum(a_last)])
    since = 0
    for t in range(len(texts)):
        if a_cut[t] == a_cut[t + 1]:
            yield 0, 0, 0, 0, "", b""
            continue
        end = int(stops[b_cut[t + 1] - 1])
        sha, since = hashlib.sha256(raw[since : end - 1]).hexdigest(), end
        links = np.diff(keys[cut[t] : cut[t + 1]], prepend=np.int32(0))
        yield int(a_cut[t + 1] - a_cut[t]), int(b_cut[t + 1] - b_cut[t]), int(groups[a_cut[t + 1]] - groups[a_cut[t]]), len(links), sha, links.tobytes()


KINDS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"
_SCHEMA = pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]]) for x in KINDS.split(", ")])


def _align(bpe_path: str, piece_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (bpe_path, piece_path) not in _pairs:
            both = TwoTokenizers(bpe_path, piece_path)
            _pairs[bpe_path, piece_path] = both, _digits(max(len(both.a_bytes), len(both.b_bytes)))
        both, digits = _pairs[bpe_path, piece_path]
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for at, some in text_slices(batch.column("rationale"), BYTES_PER_STEP):
                texts = some.to_pylist()
                rows = list(_aligned_texts(texts, both, digits))
                out = [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(texts)), pa.array([chunk] * len(texts), pa.int64()), *out], ["id", "chunk", *_SCHEMA.names])
                held += some.nbytes
                if held >= BYTES_PER_CHUNK:
                    chunk, held = chunk + 1, 0
        release_memory(both.cache)

    return run


def _links(rows: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.cumsum(np.frombuffer(x, np.int32), dtype=np.int32) for x in rows.to_pylist()]


def _usage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, pair, n) of links, summed up as far as rows of a chunk come together."""
    for batch in batches:
        chunks = batch.column("chunk").to_numpy()
        starts = np.flatnonzero(np.diff(chunks, prepend=chunks[:1] - 1))
        for a, b in zip(starts, [*starts[1:], len(chunks)], strict=True):
            pair, n = np.unique(np.concatenate(_links(batch.column("links").slice(a, b - a))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), chunks[a])), pa.array(pair), pa.array(n)], ["chunk", "pair", "n"])


def _price(cases: pa.Table, prices: pa.Table) -> pa.Table:
    """n_best and count_sum of the cases of one chunk from the counts of its pairs."""
    order = np.argsort(prices.column("pair").to_numpy())
    pair, count, best = (prices.column(c).to_numpy()[order] for c in ("pair", "count", "best"))
    n_best, count_sum = [], []
    for links in _links(cases.column("links")):
        at = np.searchsorted(pair, links)
        n_best.append(int(np.count_nonzero(best[at])) if len(at) else 0)
        count_sum.append(int(count[at].sum()) if len(at) else 0)
    out = cases.drop_columns(["links", "chunk"])
    return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))


def align_tokenizers(cases: DataFrame, bpe_path: str, piece_path: str) -> DataFrame:
    """Align what two tokenizers make of every whole rationale.

    cases: id, rationale. A: a byte-level BPE file, of a space and the text; B: a piece model with byte fallback that adds
    the space itself. Strings of special tokens are plain text. Bytes where tokens of both end cut a text into groups; an A and
    a B token whose bytes overlap are a link. Returns per case id, n_a, n_b (tokens), n_groups, n_links,
    n_best (links whose pair of ids no other A id exceeds for its B id, in links of the whole corpus), count_sum (corpus
    counts over links), groups_sha256 (of `a1,a2|b1;a3|b2,b3`).

    Texts are encoded once; ids, groups and links are written to the shared folder. Pairs of ids are then counted per
    chunk of some megabytes, summed up over the corpus, and the counts of a chunk's own pairs go back to it: what is shuffled
    grows with the distinct pairs of the chunks, and no table of pairs is held by a task or the driver.

    Nulls: a null or empty rationale, or one whose joined A or B bytes differ from space and text, has no tokens: zeros
    and an empty groups_sha256. A null id is kept. Repeated rows are aligned one by one and all count. Very long texts are aligned
    whole; one above a chunk's size is a chunk of its own. Equal counts are all best. Other columns are not carried and cannot
    clash. No cases: no rows.
    """
    spark = cases.sparkSession
    kind = cases.schema["id"].dataType.simpleString()
    folder = shared_folder(spark)
    coded = cases.select("id", F.coalesce("rationale", F.lit("")).alias("rationale"))
    coded.mapInArrow(_align(bpe_path, piece_path), f"id {kind}, chunk long, {KINDS}").write.options(**{"compression": "zstd", "parquet.block.size": ROW_GROUP_BYTES}).parquet(
        f"{folder}/aligned"
    )
    aligned = spark.read.parquet(f"{folder}/aligned")
    aligned.select("chunk", "links").mapInArrow(_usage, "chunk long, pair int, n long").write.parquet(f"{folder}/usage")
    usage = spark.read.parquet(f"{folder}/usage")
    counts = usage.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.shiftright("pair", A_BITS))
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    prices = counts.join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    priced = usage.select("chunk", "pair").join(prices, "pair").select("chunk", "pair", "count", "best")
    kinds = ", ".join(x for x in KINDS.split(", ") if not x.startswith("links"))
    return aligned.groupBy("chunk").cogroup(priced.groupBy("chunk")).applyInArrow(_price, f"id {kind}, {kinds}, n_best long, count_sum long")
