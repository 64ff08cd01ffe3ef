"""Byte-level BPE of case narratives: merges by a recursive DuckDB query in each task, decoding by ordered aggregation."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from plumbline.llm.word_ids import WordCache, text_slices

#: Words this long (bytes) are merged with a heap: one contraction per round costs their length squared.
LONG_WORD = 256
WORDS_PER_QUERY = 20_000
CACHED_WORDS = 700_000
#: Texts are taken together up to this many bytes; a longer one is taken alone and whole.
BYTES_PER_STEP = 6_000_000
MEMORY = "256MB"

#: start(word, pos, tok) holds a row per token position, at first one per byte. Each step finds every word's
#: leftmost pair of least rank, puts the whole in the place of its left token and drops the right one.
ENCODE = """WITH RECURSIVE run(step, word, pos, tok, after, before) AS (
  SELECT 0, word, pos, tok, lead(tok) OVER near, lag(pos) OVER near
  FROM start WINDOW near AS (PARTITION BY word ORDER BY pos)
  UNION ALL
  SELECT step + 1, word, pos, tok, lead(tok) OVER near, lag(pos) OVER near
  FROM (
    SELECT step, run.word, pos, CASE WHEN pos = best % 65536 THEN (best // 65536)::INTEGER ELSE tok END AS tok
    FROM run JOIN (
      SELECT word, min(merged::BIGINT * 65536 + pos) AS best
      FROM run JOIN merges ON merges.l = run.tok AND merges.r = run.after GROUP BY word
    ) AS least USING (word)
    WHERE before IS DISTINCT FROM best % 65536
  ) WINDOW near AS (PARTITION BY word ORDER BY pos)
)
SELECT run.word, list(tok ORDER BY pos) AS ids
FROM run JOIN (SELECT word, max(step) AS step FROM run GROUP BY word) AS final USING (word, step) GROUP BY run.word"""

DECODE = """SELECT doc, unhex(string_agg(piece, '' ORDER BY pos)) AS text
FROM tokens JOIN vocabulary USING (tok) GROUP BY doc"""


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 bytes and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge_pairs(ranks: dict[bytes, int]) -> tuple[list[int], list[int], list[int]]:
    """Every way to cut a token into two tokens: ids of left, right and whole. A pair's rank is the whole's."""
    left, right, whole = [], [], []
    for token, rank in ranks.items():
        for at in range(1, len(token)):
            a, b = ranks.get(token[:at]), ranks.get(token[at:])
            if a is not None and b is not None:
                left.append(a), right.append(b), whole.append(rank)
    return left, right, whole


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same contraction for one very long word, with a heap of (rank, place)."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a piece at i is word[i:end[i]]; dead pieces have end 0
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, upto = heapq.heappop(heap)
        mid = end[i]
        if mid == 0 or mid >= n or end[mid] != upto:
            continue
        end[i], end[mid] = upto, 0
        if upto < n:
            before[upto] = i
            if (r := ranks.get(word[i : end[upto]])) is not None:
                heapq.heappush(heap, (r, i, end[upto]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:upto])) is not None:
            heapq.heappush(heap, (r, p, upto))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """One per Python worker: the merge table and vocabulary in DuckDB, and the words met last."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks, self.pattern = read_ranks(path), regex.compile(pattern)
        self.cache = WordCache(self.learn, CACHED_WORDS)
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY})
        left, right, whole = (pa.array(x, pa.int32()) for x in merge_pairs(self.ranks))
        self.db.register("given", pa.table({"l": left, "r": right, "merged": whole}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        pieces = pa.table({"tok": pa.array(list(self.ranks.values()), pa.int32()), "piece": [t.hex() for t in self.ranks]})
        self.db.register("given", pieces)
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.db.unregister("given")

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words: a recursive query for each WORDS_PER_QUERY of them."""
        out = [b""] * len(words)
        for first in range(0, len(words), WORDS_PER_QUERY):
            raw = [w.encode() for w in words[first : first + WORDS_PER_QUERY]]
            for i in (i for i, b in enumerate(raw) if len(b) >= LONG_WORD):
                out[first + i] = np.array(merge_long(raw[i], self.ranks), np.int32).tobytes()
            short = np.array([i for i, b in enumerate(raw) if len(b) < LONG_WORD], np.int32)
            if not len(short):
                continue
            lens = np.array([len(raw[i]) for i in short])
            pos = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
            tok = self.byte_ids[np.frombuffer(b"".join(raw[i] for i in short), np.uint8)]
            start = pa.table({"word": pa.array(np.repeat(short, lens)), "pos": pa.array(pos.astype(np.int32)), "tok": pa.array(tok)})
            self.db.register("start", start)
            got = self.db.sql(ENCODE).to_arrow_table().combine_chunks()
            self.db.unregister("start")
            ids = got.column("ids").combine_chunks()
            flat, off = ids.values.to_numpy().astype(np.int32).tobytes(), (4 * ids.offsets.to_numpy()).tolist()
            for word, a, b in zip(got.column("word").to_pylist(), off, off[1:], strict=False):
                out[first + word] = flat[a:b]
        return out

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each begins and the last ends."""
        cut = [self.pattern.findall(t) for t in texts.to_pylist()]
        return self.cache.ids(pa.array(chain.from_iterable(cut), pa.string()), np.array([len(w) for w in cut], np.int64))

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of each id sequence: ids join the vocabulary and are strung together by position."""
        lens = np.diff(ends)
        out = [b""] * len(lens)
        tokens = pa.table(
            {
                "doc": pa.array(np.repeat(np.arange(len(lens), dtype=np.int32), lens)),
                "pos": pa.array((np.arange(len(ids)) - np.repeat(ends[:-1], lens)).astype(np.int32)),
                "tok": pa.array(ids.astype(np.int32)),
            }
        )
        self.db.register("tokens", tokens)
        for doc, text in self.db.execute(DECODE).fetchall():
            out[doc] = text
        self.db.unregister("tokens")
        return out


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _round_trip(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            n, hashes, back = [], [], []
            for _, texts in text_slices(batch.column("rationale").fill_null(""), BYTES_PER_STEP):
                ids, ends = codec.encode(texts)
                n += np.diff(ends).tolist()
                decimal = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids).cast(pa.string()))
                hashes += [hashlib.sha256(x.as_buffer()).hexdigest() for x in pc.binary_join(decimal, ",")]
                back += [hashlib.sha256(x).hexdigest() for x in codec.decode(ids, ends)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _tokens(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            lists = []
            for _, texts in text_slices(batch.column("rationale").fill_null(""), BYTES_PER_STEP):
                ids, ends = codec.encode(texts)
                lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids).cast(pa.int32())))
            whole = pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), whole], ["id", "ids"])

    return run


def _texts(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            lists = batch.column("ids")
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
            texts = codec.decode(lists.flatten().to_numpy(), ends)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.binary())], ["id", "rationale"])

    return run


def _id_type(cases: DataFrame) -> str:
    return cases.schema["id"].dataType.simpleString()


def encode_cases(cases: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token ids of every whole rationale: id, ids (array of int). Cases: id, rationale.

    `path` is a rank file, `pattern` cuts a text into words that are merged
    separately. A null rationale counts as empty and has no ids; null ids and
    repeated rows stay; other columns are not carried; no cases, no rows.
    """
    out = f"id {_id_type(cases)}, ids array<int>"
    return cases.select("id", "rationale").mapInArrow(_tokens(path, pattern), out)


def decode_cases(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """The bytes of every id sequence: id, rationale (binary). Null or empty ids give empty bytes."""
    out = f"id {_id_type(tokens)}, rationale binary"
    return tokens.select("id", "ids").mapInArrow(_texts(path, pattern), out)


def round_trip(cases: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every case and decode its ids again in the same task: id, n_tokens, ids_sha256 (of the decimal
    ids joined by commas) and decoded_sha256 (of the decoded bytes), in lower-case hex. Nulls as in `encode_cases`.
    """
    out = f"id {_id_type(cases)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return cases.select("id", "rationale").mapInArrow(_round_trip(path, pattern), out)
