"""Packing: exact pieces, full sequences, and the linear program against enumeration."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from tokenizers import Tokenizer

from plumbline.llm import packing

PATH = P.path("word_bpe_49k.json")


def ids_of(text):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, texts, length):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    for i, text in texts.items():
        ids = ids_of(text)
        pieces = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows if r["id"] == i)
        at = 0
        for start, size, crc, n in pieces:
            assert start == at and n == len(ids)
            assert crc == zlib.crc32(np.array(ids[start : start + size], "<u4").tobytes())
            at += size
        assert at == len(ids)


def test_pieces_cover_every_text(spark):
    draw = random.Random(2)
    texts = {i: " ".join(draw.choice(["lung", "Opacity,", "éÀß.", "x's", "12", "ΣΑΣ", "áb"]) for _ in range(draw.randint(0, 300))) for i in range(60)}
    texts |= {100: "", 101: None, 102: "\x1c lung\x1dfield", 103: "abc" * 4000, 104: "<|endoftext|> clear", 105: "   wide"}
    rows = [(i, t, "x") for i, t in texts.items()]
    cases = spark.createDataFrame(rows, "id long, rationale string, offset string")
    got = packing.pack_cases(cases, PATH, 64).collect()
    check(got, texts, 64)


def test_repeats_nulls_and_no_rows(spark):
    cases = spark.createDataFrame([(1, "same text")] * 50 + [(None, "same text")], "id long, rationale string")
    got = packing.pack_cases(cases, PATH, 64).collect()
    assert len(got) == 51 and sum(r["length"] for r in got) == 51 * len(ids_of("same text"))
    assert packing.pack_cases(spark.createDataFrame([], "id long, rationale string"), PATH).count() == 0


def test_cuts_tile_a_text():
    for n in range(1, 200):
        parts = list(packing.cuts(n, 32))
        assert [s for s, _ in parts] == [0, *[e for _, e in parts][:-1]] and parts[-1][1] == n
        assert all(e - s == 32 or e - s <= 16 for s, e in parts)


def test_knapsack_matches_enumeration():
    draw = np.random.default_rng(4)
    for _ in range(30):
        sizes = np.sort(draw.choice(np.arange(1, 13), 4, replace=False))
        values = draw.random(4)
        best, counts = packing.best_pattern(values, sizes, 12)
        every = max(sum(c * v for c, v in zip(k, values)) for k in itertools.product(range(13), repeat=4) if sum(c * s for c, s in zip(k, sizes)) <= 12)
        assert abs(best - every) < 1e-9 and abs(counts @ values - best) < 1e-9 and counts @ sizes <= 12


def test_patterns_hold_all_items_near_the_bound():
    draw = np.random.default_rng(6)
    for n in (1, 5, 300, 4000):
        sizes, demand = np.unique(draw.integers(1, 33, n), return_counts=True)
        patterns = packing.whole_patterns(sizes, demand, 64)
        assert all(p @ sizes <= 64 for p, _ in patterns)
        assert (sum(k * p for p, k in patterns) >= demand).all()
        assert sum(k for _, k in patterns) <= np.ceil(sizes @ demand / 64) * 1.02 + 2


def test_texts_without_words_of_letters(spark):
    rows = [(1, "12 34 !!"), (2, None), (3, "...")]
    got = packing.pack_cases(spark.createDataFrame(rows, "id long, rationale string").coalesce(1), P.path("word_bpe_49k.json")).collect()
    assert sorted(r["id"] for r in got) == [1, 2, 3]


def test_words_of_a_batch_are_not_listed_one_by_one():
    """Before, each distinct word of a batch became a scalar of its own on the way to the memory."""
    import pyarrow as pa

    from plumbline.llm.word_ids import WordCache

    learned = []
    cache = WordCache(lambda new: [learned.append(w) or len(w).to_bytes(4, "little") * (i % 3) for i, w in enumerate(new)], 100)
    words = pa.array(["a", "", "bb", "a", "é", "bb", "dddd"])
    source = open(WordCache.ids.__code__.co_filename).read()
    for _ in range(2):
        ids, ends = cache.ids(words, [3, 0, 4])
        assert ids.tolist() == [0, 2, 2, 2, 2, 4] and ends.tolist() == [0, 3, 3, 6]
    assert learned == ["a", "", "bb", "é", "dddd"] and ".to_pylist()" not in source.split("def ids")[1].split("def ")[0]


def test_a_worker_remembers_no_more_words_than_it_is_told():
    """Before, every worker kept up to 700,000 words, also at the end of the pipeline, and encoded 3 MB of text at once."""
    texts = [" ".join(f"w{i}x{j}" for j in range(400)) for i in range(900)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(900)), pa.array(texts)], ["id", "rationale"])
    rows = {n: [list(zip(*b.to_pydict().values())) for b in packing._cut(PATH, 2048, 1, n)(iter([batch] * 3))] for n in (1_000, 1_000_000)}
    assert rows[1_000] == rows[1_000_000] and len(rows[1_000][0]) > 900
    list(packing._cut(PATH, 2048, 1, 1_000)(iter([batch, batch.slice(0, 10)])))
    assert len(packing._tokenizers[PATH].cache.words) <= 1_000 + 4_000 and packing.BYTES_PER_STEP <= 1_000_000
