"""Byte-level BPE against the public tiktoken library, and exact round trips."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from plumbline.llm import byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tik():
    ranks = byte_bpe.read_ranks(PATH)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdeéñ漢 ٣😀'.,\n\t|<>") for _ in range(draw.randint(0, 30))) for _ in range(60)]
    long_ones = ["ab" * 3000, "".join(draw.choice("ethanor") for _ in range(9000)), "x" * 255, "é" * 300]
    return ["", " ", "\n\n", "<|endoftext|> it's 1234"] + words + long_ones


def test_matches_tiktoken_and_round_trips(spark, tik):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(900, None, "x"), (900, None, "x"), (None, "again", "x")]
    cases = spark.createDataFrame(rows, "id long, rationale string, n_tokens string").repartition(3)
    got = {r["id"]: r for r in byte_bpe.round_trip(cases, PATH, P.PATTERN).collect()}
    assert len(got) == len(rows) - 1
    for i, t, _ in rows:
        ids = tik.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_ids_and_texts_as_tables(spark, tik):
    cases = spark.createDataFrame([(1, "The lungs are clear."), (2, None), (3, "")], "id long, rationale string")
    ids = byte_bpe.encode_cases(cases, PATH, P.PATTERN)
    assert {r["id"]: r["ids"] for r in ids.collect()} == {1: tik.encode_ordinary("The lungs are clear."), 2: [], 3: []}
    back = {r["id"]: bytes(r["rationale"]) for r in byte_bpe.decode_cases(ids, PATH, P.PATTERN).collect()}
    assert back == {1: b"The lungs are clear.", 2: b"", 3: b""}


def test_empty_table(spark):
    none = spark.createDataFrame([], "id long, rationale string")
    assert byte_bpe.round_trip(none, PATH, P.PATTERN).count() == 0
