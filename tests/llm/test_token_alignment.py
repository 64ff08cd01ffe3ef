"""Alignment of two tokenizers against both libraries and plain overlaps of byte ranges."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pyarrow.parquet as pq
import pytest

from plumbline.llm import token_alignment

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [
    "", " ", "\t", " lead", "trail ", "two  spaces\n\nand lines \n", "a▁b", "▁", "<|endoftext|> <s> </s> <unk> <0x41>", "é ½ 日本語 \U0001f600 x\x00y",
    "\ta b　c d", "x\r\ny", "don't  it's 12,345.67!!", "a" * 5000, "word " * 3000, "\x1c \x85",
]


@pytest.fixture(scope="module")
def both():
    return token_alignment.TwoTokenizers(*PATHS)


def brute(texts, both):
    """Per text its ids, groups and links, from the libraries and byte ranges alone; and the counts of all links."""
    rows, counts = [], Counter()
    for text in texts:
        whole = b" " + (text or "").encode()
        a = both.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = both.b.encode(text) if text else []
        ranges = []
        for ids, sizes in ((a, both.a_bytes), (b, both.b_bytes)):
            at, out = 0, []
            for i in ids:
                out.append((at, at := at + len(sizes[i]), i))
            ranges.append(out)
        if b"".join(both.a_bytes[i] for i in a) != whole or b"".join(both.b_bytes[i] for i in b) != whole:
            ranges = [[], []]
        x, y = ranges
        cuts, groups, since = sorted({e for _, e, _ in x} & {e for _, e, _ in y}), [], 0
        inside = {e: [[], []] for e in cuts}
        for side, tokens in enumerate(ranges):
            at = 0
            for _, e, i in tokens:
                while e > cuts[at]:
                    at += 1
                inside[cuts[at]][side].append(i)
        groups = ["|".join(",".join(map(str, ids)) for ids in inside[c]) for c in cuts]
        links, j = [], 0
        for s, e, i in x:
            while y[j][1] <= s:
                j += 1
            k = j
            while k < len(y) and y[k][0] < e:
                links.append((i, y[k][2]))
                k += 1
        counts.update(links)
        rows.append((len(x), len(y), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if cuts else ""))
    return rows, counts


def texts_of_table(spark, n):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return [r["text"] for r in table.orderBy("doc_id").limit(n).collect()]


def test_rows_equal_brute_force(spark, both):
    texts = [*texts_of_table(spark, 250), *ODD, ODD[5], None]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, "no id at all", 0), (3, "an id twice", 0)]
    cases = spark.createDataFrame(rows, "id long, rationale string, n_links int").repartition(5)
    got = token_alignment.align_tokenizers(cases, *PATHS).collect()
    wanted, counts = brute([t for _, t, _ in rows], both)
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    names = ("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
    want = sorted(
        repr((i, a, b, g, len(links), sha, sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links)))
        for (i, _, _), (a, b, g, links, sha) in zip(rows, wanted, strict=True)
    )
    assert sorted(repr(tuple(r[c] for c in names)) for r in got) == want
    assert sum(r["n_a"] == 0 for r in got) < 12


def test_run_skipping_finds_every_common_end():
    draw = random.Random(4)
    for _ in range(300):
        size = draw.randint(1, 400)
        shared = {x for x in range(1, size) if draw.random() < draw.choice([0.1, 0.9])} | {size}
        a = sorted(shared | {x for x in range(1, size) if draw.random() < 0.05})
        b = sorted(shared | {x for x in range(1, size) if draw.random() < 0.05})
        i, j, n, odd_a, odd_b = token_alignment.align(a, b)
        runs = [(x + d, y + d) for x, y, k in zip(i, j, n, strict=True) for d in range(k)]
        ends = sorted(a[x] for x, _ in [*runs, *zip(odd_a, odd_b, strict=True)])
        assert ends == sorted(set(a) & set(b))
        assert all(a[x] == b[y] and (x == 0 or a[x - 1] in b) and (a[x - 1] if x else 0) == (b[y - 1] if y else 0) for x, y in runs)
    assert token_alignment.align([], []) == ([], [], [], [], [])


def test_small_memory_and_chunks_change_nothing(spark, both, monkeypatch):
    cases = spark.createDataFrame(list(enumerate(texts_of_table(spark, 60))), "id long, rationale string").repartition(2)
    whole = sorted(token_alignment.align_tokenizers(cases, *PATHS).collect())
    texts = [r["rationale"] or "" for r in cases.collect()]
    with monkeypatch.context() as m:
        m.setattr(both.cache, "limit", 10)
        m.setattr(token_alignment, "WORDS_PER_LINE", 3)
        digits = token_alignment._digits(50_257)
        parts = [row for t in texts for row in token_alignment._aligned_texts([t], both, digits)]
    assert sorted(p[4] for p in parts) == sorted(r["groups_sha256"] for r in whole)


def test_a_worker_and_a_writer_hold_little(spark, monkeypatch, tmp_path):
    both = token_alignment.TwoTokenizers(*PATHS)
    for since in range(0, 320_000, 40_000):
        both.encode([" ".join(f"{i:x}" for i in range(since, since + 40_000))])
    assert len(both.cache.words) <= 250_000

    monkeypatch.setattr(token_alignment, "ROW_GROUP_BYTES", 1 << 14)
    monkeypatch.setattr(token_alignment, "shared_folder", lambda _: str(tmp_path))
    cases = spark.createDataFrame([(i, f"some {i} words {i * i} again " * 20) for i in range(1_000)], "id long, rationale string").coalesce(1)
    token_alignment.align_tokenizers(cases, *PATHS)
    assert max(pq.ParquetFile(f).num_row_groups for f in tmp_path.glob("aligned/*.parquet")) > 1


def test_no_cases(spark):
    assert token_alignment.align_tokenizers(spark.createDataFrame([], "id string, rationale string"), *PATHS).count() == 0
