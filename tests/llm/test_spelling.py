"""Spelling variants against comparison of all pairs."""

import random
import re
import zlib
from collections import Counter

from plumbline.llm import spelling
from plumbline.llm.queries import QUERIES


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def neighbours(vocabulary):
    """Near words through deletion neighbourhoods: another way to all pairs one edit apart."""
    at = {}
    for w in vocabulary:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            at.setdefault(key, []).append(w)
    near = {w: set() for w in vocabulary}
    for some in at.values():
        for a in some:
            near[a] |= {b for b in some if one_edit(a, b)}
    return near


def grouped(counts, min_letters=7, min_count=2, ratio=10):
    n = {w: c for w, c in counts.items() if len(w) >= min_letters and c >= min_count}
    near = neighbours(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=repr)


def counted(docs):
    total = Counter()
    for i, text in docs:
        for run in re.findall("[a-zÀ-ÿ]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return total


def test_all_pairs_of_drawn_words(spark):
    draw = random.Random(9)
    for letters, size in (("ab", 300), ("abcdÀé", 600)):
        words = {"".join(draw.choice(letters) for _ in range(draw.randint(4, 9))) for _ in range(size)}
        counts = {w: draw.choice([1, 2, 3, 30, 300, 4000, 50_000]) for w in words}
        rows = [(w, c, 1) for w, c in counts.items()] + [(None, 3, 1), ("nothing", None, 1)]
        got = spelling.group_spellings(spark.createDataFrame(rows, "word string, n long, key int").repartition(3), 4).collect()
        assert sorted(map(tuple, got), key=repr) == grouped(counts, 4)
        assert any(r["form"] is not None and r["root"] != r["form"] for r in got)


def test_pivots_are_the_cheapest_disjoint_pair():
    draw = random.Random(10)
    for _ in range(300):
        word = "".join(draw.choice("abc") for _ in range(draw.randint(4, 10)))
        rank = {x + y: (draw.randint(1, 5), x + y) for x in "abc" for y in "abc"}
        prefix = spelling.gram_prefix(word, rank, 1)
        chosen = spelling.pivots(prefix, rank, 2)
        pairs = [rank[g][0] + rank[h][0] for i, g in prefix for j, h in prefix if j >= i + 2]
        assert len(prefix) >= 3 and chosen[1][0] >= chosen[0][0] + 2 and set(chosen) <= set(prefix)
        assert sum(rank[g][0] for _, g in chosen) == min(pairs)


def test_words_of_odd_cases(spark):
    rows = [(1, "Pleural PLEURAL pleural×÷ xpleural effusion"), (1, "Pleural PLEURAL pleural×÷ xpleural effusion"), (None, "Opacities ÀÉopacity"), (2, None), (3, ""), (4, "consolidation " * 5000)]
    cases = spark.createDataFrame([(i, t, 7) for i, t in rows], "id long, rationale string, word int").repartition(3)
    got = {r["word"]: r["n"] for r in spelling.count_words(cases, typo_every=31).collect()}
    assert got == {w: n for w, n in counted(rows).items() if len(w) >= 7}
    assert {r["word"]: r["n"] for r in spelling.count_words(cases).collect()}["consolidation"] == 5000


def test_no_cases(spark):
    words = spelling.count_words(spark.createDataFrame([], "id long, rationale string"))
    assert spelling.group_spellings(words).count() == 0


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_spelling_variants"](spark, sf_dir).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=repr) == grouped(counted(docs))
