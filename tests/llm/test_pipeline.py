"""The pipeline against a plain version of every stage, each on its own input."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from plumbline.llm import quality_classifier as qc, unit_dedup

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    draw = random.Random(11)
    words = {
        "en": "the lung fields are clear with no effusion seen and heart size is normal there was an opacity".split(),
        "fr": "les poumons sont clairs sans épanchement le cœur est normal avec une opacité dans la base".split(),
    }
    made = {k: [a + b for a in v for b in v] for k, v in words.items()}
    passage = " ".join(draw.choice(made["en"]) for _ in range(34)).capitalize() + "."
    rows = []
    for i in range(240):
        lang = "en" if i % 3 else "fr"
        pick = lambda: draw.choice(words[lang]) if draw.random() < 0.5 else draw.choice(made[lang])  # noqa: B023, E731
        text = "\n".join(" ".join(pick() for _ in range(draw.randint(6, 14))).capitalize() + "." for _ in range(draw.randint(3, 9)))
        if i % 6 == 0:
            text = " ".join(w + draw.choice(["$$$", "***", "&&&"]) for w in text.split())
        elif i % 20 == 1:
            text += "\n" + passage
        elif i % 20 == 7 and rows:
            text = rows[-2][1].replace(" the ", " ") if draw.random() < 0.5 else rows[-2][1]
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
    rows += [(300, None, "en", "s", None), (301, "", None, None, 0), (302, "12 34 56 78", "en", "s", 11), (303, "long " * 3000, "en", "s", 15000)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    rows = documents()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{root}/documents.parquet")
    labels = [(i, int(i % 6 != 0), 0) for i, *_ in rows if i < 240]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def read(spark, df, root, name):
    df.write.mode("overwrite").parquet(f"{root}/{name}")
    return spark.read.parquet(f"{root}/{name}")


def plain_components(docs, size=5, percent=80):
    sets = {}
    for r in docs:
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return sorted(i for i in sets if root(i) == i)


def test_stages_against_plain_versions(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    good = read(spark, cp.good_quality(spark, docs, folder), tmp_path, "0")
    model = qc.fit_discriminant(
        qc.case_vectors(cp.as_cases(docs)).join(cp.quality_labels(spark, folder), "id")
    )
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    said = model.scores(np.array([qc.text_statistics(t) for _, t in texts]))
    assert ids(good) == sorted(i for (i, _), s in zip(texts, said, strict=True) if s >= 0.5)
    assert np.mean([(i in set(ids(good))) == (i % 6 != 0) for i in range(240)]) > 0.95

    known = read(spark, cp.known_language(spark, good, folder), tmp_path, "1")
    gone = set(ids(good)) - set(ids(known))
    assert {i for i in (300, 301, 302) if i in ids(good)} <= gone and len(gone) < 8

    single = read(spark, cp.no_near_duplicates(spark, known, folder), tmp_path, "2")
    assert ids(single) == plain_components(known.collect()) and single.count() < known.count()

    freed = read(spark, cp.no_repeated_passages(spark, single, folder), tmp_path, "3")
    assert good.columns == known.columns == single.columns == freed.columns == names
    seen, expected = set(), {}
    for r in sorted(single.collect(), key=lambda r: r["doc_id"]):
        text, gone = r["text"], set()
        for at, to, unit in unit_dedup.passage_units(text, unit_dedup.MIN_WORDS):
            if unit in seen:
                gone |= set(range(at, to + 1))
        seen |= {unit for _, _, unit in unit_dedup.passage_units(text, unit_dedup.MIN_WORDS)}
        expected[r["doc_id"]] = "".join(c for i, c in enumerate(text) if i not in gone)
    got = {r["doc_id"]: r["text"] for r in freed.collect()}
    assert got == expected and any(got[r["doc_id"]] != r["text"] for r in single.collect()) and all(r["n_chars"] == len(r["text"]) for r in freed.collect())

    tokens = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = cp.packed(spark, freed, folder).collect()
    for i, text in got.items():
        whole = [*tokens.encode(text, add_special_tokens=False).ids, 1]
        parts = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        assert sum(p["length"] for p in parts) == len(whole)
        assert all(p["ids_crc32"] == zlib.crc32(np.array(whole[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) for p in parts)


def test_run_is_the_stages_in_turn(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for n, (_, stage) in enumerate(cp.STAGES):
        docs = read(spark, stage(spark, docs, folder), tmp_path, str(n))
    assert sorted(map(tuple, cp.run(spark, folder).collect())) == sorted(map(tuple, docs.collect()))


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_and_shared_ids(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = ("id", "rationale", "removed", "__id", "__row", "carried", "label", "score", "class", "kept_id", "span_id", "CELL")
    wide = docs.select("*", *(F.lit(n).alias(c) for n, c in enumerate(more))).repartition(3)
    odd = [(None, "no id but words " * 9, "en", None, 1), (None, None, None, None, None), (7, "some other text of document seven " * 4, "en", "s", 1)]
    wide = wide.unionByName(spark.createDataFrame(odd, COLUMNS), allowMissingColumns=True)
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, wide, folder)
        assert out.columns == wide.columns
        rows = out.collect()
        assert 0 < len(rows) <= wide.count()
        assert {r["CELL"] for r in rows if r["doc_id"] is not None} == {None, len(more) - 1}
    assert cp.STAGES[-1][1](spark, wide, folder).count() >= wide.count()


def test_near_duplicates_keep_unrelated_rows(spark, folder):
    draw = random.Random(2)
    one, two = (" ".join(draw.choice("abcdefghij") * 2 for _ in range(60)) for _ in range(2))
    rows = [(5, one), (5, two), (6, one), (None, one), (None, "a b c d e f"), (None, "a b c d e f"), (5, two), (8, None), (8, None), (9, " \t")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], COLUMNS)
    kept = cp.no_near_duplicates(spark, docs, folder).collect()
    want = [(5, one), (5, two), (None, "a b c d e f"), (8, None), (8, None), (9, " \t")]
    assert sorted(repr((r["doc_id"], r["text"])) for r in kept) == sorted(map(repr, want))
