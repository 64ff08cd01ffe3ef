"""Spelling variants among the words of case narratives, found by pivotal grams."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import settle
from plumbline.llm.word_ids import release_memory

#: Letters of Latin-1, as code points.
LETTERS = "A-Za-zÀ-ÿ"
MIN_LETTERS = 7
WORDS_PER_FLUSH = 200_000
GRAM = 2
#: Positions that an edit is narrowed to.
SPAN = 2


def _count(min_letters: int, typo_every: int | None):
    run_of = re.compile(f"[{LETTERS}]{{{min_letters},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("rationale").to_pylist(), strict=True):
                if not text:
                    continue
                runs = Counter(run_of.findall(text.encode().lower().decode()))
                if typo_every is None:
                    total.update(runs)
                else:
                    for word, n in runs.items():
                        code = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
                        if code % typo_every == 0:
                            at = code % len(word)
                            word = word[:at] + word[at + 1 :]
                        total[word] += n
                if len(total) >= WORDS_PER_FLUSH:
                    yield flush()
                    total.clear()
        yield flush()
        release_memory()

    return run


def count_words(cases: DataFrame, min_letters: int = MIN_LETTERS, typo_every: int | None = None) -> DataFrame:
    """How often each word occurs in the whole rationales of all cases: word, n.

    A word is a maximal run of Latin-1 letters (with the two signs among them), A-Z lower-cased, of at least
    `min_letters`. typo_every: for experiments, the runs of one case in so many lose a letter, drawn by CRC32 of `id:run`.
    Counts are added up in the task first, so a frequent word or repeated rows cost nothing more. A null or empty rationale
    has no words, a null id counts as an empty one, very long texts are read whole. Other columns are not read. No cases: no rows.
    """
    counted = cases.select("id", "rationale").mapInArrow(_count(min_letters, typo_every), "word string, n long")
    return counted.filter(F.length("word") >= min_letters).groupBy("word").agg(F.sum("n").alias("n"))


def gram_prefix(word: str, rank: dict[str, tuple[int, str]], edits: int) -> list[tuple[int, str]]:
    """(position, gram) of the word's rarest grams: so many that `edits` edits cannot touch more than all but one disjoint choice.

    With GRAM * edits + 1 grams there are edits + 1 disjoint ones. All places of the last gram taken are taken.
    """
    grams = sorted((rank[word[i : i + GRAM]], i) for i in range(len(word) - GRAM + 1))
    last = grams[min(GRAM * edits, len(grams) - 1)][0]
    return [(i, r[1]) for r, i in grams if r <= last]


def pivots(prefix: list[tuple[int, str]], rank: dict[str, tuple[int, str]], count: int) -> list[tuple[int, str]]:
    """`count` disjoint grams of the prefix with the least total frequency, by dynamic programming over positions.

    best[k][m]: the cheapest choice of k disjoint grams among the first m by position; a gram either stays out or follows
    the best choice of one less among those that end before it.
    """
    grams = sorted(prefix)
    best: list[list[tuple[int, tuple]]] = [[(0, ())] * (len(grams) + 1)]
    none = (math.inf, ())
    for k in range(1, count + 1):
        row = [none]
        for m, (at, gram) in enumerate(grams):
            free = sum(1 for a, _ in grams[:m] if a + GRAM <= at)
            cost, chosen = best[k - 1][free]
            row.append(min(row[m], (cost + rank[gram][0], (*chosen, m))))
        best.append(row)
    return [grams[m] for m in best[count][-1][1]]


def edit_keys(word: str, grams: list[tuple[int, str]], lengths: Iterable[int]) -> set[str]:
    """What a word shares with a pivotal word of one of the lengths if it keeps one of the grams and one edit parts them.

    Up to the gram both are equal at equal positions and the edit lies behind it, or from it on they are equal and the edit
    lies before. There the pivotal word's positions are cut into spans of SPAN points; all but the span of the edit is equal
    at positions that follow from the length, and makes the key.
    """
    keys = set()
    for (at, _), whole in product(grams, lengths):
        behind, before = whole - at - GRAM, at + whole - len(word)
        for p in range(0, max(behind, 1), SPAN):
            rest = max(behind - p - SPAN, 0)
            if behind >= 0 and at + GRAM + p + rest <= len(word):
                keys.add(f"{word[: at + GRAM + p]}|{word[len(word) - rest :]}")
        for p in range(0, max(before, 1), SPAN):
            rest = max(before - p - SPAN, 0)
            if before >= 0 and p + rest <= at:
                keys.add(f"{word[:p]}|{word[at - rest :]}")
    return keys


def _keyed(rank: dict[str, tuple[int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, key, pivotal = [], [], []
            for i, word in enumerate(batch.column("word").to_pylist()):
                prefix = gram_prefix(word, rank, 1)
                size = len(word)
                for side, found in ((True, edit_keys(word, pivots(prefix, rank, 2), [size])), (False, edit_keys(word, prefix, range(size - 1, size + 2)))):
                    row += [i] * len(found)
                    key += found
                    pivotal += [side] * len(found)
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("word", "n")), pa.array(key, pa.string()), pa.array(pivotal, pa.bool_())], ["word", "n", "key", "pivotal"])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """Pairs of words one edit apart, in both directions: word, n, other, other_n.

    words: word (distinct, four letters at least), n. Grams are ordered by how many places hold them, rare ones first. Of two near words the one
    whose prefix ends earlier in that order keeps one of its two disjoint pivots in the other's prefix, since one edit touches only one
    of them. Pivots are joined to prefixes with the text that is then equal (`edit_keys`); what meets is verified. No other pair is formed.
    """
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(GRAM)))).alias("gram"))
    # at most the square of the letters
    rank = {r["gram"]: (r["count"], r["gram"]) for r in grams.groupBy("gram").count().collect()}
    keyed = words.select("word", "n").mapInArrow(_keyed(rank), "word string, n long, key string, pivotal boolean")
    keyed = settle(keyed.withColumn("key", F.xxhash64("key")))  # keys that collide are verified like all others
    other = keyed.filter("NOT pivotal").select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    met = keyed.filter("pivotal").drop("pivotal").join(other, "key")
    met = met.filter((F.abs(F.length("word") - F.length("other")) <= 1) & (F.col("word") != F.col("other")))
    met = met.filter(F.levenshtein("word", "other", 1) == 1)
    ends = F.array_sort(F.array(F.struct("word", "n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"))))
    pairs = met.select(ends.alias("ends")).select(F.col("ends")[0].alias("a"), F.col("ends")[1].alias("b")).distinct()
    sides = F.array(F.struct(F.col("a").alias("one"), F.col("b").alias("two")), F.struct(F.col("b").alias("one"), F.col("a").alias("two")))
    both = pairs.select(F.explode(sides).alias("x"))
    return both.select("x.one.word", "x.one.n", F.col("x.two.word").alias("other"), F.col("x.two.n").alias("other_n"))


def group_spellings(words: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = 2, ratio: int = 10) -> DataFrame:
    """The accepted form and the root of every word.

    words: word, n, as from `count_words`. Takes words of at least `min_letters` (four or more) code points that occur `min_count` times. Near words are one
    inserted, deleted or replaced code point apart. A word's form is its near word of the largest n, of equal ones the first in
    code-point order, if that n is at least `ratio` times its own; the root follows forms to the last. Returns word, form, root, n,
    n_near (near words), form_n.

    Forms grow by `ratio` from step to step, which bounds the doubling of root pointers. A null word or n is dropped; a word in
    several rows has the sum of their n. Words are joined by keys of few words each, never all with all. Other columns are not read. No words: no rows.
    """
    counts = words.filter(F.length("word") >= min_letters).groupBy("word").agg(F.sum("n").alias("n"))
    vocabulary = settle(counts.filter(F.col("n") >= min_count))
    by_size = F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))
    best = near_words(vocabulary).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(by_size).alias("best"))
    accepted = -F.col("best.less") >= F.col("n") * ratio
    joined = settle(
        vocabulary.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(accepted, F.col("best.form")).alias("form"), F.when(accepted, -F.col("best.less")).alias("form_n"),
        )
    )
    roots = joined.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    steps = math.log(max(ratio, joined.agg(F.max("n")).first()[0] or 1), ratio)
    for _ in range(math.ceil(math.log2(steps + 1))):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        roots = settle(roots.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")))
    out = joined.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
