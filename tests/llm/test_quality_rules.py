"""Counts against a plain loop, cut-offs against exact binomial sums, and no Python in the plan."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from plumbline.llm import quality_rules as qr


def counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def texts():
    draw = random.Random(4)
    out = [None, "", " \n\t ", "one", "a b c d e a b c d e", "x " * 40, "é😀 # $\x1c&\xa0|", "same line\nsame line\n\n \nsame line ", "w " * 5000]
    for _ in range(60):
        out.append(draw.choice(["\n", " ", "  "]).join(draw.choice(["a", "b", "c#", "dd", "é"]) for _ in range(draw.randint(0, 60))))
    return out


def test_counts(spark):
    rows = [(i, t, 1) for i, t in enumerate(texts())]
    got = qr.case_statistics(spark.createDataFrame(rows, "id long, rationale string, n_words int").drop("n_words")).collect()
    for r in got:
        expected = counts(rows[r["id"]][1])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected


def cdf(k, n, p):
    return math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(min(k, n) + 1))


def test_exact_binomial_sums(spark):
    rows = [(k, n) for n in (1, 5, 60, 400) for k in (0, 1, 3, n // 2, n - 1, n) if k <= n]
    out = spark.createDataFrame(rows, "k long, n long").withColumn("c", qr.log_binomial_cdf(F.col("k"), F.col("n"), 0.05))
    for r in out.collect():
        assert math.isclose(math.exp(r["c"]), cdf(r["k"], r["n"], 0.05), rel_tol=1e-9)


def statistics(spark, rows):
    names = "id long, source string, label int, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
    return spark.createDataFrame(rows, names)


def test_cutoffs_are_the_strictest_that_pass(spark):
    draw, rows = random.Random(5), []
    for i in range(4000):
        source, label = ["a", "b", None][i % 3], int(draw.random() < 0.8)
        symbols = draw.choice([0, 0, 0, 1, 4]) if label else draw.choice([20, 40])
        rows.append((i, source, label, 50, 200 if i % 3 else 300, symbols, 10, draw.choice([0, 0, 1]), draw.choice([0, 2, 6])))
    rows.append((5000, "few", 1, 50, 200, 0, 10, 0, 0))
    share, error = 0.05 / len(qr.LADDERS), math.log(0.05 / (4 * len(qr.LADDERS)))
    got = {(r["source"], r["rule"]): (r["cutoff"], r["n_good"], r["rejected"]) for r in qr.certified_cutoffs(statistics(spark, rows), max_false_rejection=0.05).collect()}
    rate = {
        "symbol_rate": lambda r: r[5] / r[4], "dup_line_rate": lambda r: r[7] / r[6],
        "repeat_word_rate": lambda r: r[8] / r[3], "mean_word_length": lambda r: r[4] / r[3],
    }
    for source in ("a", "b", None, "few"):
        good = [r for r in rows if r[1] == source and r[2] == 1]
        for rule, ladder in qr.LADDERS.items():
            best = None
            for cut in ladder:
                rejected = sum(rate[rule](r) > cut for r in good)
                if math.log(max(cdf(rejected, len(good), share), 1e-300)) > error:
                    break
                best = (cut, len(good), rejected)
            assert got.get((source, rule)) == best
    assert ("few", "symbol_rate") not in got and len(got) >= 9


def test_four_strata_of_500_good_cases_are_certified(spark):
    rows = [(i, "abcd"[i % 4], 1, 50, 200, 0, 10, 0, 0) for i in range(2000)]
    got = {(r["source"], r["rule"]): r["cutoff"] for r in qr.certified_cutoffs(statistics(spark, rows)).collect()}
    assert got == {(source, rule): ladder[-1] for source in "abcd" for rule, ladder in qr.LADDERS.items()}


def test_large_strata_are_counted_whole(spark):
    rows = spark.range(250_000).selectExpr(
        "if(id % 1000 = 0, null, id) id", "'a' source", "1 label", "50L n_words", "200L word_chars",
        "if(id % 500 = 0, 40L, 0L) n_symbols", "10L n_lines", "0L n_dup_lines", "0L n_repeat_words",
    )
    got = {r["rule"]: (r["cutoff"], r["n_good"], r["rejected"]) for r in qr.certified_cutoffs(rows).collect()}
    assert got["symbol_rate"] == (0.02, 250_000, 500) and got["dup_line_rate"] == (0.10, 250_000, 0)


def test_verdicts_nulls_and_no_labels(spark):
    good = "the lung fields are clear and the heart size is normal on this film today"
    rows = [(i, good if i % 4 else " ".join(w + "$$$$" for w in good.split()), "a") for i in range(1200)] + [(None, None, None), (2000, "", None), (2000, "", None)]
    cases = spark.createDataFrame([(*r, True) for r in rows], "id long, rationale string, source string, kept boolean")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(1200)] + [(None, 1), (3, None)], "id long, label int")
    got = qr.apply_quality_rules(cases, labels).collect()
    assert len(got) == len(rows)
    assert {r["kept"] for r in got if r["id"] is not None and r["id"] < 1200 and r["id"] % 4} == {True}
    assert {r["kept"] for r in got if r["id"] is not None and r["id"] < 1200 and r["id"] % 4 == 0} == {False}
    assert all(r["base_failed"] and not r["kept"] for r in got if r["id"] in (None, 2000))
    free = qr.apply_quality_rules(cases, labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in free)
    assert qr.apply_quality_rules(cases.limit(0), labels).count() == 0
    plan = qr.apply_quality_rules(cases, labels)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
