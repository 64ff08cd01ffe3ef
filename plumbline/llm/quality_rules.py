"""Quality rules whose cut-offs are certified on labelled holdouts. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.common import SPACES, settle, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Cut-offs of each statistic from the mildest to the strictest; a case fails a rule where its statistic is above.
LADDERS: dict[str, tuple[float, ...]] = {
    "symbol_rate": (0.60, 0.40, 0.30, 0.25, 0.20, 0.15, 0.10, 0.07, 0.05, 0.03, 0.02),
    "dup_line_rate": (0.80, 0.60, 0.50, 0.40, 0.30, 0.25, 0.20, 0.15, 0.10),
    "repeat_word_rate": (0.18, 0.16, 0.14, 0.12, 0.10, 0.08, 0.06, 0.04, 0.02),
    "mean_word_length": (40.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0),
}


def case_statistics(cases: DataFrame) -> DataFrame:
    """`cases` (with `rationale`) and the counts of every whole rationale, all long.

    n_lines (lines with a word), n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with
    a word, equal to an earlier line), n_repeat_words (words inside a window of
    five words that occurs twice or more in the text, the first time included).
    """
    text = F.coalesce("rationale", F.lit(""))
    out = cases.withColumn("__w", words_of(F.col("rationale")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("__lines", lines)
    out = out.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.length(F.regexp_replace(text, SPACES, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__h": F.transform("__w", lambda w: F.xxhash64(w)),
        }
    )
    starts = F.when(F.size("__h") >= WINDOW, F.sequence(F.lit(0), F.size("__h") - F.lit(WINDOW))).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("__g", F.transform(starts, lambda i: F.xxhash64(*[F.get("__h", i + F.lit(j)) for j in range(WINDOW)])))
    some = F.size(F.array_distinct("__g")) < F.size("__g")
    none = F.array().cast("array<struct<g:bigint,at:int>>")
    sorted_ = F.sort_array(F.transform("__g", lambda g, i: F.struct(g.alias("g"), i.alias("at"))))
    out = out.withColumn("__s", F.when(some, sorted_).otherwise(none))
    same = lambda x, other: F.coalesce(x["g"] == other["g"], F.lit(False))
    twice = F.filter("__s", lambda x, i: same(x, F.get("__s", i + F.lit(1))) | same(x, F.get("__s", F.nullif(i, F.lit(0)) - F.lit(1))))
    out = out.withColumn("__at", F.sort_array(F.transform(twice, lambda x: x["at"])))
    covered = F.aggregate(
        F.transform("__at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("__at", i + F.lit(1)) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    return out.withColumn("n_repeat_words", covered).drop("__w", "__lines", "__h", "__g", "__s", "__at")


def base_failed() -> Column:
    """Too few words, or more than a fifth of them repeated."""
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))


def _rates() -> dict[str, Column]:
    return {
        "symbol_rate": F.try_divide("n_symbols", "word_chars"),
        "dup_line_rate": F.try_divide("n_dup_lines", "n_lines"),
        "repeat_word_rate": F.try_divide("n_repeat_words", "n_words"),
        "mean_word_length": F.try_divide("word_chars", "n_words"),
    }


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """log P(Bin(n, p) <= k), term by term in logs: exact up to rounding, no underflow."""
    odds = float(p) / (1.0 - float(p))
    none = F.lit(float("-inf"))
    start = F.struct(none.alias("total"), (n.cast("double") * F.log1p(F.lit(-float(p)))).alias("term"))

    def step(acc: Column, i: Column) -> Column:
        top = F.greatest(acc["total"], acc["term"])
        low = F.least(acc["total"], acc["term"])
        total = top + F.log1p(F.exp(low - top))
        term = acc["term"] + F.log((n - i).cast("double") / (i + F.lit(1)).cast("double") * F.lit(odds))
        return F.struct(total.alias("total"), term.alias("term"))

    whole = F.aggregate(F.sequence(F.lit(0).cast("long"), F.least(k, n - F.lit(1)).cast("long")), start, step, lambda acc: acc["total"])
    return F.when(k >= n, F.lit(0.0)).otherwise(whole)


def certified_cutoffs(
    labelled: DataFrame,
    stratum: str = "source",
    max_false_rejection: float = 0.05,
    confidence: float = 0.95,
) -> DataFrame:
    """Per stratum and rule the strictest cut-off that is certified: rows (stratum, rule, cutoff, n_good, rejected).

    labelled: the rows of `case_statistics` with the stratum and `label` (1 = good).
    Good cases that pass the base rules are the holdout. A cut-off is certified
    where the exact binomial test refutes "it rejects more than its share of
    good cases": P(Bin(n, share) <= rejected) <= its error. The allowed rate
    is shared out over the rules, so that all rules together keep it, and the error
    1 - confidence over strata and rules (Bonferroni). Within a rule the ladder
    is tested from the mildest cut-off on and ends at the first that fails,
    which needs no further correction (fixed-sequence testing). A stratum without a
    certified cut-off gets none: nothing of it is rejected.

    All good cases count. A cut-off that rejects its share or more cannot pass, as half of the distribution
    lies at or below its mean, so the sum has fewer terms than the share of the good cases.
    """
    rates = _rates()
    good = labelled.filter((F.col("label") == 1) & ~base_failed())
    over = [
        F.count_if(rate > F.lit(cut)).alias(f"{rule}_{i}") for rule, rate in rates.items() for i, cut in enumerate(LADDERS[rule])
    ]
    counts = good.groupBy(stratum).agg(F.count(F.lit(1)).alias("n_good"), *over)
    strata = counts.withColumn("strata", F.count(F.lit(1)).over(Window.partitionBy()))  # one row per stratum
    rungs = F.array(
        *[
            F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("rung"), F.lit(cut).alias("cutoff"), F.col(f"{rule}_{i}").alias("rejected"))
            for rule in rates
            for i, cut in enumerate(LADDERS[rule])
        ]
    )
    ladder = strata.select(stratum, "n_good", "strata", F.inline(rungs))
    share = max_false_rejection / len(rates)
    error = F.log(F.lit(1.0 - confidence) / (F.col("strata") * F.lit(len(rates))))
    under = F.col("rejected") < F.lit(share) * F.col("n_good")
    passed = F.when(under, log_binomial_cdf(F.col("rejected"), F.col("n_good"), share) <= error).otherwise(F.lit(False))
    tested = ladder.withColumn("passed", passed)
    down = Window.partitionBy(stratum, "rule").orderBy("rung").rowsBetween(Window.unboundedPreceding, 0)
    reached = tested.withColumn("open", F.min(F.col("passed").cast("int")).over(down) == 1).filter("open")
    last = reached.groupBy(stratum, "rule").agg(
        F.max(F.struct("rung", "cutoff", "n_good", "rejected")).alias("best")
    )
    return last.select(stratum, "rule", "best.cutoff", "best.n_good", "best.rejected")


def apply_quality_rules(cases: DataFrame, labels: DataFrame, stratum: str = "source", **limits) -> DataFrame:
    """Counts, `base_failed` and `kept` for every case.

    cases: id, rationale and the stratum; labels: id, label (1 = good), the labelled holdout.
    Returns id, the stratum, the counts of `case_statistics`, base_failed, kept. A case is
    kept where the base rules hold and no statistic is above its stratum's certified cut-off.

    Nulls: a null rationale has no words and fails the base; a null stratum is a
    stratum of its own; a null label is no label; null ids stay, unlabelled. Empty texts fail
    the base. Repeated rows get equal results, one each. Without labels, or with
    too few, no cut-off is certified and the base rules alone decide. Other columns are not carried.
    """
    counted = settle(case_statistics(cases.select("id", "rationale", stratum)).drop("rationale"))
    holdout = counted.join(labels.select("id", "label").filter(F.col("label").isNotNull()), "id")
    cutoffs = certified_cutoffs(holdout, stratum, **limits)
    rates = _rates()
    wide = cutoffs.groupBy(F.col(stratum).alias("__stratum")).agg(
        *[F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"__{rule}") for rule in rates]
    )
    # one row per stratum; Spark broadcasts it, or not, by its measured size
    out = counted.join(wide, F.col(stratum).eqNullSafe(F.col("__stratum")), "left")
    fails = F.lit(False)
    for rule, rate in rates.items():
        fails = fails | F.coalesce(rate > F.col(f"__{rule}"), F.lit(False))
    out = out.withColumn("base_failed", base_failed())
    out = out.withColumn("kept", ~F.col("base_failed") & ~fails)
    return out.drop("__stratum", *[f"__{rule}" for rule in rates])
