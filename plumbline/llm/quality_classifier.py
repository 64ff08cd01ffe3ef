"""Regularised quadratic discriminant over statistics of case narratives."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import settle
from plumbline.llm.word_ids import release_memory

#: What is measured of a whole text, in the order of the vector.
STATISTICS = (
    "log_words", "mean_word", "long_words", "distinct_words", "distinct_pairs", "top_word", "symbols", "digits", "upper",
    "exclamations", "closers", "lines", "dup_lines", "no_letter_words", "short_words", "spaces",
)
#: Shares go in as log(share + FLOOR), which keeps rare marks from outweighing all else.
FLOOR = 0.01
#: A short text says little: its measures are mixed with those of plain prose as if so many words of it were added.
PRIOR_WORDS = 30
#: Mean word length and the shares of plain prose, in the order of STATISTICS after log_words.
PLAIN = (6.0, 0.02, 0.3, 0.05, 0.05, 0.0, 0.0, 0.03, 0.0, 0.15, 0.03, 0.0, 0.0, 0.35, 0.14)
MAX_LOGIT = 30.0


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOLS, _DIGITS = _mask("#*$%&|<>@^~=_\\{}[]+"), _mask("0123456789")
_UPPER, _LETTERS = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_SPACES = _mask(" \t\n\r\x0b\f")
_LETTERS[128:] = True  # bytes of letters beyond ASCII


def text_statistics(text: str | None) -> np.ndarray:
    """STATISTICS of one whole text; an empty or null one has a vector too."""
    data = (text or "").encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    n, size = max(len(words), 1), max(len(data), 1)
    lens = np.array([len(w) for w in words], np.int64)
    marks = max(int(counts[~_SPACES].sum()), 1)
    letters = max(int(counts[_LETTERS].sum()), 1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    top = max(Counter(words).values(), default=0)
    share = np.array(
        [
            (lens > 14).sum() / n,
            1 - len(set(words)) / n,
            1 - len(set(zip(words, words[1:], strict=False))) / max(n - 1, 1) if len(words) > 1 else 0.0,
            top / n,
            counts[_SYMBOLS].sum() / marks,
            counts[_DIGITS].sum() / marks,
            counts[_UPPER].sum() / letters,
            counts[33] / marks,
            (counts[46] + counts[44]) / n,
            len(lines) / n,
            1 - len(set(lines)) / max(len(lines), 1) if lines else 0.0,
            sum(not w.isalpha() for w in words if w.isascii() and len(w) < 3) / n,
            (lens < 4).sum() / n,
            counts[_SPACES].sum() / size,
        ]
    )
    plain = np.array(PLAIN)
    trust = len(words) / (len(words) + PRIOR_WORDS)
    mixed = trust * np.concatenate([[lens.sum() / n], share]) + (1 - trust) * plain
    return np.concatenate([[np.log1p(len(words)), np.log1p(mixed[0])], np.log(mixed[1:] + FLOOR)])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release_memory()
    for batch in batches:
        x = np.array([text_statistics(t) for t in batch.column("rationale").to_pylist()]).reshape(-1, len(STATISTICS))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), lists], ["id", "x"])


def case_vectors(cases: DataFrame) -> DataFrame:
    """id, x: the statistics of every rationale."""
    kind = cases.schema["id"].dataType.simpleString()
    return cases.select("id", "rationale").mapInArrow(_measure, f"id {kind}, x array<double>")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(STATISTICS)
    sums = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        if batch.num_rows:
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            y = batch.column("label").to_numpy()
            for c in (0, 1):
                z = x[y == c]
                sums[c] += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
    at = np.arange(sums.shape[1], dtype=np.int32)
    for c in (0, 1):
        yield pa.RecordBatch.from_pydict({"label": np.full(len(at), c, np.int32), "at": at, "value": sums[c]})


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussians with Cholesky factors of their shrunken covariances; `prior` is the log odds of label 1."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    prior: float
    only: int | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: the logistic of the difference of log densities plus the prior."""
        if self.only is not None:
            return np.full(len(x), {0: 0.0, 1: 1.0, -1: 0.5}[self.only])
        z = (x - self.centre) / self.scale
        logs = []
        for c in (0, 1):
            away = np.linalg.solve(self.factors[c], (z - self.means[c]).T)  # the factor is triangular and was formed once
            logs.append(-0.5 * (away * away).sum(axis=0) - 0.5 * self.log_dets[c])
        logit = np.clip(self.prior + logs[1] - logs[0], -MAX_LOGIT, MAX_LOGIT)
        return 1.0 / (1.0 + np.exp(-logit))


def shrinkage(cov: np.ndarray, n: float) -> float:
    """Oracle-approximating weight of the scaled identity in a covariance of n rows."""
    d = len(cov)
    square, trace = float((cov * cov).sum()), float(np.trace(cov)) ** 2
    top, low = (1 - 2 / d) * square + trace, (n + 1 - 2 / d) * (square - trace / d)
    return 1.0 if low <= 0 else min(1.0, top / low)


def fit_discriminant(labelled: DataFrame, least: float = 0.05) -> Discriminant:
    """Fit on rows (x, label 0 or 1). Executors add up count, sums and products of each class; the driver gets those.

    Each class covariance, in units of the pooled deviation, is drawn to a multiple of the identity
    by the oracle-approximating weight, by `least` at the least. With one class alone its label is
    certain; with none every score is a half.
    """
    d = len(STATISTICS)
    sums = np.zeros((2, 1 + d + d * d))
    parts = labelled.select("x", F.col("label").cast("int").alias("label")).filter("label in (0, 1)").mapInArrow(_moments, "label int, at int, value double")
    for r in parts.groupBy("label", "at").agg(F.sum("value").alias("v")).collect():  # 2 * (1 + d + d * d) rows
        sums[r["label"], r["at"]] = r["v"]
    n = sums[:, 0]
    if (n < 2).any():
        only = -1 if n.sum() == 0 or (n > 0).all() else int(n[1] > 0)
        zero = np.zeros(d)
        return Discriminant(zero, zero + 1, zero, zero, zero, 0.0, only)
    mean = sums[:, 1 : 1 + d].sum(axis=0) / n.sum()
    second = sums[:, 1 + d :].sum(axis=0).reshape(d, d) / n.sum()
    spread = np.diag(second) - mean * mean
    # a constant statistic has rounding alone for a spread, which is no unit
    scale = np.sqrt(np.where(spread > 1e-9 * (1 + np.diag(second)), spread, 1.0))
    means, factors, log_dets = [], [], []
    for c in (0, 1):
        own = sums[c, 1 : 1 + d] / n[c]
        cov = (sums[c, 1 + d :].reshape(d, d) / n[c] - np.outer(own, own)) / np.outer(scale, scale)
        weight = max(least, shrinkage(cov, n[c]))
        cov = (1 - weight) * cov + (weight * max(np.trace(cov) / d, 1e-6)) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        means.append((own - mean) / scale)
        factors.append(factor)
        log_dets.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(mean, scale, np.array(means), np.array(factors), np.array(log_dets), float(np.log(n[1] / n[0])))


def _score(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.scores(x))], ["id", "score"])

    return run


def score_cases(cases: DataFrame, labels: DataFrame) -> DataFrame:
    """id, score (0 to 1, the probability of label 1) and predicted (1 where score >= 0.5) of every case.

    cases: id, rationale; labels: id, label, the rows to learn from (each row counts once). Only the
    text enters a score. Texts are measured once, whole; labels meet the measured vectors, not the texts.

    Nulls: a null rationale is measured as an empty one; null ids are scored, not learnt from; null
    labels are none. Repeated rows are scored alike. Without labels every score is 0.5. No cases: no rows.
    """
    vectors = settle(case_vectors(cases))
    model = fit_discriminant(vectors.join(labels.select("id", "label"), "id"))
    kind = cases.schema["id"].dataType.simpleString()
    scored = vectors.mapInArrow(_score(model), f"id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _keep(model: Discriminant, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            x = np.array([text_statistics(t) for t in batch.column("rationale").to_pylist()]).reshape(-1, len(STATISTICS))
            yield batch.filter(pa.array(model.scores(x) >= threshold))

    return run


def keep_good_cases(cases: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The cases with a score of at least `threshold`, with all their columns. Learns as `score_cases`.

    Texts are measured twice, to learn and to decide, and so never leave their task.
    """
    model = fit_discriminant(case_vectors(cases).join(labels.select("id", "label"), "id"))
    return cases.mapInArrow(_keep(model, threshold), cases.schema)
