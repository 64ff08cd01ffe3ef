"""Language of case narratives: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.word_ids import release_memory

#: N-grams of one to three characters are hashed to so many features.
FEATURES = 1 << 13
ORDERS = (1, 2, 3)
UNKNOWN = "und"
MAX_LANGUAGES = 256
#: Labelled cases that a fit takes of a language, drawn by hash of id; a language with fewer gives all.
MAX_PER_LANGUAGE = 1_500
MAX_SAMPLE = 20_000
EPOCHS = 3
ALPHA, BETA = 0.3, 1.0
L1, L2 = 0.02, 0.02

#: Of the characters of the basic plane, the letters; all others but those beyond the plane count as a space.
_IS_LETTER = np.array([chr(i).isalpha() for i in range(0x10000)])


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, runs of anything else as one space, with a space at both ends."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_IS_LETTER[np.minimum(codes, 0xFFFF)] | (codes > 0xFFFF), codes, 32)
    gap = codes == 32
    return codes[~(gap & np.concatenate([[False], gap[:-1]]))].astype(np.uint64)


def grams(text: str | None) -> np.ndarray:
    """Counts of the hashed character n-grams of a whole text."""
    codes, out = letters(text or ""), np.zeros(FEATURES, np.int64)
    h = np.zeros(len(codes), np.uint64)
    for n in ORDERS:
        if len(codes) < n:
            break
        h = (h[: len(codes) - n + 1] + codes[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        out += np.bincount(((h >> np.uint64(40)) % np.uint64(FEATURES)).astype(np.int64), minlength=FEATURES)
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def weighted(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF of one text, of length one: features and values."""
    at = np.flatnonzero(counts)
    values = np.log1p(counts[at]) * idf[at]
    norm = np.sqrt(values @ values)
    return at, values / norm if norm > 0 else values


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release_memory()
    met, rows = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for text in batch.column("rationale").to_pylist():
            met += grams(text) > 0
            rows += 1
    yield pa.RecordBatch.from_pydict({"at": np.arange(FEATURES + 1, dtype=np.int32), "n": np.concatenate([met, [rows]])})


def inverse_document_frequency(cases: DataFrame) -> np.ndarray:
    """Smoothed log inverse document frequency of each feature, over all of `cases`."""
    parts = cases.select("rationale").mapInArrow(_document_counts, "at int, n long")
    out = np.zeros(FEATURES + 1)
    for r in parts.groupBy("at").agg(F.sum("n").alias("n")).collect():  # FEATURES + 1 rows
        out[r["at"]] = r["n"]
    return np.log((1 + out[-1]) / (1 + out[:-1])) + 1


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow the regularised leader (proximal, per coordinate) with elastic net, for a softmax."""

    def __init__(self, classes: int) -> None:
        self.z, self.n = np.zeros((classes, FEATURES + 1)), np.zeros((classes, FEATURES + 1))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = softmax(w @ values)
        error[label] -= 1
        g = error[:, None] * values
        n = self.n[:, at]
        self.z[:, at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[:, at] = n + g * g


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least cross entropy, by golden-section search on its logarithm.

    A label counts as (n + 1) / (n + 2) of n rows, so that a faultless sample does not make every answer certain.
    """
    n, k = logits.shape
    if n == 0 or k < 2:
        return 1.0
    target = np.full((n, k), 1 / (n + 2) / (k - 1))
    target[np.arange(n), labels] = (n + 1) / (n + 2)

    def loss(t: float) -> float:
        return -float((target * np.log(np.maximum(softmax(logits / np.exp(t)), 1e-300))).sum(axis=1).mean())

    lo, hi, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(50):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _fit(languages: list[str], idf: np.ndarray):
    number = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        rows = []
        for batch in batches:
            for draw, lang, text in zip(*(batch.column(c).to_pylist() for c in ("draw", "lang", "rationale")), strict=True):
                at, values = weighted(grams(text), idf)
                rows.append((draw, number[lang], np.append(at, FEATURES).astype(np.int16), np.append(values, 1.0).astype(np.float32)))
        rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
        held, train = rows[::5], [r for i, r in enumerate(rows) if i % 5]
        model = Ftrl(len(languages))
        for epoch in range(EPOCHS):
            # another order in each epoch, the same in every run
            for i in np.random.default_rng(epoch).permutation(len(train)):
                _, label, at, values = train[i]
                model.learn(at, values.astype(np.float64), label)
        w = model.weights()
        logits = np.array([w[:, at] @ values for _, _, at, values in held]).reshape(-1, len(languages))
        t = best_temperature(logits, np.array([r[1] for r in held], np.int64))
        for c in range(len(languages)):
            at = np.flatnonzero(w[c]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"class": np.full(len(at) + 1, c, np.int32), "at": np.append(at, np.int32(-1)), "value": np.append(w[c, at], t)})

    return run


@dataclass(frozen=True)
class Identifier:
    languages: list[str]
    weights: np.ndarray
    temperature: float
    idf: np.ndarray

    def say(self, text: str | None) -> tuple[str, float]:
        """The likeliest language of a whole text and its probability."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        at, values = weighted(grams(text), self.idf)
        p = softmax((self.weights[:, at] @ values + self.weights[:, FEATURES]) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def fit_identifier(labelled: DataFrame, idf: np.ndarray) -> Identifier:
    """Fit on rows (id, rationale, lang), lang not null.

    At most MAX_PER_LANGUAGE rows of a language and about MAX_SAMPLE in all are taken, drawn by
    hash of id, so one task holds the sample. A fifth of it sets the temperature. Weights at
    zero, most of them under the elastic net, are not sent back.
    """
    rows = labelled.filter(F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(counts)
    weights, temperature = np.zeros((len(languages), FEATURES + 1)), 1.0
    if languages:
        spark = labelled.sparkSession
        take = min(MAX_PER_LANGUAGE, MAX_SAMPLE // len(languages))
        shares = spark.createDataFrame([(x, min(1.0, take / counts[x])) for x in languages], "lang string, share double")
        draw = F.xxhash64(F.lit("language"), "id", "rationale")
        unit = F.pmod(draw, F.lit(1 << 30)) / F.lit(float(1 << 30))
        sample = rows.select(draw.alias("draw"), unit.alias("unit"), "lang", "rationale").join(F.broadcast(shares), "lang")  # MAX_LANGUAGES rows
        sample = sample.filter("unit < share").select("draw", "lang", "rationale").repartition(1)
        for r in sample.mapInArrow(_fit(languages, idf), "class int, at int, value double").collect():
            if r["at"] < 0:
                temperature = r["value"]
            else:
                weights[r["class"], r["at"]] = r["value"]
    return Identifier(languages, weights, temperature, idf)


def learned_identifier(labelled: DataFrame) -> Identifier:
    """Document frequencies and fit of the labelled rows alone; rows without a language teach nothing."""
    known = labelled.select("id", "rationale", "lang").filter(F.col("lang").isNotNull())
    return fit_identifier(known, inverse_document_frequency(known))


def _predict(model: Identifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            said, score = zip(*map(model.say, batch.column("rationale").to_pylist()), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(said, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    return run


def identify_language(cases: DataFrame, labelled: DataFrame) -> DataFrame:
    """id, lang_pred and score (0 to 1, calibrated) of every case.

    cases: id, rationale; labelled: id, rationale, lang, the rows to learn from. Only the whole
    text enters a prediction; inverse document frequencies count the labelled rows that have a language. The reference project
    keeps no language of a narrative, so `lang` is the caller's.

    A null text or one without a letter is `und` with score 0, and so is everything where
    no language is known. Null ids and repeated rows stay, one row each; ties go to the
    first language in order; other columns are not carried; no cases, no rows.
    """
    model = learned_identifier(labelled)
    kind = cases.schema["id"].dataType.simpleString()
    return cases.select("id", "rationale").mapInArrow(_predict(model), f"id {kind}, lang_pred string, score double")


def _keep(model: Identifier, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            said = [model.say(t) for t in batch.column("rationale").to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in said], pa.bool_()))

    return run


def keep_known_languages(cases: DataFrame, labelled: DataFrame, least: float = 0.5) -> DataFrame:
    """The cases whose language is told with a score of at least `least`, with all their columns.

    Learns as `identify_language`. Null texts and texts without a letter go; null ids and repeated rows are judged one by one, very long texts
    whole; other columns may have any name. No cases: no rows.
    """
    model = learned_identifier(labelled)
    return cases.mapInArrow(_keep(model, least), cases.schema)
