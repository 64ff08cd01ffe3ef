"""Linear probes.

A probe is a standard scaler + L2 logistic regression. Gradients are aggregated on
the executors; the driver only holds coefficients. A single probe is MLlib's; probes
per source and fold are fitted together by `multifit`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from plumbline.operators import audits as A
from plumbline.operators import calibrate as C
from plumbline.operators import metrics as M
from plumbline.operators import multifit as MF
from plumbline.operators import resample as B
from plumbline.operators import splits as S
from plumbline.functions.maths import tempered
from plumbline.functions.skew import skew_attach
from plumbline.session import settle

ROWS_PER_PARTITION = 20_000
PARALLEL_FITS = 8


def as_features(df: DataFrame, vector: str = "v") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))


class Probe:
    """Fitted scaler and classifier."""

    def __init__(self, scaler, model, keep: Sequence[int] | None):
        self.scaler, self.model, self.keep = scaler, model, keep

    def coefficients(self) -> list[float]:
        return [float(x) for x in self.model.coefficients]

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Add the decision value of the positive class."""
        ready = self.scaler.transform(_sliced(df, self.keep))
        out = self.model.transform(ready)
        return out.withColumn(name, vector_to_array("rawPrediction")[1]).drop(
            "__in", "__scaled", "rawPrediction", "probability", "prediction"
        )

    def predict(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        out = self.model.transform(self.scaler.transform(_sliced(df, self.keep)))
        return out.withColumn(name, F.col("prediction").cast("int")).drop(
            "__in", "__scaled", "rawPrediction", "probability", "prediction"
        )


def _sliced(df: DataFrame, keep: Sequence[int] | None) -> DataFrame:
    if keep is None:
        return df.withColumn("__in", F.col("features"))
    return VectorSlicer(inputCol="features", outputCol="__in", indices=list(keep)).transform(df)


def linear_probe(
    train: DataFrame, label: str = "label", c: float = 1.0, balanced: bool = False, keep: Sequence[int] | None = None,
    multiclass: bool = False, max_iter: int = 100,
) -> Probe:
    """Fit on `features`. regParam = (n - 1) / (C n^2) matches a C-weighted loss over
    features scaled by the population deviation; balanced weights are n / (k n_c).
    """
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("__m"))
    n, k = counts.agg(F.coalesce(F.sum("__m"), F.lit(0)), F.count(F.lit(1))).first()
    if k < 2:
        raise ValueError("a probe needs two classes")
    ready = _sliced(train, keep).withColumn("__y", F.col(label).cast("double"))
    if balanced:
        ready = ready.join(counts, label).withColumn("__w", F.lit(n / k) / F.col("__m")).drop("__m")
    else:
        ready = ready.withColumn("__w", F.lit(1.0))
    # Every solver step is one job over the partitions: size them by rows, not by the cluster.
    ready = ready.coalesce(math.ceil(n / ROWS_PER_PARTITION))
    scaler = StandardScaler(inputCol="__in", outputCol="__scaled", withMean=True, withStd=True).fit(ready)
    model = LogisticRegression(
        featuresCol="__scaled", labelCol="__y", weightCol="__w", regParam=(n - 1) / (c * n * n), elasticNetParam=0.0,
        standardization=False, maxIter=max_iter, tol=1e-4, family="multinomial" if multiclass else "binomial",
    ).fit(scaler.transform(ready))
    return Probe(scaler, model, keep)


def source_codes(df: DataFrame, source: str = "source", name: str = "__code") -> tuple[DataFrame, list]:
    """Number the distinct values of `source` from 0 in sorted order (NULL first); also the list of them.

    The list holds one value a source, less than the coefficients that a fit a source keeps.
    """
    names = [r[0] for r in df.select(source).distinct().orderBy(source).toLocalIterator()]
    table = df.sparkSession.createDataFrame(list(enumerate(names)), df.select(F.lit(0).alias(name), F.col(source).alias("__named")).schema)
    return df.join(table, F.col(source).eqNullSafe(F.col("__named")), "left").drop("__named"), names


def group_bars(df: DataFrame, group: str, ident: str, code: str = "__code") -> DataFrame:
    """Add `__others`: the codes of all sources in which the row's group (>= 0) has members."""
    known = df.filter(F.col(group) >= 0).groupBy(group).agg(F.collect_set(code).alias("__others"), F.count(F.lit(1)).alias("__rows"))
    return skew_attach(df, known, group, [ident], "__rows", "left")


def _each(spark, fn, items: Sequence) -> list:
    """fn over independent fits from a few driver threads, the way cross-validation runs them."""
    with ThreadPool(min(PARALLEL_FITS, max(1, len(items)))) as pool:
        return pool.map(inheritable_thread_target(spark)(fn), items)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def probe_lodo(df: DataFrame, source: str = "source", label: str = "label", balanced: bool = True, group: str = "grp", vector: str = "v") -> DataFrame:
    """AUC per left-out source (single-class sources skipped), with its rows and groups; all folds are fitted together."""
    coded, _ = source_codes(df, source)
    rows = MF.task_rows(coded, vector, [label], bars=F.array("__code"))
    two = S.two_class_sources(coded, "__code", label)
    tasks = MF.Tasks.of([(-1, r[0], 0, 0) for r in two.orderBy("__code").toLocalIterator()])
    scored = settle(MF.fit_many(rows, tasks, balanced=balanced).score(rows, [source, group, label]))
    sizes = scored.groupBy(source).agg(F.count_distinct(group).alias("n_groups"))
    return M.auc(scored, [source], "score", label).withColumn("n", F.col("n_pos") + F.col("n_neg")).join(sizes, source)


def lodo_means(folds: DataFrame) -> DataFrame:
    """Macro mean, row-weighted and group-weighted mean AUC."""
    def weighted(w: str):
        return F.sum(F.col("auc") * F.col(w)) / F.sum(w)

    return folds.agg(F.avg("auc").alias("macro"), weighted("n").alias("by_rows"), weighted("n_groups").alias("by_groups"))


def probe_within_source(
    df: DataFrame, source: str = "source", label: str = "label", k: int = 5, floor: int = 10, group: str = "grp", vector: str = "v"
) -> DataFrame:
    """Mean grouped k-fold AUC inside each source; NULL under `floor` rows of a class.

    Folds of all sources are dealt in one pass and fitted together, a task a source and fold.
    """
    sizes = df.groupBy(source).agg(
        F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg")
    )
    coded, names = source_codes(df, source)
    per_code = coded.groupBy("__code").agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    big = [r[0] for r in per_code.filter((F.col("p") >= floor) & (F.col("q") >= floor)).select("__code").orderBy("__code").toLocalIterator()]
    if not big:
        return sizes.withColumn("auc", F.lit(None).cast("double"))
    keyed = coded.withColumn("__g", F.concat_ws("|", "__code", group))
    folded = S.stratified_group_kfold(keyed, k, label, "__g", within=["__code"])
    rows = MF.task_rows(folded, vector, [label], scope=F.col("__code"), bars=F.array("fold"))
    fits = MF.fit_many(rows, MF.Tasks.of([(s, f, 0, 0) for s in big for f in range(k)]))
    scored = settle(fits.score(rows, [source, "fold", label]))
    folds = M.auc(scored, [source, "fold"], "score", label).filter("auc IS NOT NULL")
    means = folds.groupBy(F.col(source).alias("__s")).agg(F.avg("auc").alias("auc"))
    return sizes.join(means, F.col(source).eqNullSafe(F.col("__s")), "left").drop("__s")


def probe_cross_site(train: DataFrame, unseen: DataFrame, label: str = "label", balanced: bool = False) -> DataFrame:
    """Fit on every known source, judge on the unseen site."""
    scored = linear_probe(train, label, balanced=balanced).score(unseen).select(label, "score")
    return M.auc(scored, [], "score", label)


def site_prediction(df: DataFrame, source: str = "source", k: int = 5, group: str = "grp") -> DataFrame:
    """Grouped CV accuracy of predicting the source, against the majority share, and balanced accuracy against 1/k."""
    coded, names = source_codes(df, source, "__site")
    # Deal groups to folds by draw; the label stratum is the site parity.
    folded = S.stratified_group_kfold(coded.withColumn("__two", F.col("__site") % 2), k, "__two", group).persist()

    held = [r[0] for r in folded.select("fold").distinct().orderBy("fold").collect()]

    def fold(f) -> DataFrame:
        probe = linear_probe(folded.filter(F.col("fold") != f), "__site", balanced=True, multiclass=True)
        return probe.predict(folded.filter(F.col("fold") == f)).select("fold", "__site", "predicted")

    hits = _union(_each(df.sparkSession, fold, held)).withColumn("hit", (F.col("__site") == F.col("predicted")).cast("double"))
    acc = hits.groupBy("fold").agg(F.avg("hit").alias("a")).agg(
        F.avg("a").alias("cv_accuracy"), F.stddev_pop("a").alias("cv_std"), F.count(F.lit(1)).alias("n_folds")
    )
    recall = hits.groupBy("__site").agg(F.avg("hit").alias("r")).agg(F.avg("r").alias("balanced_accuracy"))
    share = df.groupBy(source).agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") / F.sum("n")).alias("majority_chance"))
    return acc.join(recall).join(share).withColumn("uniform_chance", F.lit(1.0 / len(names)))


def site_vs_rest(df: DataFrame, site: str, source: str = "source", group: str = "grp") -> DataFrame:
    """AUC of telling one site from the rest on held-out groups (half for fitting)."""
    halves = S.grouped_half_split(df.withColumn("__is", (F.col(source) == site).cast("int")), group).persist()
    probe = linear_probe(halves.filter("half = 'a'"), "__is")
    return M.auc(probe.score(halves.filter("half = 'b'")).select("__is", "score"), [], "score", "__is")


def fit_population_sensitivity(full: DataFrame, part: DataFrame, unseen: DataFrame, label: str = "label") -> DataFrame:
    """The same probe fitted on a slice and on the whole corpus."""
    out = []
    for name, train in (("slice", part), ("full", full)):
        out.append(probe_cross_site(train, unseen, label).withColumn("fitted_on", F.lit(name)))
    return _union(out)


def channel_ablation(train: DataFrame, unseen: DataFrame, label: str = "label", drops: Sequence[int] = (0, 1, 5, 10, 20)) -> DataFrame:
    """AUC after dropping the channels of largest |coefficient|, refitted, with the retained fraction."""
    base = linear_probe(train, label)
    order = sorted(range(len(base.coefficients())), key=lambda i: (-abs(base.coefficients()[i]), i))

    def drop(d: int) -> DataFrame:
        keep = sorted(set(range(len(order))) - set(order[:d]))
        probe = base if d == 0 else linear_probe(train, label, keep=keep)
        one = M.auc(probe.score(unseen).select(label, "score"), [], "score", label)
        return one.select(F.lit(d).alias("dropped"), F.lit(len(keep)).alias("n_channels"), "auc")

    curve = _union(_each(train.sparkSession, drop, list(drops)))
    first = curve.filter("dropped = 0").select("auc")
    return curve.withColumn("retained", F.col("auc") / first.scalar())


def permuted_labels(df: DataFrame, n_perms: int, label: str = "label", by: str = "id") -> DataFrame:
    """(by, __y0, __y1, ...): the greatest label of every value of `by`, dealt anew n_perms times."""
    keys = df.groupBy(by).agg(F.max(label).alias(label), F.count(F.lit(1)).alias("__rows"))
    for k in range(n_perms):
        keys = S.permute_labels(keys, k, label, by).withColumnRenamed("permuted", f"__y{k}")
    return keys.drop(label)


def permutation_refit(
    df: DataFrame, n_perms: int = 3, by: str = "id", source: str = "source", label: str = "label", group: str = "grp",
    ident: str = "id", vector: str = "v", guard: bool = True,
) -> DataFrame:
    """Leave-one-source-out AUC of probes refitted on permuted labels: (perm, auc, n_folds), auc the mean over the folds.

    Labels are dealt among the values of `by`; with `by` a group, its rows keep one label in common, and a probe that recognises
    a group in another source shows as an AUC far from a half. `guard` keeps the groups (>= 0) of the held-out source out of
    training. All permutations and folds are fitted together. Folds in which a permutation left one class have no AUC.
    """
    coded, names = source_codes(df, source)
    bars = F.array("__code")
    if guard:
        coded = group_bars(coded, group, ident)
        bars = F.array_distinct(F.concat(bars, F.coalesce("__others", F.array().cast("array<int>"))))
    labels = [f"__y{k}" for k in range(n_perms)]
    drawn = settle(permuted_labels(df, n_perms, label, by))
    rows = MF.task_rows(skew_attach(coded, drawn, by, [ident], "__rows"), vector, labels, bars=bars)
    fits = MF.fit_many(rows, MF.Tasks.of([(-1, s, 0, k) for k in range(n_perms) for s in range(len(names))]))
    scored = settle(fits.score(rows, ["__code", *labels])).withColumn("__y", F.element_at(F.array(*labels), F.col("variant") + 1))
    folds = M.auc(scored, ["variant", "__code"], "score", "__y")
    return folds.groupBy(F.col("variant").alias("perm")).agg(F.avg("auc").alias("auc"), F.count("auc").alias("n_folds"))


def permutation_check(df: DataFrame, n_perms: int = 3, cut: float = 0.60, **options) -> DataFrame:
    """Verdict over `permutation_refit`: FAIL where the mean AUC of refitted permutations reaches the cut."""
    return B.permutation_verdict(permutation_refit(df, n_perms, **options), cut=cut)


def dose_refit(
    corpus: DataFrame, pool: DataFrame, test: DataFrame, doses: Sequence[int | None] = (50, 100, None), source: str = "source",
    label: str = "label", ident: str = "id", vector: str = "v", seed: int = 7, target: float = 0.95,
) -> DataFrame:
    """Training on `corpus` and growing prefixes of a new site's `pool`, judged on the site's fixed `test` rows.

    Per dose ('0' is none, 'ALL' the pool; `ident` is unique in the pool): every source of the corpus is left out once, the
    pool rows always train. These scores give the temperature and the threshold of `target` sensitivity on the calibration
    slice, and on the rest AUC and sensitivity with the forgetting check. A fit on everything scores the test rows: AUC, ECE,
    specificity at 0.90 sensitivity, sensitivity at 0.70 specificity and sensitivity at the threshold. Doses are levels of
    the same rows, so all fits share every pass.
    """
    named = ["0", *("ALL" if d is None else str(d) for d in doses)]
    numbers = F.create_map(*[F.lit(x) for pair in zip(named, range(len(named))) for x in pair])
    first = S.nested_doses(pool.select(ident, label), doses, label, seed, ident)
    first = settle(first.groupBy(ident).agg(F.min(numbers[F.col("dose")]).alias("level")))
    coded, names = source_codes(S.calibration_split(corpus, [source, label], seed=seed, ident=ident), source)
    own = coded.select(ident, label, vector, "role", F.col("__code").alias("cell"), F.lit(0).alias("start"))
    added = pool.select(ident, label, vector).join(first, ident).select(
        ident, label, vector, F.lit("pool").alias("role"), F.lit(-2).alias("cell"), F.col("level").alias("start")
    )
    rows = MF.task_rows(settle(own.unionByName(added)), vector, [label], bars=F.array("cell"), level=F.col("start"))
    levels = range(len(named))
    fits = MF.fit_many(rows, MF.Tasks.of([(-1, s, d, 0) for d in levels for s in [*range(len(names)), -1]]))

    oof = settle(fits.score(rows.filter("cell >= 0"), [ident, label, "role"]))
    cal = oof.filter("role = 'cal'")
    heat = C.fit_temperature_bounded(cal, ["level"], "score", label).select("level", "temperature")
    steps = M.roc_steps(cal.join(heat, "level").withColumn("p", tempered("score", F.col("temperature"))), ["level"], "p", label)
    point = settle(heat.join(M.threshold_for_sensitivity_roc(steps, ["level"], target), "level"))

    def judged(df: DataFrame) -> DataFrame:
        return df.join(point, "level").withColumn("p", tempered("score", F.col("temperature")))

    def caught(df: DataFrame, name: str) -> DataFrame:
        hit = F.count_if((F.col(label) == 1) & (F.col("p") >= F.col("threshold")))
        return df.groupBy("level").agg((hit / F.nullif(F.count_if(F.col(label) == 1), F.lit(0))).alias(name))

    known = judged(oof.filter("role = 'eval'"))
    new = settle(judged(fits.score(MF.task_rows(test, vector, [label]), [ident, label], held_out=False)))
    curve = M.roc_steps(new, ["level"], "p", label)
    whole = len(names)
    sizes = [(d, named[d], *(int(m[d * (whole + 1) + whole] - m[whole]) for m in (fits.n, fits.n_pos))) for d in levels]
    out = corpus.sparkSession.createDataFrame(sizes, "level int, dose string, dose_n long, n_pos long").join(point, "level")
    for part in (
        M.auc(new, ["level"], "p", label).select("level", "auc"),
        M.ece(new, ["level"], "p", label).select("level", "ece"),
        M.spec_at_sens(curve, ["level"]).select("level", "spec_at_sens"),
        M.sens_at_spec_last(curve, ["level"]).select("level", "sens_at_spec"),
        caught(new, "sens"),
        M.auc(known, ["level"], "p", label).select("level", F.col("auc").alias("known_auc")),
        caught(known, "known_sens"),
    ):
        out = out.join(part, "level", "left")
    return out.drop("level").withColumn("forgetting", A.forgetting_check(F.col("known_sens")))
