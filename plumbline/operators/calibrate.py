"""Calibration fits, fusion and conformal bands.

One-parameter fits are grouped aggregations over a grid, so every group is fitted
in the same pass. Two- and three-parameter logistic fits use MLlib, whose
gradient sums are tree-aggregated; they return the converged optimum.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline import constants as K
from plumbline.functions.maths import EPS_FIT, EPS_RECORD, binary_nll, clamp, col, logit, sigmoid, softplus, tempered
from plumbline.functions.skew import skew_attach
from plumbline.operators.metrics import order_statistic

TEMPERATURE_BOUNDS = (0.05, 20.0)
REFINE_POINTS = 100
ROWS_PER_PARTITION = 50_000
REFINE_LEVELS = 3


def nll(df: DataFrame, keys: Sequence[str], p="p", label="label", eps: float = EPS_FIT) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(binary_nll(label, p, eps)).alias("nll"))


def fit_temperature_grid(df: DataFrame, keys: Sequence[str], z="logit", label="label") -> DataFrame:
    """argmin of NLL over 91 temperatures from 0.5 to 5; the smallest wins ties."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(90)), lambda i: i * F.lit(4.5 / 90) + F.lit(0.5))
    each = df.select(*keys, col(z).alias("__z"), col(label).alias("__y"), F.explode(grid).alias("t"))
    per = each.groupBy(*keys, "t").agg(F.avg(binary_nll("__y", tempered("__z", F.col("t")))).alias("nll"))
    best = F.min(F.struct(F.col("nll"), F.col("t")))
    return per.groupBy(*keys).agg(best.alias("__b")).select(
        *keys, F.col("__b.t").alias("temperature"), F.col("__b.nll").alias("nll")
    )


def fit_temperature_bounded(
    df: DataFrame, keys: Sequence[str], z="logit", label="label", eps: float = EPS_FIT
) -> DataFrame:
    """Minimise NLL of sigmoid(z/T) on [0.05, 20].

    NLL has one minimum in T, so an evenly spaced grid brackets it between two
    neighbours; three levels of 100 steps narrow 20 to 4e-5. Each level is one
    pass with map-side combine and a state of one row per group.
    """
    # Copies of one (score, label) are one weighted row, so a hot value is not a hot salt.
    rows = df.groupBy(*keys, col(z).alias("__z"), col(label).alias("__y")).agg(F.count(F.lit(1)).alias("__w"))
    steps = F.sequence(F.lit(0), F.lit(REFINE_POINTS))
    state = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).select(
        *keys, "__rows", F.lit(TEMPERATURE_BOUNDS[0]).alias("__lo"), F.lit(TEMPERATURE_BOUNDS[1]).alias("__hi")
    )
    for _ in range(REFINE_LEVELS):
        if keys:
            ready = skew_attach(rows, state, keys, ["__z", "__y"], "__rows")
        else:
            ready = rows.withColumn("__lo", state.select("__lo").scalar()).withColumn(
                "__hi", state.select("__hi").scalar()
            )
        each = ready.select("*", F.explode(steps).alias("i")).withColumn(
            "t", F.col("__lo") + F.col("i") * (F.col("__hi") - F.col("__lo")) / F.lit(float(REFINE_POINTS))
        )
        per = each.groupBy(*keys, "__lo", "__hi", "i", "t").agg(
            (F.sum(F.col("__w") * binary_nll("__y", tempered("__z", F.col("t")), eps)) / F.sum("__w")).alias("nll"),
            F.count(F.lit(1)).alias("__rows"),
        )
        best = per.groupBy(*keys, "__lo", "__hi").agg(
            F.min(F.struct("nll", "t")).alias("__b"), F.max("__rows").alias("__rows")
        )
        step = (F.col("__hi") - F.col("__lo")) / F.lit(float(REFINE_POINTS))
        found = best.select(
            *keys,
            "__rows",
            F.col("__b.t").alias("temperature"),
            F.col("__b.nll").alias("nll"),
            F.greatest(F.lit(TEMPERATURE_BOUNDS[0]), F.col("__b.t") - step).alias("__lo"),
            F.least(F.lit(TEMPERATURE_BOUNDS[1]), F.col("__b.t") + step).alias("__hi"),
        )
        state = found.select(*keys, "__rows", "__lo", "__hi")
    return found.select(*keys, "temperature", "nll")


def _logistic(df: DataFrame, features: Sequence[str], reg: float, weight: str | None = None):
    packed = VectorAssembler(inputCols=list(features), outputCol="__x").transform(df).persist()
    # Every solver step is one job over the partitions: size them by rows, not by the cluster.
    sized = packed.coalesce(max(1, math.ceil(packed.count() / ROWS_PER_PARTITION)))
    model = LogisticRegression(
        featuresCol="__x", labelCol="__y", regParam=reg, elasticNetParam=0.0, standardization=False,
        maxIter=100, tol=1e-9, family="binomial",
    )
    if weight:
        model = model.setWeightCol(weight)
    fitted = model.fit(sized)
    packed.unpersist()
    return fitted


def platt_rows(df: DataFrame, z: str, label: str) -> DataFrame:
    """Soft-target rows: each row splits into a positive part t and a negative part 1 - t.

    Below 200 rows the targets are (n+ + 1)/(n+ + 2) and 1/(n- + 2), else 1 and 0.
    """
    size = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("p"))
    sized = df.withColumn("__n", size.select("n").scalar()).withColumn("__p", size.select("p").scalar())
    small = F.col("__n") < 200
    target = (
        F.when(small & (F.col(label) == 1), (F.col("__p") + 1.0) / (F.col("__p") + 2.0))
        .when(small, 1.0 / (F.col("__n") - F.col("__p") + 2.0))
        .otherwise(F.col(label).cast("double"))
    )
    parts = F.array(
        F.struct(F.lit(1.0).alias("__y"), target.alias("__w")),
        F.struct(F.lit(0.0).alias("__y"), (1.0 - target).alias("__w")),
    )
    return sized.select(F.col(z).alias("__z"), F.explode(parts).alias("__t")).select("__z", "__t.*").filter("__w > 0")


def fit_platt(df: DataFrame, p: str = "prob", label: str = "label") -> tuple[float, float]:
    """A, B of sigmoid(A logit(p) + B)."""
    rows = df.select(logit(p).alias("z"), F.col(label))
    model = _logistic(platt_rows(rows, "z", label), ["__z"], 0.0, "__w")
    return float(model.coefficients[0]), float(model.intercept)


def apply_calibration(p, method, a, b, t) -> Column:
    """platt: sigmoid(A logit p + B), else sigmoid(logit p / T)."""
    z = logit(p)
    return F.when(col(method) == "platt", sigmoid(col(a) * z + col(b))).otherwise(sigmoid(z / col(t)))


def select_calibration(samples: DataFrame, members: Sequence[str] = tuple(K.MEMBER_WEIGHTS)) -> DataFrame:
    """Per member: temperature by default, Platt with >= 100 rows and an NLL better by > 0.01.

    Members under 10 rows get no row. Returns member, method, t, a, b, n, nll_raw, nll_cal.
    """
    rows = samples.filter(F.col("prob").isNotNull()).withColumn("z", logit("prob"))
    sizes = rows.groupBy("member").agg(
        F.count(F.lit(1)).alias("n"), F.avg(binary_nll("label", "prob", EPS_RECORD)).alias("nll_raw")
    )
    temps = fit_temperature_bounded(rows, ["member"], "z", eps=EPS_RECORD).withColumnRenamed("nll", "nll_t")
    known = {r["member"]: r["n"] for r in sizes.filter(F.col("member").isin(list(members))).collect()}
    fits = [(m, *fit_platt(rows.filter(F.col("member") == m))) for m in members if known.get(m, 0) >= 100]
    platt = samples.sparkSession.createDataFrame(fits, "member string, a double, b double")
    zc = sigmoid(F.col("a") * F.col("z") + F.col("b"))
    nll_p = (
        rows.join(F.broadcast(platt), "member")
        .groupBy("member", "a", "b")
        .agg(F.avg(binary_nll("label", zc, EPS_RECORD)).alias("nll_p"))
    )
    both = sizes.filter("n >= 10").join(temps, "member").join(nll_p, "member", "left")
    wins = F.coalesce(F.col("nll_p") < F.col("nll_t") - 0.01, F.lit(False))
    return both.select(
        "member",
        F.when(wins, "platt").otherwise("temperature").alias("method"),
        F.when(wins, F.lit(1.0)).otherwise(F.col("temperature")).alias("t"),
        F.when(wins, F.col("a")).otherwise(F.lit(1.0)).alias("a"),
        F.when(wins, F.col("b")).otherwise(F.lit(0.0)).alias("b"),
        "n",
        "nll_raw",
        F.when(wins, F.col("nll_p")).otherwise(F.col("nll_t")).alias("nll_cal"),
    )


def weight_of(member, weights: Mapping[str, float]) -> Column:
    out = F.lit(0.0)
    for name, w in weights.items():
        out = F.when(col(member) == name, F.lit(float(w))).otherwise(out)
    return out


def effective_weights(members: DataFrame, key: str, weights: Mapping[str, float], mode: str = "fixed") -> DataFrame:
    """Weight per present member: renormalised over the item's members in fixed mode (sum 0 -> 1)."""
    raw = weight_of("member", weights)
    if mode == "fitted":
        return members.withColumn("weight", raw)
    total = F.sum(raw).over(Window.partitionBy(key))
    return members.withColumn("weight", raw / F.when(total == 0, F.lit(1.0)).otherwise(total))


def fuse_log_odds(
    members: DataFrame, key: str, weights: Mapping[str, float], mode: str = "fixed", bias: float = 0.0
) -> DataFrame:
    """sigmoid(bias + sum w logit p) per item as one aggregation; members absent give 0.5.

    Renormalised weights need no second pass: sum(w l) / sum(w) over present members.
    """
    w = weight_of("member", weights)
    here = F.col("prob").isNotNull()
    num = F.coalesce(F.sum(F.when(here, w * logit("prob"))), F.lit(0.0))
    den = F.coalesce(F.sum(F.when(here, w)), F.lit(0.0))
    z = num / F.when(den == 0, F.lit(1.0)).otherwise(den) if mode == "fixed" else num + F.lit(bias)
    present = F.count("prob")
    return members.groupBy(key).agg(
        F.when(present == 0, F.lit(0.5)).otherwise(sigmoid(z)).alias("fused"), present.alias("n_members")
    )


def member_logits(samples: DataFrame, key: str, label: str, members: Sequence[str], prob: str = "prob") -> DataFrame:
    """Wide row per item: z_<member> = logit of its probability, 0 when absent."""
    return samples.groupBy(key, label).agg(
        *[
            F.coalesce(F.max(F.when(F.col("member") == m, logit(prob))), F.lit(0.0)).alias(f"z_{m}")
            for m in members
        ]
    )


def fit_fusion_weights(
    samples: DataFrame, key: str = "id", label: str = "label", members: Sequence[str] = tuple(K.MEMBER_WEIGHTS),
    prob: str = "prob", l2: float = 1e-2,
) -> tuple[dict[str, float], float]:
    """L2 logistic weights over member logits, bias unpenalised."""
    wide = member_logits(samples, key, label, members, prob).withColumn("__y", F.col(label).cast("double"))
    model = _logistic(wide, [f"z_{m}" for m in members], l2)
    return dict(zip(members, map(float, model.coefficients))), float(model.intercept)


def late_fusion_gain(image_logit, clinical_logit, g, present) -> Column:
    """image + softplus(g) * clinical; an absent modality contributes 0."""
    extra = F.when(col(present), softplus(g) * col(clinical_logit)).otherwise(F.lit(0.0))
    return col(image_logit) + extra


def log_odds_blend(channels: Sequence[tuple[Column, float]]) -> Column:
    """Sum of softplus(w) * channel logit over active channels."""
    out = F.lit(0.0)
    for z, w in channels:
        out = out + softplus(F.lit(float(w))) * F.coalesce(z, F.lit(0.0))
    return out


def conformal_thresholds(
    df: DataFrame, keys: Sequence[str], score="p", label="label", alpha: float = 0.92, gamma: float = 0.1,
    min_per_class: int = 20,
) -> DataFrame:
    """tau_low keeps alpha of positives above it, tau_high keeps gamma of negatives above it.

    Both come from one order-statistic pass over (keys, class); the band never inverts.
    """
    pos = F.col("__y") == 1
    rows = df.select(*keys, (col(label) == 1).cast("int").alias("__y"), col(score).cast("double").alias("__s"))
    k_pos = F.floor(F.lit(1.0 - alpha) * (F.col("__n") + 1))
    m_neg = F.floor(F.lit(gamma) * (F.col("__n") + 1))
    place = F.when(pos, F.when(k_pos > 0, k_pos)).otherwise(F.when(m_neg > 0, F.col("__n") - m_neg + 1))
    per = order_statistic(rows, [*keys, "__y"], "__s", place, "__v")
    low = F.coalesce(F.max(F.when(pos, F.col("__v"))), F.lit(0.0))
    high = F.coalesce(F.max(F.when(~pos, F.col("__v"))), F.lit(1.0))
    n_pos = F.coalesce(F.max(F.when(pos, F.col("__n"))), F.lit(0))
    n_neg = F.coalesce(F.max(F.when(~pos, F.col("__n"))), F.lit(0))
    return per.groupBy(*keys).agg(
        clamp(low, 0, 1).alias("tau_low"),
        clamp(F.greatest(high, low), 0, 1).alias("tau_high"),
        n_pos.alias("n_pos"),
        n_neg.alias("n_neg"),
        ((n_pos < min_per_class) | (n_neg < min_per_class)).alias("incomplete"),
    )


def safety_threshold(df: DataFrame, keys: Sequence[str], score="p", label="label", alpha: float = 0.92) -> DataFrame:
    """(1 - alpha) order statistic of positives; 0.5 under 20 of them, the minimum when k <= 0."""
    pos = df.filter(col(label) == 1).select(*keys, col(score).alias("__s"))
    k = F.greatest(F.lit(1), F.floor(F.lit(1.0 - alpha) * (F.col("__n") + 1)))
    found = order_statistic(pos, keys, "__s", k, "__v")
    return found.select(
        *keys, F.when(F.col("__n") >= 20, F.col("__v")).otherwise(F.lit(0.5)).alias("threshold"), F.col("__n").alias("n_pos")
    )


def undetermined_rate(df: DataFrame, keys: Sequence[str], p: str, tau_low: str, tau_high: str) -> DataFrame:
    inside = (F.col(p) >= F.col(tau_low)) & (F.col(p) < F.col(tau_high))
    return df.groupBy(*keys).agg(F.avg(inside.cast("double")).alias("undetermined_rate"))


def fit_calibration(samples: DataFrame, alpha: float = 0.92, gamma: float = 0.1) -> DataFrame:
    """Composite fit over (id, member, label, prob): one row per fitted member.

    Member calibrations, then fusion weights (fitted from 50 rows with 10 per class,
    else fixed), then conformal thresholds of the fused score and the safety
    threshold of the record member. Only parameter rows reach the driver.
    """
    spark: SparkSession = samples.sparkSession
    members = tuple(K.MEMBER_WEIGHTS)
    chosen = select_calibration(samples, members)
    params = {r["member"]: r for r in chosen.collect()}
    cal = F.col("prob")
    for m, r in params.items():
        fitted = apply_calibration("prob", F.lit(r["method"]), F.lit(r["a"]), F.lit(r["b"]), F.lit(r["t"]))
        cal = F.when(F.col("member") == m, fitted).otherwise(cal)
    ready = samples.withColumn("prob", cal)
    counts = samples.select("id", "label").distinct().agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("p")
    ).first()
    fitted = counts["n"] >= 50 and counts["p"] >= 10 and counts["n"] - counts["p"] >= 10
    weights, bias = fit_fusion_weights(ready) if fitted else (dict(K.MEMBER_WEIGHTS), 0.0)
    mode = "fitted" if fitted else "fixed"
    labels = samples.select("id", "label").distinct()
    fused = fuse_log_odds(ready, "id", weights, mode, bias).join(labels, "id")
    band = conformal_thresholds(fused, [], "fused", alpha=alpha, gamma=gamma)
    safety = safety_threshold(ready.filter(F.col("member") == "vlm"), [], "prob", alpha=alpha)
    base = spark.createDataFrame(
        [(m, *(params[m][c] for c in ("method", "t", "a", "b", "n")), weights[m]) for m in members if m in params],
        "member string, method string, t double, a double, b double, n long, weight double",
    )
    out = base.withColumn("mode", F.lit(mode)).withColumn("bias", F.lit(bias))
    for name in ("tau_low", "tau_high", "incomplete"):
        out = out.withColumn(name, band.select(name).scalar())
    return out.withColumn("safety_threshold", F.coalesce(safety.select("threshold").scalar(), F.lit(0.5)))


def lock_protocol(split: DataFrame, t: float, thr: float, low: float, seed: int, frac: float) -> DataFrame:
    """One-row frozen operating point with the split's sizes; refuses an inverted abstain band."""
    if not low < thr:
        raise ValueError(f"abstain band inverted: low={low} >= thr={thr}")
    return split.agg(
        F.count_if(F.col("role") == "cal").alias("n_cal"), F.count_if(F.col("role") == "eval").alias("n_eval")
    ).select(
        F.lit(t).alias("t"), F.lit(thr).alias("thr_at_95sens"), F.lit(low).alias("borderline_low"),
        F.lit(K.SCAR_ESCALATE).alias("s_inactive_escalate"),
        F.lit(K.EVIDENCE_BOX_HIGH).alias("asymmetric_evidence_thr"),
        F.lit(seed).alias("seed"), F.lit(frac).alias("cal_frac"), "n_cal", "n_eval",
    )


def softmax_weighted_pool(
    tokens: DataFrame, item: Sequence[str], score: str, value: str, temperature: float = 1.0
) -> DataFrame:
    """Sum of softmax(score) * value per item; an item's tokens are a fixed-size set."""
    top = F.max(score).over(Window.partitionBy(*item))
    e = F.exp((F.col(score) - top) / F.lit(temperature))
    return tokens.withColumn("__e", e).groupBy(*item).agg(
        (F.sum(F.col("__e") * F.col(value)) / F.sum("__e")).alias("pooled")
    )


def gated_soft_or(zones: DataFrame, item: str, zone_logit: str, gate_logit: str, floor: float = 0.25) -> DataFrame:
    """logsumexp over zones of gate * logit with gate = floor + (1 - floor) sigmoid(gate_logit)."""
    g = (F.lit(floor) + F.lit(1.0 - floor) * sigmoid(gate_logit)) * F.col(zone_logit)
    gated = zones.withColumn("__g", g)
    top = F.max("__g").over(Window.partitionBy(item))
    return gated.withColumn("__m", top).groupBy(item).agg(
        (F.max("__m") + F.ln(F.sum(F.exp(F.col("__g") - F.col("__m"))))).alias("soft_or")
    )


def tta_mean(passes: DataFrame, key: str, prob: str = "prob", expected: int = 5) -> DataFrame:
    """Mean over exactly `expected` passes; incomplete items are flagged with a NULL mean."""
    n = F.count(prob)
    return passes.groupBy(key).agg(
        n.alias("n_passes"), F.when(n == expected, F.avg(prob)).alias("mean_prob"), (n == expected).alias("complete")
    )


def self_consistency(samples: DataFrame, key: str, prob: str = "prob") -> DataFrame:
    """Mean and population std of the successful samples; failed when there is none."""
    n = F.count(prob)
    return samples.groupBy(key).agg(
        n.alias("n_ok"), F.avg(prob).alias("mean_prob"), F.stddev_pop(prob).alias("std"), (n == 0).alias("failed")
    )
