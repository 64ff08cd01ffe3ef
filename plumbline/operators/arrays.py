"""Token pooling, box geometry, evidence maps and localisation scores.

Maps and token sets are fixed-size per item (64 cells), so windows partitioned by
item stay small whatever the number of items.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline import constants as K
from plumbline.functions.maths import clamp, col, half_even, ratio

LSE_TAU = 0.1


def pool_tokens(tokens: DataFrame, keys: Sequence[str], value: str, kinds: Sequence[str], top: int = 8) -> DataFrame:
    """Channel-wise pooling over tokens, all requested kinds in one grouping.

    keys = (item, channel). The token values of one item and channel are gathered
    as one short sorted array; every pool is an expression over it.
    """
    vals = tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("v"))
    v, n = F.col("v"), F.size("v")

    def quantile(q: float) -> Column:
        h = F.lit(q) * (n - 1)
        lo = F.get(v, F.floor(h).cast("int"))
        hi = F.get(v, F.least(F.floor(h) + 1, n - 1).cast("int"))
        return lo + (hi - lo) * (h - F.floor(h))

    def mean_of(arr: Column) -> Column:
        return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / F.size(arr)

    peak = F.array_max(v)
    soft = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp((x - peak) / LSE_TAU)) / n
    pools = {
        "max": peak,
        "mean": mean_of(v),
        "p95": quantile(0.95),
        "top8mean": mean_of(F.slice(v, F.greatest(n - top + 1, F.lit(1)), F.lit(top))),
        "lse": peak + F.lit(LSE_TAU) * F.ln(soft),
        "wmax": F.least(peak, quantile(0.98)),
    }
    return vals.select(*keys, *[pools[k].alias(k) for k in kinds])


def vector_norm(v) -> Column:
    return F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2norm_tokens(v) -> Column:
    """Unit-norm vector; a zero vector (norm < 1e-8) stays zero."""
    n = vector_norm(v)
    safe = F.when(n < 1e-8, F.lit(1.0)).otherwise(n)
    return F.transform(col(v), lambda x: x.cast("double") / safe)


def apical_pool(cells: DataFrame, keys: Sequence[str], value: str, rows: int = 3) -> DataFrame:
    """Mean over the top rows of the grid."""
    return cells.filter(F.col("gy") < rows).groupBy(*keys).agg(F.avg(value).alias("pooled"))


def feature_concat(*branches) -> Column:
    return F.concat(*[F.transform(col(b), lambda x: x.cast("double")) for b in branches])


def scale_factor(height, width, working: int = 1024) -> Column:
    """working / min side, the side floored at 1."""
    return F.lit(float(working)) / F.greatest(F.lit(1), F.least(col(height), col(width))).cast("double")


def scale_boxes(boxes, height, width, working: int = 1024) -> Column:
    s = scale_factor(height, width, working)
    return F.transform(
        col(boxes), lambda b: F.struct(*[(b[k] * s).alias(k) for k in ("x", "y", "w", "h")])
    )


def letterbox_params(y0, y1, x0, x1) -> Column:
    """Struct(side, pad_x, pad_y) of the centred square around a crop."""
    cw, ch = F.greatest(F.lit(1), col(x1) - col(x0)), F.greatest(F.lit(1), col(y1) - col(y0))
    side = F.greatest(cw, ch)
    return F.struct(
        side.alias("side"), F.floor((side - cw) / 2).alias("pad_x"), F.floor((side - ch) / 2).alias("pad_y")
    )


def map_crop_to_original(y0, y1, x0, x1, harm_w, harm_h, orig_w, orig_h) -> Column:
    """Crop box in original pixels, halves rounded to even."""
    sx = F.when(col(harm_w) > 0, col(orig_w) / col(harm_w).cast("double")).otherwise(F.lit(1.0))
    sy = F.when(col(harm_h) > 0, col(orig_h) / col(harm_h).cast("double")).otherwise(F.lit(1.0))
    return F.struct(
        half_even(col(x0) * sx).alias("x"),
        half_even(col(y0) * sy).alias("y"),
        half_even((col(x1) - col(x0)) * sx).alias("w"),
        half_even((col(y1) - col(y0)) * sy).alias("h"),
    )


def rasterize_boxes(boxes: DataFrame, ident: str = "id", width: int = 1024, height: int = 1024, grid: int = 8, mode: str = "soft") -> DataFrame:
    """Boxes over a crop -> covered cells (ident, gy, gx, value), max over boxes.

    Rows carry x, y, w, h and the crop y0, y1, x0, x1. Each box emits just the cells
    between its floor and ceiling bounds; cells it does not touch are absent.
    """
    lb = boxes.withColumn("__l", letterbox_params("y0", "y1", "x0", "x1"))
    cw, ch = F.greatest(F.lit(1), F.col("x1") - F.col("x0")), F.greatest(F.lit(1), F.col("y1") - F.col("y0"))

    def span(lo: str, size: str, start: str, extent: Column, pad: str, limit: int) -> tuple[Column, Column]:
        a = clamp(F.col(lo), 0, limit) - F.col(start)
        b = clamp(F.col(lo) + F.col(size), 0, limit) - F.col(start)
        return F.greatest(F.lit(0.0), a), F.least(extent.cast("double"), b)

    cx0, cx1 = span("x", "w", "x0", cw, "pad_x", width)
    cy0, cy1 = span("y", "h", "y0", ch, "pad_y", height)
    side = F.col("__l.side").cast("double")
    g = float(grid)
    placed = lb.withColumns({"__cx0": cx0, "__cx1": cx1, "__cy0": cy0, "__cy1": cy1}).filter(
        (F.col("__cx1") > F.col("__cx0")) & (F.col("__cy1") > F.col("__cy0"))
    )
    placed = placed.select(
        ident,
        ((F.col("__cx0") + F.col("__l.pad_x")) / side * g).alias("gx0"),
        ((F.col("__cx1") + F.col("__l.pad_x")) / side * g).alias("gx1"),
        ((F.col("__cy0") + F.col("__l.pad_y")) / side * g).alias("gy0"),
        ((F.col("__cy1") + F.col("__l.pad_y")) / side * g).alias("gy1"),
    )

    def cells(lo: str, hi: str) -> Column:
        first, last = F.floor(lo).cast("int"), F.least(F.lit(grid), F.ceil(hi)).cast("int") - 1
        return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    each = placed.withColumn("gy", F.explode(cells("gy0", "gy1"))).withColumn("gx", F.explode(cells("gx0", "gx1")))
    oy = F.least(F.col("gy") + 1.0, F.col("gy1")) - F.greatest(F.col("gy").cast("double"), F.col("gy0"))
    ox = F.least(F.col("gx") + 1.0, F.col("gx1")) - F.greatest(F.col("gx").cast("double"), F.col("gx0"))
    value = F.lit(1.0) if mode == "hard" else ox * oy
    return (
        each.filter((oy > 0) & (ox > 0))
        .groupBy(ident, "gy", "gx")
        .agg(clamp(F.max(value), 0, 1).alias("value"))
    )


def grid_max(grid) -> Column:
    """Largest finite cell of a 2-D array; NULL when missing, empty or all non-finite."""
    flat = F.filter(F.flatten(col(grid)), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.array_max(flat)


def region_name(gy, gx) -> Column:
    """Row band and side of a cell; the left half of the map is the right side."""
    band = F.when(col(gy) < 2, "upper").when(col(gy) < 5, "mid").otherwise("lower")
    return F.concat_ws(" ", band, F.when(col(gx) < 4, "right").otherwise("left"))


def grid_argmax(cells: DataFrame, ident: str = "id", value: str = "x") -> DataFrame:
    """First-largest cell per item in row-major order, with its region."""
    best = F.max_by(F.struct("gy", "gx"), F.struct(F.col(value), -F.col("pos")))
    return cells.groupBy(ident).agg(F.max(value).alias("peak"), best.alias("__c")).select(
        ident, "peak", "__c.gy", "__c.gx", region_name("__c.gy", "__c.gx").alias("region")
    )


def top_relevant(values, names: Sequence[str] = K.RELEVANT_FINDINGS) -> Column:
    """Largest value over the named keys of a map; NULL if none is present."""
    return F.array_max(F.filter(F.array(*[F.try_element_at(col(values), F.lit(n)) for n in names]), lambda x: ~F.isnan(x)))


def top_k_map(values, k: int = 5) -> Column:
    """The k largest map entries, value descending then key."""
    entries = F.transform(F.map_entries(col(values)), lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("key")))
    return F.transform(
        F.slice(F.array_sort(entries), 1, k), lambda e: F.struct(e["key"].alias("key"), (-e["neg"]).alias("value"))
    )


def fixed(x, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", col(x))


def evidence_digest(df: DataFrame) -> Column:
    """Text digest of verdict, calibrated numbers, zones, top findings and warnings; empty blocks drop out.

    Reads verdict, t, t_seq, tb_prob, threshold, s_inactive, safety_net, zones, findings, warnings.
    """
    def block(title: str, entries: Column, render) -> Column:
        lines = F.array_join(F.transform(entries, render), "\n")
        return F.when(F.size(entries) > 0, F.concat(F.lit(title + "\n"), lines))

    def numbered(e: Column) -> Column:
        return F.concat(F.lit("  "), e["key"], F.lit(": "), F.format_string("%.4f", e["value"]))

    return F.concat_ws(
        "\n",
        F.concat(F.lit("verdict: "), F.col("verdict")),
        F.concat(F.lit("tb_prob (calibrated under T="), fixed("t", 3), F.lit("): "), fixed("tb_prob", 4)),
        F.concat(F.lit("decided_at_threshold: "), fixed("threshold", 4)),
        F.concat(F.lit("s_inactive (under T_seq="), fixed("t_seq", 3), F.lit("): "), fixed("s_inactive", 4)),
        F.when(F.length("safety_net") > 0, F.concat(F.lit("safety_net_applied: "), F.col("safety_net"))),
        block("per-zone probabilities:", top_k_map("zones", 1000), numbered),
        block("top-5 findings:", top_k_map("findings", 5), numbered),
        block("preprocessing warnings:", F.col("warnings"), lambda w: F.concat(F.lit("  - "), w)),
    )


def pointing_game(cells: DataFrame, ident: str = "id", evidence: str = "ev", truth: str = "gt") -> DataFrame:
    """Hit = the strongest evidence cell (first on ties) is a positive cell."""
    best = F.max_by(F.col(truth), F.struct(F.col(evidence), -F.col("pos")))
    return cells.groupBy(ident).agg((best > 0.5).alias("hit"))


def iou_scores(cells: DataFrame, ident: str = "id", evidence: str = "ev", truth: str = "gt", tau: float = 0.5) -> DataFrame:
    """IoU at the item's own number of positive cells and at a fixed cut; NULL without positives."""
    rank = F.row_number().over(Window.partitionBy(ident).orderBy(F.col(evidence).desc(), F.col("pos")))
    k = F.sum((F.col(truth) > 0.5).cast("int")).over(Window.partitionBy(ident))
    flagged = cells.withColumn("__top", rank <= k).withColumn("__k", k)
    gt = F.col(truth) > 0.5

    def iou(pred: Column) -> Column:
        return F.when(F.max("__k") > 0, ratio(F.count_if(pred & gt), F.count_if(pred | gt)))

    return flagged.groupBy(ident).agg(iou(F.col("__top")).alias("iou_topk"), iou(F.col(evidence) >= tau).alias("iou_fixed"))


def localization_scores(cells: DataFrame, ident: str = "id", evidence: str = "ev", truth: str = "gt") -> DataFrame:
    return pointing_game(cells, ident, evidence, truth).join(iou_scores(cells, ident, evidence, truth), ident)


def cell_pos_weight(cells: DataFrame, truth: str = "gt") -> DataFrame:
    """max(1, neg / max(1, pos)) over the cells of boxed items."""
    pos = F.count_if(F.col(truth) > 0.5)
    neg = F.count(F.lit(1)) - pos
    return cells.agg(F.greatest(F.lit(1.0), neg / F.greatest(F.lit(1), pos)).alias("pos_weight"))


def class_weight(df: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.groupBy(*keys).agg((F.greatest(F.lit(1), neg) / F.greatest(F.lit(1), pos)).alias("weight"))


def total_variation(cells: DataFrame, ident: str = "id", value: str = "x") -> DataFrame:
    """Mean absolute step down plus mean absolute step across."""
    down = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(ident, "gx").orderBy("gy")))
    across = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(ident, "gy").orderBy("gx")))
    steps = cells.withColumn("__d", down).withColumn("__a", across)
    return steps.groupBy(ident).agg((F.avg("__d") + F.avg("__a")).alias("tv"))


def attention_com_row(cells: DataFrame, ident: str = "id", weight: str = "w") -> DataFrame:
    """Centre of mass over rows."""
    return cells.groupBy(ident).agg((F.sum(F.col(weight) * F.col("gy")) / F.sum(weight)).alias("com_row"))
