"""Tolerant and strict handling of JSON records.

Fields are typed through VARIANT, so a number and a numeric string stay apart and
nothing has to be inferred up front. All of it is built-in expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import constants as K
from plumbline.functions.maths import clamp, col
from plumbline.functions.skew import skew_attach
from plumbline.operators.metrics import score_quantiles

_NUMERIC = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"
_NUMBERS = r"^ARRAY<(BIGINT|DOUBLE|FLOAT|DECIMAL[^<>]*|VOID)>$"
_STRINGS = r"^ARRAY<(STRING|VOID)>$"
_BOX = "array<struct<xmin string, ymin string, width string, height string>>"


def field(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column, path: str = "$") -> Column:
    """Schema text of a field; NULL when absent or JSON null."""
    return F.nullif(F.schema_of_variant(field(v, path)), F.lit("VOID"))


def is_number(v: Column, path: str) -> Column:
    return F.coalesce(F.rlike(kind(v, path), F.lit(_NUMERIC)), F.lit(False))


def is_string(v: Column, path: str) -> Column:
    return F.coalesce(kind(v, path) == "STRING", F.lit(False))


def number(v: Column, path: str) -> Column:
    """Number or NULL; numeric text is not a number."""
    return F.when(is_number(v, path), F.try_variant_get(v, path, "double"))


def text(v: Column, path: str) -> Column:
    """Non-empty string or NULL."""
    s = F.try_variant_get(v, path, "string")
    return F.when(is_string(v, path) & (F.length(s) > 0), s)


def strings(v: Column, path: str) -> Column:
    """Array of strings, [] when the field is anything else."""
    ok = F.coalesce(F.rlike(kind(v, path), F.lit(_STRINGS)), F.lit(False))
    got = F.try_variant_get(v, path, "array<string>")
    return F.when(ok & ~F.exists(got, lambda s: s.isNull()), got).otherwise(F.array().cast("array<string>"))


def pick(v: Column, path: str, allowed: Sequence[str], fallback: str) -> Column:
    s = text(v, path)
    return F.when(s.isin(list(allowed)), s).otherwise(F.lit(fallback))


def clamp01(v: Column, path: str) -> Column:
    return F.coalesce(clamp(number(v, path), 0, 1), F.lit(0.0))


def normalize_submission(df: DataFrame, raw: str, model_id: str = "unknown") -> DataFrame:
    """Tolerant record normaliser with forced-abstain rails applied after defaults."""
    v = F.try_parse_json(F.col(raw))
    base = df.withColumns(
        {
            "image_quality": pick(v, "$.image_quality", K.QUALITY_VALUES, "limited"),
            "projection": pick(v, "$.projection", K.PROJECTION_VALUES, "unknown"),
            "__screen": pick(v, "$.tb_screen_result", K.SCREEN_VALUES, "abstain"),
            "confidence_band": pick(v, "$.confidence_band", K.BAND_VALUES, "low"),
            "tb_score": clamp01(v, "$.tb_score_uncalibrated"),
            "scar_score": clamp01(v, "$.scar_shape_score_uncalibrated"),
            "mimic_features": strings(v, "$.mimic_features_present"),
            "localization": strings(v, "$.abnormality_localization"),
            "safety_flags": strings(v, "$.safety_flags"),
            "__why": F.coalesce(text(v, "$.short_rationale"), F.lit("(no rationale returned)")),
            "limitation": text(v, "$.refusal_or_limitation"),
            "model_version": F.coalesce(text(v, "$.model_version_seen_by_client"), F.lit(model_id)),
        }
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("image_quality") != "diagnostic", F.concat(F.lit("image_quality="), F.col("image_quality"))),
            F.when(
                (F.col("projection") == "unknown") & (F.col("__screen") == "screen_positive"),
                F.lit("projection=unknown with positive screen"),
            ),
            F.when(F.col("confidence_band") == "low", F.lit("confidence_band=low")),
        )
    )
    forced = (F.size(reasons) > 0) & (F.col("__screen") != "abstain")
    prefixed = F.concat(F.lit("[forced abstain: "), F.array_join(reasons, ", "), F.lit("] "), F.col("__why"))
    return (
        base.withColumn("rationale", F.when(forced, prefixed).otherwise(F.col("__why")))
        .withColumn("screen", F.when(forced, "abstain").otherwise(F.col("__screen")))
        .drop("__screen", "__why")
    )


def _unit_map(v: Column, path: str) -> Column:
    """Object whose values are all numbers in [0, 1]."""
    names = F.try_variant_get(v, path, "map<string,variant>")
    vals = F.map_values(names)
    good = F.forall(
        vals,
        lambda x: F.coalesce(F.rlike(F.schema_of_variant(x), F.lit(_NUMERIC)), F.lit(False))
        & F.coalesce(F.try_variant_get(x, "$", "double").between(0, 1), F.lit(False)),
    )
    return F.coalesce(F.startswith(kind(v, path), F.lit("OBJECT")) & good, F.lit(False))


def _unit_grid(v: Column, path: str, side: int = 8) -> Column:
    """side x side array of numbers in [0, 1]."""
    grid = F.try_variant_get(v, path, "array<array<variant>>")

    def good_cell(x: Column) -> Column:
        return F.coalesce(F.rlike(F.schema_of_variant(x), F.lit(_NUMERIC)), F.lit(False)) & F.coalesce(
            F.try_variant_get(x, "$", "double").between(0, 1), F.lit(False)
        )

    rows = F.forall(grid, lambda r: (F.size(r) == side) & F.forall(r, good_cell))
    return F.coalesce((F.size(grid) == side) & rows, F.lit(False))


def _optional(v: Column, path: str, good: Column) -> Column:
    """Absent is fine, present must be valid (JSON null counts as present)."""
    return F.when(field(v, path).isNull(), F.lit(True)).otherwise(good)


def engine_violations(raw) -> Column:
    """Names of the schema rules an engine result breaks; empty = valid."""
    v = F.try_parse_json(col(raw))
    crop_ok = is_number(v, "$.crop_box.x")
    for part in ("y", "w", "h"):
        crop_ok = crop_ok & is_number(v, f"$.crop_box.{part}")
    net = F.schema_of_variant(field(v, "$.safety_net_applied"))
    rules = {
        "object": F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False)),
        "tb_prob": is_number(v, "$.tb_prob"),
        "tb_logit": is_number(v, "$.tb_logit"),
        "s_inactive": is_number(v, "$.s_inactive"),
        "verdict": F.coalesce(text(v, "$.verdict").isin("tb", "no_tb", "abstain"), F.lit(False)),
        "decided_at_threshold": is_number(v, "$.decided_at_threshold"),
        "safety_net_applied": F.coalesce(net.isin("VOID", "STRING"), F.lit(False)),
        "warnings": F.coalesce(F.startswith(kind(v, "$.image_quality.warnings"), F.lit("ARRAY")), F.lit(False)),
        "latency_ms": F.coalesce(F.rlike(kind(v, "$.latency_ms"), F.lit("^(OBJECT|ARRAY)")), F.lit(False)),
        "audit": is_string(v, "$.audit.model_id") & is_string(v, "$.audit.model_sha") & is_string(v, "$.audit.git_sha"),
        "box_evidence_grid": _optional(v, "$.box_evidence_grid", _unit_grid(v, "$.box_evidence_grid")),
        "zonal_scores": _optional(v, "$.zonal_scores", _unit_map(v, "$.zonal_scores")),
        "txrv_pathologies": _optional(v, "$.txrv_pathologies", _unit_map(v, "$.txrv_pathologies")),
        "crop_box": _optional(v, "$.crop_box", crop_ok),
        "inversion_detected": _optional(
            v, "$.inversion_detected", F.coalesce(kind(v, "$.inversion_detected") == "BOOLEAN", F.lit(False))
        ),
    }
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))


def validate_engine_result(df: DataFrame, raw: str) -> DataFrame:
    """Add violations and valid; filter on valid to split off the quarantine."""
    return df.withColumn("violations", engine_violations(raw)).withColumn("valid", F.size("violations") == 0)


def _mentions(head: str):
    def test(x: Column) -> Column:
        return F.contains(F.lower(x), F.lit(head))

    return test


def normalize_report(df: DataFrame, raw: str, zones: Sequence[str] = K.ZONES) -> DataFrame:
    """Report normaliser: text defaults, at most 4 impressions, allowed regions, required limitations."""
    v = F.try_parse_json(F.col(raw))
    plain = {k: F.coalesce(text(v, f"$.{k}"), F.lit(d)) for k, d in K.REPORT_DEFAULTS.items()}
    sections = {k: F.coalesce(text(v, f"$.findings.{k}"), F.lit(d)) for k, d in K.FINDINGS_DEFAULTS.items()}
    items = F.transform(
        F.try_variant_get(v, "$.impression", "array<variant>"),
        lambda d: F.struct(
            text(d, "$.statement").alias("statement"),
            pick(d, "$.likelihood", K.LIKELIHOOD_VALUES, "less_likely").alias("likelihood"),
        ),
    )
    kept = F.slice(F.filter(items, lambda d: d["statement"].isNotNull()), 1, 4)
    empty = F.slice(F.array(F.struct(F.lit("").alias("statement"), F.lit("").alias("likelihood"))), 1, 0)
    limits = strings(v, "$.limitations")
    for required in K.REPORT_LIMITATIONS:
        told = F.exists(limits, _mentions(required.lower()[:20]))
        limits = F.when(told, limits).otherwise(F.concat(limits, F.array(F.lit(required))))

    def short_list(path: str) -> Column:
        return F.slice(F.filter(strings(v, path), lambda s: F.length(s) > 0), 1, 20)

    return df.withColumns(
        {
            **plain,
            **sections,
            "impression": F.coalesce(kept, empty),
            "support_devices": short_list("$.support_devices"),
            "incidental_findings": short_list("$.incidental_findings"),
            "key_regions": F.filter(strings(v, "$.key_regions"), lambda z: z.isin(list(zones))),
            "limitations": limits,
        }
    )


def parse_bbox(raw) -> Column:
    """Box list from JSON list, single object, single-quoted object or an empty marker.

    A malformed box is dropped alone; unparseable text gives [].
    """
    s = F.trim(col(raw))
    blank = s.isNull() | (s == "") | F.lower(s).isin("none", "nan", "[]")
    boxes = F.from_json(s, _BOX, {"allowSingleQuotes": "true"})
    typed = F.transform(
        boxes, lambda b: F.struct(*[b[k].try_cast("double").alias(k) for k in ("xmin", "ymin", "width", "height")])
    )
    whole = F.filter(
        typed,
        lambda b: b["xmin"].isNotNull() & b["ymin"].isNotNull() & b["width"].isNotNull() & b["height"].isNotNull(),
    )
    none = F.array().cast("array<struct<xmin double, ymin double, width double, height double>>")
    return F.when(blank, none).otherwise(F.coalesce(whole, none))


def parse_boxes_xyxy(raw) -> Column:
    """Corner boxes under `boxes`, `predictions` or a bare array -> x, y, w, h, label, score."""
    v = F.try_parse_json(col(raw))
    none = F.array().cast("array<variant>")

    def arr(path: str) -> Column:
        return F.coalesce(F.try_variant_get(v, path, "array<variant>"), none)

    raw_boxes = F.concat(arr("$.boxes"), arr("$.predictions"), arr("$"))
    corners = F.filter(
        raw_boxes,
        lambda b: is_number(b, "$.xmin") & is_number(b, "$.ymin") & is_number(b, "$.xmax") & is_number(b, "$.ymax"),
    )

    def to_box(b: Column) -> Column:
        x, y = number(b, "$.xmin"), number(b, "$.ymin")
        return F.struct(
            x.alias("x"), y.alias("y"), (number(b, "$.xmax") - x).alias("w"), (number(b, "$.ymax") - y).alias("h"),
            F.when(is_string(b, "$.label"), F.try_variant_get(b, "$.label", "string")).alias("label"),
            number(b, "$.score").alias("score"),
        )

    return F.transform(corners, to_box)


def parse_embedding(raw) -> Column:
    """Vector from a flat array, [[...]] (first row), [seq][tok][dim] (mean over the outer axis),
    {embedding}, {data: [{embedding}]}; else [].
    """
    v = F.try_parse_json(col(raw))

    def flat(path: str) -> Column:
        ok = F.coalesce(F.rlike(kind(v, path), F.lit(_NUMBERS)), F.lit(False))
        return F.when(ok, F.try_variant_get(v, path, "array<double>"))

    # Three levels deep, each inner row flattened to its numbers: rows are averaged position by position.
    cube = F.try_variant_get(v, "$", "array<array<array<double>>>")
    rows = F.transform(cube, lambda m: F.get(m, F.lit(0)))
    n = F.size(cube)
    first = F.get(rows, F.lit(0))
    pooled = F.transform(
        first,
        lambda _x, i: F.aggregate(
            rows, F.lit(0.0), lambda acc, r: acc + F.coalesce(F.get(r, i), F.lit(0.0)) / n.cast("double")
        ),
    )
    empty = F.array().cast("array<double>")
    return F.coalesce(flat("$"), flat("$[0]"), pooled, flat("$.embedding"), flat("$.data[0].embedding"), empty)


def extract_json_from_text(raw) -> Column:
    """Strip code fences, take first { to last }; NULL when it is not JSON."""
    bare = F.trim(F.replace(F.regexp_replace(col(raw), r"(?i)```json", ""), F.lit("```"), F.lit("")))
    body = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(body).isNotNull() & (F.length(body) > 0), body)


def quality_gate(df: DataFrame, is_target: Column, quality: Column, reason: Column) -> DataFrame:
    """halted and halt_reason for rows that are not the target kind or are unreadable."""
    halt = F.coalesce(~is_target, F.lit(True)) | F.coalesce(quality == "unreadable", F.lit(False))
    said = F.when(F.length(reason) > 0, reason).otherwise(F.lit("Image rejected by quality gate."))
    return df.withColumn("halted", halt).withColumn("halt_reason", F.when(halt, said))


def content_fingerprint(s) -> Column:
    """FNV-1a 32-bit hex over characters of the basic plane."""
    step = F.aggregate(
        F.split(col(s), ""),
        F.lit(2166136261).cast("bigint"),
        lambda h, c: F.when(
            F.length(c) > 0,
            (h.bitwiseXOR(F.ascii(c).cast("bigint")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)),
        ).otherwise(h),
    )
    return F.lower(F.lpad(F.hex(step), 8, "0"))


def percentile_clip_normalize(
    df: DataFrame, keys: Sequence[str], value: str, lo: float = 0.01, hi: float = 0.99, name: str = "scaled"
) -> DataFrame:
    """Clip to each group's percentiles, then min-max to [0, 1]; a flat group divides by 1."""
    q = score_quantiles(df, keys, value, (lo, hi))
    lo_c, hi_c = (c for c in q.columns if c not in (*keys, "n"))
    bounds = q.select(*keys, F.col(lo_c).alias("__lo"), F.col(hi_c).alias("__hi"), F.col("n").alias("__rows"))
    ident = [c for c, kind in df.dtypes if not kind.startswith("map")]
    out = skew_attach(df, bounds, keys, ident, "__rows")
    span = F.when(F.col("__hi") <= F.col("__lo"), F.lit(1.0)).otherwise(F.col("__hi") - F.col("__lo"))
    clipped = F.least(F.greatest(F.col(value), F.col("__lo")), F.col("__lo") + span)
    return out.withColumn(name, (clipped - F.col("__lo")) / span).drop("__lo", "__hi")


def harvest_calibration_samples(runs: DataFrame) -> DataFrame:
    """Nested runs -> label, map of non-NULL member probabilities, record-member uncertainty, halted flag."""
    present = F.filter("members", lambda m: m["tb_prob"].isNotNull())
    probs = F.map_from_entries(F.transform(present, lambda m: F.struct(m["id"], m["tb_prob"])))
    unc = F.get(F.filter("members", lambda m: m["id"] == "vlm"), F.lit(0))["uncertainty"]
    return runs.select(
        "id", "label", probs.alias("member_probs"), unc.alias("vlm_uncertainty"),
        F.col("members").isNull().alias("halted"),
    )


def probe_pool_select(probe: DataFrame, main: DataFrame, same_source: str | None = None) -> DataFrame:
    """Probe rows relabelled 1 plus active main rows relabelled 0, optionally of one source only."""
    active = main.filter(F.col("label") == 1)
    if same_source is not None:
        active = active.filter(F.col("source") == same_source)
    pos = probe.withColumn("label", F.lit(1)).withColumn("source", F.lit("sequelae"))
    return pos.unionByName(active.withColumn("label", F.lit(0)), allowMissingColumns=True)
