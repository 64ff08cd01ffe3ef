"""Manifests, label rules, annotation collapse and case records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import constants as K
from plumbline.functions.maths import col
from plumbline.functions.ranking import id_bucket, ranked

IMAGE_NAME = r"(?i)\.(png|jpe?g|bmp)$"


def is_image(path) -> Column:
    return F.rlike(col(path), F.lit(IMAGE_NAME))


def base_name(path) -> Column:
    """Last part after / or \\."""
    return F.regexp_extract(col(path), r"([^/\\]*)$", 1)


def stem(path) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def relative_to_first(path) -> Column:
    """Drop the leading folder."""
    return F.regexp_replace(col(path), r"^[^/]*/", "")


def label_from_path(rel) -> Column:
    """mask -> NULL; tubercul, _1 name or a part 'tb' -> 1; normal/healthy part or _0 name -> 0."""
    low = F.lower(col(rel))
    parts = F.split(low, "/")
    pos = (
        F.contains(low, F.lit("tubercul"))
        | F.rlike(low, F.lit(r"_1\.(png|jpe?g|bmp)$"))
        | F.array_contains(parts, "tb")
    )
    neg = F.arrays_overlap(parts, F.array(F.lit("normal"), F.lit("healthy"))) | F.rlike(
        low, F.lit(r"_0\.(png|jpe?g|bmp)$")
    )
    return F.when(F.contains(low, F.lit("mask")), F.lit(None).cast("int")).when(pos, 1).when(neg, 0)


def label_from_folder_tokens(rel) -> Column:
    """Holdout variant: a part only has to contain the token."""
    low = F.lower(col(rel))
    parts = F.split(low, "/")
    pos = F.exists(parts, lambda p: F.contains(p, F.lit("tb")) | F.contains(p, F.lit("tubercul")))
    neg = F.exists(parts, lambda p: F.contains(p, F.lit("normal")) | F.contains(p, F.lit("healthy")))
    return F.when(F.contains(low, F.lit("mask")), F.lit(None).cast("int")).when(pos, 1).when(neg, 0)


def label_from_prefix(rel) -> Column:
    low = F.lower(col(rel))
    return F.when(F.startswith(low, F.lit("tb/")), 1).when(F.startswith(low, F.lit("normal/")), 0)


def patient_id(source, path) -> Column:
    return F.concat_ws("_", col(source), F.regexp_replace(stem(path), "_[01]$", ""))


def collapse_annotations(annotations: DataFrame, files: DataFrame) -> DataFrame:
    """Many annotation rows per file -> one labelled row per file.

    annotations: fname, target, kind ('active_tb' / 'latent_tb' / other), box struct
    or NULL. files: fname, path. Files under a 'test' folder are dropped. An active
    row makes the file positive and only active boxes are kept; else target no_tb
    makes it negative; else a latent row sends it to the probe.
    """
    live = files.filter(~F.array_contains(F.split(F.lower("path"), "/"), "test"))
    per = (
        annotations.join(live, "fname")
        .groupBy("fname", "path")
        .agg(
            F.max((F.col("kind") == "active_tb").cast("int")).alias("__active"),
            F.max((F.col("kind") == "latent_tb").cast("int")).alias("__latent"),
            F.min("target").alias("__target"),
            F.array_sort(F.collect_list(F.when(F.col("kind") == "active_tb", F.col("box")))).alias("__boxes"),
        )
    )
    role = F.when(F.col("__active") == 1, "binary").when(F.col("__target") == "no_tb", "binary").when(
        F.col("__latent") == 1, "probe"
    )
    boxes = F.when(F.col("__active") == 1, F.col("__boxes")).otherwise(F.slice("__boxes", 1, 0))
    return (
        per.withColumn("role", role)
        .filter(F.col("role").isNotNull())
        .select(
            "fname",
            "path",
            "role",
            F.when((F.col("__active") == 1) | (F.col("role") == "probe"), 1).otherwise(0).alias("label"),
            boxes.alias("boxes"),
        )
    )


def unmatched_annotations(annotations: DataFrame, files: DataFrame) -> DataFrame:
    """Names without a file, with their number of annotation rows."""
    lost = annotations.join(files.select("fname").distinct(), "fname", "left_anti")
    return lost.groupBy("fname").agg(F.count(F.lit(1)).alias("n_rows"))


def route_roles(manifest: DataFrame, excluded: Column, holdout: Column) -> DataFrame:
    """role = external_holdout / excluded / train; write with partitionBy('role') for separate manifests.

    Excluded and holdout sources never enter train.
    """
    return manifest.withColumn(
        "role", F.when(holdout, "external_holdout").when(excluded, "excluded").otherwise("train")
    )


def read_label_lines(lines: DataFrame, line: str = "line", order: Sequence[str] = ("line_no",)) -> DataFrame:
    """`filename,label` lines -> (filename, label); header skipped, last duplicate wins.

    The winner is a max_by on the order columns, combined map-side, so a name
    repeated without bound is never gathered.
    """
    cells = F.split(F.trim(F.col(line)), ",")
    name, label = F.trim(F.get(cells, F.lit(0))), F.trim(F.get(cells, F.lit(1)))
    rows = lines.select(name.alias("name"), label.alias("raw"), *order).filter(
        (F.length("name") > 0) & (F.lower("name") != "filename") & F.col("raw").isin("0", "1")
    )
    return rows.groupBy(base_name("name").alias("filename")).agg(
        F.max_by("raw", F.struct(*order)).cast("int").alias("label")
    )


def match_labels_to_files(labels: DataFrame, files: DataFrame) -> DataFrame:
    """Labels with the file found by basename (path NULL when none)."""
    paths = files.filter(is_image("path")).groupBy(base_name("path").alias("filename")).agg(F.max("path").alias("path"))
    return labels.join(paths, "filename", "left")


def match_counts(matched: DataFrame) -> DataFrame:
    return matched.agg(
        F.count("path").alias("imported"), F.count_if(F.col("path").isNull()).alias("skipped_no_match")
    )


def expand_findings(df: DataFrame, index_col: str, names: Sequence[str] = K.FINDING_NAMES) -> DataFrame:
    """Class-index list -> names, joined text, count and one 0/1 column per class.

    An index without a name is kept as its number.
    """
    known = F.array(*map(F.lit, names))
    named = F.transform(
        F.col(index_col),
        lambda i: F.when((i >= 0) & (i < len(names)), F.get(known, i)).otherwise(i.cast("string")),
    )
    out = df.withColumn("finding_names", named)
    out = out.withColumn("findings", F.array_join("finding_names", "|")).withColumn(
        "n_findings", F.size("finding_names")
    )
    onehot = {n.replace(" ", "_"): F.array_contains("finding_names", n).cast("int") for n in names}
    return out.withColumns(onehot)


def capped_ingest(df: DataFrame, is_normal: Column, target: int, normal_frac: float, order: str = "id") -> DataFrame:
    """Scan-order rows until the per-class caps: normal target * frac, abnormal target."""
    r = ranked(df.withColumn("__normal", is_normal), ["__normal"], [order], id_bucket(order), "__rn")
    cap = F.when(F.col("__normal"), F.lit(int(target * normal_frac))).otherwise(F.lit(target))
    return r.filter(F.col("__rn") <= cap).drop("__rn", "__normal")


def skip_existing(incoming: DataFrame, existing: DataFrame, name: str = "fname") -> DataFrame:
    return incoming.join(existing.select(name).distinct(), name, "left_anti")


def fail_visible_counts(df: DataFrame, source: str, bad: Column) -> DataFrame:
    """Per source: rows seen and rows that could not be read; sources without failures show 0."""
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_unreadable"))


def missing_references(sidecar: DataFrame, files: DataFrame, name: str = "fname", examples: int = 3) -> DataFrame:
    """Count of sidecar names without a file and the first few of them."""
    lost = sidecar.select(name).distinct().join(files.select(name).distinct(), name, "left_anti")
    first = lost.orderBy(name).limit(examples)
    return lost.agg(F.count(F.lit(1)).alias("n_missing")).withColumn(
        "examples", first.agg(F.array_join(F.array_sort(F.collect_list(name)), "|")).scalar()
    )


def assert_references_exist(sidecar: DataFrame, files: DataFrame, name: str = "fname") -> None:
    row = missing_references(sidecar, files, name).first()
    if row["n_missing"]:
        raise ValueError(f"{row['n_missing']} referenced files are missing, e.g. {row['examples']}")


def unique_paths(df: DataFrame, order: str = "id", **overrides: Mapping[str, object]) -> DataFrame:
    """One row per path (first in order), then the given columns overwritten."""
    others = [c for c in df.columns if c != "path"]
    first = df.groupBy("path").agg(F.min_by(F.struct(*others), F.col(order)).alias("__r")).select("path", "__r.*")
    for name, value in overrides.items():
        first = first.withColumn(name, F.lit(value))
    return first


def upsert_case(log: DataFrame, key: str = "id", order: Sequence[str] = ("seq",)) -> DataFrame:
    """Latest version per key of an append log."""
    others = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__r")).select(key, "__r.*")


def history_list(cases: DataFrame, created: str = "created_at", ident: str = "id", n: int = 50) -> DataFrame:
    """The newest n cases."""
    return cases.orderBy(F.col(created).desc(), F.col(ident).desc()).limit(n)


def corpus_counts(corpus: DataFrame, embedding: str = "v", label: str = "label") -> DataFrame:
    return corpus.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.coalesce(F.size(embedding), F.lit(0)) > 0).alias("embedded"),
        F.count_if(F.col(label) == 1).alias("positive"),
        F.count_if(F.col(label) == 0).alias("negative"),
    )


def session_export(runs: DataFrame) -> DataFrame:
    """Nested run rows -> flat export rows; only named fields of members and neighbours survive."""
    members = F.transform(
        "members", lambda m: F.struct(m["id"].alias("id"), m["tb_prob"].alias("tb_prob"), m["provider"].alias("provider"))
    )
    return runs.select(
        "id", "image_name", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        "verdict", "confidence", "auto_abstained", "fallback_rate", members.alias("members"),
    )


def session_fallback_rate(runs: DataFrame) -> DataFrame:
    return runs.agg(F.coalesce(F.avg("fallback_rate"), F.lit(0.0)).alias("session_fallback_rate"))
