"""Readers and writers: file listings, label CSVs, manifests, ledgers and checkpoints of partial work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plumbline.operators.ingest import is_image

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("label", T.IntegerType(), True),
        T.StructField("source", T.StringType(), True),
        T.StructField("patient_id", T.StringType(), True),
        T.StructField("bbox", T.StringType(), True),
        T.StructField("split", T.StringType(), True),
    ]
)


def scan_file_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Recursive listing of image files under root: path, relative path, length.

    The content column is never selected, so file bytes are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = root.rstrip("/") + "/"
    rel = F.substring_index(F.col("path"), prefix, -1)
    return files.select("path", rel.alias("rel"), "length", "modificationTime").filter(is_image("path"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest CSV with a fixed schema; a malformed file fails instead of being guessed."""
    return spark.read.csv(path, header=True, schema=MANIFEST_SCHEMA, mode="FAILFAST", enforceSchema=True)


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with an order that survives splitting: file, split start, position in the split."""
    lines = spark.read.text(path)
    return lines.select(
        F.col("value").alias("line"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("at"),
        ).alias("line_no"),
    )


def write_tables(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Parquet, CSV, JSON or ORC sink; role manifests use partition_by=('role',)."""
    writer = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", "true").csv(path)
    else:
        writer.format(fmt).save(path)


def write_once(df: DataFrame, path: str) -> None:
    """Locked one-row tables: a second write to the same place fails."""
    write_tables(df, path, "json", mode="errorifexists")


def append_audit_log(df: DataFrame, path: str) -> None:
    """Append ledger rows stamped with the write time."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


def write_increment(df: DataFrame, path: str, part: str, key: str = "part") -> bool:
    """Persist one finished part (dose, source, batch) under its own partition.

    A part that is already complete is skipped, so an interrupted sweep resumes.
    Returns whether it was written.
    """
    spark = df.sparkSession
    target = f"{path}/{key}={part}"
    jvm = spark._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    if marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        return False
    df.write.mode("overwrite").parquet(target)
    return True


def read_increments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
