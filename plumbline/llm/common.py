"""Helpers shared by the corpus operators.

The operators work on the project's persisted cases: `id`, `rationale` (the free
text of an adjudication), `source`, `label` and `embedding`. Every operator takes
only the columns it names, so further columns of a table never clash.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.session import settle

__all__ = ["SPACES", "bounded_batches", "gapless_rank", "settle", "shared_folder", "spread_count", "words_of"]

#: ASCII white space, as one Java character class.
SPACES = r"[\x20\x09-\x0D]+"

ROWS_PER_BUCKET = 1_000
MAX_BUCKETS = 4_096
BATCH_BYTES = 8 << 20


def words_of(text: Column) -> Column:
    """Words of a whole text: runs of anything but ASCII white space; NULL has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """A new folder for intermediate tables under the one the cluster names in spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="run-")
    return f"{named.rstrip('/')}/tables-{uuid.uuid4().hex}"


def spread_count(rows: int) -> int:
    """Buckets that keep the largest key of `rows` rows at about a thousand rows each."""
    return max(1, min(MAX_BUCKETS, rows // ROWS_PER_BUCKET))


def bounded_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of some megabytes, not by rows: a row may be a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def gapless_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, buckets: int) -> DataFrame:
    """Number the rows of each key 0, 1, 2, ... without one task per key.

    Rows of a key are dealt over `buckets` by a hash of `order`; a bucket starts
    where the counts of the key's lower buckets end. `order` should identify a row:
    rows equal in it may swap numbers, which leaves equal rows equal.
    """
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    ranked = dealt.withColumn("__in", F.row_number().over(inside) - 1)
    out = ranked.join(starts, [*keys, "__bucket"])
    return out.withColumn(name, (F.col("__start") + F.col("__in")).cast("long")).drop("__bucket", "__start", "__in")
