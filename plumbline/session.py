"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

# Runtime re-planning does the sizing: partitions are coalesced to the advisory
# size after each shuffle, and a join partition that is both large and far above
# the median is split across tasks.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # checkpoints go with the frames that read them; else the shared folder only grows
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

#: A scan is dealt anew if its fullest split holds this many times a core's share of the rows.
UNEVEN = 1.5
TASKS_PER_SLOT = 4


def build_session(cpus: str | int = "*", app: str = "plumbline", memory: str = "12g") -> SparkSession:
    """Local session for tests and the bench; on a cluster use the submitted one."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterated frame with a reliable checkpoint.

    The folder is the shared one the cluster names in spark.checkpoint.dir. Only
    when the session names none (local tests) a temporary folder is set.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="run-"))
    return df.checkpoint(eager=True)


def spread_small(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan over the cluster before heavy per-row work, where its splits do not.

    Splits are cut by file size, but a row group is read by one of them: a large file of one row group has
    many splits and all its rows in one task. So the rows of every split are counted, which reads no wide
    column. An input whose fullest split holds about a core's share or less is left alone; any other is exchanged once,
    four tasks to a core.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        held = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"))
        most, rows = held.agg(F.max("n"), F.sum("n")).first()
        if not rows or most * slots < UNEVEN * rows:
            return df
    return df.repartition(TASKS_PER_SLOT * slots, *df.columns)
