"""Streaming folds over run events and scores.

The reducer is a set of order-insensitive aggregates keyed by event sequence, so
late and re-ordered events give the same state and batch and stream share code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import constants as K
from plumbline.functions.maths import tempered
from plumbline.operators.rules import band_verdict, evidence_fires, raised, scar_fires


def _last(value: Column, when: Column) -> Column:
    """Value of the highest sequence number among rows where `when` holds."""
    return F.max_by(F.when(when, value), F.when(when, F.col("seq")))


def fold_stages(events: DataFrame) -> DataFrame:
    """Per (run, stage): last status, last present note, sticky fallback flag, last error.

    Reads run_id, stage, seq, kind, status, note.
    """
    kind = F.col("kind")
    moved = kind == "stage_status"
    fell = (kind == "fallback_fired") | (moved & (F.col("status") == "fallback"))
    return events.groupBy("run_id", "stage").agg(
        _last(F.col("status"), moved).alias("status"),
        _last(F.col("note"), moved & (F.length("note") > 0)).alias("note"),
        F.coalesce(F.bool_or(fell), F.lit(False)).alias("fell_back"),
        _last(F.coalesce(F.col("note"), F.lit("error")), kind == "error").alias("last_error"),
        F.max("seq").alias("last_seq"),
    )


def fold_runs(events: DataFrame) -> DataFrame:
    """Per run: halted is terminal, a finish keeps it; else done after a finish, else running."""
    kind = F.col("kind")
    halted = F.coalesce(F.bool_or(kind == "halted"), F.lit(False))
    finished = F.coalesce(F.bool_or(kind == "finish"), F.lit(False))
    return events.groupBy("run_id").agg(
        F.when(halted, "halted").when(finished, "done").otherwise("running").alias("status"),
        F.count(F.lit(1)).alias("n_events"),
        F.max("seq").alias("last_seq"),
    )


def score_and_decide(scores: DataFrame, t: float = K.LOCKED_T, thr: float = K.LOCKED_THR, low: float = K.LOCKED_LOW) -> DataFrame:
    """Locked calibration and rule chain on arriving rows (id, logit, s_inactive, box_max, path_max); stateless."""
    p = tempered("logit", t)
    base = scores.withColumn("p", p).withColumn("band", F.lower(band_verdict("p", thr, low)))
    engine = F.when(F.col("p") >= thr, "tb").otherwise("no_tb")
    staged = base.withColumn("__v", engine)
    staged = staged.withColumn("__v", raised("__v", scar_fires("__v", "p", "s_inactive")))
    return staged.withColumn("verdict", raised("__v", evidence_fires("__v", "p", "box_max", "path_max"))).drop("__v")


def provider_status(events: DataFrame, provider: str = "provider", state: str = "state", order: str = "ts") -> DataFrame:
    """Last state per provider."""
    return events.groupBy(provider).agg(
        F.max_by(state, F.struct(order, "seq")).alias("state"), F.max(order).alias("at")
    )


def finished_runs(events: DataFrame) -> DataFrame:
    """Rows that close a run; append them to the history sink."""
    return events.filter(F.col("kind") == "finish").select("run_id", "seq", "ts", F.col("note").alias("summary"))


def progress(events: DataFrame, total: int) -> DataFrame:
    """Done, share, rate per second and seconds left, from event times."""
    done = F.count_if(F.col("kind") == "finish")
    at = F.col("ts").cast("timestamp")
    span = F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))
    rate = F.when(span > 0, done / (span / F.lit(1e6)))
    return events.agg(
        done.alias("done"),
        (done / F.lit(float(total))).alias("share"),
        rate.alias("rate"),
        F.when(rate > 0, (F.lit(total) - done) / rate).alias("eta_seconds"),
    )


def start_fold(events: DataFrame, path: str, checkpoint: str, fold=fold_stages):
    """Keep the folded state of a stream as a table, rewritten per micro-batch (update semantics)."""

    def put(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return (
        fold(events)
        .writeStream.outputMode("complete")
        .foreachBatch(put)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_append(rows: DataFrame, path: str, checkpoint: str):
    """Append sink for stateless rows (verdicts, finished runs)."""
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
