"""Streaming operators, run to completion over the event table.

Each query starts a stream over the parquet table, waits for it and returns the
sink's table. Checkpoints and sinks live in the session's shared folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.hashing import unit
from plumbline.plans.common import rounded
from plumbline.plans.registry import query
from plumbline.plans.views import run_events, su
from plumbline.streaming import runs as R


def workspace(spark) -> str:
    """A fresh folder under the shared checkpoint location (a temporary one only in local tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="run-")
    return f"{named}/stream-{uuid.uuid4().hex}"


def stream(v, name: str) -> DataFrame:
    """The table as a file stream."""
    schema = v.table(name).schema
    return v.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(v.sf_dir)


def finish(v, query_, path: str) -> DataFrame:
    query_.awaitTermination()
    return v.spark.read.parquet(path)


@query("stream_run_state", """SELECT run_id, stage, arg_max(status, seq) FILTER (kind = 'stage_status') AS status,
arg_max(note, seq) FILTER (kind = 'stage_status' AND note IS NOT NULL) AS note,
bool_or(kind = 'fallback_fired' OR kind = 'stage_status' AND status = 'fallback') AS fell_back,
arg_max(coalesce(note, 'error'), seq) FILTER (kind = 'error') AS last_error, max(seq) AS last_seq FROM runs GROUP BY run_id, stage""", "runs")
def _state(v):
    at = workspace(v.spark)
    return finish(v, R.start_fold(run_events(stream(v, "events")), f"{at}/out", f"{at}/ckpt"), f"{at}/out")


@query("stream_run_status", """SELECT run_id, CASE WHEN bool_or(kind = 'finish') THEN 'done' ELSE 'running' END AS status, count(*) AS n_events, max(seq) AS last_seq
FROM runs GROUP BY run_id""", "runs")
def _status(v):
    at = workspace(v.spark)
    return finish(v, R.start_fold(run_events(stream(v, "events")), f"{at}/out", f"{at}/ckpt", R.fold_runs), f"{at}/out")


def arriving(events: DataFrame) -> DataFrame:
    i = F.col("event_id").alias("id")
    return events.select(
        i, (8.0 * (unit("lg", "event_id") - 0.5)).alias("logit"), unit("si", "event_id").alias("s_inactive"),
        unit("box", "event_id").alias("box_max"), unit("path", "event_id").alias("path_max"))


ARRIVE = f"""arrive AS (SELECT id, p, s_inactive, box_max, path_max, CASE WHEN p >= 0.6104530692100525e0 THEN 'tb' ELSE 'no_tb' END AS v0 FROM (
SELECT event_id AS id, 1e0/(1e0+exp(-(8e0*({su('lg', 'event_id')}-0.5e0))/1.5914955557015147e0)) AS p, {su('si', 'event_id')} AS s_inactive,
{su('box', 'event_id')} AS box_max, {su('path', 'event_id')} AS path_max FROM events))"""


@query("stream_score_and_decide", """SELECT id, round(p, 6) AS p, CASE WHEN p >= 0.6104530692100525e0 THEN 'tb' WHEN p >= 0.2e0 THEN 'abstain' ELSE 'no_tb' END AS band,
CASE WHEN v0 = 'no_tb' AND ((p >= 0.35e0 AND p < 0.6105e0 AND s_inactive >= 0.7126e0) OR (p < 0.2e0 AND box_max >= 0.88e0 AND path_max >= 0.44e0)) THEN 'abstain' ELSE v0 END AS verdict FROM arrive""",
       "", ARRIVE)
def _decide(v):
    at = workspace(v.spark)
    rows = R.score_and_decide(arriving(stream(v, "events"))).select("id", "p", "band", "verdict")
    return rounded(finish(v, R.start_append(rows, f"{at}/out", f"{at}/ckpt"), f"{at}/out"), "p")


@query("stream_provider_status", "SELECT stage AS provider, arg_max(status, (ts, seq)) AS state, max(ts) AS at FROM runs GROUP BY stage", "runs")
def _provider(v):
    at = workspace(v.spark)

    def fold(events):
        return R.provider_status(events.withColumnRenamed("stage", "provider").withColumnRenamed("status", "state"))

    return finish(v, R.start_fold(run_events(stream(v, "events")), f"{at}/out", f"{at}/ckpt", fold), f"{at}/out")


@query("stream_history_sink", "SELECT run_id, seq, ts, note AS summary FROM runs WHERE kind = 'finish'", "runs")
def _history(v):
    at = workspace(v.spark)
    rows = R.finished_runs(run_events(stream(v, "events")))
    return finish(v, R.start_append(rows, f"{at}/out", f"{at}/ckpt"), f"{at}/out")


@query("stream_progress", """SELECT done, round(done/1e6, 6) AS share, round(done/span, 6) AS rate, round((1000000-done)/(done/span), 0) AS eta_seconds FROM (
SELECT count(*) FILTER (kind = 'finish') AS done, (epoch_us(max(ts)) - epoch_us(min(ts)))/1e6 AS span FROM runs)""", "runs")
def _progress(v):
    at = workspace(v.spark)
    out = finish(v, R.start_fold(run_events(stream(v, "events")), f"{at}/out", f"{at}/ckpt", lambda e: R.progress(e, 1_000_000)), f"{at}/out")
    return rounded(rounded(out, "share", "rate"), "eta_seconds", digits=0)


@query("run_ledger", """SELECT run_id, n_events, last_seq FROM (SELECT run_id, count(*) AS n_events, max(seq) AS last_seq FROM runs GROUP BY run_id)""", "runs")
def _ledger(v):
    from plumbline.sources.tables import append_audit_log

    at = f"{workspace(v.spark)}/ledger"
    append_audit_log(R.fold_runs(v.runs).select("run_id", "n_events", "last_seq"), at)
    return v.spark.read.schema("run_id bigint, n_events bigint, last_seq bigint").json(at)


@query("write_tables_roles", """SELECT role, count(*) AS n FROM roled GROUP BY role""", "roled")
def _roles(v):
    from plumbline.sources.tables import write_tables

    at = f"{workspace(v.spark)}/roles"
    write_tables(v.roled.select("id", "source", "label", "role"), at, partition_by=("role",))
    return v.spark.read.parquet(at).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def _written(v, fmt: str):
    """The roles written in a format and read again."""
    from plumbline.sources.tables import write_tables

    at, roles = f"{workspace(v.spark)}/{fmt}", v.roled.select("id", "source", "label", "role")
    write_tables(roles, at, fmt)
    return v.spark.read.schema(roles.schema).option("header", "true").format(fmt).load(at)


@query("write_tables_csv", "SELECT id, source, label, role FROM roled", "roled")
def _csv(v):
    return _written(v, "csv")


@query("write_tables_json", "SELECT id, source, label, role FROM roled", "roled")
def _json(v):
    return _written(v, "json")


@query("incremental_checkpoint", """SELECT part, count(*) AS n FROM (SELECT site AS part FROM scored) GROUP BY part""", "scored")
def _increment(v):
    from plumbline.sources.tables import read_increments, write_increment

    at = f"{workspace(v.spark)}/parts"
    for part in ("s0", "s1", "s2", "s3"):
        write_increment(v.scored.filter(F.col("site") == part).select("id", "logit"), at, part)
    return read_increments(v.spark, at).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


