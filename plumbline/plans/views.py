"""Views derived from the shared tables, each stated once per engine.

Every class method is the Spark plan; the entry of the same name in SQL_VIEWS is
the DuckDB text.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions.hashing import unit
from plumbline.functions.maths import sigmoid


def su(seed: str, *keys: str) -> str:
    """SQL text of the keyed draw unit(seed, *keys)."""
    parts = ", ".join([f"'{seed}'", *keys])
    return f"(('0x' || substr(md5(concat_ws('|', {parts})), 1, 8))::BIGINT / 4294967296::DOUBLE)"


def ssig(z: str) -> str:
    """SQL text of the stable sigmoid."""
    return f"(CASE WHEN ({z}) >= 0 THEN 1e0/(1e0+exp(-({z}))) ELSE exp({z})/(1e0+exp({z})) END)"


SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "scored": (
        (),
        f"""SELECT d.doc_id AS id, d.source, d.lang, 's' || (d.doc_id % 4) AS site, l.quality AS label,
        2e0*(l.quality::DOUBLE - 0.5e0) + 4e0*({su('s', 'd.doc_id')} - 0.5e0) AS logit, d.doc_id // 3 AS grp
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "scored_b": (
        ("scored",),
        f"SELECT id, source, lang, site, label, logit + 2e0*({su('b', 'id')} - 0.5e0) AS logit, grp FROM scored",
    ),
    "member_probs": (
        ("scored",),
        f"""SELECT id, member, label, prob FROM (
        SELECT id, label, member, {ssig(f"logit + 2e0*({su('noise', 'id', 'member')} - 0.5e0)")} AS prob
        FROM scored CROSS JOIN (VALUES ('tb'), ('general'), ('vlm')) m(member)) t
        WHERE {su('miss', 'id', 'member')} >= 0.1e0""",
    ),
    "findings": (
        (),
        """SELECT id, unnest(CASE WHEN len(fs) = 0 THEN ['no_finding'] ELSE fs END) AS finding FROM (
        SELECT d.doc_id AS id, list_filter([
          CASE WHEN l.toxic = 1 THEN 'toxic' END, CASE WHEN d.lang <> 'en' THEN 'lang_' || d.lang END,
          CASE WHEN d.n_chars < 400 THEN 'short' END, CASE WHEN d.n_chars > 3000 THEN 'long' END],
          lambda x: x IS NOT NULL) AS fs
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id) t""",
    ),
    "signals": (
        (),
        f"""SELECT d.doc_id AS id, d.source, d.lang, {su('tb', 'd.doc_id')} AS tb_prob,
        {su('si', 'd.doc_id')} AS s_inactive, {su('box', 'd.doc_id')} AS box_max,
        {su('path', 'd.doc_id')} AS path_max FROM documents d""",
    ),
    "manifest": (
        (),
        """SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS source,
        regexp_extract(url, '^https?://([^/]+)', 1) || '/' ||
        (['normal','tb','mask','tuberculosis_set','Healthy','misc'])[(page_id % 6) + 1] || '/p' || page_id ||
        (['_0','_1',''])[(page_id % 7 % 3) + 1] || '.' || (['png','jpg','JPEG','bmp','txt'])[(page_id % 5) + 1] AS path,
        html FROM pages""",
    ),
    "roled": (
        (),
        f"""SELECT d.doc_id AS id, d.text, d.source, coalesce(l.quality, 0) AS label,
        CASE WHEN {su('role', 'd.doc_id')} < 0.8e0 THEN 'train' ELSE 'holdout' END AS role
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "vecs": (
        (),
        """SELECT vec_id AS id, (label < 3)::INT AS label, 's' || (vec_id % 4) AS source, vec_id // 2 AS grp,
        embedding AS v FROM embeddings""",
    ),
    "cells": (
        ("vecs",),
        """SELECT id, label, (pos - 1)::INT AS pos, ((pos - 1) // 8)::INT AS gy, ((pos - 1) % 8)::INT AS gx,
        v[pos]::DOUBLE AS x FROM vecs, unnest(range(1, 65)) r(pos)""",
    ),
    "boxes": (
        (),
        f"""SELECT doc_id AS id, b AS box, floor({su('x', 'doc_id', 'b')}*900e0) AS x, floor({su('y', 'doc_id', 'b')}*900e0) AS y,
        30e0 + floor({su('w', 'doc_id', 'b')}*300e0) AS w, 30e0 + floor({su('h', 'doc_id', 'b')}*300e0) AS h,
        floor({su('cy', 'doc_id')}*200e0)::BIGINT AS y0, 1024 - floor({su('dy', 'doc_id')}*200e0)::BIGINT AS y1,
        floor({su('cx', 'doc_id')}*300e0)::BIGINT AS x0, 1024 - floor({su('dx', 'doc_id')}*300e0)::BIGINT AS x1
        FROM documents, unnest([0, 1]) t(b) WHERE {su('nb', 'doc_id')}*2e0 > b""",
    ),
    "runs": (
        (),
        """SELECT user_id AS run_id, event_id AS seq, ts, CASE event_type WHEN 'click' THEN 'stage_status'
        WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'finish' WHEN 'signup' THEN 'fallback_fired'
        ELSE 'ensemble_done' END AS kind,
        's' || (json_extract_string(props, '$.k')::BIGINT % 7) AS stage,
        (['pending','running','done','fallback','failed'])[(event_id % 5) + 1] AS status,
        CASE WHEN event_id % 3 = 0 THEN 'note ' || event_id END AS note, value FROM events""",
    ),
}


def with_views(names, sql: str, ctes: str = "") -> str:
    """Prepend the definitions of the named views, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for dep in SQL_VIEWS[name][0]:
                visit(dep)
            order.append(name)

    for name in names:
        visit(name)
    members = [f"{n} AS MATERIALIZED ({SQL_VIEWS[n][1]})" for n in order]
    if ctes.strip():
        members.append(ctes.strip().rstrip(","))
    return (f"WITH RECURSIVE {', '.join(members)} " if members else "") + sql


class Views:
    """Spark side of the derived views over one table folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, str(sf_dir)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def scored(self) -> DataFrame:
        docs = self.table("documents").select("doc_id", "source", "lang")
        y = F.col("quality").cast("double")
        return docs.join(self.table("labels").select("doc_id", "quality"), "doc_id").select(
            F.col("doc_id").alias("id"),
            "source",
            "lang",
            F.concat(F.lit("s"), F.col("doc_id") % 4).alias("site"),
            F.col("quality").alias("label"),
            (2.0 * (y - 0.5) + 4.0 * (unit("s", "doc_id") - 0.5)).alias("logit"),
            F.expr("doc_id div 3").alias("grp"),
        )

    @cached_property
    def scored_b(self) -> DataFrame:
        return self.scored.withColumn("logit", F.col("logit") + 2.0 * (unit("b", "id") - 0.5))

    @cached_property
    def member_probs(self) -> DataFrame:
        each = self.scored.select("id", "label", "logit", F.explode(F.array(*map(F.lit, ("tb", "general", "vlm")))).alias("member"))
        return each.filter(unit("miss", "id", "member") >= 0.1).select(
            "id", "member", "label", sigmoid(F.col("logit") + 2.0 * (unit("noise", "id", "member") - 0.5)).alias("prob")
        )

    @cached_property
    def findings(self) -> DataFrame:
        docs = self.table("documents").select("doc_id", "lang", "n_chars")
        marks = F.array_compact(
            F.array(
                F.when(F.col("toxic") == 1, "toxic"),
                F.when(F.col("lang") != "en", F.concat(F.lit("lang_"), "lang")),
                F.when(F.col("n_chars") < 400, "short"),
                F.when(F.col("n_chars") > 3000, "long"),
            )
        )
        return docs.join(self.table("labels").select("doc_id", "toxic"), "doc_id").select(
            F.col("doc_id").alias("id"),
            F.explode(F.when(F.size(marks) == 0, F.array(F.lit("no_finding"))).otherwise(marks)).alias("finding"),
        )

    @cached_property
    def signals(self) -> DataFrame:
        return self.table("documents").select(
            F.col("doc_id").alias("id"),
            "source",
            "lang",
            unit("tb", "doc_id").alias("tb_prob"),
            unit("si", "doc_id").alias("s_inactive"),
            unit("box", "doc_id").alias("box_max"),
            unit("path", "doc_id").alias("path_max"),
        )

    @cached_property
    def manifest(self) -> DataFrame:
        host = F.regexp_extract("url", "^https?://([^/]+)", 1)

        def pick(values, index):
            return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))

        pid = F.col("page_id")
        return self.table("pages").select(
            "page_id",
            host.alias("source"),
            F.concat(
                host,
                F.lit("/"),
                pick(("normal", "tb", "mask", "tuberculosis_set", "Healthy", "misc"), pid % 6),
                F.lit("/p"),
                pid,
                pick(("_0", "_1", ""), pid % 7 % 3),
                F.lit("."),
                pick(("png", "jpg", "JPEG", "bmp", "txt"), pid % 5),
            ).alias("path"),
            "html",
        )

    @cached_property
    def roled(self) -> DataFrame:
        return self.with_roles(self.table("documents").select("doc_id", "text", "source"))

    def with_roles(self, docs: DataFrame) -> DataFrame:
        """Rows of doc_id and further columns with label and role; a join of wide rows exchanges them."""
        return docs.join(self.table("labels").select("doc_id", "quality"), "doc_id", "left").select(
            F.col("doc_id").alias("id"),
            *[c for c in docs.columns if c != "doc_id"],
            F.coalesce("quality", F.lit(0)).alias("label"),
            F.when(unit("role", "doc_id") < 0.8, "train").otherwise("holdout").alias("role"),
        )

    @cached_property
    def vecs(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("id"),
            (F.col("label") < 3).cast("int").alias("label"),
            F.concat(F.lit("s"), F.col("vec_id") % 4).alias("source"),
            F.expr("vec_id div 2").alias("grp"),
            F.col("embedding").alias("v"),
        )

    @cached_property
    def cells(self) -> DataFrame:
        return self.vecs.select("id", "label", F.posexplode("v").alias("pos", "x")).select(
            "id",
            "label",
            "pos",
            F.expr("cast(pos div 8 as int)").alias("gy"),
            (F.col("pos") % 8).alias("gx"),
            F.col("x").cast("double").alias("x"),
        )

    @cached_property
    def boxes(self) -> DataFrame:
        docs = self.table("documents").select("doc_id")
        each = docs.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("b")).filter(
            unit("nb", "doc_id") * 2.0 > F.col("b")
        )

        def grid(seed, span, *keys):
            return F.floor(unit(seed, *keys) * float(span))

        return each.select(
            F.col("doc_id").alias("id"),
            F.col("b").alias("box"),
            grid("x", 900, "doc_id", "b").cast("double").alias("x"),
            grid("y", 900, "doc_id", "b").cast("double").alias("y"),
            (30.0 + grid("w", 300, "doc_id", "b")).alias("w"),
            (30.0 + grid("h", 300, "doc_id", "b")).alias("h"),
            grid("cy", 200, "doc_id").alias("y0"),
            (F.lit(1024) - grid("dy", 200, "doc_id")).alias("y1"),
            grid("cx", 300, "doc_id").alias("x0"),
            (F.lit(1024) - grid("dx", 300, "doc_id")).alias("x1"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        return run_events(self.table("events"))


def run_events(events: DataFrame) -> DataFrame:
    """Event rows as run events; the same select serves batch and stream."""
    kind = F.col("event_type")
    return events.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("seq"),
        "ts",
        F.when(kind == "click", "stage_status")
        .when(kind == "error", "error")
        .when(kind == "purchase", "finish")
        .when(kind == "signup", "fallback_fired")
        .otherwise("ensemble_done")
        .alias("kind"),
        F.concat(F.lit("s"), F.get_json_object("props", "$.k").cast("bigint") % 7).alias("stage"),
        F.element_at(
            F.array(*map(F.lit, ("pending", "running", "done", "fallback", "failed"))),
            (F.col("event_id") % 5 + 1).cast("int"),
        ).alias("status"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("note "), F.col("event_id"))).alias("note"),
        "value",
    )
