"""Manifests, labels and case records."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.hashing import unit
from plumbline.operators import ingest as I
from plumbline.plans.common import rounded
from plumbline.plans.registry import query
from plumbline.plans.views import su

IMG = "regexp_matches(path, '\\.(png|jpe?g|bmp)$', 'i')"
REL = "regexp_replace(path, '^[^/]*/', '')"
RELS = f"rels AS (SELECT page_id, source, path, lower({REL}) AS rel FROM manifest WHERE {IMG})"


def rels(v):
    return v.manifest.filter(I.is_image("path")).select(
        "page_id", "source", "path", I.relative_to_first("path").alias("rel"))


@query("scan_file_manifest", f"SELECT page_id, source, path FROM manifest WHERE {IMG}", "manifest")
def _scan(v):
    return v.manifest.filter(I.is_image("path")).select("page_id", "source", "path")


LABEL = """CASE WHEN rel LIKE '%mask%' THEN NULL WHEN rel LIKE '%tubercul%' OR regexp_matches(rel, '_1\\.(png|jpe?g|bmp)$')
OR list_contains(string_split(rel, '/'), 'tb') THEN 1 WHEN list_has_any(string_split(rel, '/'), ['normal', 'healthy'])
OR regexp_matches(rel, '_0\\.(png|jpe?g|bmp)$') THEN 0 END"""


@query("label_from_path", f"SELECT page_id, {LABEL} AS label FROM rels", "manifest", RELS)
def _label(v):
    return rels(v).select("page_id", I.label_from_path("rel").alias("label"))


@query("label_from_folder_tokens", """SELECT page_id, CASE WHEN rel LIKE '%mask%' THEN NULL WHEN rel LIKE '%tb%' OR rel LIKE '%tubercul%' THEN 1
WHEN rel LIKE '%normal%' OR rel LIKE '%healthy%' THEN 0 END AS label FROM rels""", "manifest", RELS)
def _tokens(v):
    return rels(v).select("page_id", I.label_from_folder_tokens("rel").alias("label"))


@query("label_from_prefix", "SELECT page_id, CASE WHEN rel LIKE 'tb/%' THEN 1 WHEN rel LIKE 'normal/%' THEN 0 END AS label FROM rels",
       "manifest", RELS)
def _prefix(v):
    return rels(v).select("page_id", I.label_from_prefix("rel").alias("label"))


@query("patient_id_from_name", """SELECT page_id, source || '_' || regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1),
'\\.[^.]*$', ''), '_[01]$', '') AS patient_id FROM rels""", "manifest", RELS)
def _patient(v):
    return rels(v).select("page_id", I.patient_id("source", "path").alias("patient_id"))


ANN = f"""ann AS (SELECT 'img' || id || '.png' AS fname, CASE WHEN {su('tgt', 'id')} < 0.4e0 THEN 'no_tb' ELSE 'tb' END AS target,
 CASE WHEN {su('kind', 'id', 'box')} < 0.4e0 THEN 'active_tb' WHEN {su('kind', 'id', 'box')} < 0.7e0 THEN 'latent_tb' ELSE 'none' END AS kind,
 x, y, w, h FROM boxes),
files AS (SELECT 'img' || doc_id || '.png' AS fname, CASE WHEN doc_id % 13 = 0 THEN 'base/test/img' ELSE 'base/train/img' END || doc_id || '.png' AS path
 FROM documents WHERE doc_id % 10 <> 0)"""


def annotations(v):
    k = unit("kind", "id", "box")
    return v.boxes.select(
        F.concat(F.lit("img"), "id", F.lit(".png")).alias("fname"),
        F.when(unit("tgt", "id") < 0.4, "no_tb").otherwise("tb").alias("target"),
        F.when(k < 0.4, "active_tb").when(k < 0.7, "latent_tb").otherwise("none").alias("kind"),
        F.struct("x", "y", "w", "h").alias("box"))


def files(v):
    name = F.concat(F.lit("img"), "doc_id", F.lit(".png"))
    folder = F.when(F.col("doc_id") % 13 == 0, "base/test/").otherwise("base/train/")
    return v.table("documents").filter("doc_id % 10 <> 0").select(name.alias("fname"), F.concat(folder, name).alias("path"))


@query("equi_join_name", "SELECT fname, path, kind, x FROM ann JOIN files USING (fname)", "boxes", ANN)
def _equi(v):
    return annotations(v).join(files(v), "fname").select("fname", "path", "kind", F.col("box.x").alias("x"))


@query("collapse_annotations", """SELECT fname, path, CASE WHEN active OR target = 'no_tb' THEN 'binary' ELSE 'probe' END AS role,
CASE WHEN active THEN 1 WHEN target = 'no_tb' THEN 0 ELSE 1 END AS label, CASE WHEN active THEN n_active ELSE 0 END AS n_boxes,
CASE WHEN active THEN sx END AS sum_x FROM (
SELECT fname, path, bool_or(kind = 'active_tb') AS active, bool_or(kind = 'latent_tb') AS latent, min(target) AS target,
count(*) FILTER (kind = 'active_tb')::INT AS n_active, sum(x) FILTER (kind = 'active_tb') AS sx
FROM ann JOIN files USING (fname) WHERE path NOT LIKE '%/test/%' GROUP BY ALL) WHERE active OR target = 'no_tb' OR latent""", "boxes", ANN)
def _collapse(v):
    out = I.collapse_annotations(annotations(v), files(v))
    total = F.aggregate("boxes", F.lit(0.0), lambda a, b: a + b["x"])
    return out.select("fname", "path", "role", "label", F.size("boxes").alias("n_boxes"),
                      F.when(F.size("boxes") > 0, total).alias("sum_x"))


@query("unmatched_annotations", "SELECT fname, count(*) AS n_rows FROM ann WHERE fname NOT IN (SELECT fname FROM files) GROUP BY fname",
       "boxes", ANN)
def _unmatched(v):
    return I.unmatched_annotations(annotations(v), files(v))


@query("route_roles", """SELECT role, count(*) AS n, count(DISTINCT source) AS n_sources FROM (SELECT source,
CASE WHEN source IN ('src3', 'src7') OR source LIKE '%9' THEN 'external_holdout' WHEN source LIKE '%4' THEN 'excluded' ELSE 'train' END AS role
FROM documents) GROUP BY role""")
def _route(v):
    s = F.col("source")
    held = s.isin("src3", "src7") | F.endswith(s, F.lit("9"))
    out = I.route_roles(v.table("documents").select("source"), F.endswith(s, F.lit("4")), held)
    return out.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("n_sources"))


LINES = """lines AS (SELECT doc_id AS line_no, CASE WHEN doc_id % 50 = 0 THEN 'FileName,label' ELSE ' some\\dir/img' || (doc_id % 300) || '.png , ' ||
(['0','1','2','x'])[(doc_id % 11 % 4) + 1] END AS line FROM documents),
lab AS (SELECT filename, arg_max(raw, line_no)::INT AS label FROM (SELECT line_no, regexp_extract(trim(split_part(trim(line), ',', 1)), '([^/\\\\]*)$', 1) AS filename,
trim(split_part(trim(line), ',', 2)) AS raw FROM lines) WHERE raw IN ('0', '1') GROUP BY filename)"""


def label_lines(v):
    raw = F.element_at(F.array(*map(F.lit, "012x")), (F.col("doc_id") % 11 % 4 + 1).cast("int"))
    line = F.when(F.col("doc_id") % 50 == 0, "FileName,label").otherwise(
        F.concat(F.lit(" some\\dir/img"), F.col("doc_id") % 300, F.lit(".png , "), raw))
    return v.table("documents").select(F.col("doc_id").alias("line_no"), line.alias("line"))


@query("read_label_csv", "SELECT filename, label FROM lab", "", LINES)
def _csv(v):
    return I.read_label_lines(label_lines(v))


@query("match_labels_to_files", """SELECT count(path) AS imported, count(*) FILTER (path IS NULL) AS skipped_no_match
FROM lab LEFT JOIN files ON filename = fname""", "boxes", LINES + ", " + ANN)
def _match(v):
    return I.match_counts(I.match_labels_to_files(I.read_label_lines(label_lines(v)), files(v)))


@query("expand_findings", """SELECT id, a || '|' || b AS findings, 2 AS n_findings, (a = 'No Finding' OR b = 'No Finding')::INT AS "No_Finding",
(a = 'Fibrosis' OR b = 'Fibrosis')::INT AS "Fibrosis" FROM (SELECT doc_id AS id,
CASE WHEN doc_id % 17 < 15 THEN names[(doc_id % 17) + 1] ELSE (doc_id % 17)::VARCHAR END AS a, names[(doc_id % 15) + 1] AS b FROM documents,
(SELECT ['No Finding','Atelectasis','Cardiomegaly','Effusion','Infiltration','Mass','Nodule','Pneumonia','Pneumothorax','Consolidation','Edema',
'Emphysema','Fibrosis','Pleural_Thickening','Hernia'] AS names))""")
def _expand(v):
    idx = F.array((F.col("doc_id") % 17).cast("int"), (F.col("doc_id") % 15).cast("int"))
    d = v.table("documents").select(F.col("doc_id").alias("id"), idx.alias("idx"))
    return I.expand_findings(d, "idx").select("id", "findings", "n_findings", "No_Finding", "Fibrosis")


@query("capped_ingest", """SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY label = 0 ORDER BY id) AS rn FROM scored)
WHERE rn <= CASE WHEN label = 0 THEN 40 ELSE 200 END""", "scored")
def _capped(v):
    return I.capped_ingest(v.scored.select("id", "label"), F.col("label") == 0, 200, 0.2)


@query("skip_existing", "SELECT fname, kind, x FROM ann WHERE fname NOT IN (SELECT fname FROM files)", "boxes", ANN)
def _skip(v):
    return I.skip_existing(annotations(v), files(v)).select("fname", "kind", F.col("box.x").alias("x"))


@query("fail_visible_counts", """SELECT source, count(*) AS n_rows, count(*) FILTER (html NOT LIKE '<!DOCTYPE html>%') AS n_unreadable
FROM manifest GROUP BY source""", "manifest")
def _fail(v):
    return I.fail_visible_counts(v.manifest, "source", ~F.startswith("html", F.lit("<!DOCTYPE html>")))


@query("assert_references_exist", """SELECT count(*) AS n_missing, (SELECT string_agg(fname, '|' ORDER BY fname) FROM (
SELECT DISTINCT fname FROM ann WHERE fname NOT IN (SELECT fname FROM files) ORDER BY fname LIMIT 3)) AS examples
FROM (SELECT DISTINCT fname FROM ann WHERE fname NOT IN (SELECT fname FROM files))""", "boxes", ANN)
def _refs(v):
    return I.missing_references(annotations(v), files(v))


@query("unique_paths", """SELECT path, min(id) AS id, arg_min(lang, id) AS lang, 'merged' AS source, 1 AS label FROM (
SELECT doc_id AS id, lang, 'p/' || (doc_id % 137) AS path FROM documents) GROUP BY path""")
def _unique(v):
    d = v.table("documents").select(F.col("doc_id").alias("id"), "lang", "source",
                                    F.concat(F.lit("p/"), F.col("doc_id") % 137).alias("path"))
    return I.unique_paths(d, source="merged", label=1)


@query("upsert_case", """SELECT run_id AS id, max(seq) AS seq, arg_max(stage, seq) AS stage, arg_max(status, seq) AS status FROM runs GROUP BY run_id""",
       "runs")
def _upsert(v):
    return I.upsert_case(v.runs.select(F.col("run_id").alias("id"), "seq", "stage", "status"))


@query("history_list", "SELECT event_id AS id, ts AS created_at, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def _history(v):
    cases = v.table("events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "event_type")
    return I.history_list(cases)


@query("corpus_counts", f"""SELECT count(*) AS total, count(*) FILTER (v IS NOT NULL) AS embedded, count(*) FILTER (label = 1) AS positive,
count(*) FILTER (label = 0) AS negative FROM (SELECT label, CASE WHEN {su('emb', 'id')} < 0.8e0 THEN v END AS v FROM vecs)""", "vecs")
def _counts(v):
    return I.corpus_counts(v.vecs.withColumn("v", F.when(unit("emb", "id") < 0.8, F.col("v"))))


NESTED = f"""nested AS (SELECT id, CASE WHEN {su('vd', 'id')} < 0.9e0 THEN lang END AS verdict, {su('fb', 'id')} AS fallback_rate FROM scored)"""


def nested_runs(v):
    members = v.member_probs.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("member").alias("id"), F.col("prob").alias("tb_prob"), F.lit("local").alias("provider"),
            F.when(F.col("member") == "vlm", unit("unc", "id")).alias("uncertainty")))).alias("members"))
    return v.scored.join(members, "id", "left").select(
        "id", F.concat(F.lit("img"), "id").alias("image_name"), F.timestamp_seconds(F.col("id") * 3600).alias("created_at"),
        F.when(unit("vd", "id") < 0.9, F.col("lang")).alias("verdict"), F.col("label").alias("label"),
        F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("boolean").alias("auto_abstained"),
        unit("fb", "id").alias("fallback_rate"), "members")


@query("session_export", """SELECT n.id, strftime(make_timestamp(n.id * 3600000000), '%Y-%m-%dT%H:%M:%S.') || '000Z' AS timestamp, verdict,
round(fallback_rate, 6) AS fallback_rate, m AS members FROM nested n LEFT JOIN (SELECT id, string_agg(member || ':' || round(prob, 4), ',' ORDER BY member) AS m
FROM member_probs GROUP BY id) USING (id)""", "scored member_probs", NESTED)
def _export(v):
    out = I.session_export(nested_runs(v))
    text = F.array_join(F.transform("members", lambda m: F.concat(m["id"], F.lit(":"), F.round(m["tb_prob"], 4))), ",")
    return rounded(out.select("id", "timestamp", "verdict", "fallback_rate", text.alias("members")), "fallback_rate")


@query("session_fallback_rate", "SELECT round(coalesce(avg(fallback_rate), 0), 6) AS session_fallback_rate FROM nested", "scored", NESTED)
def _sess(v):
    return rounded(I.session_fallback_rate(nested_runs(v)), "session_fallback_rate")
