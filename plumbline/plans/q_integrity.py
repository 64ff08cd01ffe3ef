"""Duplicates, clusters and overlap audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import integrity as D
from plumbline.plans.registry import query
from plumbline.session import settle

DIGIT = "(strpos('0123456789abcdef', substr(h, pos, 1)) - 1)"


def sigs_sql(size: int, table: str = "documents") -> str:
    """SimHash of runs of `size` words as 64 hex digits per document of a table (doc_id, text); a shorter text is one run."""
    return f"""wd AS (SELECT doc_id AS id, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda w: len(w) > 0) AS ws FROM {table}),
sh AS (SELECT id, unnest(list_transform(range(1, greatest(len(ws) - {size - 1}, 1) + 1), lambda i: coalesce(array_to_string(ws[i:i + {size - 1}], ' '), ''))) AS g FROM wd),
hs AS (SELECT id, sha256(g) AS h FROM sh),
dg AS (SELECT id, pos, count(*) AS n, sum({DIGIT} // 8) AS a, sum({DIGIT} // 4 % 2) AS b, sum({DIGIT} // 2 % 2) AS c, sum({DIGIT} % 2) AS d
 FROM hs, range(1, 65) r(pos) GROUP BY id, pos),
sig AS MATERIALIZED (SELECT id, string_agg(substr('0123456789abcdef', ((a*2 > n)::INT*8 + (b*2 > n)::INT*4 + (c*2 > n)::INT*2 + (d*2 > n)::INT) + 1, 1), ''
 ORDER BY pos) AS s FROM dg GROUP BY id)"""


SIGS = sigs_sql(5)
HAM = " + ".join(
    f"bit_count(xor(('0x' || substr(x.s, {1 + 8 * i}, 8))::BIGINT, ('0x' || substr(y.s, {1 + 8 * i}, 8))::BIGINT))::INT" for i in range(8))
REPS = "reps AS MATERIALIZED (SELECT s, min(id) AS rep, count(*) AS copies FROM sig GROUP BY s)"
PAIRS = f"""pairs AS MATERIALIZED (SELECT x.rep AS a_rep, y.rep AS b_rep, ({HAM})::INT AS hamming, x.copies AS a_copies, y.copies AS b_copies
FROM reps x JOIN reps y ON x.rep < y.rep AND {HAM} <= 6)"""
COMPS = """reach(n, m) AS (SELECT rep, rep FROM reps UNION SELECT reach.n, CASE WHEN p.a_rep = reach.m THEN p.b_rep ELSE p.a_rep END
 FROM reach JOIN pairs p ON p.a_rep = reach.m OR p.b_rep = reach.m),
roots AS (SELECT n AS rep, min(m) AS root FROM reach GROUP BY n),
clusters AS MATERIALIZED (SELECT sig.id, dense_rank() OVER (ORDER BY root) - 1 AS cluster, coalesce(l.quality, 0) AS label, documents.source
 FROM sig JOIN reps USING (s) JOIN roots USING (rep) JOIN documents ON documents.doc_id = sig.id LEFT JOIN labels l ON l.doc_id = sig.id)"""
ALL = ", ".join((SIGS, REPS, PAIRS, COMPS))


def signatures(v, size: int = D.SHINGLE):
    docs = v.table("documents").select(F.col("doc_id").alias("id"), "text")
    return D.text_signatures(docs, size=size)


def clusters(v):
    items = v.roled.select("id", "label", "source")
    return D.provenance_clusters(signatures(v)).join(items, "id")


@query("signature_bits", "SELECT id, s AS signature FROM sig", "", SIGS)
def _sig(v):
    return signatures(v).select("id", D.signature_hex().alias("signature"))


@query("signature_sign_bits", "SELECT id, sum(CASE WHEN x > 0 THEN 1 ELSE 0 END)::INT AS n_on, string_agg(CASE WHEN x > 0 THEN '1' ELSE '0' END, '' ORDER BY pos DESC) AS bits "
       "FROM cells GROUP BY id", "cells")
def _sign(v):
    out = D.sign_signatures(v.vecs)
    return out.select("id", F.bit_count("s0").alias("n_on"), F.lpad(F.bin("s0"), 64, "0").alias("bits"))


@query("near_dup_join", "SELECT * FROM pairs", "", ", ".join((sigs_sql(1), REPS, PAIRS)))
def _near(v):
    """Pairs of signatures over single words: texts with nearly the same words, in any order. Nothing is dropped by it."""
    out = D.near_dup_join(D.distinct_signatures(signatures(v, 1)))
    return out.withColumn("hamming", F.col("hamming").cast("int"))


@query("exact_dup_join", """SELECT doc_id AS id, nullif(min(doc_id) OVER (PARTITION BY md5(text)), doc_id) AS copy_of FROM documents""")
def _exact(v):
    return D.exact_dup_groups(v.table("documents").select(F.col("doc_id").alias("id"), "text"))


@query("exact_dup_join_across", """SELECT h.id AS holdout_id, h.label AS holdout_label, t.train_id, t.train_label FROM roled h JOIN (
SELECT md5(text) AS k, min(id) AS train_id, arg_min(label, id) AS train_label FROM roled WHERE role = 'train' GROUP BY 1) t ON md5(h.text) = t.k
WHERE h.role = 'holdout'""", "roled")
def _across(v):
    return D.exact_overlap(v.roled.filter("role = 'holdout'"), v.roled.filter("role = 'train'"))


@query("provenance_clusters", "SELECT id, cluster FROM clusters", "", ALL)
def _clusters(v):
    return D.provenance_clusters(signatures(v))


@query("dedup_representatives", "SELECT cluster, label, min(id) AS id, arg_min(source, id) AS source FROM clusters GROUP BY cluster, label", "", ALL)
def _reps(v):
    return D.dedup_representatives(clusters(v))


@query("label_conflict_clusters", "SELECT cluster, count(*) AS n_items FROM clusters GROUP BY cluster HAVING count(DISTINCT label) > 1", "", ALL)
def _conflicts(v):
    return D.label_conflict_clusters(clusters(v))


@query("dedup_summary", """SELECT sum(n)::BIGINT AS readable, sum(k)::BIGINT AS kept, (sum(n) - sum(k))::BIGINT AS collapsed, count(*) AS clusters,
count(*) FILTER (k > 1) AS conflicts FROM (SELECT count(*) AS n, count(DISTINCT label) AS k FROM clusters GROUP BY cluster)""", "", ALL)
def _summary(v):
    return D.dedup_summary(clusters(v))


@query("dedup_counts_by_source", """SELECT source, label, count(*) AS n FROM (SELECT label, arg_min(source, id) AS source FROM clusters GROUP BY cluster, label)
GROUP BY source, label""", "", ALL)
def _by_source(v):
    return D.dedup_representatives(clusters(v)).groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"))


SIDES = """hx AS (SELECT s, min(id) AS rep, count(*) AS copies, arg_min(label, id) AS label FROM sig JOIN roled USING (id) WHERE role = 'holdout' GROUP BY s),
tx AS (SELECT s, min(id) AS rep, count(*) AS copies, arg_min(label, id) AS label FROM sig JOIN roled USING (id) WHERE role = 'train' GROUP BY s),
he AS (SELECT md5(text) AS k, min(id) AS rep, count(*) AS copies, arg_min(label, id) AS label FROM roled WHERE role = 'holdout' GROUP BY 1),
te AS (SELECT md5(text) AS k, min(id) AS rep, arg_min(label, id) AS label FROM roled WHERE role = 'train' GROUP BY 1),
""" + f"""matches AS (SELECT 'md5-exact' AS kind, 0 AS hamming, he.rep AS holdout_id, te.rep AS train_id, he.copies AS n_holdout, 1::BIGINT AS n_train,
he.label AS holdout_label, te.label AS train_label FROM he JOIN te USING (k) UNION ALL
SELECT 'near', ({HAM})::INT, x.rep, y.rep, x.copies, y.copies, x.label, y.label FROM hx x JOIN tx y ON {HAM} <= 6)"""


# Every pair of items: each distinct text is signed once, items come back by their text, so that repeated or missing ids leave no item out.
LISTED = f"""texts AS MATERIALIZED (SELECT row_number() OVER () AS doc_id, text FROM (SELECT DISTINCT text FROM roled)),
{sigs_sql(D.SHINGLE, "texts")},
items AS MATERIALIZED (SELECT r.id, r.label, r.role, md5(r.text) AS k, sig.s, count(*) OVER (PARTITION BY r.role, md5(r.text)) AS nk,
 count(*) OVER (PARTITION BY r.role, sig.s) AS ns FROM roled r JOIN texts t ON r.text IS NOT DISTINCT FROM t.text JOIN sig ON sig.id = t.doc_id),
hx AS MATERIALIZED (SELECT * FROM items WHERE role = 'holdout'), tx AS MATERIALIZED (SELECT * FROM items WHERE role = 'train'),
met AS MATERIALIZED (SELECT x.s AS hs, y.s AS ts, ({HAM})::INT AS hamming FROM (SELECT DISTINCT s FROM hx) x JOIN (SELECT DISTINCT s FROM tx) y ON {HAM} <= 6),
matches AS (SELECT 'md5-exact' AS kind, 0 AS hamming, hx.id AS holdout_id, tx.id AS train_id, hx.nk AS n_holdout, tx.nk AS n_train,
hx.label AS holdout_label, tx.label AS train_label FROM hx JOIN tx USING (k) UNION ALL
SELECT 'near', met.hamming, hx.id, tx.id, hx.ns, tx.ns, hx.label, tx.label FROM met JOIN hx ON hx.s = met.hs JOIN tx ON tx.s = met.ts)"""


def sides(v):
    """Holdout and train. Each text is read once, for its votes and its md5; only narrow rows meet the labels."""
    sigs = D.text_signatures(v.table("documents"), "doc_id", digest="md5")
    items = settle(v.with_roles(sigs))
    return [items.filter(F.col("role") == r) for r in ("holdout", "train")]


def audit(v):
    return D.holdout_overlap_audit(*sides(v))


@query("holdout_overlap_audit", "SELECT * FROM matches", "roled", LISTED)
def _audit(v):
    return audit(v)


@query("holdout_overlap_verdict", """SELECT coalesce(sum(n_holdout * n_train), 0)::BIGINT AS n_matches,
CASE WHEN count(*) > 0 THEN 'ALARM' ELSE 'CLEAN' END AS verdict FROM matches""", "roled", SIGS + ", " + SIDES)
def _verdict(v):
    return D.overlap_verdict(D.overlap_counts(*sides(v)))
