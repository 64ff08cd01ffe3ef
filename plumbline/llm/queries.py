"""The registered queries of the corpus operators: thin steps from the given tables and back."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm import byte_bpe, fingerprints, language_id, ngram_join, packing, quality_classifier, quality_rules, sharding, spelling, token_alignment, topk
from plumbline.llm import unit_dedup, url_filter
from plumbline.llm.common import gapless_rank, shared_folder, spread_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narratives(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """`documents` as cases."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("rationale"), *more)


def id_crc(name: str) -> Column:
    """CRC32 of an id as decimal text, by which rows are held out."""
    return F.crc32(F.col(name).cast("string").cast("binary"))


TOP_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""


@register("op6_top_cases", TOP_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    hits = topk.top_cases(cases.filter("id % 100 = 0"), cases, 10, 1024.0)
    return hits.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


#: (verdict, host, path), as the contract states them.
URL_RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

URL_SQL = r"""WITH cut AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
  AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(said, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (SELECT page_id, host, path, (SELECT max_by(h || p || '|' || said, length(h || p)) FROM rules
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best FROM parts)
SELECT page_id, host, path, split_part(best, '|', 1) AS rule, coalesce(split_part(best, '|', 2),
  CASE WHEN host <> '' AND ('0x' || substr(md5(host), 1, 8))::BIGINT % 8 = 0 THEN 'block' ELSE 'allow' END) AS verdict FROM fit"""


@register("op10_url_filter", URL_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of blocked hosts stands in for a published one: hosts with md5 divisible by eight, on no page or any."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    host, _ = url_filter.host_and_path(F.col("url"))
    hosts = pages.select(host.alias("key")).distinct()
    blocked = hosts.filter(F.conv(F.substring(F.md5("key"), 1, 8), 16, 10).cast("long") % 8 == 0)
    return url_filter.judge_urls(pages, URL_RULES, blocked).withColumnRenamed("id", "page_id")


@register("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language is the stratum: with some hundred labels it is the finest that can be certified."""
    cases = narratives(spark, sf_dir, "lang")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    out = quality_rules.apply_quality_rules(cases, labels, "lang")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang")
    return out.select(F.col("id").alias("doc_id"), *names)


@register("op7_byte_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.round_trip(narratives(spark, sf_dir), path, public_tokenizers.PATTERN)
    return coded.withColumnRenamed("id", "doc_id")


OLD_SHARDS, NEW_SHARDS = 6, 8


@register("op1_reshard")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old layout, written here, kept every source in one of six shards; sizes, digests and slots are read from the new one's files."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    old = F.pmod(F.crc32(F.encode(F.coalesce("source", F.lit("")), "UTF-8")), F.lit(OLD_SHARDS)).cast("int")
    size = (F.octet_length(F.coalesce("text", F.lit(""))) + F.lit(1)).cast("long")
    folder = shared_folder(spark)
    root, target = f"{folder}/old", f"{folder}/new"
    stored = docs.select("id", "text", size.alias("size"), old.alias("old_shard"), old.alias("shard"))
    stored.write.partitionBy("shard").parquet(root)
    kept = sharding.rewrite_shards(spark, root, target, NEW_SHARDS, stored.schema)
    names = ("id", "text", "old_shard", F.col("shard").cast("int").alias("shard"))
    before = spark.read.schema(stored.schema).parquet(root).filter(F.col("shard").isin(kept))
    now = before.select(*names).unionByName(spark.read.schema(stored.schema).parquet(target).select(*names))
    text = F.coalesce("text", F.lit(""))
    size, crc = (F.octet_length(text) + F.lit(1)).cast("long"), F.crc32(F.encode(text, "UTF-8"))
    now = now.select("id", size.alias("size"), crc.alias("text_crc32"), "old_shard", "shard")
    now = gapless_rank(now, ["shard"], ["id", "size", "old_shard"], "slot", spread_count(docs.count() // NEW_SHARDS + 1))
    moved = (F.col("shard") != F.col("old_shard")).alias("moved")
    fixed = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return now.select(F.col("id").alias("doc_id"), "size", "text_crc32", "shard", "slot", *fixed, "old_shard", moved)


@register("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_cases(narratives(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return packed.withColumnRenamed("id", "doc_id")


UNIT_SQL = r"""WITH cut AS (SELECT doc_id, string_split(text, E'\n') AS u FROM documents),
lines AS (SELECT doc_id, unnest(u) AS line, generate_subscripts(u, 1) AS i FROM cut),
placed AS (SELECT doc_id, i, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, length(line) AS size, trim(regexp_replace(translate(line,
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS n FROM lines),
plain AS (SELECT doc_id, start, start + size AS "end", n, len(string_split(n, ' ')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM placed WHERE n <> ''),
summed AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS upto FROM plain),
runs AS (SELECT a.doc_id, a.k AS one, b.k AS two FROM (SELECT *, upto - w + 20 AS goal FROM summed) a ASOF JOIN summed b
    ON a.doc_id = b.doc_id AND a.goal <= b.upto
  UNION SELECT a.doc_id, b.k, a.k FROM (SELECT *, upto - 20 AS goal FROM summed) a ASOF JOIN (SELECT *, upto - w AS since FROM summed) b
    ON a.doc_id = b.doc_id AND a.goal >= b.since),
units AS (SELECT r.doc_id, min(s.start) AS start, max(s."end") AS "end", string_agg(s.n, ' ' ORDER BY s.k) AS n
  FROM runs r JOIN summed s ON s.doc_id = r.doc_id AND s.k BETWEEN r.one AND r.two GROUP BY r.doc_id, r.one, r.two),
met AS (SELECT doc_id, start, "end", first_value(doc_id) OVER w AS first_doc_id, first_value(start) OVER w AS first_start,
  first_value("end") OVER w AS first_end FROM units WINDOW w AS (PARTITION BY n ORDER BY doc_id, start, "end"))
SELECT doc_id, start, "end", first_doc_id, first_start FROM met WHERE doc_id <> first_doc_id OR start >= first_end"""


@register("op5_unit_dedup", UNIT_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that repeat an earlier document's (or the document's own earlier) line or run of lines."""
    spans = unit_dedup.repeated_units(narratives(spark, sf_dir))
    return spans.withColumnsRenamed({"id": "doc_id", "first_id": "first_doc_id"})


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels to learn quality from: every row that is not held out."""
    labels = table(spark, sf_dir, "labels").filter(id_crc("doc_id") % 3 != 1)
    return labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))


@register("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_classifier.score_cases(narratives(spark, sf_dir), quality_labels(spark, sf_dir))
    held_out = F.coalesce(id_crc("id") % 3 == 1, F.lit(False))
    return scored.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", "predicted")


@register("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = narratives(spark, sf_dir, "lang")
    held_out = F.coalesce(id_crc("id") % 5 == 0, F.lit(False))
    said = language_id.identify_language(cases, cases.filter(id_crc("id") % 5 != 0))
    return said.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score")


@register("op2_ngram_join")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = ngram_join.link_cases(narratives(spark, sf_dir), 3, 90)
    return linked.withColumnRenamed("id", "doc_id")


@register("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.align_tokenizers(narratives(spark, sf_dir), *paths).withColumnRenamed("id", "doc_id")


@register("op12_fingerprints")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against itself with its last third taken from the next document's start, and against that document."""
    docs = narratives(spark, sf_dir).withColumn("rationale", F.coalesce("rationale", F.lit("")))
    pairs = fingerprints.with_next(docs).withColumn("n_chars", F.length("rationale").cast("long"))
    gone = F.floor(F.col("n_chars") / 3).cast("int")
    kept = F.substring("rationale", F.lit(1), F.col("n_chars").cast("int") - gone)
    pairs = pairs.withColumn("edited", F.concat(kept, F.substring("next_rationale", F.lit(1), gone)))
    pairs = pairs.withColumn("edited_sha256", F.sha2("edited", 256))
    columns = {"rationale": "fingerprint", "edited": "edited_fingerprint", "next_rationale": "next_fingerprint"}
    out = fingerprints.fingerprint_cases(pairs, columns)
    near = (fingerprints.similarity(F.col("fingerprint"), F.col(c)) for c in ("edited_fingerprint", "next_fingerprint"))
    near_edited, near_next = near
    names = (F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint")
    return out.select(*names, near_edited.alias("near_edited"), near_next.alias("near_next"))


@register("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(spelling.count_words(narratives(spark, sf_dir), typo_every=31))
