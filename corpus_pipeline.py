"""From raw documents to packed training sequences: quality, language, near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet in the
cluster's shared folder and read again by the next one, so a lost executor costs one stage's tasks at
most. All but the last stage return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import language_id, ngram_join, packing, quality_classifier, unit_dedup
from plumbline.llm.common import bounded_batches, shared_folder
from plumbline.llm.queries import id_crc, quality_labels

#: Words a worker of the last stage remembers, fewer than `op9` does: its memory also holds what four stages left.
CACHED_WORDS = 150_000


def as_cases(docs: DataFrame) -> DataFrame:
    """Documents as the cases the operators take; all other columns travel as one struct, so that no name can clash."""
    bounded_batches(docs.sparkSession)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select(F.col("doc_id").alias("id"), F.col("text").alias("rationale"), *([F.struct(*others).alias("carried")] if others else []))


def as_docs(cases: DataFrame, docs: DataFrame) -> DataFrame:
    """Back to the columns of `docs`, in their order."""
    own = {"doc_id": F.col("id"), "text": F.col("rationale")}
    return cases.select(*(own.get(c, F.col(f"carried.`{c}`")).alias(c) for c in docs.columns))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good ones.

    Here and in the other stages: null, empty and very long texts are judged whole, as their operator states; repeated rows and null ids are
    judged one by one; further columns of any name are kept; no documents give none.
    """
    return as_docs(quality_classifier.keep_good_cases(as_cases(docs), quality_labels(spark, sf_dir)), docs)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a probability of at least a half; texts that are null or without a letter go."""
    labelled = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("rationale"), "lang").filter(id_crc("id") % 5 != 0)
    return as_docs(language_id.keep_known_languages(as_cases(docs), labelled), docs)


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near copies: five words, similarity 0.8. Texts without words all stay; rows without an id rank last."""
    return as_docs(ngram_join.one_of_each(as_cases(docs), 5, 80), docs)


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines, runs of lines and runs of 40 words that an earlier document has; n_chars follows the text. No document goes, though its text may be empty then."""
    out = as_docs(unit_dedup.drop_repeated_units(as_cases(docs), run_words=unit_dedup.RUN_WORDS), docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens; a null text is an empty one."""
    pieces = packing.pack_cases(as_cases(docs), public_tokenizers.path("word_bpe_49k.json"), cached_words=CACHED_WORDS)
    return pieces.withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("n-gram Jaccard join", no_near_duplicates),
    ("substring dedup", no_repeated_passages),
    ("packing", packed),
]

#: Trained models and tokenizers have no SQL; tests/llm compares the rows with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark)
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
