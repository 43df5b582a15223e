"""A corpus in five steps: quality, near duplicates, benchmark passages, personal data, tokens.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which ``run`` writes as Parquet and reads again as the next stage's ``docs``.
Every stage but the last keeps the columns of ``documents``; the last returns doc_id,
source, lang, n_chars, n_tokens and the ids. No stage samples or caps its input, except
that the classifier is fitted to a bounded sample of labelled rows (ordinal.MAX_LABELLED).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.llm import bpe, jaccard, ordinal, pii, winnow
from martlens.llm.common import saved, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the highest grade is at least ordinal.KEEP_TOP stay."""
    grades = table(spark, sf_dir, "labels").select(
        "doc_id", ordinal.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    fitted = ordinal.fit(ordinal.sample(docs, grades))
    return ordinal.grade_texts(docs, fitted).where("keep").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the row of the least id (nulls last) and text hash stays.
    Texts without words are in no group; rows that repeat id and text stay once."""
    keyed = docs.withColumn("_h", F.xxhash64("text"))
    found = jaccard.near_duplicates(keyed.select("doc_id", "_h", "text")).where("component is not null")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_h")
    rows = saved(found.select("component", rank.alias("rank")).distinct(), "near-duplicates")
    first = rows.groupBy("component").agg(F.min("rank").alias("rank"))
    gone = rows.join(first, ["component", "rank"], "left_anti").select(
        F.col("rank.doc_id").alias("gone_id"), F.col("rank._h").alias("gone_h")).distinct()
    kept = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("_h") == F.col("gone_h")), "left_anti")
    repeated = docs.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    return (kept.dropDuplicates(["doc_id", "_h"]) if repeated else kept).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any word inside an occurrence of a benchmark window stay."""
    return winnow.contamination(docs.withColumn("_text", F.col("text")), table(spark, sf_dir, "benchmark")) \
        .where("n_hit = 0").withColumnRenamed("_text", "text").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars is that of the new text."""
    clean = pii.redact(pii.find_pii(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                            .otherwise(F.length("text").cast("long"))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every text, little-endian unsigned 32-bit."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                      drop_text=True, decode=False)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("personal_data", personal_data), ("tokens", tokens)]

#: SQL cannot express the fitted classifier and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
