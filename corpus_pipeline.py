"""The corpus pipeline: language ID, exact dedup, near-duplicate removal and packing, each over all its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import exact_dedup, language_id, ngram_join, packing
from evidentia.llm.scratch import written

#: Documents whose cosine with the profile of their language is lower are rejected as no text of any language.
MIN_COSINE = 0.02


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those that resemble no language. Others keep their columns."""
    train = docs.filter(~language_id.held_out(docs["doc_id"]) & docs["lang"].isNotNull() & docs["text"].isNotNull())
    whole = docs.select("text", F.struct("*").alias("row"))  # so that no column of docs clashes with the prediction's
    scored = language_id.predict(whole, language_id.profiles(train))
    return scored.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_COSINE)).select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id stays; a document without doc_id stays always."""
    gone = exact_dedup.exact_dedup(docs).filter("not kept and doc_id is not null").select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha256")).distinct()
    own = F.sha2(exact_dedup.normalised(docs["text"]), 256)
    return docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (own == gone["gone_sha256"]), "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 or more connect, the one with the smallest doc_id stays. Where a doc_id has several
    texts, each is judged by itself."""
    digest = F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")), 256))
    linked = ngram_join.ngram_join(docs.select("doc_id", "text", digest.alias("digest")), also=("digest",))
    gone = written(linked.filter("class_id <> doc_id").select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct(), "gone")
    return docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (digest == gone["gone_digest"]), "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, a row for each piece of a document."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("packing", pack_sequences),
]

#: Profiles, near duplicates and packing are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir; each stage's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
