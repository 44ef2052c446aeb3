"""The registered queries of this subpackage: each applies one operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from . import exact_dedup as dedup
from . import fill_in_middle, graph_search, kneser_ney, language_id, license_scan, ngram_join, packing, quality, sharding, vector_codes, warc

#: The shards of the production layout.
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return graph_search.nearest(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, slot, shard) of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return sharding.place(docs, SHARDS).select("doc_id", "slot", "shard")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return kneser_ney.score_corpus(docs, order=3).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each assembled capture; beside the response's own columns, the address in its request and metadata records."""
    captures = warc.archive(_table(spark, sf_dir, "pages"))
    return captures.select(
        "page_id", "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"), "refers_to", F.col("request.url").alias("request_url"), F.col("metadata.url").alias("metadata_url")
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, set_id, class_id, n_links) of every document, for links of 0.8 or more between word 5-grams."""
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.classify(_table(spark, sf_dir, "documents").select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = fill_in_middle.restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_graph_search": op1_graph_search,
    "op2_sharding": op2_sharding,
    "op3_packing": op3_packing,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_license_scan": op5_license_scan,
    "op6_warc": op6_warc,
    "op7_language_id": op7_language_id,
    "op8_bpe": op8_bpe,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_ngram_join": op10_ngram_join,
    "op11_quality": op11_quality,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_vector_codes": op13_vector_codes,
}

#: pages of equal text differ in no byte, so that text stands for the payload here. Blanks and control characters of an
#: address are escaped; each capture has its own request and metadata.
WARC_SQL = r"""
with t as (select page_id, coalesce(html, '') as html, array_to_string(list_transform(regexp_extract_all(coalesce(url, ''), '(?s).'),
  lambda c: case when unicode(c) <= 32 then printf('%%%02X', unicode(c)) else c end), '') as url from pages),
k as (select page_id, url, strlen(html) as payload_bytes, sha1(html) as payload_digest, max(page_id) over (partition by html) as first_id from t)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> first_id then first_id end as refers_to,
  url as request_url, url as metadata_url
from k
"""

ORACLES: dict[str, str] = {"op6_warc": WARC_SQL, "op9_exact_dedup": dedup.EXACT_DEDUP_SQL, "op12_fill_in_middle": fill_in_middle.FILL_IN_MIDDLE_SQL, "op13_vector_codes": vector_codes.sql()}
