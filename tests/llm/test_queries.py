"""The registered queries over the smallest tables: their columns, and their rows against SQL or brute force."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__
from evidentia.llm import queries, sharding

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_graph_search": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op2_sharding": {"doc_id": "bigint", "slot": "bigint", "shard": "int"},
    "op3_packing": dict.fromkeys(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), "bigint"),
    "op4_lm_scoring": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op5_license_scan": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op6_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint", "request_url": "string", "metadata_url": "string"},
    "op7_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op9_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op10_ngram_join": {"doc_id": "bigint", "set_id": "bigint", "class_id": "bigint", "n_links": "bigint"},
    "op11_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op12_fill_in_middle": {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"},
    "op13_vector_codes": {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"},
}


def test_all_are_registered():
    known = __spark_entry__.queries()
    assert set(COLUMNS) == set(queries.QUERIES) and set(COLUMNS) | {"pipeline"} <= set(known)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    assert dict(queries.QUERIES[name](spark, SF).dtypes) == COLUMNS[name]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_equal_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        path = f"{SF}/{t}.parquet"
        duck.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def test_search_query(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = {(r.query_id, r["rank"]): r.vec_id for r in queries.op1_graph_search(spark, SF).collect()}
    hits = 0
    asked = [i for i in rows if i % 50 == 0]
    for q in asked:
        cosine = {i: rows[q] @ v / np.linalg.norm(rows[q]) / np.linalg.norm(v) for i, v in rows.items() if i != q}
        best = sorted(cosine, key=lambda i: (-cosine[i], i))[:5]
        hits += len(set(best) & {got[q, k] for k in range(1, 6)})
    assert hits >= 0.9 * 5 * len(asked) and len(got) == 5 * len(asked)


def test_sharding_query(spark):
    table = sharding.lookup_table(queries.SHARDS)
    rows = queries.op2_sharding(spark, SF).collect()
    assert len({r.doc_id for r in rows}) == len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.shard == table[r.slot] for r in rows)
