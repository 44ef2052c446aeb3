"""Queries on whole texts."""

from __future__ import annotations

from evidentia.plans import corpus_queries


def test_identifiers_behind_4000_characters(spark, tmp_path):
    spark.createDataFrame([(1, "fooBar " * 2000, "src", "en")], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    row = corpus_queries.split_identifiers(spark, str(tmp_path)).first()
    assert (row.n_parts, row.n_distinct) == (4000, 2)
