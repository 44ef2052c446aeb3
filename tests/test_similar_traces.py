"""A question can be found by another, and never finds itself."""

from __future__ import annotations

from evidentia.plans import planning_queries


def test_questions_are_found_too(spark, tmp_path):
    rows = [(100, [1.0, 0.0], 1), (150, [1.0, 0.1], 1), (151, [1.0, 0.9], 2), (152, [0.8, 1.0], 2), (153, [0.5, 1.0], 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r.q, r["rank"], r.vec_id) for r in planning_queries.similar_traces(spark, str(tmp_path)).collect())
    assert got == [(100, 1, 150), (100, 2, 151), (100, 3, 152), (150, 1, 100), (150, 2, 151), (150, 3, 152)]
