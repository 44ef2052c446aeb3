"""Large inputs of one key, and many questions at once, in linear time and bounded memory."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from evidentia.operators import graph as G
from evidentia.operators import retrieval as R


def test_brace_ranges_of_a_long_file(spark):
    lines = spark.range(80_000).select(F.lit(1).alias("key"), (F.col("id") + 1).alias("line_no"), F.expr("case id % 4 when 0 then 'f {' when 3 then '}' else '  x' end").alias("line"))
    G.brace_ranges(lines.limit(8)).collect()
    began = time.time()
    got = G.brace_ranges(lines)
    assert got.agg(F.sum("line_end")).first()[0] == sum(range(4, 80_001, 4)) and time.time() - began < 20


def test_scoring_of_very_many_questions_stays_small():
    n, docs = 8_192, 10_000
    terms = pa.array([f"t{k}" for k in range(n)])
    rng = np.random.default_rng(1)
    low = pa.array([" ".join(f"t{k}" for k in rng.integers(0, n, 20)) for _ in range(docs)])
    score = R._term_scores(list(range(n)), np.arange(n), np.arange(n), terms, np.ones(n), 20.0, 5, pa.int64())
    batch = pa.RecordBatch.from_arrays([pa.array(range(docs)), low], names=["key", "low"])
    tracemalloc.start()
    rows = sum(len(b) for b in score(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows >= 5 * 8_000 and peak < 300 << 20


def test_parts_of_a_batch_give_what_the_whole_gives(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a{' b' * (i % 5)} c{i % 3}") for i in range(200)] + [(999, None)], "key long, text string").coalesce(1)
    asked = spark.createDataFrame([(1, "a b"), (2, "b c1"), (3, "c0 c1 c2 a"), (4, "none")], "q long, text string")
    whole = sorted(map(tuple, R.bm25(docs, asked, 6).collect()))
    apply_ = {}
    terms = pa.array(["a", "b", "c1"])
    of, term = np.array([0, 0, 1, 1]), np.array([0, 1, 1, 2])
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([f"a{' b' * (i % 5)} c{i % 3}" for i in range(50)])], names=["key", "low"])
    for most in (1, 7, 1 << 21):
        monkeypatch.setattr(R, "MEETINGS", most)
        out = [r for b in R._term_scores([1, 2], of, term, terms, np.ones(3), 4.0, 50, pa.int64())(iter([batch])) for r in b.to_pylist()]
        apply_[most] = sorted((r["q"], r["key"], r["score"]) for r in out)
    assert apply_[1] == apply_[7] == apply_[1 << 21]
    assert whole == sorted(map(tuple, R._joined_bm25(docs, R.query_terms(asked), 6).collect()))


def test_vectors_need_no_exchange(spark):
    docs = spark.createDataFrame([(1, "A b b"), (2, ""), (3, None), (4, "É?!")], "key long, text string")
    got = R.hashed_vectors(docs)
    assert "Exchange" not in got._jdf.queryExecution().toString()
    rows = {r.key: r.vec for r in got.collect()}
    assert set(rows) == {1} and sorted(x for x in rows[1] if x) == [1.0, 2.0] and len(rows[1]) == R.DIMS


def test_meetings_in_a_table_and_sorted_are_the_same(monkeypatch):
    rng = np.random.default_rng(4)
    q, key, weight = rng.integers(0, 9, 3_000), np.sort(rng.integers(50, 400, 3_000)), rng.choice([0.5, 1.0, 2.25], 3_000)
    table = sorted(zip(*(x.tolist() for x in R._best_meetings(q, key, weight, 9, 7)), strict=True))
    monkeypatch.setattr(R, "MEETINGS", 0)
    assert table == sorted(zip(*(x.tolist() for x in R._best_meetings(q, key, weight, 9, 7)), strict=True)) and len(table) >= 63
    none = np.zeros(0, np.int64)
    assert [len(x) for x in R._best_meetings(none, none, none.astype(float), 9, 7)] == [0, 0, 0]
