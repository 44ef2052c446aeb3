import random
from pathlib import Path

from pyspark.sql import functions as F

from evidentia.operators import retrieval as R
from evidentia.sources import text_index as X
from evidentia.sources.store import Catalog

DOC, ASK = "key long, text string", "q long, text string"


def texts(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    return [(i, None if i % 37 == 5 else " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(0, 40)))) for i in range(n)]


def questions(spark):
    return spark.createDataFrame([(1, "w0 w1"), (2, "w30 w45 w2"), (3, "w59"), (4, "absent"), (5, ""), (6, None), (7, "w10 w10 w11")], ASK)


def rows(df):
    return sorted((r.q, r["rank"], r.key, round(r.score, 5)) for r in df.collect())


def same(spark, index, docs, limit=7):
    assert rows(index.search(questions(spark), limit)) == rows(R.bm25(spark.createDataFrame(docs, DOC), questions(spark), limit))


def test_batches_and_merge_equal_bm25_of_the_live_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "RANGE", 16)
    index, live = X.TextIndex(Catalog(spark, f"file://{tmp_path}/c")), dict(texts(300))
    index.apply(spark.createDataFrame(list(live.items()), DOC))
    same(spark, index, list(live.items()))
    files = {p: p.stat().st_mtime_ns for p in Path(tmp_path).rglob("*.parquet")}
    changed = {i: t for i, t in texts(340, 9) if i % 6 == 0} | {1000: "w59 w59 w59", 1001: None}
    index.apply(spark.createDataFrame(list(changed.items()), DOC), spark.createDataFrame([(7,), (8,), (99_999,), (12,)], "key long"))
    live = {k: v for k, v in live.items() if k not in (7, 8)} | changed
    same(spark, index, list(live.items()))
    assert files == {p: p.stat().st_mtime_ns for p in Path(tmp_path).rglob("*.parquet") if p in files}  # nothing is written again
    index.apply(spark.createDataFrame([(6, "w3")], DOC))  # replaces a text of the second batch
    live[6] = "w3"
    same(spark, index, list(live.items()))
    index.merge()
    assert len(index._head()[1]["segments"]) == 1
    index.vacuum()
    assert len(list((tmp_path / "c" / "text_index" / "blocks").iterdir())) == 1
    same(spark, index, list(live.items()))


def test_search_reads_less_than_there_is(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "RANGE", 8)
    docs = [(i, "common " * (1 + i % 3) + ("rare " * 5 if i in (17, 404) else "")) for i in range(600)]
    index = X.TextIndex(Catalog(spark, f"file://{tmp_path}/c"))
    index.apply(spark.createDataFrame(docs, DOC))
    asked = spark.createDataFrame([(1, "rare common")], ASK)
    assert rows(index.search(asked, 2)) == rows(R.bm25(spark.createDataFrame(docs, DOC), asked, 2))
    r = index.reads(asked, 2).first()
    assert r.postings == 602 and r.postings_read < 0.1 * r.postings and r.blocks_read < 0.1 * r.blocks


def test_empty_index_repeated_and_null_keys(spark, tmp_path):
    index = X.TextIndex(Catalog(spark, f"file://{tmp_path}/c"))
    assert index.search(questions(spark), 3).collect() == [] and index.reads(questions(spark), 3).collect() == [] and index.merge() == 0
    index.apply(spark.createDataFrame([], DOC))
    assert index.search(questions(spark), 3).collect() == []
    index.apply(spark.createDataFrame([(1, "w0"), (1, "w1"), (None, "w0"), (2, "")], DOC))
    same(spark, index, [(1, "w1"), (2, "")])
    index.apply(spark.createDataFrame([], DOC), spark.createDataFrame([(1,), (2,)], "key long"))
    assert index.search(questions(spark), 3).collect() == []


def test_keys_of_several_fields(spark, tmp_path):
    docs = [(("a", i), f"w{i} w1") for i in range(5)]
    df = spark.createDataFrame(docs, "key struct<path:string,line:int>, text string")
    index = X.TextIndex(Catalog(spark, f"file://{tmp_path}/c"))
    index.apply(df)
    index.apply(df.limit(0), df.filter(F.col("key.line") == 3).select("key"))
    got = rows(index.search(questions(spark), 9))
    assert got == rows(R.bm25(df.filter(F.col("key.line") != 3), questions(spark), 9))


def test_a_dead_writer_and_a_half_manifest_do_not_wedge_a_table(spark, tmp_path):
    store = Catalog(spark, f"file://{tmp_path}/s")
    df = spark.createDataFrame([("a", 1)], "path string, n int")
    assert store.apply_batch("t", df) == 1
    (tmp_path / "s" / "t" / "_v2.json").write_text("")
    (tmp_path / "s" / "t" / "_v3.json").write_text('{"parts": {"1"')
    assert store.version("t") == 1 and store.read("t").count() == 1
    assert store.apply_batch("t", spark.createDataFrame([("b", 2)], "path string, n int")) == 4
    assert store.version("t") == 4 and sorted(r.path for r in store.read("t").collect()) == ["a", "b"]
    store.vacuum("t")
    assert store.read("t").count() == 2
    assert not [p for p in (tmp_path / "s").iterdir() if p.name.startswith("_tmp-")]


def test_only_one_of_two_writers_makes_a_version(spark, tmp_path):
    store = Catalog(spark, f"file://{tmp_path}/s")
    assert store.publish("t", 0, {"parts": {}, "schema": None, "key": []}) == 1
    assert store.publish("t", 0, {"parts": {}, "schema": None, "key": []}) is None
    assert store.publish("t", 1, {"parts": {}, "schema": None, "key": []}) == 2
