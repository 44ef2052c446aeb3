from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evidentia.operators import chunking
from evidentia.operators import retrieval as R
from evidentia.sources import feed
from evidentia.sources.store import Catalog

FILE = "path string, content string"


def files(spark, rows):
    return spark.createDataFrame(rows, FILE)


def derive():
    return {
        "chunks": lambda rows: chunking.windows(rows, 3, 1).select("path", "line_start", "line_end", "content"),
        "facts": lambda rows: rows.select("path", F.explode(F.split("content", " ")).alias("name")),
        "vectors": lambda rows: R.hashed_vectors(rows.select(F.col("path").alias("key"), F.col("content").alias("text"))).withColumnRenamed("key", "path"),
    }


def content(df):
    return sorted(map(repr, df.collect()))


def test_dependents_equal_a_fresh_build(spark, tmp_path):
    store = Catalog(spark, f"file://{tmp_path}/s", buckets=8)
    rows = {f"f{i}": "\n".join(f"a{i} b{k}" for k in range(i % 6)) for i in range(40)}
    store.apply_batch("files", files(spark, list(rows.items())))
    tables = feed.Dependents(store, "files", derive())
    assert tables.refresh() == {"chunks": 1, "facts": 1, "vectors": 1} and tables.refresh() == {"chunks": 1, "facts": 1, "vectors": 1}
    parts = store.head("chunks")[1]["parts"]
    batch = {"f3": "new text", "f77": "x\ny\nz\nw"}
    store.apply_batch("files", files(spark, list(batch.items())), "path", spark.createDataFrame([("f5",), ("none",)], "path string"))
    rows = {k: v for k, v in rows.items() if k != "f5"} | batch
    tables.refresh()
    fresh = Catalog(spark, f"file://{tmp_path}/t", buckets=8)
    fresh.apply_batch("files", files(spark, list(rows.items())))
    feed.Dependents(fresh, "files", derive()).refresh()
    for table in derive():
        assert content(store.read(table)) == content(fresh.read(table))
        assert tables.made_from(table) == 2
    touched = {str(r[0]) for r in files(spark, [(k, "") for k in ("f3", "f5", "f77")]).select(store._bucket(["path"])).collect()}
    after = store.head("chunks")[1]["parts"]
    assert {b for b in parts if parts[b] != after.get(b)} <= touched and len(touched) < len(parts)
    assert content(store.read("chunks")) == content(store.read("chunks")) and all(Path(p.removeprefix("file://")).exists() for p in after.values())


def test_a_run_that_died_is_made_up_for(spark, tmp_path):
    store = Catalog(spark, f"file://{tmp_path}/s", buckets=4)
    store.apply_batch("files", files(spark, [("a", "x"), ("b", "y")]))
    broken = derive() | {"facts": lambda rows: rows.select("path", F.raise_error(F.lit("dead")).cast("string").alias("name"))}
    with pytest.raises(Exception, match="dead"):
        feed.Dependents(store, "files", broken).refresh()
    assert store.read("facts") is None and store.version("chunks") == 1
    store.apply_batch("files", files(spark, [("a", "z z")]))
    feed.Dependents(store, "files", derive()).refresh()
    assert sorted((r.path, r.name) for r in store.read("facts").collect()) == [("a", "z"), ("a", "z"), ("b", "y")]


def test_a_version_that_is_gone(spark, tmp_path):
    store = Catalog(spark, f"file://{tmp_path}/s", buckets=4)
    store.apply_batch("files", files(spark, [("a", "x"), ("b", "y")]))
    tables = feed.Dependents(store, "files", derive())
    tables.refresh()
    store.apply_batch("files", files(spark, [("a", "q")]), "path", spark.createDataFrame([("b",)], "path string"))
    store.vacuum("files")
    assert feed.changes(store, "files", 1) is None
    tables.refresh()
    assert [(r.path, r.name) for r in store.read("facts").collect()] == [("a", "q")]


def test_changes(spark, tmp_path):
    store = Catalog(spark, f"file://{tmp_path}/s", buckets=4)
    assert feed.changes(store, "none", 0) is None
    store.apply_batch("t", files(spark, [("a", "1"), ("a", "2"), ("b", "1"), ("c", None)]))
    store.apply_batch("t", files(spark, [("a", "2"), ("a", "1"), ("b", "2"), ("d", "1")]), "path", spark.createDataFrame([("c",)], "path string"))
    got = lambda *v: sorted(map(tuple, feed.changes(store, "t", *v).collect()))
    assert got(1) == [("b", "changed"), ("c", "removed"), ("d", "added")]
    assert got(0, 1) == [("a", "added"), ("b", "added"), ("c", "added")] and got(2) == []


def test_whole_tables_lose_what_has_vanished(spark, tmp_path):
    store = Catalog(spark, f"file://{tmp_path}/s", buckets=4)
    assert feed.refresh_whole(store, "docs", files(spark, [("a", "1"), ("b", "1")])) == 1
    assert feed.refresh_whole(store, "docs", files(spark, [("b", "1"), ("a", "1")])) == 1  # nothing differs
    feed.refresh_whole(store, "docs", files(spark, [("b", "2"), ("c", "1")]))
    assert content(store.read("docs")) == content(files(spark, [("b", "2"), ("c", "1")]))


def test_sidecar(spark, tmp_path):
    store = Catalog(spark, f"file://{tmp_path}/s", buckets=4)
    seen = []

    def summarise(rows):
        seen.append(rows.count())
        return rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("content").alias("last"))

    beside = feed.Sidecar(store, "items", "items_summary", summarise)
    store.apply_batch("items", files(spark, [("a", "1"), ("a", "2"), ("b", "1")]))
    assert [tuple(r) for r in beside.summaries([F.asc("path")]).collect()] == [("a", 2, "2"), ("b", 1, "1")]
    store.apply_batch("items", files(spark, [("c", "9")]), "path", spark.createDataFrame([("b",)], "path string"))
    assert [tuple(r) for r in beside.summaries([F.desc("path")], 1).collect()] == [("c", 1, "9")]
    assert seen == [3, 1] and not beside.drifted()  # the second time only what is new
    store.apply_batch("items_summary", store.read("items_summary").limit(0), "path", spark.createDataFrame([("a",)], "path string"))
    assert beside.drifted()
    assert [tuple(r) for r in beside.summaries([F.asc("path")]).collect()] == [("a", 2, "2"), ("c", 1, "9")] and not beside.drifted()


def test_items_by_validated_ids(spark, tmp_path):
    items = feed.Items(Catalog(spark, f"file://{tmp_path}/s", buckets=4), "briefs")
    row = lambda *xs: spark.createDataFrame(list(xs), "id string, title string")
    assert items.load() is None and items.remove(row(("a", ""))) == 0
    items.save(row(("a", "x"), ("b-1", "y")))
    items.save(row(("a", "z")))
    assert content(items.load()) == content(row(("a", "z"), ("b-1", "y"))) and items.load(row(("a", ""), ("no", ""))).count() == 1
    for bad in ("../a", "", None, "a b", "x" * 200):
        with pytest.raises(ValueError, match="invalid ids"):
            items.save(row((bad, "x"), ("c", "x")))
    items.remove(row(("a", ""), ("no", "")))
    assert content(items.load()) == content(row(("b-1", "y")))
