import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from evidentia.llm import components, graph_search, ngram_join, warc

DOC = "doc_id long, text string, node long, component string"


def _sets(texts):
    out = {}
    for i, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def _brute(texts):
    sets, by = _sets(texts), defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    parent, links = {i: i for i in sets}, Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        shared = Counter(j for g in s for j in by[g] if j > i)
        for j, k in shared.items():
            if k >= 0.8 * (len(s) + len(sets[j]) - k):
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (root(i), links[i]) for i in sets}


def _near_copies():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = {}
    for g in range(6):
        base = [vocabulary[k] for k in rng.integers(0, 400, 120)]
        for _ in range((300, 20, 9, 4, 2, 1)[g]):
            words = list(base)
            for k in rng.integers(0, 120, rng.integers(0, 4)):
                words[k] = vocabulary[rng.integers(0, 400)]
            texts[len(texts)] = " ".join(words)
    return texts


def _chain():
    rng, at, texts = np.random.default_rng(4), 0, {}
    for i in range(700):  # each text shares half to nine tenths of its n-grams with the next
        texts[i] = " ".join(f"w{k}" for k in range(at, at + 40))
        at += int(rng.integers(2, 9))
    return texts


@pytest.mark.parametrize("kind", ["groups", "documents", "chain"])
def test_join_loses_no_link(spark, kind, monkeypatch):
    loose = []
    monkeypatch.setattr(ngram_join, "_loose", lambda *a, own=ngram_join._loose: loose.append(own(*a)) or loose[-1])
    texts = {"groups": _near_copies, "chain": _chain, "documents": lambda: {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}}[kind]()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_join(docs).collect()}
    assert got == _brute(texts)
    assert any(x.count() for x in loose) == (kind == "chain")


def test_join_edges(spark):
    rows = [(1, None), (2, ""), (3, "  "), (4, "one two"), (5, "One  two"), (6, "one two three"), (None, "one two"), (8, "q " * 40_000), (8, "q " * 40_000), (9, "a b c d e f"), (9, "h i j k l m")]
    docs = spark.createDataFrame([(*r, 0, "c") for r in rows], DOC)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_join(docs).collect()), key=str)
    want = [(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 1), (5, 4, 1), (6, 6, 0), (None, None, 0), (8, 8, 1), (8, 8, 1), (9, 9, 0), (9, 9, 0)]
    assert got == sorted(want, key=str)
    assert ngram_join.ngram_join(docs.filter("false")).count() == 0


def test_pruning_keeps_similar_pairs():
    least = ngram_join.least_matches(24, 240, 0.8, 1e-6)
    assert least == sorted(least) and least[0] < 12 and least[-1] < 0.8 * 240
    rng = np.random.default_rng(0)
    for similarity in (0.8, 0.9):
        equal = rng.binomial(24, similarity, (2000, 10)).cumsum(axis=1)
        assert (equal >= np.array(least)).all(axis=1).mean() > 0.999


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3), (101, 100)]
    rows = components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    got = {r.node: r.component for r in rows}
    assert len(rows) == len(got) and got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def _exact(vectors, queries, k):
    out = {}
    for q, v in queries.items():
        v = np.asarray(v, float)
        near = sorted((-float(np.dot(v, x) / (np.linalg.norm(v) * np.linalg.norm(x))), i) for i, x in vectors.items() if i != q)
        out[q] = [i for _, i in near[:k]]
    return out


@pytest.mark.parametrize("shard", [graph_search.SHARD, 128])
def test_search_recall(spark, shard, monkeypatch):
    monkeypatch.setattr(graph_search, "SHARD", shard)
    monkeypatch.setattr(graph_search, "QUERIES", shard // 16)
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    vectors = {r.vec_id: np.array(r.embedding, float) for r in rows.collect()}
    want = _exact(vectors, {i: v for i, v in vectors.items() if i % 50 == 0}, 5)
    got = defaultdict(list)
    for r in sorted(graph_search.nearest(rows, rows.filter("vec_id % 50 = 0")).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
        exact = vectors[r.query_id] @ vectors[r.vec_id] / np.linalg.norm(vectors[r.query_id]) / np.linalg.norm(vectors[r.vec_id])
        assert abs(exact - r.score) < 1e-12
    assert sum(len(set(got[q]) & set(w)) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, None]), (7, [inf, 0.0]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [-1.0, 0.0]), (11, [1.0, 1.0])]
    v = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = [(r.query_id, r["rank"], r.vec_id) for r in graph_search.nearest(v, v).orderBy("query_id", "rank").collect()]
    assert [x for x in got if x[0] == 0] == [(0, 1, 1), (0, 2, 2), (0, 3, 11), (0, 4, 10)]
    assert {x[0] for x in got} == {0, 1, 2, 10, 11}
    assert graph_search.nearest(v.filter("false"), v.filter("false")).count() == 0


@pytest.mark.parametrize("power", [-300, 200, 300])
def test_search_over_the_whole_range_of_doubles(spark, power):
    x = np.random.default_rng(2).normal(size=(60, 4))
    v = spark.createDataFrame([(i, (row * 10.0**power).tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    want = _exact(dict(enumerate(x)), {0: x[0], 50: x[50]}, 5)
    got = defaultdict(list)
    for r in graph_search.nearest(v, v.filter("vec_id % 50 = 0")).orderBy("rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == want


def test_search_with_many_copies(spark):
    rows = [(i, [1.0, 0.5, 0.25]) for i in range(300)] + [(i, [float(i % 7), 1.0, float(i % 11)]) for i in range(300, 900)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = dict(rows)
    want = _exact(vectors, {i: x for i, x in vectors.items() if i % 50 == 0}, 5)
    got = defaultdict(list)
    for r in graph_search.nearest(v, v.filter("vec_id % 50 = 0")).orderBy("rank").collect():
        got[r.query_id].append(r.vec_id)
    assert all(got[q] == w for q, w in want.items() if q < 300)


def test_pruned_edges_are_diverse():
    x = np.random.default_rng(1).normal(size=(500, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, entries = graph_search.build_graph(x)
    assert graph.shape == (500, graph_search.DEGREE) and len(entries)
    for p in range(0, 500, 97):
        own = [g for g in graph[p] if g >= 0]
        assert len(own) == len(set(own)) and p not in own
    ids, _ = graph_search.beam_search(x, graph, entries, x, 32)
    assert (ids[:, 0] == np.arange(500)).mean() > 0.98


PAGES = [(1, "http://a.example/x\r\ny", "<p>small</p>"), (2, "http://a.example/", "b" * 2000), (3, None, "b" * 2000), (4, "http://b.example/", None), (5, "http://b.example/", ""), (6, "u", "é" * 600), (6, "u", "é" * 600), (None, "u", "b" * 2000), (7, "v", "WARC/1.1\r\n\r\nx" * 300)]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string")
    planned = warc.plan(pages)
    records = warc.read_records(warc.write_archives(planned, roll=500))
    stored = {(r.record_id): bytes(r.payload) for r in records.collect() if r.type == "response"}
    rows = warc.assemble(records).collect()
    assert len(rows) == len(PAGES) and all(r.request and r.metadata for r in rows)
    by_page = defaultdict(list)
    for r in rows:
        by_page[r.page_id].append(r)
        assert r.response.payload_bytes == len((dict((p[0], p[2]) for p in PAGES)[r.page_id] or "").encode())
    assert (by_page[3][0].response.type, by_page[2][0].response.type, by_page[2][0].refers_to) == ("response", "revisit", 3)
    assert by_page[None][0].refers_to == 3
    assert [r.response.type for r in by_page[6]] == ["response"] * 2
    assert {r.response.type for p in (1, 4, 5) for r in by_page[p]} == {"response"}
    assert Counter(stored.values()) == Counter((p[2] or "").encode() for p in PAGES if not (p[0] in (2, None)))
    assert warc.archive(pages.filter("false")).count() == 0


def test_assembly_without_sides(spark):
    rows = [("urn:capture:1:a", "response", None, None, "u", "d", 1, "x"), ("urn:capture:2:b:request", "request", "urn:capture:2:b", None, "u", "d", None, None), ("i", "warcinfo", None, None, None, "d", None, None)]
    records = spark.createDataFrame(rows, "record_id string, type string, concurrent_to string, refers_to string, url string, date string, payload_bytes long, payload_digest string")
    (one,) = warc.assemble(records).collect()
    assert one.page_id == 1 and one.request is None and one.metadata is None


def test_recall_over_several_shards(spark, monkeypatch):
    """Against brute force, in double precision, ties by the smaller id."""
    monkeypatch.setattr(graph_search, "SHARD", 500)
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in vectors.collect() if r.embedding and np.isfinite(r.embedding).all() and np.any(r.embedding)]
    ids, x = np.array([i for i, _ in rows]), np.array([v / np.linalg.norm(v) for _, v in rows])
    found: dict[int, set] = {}
    for r in graph_search.nearest(vectors, vectors.filter("vec_id % 50 = 0"), 5).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    asked = np.flatnonzero(ids % 50 == 0)
    hits = 0
    for k in asked:
        score = np.round(x @ x[k], 12)
        score[k] = -2
        hits += len(found[ids[k]] & set(ids[np.lexsort((ids, -score))[:5]].tolist()))
    assert len(ids) > 1500 and hits >= 0.9 * 5 * len(asked)
