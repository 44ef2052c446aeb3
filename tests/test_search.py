from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evidentia.functions import places
from evidentia.operators import evidence as E
from evidentia.operators import graph as G
from evidentia.operators import quality
from evidentia.operators import retrieval as R
from evidentia.operators import search as S

FILES = [
    ("src/cache.js", "// keeps answers for five minutes so that repeated questions are fast\nexport function createAnswerCache() {}"), ("src/watch.js", "// notices changed files and indexes them again\nexport function createWatcher() {}"),
    ("src/auth.js", "// signs people in with a password and a session cookie\nexport function signIn() {}"), ("src/bill.js", "// charges a credit card and sends the invoice\nexport function charge() {}"),
    ("src/mail.js", "// sends a letter of welcome to new people\nexport function welcome() {}"), (".env", "PASSWORD=session cookie credit card invoice"), ("package.json", '{"dependencies": {"card": "1", "cookie": "2"}}'),
]
ASKED = [(1, "How long are answers kept for repeated questions?", "src/cache.js"), (2, "what happens when files are changed", "src/watch.js"), (3, "signing in with a password", "src/auth.js"), (4, "Who sends the invoice for a credit card?", "src/bill.js"), (5, "where is createWatcher", "src/watch.js")]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(p, 1, c.count("\n") + 1, c) for p, c in FILES], "path string, line_start int, line_end int, content string")


def asked(spark, rows):
    return spark.createDataFrame(rows, "q int, text string")


def test_answers_are_found(spark, chunks):
    found = S.search(chunks, asked(spark, [(q, t) for q, t, _ in ASKED]), k=3)
    top = defaultdict(list)
    for r in found.orderBy("q", "rank").collect():
        top[r.q].append(r.path)
    assert all(path in top[q] for q, _, path in ASKED)
    assert top[5][0] == "src/watch.js"  # an exact name beats what is only near
    assert not any(".env" in p for p in top.values())


def test_lexical_only_rows_have_no_similarity(spark, chunks):
    rows = S.search(chunks, asked(spark, [(1, "createWatcher")]), threshold=0.99).collect()
    assert rows and all(r.similarity is None and r.origins == ["lexical"] for r in rows)
    off = S.search(chunks, asked(spark, [(1, "createWatcher")]), lexical=False, threshold=0.99).collect()
    assert off == []


@pytest.mark.parametrize("text", ["", "   ", "?!...", '"', None])
def test_odd_questions_are_safe(spark, chunks, text):
    assert R.bm25(chunks.select(F.col("path").alias("key"), F.col("content").alias("text")), asked(spark, [(1, text)]), 5).count() == 0
    S.search(chunks, asked(spark, [(1, text)])).collect()


def test_quoted_terms_are_searched(spark, chunks):
    rows = R.bm25(chunks.select(F.col("path").alias("key"), F.col("content").alias("text")), asked(spark, [(1, '"invoice"')]), 5).collect()
    assert "src/bill.js" in {r.key for r in rows}


def test_shapes(spark):
    texts = ["how does createStore work", "use snake_case here", "see MAX_SIZE", "open src/a/b.js", "call fs.read(", "what is the plan, e.g. tomorrow", "how do react and express work together", "TypeScript and Node.js", "why is it slow", "", "look at `x`", "python integrates with it"]
    got = [r.shape for r in asked(spark, list(enumerate(texts))).select("q", R.query_shape(F.col("text")).alias("shape")).orderBy("q").collect()]
    assert got == ["identifier"] * 5 + ["product", "relational", "relational", "product", "product", "identifier", "relational"]


def test_policy_of_the_default_arm(spark):
    rows = {r.q: r for r in R.policy(asked(spark, [(1, "why slow"), (2, "createStore"), (3, "react works with express")])).collect()}
    assert (rows[1].use_boost, rows[1].use_rerank, rows[2].use_boost, rows[2].use_graph, rows[3].use_graph) == (False, False, True, False, True)


def test_manifests_step_back_unless_asked_for(spark):
    base = [("package.json", "card"), ("src/card.js", "card")]
    rows = spark.createDataFrame([(p, c, ["card"], [], m) for p, c in base for m in (True, False)], "path string, content string, tokens array<string>, families array<string>, manifest_seeking boolean")
    got = {(r.path, r.manifest_seeking): r.boost for r in R.domain_boost(rows).collect()}
    assert got == {("package.json", True): 3, ("package.json", False): -77, ("src/card.js", True): 40, ("src/card.js", False): 40}


def test_one_chunk_of_two_legs_is_one_row(spark):
    leg = lambda rows: spark.createDataFrame(rows, "q int, key string, score double, rank int")
    got = {r.key: r for r in R.fuse([("vector", leg([(1, "a", 0.9, 1), (1, "b", 0.5, 2)])), ("graph", leg([(1, "a", 7.0, 1), (1, "c", 9.0, 2)]))]).collect()}
    assert got["a"].similarity == 0.9 and got["a"].origins == ["graph", "vector"] and got["c"].similarity is None
    assert abs(got["a"].rrf - 2 / 61) < 1e-9


def test_diverse_paths_and_support(spark):
    rows = spark.createDataFrame([(1, p, i, i, 100.0 - i) for i, p in enumerate("aaabbcdd")], "q int, path string, line_start int, line_end int, score double")
    order = [F.desc("score"), F.asc("line_start")]
    assert [r.path for r in R.path_diverse(rows, 5, order).orderBy("rank").collect()] == ["a", "b", "c", "d", "a"]
    support = spark.createDataFrame([(1, "s", 50, 51, 9.0), (1, "t", 50, 51, 8.0), (1, "a", 0, 0, 99.0)], "q int, path string, line_start int, line_end int, score double")
    got = R.with_support(rows, support, 5, 2, order).orderBy("rank").collect()
    assert [(r.path, r.support) for r in got] == [("a", False), ("b", False), ("c", False), ("s", True), ("t", True)]


def test_rerank_by_definition(spark):
    scores = {1: 0.1, 2: 0.9, 3: 0.5, 4: 0.7}
    rows = spark.createDataFrame([(1, "q", str(v), k) for k, v in scores.items()], "q int, text string, content string, rank int")
    got = [r.content for r in R.rerank(rows, lambda t, c: c.cast("double"), head=3).orderBy("rank").collect()]
    model = {2: 1, 3: 2, 1: 3}
    want = sorted((1, 2, 3), key=lambda k: (-round(1 / (60 + k) + 1 / (60 + model[k]), 9), k))
    assert got == [str(scores[k]) for k in want] + ["0.7"]


def test_cosine_in_passes(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 3), float(i % 5), 1.0]) for i in range(40)] + [(90, None), (91, [0.0, 0.0, 0.0]), (92, [1.0])], "key int, vec array<double>")
    q = v.filter("key < 9").select(F.col("key").alias("q"), "vec")
    want = sorted(map(tuple, R.cosine_topk(v, q, 4).collect()))
    monkeypatch.setattr(R, "QUERY_BYTES", 60)
    monkeypatch.setattr(R, "BLOCK_BYTES", 100)
    assert sorted(map(tuple, R.cosine_topk(v, q, 4).collect())) == want and len(want) == 36


@pytest.mark.parametrize("blocks", [False, True])
def test_odd_vectors_hide_no_others(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(R, "QUERY_BYTES", 1)
        monkeypatch.setattr(R, "BLOCK_BYTES", 32)
    nan, inf = float("nan"), float("inf")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0, 0.0, 0.0]), (8, [1e300, 1e300])], "key int, vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [nan, 0.0]), (4, []), (5, None)], "q int, vec array<double>")
    got = [(r.q, r.key) for r in R.cosine_topk(v, q, 3).orderBy("q", "rank").collect()]
    assert got == [(1, 1), (1, 2), (1, 8), (2, 7)]


def test_terms_in_tasks_and_joined(spark, chunks, monkeypatch):
    docs = chunks.select(F.struct("path", "line_start").alias("key"), F.col("content").alias("text")).unionByName(spark.createDataFrame([(("x", 1), None), (("y", 1), "  ")], "key struct<path: string, line_start: int>, text string"))
    q = asked(spark, [(1, "invoice total"), (2, "the watcher of the store"), (3, None), (4, "store store"), (9, "nothingness")])
    want = sorted(map(tuple, R.bm25(docs, q, 3).collect()))
    monkeypatch.setattr(R, "QUERY_TERMS", 0)
    assert sorted(map(tuple, R.bm25(docs, q, 3).collect())) == want and want


def test_neighbours_of_a_hub(spark):
    edges = [(f"f{i:03d}", "hub") for i in range(300)] + [("a", "hub"), ("hub", "z"), ("a", "b"), ("a", "b")]
    seeds = [(1, "hub", 1), (1, "f000", 2), (1, "f001", 3), (2, "a", 1)]
    got = G.import_neighbours(spark.createDataFrame(edges, "path string, target string"), spark.createDataFrame(seeds, "q int, path string, seed_rank int"), 4).orderBy("q", "rank").collect()
    assert [(r.q, r.path, r.direction) for r in got] == [(1, "z", "imports"), (1, "a", "imported_by"), (1, "f002", "imported_by"), (1, "f003", "imported_by"), (2, "b", "imports"), (2, "hub", "imports")]


def test_import_resolution(spark):
    paths = spark.createDataFrame([(p,) for p in ("src/a/x.js", "src/b/y.ts", "src/b/index.js", "lib/pkg/mod.py", "other/pkg/mod.py", "top.js")], "path string")
    edges = [("src/a/x.js", "../b/y"), ("src/a/x.js", "./x"), ("src/a/x.js", "pkg.mod"), ("src/a/x.js", "top.js"), ("src/a/x.js", "../../../out"), ("src/a/x.js", "react"), ("top.js", "./src/b/index.js")]
    got = {(r.path, r.specifier): r.target for r in G.resolve_imports(spark.createDataFrame(edges, "path string, specifier string"), paths).collect()}
    assert got == {("src/a/x.js", "../b/y"): "src/b/y.ts", ("src/a/x.js", "pkg.mod"): "lib/pkg/mod.py", ("src/a/x.js", "top.js"): "top.js", ("top.js", "./src/b/index.js"): "src/b/index.js"}


CODE = {
    "a.py": ("import os.path\n@app.get('/x')\ndef go():\n    os.environ['KEY']", {("import", "os.path"), ("route", "/x"), ("definition", "go"), ("configuration", "KEY")}),
    "a.js": ("import {x} from './y'\napp.get('/u', f)\nclass K {}\nprocess.env.TOKEN", {("import", "./y"), ("route", "/u"), ("definition", "K"), ("configuration", "TOKEN")}),
    "a.rs": ("use std::io;\nfn main() {}\n#[get(\"/r\")]", {("import", "std::io"), ("entrypoint", "main"), ("definition", "main"), ("route", "/r")}),
    "a.go": ("func main() {\nos.Getenv(\"K\")", {("entrypoint", "main"), ("definition", "main"), ("configuration", "K")}),
    "a.css": (":root {\n--ink: #000;\n}\n.card { color: red }", {("design_token", "--ink"), ("style_rule", ".card ")}),
    "a.sh": ("set -euo\nexport PATH_X=1", {("safety", "-euo"), ("configuration", "PATH_X")}),
    "a.yaml": ("name: x", {("configuration", "name")}), "a.sol": ("event Paid(uint x);\nemit Paid(1);", {("event", "Paid"), ("event_emit", "Paid")}),
    "a.java": ("import a.b.C;\n@Service\nclass D {", {("import", "a.b.C"), ("component", "Service"), ("definition", "D")}), "a.ex": ("def run(x) do", {("definition", "run")}), "a.lua": ("local m = require('z')", {("module", "z")}),
    "a.php": ("Route::get('/p', 1);", {("route", "/p")}), "a.kt": ("fun main() {", {("entrypoint", "main"), ("definition", "main")}), "a.ml": ("let rec f x = x", {("definition", "f")}), "a.c": ("#include <stdio.h>\nint main(void) {", {("import", "stdio.h"), ("entrypoint", "main")}),
}


def test_line_facts(spark):
    files = spark.createDataFrame([(p, c) for p, (c, _) in CODE.items()], "path string, content string")
    got = defaultdict(set)
    for r in G.line_facts(files).collect():
        got[r.path].add((r.kind, r.name))
    for path, (_, want) in CODE.items():
        assert want <= got[path], path
    few = G.line_facts(files.filter("path = 'a.py'"), limit=2).orderBy("line_start").collect()
    assert [r.line_start for r in few] == [1, 2]


def test_hubs_and_spine(spark):
    edges = spark.createDataFrame([("src/planner.js", t) for t in "abcd"] + [("src/store.js", t) for t in "abc"] + [("src/main.js", "a"), ("src/planner2.js", "a"), ("src/planner2.js", "b"), ("src/store.js", "a")], "path string, target string")
    hubs = G.import_hubs(edges, 10)
    assert [(r.path, r.wires) for r in hubs.orderBy("rank").collect()][:2] == [("src/planner.js", 4), ("src/store.js", 3)]
    assert [r.path for r in G.architecture_spine(hubs, 3).orderBy("place").collect()] == ["src/planner.js", "src/store.js", "src/main.js"]


def test_layers_come_first(spark):
    paths = ["src/api/a.js", "src/api/b.js", "src/ui/c.js", "src/api/a.js", "test/d.js", "src/e.js"]
    rows = spark.createDataFrame([(1, i + 1, p) for i, p in enumerate(paths)], "q int, rank int, path string")
    got = [r["rank"] for r in E.layer_diverse(rows, 6).orderBy("place").collect()]
    assert got == [1, 3, 5, 6, 2, 4]


def test_score_ties_keep_order(spark):
    rows = spark.createDataFrame([(1, i, f"p{i}.x", "same", 0.5, "search", ["zz"]) for i in range(5)], "q int, ord int, path string, content string, similarity double, tool string, tokens array<string>")
    assert [r.ord for r in E.rank_evidence(rows).orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_citations_are_clamped(spark):
    evidence = spark.createDataFrame([("a", 10, 20), ("a", 40, 50), ("b", 1, 5)], "path string, s int, e int")
    refs = spark.createDataFrame([(1, "a", 15, 45), (2, "a", 30, 32), (3, "zz", 1, 2), (4, "b", 3, 9), (5, "a", 33, 36)], "ref_id int, path string, line_start int, line_end int")
    got = {r.ref_id: (r.line_start, r.line_end) for r in E.reconcile_refs(refs, evidence).collect()}
    assert got == {1: (15, 20), 2: (40, 50), 4: (3, 5), 5: (40, 50)} or got == {1: (15, 20), 2: (10, 20), 4: (3, 5), 5: (40, 50)}


def test_greedy_overlaps(spark):
    rows = spark.createDataFrame([(1, 1, "a", 1, 10), (1, 2, "a", 2, 9), (1, 3, "b", 2, 9), (1, 4, "a", 8, 20), (2, 1, "a", 1, 10)], "q int, ord int, path string, s int, e int")
    assert sorted((r.q, r.ord) for r in E.drop_overlapping(rows).collect()) == [(1, 1), (1, 3), (1, 4), (2, 1)]
    windows = spark.createDataFrame([("k", 1, 10, 9.0), ("k", 2, 11, 8.0), ("k", 30, 39, 7.0), ("j", 1, 10, 1.0)], "key string, s int, e int, score double")
    assert sorted((r.key, r.s, r.place) for r in E.suppress_overlaps(windows).collect()) == [("j", 1, 1), ("k", 1, 1), ("k", 30, 2)]


def test_diagrams(spark):
    sources = {1: "sequenceDiagram\nA->>B: hi\nalt x\nB->>A: y\nelse z\nend", 2: "nope", 3: "flowchart TD\nsubgraph a\nx[one] --> y", 4: "sequenceDiagram\nend\nalt x", 5: "flowchart TD\na[one --> b", 6: "sequenceDiagram\nelse x"}
    got = {r.id: r.problem for r in E.lint_diagrams(spark.createDataFrame(list(sources.items()), "id int, source string")).collect()}
    assert got == {1: None, 2: "header", 3: "open_block", 4: "end_without_block", 5: "brackets", 6: "branch_outside"}


def test_gate(spark):
    now = spark.createDataFrame([("a.recall", 0.5, 50), ("b.recall", 0.9, 50), ("c.gap", 0.3, 50), ("d.recall", 0.1, 3), ("e.recall", 0.80, 50), ("new", 1.0, 9)], "key string, value double, n int")
    old = spark.createDataFrame([("a.recall", 0.8), ("b.recall", 0.7), ("c.gap", 0.1), ("d.recall", 0.9), ("e.recall", 0.82), ("gone", 1.0)], "key string, value double")
    got = {r.key: r.verdict for r in quality.gate(now, old).collect()}
    assert got == {"a.recall": "regressed", "b.recall": "improved", "c.gap": "regressed", "d.recall": "small", "e.recall": "ok", "new": "missing", "gone": "missing"}


def test_env_files(spark):
    rows = spark.createDataFrame([(".env",), ("a/.env.prod",), ("env.js",), ("a.env",)], "path string")
    assert {r.path for r in rows.filter(~places.is_env_file(F.col("path"))).collect()} == {"env.js", "a.env"}
