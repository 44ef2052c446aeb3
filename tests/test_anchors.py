from pyspark.sql import functions as F

from evidentia.operators import anchors as A
from evidentia.operators import annotations as N


def test_behaviour(spark):
    lines = ["", None, "await send(x)", "import a from 'b'", "  // close", "es.on('x', handler)", "if (x) y.save(1)", "plain"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").orderBy("i")
    assert [r[0] for r in df.select(A.behaviour_score(F.col("line"))).collect()] == [0, 0, 65, -25, 15, 70, 43, 0]


def test_concepts_and_teaching(spark):
    df = spark.createDataFrame([("emit(x)", "stream", "event bridge"), ("emit(x)", "else", "event bridge"), ("cache.get(k)", "replay", "incidental logging"), ("x", "", "")], "line string, about string, role string")
    got = df.select(A.concept_score(F.col("line"), F.col("about"), F.col("role")), A.teaching_score(F.col("line"), F.col("role"), F.col("about"))).collect()
    assert [tuple(r) for r in got] == [(80, 105), (45, 65), (55 - 70, -80), (0, 0)]


def test_relevance(spark):
    df = spark.createDataFrame([("How does the administration fetchConfig work?", "src/admin.js", "const config = admin(fetch);"), (None, None, "x"), ("how", "", None)], "question string, path string, line string")
    terms = A.relevance_terms(F.col("question"), F.col("path"))
    got = df.select(terms.alias("t"), A.relevance_score(F.col("line"), terms).alias("s")).collect()
    assert got[0].t == ["administration", "fetch", "config", "src", "admin"] and got[0].s == 5 + 5 + 8 + 5
    assert got[1].t == [] and got[1].s == 0 and got[2].s == 0


def test_score_lines(spark):
    rows = [("k", i, line, "call boundary", 30, "Where is the stream sent?", None, None, "a.js") for i, line in enumerate(["send(x);", "", "y"], 1)]
    df = spark.createDataFrame(rows, "key string, line_no int, line string, role string, noted int, question string, intent string, caption string, path string")
    got = A.score_lines(df).orderBy("line_no").collect()
    # one point, 30 noted, 80 for the concept, 0 relevant terms; 35 of behaviour; twice 25 + 30 taught
    assert got[0].anchor == 35 and got[0].teaching == 55 and got[0].score == 1 + 30 + 80 + 35 + 110
    assert [r.boundary for r in got] == [True, True, False]


LINE = "path string, lang string, line_no int, line string"


def notes(spark, lang, *lines):
    df = spark.createDataFrame([("p", lang, i, x) for i, x in enumerate(lines, 1)], LINE)
    return [(r.role, r.facts, r.note, r.score, r.worthy) for r in N.annotate(df, languages=(lang,)).orderBy("line_no").collect()]


def test_five_languages(spark):
    assert notes(spark, "kotlin", "fun load(x: Int) {", "  val y = read(x)", "  return y", "}") == [
        ("function boundary", ["definition: load", "calls: load"], "Introduces load, the function this Kotlin excerpt is explaining.", 55, True),
        ("state/data", ["assigns: y", "calls: read", "inside: load"], "Binds y so later Kotlin code in this scope can use it.", 50, True),
        ("output boundary", ["inside: load"], "Controls what leaves this Kotlin scope or how it stops executing.", 35, True),
        ("supporting statement", ["inside: load"], "", 0, False),
    ]
    assert notes(spark, "bash", "x=1", "echo $x", "fi")[:2] == [("state/data", ["assigns: x", "calls: x"], "Stores x so later shell code in this scope can use it.", 48, True), ("output boundary", ["calls: echo"], "Controls what leaves this shell scope or how it stops executing.", 58, True)]
    assert notes(spark, "yaml", "name: x", "# c", "- a") == [("configuration entry", ["configuration: name"], "Sets name, a configuration value consumed by code or tooling.", 20, True), ("", [], "", 0, False), ("", [], "", 0, True)]
    assert notes(spark, "toml", 'a = "b"')[0][:2] == ("configuration entry", ["configuration: a"])
    assert notes(spark, "python", "raise ValueError(x)", "return f(x)", "", None)[0][0] == "error boundary"


def test_facts_of_the_graph_come_first_and_eight_at_most(spark):
    lines = spark.createDataFrame([("p", "go", 1, "x := run(y)")], LINE)
    facts = spark.createDataFrame([("p", 1, f"k{i}", "n") for i in range(9)] + [("p", 1, "k0", "n"), ("p", 2, "other", "n"), ("p", 1, "empty", "")], "path string, line_start int, kind string, name string")
    assert N.annotate(lines, facts, ("go",)).first().facts == [f"k{i}: n" for i in range(8)]
    assert N.annotate(lines, facts.filter("kind = 'k0'"), ("go",)).first().facts == ["k0: n", "assigns: x", "calls: run"]


def test_stories_and_roles_of_nodes(spark):
    df = spark.createDataFrame([("A request fails with an ERROR", ["call_expression", "Return_statement"]), (None, None), ("", ["if_statement"])], "t string, n array<string>")
    got = df.select(N.story(F.col("t"), "Go"), N.role_of_nodes(F.col("n"))).collect()
    assert got[0][0] == "This Go excerpt participates in a request or handler flow. The excerpt includes a failure path that changes how execution continues."
    assert [r[1] for r in got] == ["call boundary", "", "branch"] and got[1][0] == got[2][0] == ""
