"""Rewrites of plans against hand-made expectations, and their pieces against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import questions as Q
from evidentia.operators import rewrites as W

CODE_TEXT = "const a = 1;\nconst b = 2;\nfunction go() { return a + b; }\nexport default go;"
ITEM = "q long, ord int, tool string, path string, line_start int, line_end int, similarity double, content string"


def plan_of(spark, *slots):
    return spark.createDataFrame([(1, list(slots))], f"q long, plan array<{W.SLOT}>")


def slot(id_, kind=W.CODE, path="a.js", a=1, z=20, intent="shows x"):
    return (id_, kind, intent, [(path, a, z)] if path else [])


def run(spark, text, slots, items, hubs=None):
    asked = Q.classify(spark.createDataFrame([(1, text)], "q long, text string"))
    rows = W.rewrite(plan_of(spark, *slots), asked, spark.createDataFrame([(1, *x) for x in items], ITEM), hubs)
    return [(s.id, s.kind, [h.path for h in s.hints]) for s in rows.first().plan]


def item(ord_, path, similarity=0.5, content=CODE_TEXT, tool="search", a=1, z=30):
    return (ord_, tool, path, a, z, similarity, content)


def test_figure_and_code_are_added_where_asked_for(spark):
    got = run(spark, "Draw a diagram and show me the code of the parser", [], [item(1, "src/parser.js", 0.9), item(2, "src/other.css", 0.01), item(3, "README.md", 0.9)])
    assert got[0][:2] == ("implementation-flow", W.FIGURE) and set(got[0][2]) == {"src/parser.js", "src/other.css"}
    assert ("code-parser", W.CODE, ["src/parser.js"]) in got and not any("README.md" in p for _, _, p in got)


def test_a_plan_that_has_all_stays(spark):
    slots = [slot("d", W.FIGURE, "src/parser.js"), slot("c", W.CODE, "src/parser.js", 1, 30)]
    assert run(spark, "Draw a diagram and show me the code of the parser", slots, [item(1, "src/parser.js", 0.9)])[:2] == [("d", W.FIGURE, ["src/parser.js"]), ("c", W.CODE, ["src/parser.js"])]


def test_overview_maps_the_spine(spark):
    items = [item(1, "src/main.js"), item(2, "src/store/db.js"), item(3, "src/planner/run.js", 0.9), item(4, "docs/a.md", 0.9)]
    got = run(spark, "Give me an overview of the whole system", [slot("tail", W.CALLOUT, None)], items, ["src/store/db.js"])
    assert got[0][0] == "architecture-spine" and got[0][1] == W.FIGURE and got[0][2][0] == "src/store/db.js" and "docs/a.md" not in got[0][2]
    assert got[1][0] == "overview-db" and "tail" in [g[0] for g in got] and len(got) <= W.SLOTS


API = [
    item(1, "src/server/routes.js", 0.4, "app.post('/api/ask', withRequest({body: askRequestSchema}, handle));\nconst a = 1;\nconst b = 2;\nconst c = 3;"),
    item(2, "src/contracts.js", 0.3, "export const askRequestSchema = z.object({\nquestion: z.string()\n});\nconst d = 4;"),
    item(3, "src/schema/other.js", 0.35, "export const otherSchema = z.object({\nvalidate: 1\n});\nconst validation = 4;\nconst request = body;"),
    item(4, "public/app.js", 0.3, "const r = await fetch('/api/ask');\nconst a = 1;\nconst b = 2;\nrender(r);"),
    item(5, "src/server/sse.js", 0.3, "streamSSE(c, run);\nsave(trace);\nconst x = 1;\nconst y = 2;"),
]


def test_facets_follow_the_names_bound_at_the_route(spark):
    asked = spark.createDataFrame([(1, "Which API endpoint is called to ask a question?")], "q long, text string")
    r = W.facets(spark.createDataFrame([(1, *x) for x in API], ITEM), asked).first()
    assert r.route_handler.path == "src/server/routes.js" and r.identifiers == ["askRequestSchema"]
    assert r.request_contract.path == "src/contracts.js" and r.caller_usage.path == "public/app.js"


def test_interfaces_get_their_facets(spark):
    got = run(spark, "Which API endpoint is called to ask a question?", [], API)
    ids = [g[0] for g in got]
    assert got[0][1] == W.SEQUENCE and {"api-route-handler", "api-request-contract", "api-caller-usage"} <= set(ids)
    lone = run(spark, "Which API endpoint is called to ask a question?", [], API[4:])
    assert "api-caller-gap" in [g[0] for g in lone]


def test_supporting_actors(spark):
    items = [item(1, "src/a.js"), item(2, "package.json", 0.2, "{}"), item(3, "config.yaml", 0.2, "a: 1")]
    got = run(spark, "Which dependencies and configuration files shape this?", [slot("x")], items)
    assert ("supporting-actors", W.CALLOUT, ["package.json", "config.yaml"]) in got
    held = run(spark, "Which dependencies and configuration files shape this?", [slot("x", W.CALLOUT, "package.json")], items)
    assert "supporting-actors" not in [g[0] for g in held]


def test_named_code(spark):
    items = [item(1, "src/a.js", 0.5, " 10  // x\n 11  export function readConfig(a) {\n 12    return a;\n 13  }\n 14  done();", a=10, z=14), item(2, "src/b.js", 0.9)]
    asked = Q.classify(spark.createDataFrame([(1, "Show me the code of readConfig please")], "q long, text string"))
    rows = spark.createDataFrame([(1, *x) for x in items], ITEM)
    named = W.named_refs(rows, asked).first().named
    assert [(n.name, n.path, n.line_start, n.line_end) for n in named] == [("readConfig", "src/a.js", 11, 35)]
    got = run(spark, "Show me the code of readConfig please", [], items)
    assert ("code-read-config", W.CODE, ["src/a.js"]) in got


def test_contract_names_by_part_and_place(spark):
    text = "x withRequest(direct) body: firstSchema, query: qSchema, params: pValidator, body: firstSchema, query: other, params: zContract, query: lastSchema"
    df = spark.createDataFrame([(text,), ("no",), ("withRequest({body: aSchema" + " " * 1_300 + "query: bSchema",)], "c string")
    assert [r[0] for r in df.select(W.contract_identifiers(F.col("c"))).collect()] == [["firstSchema", "pValidator", "zContract", "qSchema"], [], ["aSchema"]]


def plain_add(plan, new, front, protect, limit=6):
    plan = list(plan)
    if any(s[0] == new[0] for s in plan):
        return plan
    if len(plan) < limit:
        return [new, *plan] if front else [*plan, new]
    free = [i for i, s in enumerate(plan) if not (protect and s[1] in W.VISUAL)]
    at = next((i for i in reversed(free) if plan[i][1] == W.CALLOUT), free[-1] if free else -1)
    if at < 0:
        return plan
    rest = plan[:at] + plan[at + 1 :]
    return [new, *rest] if front else plan[:at] + [new] + plan[at + 1 :]


@pytest.mark.parametrize(("front", "protect"), [(False, False), (False, True), (True, False)])
def test_adding_a_slot_equals_a_plain_version(spark, front, protect):
    rng = random.Random(4)
    plans = [[slot(f"s{i}" if rng.random() < 0.9 else "new", rng.choice([W.CODE, W.CALLOUT, *W.VISUAL])) for i in range(rng.randint(0, 7))] for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(plans)), f"q long, plan array<{W.SLOT}>")
    new = W.slot(F.lit("new"), W.CODE, F.lit("i"), F.array().cast(f"array<{W.REF}>"))
    got = {r.q: [s.id for s in r.plan] for r in df.select("q", W.add(F.col("plan"), new, front, protect).alias("plan")).collect()}
    assert got == {i: [s[0] for s in plain_add(p, ("new", W.CODE), front, protect)] for i, p in enumerate(plans)}


def test_overlapping_excerpts_go(spark):
    slots = [slot("a", a=1, z=20), slot("b", a=5, z=24), slot("c", a=15, z=34), slot("d", W.CALLOUT, a=1, z=20), slot("e", path="b.js"), slot("f", path=None), ("g", W.CODE, "x", [("a.js", None, None)])]
    got = W.drop_overlaps(plan_of(spark, *slots)).first().plan
    assert [s.id for s in got] == ["a", "c", "d", "e", "f", "g"]


def test_rows_without_plan_evidence_or_text(spark):
    asked = Q.classify(spark.createDataFrame([(1, None), (2, "Draw it"), (3, "")], "q long, text string"))
    plans = spark.createDataFrame([(1, None), (2, [])], f"q long, plan array<{W.SLOT}>")
    out = W.rewrite(plans, asked, spark.createDataFrame([], ITEM))
    assert sorted((r.q, len(r.plan)) for r in out.collect()) == [(1, 0), (2, 0), (3, 0)]


def test_unique_ids(spark):
    df = spark.createDataFrame([(["a", "a-2"],), ([],)], "ids array<string>")
    assert [r[0] for r in df.select(W.unique_id(F.col("ids"), F.lit("a"))).collect()] == ["a-3", "a"]
