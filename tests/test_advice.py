"""Whole jobs: what a cut of the candidates, texts or ids would lose."""

from __future__ import annotations

from evidentia.operators import evidence as E
from evidentia.plans import common, evidence_queries


def test_a_layer_is_found_at_any_rank(spark, monkeypatch):
    items = spark.createDataFrame([(1, i, f"src/{i}.json" if i < 100 else "src/last.py", "", None, "search", ["zz"]) for i in range(101)], "q int, ord int, path string, content string, similarity double, tool string, tokens array<string>")
    monkeypatch.setattr(evidence_queries, "_items", lambda spark, sf_dir: items)
    assert "src/last.py" in {r.path for r in evidence_queries.layer_diverse(spark, "").collect()}


def test_layers_by_their_definition(spark):
    import random

    pick = random.Random(3)
    paths = ["src/api/a.js", "src/api/b.js", "src/ui/c.js", "test/d.js", "src/e.js", "x.json", "y.md", "z.css"]
    rows = [(q, rank + 1, pick.choice(paths)) for q in range(30) for rank in range(pick.randrange(1, 15))]
    ranked = spark.createDataFrame(rows, "q int, rank int, path string")
    layers = {(r.q, r["rank"]): r.layer for r in E.layer_diverse(ranked, 99).collect()}
    want = []
    for q in range(30):
        own, taken, seen, kinds = [r for r in rows if r[0] == q], [], set(), set()
        for r in own:
            if r[2] not in seen and layers[r[:2]] not in kinds:
                seen.add(r[2]), kinds.add(layers[r[:2]]), taken.append(r)
        for r in own:
            if r[2] not in seen:
                seen.add(r[2]), taken.append(r)
        taken += [r for r in own if r not in taken]
        want += [(*r, i + 1) for i, r in enumerate(taken[:6])]
    got = [(r.q, r["rank"], r.path, r.place) for r in E.layer_diverse(ranked, 6).collect()]
    assert sorted(got) == sorted(want)
