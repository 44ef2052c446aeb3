"""A revision is made without holding a source's lines."""

from __future__ import annotations

import hashlib

import pyarrow as pa

from evidentia.plans import corpus_queries
from evidentia.sources import corpus


def test_only_the_digests_of_blocks_are_collected(spark):
    plan = corpus_queries.source_revision(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("collect_list") < plan.index("MapInArrow")  # above it: at most 4096 digests of 20 bytes


def test_digests_over_batches():
    lines = [("a", f"{i:05d}:x") for i in range(1000)] + [("b", "é:1")]
    batch = lambda rows: pa.RecordBatch.from_pydict({"repo": [r for r, _ in rows], "line": [x for _, x in rows]})
    got = [tuple(r.values()) for b in corpus.line_digests(batch(lines[i : i + 7]) for i in range(0, len(lines), 7)) for r in b.to_pylist()]
    want = lambda repo: hashlib.sha256("\n".join(x for r, x in lines if r == repo).encode()).hexdigest()[:16]
    assert got == [("a", want("a"), 1000), ("b", want("b"), 1)]
    assert list(corpus.line_digests(iter([]))) == []
