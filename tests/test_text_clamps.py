"""Both clamps on whole texts, against Python."""

from __future__ import annotations

import re

from evidentia.plans import state_queries

SPACE = " \t\n\r\f\v"
TEXTS = [None, "", "   ", "short text", "  edges trimmed  ", "a" + " " * 600 + "b", "word " * 300, "x" * 700, "\n\t" + "two  blanks " * 90, "ends in blanks" + "\n" * 9]


def _head(text):
    if text is None or len(text) <= 100:
        return text
    cut = text[:100]
    return cut.rpartition(" ")[0] or cut


def _squashed(text):
    return None if text is None else re.sub(f"[{SPACE}]+", " ", text).strip(" ")[:500]


def test_whole_texts(spark, tmp_path):
    more = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").union(more)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.head, r.squashed) for r in state_queries.text_clamps(spark, str(tmp_path)).collect()}
    assert got == {r.doc_id: (_head(r.text), _squashed(r.text)) for r in rows.collect()}
    assert got[10**6 + 5][1] == "a b"
