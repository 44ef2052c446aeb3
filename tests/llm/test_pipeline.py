import corpus_pipeline
import pytest

from evidentia.llm import language_id
from tests.llm.test_pairs_search_warc import _brute

SF = "/root/testdata/sf0.001"
#: Values of columns whose names the stages use themselves.
X = ("clash", 1, 2, 3)


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    all_rows = {r.doc_id: r for r in docs.collect()}
    scored = {r.doc_id: r for r in language_id.identify(docs).collect()}
    kept = {i: r.text for i, r in all_rows.items() if scored[i].lang_pred != "und" and scored[i].score >= corpus_pipeline.MIN_COSINE}
    import re

    seen = {}
    for i in sorted(kept):
        seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[i] or ""), i)
    kept = {i: kept[i] for i in seen.values()}
    kept = {i for i, (root, _) in _brute(kept).items() if root == i}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == kept
    assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())


@pytest.mark.parametrize("k", [0, 1, 2])
def test_stage_keeps_columns_and_odd_rows(spark, k):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, gone_id int, row int, keep_id long"
    text = "the and of to in a the and of to in a word"
    docs = spark.createDataFrame([(1, text, "en", "s", 1, *X), (2, text, "en", "s", 1, *X), (None, text, "en", None, None, *X), (3, None, None, None, None, *X), (4, "", "en", "s", 0, *X), (5, "123", "en", "s", 3, *X)], schema)
    out = corpus_pipeline.STAGES[k][1](spark, docs, SF)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert None in ids and (1 in ids)
    assert (2 in ids) == (k == 0) and (5 in ids) == (k != 0)
    assert corpus_pipeline.STAGES[k][1](spark, docs.filter("false"), SF).count() == 0


@pytest.mark.parametrize("k", [1, 2])
def test_other_text_under_the_id_of_a_copy_stays(spark, k):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    near = a if k == 1 else a.replace("a7 ", "c7 ")
    docs = spark.createDataFrame([(1, a), (2, near), (2, b), (3, None), (None, a)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.STAGES[k][1](spark, docs, SF).collect()), key=str)
    assert got == sorted([(1, a), (2, b), (3, None), (None, a)], key=str)
