import hashlib
import random
import re

import numpy as np
import pytest

from evidentia.llm import fill_in_middle as M


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows():
    rng = random.Random(5)
    fixed = [None, "", "a", "é", "<", "<P", "<P>", "<<S>x", "<PM>", "<M >", "x<€>", "P>", "<S", ">", "\0", "Zß𝔸漢字 a\r\n", "ab " * 30_000, "<" * 999, "<P" * 500, "é" * 5_000]
    made = ["".join(rng.choice("abP<>SM é漢\n𝔸") for _ in range(rng.randint(0, 80))) for _ in range(1_500)]
    return [*enumerate(fixed + made), (None, "no id"), (None, None), (3, "twice"), (3, "twice"), (2**62, "a large id <x>")]


def test_equals_brute_force_and_restores(spark):
    given = rows()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in given], "doc_id long, text string, form string, row int")
    made = M.transform(docs)
    assert made.columns == ["doc_id", "text", "row", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("again", M.restore(made["output"], made["form"])).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted(((i, t, *brute(i, t)) for i, t in given), key=key)
    assert all(r.again == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_table_of_no_rows(spark):
    assert M.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_sentinel_that_arises_at_a_join_is_not_taken_for_one(spark):
    texts = [(i, "<" * (i % 7) + "P" * (i % 3) + "<" * (i % 5)) for i in range(400)]
    made = M.transform(spark.createDataFrame(texts, "doc_id long, text string"))
    assert all(r.again == r.text for r in made.withColumn("again", M.restore(made["output"], made["form"])).collect())


@pytest.mark.parametrize("size", [1, 15, 17, 255, 4_097, 70_000])
def test_lanes_equal_a_walk_byte_by_byte(size):
    rng = np.random.default_rng(size)
    data = rng.choice(np.frombuffer("PSMa<>é€ ".encode(), np.uint8), size)
    offsets = np.unique(np.concatenate([[0, size], rng.integers(0, size + 1, 9)])).astype(np.int64)
    offsets = np.insert(offsets, 1, offsets[1])  # an empty text too
    state, want, first = 0, [], set(offsets[:-1].tolist())
    for i, byte in enumerate(data.tolist()):
        at = state * 12 + M._CLASS[byte] + 6 * (i in first)
        want.append(M._EMITS[at])
        state = M._TO[at]
    assert M.scan(data, offsets).tolist() == want


def test_counts_are_those_of_the_pattern():
    texts = [t or "" for _, t in rows()]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    found = M.locate(M.scan(data, offsets), offsets, np.zeros((len(texts), 2), np.int64))
    assert found["n"].tolist() == [len(re.findall(r"[A-Za-z]+|[^A-Za-z]", t, re.S)) for t in texts]
    assert found["marked"].tolist() == [bool(re.search("<[PSM]>", t)) for t in texts]
