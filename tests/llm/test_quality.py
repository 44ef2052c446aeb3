import math
import random
import re
import zlib

import numpy as np
import pytest

from evidentia.llm import quality as Q

WORDS = [f"w{c}{d}" for c in "abcdefgh" for d in "rstuvxyz"]
JUNK = ["$$$", "%%", "buy", "now", "!!!", "click"]


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def corpus(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words, good = rng.choices(WORDS, k=rng.randint(3, 60)), rng.random() < 0.7
        if not good:
            for _ in range(1 + len(words) // 4):
                words.insert(rng.randrange(len(words) + 1), rng.choice(JUNK))
        rows.append((i, " ".join(words), int(good)))
    return rows


def run(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    return Q.classify(d, spark.createDataFrame(labels, "doc_id long, label int"))


def test_held_out_accuracy(spark):
    rows = corpus(1_500)
    got = run(spark, [r[:2] for r in rows], [(r[0], r[2]) for r in rows]).collect()
    label = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in label if is_held_out(i)} and len(got) == len(rows)
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_labels_of_held_out_documents_are_not_read(spark):
    rows = corpus(300)
    one = run(spark, [r[:2] for r in rows], [(r[0], r[2]) for r in rows])
    other = run(spark, [r[:2] for r in rows], [(r[0], 1 - r[2] if is_held_out(r[0]) else r[2]) for r in rows])
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))


def test_indicators_equal_a_plain_version():
    texts = ["", "One one ONE two", "a-b  a-b", "é é $$$x", " ", "x" * 5_000, "tail"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    text, _ = Q.indicators(data, offsets)
    plain = []
    for i, t in enumerate(texts):
        words = re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+|[^A-Za-z0-9\s\u0080-\U0010ffff]+", t.lower())
        pairs = list(zip(words, words[1:], strict=False))
        found = {*words, *pairs} | {"twice" for a, b in pairs if a == b} | {"thrice" for a, b, c in zip(words, words[1:], words[2:], strict=False) if a == b == c}
        plain += [i] * len(found)
    assert text.tolist() == plain
    alone = [Q.indicators(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[1].tolist() for t in texts]
    assert [x for a in alone for x in a] == Q.indicators(data, offsets)[1].tolist()


def test_ratios_are_those_of_counts(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate([("good text", 1), ("good", 1), ("bad text", 0), ("bad bad", 0), (None, 1)] * 12) if not is_held_out(i)]
    model = Q.fit(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, label int"))
    counts = np.zeros((Q.DIM, 2))
    for _, t, y in rows:
        raw = (t or "").encode()
        counts[Q.indicators(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[1], y] += 1
    totals = (counts + 1).sum(axis=0)
    want = [math.log(((b + 1) / totals[1]) / ((a + 1) / totals[0])) for a, b in counts[:2_000].tolist()]
    assert np.allclose(model.ratio[:2_000], want) and np.allclose(model.ratio, np.log((counts[:, 1] + 1) / totals[1]) - np.log((counts[:, 0] + 1) / totals[0]))


def descent_problem(n=120, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.choice([-1.0, 1.0], n)
    x = rng.normal(0, 1, (n, 12)) + y[:, None] * 0.4
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ends = np.arange(0, 12 * n + 1, 12)
    return x, y, ends, np.tile(np.arange(12), n)


def objective(w, x, y, cost):
    return 0.5 * w @ w + cost * np.maximum(0, 1 - y * (np.c_[x, np.ones(len(x))] @ w)).sum()


@pytest.mark.parametrize("blocks", [1, 4])
def test_descent_closes_the_duality_gap(blocks):
    x, y, ends, found = descent_problem()
    cost, w, alpha = 1.0, np.zeros(13), np.zeros(len(y))
    for turn in range(400):
        total = np.zeros(13)
        for k in range(blocks):
            own = np.arange(k, len(y), blocks)
            a = alpha[own].copy()
            total += Q.descend(np.arange(0, 12 * len(own) + 1, 12), np.tile(np.arange(12), len(own)), x[own].reshape(-1), y[own], a, w.copy(), float(blocks), turn, 2, cost)
            alpha[own] = a
        w += total
    assert np.allclose(w, (alpha * y) @ np.c_[x, np.ones(len(y))]) and (alpha >= 0).all() and (alpha <= cost).all()
    dual = alpha.sum() - 0.5 * w @ w
    assert -1e-9 <= objective(w, x, y, cost) - dual <= 0.02 * objective(w, x, y, cost)


def test_odd_rows(spark):
    rows = corpus(200)
    docs = [r[:2] for r in rows] + [(None, "no id"), (900, None), (901, ""), (902, "word " * 100_000), (5, rows[5][1]), (903, "\0  漢字")]
    labels = [(r[0], r[2]) for r in rows] + [(None, 1), (900, 1), (901, None), (902, 7), (5, rows[5][2]), (7, 0), (7, 1), (10**12, 1)]
    d = spark.createDataFrame([(*r, "s", 1) for r in docs], "doc_id long, text string, score string, label int")
    out = Q.classify(d, spark.createDataFrame(labels, "doc_id long, label int"))
    assert out.columns == ["doc_id", "text", "label", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not r.text}) == 1


def test_one_label_or_none(spark):
    docs = [(i, "some text") for i in range(9)]
    assert {r.predicted for r in run(spark, docs, [(i, 0) for i in range(9)]).collect()} == {0}
    assert {r.score for r in run(spark, docs, [(99, 1)]).collect()} == {0.5}
    assert run(spark, [], [(1, 1)]).collect() == []


def test_sample_keeps_its_bounds(monkeypatch):
    monkeypatch.setattr(Q, "SAMPLE_ROWS", 10)
    monkeypatch.setattr(Q, "SAMPLE_BYTES", 100)
    assert Q._buckets(np.array([4, 0, 50, 5, 3, 1]), np.array([10, 0, 10, 20, 10, 10])) == [0, 3, 5]
    assert Q._buckets(np.array([4, 4]), np.array([101, 100])) == [1]


def test_labels_that_go_to_every_task_and_labels_that_are_joined_give_the_same(spark, monkeypatch):
    rows = corpus(200)
    one = Q.fit(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, label int"))
    monkeypatch.setattr(Q, "LABELS_AT_ONCE", 0)
    other = Q.fit(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, label int"))
    assert (one.ratio == other.ratio).all() and abs(one.constant - other.constant) < 0.2
