import hashlib
import math

import numpy as np
import pytest

from evidentia.llm import vector_codes as V


def brute(rows, parts=8, entries=16, rounds=6):
    """Plain Python over (vec_id, embedding, label) with unique ids."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) and abs(x) < V.LIMIT for x in v)]
    kept.sort(key=lambda r: r[0])
    size = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def code(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), entry, strict=True)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, v, _ in kept:
                own[code(v, p)[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(x) for c in zip(*x, strict=True)] if x else entry for x, entry in zip(own, books[p], strict=True)]
    out = {}
    for i, v, label in kept:
        found = [code(v, p) for p in range(parts)]
        out[i] = ("".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label)
    totals = {}
    for _, error, label in out.values():
        totals[label] = totals.get(label, 0) + error
    sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return {i: (c, e, totals[label], sha) for i, (c, e, label) in out.items()}


def run(spark, rows):
    df = V.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    return {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()}


def vectors(n, width, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, spread, (7, width))
    return [(i * 3, (centres[i % 7] + rng.normal(0, 0.2, width)).astype(np.float32).tolist(), None if i % 11 == 0 else i % 4) for i in range(n)]


@pytest.mark.parametrize(("n", "width"), [(300, 16), (120, 64), (5, 8)])
def test_equals_brute_force(spark, n, width):
    rows = vectors(n, width, n)
    assert run(spark, rows) == brute(rows)


def test_bad_vectors_and_ties(spark):
    rows = vectors(60, 16, 1)
    rows += [(1000 + i, v, 1) for i, v in enumerate([None, [], [None] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1e9] * 16])]
    rows += [(2000 + i, rows[5][1], 2) for i in range(50)]  # copies: entries that are equal or unused
    rows += [(-4 - i, [0.0] * 16, 3) for i in range(20)]
    assert run(spark, rows) == brute(rows)


def test_other_widths_extra_columns_and_empty_tables(spark):
    rows = [(1, [1.0, 2.0, 3.0], 1, "a"), (2, [1.0, 2.0], 1, "b"), (3, [1.5, -2.0, 0.25], None, "c"), (None, [1.0, 2.0, 3.0], 1, "d"), (3, [1.5, -2.0, 0.25], None, "c")]
    df = V.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string"))
    assert sorted((r.vec_id or 0, r.error, r.label_error) for r in df.collect()) == [(0, 0, 0), (1, 0, 0), (3, 0, 0), (3, 0, 0)]
    assert V.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_partial_distances_find_the_lowest_of_the_nearest():
    rng = np.random.default_rng(3)
    for k in (1, 2, 5, 16):
        x, book = rng.integers(-3, 4, (500, 6)), rng.integers(-3, 4, (k, 6))
        d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        code, error = V.nearest_entries(x, book)
        assert code.tolist() == d.argmin(axis=1).tolist() and error.tolist() == d.min(axis=1).tolist()
    far = np.full((3, 8), 2**27 - 1)
    assert V.nearest_entries(far, -far[:1])[1].tolist() == [8 * (2**28 - 2) ** 2] * 3
