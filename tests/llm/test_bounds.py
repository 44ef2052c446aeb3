"""Memory and file descriptors stay within bounds on unfavourable input."""

import os
import random
import tracemalloc

import numpy as np
import pytest

from evidentia.llm import kneser_ney, language_id


def block(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


@pytest.mark.parametrize(("letters", "size"), [([chr(0x4E00 + k) for k in range(3_000)], 15), ([chr(c) for c in (*range(97, 123), *range(0x3B1, 0x3C9), *range(0x4E00, 0x4F00))], 100)])
def test_bundles_of_many_short_texts(letters, size):
    rng = random.Random(1)
    data, offsets = block(["".join(rng.choices(letters, k=size)) for _ in range(10_000)])
    tracemalloc.start()
    got, n = language_id.bundles(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20 and (n == size).all()
    few = language_id.bundles(data[: offsets[40]], offsets[:41])[0]
    assert (few == got[:40]).all()


def test_either_way_of_adding_gives_the_same(monkeypatch):
    rng = np.random.default_rng(2)
    owner = np.sort(rng.integers(0, 60, 9_000))
    code = rng.integers(1, 3_000, 9_000)
    table = language_id._sums(code, owner, 70)
    monkeypatch.setattr(language_id, "CELLS", 0)
    monkeypatch.setattr(language_id, "AT_ONCE", 1_000)
    assert (table == language_id._sums(code, owner, 70)).all()


def test_a_model_of_many_buckets_keeps_few_files_open(tmp_path):
    for b in range(600):
        np.save(tmp_path / f"word-{b}.npy", np.array([b], np.uint64))
    arrays = kneser_ney._Arrays(str(tmp_path), 600)
    before = len(os.listdir("/proc/self/fd"))
    assert [int(arrays.open("word", b)[0]) for b in range(600)] == list(range(600)) and arrays.open("word", 600) is None
    assert len(os.listdir("/proc/self/fd")) - before <= kneser_ney.MAPS
