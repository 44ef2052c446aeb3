import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.llm import codec
from evidentia.llm import kernels as K

PATTERN = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
TEXT = st.lists(st.sampled_from([*"ab'stmdrevlL  \n\t é1٣!-.😀\u00a0", "'s", "'ll", " '"]), max_size=24).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_pretokens(texts):
    data, offsets = K.column_bytes(pa.array(texts, pa.string()))
    s = K.pretoken_starts(data, offsets)
    got = [bytes(data[a:b]).decode() for a, b in zip(s, np.append(s[1:], len(data)), strict=True)] if len(s) else []
    assert got == [w for t in texts for w in PATTERN.findall(t)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=5))
def test_words_and_hashes(texts):
    data, offsets = K.column_bytes(pa.array(texts, pa.string()))
    table = K.byte_table("\x20\x09\x0a\x0b\x0c\x0d")
    s, e, at = K.word_spans(data, offsets, table)
    words = [regex.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    assert [bytes(data[a:b]) for a, b in zip(s, e, strict=True)] == [w for ws in words for w in ws]
    assert np.diff(at).tolist() == [len(w) for w in words]
    h = K.span_hash(data, s, e).tolist()
    seen = {}
    for w, x in zip((w for ws in words for w in ws), h, strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_blocks_cover_everything():
    offsets = np.array([0, 10, 10, 5000, 5001])
    assert list(K.blocks(offsets, 100)) == [(0, 2), (2, 3), (3, 4)]


def test_codec_round_trip():
    arrays = [np.array([], np.uint32), np.array([1, 2**31, 5], np.uint32), np.array([2**63, 1], np.uint64), np.array([7], np.uint16)]
    for a, b in zip(arrays, codec.unpack(codec.pack(*arrays), 4), strict=True):
        assert a.tolist() == b.tolist() and a.dtype == b.dtype


def test_words_of_one_hash_are_told_apart(monkeypatch):
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in [*rng.integers(1, 30, 400), 3000, 3000]]
    words += [words[-1], words[-1][:-1] + b"z"]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    for constant in (False, True):
        if constant:
            monkeypatch.setattr(K, "span_hash", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
        found, first, hashes, inverse = K.distinct_spans(data, starts, ends)
        assert len(set(found)) == len(found) == len(first) == len(hashes) and [found[k] for k in inverse] == words


def test_counts_beyond_32_bits_keep_their_value():
    from evidentia.llm import codec

    for top in (0, 1, 2**32 - 1, 2**32, 4_294_967_303, 2**50):
        x = np.array([1, top], np.int64)
        assert codec.unpack(codec.pack(codec.narrow(x)), 1)[0].tolist() == [1, top]
    assert codec.narrow(np.zeros(0, np.int64)).dtype == np.uint32
