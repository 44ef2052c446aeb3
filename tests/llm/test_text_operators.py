import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from evidentia.llm import bpe, kneser_ney, language_id, license_scan, packing

SF = "/root/testdata/sf0.001"
WORDS = [None, "", "   ", "The cat, the dog.", "The cat, the dog.", "Über die Straße 'twas 12 <|endoftext|> don't", "z" * 30_000, "a b c " * 9_000, "!!! ??? 123", "under the MIT License, Apache License, Version 2 and CC BY-NC under the mit license"]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, "en" if i % 2 else None, i, "clash") for i, t in enumerate(WORDS)] + [(None, "no id here", "de", 1, "x"), (3, "The cat, the dog.", "en", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score long, ids string")


@pytest.fixture(scope="module")
def empty(edge):
    return edge.filter("false")


@pytest.fixture(scope="module")
def some(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_bpe_is_tiktoken(spark, some, edge):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    reference = bpe._encoder(ranks)
    docs = some.select("doc_id", "text").union(edge.selectExpr("doc_id + 1000000", "text"))
    want = Counter((r.doc_id, tuple(reference.encode_ordinary(r.text or ""))) for r in docs.collect())
    encoded = bpe.encode(docs, ranks, chunk=50_000)
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == want
    texts = Counter((r.doc_id, (r.text or "").encode()) for r in docs.collect())
    assert Counter((r.doc_id, bytes(r.bytes)) for r in bpe.decode(encoded, ranks).collect()) == texts


def test_bpe_decoding_of_odd_rows(spark):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    table = {v: k for k, v in bpe.read_ranks(ranks).items()}
    ids = [None, [], [300, 5, 300], [0], list(range(25_000)), [], None, [7]]  # a row of more ids than a batch holds
    rows = [(i, x, f"t{i}", "h") for i, x in enumerate([*ids, *ids])]
    encoded = spark.createDataFrame(rows, "at int, ids array<int>, token string, head string").coalesce(1)
    got = bpe.decode(encoded, ranks)
    assert got.columns == ["at", "token", "head", "bytes"]
    assert [(r[0], r[1], r[2], None if r[3] is None else bytes(r[3])) for r in got.collect()] == [(i, t, h, None if x is None else b"".join(table[k] for k in x)) for i, x, t, h in rows]
    assert bpe.decode(encoded.filter("false"), ranks).count() == 0
    with pytest.raises(Exception, match="no token of the vocabulary"):
        bpe.decode(spark.createDataFrame([([10**9],)], "ids array<int>"), ranks).collect()


def test_bpe_of_nothing(empty):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert bpe.encode(empty, ranks).count() == 0


def test_bpe_digest(edge):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    reference = bpe._encoder(ranks)
    docs = edge.filter("doc_id is not null").dropDuplicates(["doc_id"])
    for r in bpe.round_trip(docs, ranks).collect():
        ids = reference.encode_ordinary(WORDS[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((WORDS[r.doc_id] or "").encode()).hexdigest()


def _pieces_fit(rows, ids, length):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc, pieces in by_doc.items():
        parts = sorted(pieces, key=lambda r: r.start)
        if isinstance(ids.get(doc), list):
            got = b"".join(bytes(r.ids) for r in parts)
            assert got == np.array(ids[doc], "<u4").tobytes()
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0 and r.length == len(r.ids) // 4
            at += r.length
        assert at <= length
    return len(by_seq)


def test_packing_keeps_every_id_once(spark, some, edge):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    docs = some.select("doc_id", "text").union(edge.filter("doc_id is not null").dropDuplicates(["doc_id"]).selectExpr("doc_id + 1000000", "text"))
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    rows = packing.pack(docs.repartition(3), path, 512, 8).collect()
    n = _pieces_fit(rows, ids, 512)
    total = sum(map(len, ids.values()))
    assert sum(r.length for r in rows) == total
    assert n <= 1.02 * total / 512 + 2
    assert {r.doc_id: r.doc_tokens for r in rows} == {d: len(x) for d, x in ids.items()}


def test_packing_edges(edge, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.pack(empty, path).count() == 0
    rows = packing.pack(edge, path, 64, 2).collect()
    _pieces_fit(rows, {}, 64)
    assert sum(r.doc_id is None for r in rows) >= 1
    assert sum(r.doc_id == 3 and r.start == 0 for r in rows) == 2


def test_tokenizer_ranks_follow_the_merges():
    ranks = packing.byte_ranks(public_tokenizers.path("byte_bpe_50k.json"))
    assert ranks == bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def _tokens(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return [*re.findall(rb"[^\x20\x09-\x0D]+", low), None]


def test_kneser_ney_by_its_definition(spark, some, edge):
    docs = some.select("doc_id", "text").union(edge.filter("doc_id is not null").dropDuplicates(["doc_id"]).selectExpr("doc_id + 1000000", "text"))
    rows = docs.collect()
    tokens = {r.doc_id: _tokens(r.text) for r in rows}
    train = [d for d in tokens if zlib.crc32(str(d).encode()) % 7 != 2]
    count = Counter(w for d in train for w in tokens[d])
    pairs = Counter(p for d in train for p in zip(["start", *tokens[d]], tokens[d], strict=False))
    after, kinds, cont = Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
    for (p, w), c in pairs.items():
        after[p] += c
        kinds[p][min(c, 3) - 1] += 1
        cont[w] += 1
    db, dw = (kneser_ney.discounts([sum(x == k for x in v.values()) for k in (1, 2, 3, 4)]) for v in (pairs, cont))
    total, n, v = sum(cont.values()), sum(count.values()), len(count)
    rest = sum(dw[min(c, 3) - 1] for c in cont.values()) / total

    def p(prev, w):
        low = ((cont[w] - dw[min(cont[w], 3) - 1]) / total if cont[w] else 0) + rest / (v + 1)
        if not after[prev]:
            return low
        c = pairs[prev, w]
        return ((c - db[min(c, 3) - 1]) / after[prev] if c else 0) + sum(a * b for a, b in zip(kinds[prev], db, strict=True)) / after[prev] * low

    assert abs(sum(p(b"the", w) for w in count) + p(b"the", b"\0never") - 1) < 1e-9
    got = {r.doc_id: r for r in kneser_ney.score_corpus(docs).collect()}
    held = [0.0, 0.0]
    for d, ws in tokens.items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(count[w] > 0 for w in ws), n, d not in train)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(a, w)) for a, w in zip(["start", *ws], ws, strict=False)), rel_tol=1e-9)
        if r.held_out:
            held[0] += r.score
            held[1] += r.base_score
    assert held[0] > held[1]


def test_kneser_ney_edges(edge, empty):
    assert kneser_ney.score_corpus(empty).count() == 0
    rows = kneser_ney.score_corpus(edge).collect()
    assert len(rows) == len(WORDS) + 2 and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    one = kneser_ney.score_corpus(edge.filter("doc_id = 0")).collect()[0]
    assert one.n_tokens == 1


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(docs).collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) > 0.98 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_language_id_brute_force():
    data = "Ab ça, ab!".encode()
    v, n = language_id.bundles(np.frombuffer(data + b"123", np.uint8), np.array([0, len(data), len(data) + 3]))
    letters, symbols = language_id._letters(), language_id._symbols()
    want = np.zeros(language_id.DIM)
    for word in ("ab", "ça", "ab"):
        padded = [0, *(int(symbols[ord(c)]) for c in word), 0]
        for a, b, c in zip(padded, padded[1:], padded[2:], strict=False):
            want += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    assert np.allclose(v[0], want) and n[0] == 6
    assert not v[1].any()


def test_language_id_edges(edge, empty):
    assert language_id.identify(empty).count() == 0
    rows = language_id.identify(edge).collect()
    assert len(rows) == len(WORDS) + 2
    for r in rows:
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or ""))
        assert 0 <= r.score <= 1
    nothing = language_id.identify(edge.filter("lang is null")).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def _license_rows(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    phrases = {"mit": b"under the mit license", "apache-2": b"apache license version 2", "cc-by-nc": b"cc by nc"}
    return len(words), [(k, i) for k, p in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]


def test_license_places(spark, edge):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").union(edge.selectExpr("doc_id + 1000000", "text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in license_scan.summary(license_scan.scan(docs)).collect():
        n, places = _license_rows(texts[r.doc_id])
        at = [i for _, i in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, len(places), min(at, default=None), max(at, default=None), ",".join(sorted({k for k, _ in places})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_license_templates(spark, empty):
    grant = "Permission is hereby granted, free of charge, to any person obtaining one copy of this software and associated documentation files"
    docs = spark.createDataFrame([(1, "x " * 50 + grant), (2, grant.replace("free", "paid")), (3, "free software to any person " * 3)], "doc_id long, text string")
    rows = {r.doc_id: r for r in license_scan.summary(license_scan.scan(docs)).collect()}
    assert rows[1].labels == "mit" and 0.8 <= rows[1].score < 1
    assert rows[2].labels == rows[3].labels == ""  # the key phrase, or most of the words, are missing
    assert license_scan.summary(license_scan.scan(empty)).count() == 0
