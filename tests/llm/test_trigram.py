"""The trigram model against its definition."""

import math
import zlib
from collections import Counter, defaultdict

import pytest

from evidentia.llm import kneser_ney, kneser_ney_trigram

from .test_text_operators import SF, WORDS, _tokens


def _by_definition(tokens, train):
    count, grams = Counter(w for d in train for w in tokens[d]), Counter()
    for d in train:
        padded = ["start", "start", *tokens[d]]
        grams.update(zip(padded, padded[1:], padded[2:], strict=False))
    levels = [grams]
    for _ in range(2):
        lower = Counter(g[1:] for g in levels[0])
        levels.insert(0, lower)
    d1, d2, d3 = (kneser_ney.discounts([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]) for c in levels)
    sums = []
    for c in levels:
        total, kinds = Counter(), defaultdict(lambda: [0, 0, 0])
        for g, n in c.items():
            total[g[:-1]] += n
            kinds[g[:-1]][min(n, 3) - 1] += 1
        sums.append((total, kinds))

    def p(gram):
        low = 1 / (len(count) + 1)
        for k, d in ((1, d1), (2, d2), (3, d3)):
            g, (total, kinds) = gram[-k:], sums[k - 1]
            if total[g[:-1]]:
                n = levels[k - 1][g]
                low = ((n - d[min(n, 3) - 1]) if n else 0) / total[g[:-1]] + sum(a * b for a, b in zip(kinds[g[:-1]], d, strict=True)) / total[g[:-1]] * low
        return low

    return p, count


@pytest.mark.parametrize("partitions", [1, 4])
def test_trigrams_by_their_definition(spark, partitions):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(120).union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(WORDS)], "doc_id long, text string")).cache()
    tokens = {r.doc_id: _tokens(r.text) for r in docs.collect()}
    train = [d for d in tokens if zlib.crc32(str(d).encode()) % 7 != 2]
    p, count = _by_definition(tokens, train)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.doc_id: r for r in kneser_ney.score_corpus(docs, order=3).collect()}
        model = kneser_ney_trigram.train(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(model.hot) or partitions == 1  # "a b c" and the like go by the other way
    assert set(got) == set(tokens)
    for d, ws in tokens.items():
        padded = ["start", "start", *ws]
        want = sum(math.log10(p(g)) for g in zip(padded, padded[1:], padded[2:], strict=False))
        assert math.isclose(got[d].score, want, rel_tol=1e-9)
        assert got[d].n_known == sum(count[w] > 0 for w in ws)


def test_two_words_before_count(spark):
    docs = spark.createDataFrame([(i, "a x b c x d") for i in range(40)], "doc_id long, text string")
    two, three = (kneser_ney.score_corpus(docs, order=n).first().score for n in (2, 3))
    assert three > two  # x is followed by b after a, and by d after c


def test_trigram_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert kneser_ney.score_corpus(empty, order=3).count() == 0
    one = kneser_ney.score_corpus(spark.createDataFrame([(0, None)], "doc_id long, text string"), order=3).first()
    assert one.n_tokens == 1 and math.isfinite(one.score)
    with pytest.raises(ValueError):
        kneser_ney.score_corpus(empty, order=4)
