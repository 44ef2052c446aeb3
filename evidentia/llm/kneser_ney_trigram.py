"""The trigram model of kneser_ney: the same words, discounts and formulas with one more level.

A trigram (u, v, w) is counted in the bucket of its middle word, where its context (u, v) and its end (v, w) are whole too, so
that one exchange gives the counts, the contexts and the continuation counts of the bigrams. A middle word that fills
more than a quarter of a bucket is dealt by (v, w) over all buckets, and only its contexts are added up in a second exchange.
Trigrams move in ROUNDS slices of the buckets, each slice's shuffle being released before the next, and a bucket keeps
the top bits of its sorted hashes in a directory, 32 bits each and counts of a byte with a list of the larger ones.

The words of a gram are told apart by 48 bits; an unseen gram is taken for a seen one with a chance of about 2e-9.
"""

from __future__ import annotations

import functools
import gc
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .codec import narrow, pack, steps, unpack
from .kneser_ney import _ROWS, _16, _32, END, ROWS, START, STRETCH, _Arrays, _key, _ones_to_fours, _range, _save, _summed, discounts, n_buckets, tokens
from .scratch import local_path, shared_dir, written

ROUNDS = 4
_LOW = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class TrigramModel:
    """A few numbers; the arrays are files of the shared folder."""

    folder: str
    buckets: int
    n_tokens: int
    n_words: int
    #: Middle words that are dealt by (v, w).
    hot: np.ndarray
    trigram_discounts: tuple[float, float, float]
    bigram_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    n_bigrams: int
    word_rest: float


def _spot(key: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket that has nothing to do with the order of keys."""
    return _range(K.mix(key + np.uint64(0x2545F4914F6CDD1D)), buckets)


def _order(bucket: np.ndarray, along: np.ndarray, buckets: int) -> np.ndarray:
    """The order by bucket, and there by the first 48 bits of along."""
    return np.argsort(bucket.astype(np.uint64) << np.uint64(48) | along >> _16) if buckets <= 1 << 16 else np.lexsort((along, bucket))


def _is_hot(v: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return np.isin(v, hot) if len(hot) else np.zeros(len(v), bool)


def _home(v: np.ndarray, pair: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of what has the middle word v: by v alone, or by the pair where v is hot."""
    return np.where(_is_hot(v, hot), _spot(pair, buckets), _spot(v, buckets))


def grams(cur: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 48-bit words of each token's trigram; two starts stand before each text."""
    w = cur >> _16
    v, u = np.empty_like(w), np.empty_like(w)
    v[1:], u[2:] = w[:-1], w[:-2]
    first = begin[:-1]
    v[first] = u[first] = START >> _16
    second = first + 1
    u[second[second < begin[1:]]] = START >> _16
    return u, v, w


def _stretches(batches: Iterator[pa.RecordBatch], emit):  # noqa: ANN001, ANN202
    """The rows that emit makes of the tokens of each stretch of texts."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for kind, b, blob in emit(held):
            yield pa.RecordBatch.from_pydict({"kind": [kind], "bucket": [b], "data": [blob], "stats": [None]}, schema=_ROWS)

    for batch in batches:
        data, offsets = K.column_bytes(batch.column("text"))
        for i, j in K.blocks(offsets):
            if size and size + offsets[j] - offsets[i] > STRETCH:
                yield from rows()
                held.clear()
                size = 0
            held.append(tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            size += int(offsets[j] - offsets[i])
    if held:
        yield from rows()


def _parts(order: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of ascending bucket numbers."""
    cuts = np.searchsorted(order, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, int(cuts[b]), int(cuts[b + 1])


def _count_words(buckets: int):  # noqa: ANN202
    def emit(held: list) -> Iterator[tuple[int, int, bytes]]:
        words, n = np.unique(np.concatenate([cur for cur, _ in held]), return_counts=True)
        for b, i, j in _parts(_range(words, buckets), buckets):
            yield 0, b, pack(steps(words[i:j]), n[i:j].astype(np.uint32))

    return lambda batches: _stretches(batches, emit)


def _merge_words(folder: str):  # noqa: ANN202
    def apply(group: pd.DataFrame) -> pd.DataFrame:
        bucket = int(group["bucket"].iloc[0])
        parts = [unpack(x, 2) for x in group["data"]]
        words, n = _summed(np.concatenate([np.cumsum(k) for k, _ in parts]), np.concatenate([c.astype(np.int64) for _, c in parts]))
        _save(folder, "word", bucket, words)
        _save(folder, "word-n", bucket, n.astype(np.uint64))
        top = np.argsort(-n, kind="stable")[:64]
        out = [(4, bucket, None, [int(n.sum()), len(words)])]
        out += [(5, bucket, None, [int(words[k] >> _16), int(n[k])]) for k in top]
        return pd.DataFrame(out, columns=["kind", "bucket", "data", "stats"])

    return apply


def _count(buckets: int, hot: np.ndarray, turn: int):  # noqa: ANN202
    def emit(held: list) -> Iterator[tuple[int, int, bytes]]:
        u, v, w = (np.concatenate(x) for x in zip(*(grams(*h) for h in held), strict=True))
        bucket = _spot(v, buckets)
        far = np.flatnonzero(_is_hot(v, hot))
        bucket[far] = _spot(_key(v[far], w[far]), buckets)
        mine = np.flatnonzero(bucket % ROUNDS == turn)
        if not len(mine):
            return
        u, v, w, bucket = u[mine], v[mine], w[mine], bucket[mine]
        # one sort by the first bits of everything; runs that they leave broken are only sent as two
        order = _order(bucket, v >> np.uint64(24) << np.uint64(40) | u >> np.uint64(36) << np.uint64(28) | w >> np.uint64(36) << np.uint64(16), buckets)
        u, v, w, bucket = u[order], v[order], w[order], bucket[order]
        new_v = np.concatenate([[True], (v[1:] != v[:-1]) | (bucket[1:] != bucket[:-1])])
        new_u = new_v | np.concatenate([[True], u[1:] != u[:-1]])
        first = np.flatnonzero(new_u | np.concatenate([[True], w[1:] != w[:-1]]))
        n = np.diff(np.append(first, len(u))).astype(np.uint32)
        u, v, w, bucket, new_v, new_u = u[first], v[first], w[first], bucket[first], new_v[first], new_u[first]
        for b, i, j in _parts(bucket, buckets):
            at_u, at_v = np.flatnonzero(new_u[i:j]), np.flatnonzero(new_v[i:j])
            us = u[i:j][at_u]
            fan_v = np.diff(np.append(np.searchsorted(at_u, at_v), len(at_u))).astype(np.uint32)
            fan_u = np.diff(np.append(at_u, j - i)).astype(np.uint32)
            yield 1, b, pack(steps(v[i:j][at_v]), fan_v, (us & _LOW).astype(np.uint32), (us >> _32).astype(np.uint16), fan_u, (w[i:j] & _LOW).astype(np.uint32), (w[i:j] >> _32).astype(np.uint16), n[i:j])

    return lambda batches: _stretches(batches, emit)


def _opened(blob: bytes) -> tuple[np.ndarray, ...]:
    vs, fan_v, u_low, u_high, fan_u, w_low, w_high, n = unpack(blob, 8)
    u = u_low.astype(np.uint64) | u_high.astype(np.uint64) << _32
    w = w_low.astype(np.uint64) | w_high.astype(np.uint64) << _32
    return np.repeat(u, fan_u), np.repeat(np.repeat(np.cumsum(vs), fan_v), fan_u), w, n


def save_table(folder: str, name: str, bucket: int, keys: np.ndarray, values: np.ndarray) -> None:
    """Ascending keys and the rows of their values."""
    bits = max(1, int(len(keys)).bit_length() - 3)
    cell = (keys >> np.uint64(64 - bits)).astype(np.int64)
    _save(folder, f"{name}-at", bucket, np.searchsorted(cell, np.arange((1 << bits) + 1)).astype(np.uint32))
    _save(folder, f"{name}-key", bucket, (keys << np.uint64(bits) >> _32).astype(np.uint32))
    values = values[:, None] if values.ndim == 1 else values
    _save(folder, f"{name}-n", bucket, np.minimum(values, 255).astype(np.uint8))
    large = np.flatnonzero(values.ravel() >= 255)
    _save(folder, f"{name}-large", bucket, np.stack([large, values.ravel()[large].astype(np.int64)]).astype(np.int64))


class Tables(_Arrays):
    def rows(self, name: str, keys: np.ndarray, bucket: np.ndarray, width: int) -> np.ndarray:
        """The values of keys, in any order; zeros where a key is missing."""
        out = np.zeros((len(keys), width), np.int64)
        order = _order(bucket, keys, self.buckets)
        for b, i, j in _parts(bucket[order], self.buckets):
            have = self.open(f"{name}-key", b)
            if have is None or not len(have):
                continue
            own, start = order[i:j], self.open(f"{name}-at", b)
            bits = np.uint64(len(start).bit_length() - 1)
            k = keys[own]
            cell, print_ = (k >> (np.uint64(64) - bits)).astype(np.int64), (k << bits >> _32).astype(np.uint32)
            low, end = start[cell].astype(np.int64), start[cell + 1].astype(np.int64)
            high = end.copy()
            for _ in range(int((high - low).max()).bit_length()):
                mid = (low + high) >> 1
                less = (low < high) & (have[np.minimum(mid, len(have) - 1)] < print_)
                low, high = np.where(less, mid + 1, low), np.where(less, high, np.where(low < high, mid, high))
            hit = np.flatnonzero((low < end) & (have[np.minimum(low, len(have) - 1)] == print_))
            found = self.open(f"{name}-n", b)[low[hit]].astype(np.int64)
            where, large = self.open(f"{name}-large", b)
            for c in range(width):
                at = np.flatnonzero(found[:, c] == 255)
                found[at, c] = large[np.searchsorted(where, low[hit][at] * width + c)]
            out[own[hit]] = found
        return out


def _by_kind(n: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """What a context adds up: its total and its successors seen once, twice and more."""
    return [weight.astype(np.int64), *((x).astype(np.int64) for x in (n == 1, n == 2, n >= 3))]


def _sent(kind: int, keys: np.ndarray, bucket: np.ndarray, values: list[np.ndarray], buckets: int) -> Iterator[tuple]:
    order = np.lexsort((keys, bucket))
    for b, i, j in _parts(bucket[order], buckets):
        own = order[i:j]
        yield kind, b, pack(steps(keys[own]), *(narrow(x[own]) for x in values)), None


def _merge_counts(folder: str, buckets: int, hot: np.ndarray):  # noqa: ANN202
    def apply(group: pd.DataFrame) -> pd.DataFrame:
        bucket = int(group["bucket"].iloc[0])
        u, v, w, n = (np.concatenate(x) for x in zip(*(_opened(x) for x in group["data"]), strict=True))
        pair = _key(u, v)
        key = _key(pair, w)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        c = np.add.reduceat(n[order].astype(np.int64), first)
        own = order[first]
        save_table(folder, "trigram", bucket, key[first], c)
        u, v, w, pair = u[own], v[own], w[own], pair[own]
        del key, order, first, own, n
        stats, out = _ones_to_fours(c), []
        far = _is_hot(v, hot)
        context, *sums = _summed(pair[~far], *(x[~far] for x in _by_kind(c, c)))
        save_table(folder, "context", bucket, context, np.stack(sums, axis=1))
        if far.any():
            context, *sums = _summed(pair[far], *(x[far] for x in _by_kind(c, c)))
            out += _sent(1, context, _spot(context, buckets), sums, buckets)
        end = _key(v, w)
        order = np.argsort(end)
        end = end[order]
        first = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
        m = np.diff(np.append(first, len(end)))
        save_table(folder, "bigram", bucket, end[first], m)
        stats += _ones_to_fours(m)
        v, w = v[order[first]], w[order[first]]
        middle, *sums = _summed(v, *_by_kind(m, m))
        out += _sent(2, middle, _range(middle << _16, buckets), sums, buckets)
        word, times = np.unique(w, return_counts=True)
        out += _sent(3, word, _range(word << _16, buckets), [times], buckets)
        out.append((4, bucket, None, stats))
        return pd.DataFrame(out, columns=["kind", "bucket", "data", "stats"])

    return apply


def _merge_rest(folder: str):  # noqa: ANN202
    def apply(group: pd.DataFrame) -> pd.DataFrame:
        bucket, stats = int(group["bucket"].iloc[0]), [0] * 6

        def summed(kind: int, width: int) -> tuple[np.ndarray, ...] | None:
            parts = [unpack(x, width + 1) for x in group.loc[group["kind"] == kind, "data"]]
            return _summed(np.concatenate([np.cumsum(p[0]) for p in parts]), *(np.concatenate([p[k + 1].astype(np.int64) for p in parts]) for k in range(width))) if parts else None

        if (rows := summed(1, 4)) is not None:
            save_table(folder, "hot", bucket, rows[0], np.stack(rows[1:], axis=1))
        if (rows := summed(2, 4)) is not None:
            _save(folder, "middle", bucket, rows[0])
            _save(folder, "middle-n", bucket, np.stack(rows[1:], axis=1).astype(np.uint64))
        if (rows := summed(3, 1)) is not None:
            word, m = rows
            _save(folder, "successor", bucket, word)
            _save(folder, "successor-n", bucket, m.astype(np.uint64))
            stats = [int(m.sum()), int((m >= 3).sum()), *_ones_to_fours(m)]
        return pd.DataFrame([(4, bucket, None, stats)], columns=["kind", "bucket", "data", "stats"])

    return apply


def _release(spark) -> None:  # noqa: ANN001
    """Shuffle files go once nothing refers to their plan."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def train(docs: DataFrame) -> TrigramModel:
    spark = docs.sparkSession
    texts = docs.select("text")
    buckets = n_buckets(texts)
    folder = local_path(shared_dir(spark))
    os.makedirs(folder, exist_ok=True)
    words = written(texts.mapInArrow(_count_words(buckets), ROWS).groupBy("bucket").applyInPandas(_merge_words(folder), ROWS), "words")

    def sums(df: DataFrame, n: int) -> list[int]:
        return [int(x) for x in df.filter("kind = 4").agg(*[F.coalesce(F.sum(F.col("stats")[k]), F.lit(0)) for k in range(n)]).first()]

    n_tokens, n_words = sums(words, 2)
    frequent = [r.word for r in words.filter("kind = 5").select(F.col("stats")[0].alias("word"), F.col("stats")[1].alias("n")).filter(F.col("n") * 4 * buckets > n_tokens).collect()]
    # the start is the middle of each text's first trigram: as often as the end
    hot = np.unique(np.array([*frequent, *([int(START >> _16)] if int(END >> _16) in frequent else [])], np.uint64))
    merged = []
    for turn in range(ROUNDS):
        counted = texts.mapInArrow(_count(buckets, hot, turn), ROWS)
        merged.append(written(counted.groupBy("bucket").applyInPandas(_merge_counts(folder, buckets, hot), ROWS), f"round-{turn}", "uncompressed"))
        del counted
        _release(spark)
    every = functools.reduce(DataFrame.union, merged)
    ends = written(every.filter("kind in (1, 2, 3)").groupBy("bucket").applyInPandas(_merge_rest(folder), ROWS), "rest")
    both = sums(every, 8)
    total, many, *uni = sums(ends, 6)
    w = discounts(uni)
    rest = (w[0] * uni[0] + w[1] * uni[1] + w[2] * many) / total if total else 1.0
    return TrigramModel(folder, buckets, n_tokens, n_words, hot, discounts(both[:4]), discounts(both[4:]), w, total, rest)


def _level(n: np.ndarray, context: np.ndarray, d: tuple[float, float, float], lower: np.ndarray) -> np.ndarray:
    """The interpolated probability of entries with counts n after contexts (total, once, twice, more)."""
    less, total = np.array([0.0, *d]), context[:, 0]
    most = np.maximum(total, 1)
    seen = np.where(total > 0, (n - less[np.minimum(n, 3)]) / most, 0.0)
    return seen + np.where(total > 0, context[:, 1:] @ less[1:] / most, 1.0) * lower


def log_probabilities(model: TrigramModel, arrays: Tables, cur: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token its log10 probability after its two words before, and how often training has the token."""
    u, v, w = grams(cur, begin)
    words, at = np.unique(cur, return_inverse=True)
    count = arrays.values("word", "word-n", words)[at]
    m = arrays.values("successor", "successor-n", words, shift=True).astype(np.int64)
    dw = np.array([0.0, *model.word_discounts])
    word_p = ((m - dw[np.minimum(m, 3)]) / model.n_bigrams if model.n_bigrams else 0.0) + model.word_rest / (model.n_words + 1)
    middles, v_at = np.unique(v, return_inverse=True)
    after = arrays.values("middle", "middle-n", middles << _16, shift=True)
    after = (after if after.ndim == 2 else np.zeros((len(middles), 4)))[v_at]
    pair, end = _key(u, v), _key(v, w)
    home = _home(v, end, model.hot, model.buckets)
    p = _level(arrays.rows("bigram", end, home, 1)[:, 0], after, model.bigram_discounts, word_p[at])
    far = _is_hot(v, model.hot)
    context = np.zeros((len(cur), 4), np.int64)
    context[~far] = arrays.rows("context", pair[~far], home[~far], 4)
    context[far] = arrays.rows("hot", pair[far], _spot(pair[far], model.buckets), 4)
    n = arrays.rows("trigram", _key(pair, w), home, 1)[:, 0]
    return np.log10(_level(n, context, model.trigram_discounts, p)), count
