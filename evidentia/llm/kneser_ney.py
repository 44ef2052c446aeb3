"""Interpolated modified Kneser-Ney model (bigrams here, trigrams in kneser_ney_trigram): counted in Spark, kept as sorted hash arrays in the shared folder,
mapped into memory by the workers that score.

A word is the top 64 bits of its hash, as a successor the top 48. Tasks count stretches of text and send each bucket
its sorted words and bigrams; a bucket merges them, writes its arrays and passes on the numbers of distinct
neighbours. The successors of one word spread over SPREAD buckets, so that no frequent word makes a bucket large.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .codec import narrow, pack, steps, unpack
from .scratch import local_path, shared_dir, written

WORD = K.byte_table("\x20\x09\x0a\x0b\x0c\x0d")
#: Hashes of the end of a text, which is a token, and of the start, which is only a context.
END, START = np.uint64(0x9FB21C651E98DF25), np.uint64(0x3C79AC492BA7B653)
#: Bytes of text that are counted before the counts move, and that are scored at once.
STRETCH = 32 << 20
SCORED = 4 << 20
#: Files of a model that a worker maps at once.
MAPS = 256
SPREAD = 8
#: Bytes of text whose grams a bucket holds at most, on average.
BUCKET = 24 << 20
_16, _32 = np.uint64(16), np.uint64(32)


def _range(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a hash; ascending with the hash."""
    return ((h >> _32) * np.uint64(buckets) >> _32).astype(np.int64)


def _place(prev: np.ndarray, cur: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a bigram."""
    return (_range(prev, buckets) + (cur & np.uint64(SPREAD - 1)).astype(np.int64) * max(1, buckets // SPREAD)) % buckets


def _key(prev: np.ndarray, cur: np.ndarray) -> np.ndarray:
    return K.mix(prev ^ K.mix(cur + np.uint64(0x632BE59BD9B4E019)))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens, ends included, and where each text's begin."""
    low = K.lower_ascii(data)
    s, e, at = K.word_spans(low, offsets, WORD)
    n = len(offsets) - 1
    out = np.empty(len(s) + n, np.uint64)
    begin = at + np.arange(n + 1)
    out[begin[1:] - 1] = END
    words = np.ones(len(out), bool)
    words[begin[1:] - 1] = False
    out[words] = K.span_hash(low, s, e) if len(s) else np.zeros(0, np.uint64)
    return out, begin


def contexts(cur: np.ndarray, begin: np.ndarray) -> np.ndarray:
    prev = np.empty_like(cur)
    prev[1:] = cur[:-1]
    prev[begin[:-1]] = START
    return prev


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys ascending, with the sums of their values."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[first], *(np.add.reduceat(v[order], first) for v in values))


#: kind 0: words and counts; 1: bigrams by context; 2: contexts with numbers of successors; 3: successors with numbers of contexts; 4: statistics.
ROWS = "kind int, bucket int, data binary, stats array<long>"
_ROWS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary()), ("stats", pa.list_(pa.int64()))])


def _count(buckets: int):  # noqa: ANN202
    def emit(held: list[np.ndarray], prevs: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
        cur, prev = np.concatenate(held), np.concatenate(prevs)
        words, n = np.unique(cur, return_counts=True)
        cuts = np.searchsorted(_range(words, buckets), np.arange(buckets + 1))
        for b in range(buckets):
            i, j = cuts[b], cuts[b + 1]
            if i < j:
                yield 0, b, pack(steps(words[i:j]), n[i:j].astype(np.uint32))
        cur = cur >> _16
        key = _key(prev, cur)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.append(first, len(key)))
        prev, cur = prev[order[first]], cur[order[first]]
        bucket = _place(prev, cur, buckets)
        order = np.lexsort((prev, bucket))
        prev, cur, n, bucket = prev[order], cur[order], n[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        for b in range(buckets):
            i, j = cuts[b], cuts[b + 1]
            if i < j:
                own, fan = np.unique(prev[i:j], return_counts=True)
                low, high = (cur[i:j] & np.uint64(0xFFFFFFFF)).astype(np.uint32), (cur[i:j] >> _32).astype(np.uint16)
                yield 1, b, pack(steps(own), fan.astype(np.uint32), low, high, n[i:j].astype(np.uint32))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        prevs: list[np.ndarray] = []
        size = 0
        for batch in batches:
            data, offsets = K.column_bytes(batch.column("text"))
            for i, j in K.blocks(offsets):
                if size and size + offsets[j] - offsets[i] > STRETCH:
                    for kind, b, blob in emit(held, prevs):
                        yield pa.RecordBatch.from_pydict({"kind": [kind], "bucket": [b], "data": [blob], "stats": [None]}, schema=_ROWS)
                    held, prevs, size = [], [], 0
                cur, begin = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                held.append(cur)
                prevs.append(contexts(cur, begin))
                size += int(offsets[j] - offsets[i])
        if held:
            for kind, b, blob in emit(held, prevs):
                yield pa.RecordBatch.from_pydict({"kind": [kind], "bucket": [b], "data": [blob], "stats": [None]}, schema=_ROWS)

    return apply


def _save(folder: str, name: str, bucket: int, array: np.ndarray) -> None:
    """Whole or not at all, and the same from every attempt of the task."""
    part = f"{folder}/{name}-{bucket}.{TaskContext.get().taskAttemptId()}.part"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, f"{folder}/{name}-{bucket}.npy")


def _ones_to_fours(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def _merge_counts(folder: str, buckets: int):  # noqa: ANN202
    def apply(group: pd.DataFrame) -> pd.DataFrame:
        bucket, out = int(group["bucket"].iloc[0]), []
        parts = [unpack(x, 2) for x in group.loc[group["kind"] == 0, "data"]]
        words, n = _summed(np.concatenate([np.cumsum(k) for k, _ in parts]), np.concatenate([c.astype(np.int64) for _, c in parts])) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        _save(folder, "word", bucket, words)
        _save(folder, "word-n", bucket, n.astype(np.uint64))
        prev, cur, count = [], [], []
        for x in group.loc[group["kind"] == 1, "data"]:
            own, fan, low, high, c = unpack(x, 5)
            prev.append(np.repeat(np.cumsum(own), fan))
            cur.append(low.astype(np.uint64) | high.astype(np.uint64) << _32)
            count.append(c)
        stats = [int(n.sum()), len(words), 0, 0, 0, 0]
        if prev:
            prev, cur, count = np.concatenate(prev), np.concatenate(cur), np.concatenate(count)
            key = _key(prev, cur)
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            c = np.add.reduceat(count[order].astype(np.int64), first)
            prev, cur = prev[order[first]], cur[order[first]]
            _save(folder, "bigram", bucket, key[first])
            _save(folder, "bigram-n", bucket, narrow(c))
            stats[2:] = _ones_to_fours(c)
            del key, order
            p, n1, n2, n3 = _summed(prev, *((x).astype(np.int64) for x in (c == 1, c == 2, c >= 3)))
            w, m = np.unique(cur, return_counts=True)
            to, tw = _range(p, buckets), _range(w << _16, buckets)
            for b in range(buckets):
                i, j = np.searchsorted(to, [b, b + 1])
                if i < j:
                    out.append((2, b, pack(steps(p[i:j]), *(narrow(x[i:j]) for x in (n1, n2, n3))), None))
                i, j = np.searchsorted(tw, [b, b + 1])
                if i < j:
                    out.append((3, b, pack(steps(w[i:j]), narrow(m[i:j])), None))
        out.append((4, bucket, None, stats))
        return pd.DataFrame(out, columns=["kind", "bucket", "data", "stats"])

    return apply


def _merge_neighbours(folder: str):  # noqa: ANN202
    def apply(group: pd.DataFrame) -> pd.DataFrame:
        bucket, stats = int(group["bucket"].iloc[0]), [0] * 6
        parts = [unpack(x, 4) for x in group.loc[group["kind"] == 2, "data"]]
        if parts:
            prev, *n = _summed(np.concatenate([np.cumsum(p[0]) for p in parts]), *(np.concatenate([p[k].astype(np.int64) for p in parts]) for k in (1, 2, 3)))
            _save(folder, "context", bucket, prev)
            _save(folder, "context-n", bucket, narrow(np.stack(n, axis=1)))
        parts = [unpack(x, 2) for x in group.loc[group["kind"] == 3, "data"]]
        if parts:
            cur, m = _summed(np.concatenate([np.cumsum(p[0]) for p in parts]), np.concatenate([p[1].astype(np.int64) for p in parts]))
            _save(folder, "successor", bucket, cur)
            _save(folder, "successor-n", bucket, m.astype(np.uint64))
            stats = [int(m.sum()), int((m >= 3).sum()), *_ones_to_fours(m)]
        return pd.DataFrame([(4, bucket, None, stats)], columns=["kind", "bucket", "data", "stats"])

    return apply


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts from the numbers of entries counted once to four times; each at most its count."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = [k - (k + 1) * y * b / a if a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.0), float(k)) if n1 else 0.5 for k, d in zip((1, 2, 3), raw, strict=True))


@dataclass(frozen=True)
class Model:
    """A few numbers; the arrays are files of the shared folder."""

    folder: str
    buckets: int
    n_tokens: int
    n_words: int
    n_texts: int
    bigram_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    #: Distinct bigrams, and the discounted mass of the successor counts.
    n_bigrams: int
    word_rest: float


def n_buckets(docs: DataFrame) -> int:
    """How many buckets hold the counts: as many as shuffles have partitions, and more where the text fills them."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(size) // BUCKET)


def train(docs: DataFrame) -> Model:
    """Counts every text of docs (null: empty). One row of sums for each bucket is reduced in Spark; the driver sees one."""
    spark = docs.sparkSession
    buckets = n_buckets(docs)
    folder = local_path(shared_dir(spark))
    os.makedirs(folder, exist_ok=True)
    counted = docs.select("text").mapInArrow(_count(buckets), ROWS)
    merged = written(counted.groupBy("bucket").applyInPandas(_merge_counts(folder, buckets), ROWS), "neighbours", "uncompressed")
    ends = written(merged.filter("kind in (2, 3)").groupBy("bucket").applyInPandas(_merge_neighbours(folder), ROWS), "ends")

    def sums(df: DataFrame) -> list[int]:
        row = df.filter("kind = 4").agg(*[F.coalesce(F.sum(F.col("stats")[k]), F.lit(0)) for k in range(6)]).first()
        return [int(x) for x in row]

    n_tokens, n_words, *bi = sums(merged)
    total, many, *uni = sums(ends)
    d, w = discounts(bi), discounts(uni)
    rest = (w[0] * uni[0] + w[1] * uni[1] + w[2] * many) / total if total else 1.0
    end = _Arrays(folder, buckets)
    n_texts = int(end.values("word", "word-n", np.array([END]))[0])
    return Model(folder, buckets, n_tokens, n_words, n_texts, d, w, total, rest)


class _Arrays:
    """The model's files, mapped when used; MAPS of them stay mapped, for each holds a file descriptor."""

    def __init__(self, folder: str, buckets: int) -> None:
        self.folder, self.buckets = folder, buckets
        self.open = functools.lru_cache(maxsize=MAPS)(self._open)

    def _open(self, name: str, bucket: int) -> np.ndarray | None:
        path = f"{self.folder}/{name}-{bucket}.npy"
        return np.load(path, mmap_mode="r").view(np.ndarray) if os.path.exists(path) else None

    def find(self, name: str, value: str, keys: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The values of keys, which are sorted by bucket and then by key; zero where a key is missing."""
        cuts = np.searchsorted(bucket, np.arange(self.buckets + 1))
        out = None
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            have, values = self.open(name, b), self.open(value, b)
            if have is None or not len(have):
                continue
            own = keys[cuts[b] : cuts[b + 1]]
            at = np.minimum(np.searchsorted(have, own), len(have) - 1)
            hit = have[at] == own
            if out is None:
                out = np.zeros((len(keys), *values.shape[1:]), np.float64)
            out[cuts[b] : cuts[b + 1]][hit] = values[at[hit]]
        return np.zeros(len(keys)) if out is None else out

    def values(self, name: str, value: str, words: np.ndarray, shift: bool = False) -> np.ndarray:
        """Of ascending words."""
        return self.find(name, value, words >> _16 if shift else words, _range(words, self.buckets))


def log_probabilities(model: Model, arrays: _Arrays, cur: np.ndarray, prev: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token its log10 probability after its context, and how often training has the token."""
    words, at = np.unique(np.concatenate([cur, prev]), return_inverse=True)
    c_at, p_at = at[: len(cur)], at[len(cur) :]
    count = arrays.values("word", "word-n", words)
    m = arrays.values("successor", "successor-n", words, shift=True)
    # successors are told apart by 48 bits: each has its own place among ascending words too
    dw, db = np.array([0.0, *model.word_discounts]), np.array([0.0, *model.bigram_discounts])
    kind = np.minimum(m, 3).astype(np.int64)
    word_p = ((m - dw[kind]) / model.n_bigrams if model.n_bigrams else 0.0) + model.word_rest / (model.n_words + 1)
    n = arrays.values("context", "context-n", words)
    n = n if n.ndim == 2 else np.zeros((len(words), 3))
    total = np.where(words == START, model.n_texts, count)
    total = np.where(words == END, 0, total)
    rest = np.where(total > 0, (n @ db[1:]) / np.maximum(total, 1), 1.0)
    short = cur >> _16
    key = _key(prev, short)
    bucket = _place(prev, short, model.buckets)
    order = np.lexsort((key, bucket))
    key, bucket = key[order], bucket[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    pair = np.empty(len(cur))
    pair[order] = np.repeat(arrays.find("bigram", "bigram-n", key[first], bucket[first]), np.diff(np.append(first, len(key))))
    t = total[p_at]
    p = np.where(t > 0, (pair - db[np.minimum(pair, 3).astype(np.int64)]) / np.maximum(t, 1), 0.0) + rest[p_at] * word_p[c_at]
    return np.log10(p), count[c_at]


def score(docs: DataFrame, model) -> DataFrame:  # noqa: ANN001
    """docs with (n_tokens, n_known, train_tokens, base_score, score) behind its columns, which replace columns of
    these names. perplexity is 10 ** (-score / n_tokens)."""
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    docs = docs.drop(*names)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import kneser_ney_trigram as trigram

        arrays = (_Arrays if isinstance(model, Model) else trigram.Tables)(model.folder, model.buckets)
        for batch in batches:
            data, offsets = K.column_bytes(batch.column("text"))
            for i, j in K.blocks(offsets, SCORED):
                cur, begin = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                lp, count = log_probabilities(model, arrays, cur, contexts(cur, begin)) if isinstance(model, Model) else trigram.log_probabilities(model, arrays, cur, begin)
                base = np.log10((count + 1) / (model.n_tokens + model.n_words + 1))
                sums = [np.add.reduceat(x, begin[:-1]) for x in (base, lp)]
                known = np.add.reduceat((count > 0).astype(np.int64), begin[:-1])
                more = [np.diff(begin), known, np.full(j - i, model.n_tokens), *sums]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *(pa.array(x) for x in more)], names=[*batch.schema.names, *names])

    return docs.mapInArrow(apply, f"{kept}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(doc_id: Column) -> Column:
    """A seventh of the documents, by their ids; nothing is learnt from them."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def score_corpus(docs: DataFrame, order: int = 2) -> DataFrame:
    """docs with held_out and the columns of score(); the model learns from all documents that are not held out.

    order is the length of the longest n-gram, 2 or 3; before a text stand order - 1 starts.

    Case of A-Z is ignored; words are separated by blanks, tabs and line ends, and each text ends with one more
    token. A null or empty text is that token alone. Where nothing was learnt, every token is unknown. Repeated rows
    count as often as they occur; further columns pass through, except those that have a result's name.
    """
    from . import kneser_ney_trigram as trigram

    if order not in (2, 3):
        raise ValueError(f"order {order}: only bigrams and trigrams")
    model = (train if order == 2 else trigram.train)(docs.filter(~held_out(F.col("doc_id"))))
    return score(docs.withColumn("held_out", held_out(F.col("doc_id"))), model)
