"""Quality classifier: n-gram indicators scaled by class log-count ratios, and a linear hinge-loss model over them.

The indicators of a text are its distinct words and pairs of neighbouring words, hashed, and two more for any word that follows
itself once or twice. Counts of all labelled texts give each indicator's log-count ratio (naive Bayes); a text is its ratios at
unit length. The model is fitted by dual coordinate descent on a bounded sample of the labelled texts: blocks of them descend
side by side from the same weights, each as if the others moved with it, and their steps are added up, round after round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import codec
from . import kernels as K
from .scratch import written

BITS = 18
DIM = 1 << BITS
#: Added to each count before ratios are taken.
SMOOTH = 1.0
#: The upper bound of a dual variable.
COST = 4.0
#: Blocks of the sample, rounds, and passes over a block in a round.
BLOCKS, ROUNDS, PASSES = 16, 10, 2
#: Bounds of the sample that the hinge-loss model is fitted on; counts and ratios come from all labelled texts.
SAMPLE_ROWS, SAMPLE_BYTES = 65_536, 1 << 28
#: Labelled ids, of 12 bytes each, that go to every task; more are joined by an exchange of both sides, which moves texts.
LABELS_AT_ONCE = 1_000_000
#: The sample is made of whole buckets of document ids.
BUCKETS = 4096
#: score is the logistic function of SLOPE times the margin.
SLOPE = 2.0

_SPACE, _WORD, _MARK = 0, 1, 2
#: What stands for a word behind itself, and behind itself twice.
_TWICE, _THRICE = K.mix(np.array([2, 3], np.uint64))


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, _WORD, np.uint8)
    kinds[:128] = [_WORD if chr(c).isalnum() else _MARK for c in range(128)]
    kinds[[0x20, *range(0x09, 0x0E)]] = _SPACE
    return kinds


_KINDS = _byte_kinds()


def indicators(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, indicator) of each distinct indicator of each text, in order. Words are runs of letters and digits, and runs of marks."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = K.lower_ascii(data)
    kind = _KINDS[low]
    edge = np.ones(n + 1, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    word = kind[cuts[:-1]] != _SPACE
    starts, ends = cuts[:-1][word], cuts[1:][word]
    h = K.span_hash(low, starts, ends)
    text = np.searchsorted(offsets, starts, "right") - 1
    inside = text[:-1] == text[1:]
    pair = K.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[inside]
    twice = inside & (h[:-1] == h[1:])
    thrice = twice[:-1] & twice[1:]
    again = [np.full(k.sum(), seed, np.uint64) for k, seed in ((twice, _TWICE), (thrice, _THRICE))]
    every = np.concatenate([h, pair, *again]) >> np.uint64(64 - BITS)
    owner = np.concatenate([text, text[:-1][inside], text[:-1][twice], text[:-2][thrice]])
    key = np.unique(owner.astype(np.int64) << BITS | every.astype(np.int64))
    return key >> BITS, key & (DIM - 1)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Blocks of whole texts with the (text, indicator) pairs of each."""
    for batch in batches:
        data, offsets = K.column_bytes(batch.column("text"))
        for i, j in K.blocks(offsets):
            yield batch.slice(i, j - i), *indicators(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, text, found in _texts(batches):
        ends = np.searchsorted(text, np.arange(batch.num_rows + 1))
        packed = [codec.pack(codec.steps(found[a:b].astype(np.uint32))) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("bucket"), pa.array(packed, pa.binary())], names=["label", "bucket", "x"])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The indicators of all rows, and where each row's begin and end."""
    rows = [np.cumsum(codec.unpack(blob, 1)[0]) for blob in column.to_pylist()]
    return np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each indicator of a task with its texts of either label, and behind DIM one for each bucket with its texts and bytes."""
    total = np.zeros((DIM + BUCKETS, 2), np.int64)
    for batch in batches:
        found, ends = _unpacked(batch.column("x"))
        label, bucket = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("label", "bucket"))
        for y in (0, 1):
            total[:DIM, y] += np.bincount(found[np.repeat(label, np.diff(ends)) == y], minlength=DIM)
        total[DIM:, 0] += np.bincount(bucket, minlength=BUCKETS)
        total[DIM:, 1] += np.bincount(bucket, 4 * np.diff(ends), minlength=BUCKETS).astype(np.int64)
    slot = np.flatnonzero(total.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot, 0]), pa.array(total[slot, 1])], names=["slot", "a", "b"])


def descend(ends: np.ndarray, found: np.ndarray, x: np.ndarray, y: np.ndarray, alpha: np.ndarray, w: np.ndarray, side: float, seed: int, passes: int = PASSES, cost: float = COST) -> np.ndarray:
    """Dual coordinate descent over rows of unit length with a constant 1 behind them (its weight is w[-1]). Moves alpha and w;
    a step counts side times in w, for as many blocks that move at once. Gives the plain change of w."""
    before = w.copy()
    rng = np.random.default_rng(seed)
    spans = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
    square = [float(x[a:b] @ x[a:b]) + 1.0 for a, b in spans]
    signs = y.tolist()
    for _ in range(passes):
        for i in rng.permutation(len(spans)).tolist():
            a, b = spans[i]
            at, own = found[a:b], x[a:b]
            slope = signs[i] * (float(w[at] @ own) + w[-1]) - 1.0
            new = min(max(alpha[i] - slope / (side * square[i]), 0.0), cost)
            if step := (new - alpha[i]) * signs[i] * side:
                alpha[i] = new
                w[at] += step * own
                w[-1] += step
    return (w - before) / side


@dataclass(frozen=True)
class Model:
    """ratio and weight of each indicator, and the constant."""

    ratio: np.ndarray
    weight: np.ndarray
    constant: float


def _unit(found: np.ndarray, ends: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """The ratios of the rows' indicators, each row at unit length."""
    x, owner = ratio[found], np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    norm = np.sqrt(np.bincount(owner, x * x, minlength=len(ends) - 1))
    return x / np.maximum(norm, 1e-12)[owner]


def held_out(doc_id: Column) -> Column:
    """A third of the documents, by their ids; nothing is learnt from them."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def _ratios(counts: np.ndarray) -> np.ndarray:
    p = counts + SMOOTH
    share = p / p.sum(axis=0)
    return np.log(share[:, 1] / share[:, 0])


def _buckets(rows: np.ndarray, sizes: np.ndarray) -> list[int]:
    """Buckets, in order, that fit into the bounds of the sample; one that would not fit is passed over."""
    out, n, size = [], 0, 0
    for k in np.flatnonzero(rows).tolist():
        if n + rows[k] <= SAMPLE_ROWS and size + sizes[k] <= SAMPLE_BYTES:
            out.append(k)
            n, size = n + rows[k], size + sizes[k]
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of (doc_id, text) with (doc_id, label).

    A document counts if its label is 0 or 1; ids with both labels, null ids and null labels do not. Null texts are empty.
    Ratios come from all of these documents, weights from a sample of whole buckets of ids within SAMPLE_ROWS and SAMPLE_BYTES
    of indicators. Without documents of both labels all weights are 0 and the constant says which label was seen, if one was.
    """
    one = labels.filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most")
    one = written(one.select("doc_id", F.col("label").cast("int").alias("label")), "labels")
    rows = docs.select("doc_id", "text").join(F.broadcast(one) if one.count() <= LABELS_AT_ONCE else one, "doc_id")
    given = rows.select("text", "label", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    featured = written(given.mapInArrow(_featured, "label int, bucket int, x binary"), "indicators")
    seen = {r.label for r in featured.select("label").distinct().collect()}
    if len(seen) < 2:
        return Model(np.zeros(DIM), np.zeros(DIM), float(2 * seen.pop() - 1) if seen else 0.0)
    sums = featured.mapInArrow(_counted, "slot long, a long, b long").groupBy("slot").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
    total = np.zeros((DIM + BUCKETS, 2), np.int64)
    total[sums["slot"].to_numpy()] = np.stack([sums["a"].to_numpy(), sums["b"].to_numpy()], axis=1)
    ratio = _ratios(total[:DIM])
    sample = featured.filter(F.col("bucket").isin(_buckets(total[DIM:, 0], total[DIM:, 1])))
    dealt = written(sample.repartition(BLOCKS).select(F.monotonically_increasing_id().alias("row"), "label", "x"), "sample")
    blocks = dealt.select(F.spark_partition_id().alias("block")).distinct().count()
    weights, constant = _rounds(dealt, ratio, blocks)
    return Model(ratio, weights, constant)


def _rounds(dealt: DataFrame, ratio: np.ndarray, blocks: int) -> tuple[np.ndarray, float]:
    """Weights after ROUNDS rounds. A dual variable for each row of the sample and the weights stay with the driver between them."""
    w, rows, alpha = np.zeros(DIM + 1), np.zeros(0, np.int64), np.zeros(0)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(*_unpacked(b.column("x")), b.column("row").to_numpy(zero_copy_only=False), b.column("label").to_numpy(zero_copy_only=False)) for b in batches]
        got = [g for g in got if len(g[2])]
        if not got:
            return
        row = np.concatenate([g[2] for g in got])
        found = np.concatenate([g[0] for g in got])
        ends = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(g[1]) for g in got]))])
        y = 2.0 * np.concatenate([g[3] for g in got]) - 1
        own = alpha[np.searchsorted(rows, row)].copy() if len(rows) else np.zeros(len(row))
        change = descend(ends, found, _unit(found, ends, ratio), y, own, w.copy(), float(blocks), int(row[0]) % 1_000_003 + turn)
        at = np.flatnonzero(change)
        packed = codec.pack(codec.steps(at.astype(np.uint32)), change[at].astype("<f4").view("<u4"), row.astype("<u8"), own.astype("<f8").view("<u8"))
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], names=["packed"])

    for turn in range(ROUNDS):  # noqa: B007  step reads it
        news = []
        for r in dealt.mapInArrow(step, "packed binary").collect():
            at, change, row, own = codec.unpack(r.packed, 4)
            w[np.cumsum(at)] += change.view("<f4")
            news.append((row.astype(np.int64), own.view("<f8")))
        if not news:
            break
        rows, alpha = (np.concatenate(part) for part in zip(*news, strict=True))
        order = np.argsort(rows)
        rows, alpha = rows[order], alpha[order]
    return w[:-1], float(w[-1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text and others) with (score, predicted) behind its columns, which replace columns of these names."""
    docs = docs.drop("score", "predicted")
    kept = docs.schema.fields
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["score double, predicted int"])
    ratio, both, constant = model.ratio.astype(np.float32), (model.ratio * model.weight).astype(np.float32), model.constant

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text, found in _texts(batches):
            own = ratio[found].astype(np.float64)
            norm = np.sqrt(np.bincount(text, own * own, minlength=batch.num_rows))
            margin = np.bincount(text, both[found], minlength=batch.num_rows) / np.maximum(norm, 1e-12) + constant
            value = 1 / (1 + np.exp(-np.clip(SLOPE * margin, -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value), pa.array((value >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(scored, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with (held_out, score, predicted); the model is fitted on labelled documents that are not held out.

    score rises with how likely label 1 is; predicted is 1 from 0.5 on. Equal texts get equal results, empty and null ones that of
    the constant. An empty table gives no rows; further columns pass through.
    """
    train = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return score(docs.withColumn("held_out", held_out(F.col("doc_id"))), fit(train, labels))
