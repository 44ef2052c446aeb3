"""Similarity join of texts by the Jaccard coefficient of their word n-grams, with Bayesian pruning.

Texts with the same set of n-grams are one node. Bands of MinHash values link nodes that may be similar, each to the
smallest of its bucket; the components of these links hold every pair that shares a band. A component is compared as a
whole where its texts are much alike, and bucket by bucket where that makes fewer pairs, as in long chains of texts that
are little alike; both ways meet every pair that shares a band. In blocks of bounded size, MinHash values are compared
some at a time: a pair is dropped when the posterior probability that it reaches the threshold falls below a tolerance,
and the rest are counted exactly. No pair is ever a row: a block gives each text's number of links and the smallest
text it hangs together with.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import connected_components
from .scratch import written

WORDS = 5
THRESHOLD = 0.8
#: Bands of MinHash values: a pair at the threshold shares none of them with a probability of 5e-6.
BANDS, ROWS = 40, 6
#: Values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 24, 1e-6
#: Texts in a block, and n-grams of all its texts, on average.
BLOCK, GRAMS = 128, 1 << 19
#: Rows in a group of blocks, and n-grams of all its texts.
GROUP, GROUP_GRAMS = 512, 1 << 21

WORD = K.byte_table("\x20\x09\x0a\x0b\x0c\x0d")
_RNG = np.random.default_rng(7)
_A = _RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_PLACE = _RNG.integers(0, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> list[np.ndarray]:
    """For each text its distinct n-gram hashes, ascending. A text of fewer words, but some, is one n-gram of them all."""
    low = K.lower_ascii(data)
    s, e, at = K.word_spans(low, offsets, WORD)
    h = K.span_hash(low, s, e) if len(s) else np.zeros(0, np.uint64)
    runs = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        runs += h[k : len(h) - n + 1 + k] * _PLACE[k % 64]
    runs = K.mix(runs)
    out = []
    for i in range(len(offsets) - 1):
        a, b = at[i], at[i + 1]
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        else:
            short = np.zeros(0, np.uint64)
            for k in range(b - a):
                short = (short if k else np.array([b - a], np.uint64)) + h[a + k : a + k + 1] * _PLACE[k]
            out.append(K.mix(short))
    return out


def signature(grams: np.ndarray) -> np.ndarray:
    """The MinHash values."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        low = np.minimum(low, (x[None, i : i + 2048] * _A[:, None] + _B[:, None]).min(axis=1))
    return low


def set_key(grams: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of n-grams, as two signed numbers."""
    pair = np.array([K.mix(grams + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), K.mix(grams ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)])
    return tuple(pair.view(np.int64).tolist())


def band_keys(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = K.mix(key ^ rows[:, k]) + np.uint64(k)
    return key.view(np.int64)


def sketch(docs: DataFrame, n: int = WORDS, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, a, b, bands) of each row: the number of n-grams, the key of their set and its bands; then the columns of also."""
    names = ["doc_id", "size", "a", "b", "bands", *also]
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*also).schema.fields)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.column_bytes(batch.column("text"))
            for i, j in K.blocks(offsets):
                sets = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
                keys = [set_key(g) for g in sets]
                bands = [band_keys(signature(g)) if len(g) else np.zeros(0, np.int64) for g in sets]
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), pa.array([len(g) for g in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(bands, pa.list_(pa.int64())), *map(own.column, also)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text", *also).mapInArrow(apply, f"doc_id long, size long, a long, b long, bands array<long>{more}")


def least_matches(step: int, total: int, threshold: float, tolerance: float) -> list[int]:
    """After step, 2 * step ... comparisons: the fewest equal values with which a pair stays.

    With a uniform prior, the posterior probability of a similarity of at least t after m of h equal values is that of
    at most m successes in h + 1 trials with chance t.
    """
    out = []
    for h in range(step, total + 1, step):
        below, m = 0.0, -1
        while below < tolerance and m < h:
            m += 1
            below += math.comb(h + 1, m) * threshold**m * (1 - threshold) ** (h + 1 - m)
        out.append(m)
    return out


def similar_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of left[k] and right[k] whose Jaccard coefficient reaches the threshold."""
    size = np.array([len(g) for g in sets], np.int64)
    keep = np.minimum(size[left], size[right]) >= threshold * np.maximum(size[left], size[right]) - 1e-9
    left, right = left[keep], right[keep]
    if not len(left):
        return left, right
    used, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    values = np.stack([signature(sets[k]) for k in used.tolist()])
    l, r = place[: len(left)], place[len(left) :]  # noqa: E741
    equal = np.zeros(len(left), np.int64)
    for k, least in enumerate(least_matches(STEP, values.shape[1], threshold, tolerance)):
        part = slice(k * STEP, (k + 1) * STEP)
        equal += (values[l, part] == values[r, part]).sum(axis=1)
        keep = equal >= least
        if not keep.all():
            l, r, left, right, equal = l[keep], r[keep], left[keep], right[keep], equal[keep]
        if not len(l):
            return left, right
    if len(l) <= 32:
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left.tolist(), right.tolist(), strict=True)])
    else:  # all intersections of the block at once, as a product of 0/1 matrices
        grams, owner = np.concatenate([sets[k] for k in used.tolist()]), np.repeat(np.arange(len(used)), size[used])
        known, column = np.unique(grams, return_inverse=True)
        shared = np.zeros((len(used), len(used)), np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for c in range(0, len(known), 4096):
            i, j = np.searchsorted(column, [c, c + 4096])
            there = np.zeros((len(used), min(4096, len(known) - c)), np.float32)
            there[owner[i:j], column[i:j] - c] = 1
            shared += there @ there.T
        both = shared[l, r].astype(np.int64)
    keep = both >= threshold * (size[left] + size[right] - both) - 1e-9
    return left[keep], right[keep]


def _roots(n: int, left: np.ndarray, right: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For each of n texts the smallest name it hangs together with."""
    label = names.copy()
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        if (new == label).all():
            return label
        label = new


def _blocks(n: int, threshold: float, tolerance: float):  # noqa: ANN202
    def apply(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, by_band, lo, hi), own in group.groupby(["component", "by_band", "lo", "hi"], sort=False):
            raw = [(t or "").encode() for t in own["text"]]
            data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])])
            sets = shingles(data, offsets, n)
            # a doc_id may stand for other texts too
            good = np.array([k == (a, b) for k, a, b in zip(map(set_key, sets), own["a"], own["b"], strict=True)], bool)
            at = np.flatnonzero(good)
            at = at[~own["node"].iloc[at].duplicated().to_numpy()]  # repeated rows
            block = own["block"].to_numpy()
            if lo == hi:
                i, j = np.triu_indices(len(at), 1)
                i, j = at[i], at[j]
            else:
                first, second = at[block[at] == lo], at[block[at] == hi]
                i, j = np.repeat(first, len(second)), np.tile(second, len(first))
            i, j = similar_pairs(sets, i, j, threshold, tolerance)
            if len(i) and by_band:  # a pair counts in the first of the buckets that hold it
                used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
                bands = np.stack([band_keys(signature(sets[k])) for k in used.tolist()])
                alike = bands[place[: len(i)]] == bands[place[len(i) :]]
                mine = bands[place[: len(i)], alike.argmax(axis=1)] == own["component"].iloc[0]
                i, j = i[mine], j[mine]
            if not len(i):
                continue
            copies, names = own["copies"].to_numpy(), own["node"].to_numpy()
            links = np.bincount(i, copies[j], len(own)) + np.bincount(j, copies[i], len(own))
            root = _roots(len(own), i, j, names)
            for k in np.flatnonzero(links):
                out.append((int(names[k]), int(root[k]), int(links[k]), bool(by_band or own["n_blocks"].iloc[0] > 1)))
        return pd.DataFrame(out, columns=["node", "root", "links", "many"])

    return apply


def _loose(buckets: DataFrame, parts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(component) of the components of several blocks that make fewer pairs bucket by bucket than as a whole."""
    large = sizes.filter("n_blocks > 1").select("component", "k")
    inside = buckets.select(F.col("hub").alias("node"), F.col("k").cast("double").alias("own")).join(parts.select("node", "component"), "node").groupBy("component").agg(F.sum(F.col("own") * F.col("own")).alias("pairs"))
    return written(large.join(inside, "component").filter("pairs < cast(k as double) * k").select("component"), "loose")


def ngram_join(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, set_id, class_id, n_links), one row for each row of docs; then the columns of also.

    Two rows are linked when the Jaccard coefficient of their sets of word n-grams is at least the threshold. set_id is
    the smallest doc_id with the same set of n-grams, class_id the smallest that links lead to, and n_links the
    number of other rows that are linked to this one, copies included. Case of A-Z does not count; words are separated
    by blanks, tabs and line ends, and a text of fewer than n words is one n-gram of them all.

    A null, empty or blank text has no n-grams and no links: its class is itself. A row with a null doc_id has null ids and
    no links. Repeated rows are copies of each other. An empty table gives no rows; only doc_id, text and also are read.
    """
    rows = written(sketch(docs, n, also).withColumn("node", F.xxhash64("size", "a", "b")), "sketch")
    some = rows.filter("doc_id is not null and size > 0")
    sets = written(
        some.groupBy("node", "size", "a", "b").agg(F.min(F.struct("doc_id", "bands")).alias("first"), F.count(F.lit(1)).alias("copies")).select("node", "size", "a", "b", "copies", F.col("first.doc_id").alias("set_id"), F.col("first.bands").alias("bands")),
        "sets",
    )
    banded = sets.select("node", F.explode("bands").alias("band"))
    buckets = written(banded.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("k")).filter("k > 1"), "buckets")
    hung = banded.join(buckets.select("band", "hub"), "band").filter("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    parts = written(connected_components(hung).join(sets.select("node", "size"), "node"), "parts")
    n_blocks = F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("grams") / GRAMS)).cast("int").alias("n_blocks")
    sizes = written(parts.groupBy("component").agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("grams")).select("component", n_blocks, "k"), "sizes")
    members = parts.join(sizes.select("component", "n_blocks"), "component").select("node", "size", "component", "n_blocks", F.lit(False).alias("by_band"))
    if not sizes.filter("n_blocks > 1").isEmpty():
        loose = _loose(buckets, parts, sizes)
        apart = banded.join(parts.join(loose, "component").select("node", "size"), "node").join(buckets.select("band"), "band").withColumnRenamed("band", "component")
        counts = apart.groupBy("component").agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("grams")).select("component", n_blocks)
        members = members.join(loose, "component", "left_anti").unionByName(apart.join(counts, "component").withColumn("by_band", F.lit(True)))
    members = written(members, "members")
    total, grams = members.agg(F.coalesce(F.sum("n_blocks"), F.lit(0)), F.coalesce(F.sum(F.col("size") * F.col("n_blocks")), F.lit(0))).first()
    groups = max(1, int(total) // GROUP, int(grams) // GROUP_GRAMS)
    members = members.drop("size").withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    members = members.join(sets.select("node", "a", "b", "copies", F.col("set_id").alias("doc_id")), "node")
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(members, "doc_id")
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    spread = texts.select("*", other.alias("other")).select("*", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    spread = spread.withColumn("g", F.pmod(F.xxhash64("component", "by_band", "lo", "hi"), F.lit(groups)))
    found = written(spread.groupBy("g").applyInPandas(_blocks(n, threshold, tolerance), "node long, root long, links long, many boolean"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = found.filter("not many").select("node", F.col("root").alias("label")).distinct()
    if not found.filter("many").isEmpty():
        over = connected_components(found.filter("many").select(F.col("node").alias("u"), F.col("root").alias("v")))
        labels = labels.unionByName(over.select("node", F.col("component").alias("label")))
    linked = written(labels.join(links, "node", "left").join(sets.select("node", "set_id"), "node"), "linked")
    first = linked.groupBy("label").agg(F.min("set_id").alias("class_id"))
    classes = linked.join(first, "label").select("node", "class_id", "links")
    known = written(sets.select("node", "set_id", "copies").join(classes, "node", "left").select("node", "set_id", F.coalesce("class_id", "set_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "known")
    alone = rows.filter("doc_id is null or size = 0").select("doc_id", F.col("doc_id").alias("set_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), *also)
    return some.select("doc_id", "node", *also).join(known, "node").select("doc_id", "set_id", "class_id", "n_links", *also).unionByName(alone)
