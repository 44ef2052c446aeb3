"""Approximate nearest neighbours over robust-pruned directed graphs, one for each shard of the vectors.

A shard's graph starts random. Points are taken in batches: a greedy beam search from the entry points proposes
candidates, and relaxed pruning keeps the nearest of them and those which no kept one is much nearer to (diverse
edges, long ones among them); the reverse edges are added and pruned alike. A query searches each shard with a
beam; the nearest found are ordered by their exact cosine.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

#: Distinct vectors in a shard (on average), queries in a block, and edges of a point. Every query visits every shard, so
#: both grow with their number only, and are as large as a task can hold.
SHARD, QUERIES, DEGREE = 16384, 16384, 28
#: Queries that advance together.
TOGETHER = 1024
#: Widths of the beams that build and that search, and how many points of a beam a step expands.
BUILD_BEAM, BEAM, EXPAND = 48, 192, 4
#: A candidate goes when a kept one is so many times nearer to it than the point is (squared distances).
RELAX = 1.2
ENTRIES = 8
BATCH = 256


def beam_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the points of its final beam, nearest first, with their cosines; -1 and -inf where it is short.

    x and queries hold unit vectors; all queries advance together, each by its best unexpanded points.
    """
    n, q = len(x), len(queries)
    rows = np.arange(q)[:, None]
    start = np.repeat(entries[None, :], q, axis=0)
    ids = np.full((q, beam), -1, np.int64)
    near = np.full((q, beam), -np.inf, np.float32)
    done = np.ones((q, beam), bool)
    width = min(beam, start.shape[1])
    ids[:, :width] = start[:, :width]
    near[:, :width] = queries @ x[entries[:width]].T
    done[:, :width] = False
    seen = np.zeros((q, n + 1), bool)
    seen[rows, ids[:, :width]] = True
    live = np.arange(q)
    while len(live):
        score = np.where(done[live], -np.inf, near[live])
        take = np.argpartition(-score, min(EXPAND, beam) - 1, axis=1)[:, :EXPAND]
        open_ = np.take_along_axis(score, take, 1) > -np.inf
        go = open_.any(axis=1)
        live, take, open_ = live[go], take[go], open_[go]
        if not len(live):
            break
        at = live[:, None]
        done[at, take] = True
        more = np.where(open_[:, :, None], graph[np.maximum(ids[at, take], 0)], -1).reshape(len(live), -1)
        more[seen[at, more]] = -1  # the last column of seen stands for -1 and stays false
        more.sort(axis=1)
        more[:, 1:][more[:, 1:] == more[:, :-1]] = -1
        seen[at, more] = True
        seen[:, n] = False
        found = np.where(more >= 0, np.einsum("ijk,ik->ij", x[np.maximum(more, 0)], queries[live]), -np.inf).astype(np.float32)
        all_near = np.concatenate([near[live], found], axis=1)
        best = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
        near[live] = np.take_along_axis(all_near, best, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], more], axis=1), best, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], more < 0], axis=1), best, 1)
    order = np.argsort(-near, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """For each point its kept candidates, padded with -1."""
    c = np.where(candidates == points[:, None], -1, candidates)
    c.sort(axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    v = x[np.maximum(c, 0)]
    far = 2 - 2 * np.einsum("ijk,ik->ij", v, x[points])
    left = c >= 0
    out = np.full((len(points), degree), -1, np.int64)
    rows = np.arange(len(points))
    for k in range(degree):
        d = np.where(left, far, np.inf)
        best = d.argmin(axis=1)
        some = np.isfinite(d[rows, best])
        if not some.any():
            break
        out[some, k] = c[rows, best][some]
        between = 2 - 2 * np.einsum("ijk,ik->ij", v, v[rows, best])
        left &= ~((relax * between <= far) & some[:, None])
        left[rows, best] = False
    return out


def build_graph(x: np.ndarray, seed: int = 0, degree: int = DEGREE) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours of each point, entry points) of unit vectors x."""
    n = len(x)
    rng = np.random.default_rng(seed)
    medoid = int((x @ x.mean(axis=0)).argmax())
    entries = np.unique(np.append(rng.integers(0, n, ENTRIES - 1), medoid))
    if n <= degree + 1:  # everything is a neighbour
        graph = np.tile(np.arange(n), (n, 1))
        graph[np.arange(n), np.arange(n)] = -1
        return graph, entries
    graph = np.full((n, degree), -1, np.int64)
    graph[:, : degree // 2] = rng.integers(0, n, (n, degree // 2))
    for relax in (1.0, RELAX):
        order = rng.permutation(n)
        for i in range(0, n, BATCH):
            batch = order[i : i + BATCH]
            ids, _ = beam_search(x, graph, entries, x[batch], BUILD_BEAM)
            graph[batch] = robust_prune(x, batch, np.concatenate([ids, graph[batch]], axis=1), degree, relax)
            to, of = graph[batch].ravel(), np.repeat(batch, degree)
            to, of = to[to >= 0], of[to >= 0]
            order_ = np.argsort(to, kind="stable")
            to, of = to[order_], of[order_]
            target, first, count = np.unique(to, return_index=True, return_counts=True)
            reverse = np.full((len(target), min(int(count.max()), 4 * degree)), -1, np.int64)
            place = np.arange(len(to)) - np.repeat(first, count)
            fits = place < reverse.shape[1]
            reverse[np.repeat(np.arange(len(target)), count)[fits], place[fits]] = of[fits]
            graph[target] = robust_prune(x, target, np.concatenate([graph[target], reverse], axis=1), degree, relax)
    return graph, entries


def _unit(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double precision, times a power of two so that no square overflows, and their single-precision unit vectors."""
    v = np.stack([np.asarray(a, np.float64) for a in column])
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])
    return v, (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _build(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("first_id", kind="stable").reset_index(drop=True)
    graph, entries = build_graph(_unit(group["embedding"])[1])
    group["pos"] = np.arange(len(group))
    group["entry"] = np.isin(group["pos"], entries)
    group["neighbours"] = [g[g >= 0].tolist() for g in graph]
    return group[["dim", "shard", "pos", "embedding", "ids", "entry", "neighbours"]]


def _search(k: int, beam: int):  # noqa: ANN202
    names = ["query_id", "vec_id", "score"]

    def apply(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(queries):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        index = index.sort_values("pos")
        v, x = _unit(index["embedding"])
        q, unit = _unit(queries["embedding"])
        width = max(len(a) for a in index["neighbours"])
        graph = np.full((len(index), max(1, width)), -1, np.int64)
        for i, a in enumerate(index["neighbours"]):
            graph[i, : len(a)] = a
        entries = np.flatnonzero(index["entry"].to_numpy())
        found = np.concatenate([beam_search(x, graph, entries, unit[i : i + TOGETHER], min(beam, len(index)))[0] for i in range(0, len(unit), TOGETHER)])
        ids, out = index["ids"].tolist(), []
        length, q_length = np.sqrt((v * v).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
        for own, vector, norm, near in zip(queries["query_id"].tolist(), q, q_length, found[:, : 2 * k + 2], strict=True):
            near = near[near >= 0]
            exact = (v[near] @ vector) / (length[near] * norm)
            best = sorted((-s, i) for s, p in zip(exact.tolist(), near.tolist(), strict=True) for i in ids[p] if i != own)
            out += [(own, i, -s) for s, i in best[:k]]
        return pd.DataFrame(out, columns=names)

    return apply


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows whose vector is neither null, empty or zero nor holds a null or non-finite component."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long"), "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine & F.exists("embedding", lambda c: c != 0))


def build_index(vectors: DataFrame, k: int) -> DataFrame:
    """The graphs, a row for each distinct vector: its shard, place, neighbours, and its k + 1 smallest ids, which are all
    that a list of k neighbours can hold of it. Shards grow in number, not in size."""
    pairs = usable(vectors).groupBy("embedding", "vec_id").agg(F.count(F.lit(1)).alias("n"))
    least = pairs.withColumn("r", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    distinct = written(least.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "distinct")
    shards = max(1, -(-distinct.count() // SHARD))
    placed = distinct.select(F.size("embedding").alias("dim"), F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int").alias("shard"), "embedding", "ids", F.col("ids")[0].alias("first_id"))
    kind = distinct.schema["embedding"].dataType.simpleString()
    return written(placed.groupBy("dim", "shard").applyInPandas(_build, f"dim int, shard int, pos int, embedding {kind}, ids array<long>, entry boolean, neighbours array<int>"), "graphs")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest that are found to each row of queries, a subset of vectors.

    Nearness is the largest cosine, computed in double precision from the vectors as given; ties go to the smaller
    vec_id. A query's own id is no candidate. Vectors that are null, empty or zero, or hold a null or non-finite component,
    and rows without vec_id take no part, as queries or candidates; vectors of other lengths than the query's are no
    candidates for it. Repeated rows count once, and of several vectors under one queried id the least is the query.
    With fewer candidates all are returned; empty tables give no rows; only vec_id and embedding are read.
    """
    index = build_index(vectors, k)
    asked = written(usable(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding")), "queries")
    blocks = max(1, -(-asked.count() // QUERIES))
    shards = index.groupBy("dim").agg(F.max("shard").alias("last"))
    asked = asked.withColumn("dim", F.size("embedding")).join(shards, "dim").select("query_id", "embedding", "dim", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), "last")).alias("shard"))
    spread = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    key = ["dim", "shard", "block"]
    found = spread.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(_search(k, beam), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
