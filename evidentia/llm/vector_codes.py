"""Vector codes by integer codebooks, searched with partial distances.

A vector's parts are coded one by one: the dimensions of a part are added up in descending variance of its codebook, and masks
drop an entry for a vector as soon as its integer distance so far strictly exceeds the vector's best complete one. As equal
distances are never dropped, the lowest of equally near entries wins whatever the order of search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors with a component of this magnitude or more are dropped like those that are not finite, so that distances stay within 64 bits.
LIMIT = 32_768


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x (rows, width) the nearest entry of book (entries, width) and its squared distance; ties to the lower index."""
    n = len(x)
    order = np.argsort(-book.var(axis=0), kind="stable") if book.shape[1] else np.zeros(0, np.int64)
    x, book = np.ascontiguousarray(x[:, order].T, np.int64), book[:, order]
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # the first complete distance is that of the entry which is nearest in the first dimension
    by_first = np.argsort(book[:, 0], kind="stable")
    sorted_first = book[by_first, 0]
    right = np.clip(np.searchsorted(sorted_first, x[0]), 1, max(1, len(book) - 1)) if len(book) > 1 else np.zeros(n, np.int64)
    left = np.maximum(right - 1, 0)
    code = by_first[np.where(np.abs(sorted_first[left] - x[0]) <= np.abs(sorted_first[right] - x[0]), left, right)]
    best = ((x - book[code].T) ** 2).sum(axis=0)
    for e, entry in enumerate(book):
        live = np.flatnonzero(code != e)
        sums = np.zeros(len(live), np.int64)
        for d in range(len(entry)):
            gap = x[d, live] - entry[d]
            sums += gap * gap
            near = sums <= best[live]
            if not near.all():
                live, sums = live[near], sums[near]
            if not len(live):
                break
        better = (sums < best[live]) | (e < code[live])  # what is left is no farther
        live, sums = live[better], sums[better]
        code[live], best[live] = e, sums
    return code, best


def _rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The batch's vectors as (rows, PARTS, width of a part); zeros fill up the last part."""
    column = batch.column("v")
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
    size = -(-width // PARTS)
    if size * PARTS > width:
        flat = np.pad(flat, ((0, 0), (0, size * PARTS - width)))
    return flat.reshape(len(column), PARTS, size)


def _sums(vectors: DataFrame, books: list[np.ndarray], width: int) -> dict[int, int]:
    """For each part, entry and dimension the sum over the vectors that the entry got, and their number in the dimension behind."""
    size = -(-width // PARTS) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """At most a row for each part, entry and dimension of a task, whatever its vectors."""
        total = np.zeros((PARTS, ENTRIES, size), np.int64)
        for batch in batches:
            x = _rows(batch, width)
            for p, book in enumerate(books):
                code, _ = nearest_entries(x[:, p], book)
                order = np.argsort(code, kind="stable")
                used, first = np.unique(code[order], return_index=True)
                if len(used):
                    total[p, used, :-1] += np.add.reduceat(x[order, p].astype(np.int64), first, axis=0)
                    total[p, used, -1] += np.diff(np.append(first, len(code)))
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(slot, pa.int64()), "s": pa.array(total.reshape(-1)[slot], pa.int64())})

    summed = vectors.select("v").mapInArrow(partial, "slot long, s long").groupBy("slot").agg(F.sum("s").alias("s"))
    return {r.slot: r.s for r in summed.collect()}  # PARTS * ENTRIES * size rows at most


def _moved(books: list[np.ndarray], sums: dict[int, int]) -> list[np.ndarray]:
    """Each entry becomes the floor of its vectors' mean; one that got none stays."""
    size = books[0].shape[1]
    out = [book.copy() for book in books]
    for p, book in enumerate(out):
        for e in range(len(book)):
            base = (p * ENTRIES + e) * (size + 1)
            if count := sums.get(base + size, 0):
                book[e] = [sums.get(base + d, 0) // count for d in range(size)]
    return out


def integers(embedding: Column) -> Column:
    """floor(4096 * x) of each component; null for a vector that is null, empty, or holds a component that is null, not finite
    or of magnitude LIMIT or more."""
    good = F.forall(embedding, lambda x: F.coalesce((F.abs(x) < LIMIT) & ~F.isnan(x), F.lit(False)))
    return F.when(good & (F.size(embedding) > 0), F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE).cast("int")))


def codebooks_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.reshape(-1).tolist()).encode()).hexdigest()


def train(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """The codebooks of (vec_id, v) and the width of v. Every round reads all vectors; what tasks send is a sum for each entry and
    dimension, and the driver holds the codebooks only."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    if not first:
        return [], 0
    width = len(first[0].v)
    size = -(-width // PARTS)
    seeds = np.zeros((len(first), size * PARTS), np.int64)
    seeds[:, :width] = [r.v for r in first]
    books = list(seeds.reshape(-1, PARTS, size).transpose(1, 0, 2))
    for _ in range(rounds):
        books = _moved(books, _sums(vectors, books, width))
    return books, width


def encode(vectors: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """vectors (v and others) with (code, error) behind its columns but v."""
    kept = [f for f in vectors.schema.fields if f.name != "v"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["code string", "error long"])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch, width)
            codes, errors = zip(*(nearest_entries(x[:, p], book) for p, book in enumerate(books)), strict=True)
            raw = np.stack(codes, axis=1).astype(np.uint8).tobytes().hex()
            text = [raw[i : i + 2 * PARTS] for i in range(0, len(raw), 2 * PARTS)]
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(text, pa.string()), pa.array(np.sum(errors, axis=0), pa.int64())], names=[*(f.name for f in kept), "code", "error"])

    return vectors.mapInArrow(assign, schema)


def compress(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of each vector of (vec_id, embedding, label).

    Rows whose vector is null, empty or holds a component that is null, not finite or of magnitude 32,768 or more are
    dropped, and so are vectors of another width than that of the smallest kept vec_id. A width that eight does not divide is
    filled up with zeros. With fewer than 16 vectors the codebooks have an entry for each. Equal ids are ordered by their
    vectors, null ids come last; repeated rows count each time. An empty table gives no rows; other columns are not read.
    """
    whole = embeddings.select("vec_id", "label", integers(F.col("embedding")).alias("v")).filter("v is not null")
    vectors = written(whole, "vectors")
    least = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    vectors = vectors.filter(F.size("v") == (len(least[0].v) if least else 0))
    books, width = train(vectors)
    if not books:
        return vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = written(encode(vectors, books, width), "codes")
    # written, so that the join has a plain exchange on either side and Spark can split a label with very many vectors
    by_label = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    joined = coded.join(by_label.withColumnRenamed("label", "l"), F.col("label").eqNullSafe(F.col("l")))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def sql(rounds: int = ROUNDS) -> str:
    """The same by DuckDB: a pair of common tables for each round, over (vector, part) and (part, entry) with lists of integers."""
    steps = [f"""
with recursive kept as materialized (select vec_id, label, [floor(4096 * x::double)::bigint for x in embedding] as v from embeddings
  where embedding is not null and len(embedding) > 0 and len([1 for x in embedding if x is null or isnan(x) or abs(x) >= {LIMIT}]) = 0),
parts as materialized (select vec_id, label, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] as v from kept, range({PARTS}) r(p)),
b0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 as e, v from (select p, vec_id, v from parts where vec_id in (select vec_id from kept order by vec_id limit {ENTRIES})))"""]
    for k in range(rounds + 1):
        steps.append(f"""
a{k} as materialized (select vec_id, label, p, v, arg_min(e, [d, e]) as e, min(d) as d from (
  select x.vec_id, x.label, x.p, x.v, b.e, list_sum([(x.v[i] - b.v[i]) * (x.v[i] - b.v[i]) for i in range(1, len(x.v) + 1)])::bigint as d from parts x join b{k} b using (p))
  group by vec_id, label, p, v)""")
        if k < rounds:
            steps.append(f"""
m{k} as materialized (select p, e, list(m order by i) as v from (
  select p, e, i, ((sum(v[i]) - (((sum(v[i]) % count(*)) + count(*)) % count(*))) // count(*))::bigint as m from a{k}, range(1, (select max(len(v)) + 1 from parts)) r(i) group by p, e, i) group by p, e),
b{k + 1} as materialized (select b.p, b.e, coalesce(m.v, b.v) as v from b{k} b left join m{k} m using (p, e))""")
    return ",".join(steps) + f"""
, coded as materialized (select vec_id, label, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from a{rounds} group by vec_id, label),
digest as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) as codebooks_sha256 from b{rounds})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded, digest
"""
