"""Retrieval legs over many questions at once, their fusion, boosts and diverse selection.

Questions are rows (q, text). A leg returns (q, key..., score, rank); ranks start at 1 and end ties by the key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import places
from ..functions import text as T
from . import profiles

K1, B = 1.2, 0.75
RRF_K = 60
THRESHOLD = 0.20
DIMS = 64
#: Bytes of question vectors that go to every task at once; more questions are searched in blocks of so many bytes.
QUERY_BYTES, BLOCK_BYTES = 64 << 20, 4 << 20
#: Pairs of questions and terms that go to every task at once; more are joined.
QUERY_TERMS = 1_000_000
#: Meetings of a text's terms with questions that are scored at once.
MEETINGS = 1 << 21
#: The smallest score that is one. Texts and questions are scored in a table, of so many cells at once, if there is a meeting for so many of its cells; of
#: its terms those that meet in so many cells are multiplied as a matrix of at most so many bytes.
LEAST, TABLE_CELLS, TABLE_SHARE, DENSE_SHARE, DENSE_BYTES = 1e-6, 1 << 20, 1 / 8, 0.003, 64 << 20
#: Bytes of texts that are cut into terms at once, and questions and vectors that meet at once: a worker's memory follows neither the
#: length of texts nor that of batches.
PIECE, ASKED_AT_ONCE, VECTORS_AT_ONCE = 2 << 20, 128, 1024


def candidates(k: int) -> int:
    """How many rows a leg hands on for k results."""
    return max(3 * k, 18)


def ranked(df: DataFrame, part: list[str], order: list[Column], limit: int | None = None) -> DataFrame:
    """df with (rank) inside part; the limit is pushed below the shuffle by Spark."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order)))
    return out.filter(F.col("rank") <= limit) if limit else out


# ---- lexical leg


def clean_query(text: Column) -> Column:
    """Without double quotes; null without a letter or digit."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), '"', "")
    return F.when(bare.rlike("[A-Za-z0-9]"), bare)


def query_terms(questions: DataFrame) -> DataFrame:
    """(q, term): the distinct terms of each question."""
    return questions.select("q", F.explode(F.array_distinct(T.tokens(clean_query(F.col("text"))))).alias("term"))


def postings(docs: DataFrame) -> DataFrame:
    """(key, dl, term, tf) of (key, text): the table that a search over a fixed corpus would keep, bucketed by term."""
    own = docs.select("key", T.tokens(F.col("text")).alias("t"))
    return own.select("key", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("key", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def _term_counts(terms: pa.Array):  # noqa: ANN202
    """Numbers of texts with each term; -1: of all texts; -2: of all tokens."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total, size = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            doc, term, dl = _term_places(batch.column("low"), terms)
            found += np.bincount(np.unique(doc * len(terms) + term) % len(terms), minlength=len(terms))
            total, size = total + len(dl), size + int(dl.sum())
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"term": np.append(some, [-1, -2]), "n": np.append(found[some], [total, size])})

    return apply


def _pieces(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of at most so many bytes together, or one longer text: where they begin and end."""
    upto, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


def _term_places(low: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token of lower-case texts that is one of the terms its text and term; and the number of tokens of each text. Texts are
    cut a piece at a time, of which only the asked terms stay."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for at, end in _pieces(low, PIECE):
        doc, term, dl = _piece_places(low.slice(at, end - at), terms)
        found.append((doc + at, term, dl))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _piece_places(low: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_term_places of a piece. Texts are cut as functions.text.tokens does, without moving arrays of strings."""
    lists = pc.split_pattern(pc.replace_substring_regex(low, "[^a-z0-9]+", " "), " ")
    values, doc = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    term = pc.fill_null(pc.index_in(values, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    some = pc.greater(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    return doc[term >= 0].astype(np.int64), term[term >= 0], np.bincount(doc[some], minlength=len(low))


def _best_meetings(q: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sums of weights of each question q (below n) and text key, the best limit of a question with ties: in a table where few cells
    hold them, else by sorting; both give the same."""
    if not len(key):
        return q, key, weight
    low_key = int(key.min())
    span = int(key.max()) - low_key + 1
    if n * span <= 2 * MEETINGS:
        score = np.round(np.bincount(q * span + key - low_key, weight, minlength=n * span), 6).reshape(n, span)
        score[score <= 0] = -np.inf
        low = np.partition(score, -limit, axis=1)[:, -limit, None] if span > limit else -np.inf
        r, c = np.nonzero((score >= low) & (score > -np.inf))
        return r, c + low_key, score[r, c]
    meets, place = np.unique(q * span + key - low_key, return_inverse=True)
    score = np.round(np.bincount(place, weight), 6)
    q, key = meets // span, meets % span + low_key
    kept = _best_rows(q, score, limit)
    kept = kept[score[kept] > 0]
    return q[kept], key[kept], score[kept]


def _best_rows(q: np.ndarray, score: np.ndarray, limit: int) -> np.ndarray:
    """Places of the rows with the best limit scores of each question, with ties, in the order of questions."""
    best = np.lexsort((-score, q))
    if not len(best):
        return best
    first = np.flatnonzero(np.concatenate([[True], q[best][1:] != q[best][:-1]]))
    size = np.diff(np.append(first, len(best)))
    low = np.repeat(score[best][first + np.minimum(size, limit) - 1], size)  # ties with the last of them stay
    return best[score[best] >= low]


def _table_best(doc: np.ndarray, own: np.ndarray, weight: np.ndarray, askers: np.ndarray, starts: np.ndarray, n_texts: int, limit: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Questions, texts and scores of the best limit texts of each question, with ties, where most texts share a term with most questions: scores
    are made in a table of few texts by all questions. Terms that meet in many of its cells come as a product of matrices, all others one
    meeting at a time. least: the score below which a question takes no text, as limit better ones are known; it is raised here."""
    n, fan = len(least), np.diff(starts)
    meets = fan * np.bincount(own, minlength=len(fan))
    wide = np.argsort(-meets, kind="stable")[: DENSE_BYTES // (8 * n)]
    wide = wide[meets[wide] >= DENSE_SHARE * n * n_texts]
    place = np.full(len(fan), -1)
    place[wide] = np.arange(len(wide))
    asked = np.zeros((len(wide), n))
    for i, t in enumerate(wide.tolist()):
        asked[i, askers[starts[t] : starts[t + 1]]] = 1
    step, held, found = max(1, TABLE_CELLS // n), [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], []
    for at in range(0, n_texts, step):
        a, b = np.searchsorted(doc, [at, at + step])
        d, t, w = doc[a:b] - at, own[a:b], weight[a:b]
        col = place[t]
        weights = np.zeros((min(step, n_texts - at), len(wide)))
        weights[d[col >= 0], col[col >= 0]] = w[col >= 0]
        d, t, w = d[col < 0], t[col < 0], w[col < 0]
        k = fan[t]
        q = askers[np.repeat(starts[t] - np.cumsum(k) + k, k) + np.arange(k.sum())]
        table = weights @ asked
        table += np.bincount(np.repeat(d * n, k) + q, np.repeat(w, k), minlength=table.size).reshape(table.shape)
        good = table >= least - LEAST / 2
        if len(table) > limit and np.count_nonzero(good) > n * limit:
            np.maximum(least, np.round(np.partition(table, -limit, axis=0)[-limit], 6), out=least)
            good = table >= least - LEAST / 2
        cells = np.flatnonzero(good)
        found.append((cells % n, cells // n + at, np.round(table.reshape(-1)[cells], 6)))
        if sum(len(x[0]) for x in found) > n * limit or at + step >= n_texts:
            q, key, score = (np.concatenate(x) for x in zip(held, *found, strict=True))
            kept = _best_rows(q, score, limit)
            held, found = [q[kept], key[kept], score[kept]], []
            many = np.bincount(held[0], minlength=n)
            last = held[2][np.cumsum(many)[many >= limit] - 1]  # rows of a question stand by their scores
            least[many >= limit] = np.maximum(least[many >= limit], last)
    return tuple(held)


def _term_scores(names: list, of: np.ndarray, term: np.ndarray, terms: pa.Array, idf: np.ndarray, avgdl: float, limit: int, q_type: pa.DataType):  # noqa: ANN202
    """Scores the texts of a batch for all questions: each posting meets the questions that hold its term. So many texts are taken at once
    as bring MEETINGS of these, or one text; work and memory follow what texts and questions share."""
    order = np.argsort(term, kind="stable")
    askers, starts = of[order], np.searchsorted(term[order], np.arange(len(terms) + 1))
    fan = np.diff(starts)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full(len(names), LEAST)
        for batch in batches:
            doc, own, dl = _term_places(batch.column("low"), terms)
            pair, tf = np.unique(doc * len(terms) + own, return_counts=True)
            doc, own = pair // len(terms), pair % len(terms)
            weight = idf[own] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[doc] / avgdl))
            upto, at = np.cumsum(fan[own]), 0
            if len(doc) and upto[-1] >= TABLE_SHARE * len(names) * len(batch):
                q, key, score = _table_best(doc, own, weight, askers, starts, len(batch), limit, least)
                for part in range(0, len(q), MEETINGS):
                    few = slice(part, part + MEETINGS)
                    yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in q[few].tolist()], q_type), batch.column("key").take(pa.array(key[few])), pa.array(score[few])], names=["q", "key", "score"])
                continue
            while at < len(doc):
                most = np.searchsorted(upto, (upto[at - 1] if at else 0) + MEETINGS, "right")
                end = len(doc) if most >= len(doc) else max(int(np.searchsorted(doc, doc[most])), int(np.searchsorted(doc, doc[at], "right")))
                n, key = fan[own[at:end]], doc[at:end]
                q = askers[np.repeat(starts[own[at:end]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                q, key, score = _best_meetings(q, np.repeat(key, n), np.repeat(weight[at:end], n), len(names), limit)
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in q.tolist()], q_type), batch.column("key").take(pa.array(key)), pa.array(score)], names=["q", "key", "score"])
                at = end

    return apply


def bm25(docs: DataFrame, questions: DataFrame, limit: int) -> DataFrame:
    """(q, key, score, rank) of the best texts of docs (key, text).

    Up to QUERY_TERMS pairs of questions and terms go to every task, which scores its texts for all questions at once and
    keeps its own best for each, so that the shuffle carries limit rows for each batch and question; more pairs are
    joined with the texts' terms. A text without a term of a question is no result for it; a null text is an empty one.
    """
    asked = query_terms(questions)
    if asked.count() > QUERY_TERMS:
        return _joined_bm25(docs, asked, limit)
    pairs = asked.orderBy("q").toArrow()
    terms = pc.unique(pairs["term"])
    number, names = {}, []
    for q in pairs["q"].to_pylist():
        if q not in number:
            number[q] = len(names)
            names.append(q)
    of = np.array([number[q] for q in pairs["q"].to_pylist()], np.int64)
    term = np.asarray(pc.index_in(pairs["term"], value_set=terms), np.int64)
    own = docs.select("key", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    n = dict(own.select("low").mapInArrow(_term_counts(terms), "term long, n long").groupBy("term").agg(F.sum("n")).toArrow().to_pandas().itertuples(index=False, name=None)) if names else {}
    total, df = n.get(-1, 0), np.array([n.get(t, 0) for t in range(len(terms))], np.float64)
    schema = f"q {questions.schema['q'].dataType.simpleString()}, key {docs.schema['key'].dataType.simpleString()}, score double"
    score = _term_scores(names, of, term, terms, np.log(1 + (total - df + 0.5) / (df + 0.5)), n.get(-2, 0) / max(total, 1) or 1.0, limit, to_arrow_type(questions.schema["q"].dataType))
    return ranked((own if names else own.limit(0)).mapInArrow(score, schema), ["q"], [F.desc("score"), F.asc("key")], limit)


def _joined_bm25(docs: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """bm25 of any number of questions, as joins; a term's weights are computed once, however many questions hold it."""
    own = docs.select("key", T.tokens(F.coalesce("text", F.lit(""))).alias("t")).withColumn("dl", F.size("t"))
    size = own.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    terms = asked.select("term").distinct()
    hits = own.select("key", "dl", F.explode("t").alias("term")).join(terms, "term", "left_semi").groupBy("key", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighted = hits.join(df, "term").crossJoin(F.broadcast(size)).select("term", "key", weight.alias("w"))
    scores = weighted.join(asked, "term").groupBy("q", "key").agg(F.round(F.sum("w"), 6).alias("score"))
    return ranked(scores, ["q"], [F.desc("score"), F.asc("key")], limit)


# ---- vector leg


def hashed_vectors(docs: DataFrame, dims: int = DIMS) -> DataFrame:
    """(key, vec) of (key, text): the deterministic default embedder, counts of terms by hashed dimension. A vector depends on its row
    alone; a text without a term, or null, has none."""
    own = docs.select("key", F.lower("text").alias("low"))
    schema = f"key {docs.schema['key'].dataType.simpleString()}, vec array<double>"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, end - at) for b in batches for at, end in _pieces(b.column("low"), PIECE)):
            lists = pc.split_pattern(pc.replace_substring_regex(pc.fill_null(batch.column("low"), ""), "[^a-z0-9]+", " "), " ")
            values, doc = pc.dictionary_encode(lists.flatten()), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            places_ = np.array([int.from_bytes(hashlib.md5(t.encode()).digest()[:2], "big") % dims if t else -1 for t in values.dictionary.to_pylist()], np.int64)
            dim = places_[values.indices.to_numpy(zero_copy_only=False)] if len(values) else np.zeros(0, np.int64)
            some = dim >= 0
            counts = np.bincount(doc[some] * dims + dim[some], minlength=len(lists) * dims).reshape(len(lists), dims).astype(np.float64)
            kept = np.flatnonzero(counts.any(axis=1))
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1) * dims, pa.int32()), pa.array(counts[kept].reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(kept)), vec], names=["key", "vec"])

    return own.mapInArrow(apply, schema)


def _matrix(vecs: list, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of the usable vectors of one length, and their places: null and zero vectors, and those with a null or
    non-finite component, are left out."""
    fit = np.array([j for j, v in enumerate(vecs) if v is not None and len(v) == dims and None not in v], np.int64)
    x = np.array([vecs[j] for j in fit.tolist()], np.float64).reshape(len(fit), dims)
    most = np.abs(x).max(axis=1, initial=0)
    good = np.isfinite(x).all(axis=1) & (most > 0)
    x = x[good] / most[good, None]
    return x / np.linalg.norm(x, axis=1, keepdims=True), fit[good]


def _best(questions: np.ndarray, vectors: np.ndarray, limit: int, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of questions and vectors and their cosines: for each question all that its limit nearest could be, ties included. least: the
    cosine below which a question takes no vector; it is raised once limit nearer ones are known."""
    for a in range(0, len(questions), ASKED_AT_ONCE):
        own, found = least[a : a + ASKED_AT_ONCE], []
        for at in range(0, len(vectors), VECTORS_AT_ONCE):
            score = questions[a : a + ASKED_AT_ONCE] @ vectors[at : at + VECTORS_AT_ONCE].T
            good = score >= own[:, None] - LEAST
            if score.shape[1] > limit and np.count_nonzero(good) > limit * len(own):
                np.maximum(own, np.round(np.partition(score, -limit, axis=1)[:, -limit], 6), out=own)
                good = score >= own[:, None] - LEAST
            r, c = np.nonzero(good)
            found.append((r, c + at, np.round(score[r, c], 6)))
        r, c, score = (np.concatenate(x) for x in zip(*found, strict=True))
        some = score >= own[r]
        r, c, score = r[some], c[some], score[some]
        kept = _best_rows(r, score, limit)
        yield r[kept] + a, c[kept], score[kept]


def cosine_topk(vectors: DataFrame, questions: DataFrame, limit: int, threshold: float | None = None) -> DataFrame:
    """(q, key, score, rank): the nearest vectors (key, vec) of each question (q, vec) by exact cosine, rounded to six places.

    Up to QUERY_BYTES of question vectors go to every task; more are cut into blocks, as are the vectors, and each pair of
    blocks is one group. Either way a task keeps only its own best for each question, so that the shuffle carries limit
    rows for each task and question. A question meets the vectors of its own length. Vectors that are null or zero, or have a null
    or non-finite component, match nothing. A predicate on vectors belongs before the call: it reaches the scan.
    """
    asked, stored = (df.filter("vec is not null").select(id_, "vec") for df, id_ in ((questions, "q"), (vectors, "key")))
    size = asked.agg(F.coalesce(F.sum(F.size("vec") * 8), F.lit(0)), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    q_type, key_type = (to_arrow_type(df.schema[c].dataType) for df, c in ((questions, "q"), (vectors, "key")))
    schema = f"q {questions.schema['q'].dataType.simpleString()}, key {vectors.schema['key'].dataType.simpleString()}, score double"

    def by_length(names: list, vecs: list) -> list[tuple[int, np.ndarray, list]]:
        found = []
        for dims in sorted({len(v) for v in vecs if v}):
            matrix, fit = _matrix(vecs, dims)
            found.append((dims, matrix, [names[i] for i in fit.tolist()]))
        return found

    def floors(asked_: list[tuple[int, np.ndarray, list]]) -> list[np.ndarray]:
        return [np.full(len(names), -np.inf if threshold is None else threshold) for _, _, names in asked_]

    def matches(asked_: list[tuple[int, np.ndarray, list]], least: list[np.ndarray], keys: pa.Array | pa.ChunkedArray, vecs: list) -> Iterator[pa.RecordBatch]:
        own = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        for (dims, matrix, names), low in zip(asked_, least, strict=True):
            x, fit = _matrix(vecs, dims)
            if len(x) and names:
                for q, v, score in _best(matrix, x, limit, low):
                    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in q.tolist()], q_type), own.take(pa.array(fit[v])), pa.array(score)], names=["q", "key", "score"])

    if size[0] <= QUERY_BYTES:
        here = asked.collect()
        all_asked = by_length([r.q for r in here], [r.vec for r in here])

        def against_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            least = floors(all_asked)
            for batch in batches:
                yield from matches(all_asked, least, batch.column("key"), batch.column("vec").to_pylist())

        found = stored.mapInArrow(against_all, schema)
    else:
        rows = max(1, BLOCK_BYTES // (8 * size[1]))
        n_q, n_v = (max(1, -(-df.count() // rows)) for df in (asked, stored))

        def blocks(df: DataFrame, id_: str, own: str, n: int, other: str, m: int) -> DataFrame:
            return df.select(id_, "vec", F.pmod(F.xxhash64(id_), F.lit(n)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(other)).groupBy("qb", "vb")

        def pair(qs: pa.Table, vs: pa.Table) -> pa.Table:
            if not len(qs) or not len(vs):
                return pa.table({"q": pa.array([], q_type), "key": pa.array([], key_type), "score": pa.array([], pa.float64())})
            own = by_length(qs["q"].to_pylist(), qs["vec"].to_pylist())
            out = list(matches(own, floors(own), vs["key"], vs["vec"].to_pylist()))
            return pa.Table.from_batches(out, pa.schema([("q", q_type), ("key", key_type), ("score", pa.float64())]))

        found = blocks(asked, "q", "qb", n_q, "vb", n_v).cogroup(blocks(stored, "key", "vb", n_v, "qb", n_q)).applyInArrow(pair, schema)
    return ranked(found, ["q"], [F.desc("score"), F.asc("key")], limit)


# ---- fusion


def fuse(legs: list[tuple[str, DataFrame]]) -> DataFrame:
    """(q, key, rrf, similarity, origins): reciprocal ranks of legs (q, key, score, rank), one group for each row.

    A row's similarity is its cosine in the vector leg and null elsewhere: no other rank passes for one.
    """
    rows = None
    for name, leg in legs:
        similarity = F.col("score") if name == "vector" else F.lit(None).cast("double")
        one = leg.select("q", "key", "rank", F.lit(name).alias("origin"), similarity.alias("similarity"))
        rows = one if rows is None else rows.unionByName(one)
    # dealt anew by hand: legs that are partitioned alike by q must not pass for one partitioning once their tasks are coalesced
    return rows.repartition("q", "key").groupBy("q", "key").agg(
        F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("rrf"), F.max("similarity").alias("similarity"), F.array_sort(F.collect_set("origin")).alias("origins")
    )


def merge_signals(rows: DataFrame, key: list[str]) -> DataFrame:
    """Duplicate rows of (key..., origins, similarity, score): origins united, first similarity that is there, largest score."""
    return rows.groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("origins")))).alias("origins"), F.max("similarity").alias("similarity"), F.max("score").alias("score"))


# ---- questions

#: The shapes of tokens that look like code.
CODE_TOKENS = (
    r"\b[a-z][a-z0-9]*[A-Z]\w*\b", r"\b[A-Z][a-z0-9]+[A-Z]\w*\b", r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b", r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b",
    r"\b\w+(?:\.\w+)+\(", r"\b[\w.-]+/[\w./-]+\b", r"\b[\w-]+\.[a-z]{1,4}\b", r"`[^`\s]+`",
)
ABBREVIATION = r"(?i)^(?:e\.g|i\.e|etc|vs)\.?$"
#: Phrases by which two technologies are joined.
INTEGRATION = r"(?i)\b(?:work(?:s|ing)? together|works? with|integrat\w*|connect\w*|wire[ds]?|wiring|talks? to|interacts? with|flow (?:from|between|through)|powered by|powers|uses? [\w-]+ to\b)"
#: Names by which technologies are asked for.
TECHNOLOGIES = (
    "javascript", "typescript", "python", "rust", "go", "golang", "java", "kotlin", "scala", "php", "elixir", "lua", "zig", "solidity", "html",
    "css", "react", "express", "flask", "django", "node.js", "sqlite", "postgres", "redis", "docker", "yaml", "toml", "json",
)


#: Words that ask for package lists, for markup, and for style.
MANIFEST_WORDS = r"(?i)\b(dependency|dependencies|devdependencies|manifest|version|versions|installed|install|package\.json|package manager|npm|pnpm|yarn)\b"
MARKUP_WORDS = r"\b(html|markup|template|dom|document|page|screen|layout|visible|ui|frontend|browser)\b"
STYLE_WORDS = r"\b(css|style|styles|stylesheet|selector|layout|appearance|theme|visual|color|spacing|responsive|animation)\b"


def query_shape(text: Column) -> Column:
    """identifier, relational or product. Names of technologies are no identifiers."""
    tech = F.array(*map(F.lit, TECHNOLOGIES))
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in CODE_TOKENS]))
    bare = F.transform(found, lambda t: F.replace(t, F.lit("`"), F.lit("")))
    code = F.filter(bare, lambda t: ~t.rlike(ABBREVIATION) & ~F.array_contains(tech, F.lower(t)))
    low = F.lower(text)
    named = sum((low.rlike(r"(^|[^a-z0-9])" + t.replace(".", r"\.") + "($|[^a-z0-9])").cast("int") for t in TECHNOLOGIES), F.lit(0))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "product").when(F.size(code) > 0, "identifier").when((named >= 2) | text.rlike(INTEGRATION), "relational").otherwise("product")


#: For each arm and shape: lexical leg, graph leg, boost, reranking. The last arm is the default.
POLICIES = [
    (arm, shape, True, shape != "identifier" or arm == "full", boost, rerank)
    for arm, product in (("full", (True, True)), ("no-boost-for-product", (False, True)), ("no-rerank-for-product", (True, False)), ("lexical-for-product", (False, False)))
    for shape in ("product", "identifier", "relational")
    for boost, rerank in [product if shape == "product" else (True, True)]
]
ARM = "lexical-for-product"


def policy(questions: DataFrame, arm: str = ARM) -> DataFrame:
    """questions with (shape, use_lexical, use_graph, use_boost, use_rerank)."""
    rows = [p[1:] for p in POLICIES if p[0] == arm]
    table = questions.sparkSession.createDataFrame(rows, "shape string, use_lexical boolean, use_graph boolean, use_boost boolean, use_rerank boolean")
    return questions.withColumn("shape", query_shape(F.col("text"))).join(F.broadcast(table), "shape")


def wants_manifest(text: Column) -> Column:
    return text.rlike(MANIFEST_WORDS)


def surface_families(text: Column) -> Column:
    low = F.lower(text)
    markup, style = low.rlike(MARKUP_WORDS), low.rlike(STYLE_WORDS)
    return F.filter(F.array(F.when(markup, "markup"), F.when(style, "style")), lambda x: x.isNotNull())


def lexical_tokens(questions: DataFrame, limit: int = 8) -> DataFrame:
    """(q, tokens): the words of a question and the parts of its identifiers, first of each normal form, by priority."""
    raw = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z0-9_$@./-]{2,}"), F.lit(0))
    every = F.flatten(F.transform(raw, lambda t: F.concat(F.array(t), T.split_identifier(t, lower=False))))
    rows = questions.select("q", F.posexplode(every).alias("i", "token")).withColumn("norm", T.search_token(F.col("token")))
    rows = rows.filter(~F.col("norm").isin(*T.STOPWORDS))
    first = rows.groupBy("q", "norm").agg(F.min(F.struct("i", "token")).alias("f")).select("q", F.col("f.i").alias("i"), F.col("f.token").alias("token"))
    order = F.array_sort(F.collect_list(F.struct((-T.lexical_priority(F.col("token"))).alias("p"), "i", "token")))
    return first.groupBy("q").agg(F.transform(F.slice(order, 1, limit), lambda x: x["token"]).alias("tokens"))


BOOST_TERMS = ("path_terms", "content_terms")


def _compared(parts: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(parts, T.search_token), lambda t: F.length(t) >= 2))


def boost_terms(path: Column, content: Column) -> tuple[Column, Column]:
    """What domain_boost compares a question's tokens with: parts of identifiers, which are in the compared form."""
    parts = lambda c: F.array_distinct(F.filter(T.split_text(c), lambda t: F.length(t) >= 2))
    return parts(path), parts(F.substring(content, 1, 4000))


def domain_boost(rows: DataFrame) -> DataFrame:
    """rows of (tokens, families, manifest_seeking, path, content[, profile]) with (boost): surface family 300, 40 for each term in the
    path, else 3 for one in the content's first 4000 characters, and less 80 for a manifest that is not asked for; with a
    profile, the sets of profiles.context or null, 120 times its score. With columns BOOST_TERMS, boost_terms of path and content, these
    are not made again for each row, and content is needed for profiles only."""
    parts = _compared(F.col("tokens"))
    path, content = (F.col(c) for c in BOOST_TERMS) if set(BOOST_TERMS) <= set(rows.columns) else boost_terms(F.col("path"), F.col("content"))
    in_path = F.array_intersect(parts, path)
    in_content = F.array_intersect(F.array_except(parts, path), content)
    family = F.coalesce(F.array_contains("families", places.family(F.col("path"))).cast("int"), F.lit(0))
    manifest = (~F.col("manifest_seeking") & places.is_manifest(F.col("path"))).cast("int")
    profile = profiles.profile_score(F.col("profile"), F.col("path"), F.col("content")) * 120 if "profile" in rows.columns else F.lit(0)
    return rows.withColumn("boost", (family * 300 + profile + F.size(in_path) * 40 + F.size(in_content) * 3 - manifest * 80).cast("double"))


def tiebreak(boost: Column) -> Column:
    """A positive boost that may only settle near ties."""
    return F.when(boost > 0, F.least(boost / 100, F.lit(1.9))).otherwise(boost)


# ---- selection


def path_diverse(rows: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The best row of each path in order, then the rest: k of each q, with (rank)."""
    first = F.row_number().over(Window.partitionBy("q", "path").orderBy(*order)) > 1
    return ranked(rows.withColumn("_again", first), ["q"], [F.col("_again"), *order], k).drop("_again")


def with_support(primary: DataFrame, support: DataFrame, k: int, slots: int, order: list[Column]) -> DataFrame:
    """k rows of each q: path-diverse primary rows, but up to slots places for support rows that are no primary rows."""
    keys = ["q", "path", "line_start", "line_end"]
    other = ranked(support.join(primary.select(*keys), keys, "left_anti"), ["q"], order, min(slots, k)).withColumn("support", F.lit(True))
    taken = other.groupBy("q").agg(F.count(F.lit(1)).alias("taken"))
    main = path_diverse(primary, k, order).withColumn("support", F.lit(False)).join(taken, "q", "left")
    inside = main.filter(F.col("rank") <= k - F.coalesce("taken", F.lit(0))).drop("taken")
    return ranked(inside.unionByName(other.select(*inside.columns)).withColumnRenamed("rank", "own").repartition("q"), ["q"], [F.col("support"), F.col("own")], k).drop("own")


# ---- models


def rerank(rows: DataFrame, score: Callable[[Column, Column], Column], head: int = 20) -> DataFrame:
    """rows of (q, text, content, rank) with a new rank: the first head rows ordered by reciprocal ranks of the incoming
    order and of the scorer's, the rest unchanged. A scorer is any column expression, such as a pandas UDF of a model."""
    top = rows.withColumn("_model", F.when(F.col("rank") <= head, score(F.col("text"), F.col("content"))))
    model = F.row_number().over(Window.partitionBy("q", F.col("rank") <= head).orderBy(F.desc_nulls_last("_model"), "rank"))
    blended = top.withColumn("_at", model).withColumn("_rrf", F.when(F.col("rank") <= head, F.round(1 / (RRF_K + F.col("rank")) + 1 / (RRF_K + F.col("_at")), 9)))
    own = F.row_number().over(Window.partitionBy("q").orderBy(F.desc_nulls_last("_rrf"), "rank"))
    return blended.withColumn("new_rank", own).drop("rank", "_model", "_at", "_rrf").withColumnRenamed("new_rank", "rank")


def word_overlap(text: Column, content: Column) -> Column:
    """The default scorer: the share of a question's terms that a text has."""
    asked = F.array_distinct(T.tokens(text))
    return F.size(F.array_intersect(asked, T.tokens(content))) / F.greatest(F.size(asked), F.lit(1))
