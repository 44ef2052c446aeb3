"""A kept text index: postings on disk, changed batch by batch, and a top-k search that reads the ranges it needs.

A batch of texts is a segment, which is never changed afterwards; texts that a later batch replaces or removes are listed as gone,
with the numbers of texts that their terms lose, so that counts stay exact. A segment's texts lie in ranges of about RANGE, in which they
are numbered. A block holds a term's postings in one range, with the largest frequency and the smallest length among them, which bound what
the term adds to a text of the range at any average length (after a merge the smallest length may be that of a text that is gone). The sum
over a question's terms bounds every text of a range, so that a range whose sum is below the score of the k-th text found so far holds no
result, and none of its blocks is scored. The row of the empty term lists a range's texts, with their keys and lengths.

Most terms are in few texts of a range, so that blocks are small and many. A range's blocks of one folder are one row, a pack, with their
postings as bytes behind each other: packs are made, shuffled, written and moved whole, and a search cuts the asked terms' blocks out.
Texts are shuffled once, to their range, where its packs are made; from then on packs move, and no single blocks or postings.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..operators import retrieval as R
from .shared import settled
from .store import ATTEMPTS, Catalog

#: Texts of a range, ranges of a file, and folders by term; the folder of the empty term.
RANGE, SLICE, BUCKETS, TEXTS = 1024, 256, 64, -1
#: Ranges of a question that are scored first, for a bound on its k-th score.
FIRST = 2
#: Scores are rounded to six places.
SLACK = 1e-6
#: Texts of an index up to which what is known of its ranges, a bit a text, goes to every task; more is joined.
AT_ONCE = 1 << 28
#: Cells of questions by texts that are scored at once.
CELLS = 1 << 21
#: The layout of the folders.
LAYOUT = 3
#: A pack, without the folder and range: terms with blanks between them, whose blocks end where ends says, in numbers and frequencies of four bytes each.
PACK = "terms string, ends array<int>, max_tfs array<int>, min_dls array<int>, ords binary, tfs binary"


def _bucket(term: Column) -> Column:
    return F.when(term == "", F.lit(TEXTS)).otherwise(F.pmod(F.crc32(term), F.lit(BUCKETS)).cast("int"))


def _blocks_of(packs: DataFrame) -> DataFrame:
    """The blocks (segment, term, r, n, max_tf, min_dl, ords, tfs) of packs."""
    each = packs.select("segment", "r", "ends", "max_tfs", "min_dls", "ords", "tfs", F.posexplode(F.split("terms", " ")).alias("i", "term"))
    each = each.withColumn("start", F.expr("if(i = 0, 0, get(ends, i - 1))")).withColumn("m", F.expr("get(ends, i) - start"))
    own = [F.expr(f"substring({c}, 4 * start + 1, 4 * m)").alias(c) for c in ("ords", "tfs")]
    return each.select("segment", "term", "r", F.col("m").cast("long").alias("n"), F.get("max_tfs", "i").alias("max_tf"), F.get("min_dls", "i").alias("min_dl"), *own)


def _is_dead(ord_: str) -> str:
    """Whether the bits of dead hold a text's number."""
    return f"(coalesce(shiftrightunsigned(get(dead, shiftright({ord_}, 6)), {ord_} & 63) & 1L, 0L) = 1L)"


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in values of bytes, all behind each other, and how many each value has."""
    column = column.cast(pa.binary())
    at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    n = (at[-1] - at[0]) // 4
    return (np.frombuffer(column.buffers()[2], "<i4", n, at[0]) if n else np.zeros(0, "<i4")).astype(np.int64), np.diff(at) // 4


def _in_bytes(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    """Values of bytes of which _numbers gives the numbers."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((4 * offsets).astype(np.int32)), pa.py_buffer(values.astype("<i4"))])


def _names(packs: pa.RecordBatch, k: int) -> pa.Array:
    return pc.split_pattern(packs.column("terms").slice(k, 1), " ").flatten()


def _dead_flags(words: pa.Scalar, n: int) -> np.ndarray:
    """Of the bits of dead as flags: those of the first n numbers."""
    flags, bits = np.zeros(n, bool), np.unpackbits(words.values.to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8), bitorder="little")[:n]
    flags[: len(bits)] = bits
    return flags


def _packed(r: int, names: pa.Array, bucket: np.ndarray, low: np.ndarray, term: np.ndarray, ords: np.ndarray, tfs: np.ndarray) -> dict:
    """Columns of a range's packs: of names with their folders, in whose order they come, and the smallest lengths (low), and of postings
    in the order of names and numbers. Each name has postings."""
    begin = np.flatnonzero(np.diff(term, prepend=-1))
    first = np.flatnonzero(np.diff(bucket, prepend=TEXTS))
    terms, posts = np.append(first, len(bucket)), np.append(begin[first], len(term))
    return {
        "bucket": pa.array(bucket[first], pa.int32()), "r": pa.array(np.full(len(first), r), pa.int64()), "terms": pc.binary_join(pa.ListArray.from_arrays(pa.array(terms, pa.int32()), names), " "),
        "ends": _lists(terms, np.append(begin[1:], len(term)) - np.repeat(posts[:-1], np.diff(terms))), "max_tfs": _lists(terms, np.maximum.reduceat(tfs, begin)), "min_dls": _lists(terms, low),
        "ords": _in_bytes(posts, ords), "tfs": _in_bytes(posts, tfs),
    }


#: Bytes of words.
WORD = np.isin(np.arange(256), [*b"abcdefghijklmnopqrstuvwxyz0123456789"])


def _words(low: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of lower-case texts, as functions.text.tokens cuts them, and how many each text has."""
    at = np.frombuffer(low.buffers()[1], np.int32, len(low) + 1, 4 * low.offset)
    if at[-1] == at[0]:
        return pa.array([], pa.string()), np.zeros(len(low), np.int64)
    data = np.frombuffer(low.buffers()[2], np.uint8, at[-1] - at[0], at[0])
    inside = WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = at[:-1][np.diff(at) > 0] - at[0]
    begins[heads] = inside[heads]  # a word ends with its text
    starts, kept = np.append(np.flatnonzero(begins[inside]), inside.sum()).astype(np.int32), data[inside]
    words = pa.Array.from_buffers(pa.string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(kept)])
    return words, np.diff(np.searchsorted(np.flatnonzero(begins), at - at[0]))


def _packs_of(key_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The packs of a range's texts (r, key, low), which are numbered as they come, and their row of the empty term. Texts are cut a piece
    at a time; only numbers and distinct words stay."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, dls, found, terms, ords, tfs, at, known, r = [], [], [], [], [], [], 0, 0, None
        for batch in batches:
            keys.append(batch.column("key"))
            r = batch.column("r")[0].as_py() if len(batch) else r
            texts = batch.column("low").cast(pa.string())
            for a, end in R._pieces(texts, R.PIECE):
                words, dl = _words(texts.slice(a, end - a))
                own, doc = words.dictionary_encode(), np.repeat(np.arange(end - a), dl)
                dls.append(dl)
                pair, tf = np.unique(own.indices.to_numpy().astype(np.int64) * (end - a) + doc, return_counts=True)
                found.append(own.dictionary)
                terms.append(pair // (end - a) + known)
                ords.append(pair % (end - a) + at)
                tfs.append(tf)
                at, known = at + end - a, known + len(own.dictionary)
        if not at:
            return
        dl, empty = np.concatenate(dls), pa.nulls(1, pa.binary())
        lists = lambda x: pa.ListArray.from_arrays(pa.array([0, at], pa.int32()), x)
        texts = {"bucket": pa.array([TEXTS], pa.int32()), "r": pa.array([r], pa.int64()), "terms": pa.array([""]), **dict.fromkeys(("ends", "max_tfs", "min_dls"), pa.nulls(1, pa.list_(pa.int32())))}
        yield pa.RecordBatch.from_pydict(texts | {"ords": empty, "tfs": empty, "dls": lists(pa.array(dl, pa.int32())), "keys": lists(pa.concat_arrays(keys).cast(key_type))})
        if not known:
            return
        names = pa.concat_arrays(found).dictionary_encode()
        bucket = np.array([zlib.crc32(t.encode()) % BUCKETS for t in names.dictionary.to_numpy(zero_copy_only=False)], np.int64)
        by = np.argsort(bucket, kind="stable")
        place = np.empty_like(by)
        place[by] = np.arange(len(by))
        term, ord_ = place[names.indices.to_numpy()[np.concatenate(terms)]], np.concatenate(ords)
        order = np.argsort((term << 32) + ord_, kind="stable")
        term, ord_ = term[order], ord_[order]
        low = np.minimum.reduceat(dl[ord_], np.flatnonzero(np.diff(term, prepend=-1)))
        packs = _packed(r, names.dictionary.take(pa.array(by)), bucket[by], low, term, ord_, np.concatenate(tfs)[order])
        yield pa.RecordBatch.from_pydict(packs | {"dls": pa.nulls(len(packs["r"]), pa.list_(pa.int32())), "keys": pa.nulls(len(packs["r"]), pa.list_(key_type))})

    return apply


def _lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of dead each term (term, lost) of packs has."""
    for batch in batches:
        for k in range(len(batch)):
            ords = _numbers(batch.column("ords").slice(k, 1))[0]
            ends = batch.column("ends")[k].values.to_numpy()
            lost = np.add.reduceat(_dead_flags(batch.column("dead")[k], int(ords.max()) + 1)[ords].astype(np.int64), np.append(0, ends[:-1]))
            some = np.flatnonzero(lost)
            yield pa.RecordBatch.from_pydict({"term": _names(batch, k).take(pa.array(some)), "lost": pa.array(lost[some], pa.int64())})


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packs of ranges (to) into which ranges go, whose live texts are numbered from base. What goes to one pack comes together."""

    def live(batch: pa.RecordBatch, k: int) -> tuple:
        ords, tfs = (_numbers(batch.column(c).slice(k, 1))[0] for c in ("ords", "tfs"))
        names, ends, low = _names(batch, k), *(batch.column(c)[k].values for c in ("ends", "min_dls"))
        alive = ~_dead_flags(batch.column("dead")[k], int(ords.max()) + 1)
        term, left = np.repeat(np.arange(len(names)), np.diff(ends.to_numpy(), prepend=0)), alive[ords]
        return names, low.to_numpy(), term[left], batch.column("base")[k].as_py() + np.cumsum(alive)[ords[left]] - 1, tfs[left]

    rows = ((batch, k) for batch in batches for k in range(len(batch)))
    for (bucket, to), group in groupby(rows, lambda x: (x[0].column("bucket")[x[1]].as_py(), x[0].column("to")[x[1]].as_py())):
        names, low, terms, ords, tfs = zip(*[live(*x) for x in group], strict=True)
        if not sum(map(len, ords)):
            continue
        both = pa.concat_arrays(names).dictionary_encode()
        ids, upto = both.indices.to_numpy(), np.cumsum([0, *map(len, names)])
        least = np.full(len(both.dictionary), np.iinfo(np.int32).max, np.int64)
        np.minimum.at(least, ids, np.concatenate(low))
        left, term = np.unique(ids[np.concatenate([t + a for t, a in zip(terms, upto, strict=False)])], return_inverse=True)
        ord_ = np.concatenate(ords)
        order = np.argsort((term << 32) + ord_, kind="stable")
        yield pa.RecordBatch.from_pydict(_packed(to, both.dictionary.take(pa.array(left)), np.full(len(left), bucket), least[left], term[order], ord_[order], np.concatenate(tfs)[order]))


def _scored(avgdl: float, limit: int, q_type: pa.DataType) -> Callable[[pa.Table], pa.Table]:
    """The best texts (q, segment, r, ord, score) of a range for each of its questions (q, terms), ties included, from its blocks
    (term, idf, ords, tfs), the numbers of its dead texts and the lengths of its texts (numbers)."""

    def apply(group: pa.Table) -> pa.Table:
        kind = group["kind"].to_numpy()
        asked, blocks, dead, lengths = (group.filter(pa.array(kind == k)).combine_chunks() for k in (0, 1, 2, 3))
        out, array = [], lambda t, c: t[c].combine_chunks() if t[c].num_chunks != 1 else t[c].chunk(0)
        if len(asked) and len(blocks):
            flat = lambda t: array(t, "numbers").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            (ords, held), tf = _numbers(array(blocks, "ords")), _numbers(array(blocks, "tfs"))[0]
            block, dl = np.repeat(np.arange(len(blocks)), held), flat(lengths)[ords]
            live = ~np.isin(ords, flat(dead)) if len(dead) else np.ones(len(ords), bool)
            weight = (blocks["idf"].to_numpy()[block] * tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * dl / avgdl)))[live]
            n = np.bincount(block[live], minlength=len(blocks))
            ords, starts, span = ords[live], np.cumsum(n) - n, int(ords.max()) + 1
            terms = array(asked, "terms")
            own = pc.fill_null(pc.index_in(terms.flatten(), value_set=array(blocks, "term")), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            q = pc.list_parent_indices(terms).to_numpy(zero_copy_only=False).astype(np.int64)[own >= 0]
            own = own[own >= 0]
            upto, at = np.cumsum(np.bincount(q, n[own], minlength=len(asked))), 0
            while at < len(asked):
                end = min(at + max(1, CELLS // span), max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CELLS, "right"))), len(asked))
                some = slice(np.searchsorted(q, at), np.searchsorted(q, end))
                m = n[own[some]]
                place = np.repeat(starts[own[some]] - np.cumsum(m) + m, m) + np.arange(m.sum())
                cell, cells = np.repeat(q[some] - at, m) * span + ords[place], (end - at) * span
                score = np.where(np.bincount(cell, minlength=cells) > 0, np.round(np.bincount(cell, weight[place], minlength=cells), 6), -np.inf).reshape(end - at, span)
                low = np.partition(score, -limit, axis=1)[:, -limit, None] if span > limit else -np.inf
                a, b = np.nonzero((score >= low) & (score > -np.inf))
                out.append((a + at, b, score[a, b]))
                at = end
        a, b, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        one = lambda c: pa.array([group[c][0].as_py()] * len(a), group.schema.field(c).type)
        return pa.table({"q": array(asked, "q").take(pa.array(a)).cast(q_type), "segment": one("segment"), "r": one("r"), "ord": pa.array(b, pa.int32()), "score": pa.array(score, pa.float64())})

    return apply


class TextIndex:
    """An index in a catalog. A version is a manifest of segments and lists of what is gone; readers keep the one they opened."""

    def __init__(self, catalog: Catalog, name: str = "text_index") -> None:
        self.catalog, self.name, self.spark = catalog, name, catalog.spark
        self.root = f"{catalog.root}/{name}"

    def _head(self) -> tuple[int, dict]:
        version, manifest = self.catalog.head(self.name)
        if version and manifest.get("layout") != LAYOUT:
            raise ValueError(f"{self.name} was written in another layout and has to be made anew")
        return version, {"segments": manifest.get("segments", {}), "gone": manifest.get("gone", [])}

    def _publish(self, base: int, segments: dict, gone: list[str]) -> int | None:
        return self.catalog.publish(self.name, base, {"segments": segments, "gone": gone, "layout": LAYOUT, "parts": {}})

    def _folder(self, segment: str) -> str:
        return f"{self.root}/blocks/segment={segment}"

    # ---- reading

    def _rows(self, manifest: dict) -> DataFrame:
        """(segment, bucket, r, PACK, dls, keys): packs, and the rows of the empty term."""
        paths = [self._folder(s) for s, x in manifest["segments"].items() if x["n"]]
        return self.spark.read.option("basePath", f"{self.root}/blocks").parquet(*paths)

    def _packs(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        """(segment, bucket, r, PACK)."""
        found = self._rows(manifest).drop("dls", "keys")
        return found.filter(F.col("bucket") != TEXTS if buckets is None else F.col("bucket").isin(buckets))

    def _blocks(self, manifest: dict, buckets: list[int]) -> DataFrame:
        """(segment, term, r, n, max_tf, min_dl, ords, tfs), postings as bytes; the texts (segment, r, n, ords, dls, keys) of ranges for TEXTS alone."""
        if buckets != [TEXTS]:
            return _blocks_of(self._packs(manifest, buckets))
        n = F.size("dls")
        return self._rows(manifest).filter(F.col("bucket") == TEXTS).select("segment", "r", n.cast("long").alias("n"), F.sequence(F.lit(0), n - 1).alias("ords"), "dls", "keys")

    def _docs(self, manifest: dict) -> DataFrame:
        """(segment, r, ord, key, dl), live or not."""
        each = self._blocks(manifest, [TEXTS]).select("segment", "r", F.posexplode(F.arrays_zip("keys", "dls")).alias("ord", "x"))
        return each.select("segment", "r", "ord", F.col("x.keys").alias("key"), F.col("x.dls").alias("dl"))

    def _gone(self, manifest: dict) -> DataFrame | None:
        """(segment, r, ord, dl)."""
        return self.spark.read.parquet(*[f"{g}/texts" for g in manifest["gone"]]) if manifest["gone"] else None

    def _everywhere(self, manifest: dict, rows: DataFrame) -> DataFrame:
        """Rows of ranges, for a join with blocks: the blocks stay where they are, unless the index is very large."""
        return F.broadcast(rows) if sum(s["n"] for s in manifest["segments"].values()) <= AT_ONCE else rows

    @staticmethod
    def _bits(gone: DataFrame) -> DataFrame:
        """(segment, r, dead): the numbers of a range's gone texts as bits of long values."""
        own = gone.select("segment", "r", F.call_function("shiftright", "ord", F.lit(6)).alias("w"), F.expr("shiftleft(1L, ord & 63)").alias("bit"))
        words = own.groupBy("segment", "r", "w").agg(F.bit_or("bit").alias("bits"))
        by = words.groupBy("segment", "r").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"))
        return by.select("segment", "r", F.expr("transform(sequence(0, array_max(map_keys(m))), i -> coalesce(m[i], 0L))").alias("dead"))

    # ---- writing

    def _store(self, rows: DataFrame) -> dict:
        """A segment of packs and rows of the empty term; they come dealt by the folder that they go to."""
        segment = f"s{uuid.uuid4().hex}"
        rows.sortWithinPartitions("bucket", "r").write.partitionBy("bucket").parquet(self._folder(segment))
        texts = self._blocks({"segments": {segment: {"n": 1}}}, [TEXTS])
        n, size = texts.agg(F.sum("n"), F.sum(F.expr("aggregate(dls, 0L, (a, x) -> a + x)"))).first()
        return {"id": segment, "n": n, "size": size, "ranges": max(1, -(-n // RANGE))}

    def _write(self, docs: DataFrame, n: int) -> dict:
        """A segment of n docs (key, text) with different keys."""
        if not n:
            return {"id": f"s{uuid.uuid4().hex}", "n": 0, "size": 0, "ranges": 1}
        rows = docs.select(F.pmod(F.xxhash64("key"), F.lit(max(1, -(-n // RANGE)))).alias("r"), "key", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
        key = docs.schema["key"].dataType
        # in the order of keys, so that a task that is run again gives the same numbers
        kind = f"bucket int, r long, {PACK}, dls array<int>, keys array<{key.simpleString()}>"
        made = rows.repartition("r").sortWithinPartitions("r", "key").groupBy("r").applyInArrow(_packs_of(to_arrow_type(key)), kind)
        return self._store(made.repartition("bucket", F.floor(F.col("r") / SLICE)))

    def _replaced(self, manifest: dict, keys: DataFrame) -> str | None:
        """The folder of the texts (segment, r, ord, dl) that keys replace and of the numbers (term, lost) that their terms lose; null
        without one. Blocks are read in place."""
        if not any(x["n"] for x in manifest["segments"].values()):
            return None
        dead, gone, folder = self._docs(manifest).join(keys, "key", "left_semi").drop("key"), self._gone(manifest), f"{self.root}/gone/{uuid.uuid4().hex}"
        (dead if gone is None else dead.join(gone, ["segment", "r", "ord"], "left_anti")).write.parquet(f"{folder}/texts")
        new = self.spark.read.parquet(f"{folder}/texts")
        if new.isEmpty():
            return None
        near = self._packs(manifest).join(self._everywhere(manifest, self._bits(new)), ["segment", "r"])
        lost = near.select("terms", "ends", "ords", "dead").mapInArrow(_lost, "term string, lost long")
        lost.groupBy("term").agg(F.sum("lost").alias("lost")).write.parquet(f"{folder}/terms")
        return folder

    def apply(self, docs: DataFrame, delete: DataFrame | None = None) -> int:
        """Adds docs (key, text) in the place of texts with the same keys, and removes the keys of delete, as one version. Nothing
        that is kept is written again: a batch costs its own texts and what it replaces. Of rows with one key the largest text
        counts; null keys are left out."""
        own = docs.filter("key is not null").select("key", "text")
        n, most = own.groupBy("key").count().agg(F.count(F.lit(1)), F.max("count")).first()
        if n and most > 1:  # else texts need not meet
            own = own.groupBy("key").agg(F.max("text").alias("text"))
        segment = self._write(own, n)
        keys = own.select("key") if delete is None else own.select("key").unionByName(delete.select("key")).distinct()
        for _ in range(ATTEMPTS):
            base, manifest = self._head()
            gone = self._replaced(manifest, keys)
            if done := self._publish(base, manifest["segments"] | {segment["id"]: segment}, manifest["gone"] + ([gone] if gone else [])):
                return done
        raise RuntimeError(f"other writers replaced {self.name} {ATTEMPTS} times meanwhile")

    def merge(self) -> int:
        """All live texts as one segment. Neighbouring ranges become one of about RANGE live texts, so that packs move whole."""
        base, manifest = self._head()
        held, gone = {s: x for s, x in manifest["segments"].items() if x["n"]}, self._gone(manifest)
        if not held:
            return base
        lost = dict(map(tuple, gone.groupBy("segment").count().collect())) if gone is not None else {}
        live = {s: x["n"] - lost.get(s, 0) for s, x in held.items()}
        if not any(live.values()):
            segment = {"id": f"s{uuid.uuid4().hex}", "n": 0, "size": 0, "ranges": 1}
        else:
            upto, places = 0, []
            for s, x in held.items():
                places += [F.lit(s), F.struct(F.lit(float(upto)).alias("at"), F.lit(live[s] / x["ranges"]).alias("each"))]
                upto += live[s]
            place = F.create_map(*places)[F.col("segment")]
            ranges = self._blocks(manifest, [TEXTS]).select("segment", "r", "n", F.floor((place["at"] + F.col("r") * place["each"]) / RANGE).alias("to"))
            ranges = ranges.select("*", F.lit(None).cast("array<bigint>").alias("dead")) if gone is None else ranges.join(self._everywhere(manifest, self._bits(gone)), ["segment", "r"], "left")
            ranges = ranges.withColumn("dead", F.coalesce("dead", F.array().cast("array<bigint>")))
            before = F.sum(F.col("n") - F.expr("aggregate(dead, 0, (a, x) -> a + bit_count(x))")).over(Window.partitionBy("to").orderBy("segment", "r").rowsBetween(Window.unboundedPreceding, -1))
            moves = self._everywhere(manifest, ranges.select("segment", "r", "to", "dead", F.coalesce(before, F.lit(0)).cast("int").alias("base")))
            texts = self._blocks(manifest, [TEXTS]).select("segment", "r", "dls", "keys").join(moves, ["segment", "r"])
            left = texts.withColumn("at", F.expr(f"filter(sequence(0, size(dls) - 1), i -> not {_is_dead('i')})")).filter("size(at) > 0")
            parts = left.select("to", F.struct("base", F.expr("transform(at, i -> dls[i])").alias("dls"), F.expr("transform(at, i -> keys[i])").alias("keys")).alias("p"))
            whole = parts.groupBy("to").agg(F.sort_array(F.collect_list("p")).alias("p")).select(F.lit(TEXTS).alias("bucket"), F.col("to").alias("r"), F.lit("").alias("terms"), F.flatten("p.dls").alias("dls"), F.flatten("p.keys").alias("keys"))
            packs = self._packs(manifest).drop("max_tfs").join(moves, ["segment", "r"])
            near = packs.repartition("bucket", F.floor(F.col("to") / SLICE)).sortWithinPartitions("bucket", "to", "base")
            moved = near.select("bucket", "to", "base", "dead", "terms", "ends", "min_dls", "ords", "tfs").mapInArrow(_moved, f"bucket int, r long, {PACK}")
            segment = self._store(moved.unionByName(whole.repartition(F.floor(F.col("r") / SLICE)), allowMissingColumns=True))
        done = self._publish(base, {segment["id"]: segment}, [])
        if not done:
            raise RuntimeError(f"another writer changed {self.name} meanwhile")
        return done

    def vacuum(self) -> None:
        """Deletes what the last version does not hold. No reader or writer may be at work meanwhile."""
        fs, manifest = self.catalog._fs, self._head()[1]
        held = {self._folder(s) for s in manifest["segments"]} | set(manifest["gone"])
        for what in ("blocks", "gone"):
            folder = self.catalog._path(f"{self.root}/{what}")
            for f in fs.listStatus(folder) if fs.exists(folder) else []:
                if f"{self.root}/{what}/{f.getPath().getName()}" not in held:
                    fs.delete(f.getPath(), True)

    # ---- searching

    def _weighted(self, manifest: dict, asked: DataFrame) -> tuple[Callable[[DataFrame], DataFrame], DataFrame, DataFrame, float]:
        """What gives the asked terms' blocks (segment, r, term, idf, ords, tfs) in given ranges; their sizes (term, segment, r, n); the sums
        (q, segment, r, bound) of their bounds; and the average length."""
        terms = asked.select("term").distinct()
        numbers = terms.groupBy(_bucket(F.col("term")).alias("bucket")).count().collect()  # BUCKETS numbers at most
        few = F.broadcast if sum(r[1] for r in numbers) <= R.QUERY_TERMS else lambda rows: rows
        packs = self._packs(manifest, [r[0] for r in numbers])
        sizes = settled(_blocks_of(packs).drop("ords", "tfs").join(few(terms), "term", "left_semi"))
        df, gone = sizes.groupBy("term").agg(F.sum("n").alias("df")), self._gone(manifest)
        n, size = (sum(s[k] for s in manifest["segments"].values()) for k in ("n", "size"))
        if gone is not None:
            lost = self.spark.read.parquet(*[f"{g}/terms" for g in manifest["gone"]]).join(few(terms), "term", "left_semi").groupBy("term").agg(F.sum("lost").alias("lost"))
            df = df.join(lost, "term", "left").select("term", (F.col("df") - F.coalesce("lost", F.lit(0))).alias("df"))
            less = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
            n, size = n - less[0], size - less[1]
        avgdl = size / max(n, 1) or 1.0
        idf = settled(df.select("term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")))
        bounds = sizes.join(few(idf), "term").withColumn("bound", self._weight(F.col("idf"), F.col("max_tf"), F.col("min_dl"), avgdl)).select("term", "segment", "r", "bound")

        def weighted(near: DataFrame) -> DataFrame:
            return _blocks_of(packs.join(near, ["segment", "r"], "left_semi")).join(few(idf), "term").select("segment", "r", "term", "idf", "ords", "tfs")

        return weighted, sizes, settled(asked.join(bounds, "term").groupBy("q", "segment", "r").agg(F.sum("bound").alias("bound"))), avgdl

    @staticmethod
    def _weight(idf: Column, tf: Column, dl: Column, avgdl: float) -> Column:
        return idf * tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * dl / F.lit(avgdl)))

    def _plan(self, questions: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
        """The best texts (q, segment, r, ord, score) of each range to be read, those ranges (q, segment, r), and the asked blocks with
        their questions."""
        manifest = self._head()[1]
        if not any(s["n"] for s in manifest["segments"].values()):
            return None
        asked = R.query_terms(questions)
        weighted, sizes, ranges, avgdl = self._weighted(manifest, asked)
        of, gone, q = asked.groupBy("q").agg(F.collect_list("term").alias("terms")), self._gone(manifest), questions.schema["q"].dataType

        def scores(chosen: DataFrame) -> DataFrame:
            near = self._everywhere(manifest, chosen.select("segment", "r").distinct())
            rows = chosen.join(of, "q").select("segment", "r", F.lit(0).alias("kind"), "q", "terms")
            rows = rows.unionByName(weighted(near).withColumn("kind", F.lit(1)), allowMissingColumns=True)
            lengths = self._blocks(manifest, [TEXTS]).join(near, ["segment", "r"], "left_semi").select("segment", "r", F.lit(3).alias("kind"), F.col("dls").alias("numbers"))
            rows = rows.unionByName(lengths, allowMissingColumns=True)
            if gone is not None:
                dead = gone.join(near, ["segment", "r"], "left_semi").groupBy("segment", "r").agg(F.collect_list("ord").alias("numbers"))
                rows = rows.unionByName(dead.withColumn("kind", F.lit(2)), allowMissingColumns=True)
            return rows.groupBy("segment", "r").applyInArrow(_scored(avgdl, limit, to_arrow_type(q)), f"q {q.simpleString()}, segment string, r long, ord int, score double")

        first = settled(R.ranked(ranges, ["q"], [F.desc("bound"), F.asc("segment"), F.asc("r")], FIRST).select("q", "segment", "r"))
        found = settled(scores(first))
        least = R.ranked(found, ["q"], [F.desc("score")], limit).filter(F.col("rank") == limit).select("q", F.col("score").alias("least"))
        rest = ranges.join(first, ["q", "segment", "r"], "left_anti").join(least, "q", "left")
        rest = settled(rest.filter(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - SLACK).select("q", "segment", "r"))
        return found.unionByName(scores(rest)), first.unionByName(rest), asked.join(sizes.select("term", "segment", "r", "n"), "term")

    def search(self, questions: DataFrame, limit: int) -> DataFrame:
        """(q, key, score, rank): the rows of retrieval.bm25 over the live texts. Without texts there are none."""
        plan = self._plan(questions, limit)
        if plan is None:
            return questions.select("q", F.lit(None).cast("string").alias("key"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
        # ties end by keys, which only the best and those equal to them need
        best = plan[0].withColumn("least", F.rank().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("least") <= limit)
        named = best.join(self._docs(self._head()[1]).drop("dl"), ["segment", "r", "ord"]).select("q", "key", "score")
        return R.ranked(named, ["q"], [F.desc("score"), F.asc("key")], limit)

    def reads(self, questions: DataFrame, limit: int) -> DataFrame:
        """(q, blocks, postings, blocks_read, postings_read): what a question's terms have, and what search() reads of it."""
        plan = self._plan(questions, limit)
        if plan is None:
            return questions.select("q", *[F.lit(0).cast("long").alias(c) for c in ("blocks", "postings", "blocks_read", "postings_read")]).limit(0)
        _, chosen, blocks = plan
        both = blocks.join(chosen.withColumn("read", F.lit(True)), ["q", "segment", "r"], "left")
        of_read = lambda c: F.coalesce(F.sum(F.when(F.col("read"), c)), F.lit(0)).cast("long")
        return both.groupBy("q").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("postings"), of_read(F.lit(1)).alias("blocks_read"), of_read(F.col("n")).alias("postings_read"))
