"""Byte-level BPE encoding and decoding of whole corpora: each distinct word is encoded once.

Texts are exploded into pre-tokens with their positions. Stretches of texts (chunks) reduce their pre-tokens to
distinct words before anything moves: the positions stay behind, as a file of the chunk in the shared folder. The words of
all chunks are shuffled by word, encoded once each, sent back to their chunks and put together by position. A word costs one entry for each chunk that holds it, however frequent
it is, so that no key is hot. Decoding joins each id with the table of token bytes and puts the bytes together by position.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import kernels as K
from .codec import pack, steps, unpack
from .scratch import local_path, shared_dir

#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK = 8 << 20
#: Ids of a block whose distinct ones are joined with their bytes; a longer row is a block of its own.
BLOCK = 1 << 18
#: Words kept by a task that encodes; beyond it, a word of a later chunk is encoded again.
KNOWN = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of base64 tokens and their ranks."""
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoder(path: str):  # noqa: ANN202
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


#: kind 0: the words of a chunk for one bucket (at: slots and lengths; data: bytes), later its ids. kind 1: that there is a chunk.
ROWS = "kind int, chunk long, bucket int, at binary, data binary"
_ROWS = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("at", pa.binary()), ("data", pa.binary())])


class _Chunk:
    """Distinct words in order of appearance, and for each text the slots of its pre-tokens."""

    def __init__(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.hashes: list[np.ndarray] = []
        self.words: list[bytes] = []
        self.codes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.size = 0

    def add(self, data: np.ndarray, offsets: np.ndarray, docs: np.ndarray) -> None:
        starts = K.pretoken_starts(data, offsets)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        words, first, hashes, inverse = K.distinct_spans(data, starts, ends) if len(starts) else ([], *[np.zeros(0, np.int64)] * 3)
        slots = self.slots
        new = np.array([k for k, w in enumerate(words) if w not in slots], np.int64)
        new = new[np.argsort(first[new], kind="stable")] if len(new) else new
        for k in new.tolist():
            slots[words[k]] = len(slots)
            self.words.append(words[k])
        if len(new):
            self.hashes.append(hashes[new])
        own = np.fromiter(map(slots.__getitem__, words), np.int64, len(words))
        self.codes.append(own[inverse].astype(np.uint32))
        self.counts.append(np.diff(np.searchsorted(starts, offsets, "left")))
        self.docs.append(docs)
        self.size += len(data)

    def positions(self) -> tuple[bytes, np.ndarray]:
        """The chunk's file: ids and lengths of its documents and the slots of their pre-tokens; and the words in the order
        of slots. Frequent words get small slots, whose codes take few bits."""
        codes = np.concatenate(self.codes)
        self.codes.clear()
        order = np.argsort(-np.bincount(codes, minlength=len(self.words)), kind="stable")
        slot = np.empty(len(order), np.uint32)
        slot[order] = np.arange(len(order), dtype=np.uint32)
        return pack(np.concatenate(self.counts).astype(np.uint32), *np.concatenate(self.docs).T.copy(), slot[codes]), order

    def rows(self, order: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes | None, bytes | None]]:
        yield 1, 0, None, None
        if not self.words:
            return
        bucket = (np.concatenate(self.hashes) % np.uint64(buckets)).astype(np.int64)[order]
        by_bucket = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
        for b in range(buckets):
            own = by_bucket[cuts[b] : cuts[b + 1]]
            if len(own):
                words = [self.words[k] for k in order[own].tolist()]
                yield 0, b, pack(steps(own.astype(np.uint32)), np.fromiter(map(len, words), np.uint32, len(words))), zstandard.compress(b"".join(words), 3)


def explode(docs: DataFrame, buckets: int, folder: str, chunk: int = CHUNK) -> DataFrame:
    """Rows of ROWS, and a file of positions for each chunk. A chunk's number comes from its partition, so that a task that runs
    again over the same rows makes the same chunks and replaces their files by equal ones."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, open_ = TaskContext.get().partitionId() << 24, 0, _Chunk()

        def flush() -> Iterator[pa.RecordBatch]:
            number = part + made
            blob, order = open_.positions()
            temp = f"{folder}/{number}.{TaskContext.get().taskAttemptId()}.part"
            with open(temp, "wb") as f:
                f.write(blob)
            os.replace(temp, f"{folder}/{number}")
            for kind, bucket, a, b in open_.rows(order, buckets):
                yield pa.RecordBatch.from_pydict({"kind": [kind], "chunk": [number], "bucket": [bucket if kind == 0 else number % buckets], "at": [a], "data": [b]}, schema=_ROWS)

        for batch in batches:
            data, offsets = K.column_bytes(batch.column("text"))
            ids = batch.column("doc_id")
            # ids travel as 64 bits and a flag for null
            pairs = np.stack([ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)], axis=1)
            for i, j in K.blocks(offsets):
                if open_.size and open_.size + offsets[j] - offsets[i] > chunk:
                    yield from flush()
                    made, open_ = made + 1, _Chunk()
                open_.add(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], pairs[i:j])
        if open_.docs:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(apply, ROWS)


def encode_words(rows: DataFrame, ranks: str) -> DataFrame:
    """Rows of kind 0 get their token ids (at: steps of slots and numbers of ids; data: the ids); others pass."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            if encode is None:
                encode = _encoder(ranks).encode_ordinary
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    if len(known) > KNOWN:
                        known.clear()
                    slots, lens = unpack(row["at"], 2)
                    raw, at, out = zstandard.decompress(row["data"]), 0, []
                    for size in lens.tolist():
                        word = raw[at : at + size]
                        at += size
                        ids = known.get(word)
                        if ids is None:
                            ids = known[word] = encode(word.decode())
                        out.append(ids)
                    row["at"] = pack(slots, np.fromiter(map(len, out), np.uint32, len(out)))
                    row["data"] = pack(np.fromiter((x for ids in out for x in ids), np.uint32))
                yield pa.RecordBatch.from_pylist([row], schema=_ROWS)

    return rows.mapInArrow(apply, ROWS)


def _texts(group: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids) of some texts of a chunk at a time. Of the chunk's rows only its words' ids are kept."""
    slots, lens, ids, chunk = [], [], [], None
    for batch in group:
        for row in batch.to_pylist():
            chunk = row["chunk"]
            if row["kind"] == 0:
                gaps, n = unpack(row["at"], 2)
                slots.append(np.cumsum(gaps.astype(np.int64)))
                lens.append(n.astype(np.int64))
                ids += unpack(row["data"], 1)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    slot, size = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (slots, lens))
    begin, count = np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64)
    begin[slot] = np.cumsum(size) - size
    count[slot] = size
    with open(f"{folder}/{chunk}", "rb") as f:
        per_text, docs, null, codes = unpack(f.read(), 4)
    edges = np.concatenate([[0], np.cumsum(per_text.astype(np.int64))])
    for i in range(0, len(docs), 256):  # some texts at a time
        j = min(i + 256, len(docs))
        own = codes[edges[i] : edges[j]]
        tokens = np.concatenate([[0], np.cumsum(count[own])])
        found, at = flat[K.ragged(begin[own], count[own])].astype(np.int32), tokens[edges[i : j + 1] - edges[i]].astype(np.int32)
        doc = pa.array(docs[i:j].view(np.int64), mask=null[i:j].astype(bool))
        yield pa.RecordBatch.from_arrays([doc, pa.ListArray.from_arrays(at, found)], names=["doc_id", "ids"])


#: What a chunk's batches of (doc_id, ids) become in the worker that made them, and the schema of that.
Then = tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str]


def assemble(rows: DataFrame, folder: str, then: Then | None = None) -> DataFrame:
    """(doc_id, ids): each text's token ids, put together by position."""
    finish, schema = then or (lambda batches: batches, "doc_id long, ids array<int>")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from finish(_texts(batches, folder))

    return rows.groupBy("chunk").applyInArrow(apply, schema)


def n_buckets(docs: DataFrame) -> int:
    """How many buckets the words are shuffled to: as many as shuffles have partitions, and beyond that the root of the
    number of chunks, so that both the words of a bucket and the rows that a chunk sends grow with the root of the input."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.isqrt(int(size) // CHUNK))


def encode(docs: DataFrame, ranks: str, chunk: int = CHUNK, then: Then | None = None) -> DataFrame:
    """(doc_id, ids) of every row of docs: the ids of its whole text by the ranks, as the tiktoken library encodes
    it without special tokens. With then, what that makes of (doc_id, ids), some texts at a time, in the same worker.

    A null or empty text has no ids. Repeated rows and null doc_ids are encoded row by row; an empty table gives
    no rows; only doc_id and text are read. A text longer than a chunk is a chunk of its own.
    """
    buckets = n_buckets(docs)
    folder = local_path(shared_dir(docs.sparkSession))
    os.makedirs(folder, exist_ok=True)
    rows = explode(docs, buckets, folder, chunk)
    return assemble(encode_words(rows.repartition(buckets, "bucket"), ranks), folder, then)


def token_table(spark: SparkSession, ranks: str) -> DataFrame:
    """(id, token): the bytes of each token of the vocabulary, so of a fixed size, whatever the corpus."""
    known = read_ranks(ranks)
    return spark.createDataFrame(pa.table({"id": pa.array(known.values(), pa.int32()), "token": pa.array(known.keys(), pa.binary())}))


#: A block's row: its other columns and the codes of its ids, both only at place 0; then a row for each of its distinct ids.
BLOCKS = "head binary, codes binary, at int, id int"
_BLOCKS = pa.schema([("head", pa.binary()), ("codes", pa.binary()), ("at", pa.int32()), ("id", pa.int32())])


def _distinct_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of BLOCKS: of some rows at a time their distinct ids, and for each id its place among them."""
    for batch in batches:
        ids = batch.column("ids")
        n = pc.list_value_length(ids).fill_null(0).to_numpy().astype(np.int64)
        flat, edges = ids.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(n)])
        others = batch.drop_columns(["ids"]).append_column("n", pc.list_value_length(ids))
        for i, j in K.blocks(edges, BLOCK):
            own = flat[edges[i] : edges[j]]
            distinct, codes = np.unique(own, return_inverse=True)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, others.schema) as stream:
                stream.write_batch(others.slice(i, j - i))
            blank = pa.nulls(len(distinct), pa.binary())
            head = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((sink.getvalue().to_pybytes(), pa.binary()), (codes.astype("<u4").tobytes(), pa.binary()), (0, pa.int32()), (None, pa.int32()))], schema=_BLOCKS)
            yield head
            yield pa.RecordBatch.from_arrays([blank, blank, pa.array(np.arange(1, len(distinct) + 1, dtype=np.int32)), pa.array(distinct.astype(np.int32))], schema=_BLOCKS)


def _decoded(head: bytes, codes: np.ndarray, tokens: list[bytes]) -> pa.RecordBatch:
    """A block's rows, their ids' bytes put together by position."""
    rows = pa.ipc.open_stream(head).read_next_batch()
    length = np.fromiter(map(len, tokens), np.int64, len(tokens))
    begin, data = np.cumsum(length) - length, np.frombuffer(b"".join(tokens), np.uint8)
    text = b"".join(data[K.ragged(begin[c], length[c])].tobytes() for c in (codes[k : k + BLOCK] for k in range(0, len(codes), BLOCK)))
    at = np.concatenate([[0], np.cumsum(length[codes])])
    n = rows.column("n")
    edges = at[np.concatenate([[0], np.cumsum(n.fill_null(0).to_numpy())])].tolist()
    own = [None if x is None else text[a:b] for x, a, b in zip(n.to_pylist(), edges, edges[1:], strict=False)]
    return rows.drop_columns(["n"]).append_column("bytes", pa.array(own, pa.binary()))


def _join_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (head, codes, at, id, token) of blocks, in order, become the blocks' rows with their bytes."""
    head, codes, tokens = None, None, []
    for batch in batches:
        if pc.any(pc.and_(batch.column("token").is_null(), batch.column("id").is_valid())).as_py():
            raise ValueError("an id is no token of the vocabulary")
        at, token = batch.column("at").to_numpy(), batch.column("token").to_pylist()
        edges = [*np.flatnonzero(at == 0).tolist(), len(batch)]
        if not np.array_equal(at[: edges[0]], np.arange(len(tokens) + 1, len(tokens) + 1 + edges[0])):
            raise ValueError("ids have left their order")
        tokens += token[: edges[0]]
        for i, j in zip(edges, edges[1:], strict=False):
            if head is not None:
                yield _decoded(head, codes, tokens)
            head, codes, tokens = batch.column("head")[i].as_py(), np.frombuffer(batch.column("codes")[i].as_py(), "<u4"), token[i + 1 : j]
            if not np.array_equal(at[i:j], np.arange(j - i)):
                raise ValueError("ids have left their order")
    if head is not None:
        yield _decoded(head, codes, tokens)


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """The columns of encoded but ids, and bytes: ids joined with the table of token bytes, put together by position.

    Of some rows at a time each distinct id is joined once. The table is broadcast, as it is as large as the vocabulary;
    so rows stay in their tasks and in order (which is checked), and nothing is shuffled. No ids give no bytes, null ids
    null; an id that is no token is an error. Repeated rows stay, an empty table gives no rows, and the names of other
    columns do not matter, but bytes is replaced.
    """
    kept = [f for f in encoded.schema.fields if f.name not in ("ids", "bytes")]
    own = encoded.select("ids", *[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)])
    return joined(own.mapInArrow(_distinct_ids, BLOCKS), ranks, kept)


def joined(blocks: DataFrame, ranks: str, kept: list[StructField]) -> DataFrame:
    """The rows of blocks, whose other columns are kept, with their bytes."""
    schema, names = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "bytes binary"]), [*(f.name for f in kept), "bytes"]
    with_tokens = blocks.join(F.broadcast(token_table(blocks.sparkSession, ranks)), "id", "left")
    return with_tokens.select("head", "codes", "at", "id", "token").mapInArrow(lambda batches: (b.rename_columns(names) for b in _join_tokens(batches)), schema)


#: What round_trip() knows of a text besides its ids.
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, ids) with (n_tokens, ids_sha256): the number of ids, and SHA-256 of the decimal ids joined by commas."""
    for batch in batches:
        ids = batch.column("ids")
        flat, at = ids.flatten().to_numpy().tolist(), np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())]).tolist()
        digests = [hashlib.sha256(",".join(map(str, flat[a:b])).encode()).hexdigest() for a, b in zip(at, at[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.cast(pc.list_value_length(ids), pa.int64()), pa.array(digests, pa.string()), ids], names=["doc_id", "n_tokens", "ids_sha256", "ids"])


def round_trip(docs: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text: encoded, and decoded from its ids again. The worker that puts ids
    together makes the blocks of decode() of them, so that ids leave it once, and a task runs two workers for both steps."""
    blocks = encode(docs, ranks, then=(lambda batches: _distinct_ids(_digested(batches)), BLOCKS))
    decoded = joined(blocks, ranks, StructType.fromDDL(DIGESTS).fields)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))
