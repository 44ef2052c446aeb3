"""Packing: whole documents into sequences of fixed length, online, with few open windows in each partition."""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import written

LENGTH = 2048
#: Windows that a partition keeps open.
OPEN = 32
#: A window is closed with at most this share of padding; a larger gap is filled with the beginning of the next piece.
SLACK = 0.01
#: Leftover windows that are merged in one group.
MERGE = 4096
END = 1


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """The tokens of a byte-level BPE tokenizer file and their ids, if ids follow the order of the merges: only then is
    joining the pair of the lowest id the same as applying the merges in their order."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; others follow from 256
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(model["vocab"].get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
        return None
    return {bytes(letters[c] for c in token): k for token, k in model["vocab"].items() if k < 256 + len(merges)}


class WordEncoder:
    """Token ids of texts: each distinct pre-token of a stretch is encoded once and kept, up to a bound."""

    BOUND = 500_000

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.known: dict[bytes, bytes] = {}
        if ranks := byte_ranks(path):  # the same ids, faster word by word
            self.one = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True  # in a text, their strings are ordinary text
            self.one = lambda word: tokenizer.encode(word, add_special_tokens=False).ids

    def _learn(self, words: list[bytes]) -> None:
        ids = [self.one(word.decode()) for word in words]
        raw, last = np.array([x for own in ids for x in own], np.uint32).tobytes(), 0
        for word, own in zip(words, ids, strict=True):
            self.known[word] = raw[last : last + 4 * len(own)]
            last += 4 * len(own)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's ids begin."""
        starts = K.pretoken_starts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        words, _, _, inverse = K.distinct_spans(data, starts, ends)
        if len(self.known) > self.BOUND:
            self.known.clear()
        self._learn([w for w in words if w not in self.known])
        packed = [self.known[w] for w in words]
        lens = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        at = np.cumsum(lens) - lens
        ids = np.frombuffer(b"".join(packed), np.uint32)[K.ragged(at[inverse], lens[inverse])]
        tokens = np.concatenate([[0], np.cumsum(lens[inverse])])
        return ids, tokens[np.searchsorted(starts, offsets, "left")]


class Windows:
    """The open windows of a partition; piece() places one piece and gives the windows that it closes."""

    def __init__(self, length: int, limit: int, slack: float, first: int) -> None:
        self.length, self.limit, self.slack, self.next = length, limit, int(slack * length), first
        self.free: list[int] = []  # ascending
        self.window: list[tuple[int, list]] = []  # (sequence, pieces) in the order of free
        self.closed: list[tuple[int, list]] = []

    def place(self, doc: object, total: int, start: int, ids: np.ndarray) -> None:
        while len(ids):
            size = min(len(ids), self.length)
            k = bisect.bisect_left(self.free, size)
            if k == len(self.free):  # none fits
                if len(self.free) < self.limit or size == self.length:
                    self._put(self.length, (self._new(), []), doc, total, start, ids[:size])
                elif (gap := self.free[0]) > self.slack:  # the fullest is filled up and so emitted
                    size = gap
                    self._put(gap, self._take(0), doc, total, start, ids[:size])
                else:
                    self.closed.append(self._take(0))
                    continue
            else:
                self._put(self.free[k], self._take(k), doc, total, start, ids[:size])
            start += size
            ids = ids[size:]

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def _take(self, k: int) -> tuple[int, list]:
        self.free.pop(k)
        return self.window.pop(k)

    def _put(self, free: int, window: tuple[int, list], doc: object, total: int, start: int, ids: np.ndarray) -> None:
        window[1].append((doc, start, len(ids), ids, total, self.length - free))
        left = free - len(ids)
        if left == 0:
            self.closed.append(window)
            return
        k = bisect.bisect_left(self.free, left)
        self.free.insert(k, left)
        self.window.insert(k, window)


PIECES = "doc_id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, closed boolean"


def _rows(windows: list[tuple[int, list]], closed: bool, kind: pa.DataType) -> pa.RecordBatch:
    rows = [(d, s, n, i.astype("<u4").tobytes(), t, w, o, closed) for w, pieces in windows for d, s, n, i, t, o in pieces]
    types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "closed"]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def fill(docs: DataFrame, tokenizer: str, length: int = LENGTH, open_windows: int = OPEN, slack: float = SLACK) -> DataFrame:
    """The pieces as the partitions place them; closed tells windows that are done from leftovers."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)
        windows = Windows(length, open_windows, slack, TaskContext.get().partitionId() << 32)
        kind = pa.int64()
        for batch in batches:
            data, offsets = K.column_bytes(batch.column("text"))
            names = batch.column("doc_id").to_pylist()
            kind = batch.column("doc_id").type
            for i, j in K.blocks(offsets):
                ids, at = encoder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for k in range(i, j):
                    own = np.append(ids[at[k - i] : at[k - i + 1]], np.uint32(END))
                    windows.place(names[k], len(own), 0, own)
                yield _rows(windows.closed, True, kind)
                windows.closed = []
        yield _rows(windows.window, False, kind)

    return docs.select("doc_id", "text").mapInArrow(apply, PIECES.format(id=docs.schema["doc_id"].dataType.simpleString()))


def _merge(length: int):  # noqa: ANN202
    def apply(group: pd.DataFrame) -> pd.DataFrame:
        """Best fit in order of falling size; a merged sequence takes the id of its first window."""
        group = group.sort_values(["used", "sequence_id"], ascending=[False, True])
        bins: list[tuple[int, int]] = []  # (free, sequence), ascending
        out = []
        for window, used in zip(group["sequence_id"].tolist(), group["used"].tolist(), strict=True):
            k = bisect.bisect_left(bins, (used, -1))
            free, to = bins.pop(k) if k < len(bins) else (length, window)
            out.append((window, to, length - free))
            if free > used:
                bisect.insort(bins, (free - used, to))
        return pd.DataFrame(out, columns=["sequence_id", "to", "shift"])

    return apply


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, open_windows: int = OPEN, slack: float = SLACK) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset), one row for each piece of a document.

    ids are unsigned little-endian 32-bit token ids; each document ends with id 1. A piece goes to the open window
    of its partition that it fills best. If none has room, a nearly full window is emitted and a new one opened,
    while a larger gap in the fullest is filled by cutting the piece there. The windows which partitions
    leave open, at most open_windows each, are merged in groups of bounded size.

    A null or empty text is one piece that holds the end id. Texts of any length are cut at the sequence length.
    Repeated rows and ids are packed each for itself, null ids too; an empty table gives no rows; only doc_id
    and text are read. A task that runs again makes the same pieces, as ids of sequences follow its partition.
    """
    pieces = written(fill(docs, tokenizer, length, open_windows, slack), "pieces")
    open_ = written(pieces.filter("not closed").groupBy("sequence_id").agg(F.sum("length").alias("used")), "leftover")
    groups = max(1, -(-open_.count() // MERGE))
    moves = open_.withColumn("g", F.pmod(F.xxhash64("sequence_id"), F.lit(groups))).groupBy("g").applyInPandas(_merge(length), "sequence_id long, to long, shift long")
    columns = ["doc_id", "start", "length", "ids", "doc_tokens"]
    merged = pieces.filter("not closed").join(moves, "sequence_id").select(*columns, F.col("to").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"))
    return pieces.filter("closed").select(*columns, "sequence_id", "offset").unionByName(merged)
