"""Vector kernels over the UTF-8 bytes of an Arrow text column: spans of words and of BPE pre-tokens, and their 64-bit hashes.

Everything works on blocks of whole texts, so that memory follows the block and not the partition.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
#: An odd multiplier for rolling hashes modulo 2**64, and its inverse.
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about size bytes; a longer text is a block of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j
        i = j


def byte_table(separators: str) -> np.ndarray:
    """For each byte, whether it belongs to a word."""
    table = np.ones(256, bool)
    table[[ord(c) for c in separators]] = False
    return table


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes inside each text, and the number of runs before each text."""
    inside = table[data]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[cut] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[cut - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _P, np.uint64), np.full(n, _PINV, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, from one prefix sum over the block."""
    up, down = _powers(BLOCK if len(data) <= BLOCK else 1 << int(len(data)).bit_length())
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which spans have the same bytes as the span of number other; eight bytes of all are compared at a time."""
    size = ends - starts
    same = size == size[other]
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    live, at = np.flatnonzero(same & (other != np.arange(len(size)))), 0
    while len(live) > 64 or (len(live) and not at):
        left = size[live] - at
        unlike = (eight[starts[live] + at] ^ eight[starts[other[live]] + at]) << (8 * np.maximum(8 - left, 0)).astype(np.uint64)
        same[live[unlike != 0]] = False
        live, at = live[(unlike == 0) & (left > 8)], at + 8
    for k in live.tolist():
        same[k] = data[starts[k] : ends[k]].tobytes() == data[starts[other[k]] : ends[other[k]]].tobytes()
    return same


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct spans' bytes, where each comes first, their hashes, and for each span the number of its bytes. Spans
    meet by hash; bytes decide."""
    hashes, first, inverse = np.unique(span_hash(data, starts, ends), return_index=True, return_inverse=True)
    inverse = inverse.astype(np.int64)
    raw = data.tobytes()
    words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    odd = np.flatnonzero(~same_spans(data, starts, ends, first[inverse]))
    if len(odd):
        extra: dict[bytes, int] = {}
        for k in odd.tolist():
            word = raw[starts[k] : ends[k]]
            if word not in extra:
                extra[word] = len(words)
                words.append(word)
                first, hashes = np.append(first, k), np.append(hashes, hashes[inverse[k]])
            inverse[k] = extra[word]
    return words, first, hashes, inverse


# ---- pre-tokens of byte-level BPE

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.full(0x110000, _OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\p{White_Space}+", _SPACE)):
        for m in regex.finditer(pattern, every):
            a, b = (x + 0x800 * (x >= 0xD800) for x in (m.start(), m.end() - 1))
            table[a : b + 1] = kind
    return table


def pretoken_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of public_tokenizers.PATTERN start; they cover the texts without gaps.

    Runs of one class are tokens; a single blank joins the run behind it, the last white space before
    other text stands alone, and the English contractions are cut where a token may begin.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    table = _classes()
    if (data < 128).all():
        kind = table[data]
    else:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kind = table[points][np.cumsum((data & 0xC0) != 0x80) - 1]
    first = np.zeros(n + 4, bool)  # of a text
    first[offsets[offsets < n]] = True
    first[n:] = True
    prev = np.empty(n, np.uint8)
    prev[1:] = kind[:-1]
    prev[0] = _SPACE
    lead = (data & 0xC0) != 0x80
    start = lead & ((kind != prev) | first[:n])
    white = kind == _SPACE
    # the last white space of a run before other text
    nxt = np.flatnonzero(start & ~white & ~first[:n])
    nxt = nxt[white[nxt - 1]]
    if len(nxt):
        last = nxt - 1
        while (back := ~lead[last]).any():
            last = last - back
        start[last] = True
        start[nxt[data[nxt - 1] == 32]] = False
    quote = np.flatnonzero(data == 39)
    quote = quote[start[quote]]
    if len(quote):
        ext = np.concatenate([data, np.zeros(3, np.uint8)])
        a, b, same_a, same_b = ext[quote + 1], ext[quote + 2], ~first[quote + 1], ~first[quote + 1] & ~first[quote + 2]
        one = same_a & np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = same_b & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))
        # a contraction is a token, whatever follows
        for found, size in ((quote[one], 2), (quote[two], 3)):
            start[found + 1] = False
            if size == 3:
                start[found + 2] = False
            end = found + size
            end = end[end < n]
            # what follows starts anew, but a blank keeps its own rule
            start[end[lead[end] & (kind[end] != _SPACE)]] = True
    return np.flatnonzero(start)


def ragged(at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices at[0] .. at[0]+lens[0]-1, at[1] .. and so on."""
    total = int(lens.sum())
    ends = np.cumsum(lens)
    return np.arange(total) + np.repeat(at - (ends - lens), lens)
