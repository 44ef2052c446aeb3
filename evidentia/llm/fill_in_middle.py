"""Fill-in-middle transformation by a table-driven automaton over bytes.

One scan runs the automaton over the UTF-8 bytes of a block of texts. Each transition carries what it emits: the start of
a unit, the start of a code point, the end of a sentinel; the counts of these give a text's units, its length and whether
it holds a sentinel. A second pass turns unit numbers into byte positions, where the text is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many stay plain, and of 100 others so many put the suffix first.
PLAIN_OF_100, SPM_OF_100 = 10, 20

#: What a transition emits; the bits add up.
UNIT, POINT, SENTINEL = 1, 2, 4
# Classes of bytes. A text's first byte has its class plus FIRST, and is taken as from state OUTSIDE.
_LEAD, _NAME, _LETTER, _OPEN, _CLOSE, _CONTINUED = range(6)
_FIRST = 6
# States: outside letters, in a run of letters, behind "<", behind "<" and one of the sentinels' letters.
_OUTSIDE, _LETTERS, _OPENED, _NAMED = range(4)


def _byte_classes() -> np.ndarray:
    table = np.full(256, _LEAD, np.uint8)
    table[0x80:0xC0] = _CONTINUED
    for a, z in (b"AZ", b"az"):
        table[a : z + 1] = _LETTER
    table[list(b"PSM")] = _NAME
    table[ord("<")], table[ord(">")] = _OPEN, _CLOSE
    return table


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """The next state and the emission, at state * 12 + class."""
    to, emits = np.zeros((4, 2 * _FIRST), np.uint8), np.zeros((4, 2 * _FIRST), np.uint8)
    for state in range(4):
        for kind in range(2 * _FIRST):
            at, byte = (_OUTSIDE, kind - _FIRST) if kind >= _FIRST else (state, kind)
            letter = byte in (_NAME, _LETTER)
            if letter:
                to[state, kind] = _NAMED if byte == _NAME and at == _OPENED else _LETTERS
            elif byte == _OPEN:
                to[state, kind] = _OPENED
            emits[state, kind] = UNIT * (byte != _CONTINUED and not (letter and at in (_LETTERS, _NAMED))) + POINT * (byte != _CONTINUED) + SENTINEL * (byte == _CLOSE and at == _NAMED)
    return to.reshape(-1), emits.reshape(-1)


_CLASS = _byte_classes()
_TO, _EMITS = _transitions()


def scan(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What the automaton emits at each byte. The block is walked in lanes, all a byte further at each step. Two bytes fix the
    state, whatever it was before them, so a lane begins two bytes early and needs no other lane's end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint8)
    kinds = _CLASS[data]
    kinds[offsets[:-1][np.diff(offsets) > 0]] += _FIRST
    size = max(16, int(n**0.5))
    lanes = -(-n // size)
    grid = np.zeros(lanes * size, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(lanes, size).T)
    state = np.zeros(lanes, np.uint8)
    for before in (2, 1):
        state[1:] = _TO[state[1:] * 12 + grid[size - before, :-1]]
    out = np.empty((size, lanes), np.uint8)
    for step in range(size):
        at = state * 12 + grid[step]
        out[step] = _EMITS[at]
        state = _TO[at]
    return out.T.reshape(-1)[:n]


def locate(emitted: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """For each text the number of its units, whether it holds a sentinel, and where prefix and middle end, in bytes of the block
    and in code points of the text. hashes has two columns, from which the cuts are taken."""
    units = np.flatnonzero(emitted & UNIT)
    before = np.searchsorted(units, offsets)
    n = np.diff(before)
    cuts = np.sort(hashes % (n[:, None] + 1), axis=1)
    starts = np.append(units, len(emitted))
    at = np.where(cuts < n[:, None], starts[np.minimum(before[:-1, None] + cuts, len(units))], offsets[1:, None])
    points = np.concatenate([[0], np.cumsum((emitted & POINT) > 0)])
    marks = np.searchsorted(np.flatnonzero(emitted & SENTINEL), offsets)
    return {"n": n, "marked": np.diff(marks) > 0, "cuts": at, "points": points[at] - points[offsets[:-1], None]}


def _hash(doc_id: Column, group: int) -> Column:
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


_NEW = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


def transform(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and others) with (n, form, prefix_chars, middle_chars, output) behind its columns, which replace
    columns of these names.

    A text is a row of n units, runs of A-Z and a-z or single other code points. Two cuts between units, from a hash of doc_id,
    make prefix, middle and suffix, each of which can be empty. form is `plain` (output is the text, the two lengths are
    null), `psm` or `spm`. An empty or null text and one that holds a sentinel are plain; so is one of ten by a hash of doc_id. A
    null doc_id counts as an empty one; repeated rows give repeated results. Texts of any length are cut whole.
    """
    kept = docs.drop(*_NEW)
    given = kept.select(F.struct("*").alias("row"), F.col("text"), *[_hash(F.col("doc_id"), k).alias(f"h{k}") for k in (1, 2, 3, 4)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.column_bytes(batch.column("text"))
            h = np.stack([batch.column(f"h{k}").to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4)], axis=1)
            for i, j in K.blocks(offsets):
                own, ends = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                found = locate(scan(own, ends), ends, h[i:j, :2])
                plain = (np.diff(ends) == 0) | found["marked"] | (h[i:j, 2] % 100 >= 100 - PLAIN_OF_100)
                form = np.where(plain, "plain", np.where(h[i:j, 3] % 100 < SPM_OF_100, "spm", "psm"))
                raw, out = own.tobytes(), []
                for kind, a, z, (b, c) in zip(form.tolist(), ends[:-1].tolist(), ends[1:].tolist(), found["cuts"].tolist(), strict=True):
                    prefix, middle, suffix = raw[a:b], raw[b:c], raw[c:z]
                    if kind == "plain":
                        out.append(raw[a:z])
                    elif kind == "psm":
                        out.append(b"".join((PREFIX.encode(), prefix, SUFFIX.encode(), suffix, MIDDLE.encode(), middle)))
                    else:
                        out.append(b"".join((SUFFIX.encode(), suffix, PREFIX.encode(), prefix, MIDDLE.encode(), middle)))
                points = found["points"]
                columns = [
                    batch.column("row").slice(i, j - i), pa.array(found["n"], pa.int64()), pa.array(form.tolist(), pa.string()), pa.array(points[:, 0], pa.int64(), mask=plain),
                    pa.array(points[:, 1] - points[:, 0], pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["row", *_NEW])

    made = given.mapInArrow(cut, f"row {given.schema['row'].dataType.simpleString()}, " + ", ".join(f"{k} {v}" for k, v in _NEW.items()))
    return made.select("row.*", *_NEW)


def restore(output: Column, form: Column) -> Column:
    """The text, from output and form alone. A text with sentinels is plain, so each sentinel of the other forms is found where it
    comes first."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        a, b = F.locate(second, output), F.locate(MIDDLE, output)
        size = len(first)
        return F.substring(output, F.lit(size + 1), a - size - 1), F.substring(output, a + len(second), b - a - len(second)), F.substring(output, b + len(MIDDLE), F.length(output))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(SUFFIX, PREFIX)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(prefix, middle, suffix))


FILL_IN_MIDDLE_SQL = r"""
with t as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') as u,
  sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
k as (select doc_id, text, u, len(u) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from t),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from k),
p as (select doc_id, text, n, form, array_to_string(u[1:a], '') as prefix, array_to_string(u[a + 1:b], '') as middle, array_to_string(u[b + 1:], '') as suffix from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""
