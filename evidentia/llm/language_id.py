"""Language identification by hyperdimensional profiles.

A letter is a random vector of +1 and -1. A letter trigram is the product of its letters' vectors, the first
rotated by two places and the second by one (binding); a text is the sum over its trigrams (bundling); a language
is the sum of the unit vectors of its texts. A text gets the language whose profile has the largest cosine.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Length of the vectors. Fixed, so that a profile is 4 KB whatever the corpus.
DIM = 512
SYMBOLS = 64
SEED = 20_240_501
UNKNOWN = "und"
#: Cells of a table of texts by trigrams, and trigrams whose vectors are made at once.
CELLS, AT_ONCE = 1 << 23, 8192


@functools.lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """For each code point 0 (no letter), 1 to 26 (a to z without case) or 27 to 63 (other letters, hashed)."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.zeros(0x110000, np.uint8)
    for m in regex.finditer(r"\p{L}", every):
        low = ord(m[0].lower()[0])
        table[ord(m[0])] = low - 96 if 97 <= low <= 122 else 27 + low * 2_654_435_761 % (1 << 32) % 37
    return table


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The vectors of the symbols; symbol 0 stands for the space between words."""
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (SYMBOLS, DIM))


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    v = _letters()
    return np.roll(v, 2, axis=1)[codes >> 12] * np.roll(v, 1, axis=1)[codes >> 6 & 63] * v[codes & 63]


def bundles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row for each text: its bundle, all zero where it has no letter; and its number of trigrams."""
    n = len(offsets) - 1
    lead = (data & 0xC0) != 0x80
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum(lead)])[offsets]
    sym = np.zeros(len(points) + 2 * n, np.uint8)  # a space before and after each text
    text = np.repeat(np.arange(n), np.diff(at))
    place = np.arange(len(points)) + 2 * text + 1
    sym[place] = _symbols()[points]
    owner = np.repeat(np.arange(n), np.diff(at) + 2)
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] > 0) | (sym[:-1] > 0) | (owner[1:] != owner[:-1])  # runs of other characters are one space
    sym, owner = sym[keep].astype(np.int32), owner[keep]
    if len(sym) < 3:
        return np.zeros((n, DIM), np.float32), np.zeros(n, np.int64)
    code = (sym[:-2] << 12) | (sym[1:-1] << 6) | sym[2:]
    good = (owner[:-2] == owner[2:]) & (code > 0) & (sym[1:-1] > 0)  # centred on a letter
    code, owner = code[good], owner[:-2][good]
    return _sums(code, owner, n), np.bincount(owner, minlength=n)


def _sums(code: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts the sum of its trigrams' vectors; owner ascends. All sums are of whole numbers, so that either way
    gives the same: a table of texts by distinct trigrams where it has few cells, else runs of equal trigrams of a text."""
    out = np.zeros((n, DIM), np.float32)
    there = np.zeros(SYMBOLS**3, np.int32)
    there[code] = 1
    distinct = np.flatnonzero(there)
    if n * len(distinct) <= CELLS:
        there[distinct] = np.arange(len(distinct))
        counts = np.bincount(owner * len(distinct) + there[code], minlength=n * len(distinct)).reshape(n, -1) if len(distinct) else np.zeros((n, 0))
        for a in range(0, len(distinct), AT_ONCE):
            out += counts[:, a : a + AT_ONCE].astype(np.float32) @ trigram_vectors(distinct[a : a + AT_ONCE])
        return out
    key, times = np.unique(owner.astype(np.int64) * SYMBOLS**3 + code, return_counts=True)
    text, own = np.divmod(key, SYMBOLS**3)
    for a in range(0, len(key), AT_ONCE):
        t = text[a : a + AT_ONCE]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        out[t[first]] += np.add.reduceat(trigram_vectors(own[a : a + AT_ONCE]) * times[a : a + AT_ONCE, None].astype(np.float32), first, axis=0)
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        data, offsets = K.column_bytes(batch.column("text"))
        for i, j in K.blocks(offsets):
            v, _ = bundles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield batch.slice(i, j - i), v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each language of a partition."""
    sums: dict[str, np.ndarray] = {}
    for batch, v in _batches(batches):
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in set(langs.tolist()):
            sums[lang] = sums.get(lang, 0) + v[langs == lang].sum(axis=0, dtype=np.float64)
    if sums:
        yield pa.RecordBatch.from_pydict({"lang": list(sums), "v": [x.tolist() for x in sums.values()]}, schema=pa.schema([("lang", pa.string()), ("v", pa.list_(pa.float64()))]))


def profiles(train: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages of (text, lang) and their unit profiles: 4 KB for each distinct language comes to the driver."""
    sums = train.select("text", "lang").mapInArrow(_partial, "lang string, v array<double>")
    dims = sums.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = dims.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).x.alias("v")).collect()
    rows = sorted((r for r in rows if any(r.v)), key=lambda r: r.lang)
    v = np.array([r.v for r in rows], np.float64).reshape(len(rows), DIM)
    return [r.lang for r in rows], v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """docs with (lang_pred, score) behind its columns, which replace columns of these names."""
    langs, profile = model
    docs = docs.drop("lang_pred", "score")
    kept = [f for f in docs.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, v in _batches(batches):
            some = np.abs(v).sum(axis=1) > 0
            cosine = v.astype(np.float64) @ profile.T if langs else np.zeros((len(v), 1))
            best = cosine.argmax(axis=1)
            known = some & bool(langs)
            names = np.where(known, np.array(langs or [UNKNOWN], object)[best], UNKNOWN)
            value = np.where(known, np.clip(cosine[np.arange(len(v)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(value)], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(score, schema)


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents, by their ids; nothing is learnt from them."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """docs with (held_out, lang_pred, score); profiles are learnt from documents that are not held out.

    A text that is null, empty or without a letter is `und` with score 0, and so is every text when no document has
    a language. Documents with a null language are predicted but not learnt from. Equal texts get equal results.
    Of several languages with the same cosine the first by name wins. Further columns pass through.
    """
    flagged = docs.withColumn("held_out", held_out(F.col("doc_id")))
    train = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return predict(flagged, profiles(train))
