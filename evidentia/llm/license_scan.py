"""Licence scan by a positional index of rare words.

Document frequencies of the licence vocabulary come from the whole corpus. A template of n words of which m must stand
at their places has at least one of its n - m + 1 rarest places right wherever it counts: the postings of these words are
looked up in each file, every start that they propose is verified by relative position, and the template's key phrase must
be there in full. A word counts within SLACK of the place that a start gives it, so that a few words put in or left out
move the rest of a notice without losing it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: By how many places a word of a template may be off. Base phrases allow none.
SLACK = 2

#: Words are runs of letters, digits and all non-ASCII bytes.
WORD = K.byte_table("".join(chr(c) for c in [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: The phrase of the template that has to be there word for word.
    key: str
    #: The share of the template's words that must stand at their places.
    cover: float = 0.8

    @property
    def words(self) -> list[bytes]:
        data = K.lower_ascii(np.frombuffer(self.text.encode(), np.uint8))
        s, e, _ = K.word_spans(data, np.array([0, len(data)]), WORD)
        return [bytes(data[a:b]) for a, b in zip(s, e, strict=True)]


#: The phrases whose places are counted, with their labels.
BASE = (
    Template("mit", "under the mit license", "under the mit license", 1.0),
    Template("apache-2", "apache license version 2", "apache license version 2", 1.0),
    Template("cc-by-nc", "cc by nc", "cc by nc", 1.0),
)

#: Openings and notices of well-known licences.
TEMPLATES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "free of charge to any person"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "apache license version 2"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "in source and binary forms"),
    Template("gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu general public license"),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3", "gnu general public license version 3"),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "gnu lesser general public license"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license v 2 0"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution 4 0"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc"),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related rights", "waived all copyright"),
    Template("unlicense", "This is free and unencumbered software released into the public domain", "free and unencumbered software"),
)


def _hashes(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), np.uint8)
    s, e, _ = K.word_spans(data, np.array([0, len(data)]), WORD)
    return K.span_hash(data, s, e)


class Index:
    """Postings of the templates' words: a few hundred entries, the same for every corpus."""

    def __init__(self, templates: tuple[Template, ...]) -> None:
        self.templates = templates
        self.sequence = [_hashes(t.words) for t in templates]
        self.key = [_hashes(Template("", t.key, "").words) for t in templates]
        self.vocabulary = np.unique(np.concatenate([*self.sequence, *self.key]))
        self.rows = [np.searchsorted(self.vocabulary, s) for s in self.sequence]
        self.key_rows = [np.searchsorted(self.vocabulary, s) for s in self.key]

        sizes = np.array([len(r) for r in self.rows])
        self.flat, self.begin = np.concatenate(self.rows), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        #: How many words of each template must stand at their places.
        self.needed = np.array([next(k for k in range(n + 1) if k / n >= t.cover) for n, t in zip(sizes.tolist(), templates, strict=True)])

    def sought(self, idf: np.ndarray) -> list[np.ndarray]:
        """For each template the rarest places, of which one at least is right (within SLACK) wherever the template is."""
        return [np.argsort(-idf[r], kind="stable")[: len(r) - m + 1] for r, m in zip(self.rows, self.needed.tolist(), strict=True)]

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """For each word its row of the vocabulary, or -1."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at, -1)


INDEX = Index((*BASE, *TEMPLATES))
#: Starts that are verified at once.
STARTS = 1 << 14


def _words(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each block: its range of texts, the vocabulary row of each word, and where each text's words begin."""
    data, offsets = K.column_bytes(batch.column("text"))
    for i, j in K.blocks(offsets):
        low = K.lower_ascii(data[offsets[i] : offsets[j]])
        s, e, at = K.word_spans(low, offsets[i : j + 1] - offsets[i], WORD)
        yield i, j, INDEX.lookup(K.span_hash(low, s, e)) if len(s) else np.zeros(0, np.int64), at


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, total = np.zeros(len(INDEX.vocabulary), np.int64), 0
    for batch in batches:
        for i, j, rows, at in _words(batch):
            total += j - i
            hit = np.flatnonzero(rows >= 0)
            text = np.searchsorted(at, hit, "right") - 1
            pairs = np.unique(text * len(found) + rows[hit])
            found += np.bincount(pairs % len(found), minlength=len(found))
    yield pa.RecordBatch.from_pydict({"word": np.append(np.arange(len(found)), -1), "n": np.append(found, total)})


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """The IDF of each word of the vocabulary, counted over all of docs; one row for each word comes to the driver."""
    rows = docs.select("text").mapInArrow(_frequencies, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r.word: r.n for r in rows}
    return np.log((1 + n.get(-1, 0)) / (1 + np.array([n.get(w, 0) for w in range(len(INDEX.vocabulary))])))


def _phrase_at(rows: np.ndarray, starts: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Which of the starts have the whole phrase."""
    ok = (starts >= 0) & (starts + len(phrase) <= len(rows))
    for k, row in enumerate(phrase.tolist()):
        ok[ok] = rows[starts[ok] + k] == row
    return ok


def scan_file(rows: np.ndarray, sought: list[np.ndarray]) -> tuple[list[tuple[str, int]], dict[str, float]]:
    """Of one file: (label, word) of each base phrase, and the best coverage for each label.

    rows: the vocabulary row of each word of the file, -1 for other words; sought: the places of Index.sought.
    """
    hit = np.flatnonzero(rows >= 0)
    if not len(hit):
        return [], {}
    base: list[tuple[str, int]] = []
    covered: dict[str, float] = {}
    padded = None
    present = np.zeros(len(INDEX.vocabulary), bool)
    present[rows[hit]] = True
    enough = np.add.reduceat(present[INDEX.flat].astype(np.int64), INDEX.begin) >= INDEX.needed
    for t in np.flatnonzero(enough).tolist():
        template, words = INDEX.templates[t], INDEX.rows[t]
        if not present[INDEX.key_rows[t]].all():
            continue
        starts = np.unique(np.concatenate([hit[rows[hit] == words[place]] - place for place in sought[t].tolist()]))
        if t < len(BASE):
            at = starts[_phrase_at(rows, starts, words)]
            base += [(template.label, int(a)) for a in at]
            if len(at):
                covered[template.label] = 1.0
            continue
        if padded is None:
            padded = np.concatenate([np.full(SLACK, -1), rows, np.full(SLACK + 1, -1)])
        starts = np.unique(starts[:, None] + np.arange(-SLACK, SLACK + 1))
        for k in range(0, len(starts), STARTS):
            # relative positions: how many words of the template stand where this start puts them
            places = starts[k : k + STARTS, None] + np.arange(len(words)) + SLACK
            agree = np.zeros(places.shape, bool)
            for off in range(-SLACK, SLACK + 1):
                agree |= padded[np.clip(places + off, 0, len(padded) - 1)] == words
            agree = agree.sum(axis=1)
            for i in np.flatnonzero(agree >= INDEX.needed[t]).tolist():
                start = int(starts[k + i])
                near = np.arange(max(0, start - SLACK), min(len(rows), start + len(words) + SLACK))
                if _phrase_at(rows, near, INDEX.key_rows[t]).any():
                    covered[template.label] = max(covered.get(template.label, 0.0), float(agree[i] / len(words)))
    return base, covered


SCHEMA = "n_words long, places array<struct<label: string, word: long>>, found array<struct<label: string, cover: double>>"


def scan(docs: DataFrame) -> DataFrame:
    """docs with (n_words, places, found): the base phrases' places, and each label with its best coverage.

    Case of A-Z is ignored. A null or empty text has no words and no labels. Repeated rows get equal results, an
    empty table gives none, and further columns pass through except those of these three names.
    """
    sought = INDEX.sought(document_frequencies(docs))
    docs = docs.drop("n_words", "places", "found")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    places_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    found_type = pa.list_(pa.struct([("label", pa.string()), ("cover", pa.float64())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, places, found = [], [], []
            for i, j, rows, at in _words(batch):
                for k in range(j - i):
                    base, covered = scan_file(rows[at[k] : at[k + 1]], sought)
                    n_words.append(int(at[k + 1] - at[k]))
                    places.append([{"label": a, "word": b} for a, b in base])
                    found.append([{"label": a, "cover": b} for a, b in sorted(covered.items())])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words, pa.int64()), pa.array(places, places_type), pa.array(found, found_type)], names=[*batch.schema.names, "n_words", "places", "found"])

    return docs.mapInArrow(apply, f"{kept}, {SCHEMA}")


def summary(scanned: DataFrame) -> DataFrame:
    """One row for each document: counts, first and last place, labels and the best coverage as score."""
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.col("places.word")).alias("first_word"),
        F.array_max(F.col("places.word")).alias("last_word"),
        labels(F.col("places.label")).alias("base_labels"),
        labels(F.concat(F.col("places.label"), F.col("found.label"))).alias("labels"),
        F.coalesce(F.array_max(F.col("found.cover")), F.lit(0.0)).alias("score"),
    )
