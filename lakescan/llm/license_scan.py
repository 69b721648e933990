"""Operator 11, licence scan by a positional index of rare words.

Templates are licence notices and references, a list that is a parameter. Their words are weighted by IDF, counted over
all documents. A template lies at place d of a document if the words that stand at their relative positions, a sixteenth of
its length off at most, carry ``least`` of its weight, and each of its mandatory key phrases stands inside that stretch.
The index has the postings (template, position) of each template's words of highest IDF only, as many as weigh more than
may be missing: whatever matches holds one of them. A document's own licence words are looked up from the rarest on, each
posting gives a place d, and postings are intersected by that place from the rarest word on, dropping places as soon as
too much weight is missing. So few places reach the comparison of whole templates, and none that matches is lost.

One narrow pass counts the document frequencies of the templates' words (a few hundred rows come to the driver, whatever
the corpus), a second one scans; no text is shuffled. Texts are taken apart in chunks and only licence words are kept, so
memory follows a text's bytes and its licence words.

Defined results: a null text counts as empty: no words, no places, no labels, score 0; repeated rows are documents of
their own; rows without doc_id are scanned like others; an empty table gives an empty table; columns other than doc_id
and text do not matter. A document's score is the largest share of a template's weight found, 1 for a base phrase, 0
where nothing is found.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BETWEEN = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")  # between words, before capitals are made small
CHUNK_BYTES = 1 << 20
PLACES = 1 << 18

#: Phrases that label a document wherever their words stand in a row.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


class Template(NamedTuple):
    label: str
    text: str
    phrases: tuple[str, ...]  # each must stand inside the stretch that matches


#: Short references to licences and the opening words of their public notices.
TEMPLATES = (
    Template("mit", "mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted", "without restriction")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    Template("apache-2.0", "apache license version 2 0", ("apache license",)),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("in compliance with the license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "following conditions")),
    Template("bsd", "bsd license", ("bsd license",)),
    Template("gpl-2.0", "gnu general public license version 2", ("general public license", "version 2")),
    Template("gpl-3.0", "gnu general public license version 3", ("general public license", "version 3")),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("general public license", "free software")),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("mpl-2.0", "mozilla public license version 2 0", ("mozilla public license",)),
    Template("cc-by-nc", "cc by nc", ("by nc",)),
    Template("cc-by-sa", "cc by sa", ("by sa",)),
    Template("cc-by-nd", "cc by nd", ("by nd",)),
    Template("cc-by", "creative commons attribution", ("creative commons attribution",)),
    Template("cc0", "creative commons zero", ("creative commons zero",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("public domain",)),
)


def split_words(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


def vocabulary(templates: Iterable[Template] = TEMPLATES) -> dict[bytes, int]:
    """A number for each word of templates, key phrases and base phrases."""
    texts = [*BASE, *(t.text for t in templates), *(p for t in templates for p in t.phrases)]
    return {w: i for i, w in enumerate(dict.fromkeys(w for text in texts for w in split_words(text)))}


def occurrences(text: bytes | None, ids: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of words, places of indexed words, their numbers); the text is taken apart in chunks cut between words."""
    n, at, text = 0, 0, text or b""
    places, found = [], []
    while at < len(text):
        cut = BETWEEN.search(text, at + CHUNK_BYTES)
        end = cut.start() if cut else len(text)
        words = WORD.findall(text[at:end].lower())
        hits = [(i, ids[w]) for i, w in enumerate(words, n) if w in ids]
        if hits:
            both = np.array(hits, np.int64)
            places.append(both[:, 0])
            found.append(both[:, 1])
        n += len(words)
        at = end
    empty = np.empty(0, np.int64)
    return n, np.concatenate(places or [empty]), np.concatenate(found or [empty])


class Known(NamedTuple):
    """A template as the index has it."""

    label: str
    words: np.ndarray
    weights: np.ndarray
    order: list[int]  # positions from the rarest word on
    rare: list[int]  # the first of them: a match holds one at least
    slack: int
    spare: float  # weight that may be missing
    phrases: list[list[int]]


class Index:
    """Postings of the templates' rarest words by word, each with its place in the template."""

    def __init__(self, templates: Iterable[Template], n_docs: int, df: dict[int, int], least: float = 0.8) -> None:
        self.ids = vocabulary(templates)
        self.idf = np.array([math.log(1 + n_docs / (1 + df.get(i, 0))) + 1e-6 for i in range(len(self.ids))])
        self.known: list[Known] = []
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for t in templates:
            words = np.array([self.ids[w] for w in split_words(t.text)])
            weights = self.idf[words]
            order = sorted(range(len(words)), key=lambda i: (-weights[i], i))
            spare = (1 - least) * float(weights.sum()) + 1e-9
            upto = int(np.searchsorted(np.cumsum(weights[order]), spare, "right")) + 1
            for i in order[:upto]:
                self.postings.setdefault(int(words[i]), []).append((len(self.known), i))
            self.known.append(Known(t.label, words, weights, order, order[:upto], len(words) // 16, spare, [[self.ids[w] for w in split_words(p)] for p in t.phrases]))
        self.base = {label: [self.ids[w] for w in split_words(p)] for p, label in BASE.items()}


def phrase_places(phrase: list[int], at: dict[int, np.ndarray]) -> np.ndarray:
    """Where the words of a phrase stand in a row, from the places of each word."""
    empty = np.empty(0, np.int64)
    found = at.get(phrase[0], empty)
    for k, w in enumerate(phrase[1:], 1):
        found = found[np.isin(found + k, at.get(w, empty), assume_unique=True)] if len(found) else found
    return found


def _near(sorted_places: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether a place lies from low to high."""
    return np.searchsorted(sorted_places, low, "left") < np.searchsorted(sorted_places, high, "right")


def matches(index: Index, at: dict[int, np.ndarray]) -> Iterator[tuple[str, int, int, float]]:
    """(label, first word, words, share of the weight) of the stretches that match a template."""
    empty = np.empty(0, np.int64)
    wanted = dict.fromkeys(k for w in sorted(at, key=lambda w: -index.idf[w]) for k, _ in index.postings.get(w, ()))
    for k in wanted:
        t = index.known[k]
        spots = [len(at.get(w, empty)) > 0 for p in t.phrases for w in p]
        if not all(spots):
            continue
        phrases = [phrase_places(p, at) for p in t.phrases]
        rare = [at.get(int(t.words[i]), empty) - i for i in t.rare]
        first, last = min(x[0] for x in rare if len(x)), max(x[-1] for x in rare if len(x))
        good, shares = [], []
        for start in range(int(first), int(last) + 1, PLACES):
            parts = [x[np.searchsorted(x, start) : np.searchsorted(x, start + PLACES)] for x in rare]
            d = np.unique(np.concatenate(parts))
            if t.slack:
                d = np.unique((d[:, None] + np.arange(-t.slack, t.slack + 1)).ravel())
            missing = np.zeros(len(d))
            for i in t.order:
                there = at.get(int(t.words[i]), empty)
                missing += np.where(_near(there, d + i - t.slack, d + i + t.slack), 0, t.weights[i])
                d, missing = d[missing <= t.spare], missing[missing <= t.spare]
            for p, places in zip(t.phrases, phrases, strict=True):
                inside = _near(places, d - t.slack, d + len(t.words) + t.slack - len(p))
                d, missing = d[inside], missing[inside]
            good.append(d)
            shares.append(1 - missing / t.weights.sum())
        d, share = np.concatenate(good), np.concatenate(shares)
        if len(d) and t.slack:  # windows overlap by the slack
            d, where = np.unique(d, return_index=True)
            share = share[where]
        runs = np.flatnonzero(np.diff(d) > t.slack) + 1
        for places, values in zip(np.split(d, runs), np.split(share, runs), strict=True):
            if len(places):
                best = int(values.argmax())
                yield t.label, int(places[best]), len(t.words), min(float(values[best]), 1.0)


FOUND = "array<struct<label: string, first_word: bigint, n_words: bigint, share: double>>"
SCANNED = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, found {FOUND}"
FOUND_TYPE = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("share", pa.float64())]))


def _by_word(places: np.ndarray, words: np.ndarray) -> dict[int, np.ndarray]:
    order = np.argsort(words, kind="stable")
    words, places = words[order], places[order]
    edges = [0, *(np.flatnonzero(words[1:] != words[:-1]) + 1).tolist(), len(words)]
    return {int(words[a]): places[a:b] for a, b in zip(edges, edges[1:], strict=False) if a < b}


def _scan(index: Index):
    def row(text: bytes | None) -> tuple:
        n, places, words = occurrences(text, index.ids)
        at = _by_word(places, words)
        base = {label: phrase_places(p, at) for label, p in index.base.items()}
        labels = sorted(label for label, x in base.items() if len(x))
        hits = [base[label] for label in labels]
        ends = (int(min(x[0] for x in hits)), int(max(x[-1] for x in hits))) if hits else (None, None)
        found = [dict(zip(("label", "first_word", "n_words", "share"), m, strict=True)) for m in matches(index, at)]
        return n, sum(map(len, hits)), *ends, labels, found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), FOUND_TYPE]
        for batch in batches:
            rows = [row(x.as_buffer().to_pybytes() if x.is_valid else None) for x in batch.column("text").cast(pa.large_binary())]
            columns = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "found"])

    return run


def _counted(ids: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()
        for batch in batches:
            df[-1] += batch.num_rows
            for x in batch.column("text").cast(pa.large_binary()):
                df.update(set(occurrences(x.as_buffer().to_pybytes() if x.is_valid else None, ids)[2].tolist()))
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.int32()), pa.array(list(df.values()), pa.int64())], names=["word", "n"])

    return run


def build_index(docs: DataFrame, templates: Iterable[Template] = TEMPLATES, least: float = 0.8) -> Index:
    """The index, with document frequencies over all rows of ``docs``."""
    counts = docs.select("text").mapInArrow(_counted(vocabulary(templates)), "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    df = {r.word: r.n for r in counts.collect()}  # a row a word of the templates
    return Index(templates, df.pop(-1, 0), df, least)


def license_scan(docs: DataFrame, index: Index) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, found): the base phrases and the stretches that match."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(index), SCANNED)


def query(docs: DataFrame) -> DataFrame:
    d = license_scan(docs, build_index(docs))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", "found.label")))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("found.share"), F.lit(0.0)))
    return d.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
