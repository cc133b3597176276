"""Licence scan by a positional index of rare tokens.

The templates are short phrases (BASE) and notices (NOTICES). A word's weight is its inverse frequency among all templates; the index
has, for each word, its postings (template, position). A template is looked up by its rare tokens, the LOOKUP words of highest weight (of
equal ones the longer, then the earlier): of these by the RARE highest that a file holds. Each place of such a word, less
a position it has in the template, is an offset. Postings of the template's other words are intersected with the file's words at
that offset: a phrase needs all of its words in place, a notice gets the share of its weight that stands within SLACK
words of its place. A notice is found where its share is SHARE or more and its mandatory key phrases stand, word for word, within
SLACK of their places. A phrase's rarest word is in each of its places, so no place is missed.

Words are those of common.cut_words; whole texts are read. Work is linear in the text: a place of a rare token costs a template's
length.

Defined results: null, empty texts and texts without words have no words, empty labels, null first and last words and score 0; every row
has its result, copies and equal or null ids too; the score is 1 with a phrase, else the greatest share of a notice, halved where it isn't found;
an empty table gives no rows; columns to keep are given by name, others are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_words, small_batches

# Phrases and their labels.
BASE = {
    "apache": "apache license",
    "cc-by": "cc by",
    "gpl": "gnu general public license",
    "mit": "mit license",
}
# Words of public licence notices, with their mandatory key phrases.
NOTICES = {
    "agpl": ("licensed under the gnu affero general public license", ("gnu affero general public license",)),
    "apache-2.0": ("licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    "cc-by-nc": ("licensed under cc by nc", ("cc by nc",)),
    "cc-by-nd": ("licensed under cc by nd", ("cc by nd",)),
    "cc-by-sa": ("licensed under cc by sa", ("cc by sa",)),
    "cc0": ("dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    "gpl-2.0": ("licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    "gpl-3.0": ("licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    "lgpl": ("licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    "unlicense": ("this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
}
LOOKUP, RARE, SLACK, SHARE = 6, 3, 3, 0.6
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def weights(templates: list[list[str]]) -> dict[str, int]:
    """Inverse frequencies among templates, in thousandths."""
    df = Counter(w for t in templates for w in set(t))
    return {w: round(1000 * math.log((len(templates) + 1) / n)) for w, n in df.items()}


def rare_tokens(words: list[str], weight: dict[str, int], most: int = LOOKUP) -> list[str]:
    """A template's words for its look-up, best first."""
    return sorted(dict.fromkeys(words), key=lambda w: (-weight[w], -len(w), words.index(w)))[:most]


class Index:
    """Words' numbers and weights, and for each template its words, rare tokens and key phrases as numbers."""

    def __init__(self, base: dict[str, str] = BASE, notices: dict[str, tuple] = NOTICES) -> None:
        split = [x.split() for x in base.values()] + [x[0].split() for x in notices.values()]
        self.weight = weights(split)
        self.words = sorted(self.weight)
        number = {w: i for i, w in enumerate(self.words)}
        self.numbers = lambda words: np.array([number[w] for w in words], np.int32)
        self.by_number = np.array([self.weight[w] for w in self.words], np.int64)
        self.base = [(label, self.numbers(x.split()), self.numbers(rare_tokens(x.split(), self.weight, 1))) for label, x in base.items()]
        self.notices = []
        for label, (text, keys) in notices.items():
            words = text.split()
            placed = [(next(i for i in range(len(words)) if words[i : i + len(k)] == k), self.numbers(k)) for k in map(str.split, keys)]
            self.notices.append((label, self.numbers(words), self.numbers(rare_tokens(words, self.weight)), placed))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "numbers"}


class Places:
    """The words of some files, as numbers in the index, and where each word of the index stands."""

    def __init__(self, texts: pa.Array, index: Index) -> None:
        said, self.n = cut_words(texts)
        self.start = np.concatenate(([0], np.cumsum(self.n)))
        self.code = pc.index_in(said, value_set=pa.array([w.encode() for w in index.words], pa.binary())).fill_null(-1).to_numpy()
        at = np.flatnonzero(self.code >= 0)
        at = at[np.argsort(self.code[at], kind="stable")]
        bounds = np.searchsorted(self.code[at], np.arange(len(index.words) + 1))
        self.of = [at[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def row(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, at, side="right") - 1

    def stands(self, row: np.ndarray, at: np.ndarray, code: int) -> np.ndarray:
        """Whether a word stands at places of given rows."""
        inside = (at >= self.start[row]) & (at < self.start[row + 1])
        out = np.zeros(len(at), bool)
        out[inside] = self.code[at[inside]] == code
        return out

    def offsets(self, words: np.ndarray, rare: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, offset) where a template may stand, by the `most` best rare tokens that each row holds."""
        held = np.zeros(len(self.n), np.int64)
        found = []
        for code in rare:
            at = self.of[code]
            row = self.row(at)
            use = held[row] < most
            found += [np.stack((row[use], at[use] - p)) for p in np.flatnonzero(words == code)]
            held[np.unique(row)] += 1
        both = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
        return both[0], both[1]


def scan(texts: pa.Array, index: Index) -> pa.RecordBatch:
    """One row of SCHEMA for each text."""
    places = Places(texts, index)
    rows = len(places.n)
    n_base, first, last = np.zeros(rows, np.int64), np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1, np.int64)
    score = np.zeros(rows)
    base = [[] for _ in range(rows)]
    for label, words, rare in index.base:
        row, at = places.offsets(words, rare, 1)
        for j, code in enumerate(words):
            keep = places.stands(row, at + j, code)
            row, at = row[keep], at[keep]
        n_base += np.bincount(row, minlength=rows)
        np.minimum.at(first, row, at - places.start[row])
        np.maximum.at(last, row, at - places.start[row])
        for r in np.unique(row):
            base[r].append(label)
    score[n_base > 0] = 1.0
    more = [list(x) for x in base]
    for label, words, rare, keys in index.notices:
        row, at = places.offsets(words, rare, RARE)
        near = range(-SLACK, SLACK + 1)
        got = np.zeros(len(row), np.int64)
        for j, code in enumerate(words):
            here = np.zeros(len(row), bool)
            for s in near:
                here |= places.stands(row, at + j + s, code)
            got += here * index.by_number[code]
        share = got / index.by_number[words].sum()
        sure = np.ones(len(row), bool)
        for p, key in keys:
            here = np.zeros(len(row), bool)
            for s in near:
                whole = np.ones(len(row), bool)
                for j, code in enumerate(key):
                    whole &= places.stands(row, at + p + s + j, code)
                here |= whole
            sure &= here
        sure &= share >= SHARE
        np.maximum.at(score, row, np.where(sure, share, share / 2))
        for r in np.unique(row[sure]):
            more[r].append(label)
    some = n_base > 0
    return pa.RecordBatch.from_arrays(
        [pa.array(places.n, pa.int64()), pa.array(n_base), pa.array(first, mask=~some), pa.array(last, mask=~some), pa.array([",".join(sorted(x)) for x in base]), pa.array([",".join(sorted(x)) for x in more]), pa.array(score)],
        ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    )


def scan_licenses(docs: DataFrame, *, text: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """The columns to keep and those of SCHEMA, one row a row of docs."""
    index = Index()
    kept = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(batches, "said"):
            found = scan(part.column("said"), index)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *found.columns], [*kept, *found.schema.names])

    rows = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)], F.col(text).alias("said"))
    kinds = ", ".join(f"{k} {docs.schema[c].dataType.simpleString()}" for c, k in zip(keep, kept, strict=True))
    return rows.mapInArrow(run, f"{kinds}, {SCHEMA}").withColumnsRenamed(dict(zip(kept, keep, strict=True)))
