"""Licence scan by a positional index of rare words.

Licence templates are indexed by word and position.  Document frequencies of the words they use, over all
documents, say which are rare.  In each file only the words that are the rarest of some template are looked up;
where a file has one, its postings give the places where that template would have to start.  Postings of further
rare words are intersected at the same relative position, and what remains is verified: the template's mandatory
key phrases must stand in place, and enough of its words.  Phrases are templates that have to stand word for word.

Templates are few and fixed, so the index goes to the tasks; texts are read where they lie and nothing but one
count a word and task is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import Words, slices

#: One word, after A-Z are lower-cased: a run of digits, a-z and what is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SEPARATES = np.ones(256, bool)
_SEPARATES[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Rarest words of a template that are looked up; how many must meet at one place; words by which parts may be moved.
PROBES, MEET, SLACK = 4, 2, 8
#: Share of a template's words, weighed by their rarity, that must stand in place.
LEAST_SHARE = 0.5

#: Phrases that give a label wherever they stand (fixed values).
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Notices of public licences: label, mandatory key phrases, words (fixed values, from the licences' own notices).
TEMPLATES = (
    ("mit", ("mit license",), "released under the MIT License"),
    (
        "mit",
        ("permission is hereby granted free of charge", "without restriction"),
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("apache", ("apache license",), "licensed under the Apache License, Version 2.0"),
    (
        "apache",
        ("apache license", "except in compliance with the license"),
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    (
        "bsd",
        ("redistribution and use in source and binary forms", "with or without modification"),
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    ("bsd", ("bsd license",), "released under the BSD License"),
    (
        "isc",
        ("permission to use copy modify and or distribute", "with or without fee"),
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    ("gpl-notice", ("licensed under the gnu general public license",), "this work is licensed under the GNU General Public License, version"),
    (
        "gpl-notice",
        ("redistribute it and or modify it under the terms of the gnu general public license",),
        "is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version",
    ),
    ("lgpl", ("lesser general public license",), "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", ("affero general public license",), "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl", ("mozilla public license",), "is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("epl", ("eclipse public license",), "made available under the terms of the Eclipse Public License"),
    ("boost", ("boost software license",), "distributed under the Boost Software License, Version 1.0"),
    ("unlicense", ("released into the public domain",), "this is free and unencumbered software released into the public domain"),
    ("cc0", ("cc0",), "dedicated to the public domain under CC0 1.0"),
    ("cc-by-nc", ("cc by nc",), "licensed under CC BY-NC"),
    ("cc-by-sa", ("cc by sa",), "licensed under CC BY-SA"),
    ("cc-by-nd", ("cc by nd",), "licensed under CC BY-ND"),
    ("creative-commons", ("creative commons attribution",), "this work is licensed under a Creative Commons Attribution International License"),
)


def words_of(text: str) -> list[str]:
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    #: (place in the template, length) of each key phrase
    keys: tuple[tuple[int, int], ...]
    #: stands word for word, and all its places are wanted
    exact: bool


def template(label: str, phrases: tuple[str, ...], text: str, exact: bool = False) -> Template:
    words, keys = tuple(words_of(text)), []
    for phrase in phrases:
        key = tuple(words_of(phrase))
        at = next((i for i in range(len(words) - len(key) + 1) if words[i : i + len(key)] == key), None)
        if at is None:
            raise ValueError(f"{label}: the template lacks its phrase {phrase!r}")
        keys.append((at, len(key)))
    return Template(label, words, tuple(keys), exact)


def standard_templates() -> list[Template]:
    return [*(template(label, (phrase,), phrase, True) for phrase, label in PHRASES), *(template(*t) for t in TEMPLATES)]


class Index:
    """Postings of templates by word, and the codes of their words in texts."""

    def __init__(self, templates: list[Template]):
        self.templates = templates
        self.vocabulary = sorted({w for t in templates for w in t.words})
        self.codes = {w: i for i, w in enumerate(self.vocabulary)}
        raw = [w.encode() for w in self.vocabulary]
        if any(not 1 <= len(w) <= 16 for w in raw):
            raise ValueError("words of templates have 16 bytes at most")
        first = [int.from_bytes(w[:8], "little") for w in raw]
        last = [int.from_bytes(w[-8:], "little") for w in raw]
        self._first, self._last, self._size = np.array(first, np.uint64), np.array(last, np.uint64), np.array([len(w) for w in raw])
        keys = self._key(self._first, self._last, self._size)
        self._order = np.argsort(keys)
        self._sorted = keys[self._order]
        if (self._sorted[1:] == self._sorted[:-1]).any():
            raise ValueError("two words of templates have one key")
        self._known = np.zeros(1 << 16, bool)
        self._known[(keys >> np.uint64(48)).astype(np.int64)] = True
        self.numbers = [np.array([self.codes[w] for w in t.words]) for t in templates]

    @staticmethod
    def _key(first: np.ndarray, last: np.ndarray, size: np.ndarray) -> np.ndarray:
        x = (first ^ (last * np.uint64(0xC2B2AE3D27D4EB4F)) ^ size.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    @cached_property
    def _masks(self) -> np.ndarray:
        return np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

    def encode(self, words: Words) -> np.ndarray:
        """The code of each word, -1 of those that no template has.  First and last eight bytes and length are the word."""
        out = np.full(words.starts.size, -1, np.int64)
        at = np.flatnonzero(words.ends - words.starts <= 16)
        if not at.size:
            return out
        padded = np.concatenate((np.zeros(8, np.uint8), words.data, np.zeros(8, np.uint8)))
        eight = np.ndarray((padded.size - 7,), "<u8", padded, 0, (1,))
        for a in range(0, at.size, 1 << 16):
            part = at[a : a + (1 << 16)]
            size = words.ends[part] - words.starts[part]
            short = np.minimum(size, 8)
            first = eight[words.starts[part] + 8] & self._masks[short]
            last = eight[words.ends[part]] >> (np.uint64(8) * (8 - short).astype(np.uint64))
            key = self._key(first, last, size)
            maybe = np.flatnonzero(self._known[(key >> np.uint64(48)).astype(np.int64)])
            code = self._order[np.minimum(np.searchsorted(self._sorted, key[maybe]), len(self.vocabulary) - 1)]
            same = (self._first[code] == first[maybe]) & (self._last[code] == last[maybe]) & (self._size[code] == size[maybe])
            out[part[maybe[same]]] = code[same]
        return out


class Scan:
    """The index with words weighed by their document frequencies."""

    def __init__(self, index: Index, frequency: dict[int, int], documents: int):
        self.index = index
        n = len(index.vocabulary)
        self.idf = np.array([math.log((documents + 1) / (frequency.get(c, 0) + 1)) + 1 for c in range(n)])
        self.rare = np.zeros(n, bool)
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.probes: list[int] = []
        for k, (t, numbers) in enumerate(zip(index.templates, index.numbers)):
            ranked = sorted(set(numbers.tolist()), key=lambda c: (-self.idf[c], c))
            chosen = ranked[: 1 if t.exact else PROBES]
            self.probes.append(len(chosen))
            for code in chosen:
                self.rare[code] = True
                self.postings[code] += [(k, int(at)) for at in np.flatnonzero(numbers == code)]
        self.weights = [self.idf[x] / self.idf[x].sum() for x in index.numbers]

    def matches(self, words: Words, codes: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(row, template, word where it starts in the row, share of the template's words in place)."""
        hits = np.flatnonzero((codes >= 0) & self.rare[np.maximum(codes, 0)])
        if not hits.size:
            return
        found = codes[hits]
        starts: dict[int, list[np.ndarray]] = defaultdict(list)
        for code in np.unique(found).tolist():
            places = hits[found == code]
            for k, at in self.postings[code]:
                # the row's first word tells rows apart where a template would begin before a row
                starts[k].append(np.stack((words.rows[places], places - words.begin[words.rows[places]] - at, np.full(places.size, code)), 1))
        for k, parts in starts.items():
            t, numbers = self.index.templates[k], self.index.numbers[k]
            candidates = np.unique(np.concatenate(parts), axis=0)
            if t.exact:
                yield from self._word_for_word(k, numbers, candidates, words, codes)
                continue
            places, meeting = np.unique(candidates[:, :2], axis=0, return_counts=True)
            for row, at in places[meeting >= min(MEET, self.probes[k])].tolist():
                share = self._verified(k, codes[words.begin[row] : words.begin[row + 1]], at)
                if share >= LEAST_SHARE:
                    yield row, k, at, share

    def _word_for_word(self, k: int, numbers: np.ndarray, candidates: np.ndarray, words: Words, codes: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """Places where all words stand, the rarest intersected first."""
        rows, at = candidates[:, 0], candidates[:, 1]
        sound = (at >= 0) & (at + numbers.size <= words.counts[rows])
        rows, at = rows[sound], at[sound]
        for j in sorted(range(numbers.size), key=lambda j: -self.idf[numbers[j]]):
            same = codes[words.begin[rows] + at + j] == numbers[j]
            rows, at = rows[same], at[same]
        for row, place in zip(rows.tolist(), at.tolist()):
            yield row, k, place, 1.0

    def _verified(self, k: int, row: np.ndarray, at: int) -> float:
        """Share of the words in place, 0 where a key phrase doesn't stand within SLACK words of its place."""
        t, numbers = self.index.templates[k], self.index.numbers[k]
        for begin, size in t.keys:
            key = numbers[begin : begin + size]
            low = max(0, at + begin - SLACK)
            window = row[low : max(low, at + begin + size + SLACK)]
            if window.size < size or not (np.lib.stride_tricks.sliding_window_view(window, size) == key).all(axis=1).any():
                return 0.0
        near = np.full(numbers.size + 2 * SLACK, -2, np.int64)
        a, b = at - SLACK, at + numbers.size + SLACK
        low, high = max(a, 0), min(b, row.size)
        near[low - a : high - a] = row[low:high]
        stands = (np.lib.stride_tricks.sliding_window_view(near, 2 * SLACK + 1) == numbers[:, None]).any(axis=1)
        return float(min(1.0, self.weights[k][stands].sum()))


# ---------------------------------------------------------------- Spark
def _encoded(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray]]:
    for batch in slices(batches):
        words = Words(batch.column("text"), _SEPARATES, _LOWER)
        yield batch, words, index.encode(words)


def frequencies(texts: DataFrame, index: Index) -> tuple[dict[int, int], int]:
    """In how many documents each word of the templates stands, and how many documents there are."""
    n = len(index.vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n + 1, np.int64)
        for batch, words, codes in _encoded(batches, index):
            known = np.flatnonzero(codes >= 0)
            pairs = np.unique(words.rows[known] * n + codes[known])
            total[:n] += np.bincount(pairs % n, minlength=n)
            total[n] += batch.num_rows
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["code", "n"])

    found = {r.code: r.n for r in texts.select("text").mapInArrow(counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()}
    return found, found.pop(n, 0)


_RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,n_words:long,share:double>>"


def scan_licenses(docs: DataFrame, *, id: str = "doc_id", text: str = "text", templates: list[Template] | None = None) -> DataFrame:
    """A row for each of ``docs``: its id, word count, places and labels of phrases, all labels, score and spans.

    n_base counts the places of phrases; first_word and last_word are their least and greatest start, null without
    one.  base_labels and labels (templates' too) are distinct, sorted and joined by commas, empty without any.
    score is the greatest share of a template's words found in place, 0 without a label.  spans lists each match:
    label, start (below 0 where a template's first words are lacking at the start), words of the template, share.
    A null text has no words; ids may be null or repeat, each row is answered by itself; further columns are not
    read.  Of words a task holds those of some half megabyte of text, or of one longer text.
    """
    index = Index(standard_templates() if templates is None else templates)
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    scan = Scan(index, *frequencies(rows, index))
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("share", pa.float64())]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, codes in _encoded(batches, index):
            found: dict[int, list[tuple[int, int, float]]] = defaultdict(list)
            for row, k, at, share in scan.matches(words, codes):
                found[row].append((at, k, share))
            columns: list[list] = [[] for _ in range(7)]
            for row in range(batch.num_rows):
                matches = sorted(found.get(row, ()))
                base = [(at, k) for at, k, _ in matches if index.templates[k].exact]
                labels = lambda ks: ",".join(sorted({index.templates[k].label for k in ks}))
                values = (
                    len(base),
                    min((at for at, _ in base), default=None),
                    max((at for at, _ in base), default=None),
                    labels(k for _, k in base),
                    labels(k for _, k, _ in matches),
                    max((share for *_, share in matches), default=0.0),
                    [{"label": index.templates[k].label, "first_word": at, "n_words": len(index.templates[k].words), "share": share} for at, k, share in matches],
                )
                for column, value in zip(columns, values):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span]
            arrays = [batch.column("id"), pa.array(words.counts, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types))]
            yield pa.RecordBatch.from_arrays(arrays, names=[id, *(f.split()[0] for f in _RESULT.split(", "))])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(scanned, f"`{id}` {kind}, {_RESULT}")


def op13_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
