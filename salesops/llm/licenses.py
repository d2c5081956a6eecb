"""License scans: an inverted index of anchor words and winnowed fingerprints, banded alignment.

Templates are split into words (letters and digits; case and marks do not
count). A match may leave out a fifth of a template's words (``MIN_COVERAGE``),
so of any larger part of them it holds one word at least. Such a part, the words
that the templates share least, are a template's anchors; each word of a text is
looked up among them. Of templates so long that each match must hold
``GRAM + WINDOW - 1`` words in a row, every run of ``GRAM`` words is hashed
instead, and of each ``WINDOW`` neighbouring hashes of a text the smallest is
looked up (winnowing). Either way no match is missed. Every band of diagonals
around a hit is a candidate, which an alignment within it confirms: matched
words, coverage and span. The best match is taken first, and the words outside
the spans taken are aligned again.

The index is built from the templates alone and travels with each task; texts
are scanned whole, where they are, without a shuffle.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesops.llm.common import SLICE_BYTES, hash_slice, mix64, slices, small

GRAM = 3
WINDOW = 3
BAND = 8
MIN_COVERAGE = 0.8

# Fixed values: (name, licence id, text) of the notices looked for.
TEMPLATES = [
    ("apache-2.0-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0-header",
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("mit-line", "MIT", "Released under the MIT License."),
    ("mit-line-licensed", "MIT", "This project is licensed under the MIT License."),
    (
        "mit-grant",
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("bsd-line", "BSD-3-Clause", "Distributed under the 3-Clause BSD License."),
    (
        "bsd-redistribution",
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    ("gpl-3.0-line", "GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-3.0-header",
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    ("lgpl-line", "LGPL-3.0-only", "Licensed under the GNU Lesser General Public License, version 3."),
    ("mpl-2.0-header", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0-line", "CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0-line", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-long", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("unlicense-line", "Unlicense", "This is free and unencumbered software released into the public domain."),
]

# Bytes that separate words: all ASCII but letters and digits.
APART = np.zeros(256, bool)
APART[:128] = True
APART[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False

MATCHES = "doc_id long, template string, license string, matched_words int, template_words int, coverage double, start_char long, end_char long, start_word long, end_word long"


def grams(words: np.ndarray) -> np.ndarray:
    """A hash of each run of GRAM words."""
    n = len(words) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n].copy()
    for i in range(1, GRAM):
        h = mix64(h) + words[i : n + i]
    return mix64(h)


def winnow(h: np.ndarray) -> np.ndarray:
    """Places of the smallest hash (the rightmost of equals) of every window."""
    if len(h) <= WINDOW:
        return np.array([len(h) - 1 - int(h[::-1].argmin())]) if len(h) else np.empty(0, np.int64)
    n = len(h) - WINDOW + 1
    least, place = h[:n].copy(), np.arange(n)
    for i in range(1, WINDOW):
        lower = h[i : n + i] <= least
        least = np.where(lower, h[i : n + i], least)
        place = np.where(lower, np.arange(i, n + i), place)
    return np.unique(place)


class Index:
    """Inverted index of the templates' fingerprints and of their anchor words.

    A template that leaves out at most ``spare`` words matches one at least of
    any ``spare + 1`` of its words; those that the templates share least are
    its anchors. Winnowing serves the templates long enough for every match to
    hold a run that it cannot miss.
    """

    def __init__(self, templates: list[tuple[str, str, str]], min_coverage: float = MIN_COVERAGE):
        self.names = [t[:2] for t in templates]
        hashed = [hash_slice(t[2].encode(), APART) for t in templates]
        self.words = [h for h, _, _ in hashed]
        rows = []
        for t, words in enumerate(self.words):
            h = grams(words)
            # Every gram of a template is listed: its winnowed choice may differ at its edges.
            rows += [(int(x), t, i) for i, x in enumerate(h)]
        rows.sort()
        self.keys = np.array([r[0] for r in rows], np.uint64)
        self.template = np.array([r[1] for r in rows], np.int64)
        self.place = np.array([r[2] for r in rows], np.int64)
        shared = Counter(x for words in self.words for x in words.tolist())
        self.need = [max(1, ceil(min_coverage * len(words))) for words in self.words]
        self.winnowed = np.zeros(len(templates), bool)
        rows = []
        for t, (words, start, end) in enumerate(hashed):
            spare = max(0, len(words) - self.need[t])
            # A band has room for 2 * BAND words put in, and one more for each word left out, which each end a run.
            self.winnowed[t] = -(-self.need[t] // (2 * BAND + 2 * spare + 1)) >= GRAM + WINDOW - 1
            if not self.winnowed[t]:
                order = sorted(range(len(words)), key=lambda i: (shared[int(words[i])], start[i] - end[i], i))  # noqa: B023
                rows += [(int(words[i]), t, i) for i in order[: spare + 1]]
        rows.sort()
        self.anchors, self.anchor_low, self.anchor_n = np.unique(np.array([r[0] for r in rows], np.uint64), return_index=True, return_counts=True)
        self.anchor_template = np.array([r[1] for r in rows], np.int64)
        self.anchor_place = np.array([r[2] for r in rows], np.int64)

    def candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text place, template, template place) of hits, one at least in the band of every match."""
        parts = []
        if self.winnowed.any():
            h = grams(words)
            found = self.hits(h, winnow(h))
            parts.append([x[self.winnowed[found[1]]] for x in found])
        if len(self.anchors) and len(words):
            entry = np.minimum(np.searchsorted(self.anchors, words), len(self.anchors) - 1)
            at = np.flatnonzero(self.anchors[entry] == words)
            n = self.anchor_n[entry[at]]
            text = np.repeat(at, n)
            row = np.repeat(self.anchor_low[entry[at]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            template, place = self.anchor_template[row], self.anchor_place[row]
            # All bands with a hit lie within 2 * BAND of it: most hits have too few words of the template there.
            keep = np.zeros(len(text), bool)
            for t in np.unique(template).tolist():
                own = np.flatnonzero(template == t)
                keep[own] = reach(words, self.words[t], text[own] - place[own], 2 * BAND) >= self.need[t]
            parts.append([text[keep], template[keep], place[keep]])
        return tuple(np.concatenate([p[i] for p in parts] or [np.empty(0, np.int64)]) for i in range(3))

    def hits(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text place, template, template place) of every fingerprint found."""
        low, high = np.searchsorted(self.keys, h[at]), np.searchsorted(self.keys, h[at], side="right")
        n = high - low
        text = np.repeat(at, n)
        entry = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return text, self.template[entry], self.place[entry]


def align(text: np.ndarray, template: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """Longest alignment of equal words within BAND of a diagonal.

    Returns (matched words, first, last matched place in ``text``). Cell
    (i, j) matches template word i with text word j, |j - i - diagonal| <= BAND;
    among equal counts the shorter span wins, then the first.
    """
    width = 2 * BAND + 1
    low = max(0, diagonal - BAND)
    near = text[low : max(0, len(template) + diagonal + BAND)].tolist()
    best = [(0, 0)] * width  # (matched, latest first) of row i, by j - i - diagonal + BAND
    top = (0, 0, 0)  # (matched, first - last, -first)
    for i, word in enumerate(template.tolist()):
        row = []
        cell = (0, 0)
        for d in range(width):
            j = i + diagonal + d - BAND - low
            if d + 1 < width and best[d + 1] > cell:  # skip a template word; else a text word
                cell = best[d + 1]
            if 0 <= j < len(near) and near[j] == word:
                m, first = best[d]
                here = (m + 1, first if m else j)
                cell = max(cell, here)
                top = max(top, (here[0], here[1] - j, -here[1]))
            row.append(cell)
        best = row
    m, span, first = top
    return (m, low - first, low - first - span) if m else (0, 0, 0)


def reach(words: np.ndarray, template: np.ndarray, diagonals: np.ndarray, band: int, low: int = 0, high: int | None = None) -> np.ndarray:
    """At most so many template words match ``words[low:high]`` within ``band`` of each diagonal."""
    high = len(words) if high is None else high
    at = np.arange(len(template))[:, None] + np.arange(-band, band + 1)
    out = np.zeros(len(diagonals), np.int64)
    step = max(1, (1 << 18) // at.size)
    for k in range(0, len(diagonals), step):
        j = diagonals[k : k + step, None, None] + at
        same = (words[np.clip(j, 0, len(words) - 1)] == template[:, None]) & (j >= low) & (j < high)
        out[k : k + step] = same.any(2).sum(1)
    return out


def scan_words(words: np.ndarray, index: Index, min_coverage: float) -> list[tuple[int, int, int, int]]:
    """(template, matched, first, last) of the confirmed matches in one text."""
    return confirm(words, *index.candidates(words), index, min_coverage)


def confirm(words, text, template, place, index, min_coverage) -> list[tuple[int, int, int, int]]:
    """Matches in the bands around the hits, the best first: most matched words, then better covered, shorter, earlier.

    Each further match is aligned between the spans already found, until no
    band holds one of the needed coverage.
    """
    spans: list[tuple[int, int, int, int]] = []  # (first, last, template, matched) in order

    def best(t: int, d: int) -> tuple | None:
        """The band's best match between the spans found, as a heap entry."""
        own, top = index.words[t], None
        need = min_coverage * len(own)
        low, stop = max(0, d - BAND), min(len(words), d + len(own) + BAND)
        at = max(0, bisect_left(spans, (low,)) - 1)
        while low < stop:
            while at < len(spans) and spans[at][1] < low:
                at += 1
            high = min(stop, spans[at][0]) if at < len(spans) else stop
            if high - low >= need and reach(words, own, np.array([d]), BAND, low, high)[0] >= need:
                m, first, last = align(words[low:high], own, d - low)
                if m and m >= need:
                    entry = (-m, -m / len(own), last - first, first + low, t, d, last + low)
                    top = min(top or entry, entry)
            low = spans[at][1] + 1 if at < len(spans) else stop
        return top

    # A band's entry stands at its best match while the words of that are free, before that at a bound of it.
    heap: list[tuple] = []
    for t in np.unique(template).tolist():
        own = template == t
        size = len(index.words[t])
        bands = np.unique(np.unique(text[own] - place[own])[:, None] + np.arange(-BAND, BAND + 1))
        most = reach(words, index.words[t], bands, BAND)
        heap += [(-m, -m / size, 0, 0, t, d, -1) for d, m in zip(bands.tolist(), most.tolist(), strict=True) if m >= min_coverage * size]
    heapify(heap)
    while heap:
        m, _, _, first, t, d, last = heappop(heap)
        at = bisect_left(spans, (last + 1,))
        if last >= 0 and not (at and spans[at - 1][1] >= first):
            spans.insert(at, (first, last, t, -m))
        if entry := best(t, d):
            heappush(heap, entry)
    return [(t, m, first, last) for first, last, t, m in spans]


def scan_licenses(docs: DataFrame, *, templates: list[tuple[str, str, str]] | None = None, min_coverage: float = MIN_COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each notice found (``MATCHES``), spans in characters and words.

    A notice is found if ``min_coverage`` of a template's words stand in order
    within ``BAND`` of one diagonal, whatever words stand around or between.

    ``templates``: (name, licence, text) rows; they and their index must fit a
    task's memory, as licence texts do. Templates of fewer words than ``GRAM``
    are refused.

    Defined cases: null and empty texts have no match; repeated rows report
    each their own matches; a null id is reported as null; a notice that is
    itself part of a longer matched template is reported with the longer one
    only; an empty table gives an empty result. Other columns are ignored.
    """
    index = Index(templates or TEMPLATES, min_coverage)
    if any(len(w) < GRAM for w in index.words):
        raise ValueError(f"a template needs {GRAM} words at least")

    def report(doc: int | None, data: bytes, words: np.ndarray, start: np.ndarray, end: np.ndarray, matches: list) -> Iterator[tuple]:
        for t, m, first, last in matches:
            name, licence = index.names[t]
            at = len(data[: start[first]].decode("utf-8", "replace"))
            to = at + len(data[start[first] : end[last]].decode("utf-8", "replace"))
            yield doc, name, licence, m, len(index.words[t]), m / len(index.words[t]), at, to, first, last + 1

    def group_rows(docs: list, datas: list[bytes]) -> Iterator[tuple]:
        """Short texts together: one pass of hashing, winnowing and look-up."""
        sizes = np.fromiter(map(len, datas), np.int64, len(datas)) + 1
        byte0 = np.cumsum(sizes) - sizes
        words, start, end = hash_slice(b"\n".join(datas), APART)
        word0 = np.searchsorted(start, np.append(byte0, sizes.sum()))
        # Grams and bands that reach over a text's end only add candidates; a match must lie within its text.
        text, template, place = index.candidates(words)
        owner = np.searchsorted(word0, text, side="right") - 1
        for i in np.unique(owner):
            a, b, own = word0[i], word0[i + 1], owner == i
            w = words[a:b]
            yield from report(docs[i], datas[i], w, start[a:b] - byte0[i], end[a:b] - byte0[i], confirm(w, text[own] - a, template[own], place[own], index, min_coverage))

    def long_rows(doc: int | None, data: bytes) -> Iterator[tuple]:
        parts, at = [], 0
        for piece in slices(data):
            w, s, e = hash_slice(piece, APART)
            parts.append((w, s + at, e + at))
            at += len(piece)
        words, start, end = (np.concatenate(p) for p in zip(*parts, strict=True))
        yield from report(doc, data, words, start, end, scan_words(words, index, min_coverage))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = [c.split()[0] for c in MATCHES.split(", ")]
        for b in small(batches):
            rows: list[tuple] = []
            held, ids, size = [], [], 0
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                if len(data) > SLICE_BYTES:
                    rows += long_rows(doc, data)
                    continue
                if size + len(data) > SLICE_BYTES:
                    rows += group_rows(ids, held)
                    held, ids, size = [], [], 0
                held.append(data)
                ids.append(doc)
                size += len(data) + 1
            if held:
                rows += group_rows(ids, held)
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, MATCHES)
