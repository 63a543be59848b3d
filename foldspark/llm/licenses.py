"""License scans: winnowed fingerprints of templates in an inverted index pick candidates, banded alignment measures them.

Templates are the whole texts of public licenses (the folder license_texts) and short lines by which a license is granted or
named. Words are runs of letters and digits, A-Z lower-cased, so that markup and line breaks don't matter. Every window of
GUARANTEE words of a template that a text holds unchanged shares a winnowed fingerprint with it. Hits on one template that lie
near one diagonal, and are at least a share of HITS of the template's fingerprints, make a candidate; an alignment in a band
around these diagonals gives the matched share of the template's words (coverage) and the span in the text.

Cases: a null or empty text has no matches; repeated rows are scanned each by itself; an empty table gives no rows; further
columns are ignored. Texts are scanned whole. Where several templates match at one place, the one with the most matched less
unmatched words stays (ties: the first in the list), so that a license isn't taken for another that holds its clauses and more.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm import text as X
from foldspark.llm.asks import slices

GRAM = 3
GUARANTEE = 5
BAND = 8
COVERAGE = 0.75
#: Share of a template's fingerprints that a candidate needs.
HITS = 0.2

#: Lines by which public licenses are granted or named.
LINES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)



def templates() -> list[tuple[str, str]]:
    """(license, text): whole texts, by name, then lines."""
    files = sorted((f.name, f) for f in resources.files("foldspark.llm").joinpath("license_texts").iterdir() if f.name.endswith(".txt"))
    return [(name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for name, f in files] + list(LINES)


SEPARATORS = X.byte_table([b for b in range(128) if not chr(b).isalnum()])


def tokens(raw: np.ndarray, offsets: np.ndarray):
    return X.words(raw, offsets, lower=True, spans=True, space=SEPARATORS)


def winnow(h: np.ndarray, width: int = GUARANTEE - GRAM + 1) -> np.ndarray:
    """Places of the fingerprints: the last least hash of each `width` consecutive ones."""
    if len(h) <= width:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))]) if len(h) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, width)[:, ::-1]
    return np.unique(np.arange(len(view)) + width - 1 - np.argmin(view, axis=1))


class Index:
    """Templates' words and the inverted index of their fingerprints: hash, template, place, sorted by hash."""

    def __init__(self, of: list[tuple[str, str]] | None = None):
        of = of or templates()
        self.names = [n for n, _ in of]
        self.words = []
        rows = []
        for k, (_, text) in enumerate(of):
            h = tokens(*X.arrow_bytes(pa.array([text])))[0]
            self.words.append(h)
            grams = X.windows(h, GRAM)
            rows += [(grams[p], k, p) for p in winnow(grams)]
        rows.sort()
        self.hash = np.array([r[0] for r in rows], X.U64)
        self.template = np.array([r[1] for r in rows], np.int64)
        self.place = np.array([r[2] for r in rows], np.int64)
        self.size = np.bincount(self.template, minlength=len(self.names))

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in grams, template, place in the template), every pair of equal hashes."""
        lo, hi = np.searchsorted(self.hash, grams), np.searchsorted(self.hash, grams, "right")
        some = np.flatnonzero(hi > lo)
        n = hi[some] - lo[some]
        at = np.repeat(some, n)
        entry = np.repeat(lo[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return at, self.template[entry], self.place[entry]


def align(template: np.ndarray, words: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Most words of the template matched in order within a band around word = template + shift, first and last word matched.

    A longest common subsequence over cells with |word - template - shift| <= band. Of equal ones, the shortest span.
    """
    n, m, width = len(template), len(words), 2 * band + 1
    zero = (0, 0, -1, -1)  # matched, -span, first, last
    above = [zero] * (width + 1)
    for i in range(n):
        row = [zero] * (width + 1)
        for c in range(width):
            j = i + shift - band + c
            best = above[c + 1]  # the template's word goes unmatched
            if c and row[c - 1] > best:
                best = row[c - 1]
            if 0 <= j < m and words[j] == template[i]:
                k, _, first, _ = above[c]
                first = j if first < 0 else first
                best = max(best, (k + 1, first - j, first, j))
            row[c] = best
        above = row
    k, _, first, last = max(above[:width])
    return k, first, last


def matches(h: np.ndarray, index: Index, least: float = COVERAGE, band: int = BAND) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first word, last word) in one text's words."""
    at, template, place = index.hits(X.windows(h, GRAM))
    found = []
    for t in np.unique(template):
        words = index.words[t]
        width = min(band, max(1, len(words) // 4))  # narrower for short templates, which may follow one another
        mine = np.flatnonzero(template == t)
        shifts = at[mine] - place[mine]
        order = np.argsort(shifts, kind="stable")
        shift, places = shifts[order], place[mine][order]
        cut = np.flatnonzero(np.diff(shift, prepend=shift[0] - width - 1) > width)
        for a, b in zip(cut, [*cut[1:], len(shift)], strict=True):
            if len(np.unique(places[a:b])) < HITS * index.size[t]:
                continue
            mid, wide = int(shift[a] + shift[b - 1]) // 2, width + int(shift[b - 1] - shift[a] + 1) // 2
            lo = max(0, mid - wide)
            k, first, last = align(words, h[lo : mid + len(words) + wide], mid - lo, wide)
            if k >= least * len(words):
                found.append((int(t), k, first + lo, last + lo))
    found.sort(key=lambda x: (len(index.words[x[0]]) - 2 * x[1], x[0], x[2]))
    kept: list[tuple[int, int, int, int]] = []
    for f in found:
        if all(f[2] > g[3] or f[3] < g[2] for g in kept):
            kept.append(f)
    return sorted(kept, key=lambda x: x[2])


_OUT = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for b in slices(batch):
                raw, offsets = X.arrow_bytes(b.column(1))
                h, d, s, e = tokens(raw, offsets)
                grams = X.windows(h, GRAM)
                some = np.unique(d[np.flatnonzero(np.isin(grams, index.hash))]) if len(grams) else []
                at = np.searchsorted(d, np.arange(len(b) + 1))
                out: list = [[] for _ in range(len(b))]
                for i in some:
                    lo, hi = at[i], at[i + 1]
                    if not (found := matches(h[lo:hi], index)):
                        continue
                    points = np.append(0, np.cumsum((raw[offsets[i] : offsets[i + 1]] & 0xC0) != 0x80))  # code points before each byte
                    for t, k, first, last in found:
                        start, end = points[s[lo + first] - offsets[i]], points[e[lo + last] - offsets[i]]
                        out[i].append({"license": index.names[t], "coverage": k / len(index.words[t]), "start": int(start), "end": int(end)})
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, _OUT)], ["doc_id", "matches"])

    return run


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and matches: array of (license, coverage, start, end) with code points, ends exclusive. One pass, no shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(Index())  # a megabyte, whatever the documents are
    return docs.select("doc_id", "text").mapInArrow(_scan(shared), f"doc_id {kind}, matches array<struct<license:string,coverage:double,start:int,end:int>>")


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_matches and the matches written out as license:coverage:start:end."""
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(F.transform("matches", lambda m: F.concat_ws(
        ":", m["license"], F.format_string("%.4f", m["coverage"]), m["start"], m["end"])), ",").alias("matches"))
