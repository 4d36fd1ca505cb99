"""Licence scan: winnowed template fingerprints, then banded alignment.

Templates are few and fixed, so their inverted index (fingerprint -> template,
position) goes to every worker. A document's winnowed word trigrams that are in the
index pick candidate templates and diagonals. A match may share no trigram (changed
or inserted words), so a second index holds so many single words of each template
that none can be missing from a match; they pick candidates wherever enough of the
template's words are near. A local alignment in a band around the diagonal gives the
matched words, their share of the template, and the span.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.words import ALNUM, slabs, windows

#: Licence notices, a parameter of scan().
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "MIT": "Released under the MIT License",
    "MIT-notice": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}
#: Words in a fingerprint; of each WINDOW consecutive ones the least is kept, so a common run of GRAM + WINDOW - 1 words shares one.
GRAM, WINDOW = 3, 2
SCHEMA = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("matched_words", pa.int64()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])


def winnow(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints of a word-hash sequence."""
    g = windows(h, GRAM)
    if len(g) <= 1:
        return np.arange(len(g)), g
    at = np.unique(np.where(g[:-1] <= g[1:], np.arange(len(g) - 1), np.arange(1, len(g))))
    return at, g[at]


def align(a: np.ndarray, b: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """Best local alignment of template a with document words b near b = a + diagonal: (matched words, first, past-the-last word of b)."""
    best, end = (0, 0, 0, 0), 0
    above: dict[int, tuple[int, int, int]] = {}
    for i in range(len(a)):
        row: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + diagonal - band), min(len(b), i + diagonal + band + 1)):
            s, m, f = above.get(j - 1, (0, 0, j))
            if s <= 0:
                s, m, f = 0, 0, j
            here = (s + 2, m + 1, f) if a[i] == b[j] else (s - 1, m, f)
            for other in (above.get(j), row.get(j - 1)):
                if other is not None and other[0] - 1 > here[0]:
                    here = (other[0] - 1, other[1], other[2])
            if here[0] > 0:
                row[j] = here
                if here[0] > best[0]:
                    best, end = (*here, 0), j + 1
        above = row
    return best[1], best[2], end


class Index:
    def __init__(self, templates: dict[str, str], least: float = 0.8):
        self.names = list(templates)
        texts, self.words = pa.array([templates[n] for n in self.names], pa.string()), []
        for slab in slabs(texts, ALNUM, lower=True):
            h = slab.hashes()
            self.words += [h[x:y] for x, y in zip(slab.bounds[:-1], slab.bounds[1:])]
        entries = sorted((int(g), k, int(p)) for k, h in enumerate(self.words) for p, g in zip(*winnow(h)))
        self.hash = np.array([e[0] for e in entries], np.uint64)
        self.template, self.pos = (np.array([e[k] for e in entries], np.int64) for k in (1, 2))
        #: Words a match of each template has at least.
        self.need = [next((m for m in range(1, len(h) + 1) if m >= least * len(h)), len(h) + 1) for h in self.words]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.words]))
        self.rank = [np.searchsorted(self.vocabulary, h) for h in self.words]
        self.has = np.zeros((len(self.words), len(self.vocabulary) + 1), bool)
        for k, r in enumerate(self.rank):
            self.has[k, r] = True
        # of so many positions a match leaves out all but one at most; words of few templates, and long ones, are taken
        shared = self.has.sum(0)
        length = dict(zip(self.vocabulary.tolist(), [0] * len(self.vocabulary)))
        for slab in slabs(texts, ALNUM, lower=True):
            length |= zip(slab.hashes().tolist(), (slab.end - slab.start).tolist())
        self.anchors: list[list[int]] = []
        for h, r, need in zip(self.words, self.rank, self.need):
            order = sorted(range(len(h)), key=lambda p: (int(np.count_nonzero(h == h[p])), -length[int(h[p])], int(shared[r[p]]), p))
            self.anchors.append(sorted(order[: len(h) - need + 1]))

    def candidates(self, h: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, least position in the text, diagonal) of each cluster of hits."""
        at, g = winnow(h)
        low, high = np.searchsorted(self.hash, g, "left"), np.searchsorted(self.hash, g, "right")
        count = high - low
        if not count.any():
            return []
        entry = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        text, template = np.repeat(at, count), self.template[entry]
        diagonal = text - self.pos[entry]
        out, order = [], np.lexsort((diagonal, template))
        last: tuple[int, int] | None = None
        for k in order.tolist():
            t, d = int(template[k]), int(diagonal[k])
            if last is None or last[0] != t or d - last[1] > self.band(t):
                out.append((t, int(text[k]), d))
                last = (t, d)
        return out

    def sparse(self, h: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, template, diagonal) of every anchor word of a template with enough of its words around it; rows are bounds of h."""
        if not len(self.vocabulary):
            return []
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[at] == h)
        rank, out = at[known], []
        row = np.searchsorted(bounds, known, "right") - 1
        low, high = bounds[row], bounds[row + 1]
        for t, (ranks, need) in enumerate(zip(self.rank, self.need)):
            mine = self.has[t][rank]
            place = known[mine]
            if len(place) < need:
                continue
            lo, hi, reach = low[mine], high[mine], self.band(t) + 1
            for p in self.anchors[t]:
                hits = np.flatnonzero(rank[mine] == ranks[p])
                j = place[hits]
                first = np.maximum(lo[hits], j - p - reach)
                stop = np.minimum(hi[hits], j - p + len(ranks) + reach)
                enough = np.searchsorted(place, stop) - np.searchsorted(place, first) >= need
                for k in hits[enough].tolist():
                    out.append((int(row[mine][k]), t, int(place[k] - lo[k]) - p))
        return out

    def band(self, t: int) -> int:
        return 2 + len(self.words[t]) // 8


def _scan(index):
    def run(batches):
        ix = index.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [[] for _ in SCHEMA]
            for slab in slabs(batch.column(1), ALNUM, lower=True):
                h = slab.hashes()
                fingerprint = windows(h, GRAM)
                known = np.r_[np.isin(fingerprint, ix.hash), np.zeros(len(h) - len(fingerprint), bool)]
                near: dict[int, set[tuple[int, int]]] = {}
                for r, t, d in ix.sparse(h, slab.bounds):
                    near.setdefault(r, set()).add((t, d))
                hits = np.flatnonzero(known)
                for r in sorted({*np.unique(np.searchsorted(slab.bounds, hits, "right") - 1).tolist(), *near}):
                    a, b = int(slab.bounds[r]), int(slab.bounds[r + 1])
                    raw, found = None, []
                    for t, d in sorted({(t, d) for t, _, d in ix.candidates(h[a:b])} | near.get(r, set())):
                        band, words = ix.band(t), ix.words[t]
                        first = max(0, d - band - 1)
                        part = h[a + first : min(b, a + d + len(words) + 2 * band)]
                        m, x, y = align(words, part, d - first, band + 1)
                        if m >= ix.need[t]:
                            found.append((t, first + x, first + y, m))
                    for t, x, y, m in _apart(found):
                        raw = slab.data[slab.offsets[r] : slab.offsets[r + 1]] if raw is None else raw
                        at = [int(slab.start[a + x] - slab.offsets[r]), int(slab.end[a + y - 1] - slab.offsets[r])]
                        # bytes that don't continue a character are its code points
                        span = [int(np.count_nonzero((raw[:p] & 0xC0) != 0x80)) for p in at]
                        for col, v in zip(rows, (ids[slab.first + r], ix.names[t], m, m / len(ix.words[t]), *span)):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, SCHEMA)], schema=SCHEMA)

    return run


def _apart(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of overlapping matches of one template the one with most words, the first on ties."""
    out: list[tuple[int, int, int, int]] = []
    for t, x, y, m in sorted(found, key=lambda f: (f[0], f[1], -f[3])):
        if out and out[-1][0] == t and x < out[-1][2]:
            if m > out[-1][3]:
                out[-1] = (t, x, y, m)
        else:
            out.append((t, x, y, m))
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each match: doc_id, license, matched_words, coverage (share of the template's words), start, end (code points).

    Words are compared without case and punctuation. Matches cover at least `least` of
    a template; overlapping matches of one template are one. Null and empty texts
    have none; repeated rows repeat their matches; ids may be null. No other column is read.
    """
    index = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES if templates is None else templates, least))
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return named.mapInArrow(_scan(index), "doc_id long, license string, matched_words long, coverage double, start long, end long")
