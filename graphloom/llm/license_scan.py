"""License scans: winnowed fingerprints of templates in an inverted index, then banded alignment.

Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased. Of each template the runs of SHINGLE words are
hashed and winnowed: of each WINDOW successive hashes the smallest (the last of equal ones) is a fingerprint; a run of
SHINGLE + WINDOW - 1 words that a text shares proposes it. Words that differ cut a template of n words, of which LEAST_COVERAGE match,
into runs of which one has 4 words at least if n is LONG or more, and 2 if it is 5 or more; so of templates below LONG words
all runs of SHORT_SHINGLE words are fingerprints. The index maps fingerprints to template and place; it holds templates only, so its size does not depend on the corpus, and it is sent to
every task. Every shingle of a document is looked up; a hit behind the template's last match proposes a
template at a diagonal, which alignment within BAND of it (match 1, mismatch and gap -1, free ends) confirms.

A match covers ``matched / words of the template``; from LEAST_COVERAGE on it is reported with its span in code points (from
the first to behind the last matched word). A template matched twice in a text gives two rows; of matches that overlap
by more than half, only the best is reported (the more words matched, then the earlier, then by name).

Defined cases: null, blank and license-free texts give no row; repeated rows give their rows each; an empty table gives none;
only the id and text columns are read; texts of any length are scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import LOWER, Prefix, batches_of, chunks, read, shingles, text_bytes

SHINGLE, WINDOW, BAND, LEAST_COVERAGE = 3, 2, 8, 0.8
LONG, SHORT_SHINGLE = 16, 2

#: The wording of the notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

_PART = np.zeros(256, bool)
_PART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def split(data: np.ndarray, starts: np.ndarray):
    """Begin, end and hash of each word, and the first word of each text (and the end)."""
    part = _PART[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    begin = np.flatnonzero(part & (~np.concatenate(([False], part[:-1])) | edge[:-1]))
    end = np.flatnonzero(part & (~np.concatenate((part[1:], [False])) | edge[1:])) + 1
    h = Prefix(LOWER[data]).of(begin, end) if len(begin) else np.zeros(0, np.uint64)
    return begin, end, h, np.searchsorted(begin, starts)


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest hash of each window, the last of equal ones; of a shorter list the smallest."""
    chosen = set()
    for i in range(max(1, len(h) - window + 1)):
        part = h[i : i + window]
        if len(part):
            chosen.add(i + len(part) - 1 - int(np.argmin(part[::-1])))
    return np.array(sorted(chosen), np.int64)


class Index:
    """Sorted fingerprints with the template and the place of each; a table for each number of words that is hashed together."""

    def __init__(self, templates: dict[str, str]):
        self.names, self.words = sorted(templates), []
        found: dict[int, list] = {}
        for t, name in enumerate(self.names):
            raw = np.frombuffer(templates[name].encode(), np.uint8)
            _, _, h, _ = split(raw, np.array([0, len(raw)]))
            self.words.append(h)
            k = min(SHINGLE if len(h) >= LONG else SHORT_SHINGLE, max(1, len(h)))
            runs = shingles(h, k)
            at = winnow(runs, WINDOW if len(h) >= LONG else 1) if len(runs) else np.zeros(0, np.int64)
            found.setdefault(k, []).append((runs[at], np.full(len(at), t), at))
        self.tables = {}
        for k, parts in found.items():
            columns = [np.concatenate([p[c] for p in parts]) for c in range(3)]
            order = np.argsort(columns[0], kind="stable")
            self.tables[k] = [c[order] for c in columns]

    def hits(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """For words of texts, first being the first word of each (and the end): text, place in the words, template and place in the
        template of every hit, by text and place."""
        out = []
        for k, (keys, which, place) in sorted(self.tables.items()):
            runs = shingles(h, k)
            lo, hi = np.searchsorted(keys, runs), np.searchsorted(keys, runs, "right")
            some = np.flatnonzero(hi > lo)
            many = (hi - lo)[some]
            entry = np.repeat(lo[some], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            at = np.repeat(some, many)
            doc = np.searchsorted(first, at, "right") - 1
            inside = at + k <= first[doc + 1]
            out.append((doc[inside], at[inside], which[entry][inside], place[entry][inside]))
        doc, at, which, place = (np.concatenate([o[c] for o in out]) for c in range(4)) if out else (np.zeros(0, np.int64) for _ in range(4))
        order = np.lexsort((at, doc))
        return doc[order], at[order], which[order], place[order]


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Best alignment of the template to the text within ``band`` of a diagonal (place in text minus place in template):
    matched words, first and last matched place in the text. Ends are free."""
    none = (0, 0, -1, -1)  # score, matched, first, last
    row = {}
    best = none
    for i, word in enumerate(template.tolist()):
        new = {}
        for j in range(max(0, i + diagonal - band), min(len(text), i + diagonal + band + 1)):
            s, m, a, b = row.get(j - 1, none)
            if word == int(text[j]):
                here = (s + 1, m + 1, j if a < 0 else a, j)
            else:
                here = (s - 1, m, a, b)
            for s, m, a, b in (row.get(j, none), new.get(j - 1, none)):
                if s - 1 > here[0]:
                    here = (s - 1, m, a, b)
            new[j] = here if here[0] > 0 else none
            if (new[j][1], new[j][0]) > (best[1], best[0]):
                best = new[j]
        row = new
    return best[1], best[2], best[3]


def scan_text(index: Index, h: np.ndarray, at: np.ndarray, which: np.ndarray, place: np.ndarray, least: float) -> list[tuple]:
    """(template name, matched, coverage, first word, last word) of the matches of a text with these hits."""
    found = []
    for t in np.unique(which):
        template, last, tried = index.words[t], -1, set()
        own = which == t
        for x, d in sorted(zip(at[own].tolist(), (at - place)[own].tolist(), strict=True)):
            if x <= last or d in tried:
                continue
            tried.add(d)
            m, a, b = align(template, h[last + 1 :], d - last - 1)
            if m and m / len(template) >= least:
                found.append((index.names[t], m, m / len(template), a + last + 1, b + last + 1))
                last, tried = b + last + 1, set()
    found.sort(key=lambda f: (-f[1], f[3], f[0]))
    kept: list[tuple] = []
    for f in found:
        if all(2 * (min(f[4], g[4]) - max(f[3], g[3]) + 1) <= f[4] - f[3] + 1 for g in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: f[3])


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST_COVERAGE) -> DataFrame:
    """doc_id, license, matched_words, coverage, span_start, span_end: a row for each match in docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates))
    names = ["doc_id", "license", "matched_words", "coverage", "span_start", "span_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            data, starts = text_bytes(batch.column(1))
            ids, rows = batch.column(0).to_pylist(), []
            for i, j in chunks(starts):
                part, cut = data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]
                begin, end, h, first = split(part, cut)
                doc, at, which, place = index.hits(h, first)
                edges = np.flatnonzero(np.diff(doc, prepend=-1))
                for x, i0, i1 in zip(doc[edges], edges, [*edges[1:], len(doc)], strict=False):  # without hits there is no edge
                    own, lo, hi = slice(i0, i1), first[x], first[x + 1]
                    for name, m, coverage, a, b in scan_text(index, h[lo:hi], at[own] - lo, which[own], place[own], least):
                        raw = part[cut[x] : cut[x + 1]]
                        s, e = (len(raw[: p - cut[x]].tobytes().decode("utf-8")) for p in (begin[lo + a], end[lo + b]))
                        rows.append((ids[i + x], name, m, coverage, s, e))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names)

    batches_of(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, license string, matched_words long, coverage double, span_start long, span_end long")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


QUERIES = {"op2_license_scan": op2_license_scan}
