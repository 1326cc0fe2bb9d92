"""Licence scans with a generalised suffix automaton over licence tokens.

Each file's words are walked through the automaton; the matching statistics (the longest suffix that is in
some template, after each word) give maximal matches, and long ones are chained, template by template, into
the spans that the template covers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import read_table
from ._text import NON_WORD, chunks, fingerprint, words

# Phrases and the labels of places where they stand.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Opening words of public licence texts and notices, with their labels.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "This work is licensed under CC BY 4.0"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]

#: Words of a match that is chained, of a gap that a chain may bridge, and of a span that gives a label, at least, at most and at least.
MIN_MATCH, MAX_GAP, MIN_SPAN = 4, 6, 8
#: Share of a template's words that a span must cover to give its label.
MIN_COVER = 0.2


class SuffixAutomaton:
    """States of all substrings of several token lists; ``ends`` has, by state, (template, last token) of one occurrence per template."""

    def __init__(self, lists: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]
        for which, tokens in enumerate(lists):
            last = 0
            for at, token in enumerate(tokens):
                last = self._extend(last, token)
                self.ends[last].setdefault(which, at)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            for which, at in self.ends[state].items():
                up = self.ends[self.link[state]]
                up[which] = min(up.get(which, at), at)

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append({})
        return len(self.length) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        clone = self._new(self.length[p] + 1)
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        self.link[q] = clone
        while p != -1 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int) -> int:
        q = self.next[last].get(token)
        if q is not None:  # the substring is known from another list
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, token)
        state, p = self._new(self.length[last] + 1), last
        while p != -1 and token not in self.next[p]:
            self.next[p][token] = state
            p = self.link[p]
        if p != -1:
            q = self.next[p][token]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
        return state

    def statistics(self, tokens: list[int]) -> tuple[list[int], list[int]]:
        """After each token, the length of the longest suffix that is in some list, and its state."""
        state = size = 0
        sizes, states = [], []
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if token in self.next[state]:
                state = self.next[state][token]
                size += 1
            sizes.append(size)
            states.append(state)
        return sizes, states


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], phrases: list[tuple[str, str]], min_match: int, max_gap: int, min_span: int, min_cover: float):
        self.limits = min_match, max_gap, min_span, min_cover
        split = lambda text: [text_bytes(found, i) for found in [words(pa.array([text]), NON_WORD)] for i in range(len(found.starts))]
        self.labels = [label for label, _ in templates]
        lists = [split(text) for _, text in templates]
        self.phrases = [(split(text), label) for text, label in phrases]
        known = sorted({w for x in [*lists, *(p for p, _ in self.phrases)] for w in x}, key=fingerprint)
        self.hashes = np.array([fingerprint(w) for w in known], dtype=np.uint64)
        ids = {w: i for i, w in enumerate(known)}
        self.lists = [[ids[w] for w in x] for x in lists]
        self.phrase_ids = [([ids[w] for w in p], label) for p, label in self.phrases]
        self.automaton = SuffixAutomaton([*self.lists, *(p for p, _ in self.phrase_ids)])

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        """Template token ids; -1 for words of no template."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def places(self, tokens: np.ndarray, owner: np.ndarray) -> list[tuple[str, np.ndarray]]:
        """(label, first words) of the phrases."""
        out = []
        for ids, label in self.phrase_ids:
            n = len(tokens) - len(ids) + 1
            if n <= 0:
                out.append((label, np.zeros(0, dtype=np.int64)))
                continue
            ok = owner[:n] == owner[len(ids) - 1 :]
            for k, t in enumerate(ids):
                ok &= tokens[k : k + n] == t
            out.append((label, np.flatnonzero(ok)))
        return out

    def matches(self, tokens: list[int], first: int) -> list[tuple[int, int, int, int]]:
        """(template, start, end, end in the template) of the maximal matches in a run of template words that begins at word ``first``."""
        min_match = self.limits[0]
        sizes, states = self.automaton.statistics(tokens)
        out = []
        for i, size in enumerate(sizes):
            # a maximal match: it is not continued by the next word
            if size >= min_match and (i + 1 == len(sizes) or sizes[i + 1] != size + 1):
                for which, end in self.automaton.ends[states[i]].items():
                    if which < len(self.lists):
                        out.append((which, first + i - size + 1, first + i + 1, end + 1))
        return out


def text_bytes(found, i: int) -> str:
    return found.data[found.starts[i] : found.ends[i]].tobytes().decode("utf-8", "replace")


def chain(matches: list[tuple[int, int, int, int]], sizes: list[int], max_gap: int, min_span: int, min_cover: float) -> list[tuple[int, int, int, float]]:
    """(template, start, end, cover): matches (template, start, end, end in template) in order, where both gaps are small."""
    out = []
    for which in sorted({m[0] for m in matches}):
        now = None
        for _, start, end, to in [*sorted(m for m in matches if m[0] == which), (which, 1 << 62, 1 << 62, 0)]:
            frm = to - (end - start)
            if now and start - now[1] <= max_gap and start < (1 << 61) and -max_gap <= frm - now[3] <= max_gap:
                now[4] += max(0, end - max(start, now[1]))
                now[1], now[3] = max(now[1], end), max(now[3], to)
                continue
            if now and now[4] >= min(min_span, sizes[which]) and now[4] >= min_cover * sizes[which]:
                out.append((which, now[0], now[1], min(1.0, now[4] / sizes[which])))
            now = [start, end, frm, to, end - start]
    return out


_scanners: dict[tuple, Scanner] = {}

RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,cover:double>>"


def scan(config: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanners.get(config) or _scanners.setdefault(config, Scanner(*config))
        min_match, max_gap, min_span, min_cover = scanner.limits
        sizes = [len(x) for x in scanner.lists]
        for batch in batches:
            for part in chunks(batch, "text"):
                found = words(part.column(1), NON_WORD)
                owner, n = found.text_of(), len(found.bounds) - 1
                tokens = scanner.tokens(found.hashes())
                base: list[dict] = [{} for _ in range(n)]
                for label, at in scanner.places(tokens, owner):
                    for i in at.tolist():
                        base[owner[i]].setdefault(label, []).append(i - int(found.bounds[owner[i]]))
                matches: list[list] = [[] for _ in range(n)]
                # runs of template words within a text; what is shorter than a match is not walked
                edge = np.ones(len(tokens) + 1, dtype=bool)
                edge[1:-1] = (owner[1:] != owner[:-1]) | ((tokens[1:] < 0) != (tokens[:-1] < 0))
                cuts = np.flatnonzero(edge) if len(tokens) else np.zeros(1, dtype=np.int64)
                runs = [(int(i), int(j)) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j - i >= min_match and tokens[i] >= 0]
                for i, j in runs:
                    matches[owner[i]] += scanner.matches(tokens[i:j].tolist(), i - int(found.bounds[owner[i]]))
                rows = []
                for k in range(n):
                    places = sorted(x for at in base[k].values() for x in at)
                    spans = chain(matches[k], sizes, max_gap, min_span, min_cover) if matches[k] else []
                    labels = sorted({*base[k], *(scanner.labels[w] for w, *_ in spans)})
                    score = max([0.5 if places else 0.0, *(0.5 + c / 2 for *_, c in spans)])
                    rows.append((len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(base[k])), ",".join(labels), score, [{"label": scanner.labels[w], "start": a, "end": b, "cover": c} for w, a, b, c in spans]))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
                span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span]
                arrays = [part.column(0), pa.array(np.diff(found.bounds).astype(np.int64))] + [pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return run


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, phrases: list[tuple[str, str]] | None = None, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_span: int = MIN_SPAN, min_cover: float = MIN_COVER) -> DataFrame:
    """One row per document: its words, the base phrases' places, labels, score and covered template spans.

    Words are runs of ASCII letters and digits and non-ASCII characters, A-Z in lower case. ``n_base`` counts all
    places of the phrases, ``first_word`` and ``last_word`` are the smallest and largest start (null without one).
    ``labels`` adds to the phrases' labels those of templates of which a chain of matches covers enough. ``score`` is 0 without
    either, 0.5 for phrases alone, and up to 1 with the covered share of a template. Null and empty texts have no words;
    repeated rows are scanned each, further columns are not read, no rows give no rows.
    """
    config = (tuple(templates or TEMPLATES), tuple(phrases or PHRASES), min_match, max_gap, min_span, min_cover)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan(config), RESULT)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents"))


#: The base columns; the method's own labels and score have no SQL. For fixtures.
BASE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, CAST(len(w) + 1 AS BIGINT))) AS i FROM d),
b AS (
  SELECT doc_id, i - 1 AS spot, CASE
    WHEN w[i] = 'gnu' AND w[i+1] = 'general' AND w[i+2] = 'public' AND w[i+3] = 'license' THEN 'gpl'
    WHEN w[i] = 'apache' AND w[i+1] = 'license' THEN 'apache'
    WHEN w[i] = 'cc' AND w[i+1] = 'by' THEN 'cc-by'
    WHEN w[i] = 'mit' AND w[i+1] = 'license' THEN 'mit' END AS label FROM p)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, count(label) AS n_base, min(spot) FILTER (label IS NOT NULL) AS first_word,
       max(spot) FILTER (label IS NOT NULL) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM d LEFT JOIN b ON b.doc_id = d.doc_id AND b.label IS NOT NULL GROUP BY d.doc_id, d.w
"""
