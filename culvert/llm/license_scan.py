"""License scan: matching statistics against a generalised suffix automaton of template words.

The automaton holds every run of words of all license templates and base phrases. A document's
words are streamed through it; at each word it tells the longest run that ends there and stands in
some template. Runs that can't grow are chained, template by template, when they stand in the
template's order and near each other; a chain that covers enough of its template labels a span.
Base phrases are found at the automaton states that they end in.

Most words of a corpus follow no template: only places where two neighbours stand together in a
template enter the automaton; elsewhere the statistics are below two, which nothing here uses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from culvert.llm import words as wd
from culvert.llm.exchange import bounded_batches

#: Base phrases with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Wording of public license notices, with the labels of the method.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library",
    ],
    "agpl": ["under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES",
    ],
    "unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"],
    "boost": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "may be used to endorse or promote products derived from this software without specific prior written permission.",
        "ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
}
#: Shortest run for a chain, words of the document between runs of a chain, and the share of a
#: template's words that a chain covers at least.
MIN_RUN, MAX_GAP, MIN_SHARE = 3, 12, 0.7
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOW))


class SuffixAutomaton:
    """All runs of several sequences: next (by state and symbol), link and length of the longest run
    of each state, and ends: the (sequence, place of the last symbol) of a state's runs."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for k, sequence in enumerate(sequences):
            last = 0
            for place, symbol in enumerate(sequence):
                last = self._extended(last, symbol)
                self.ends[last].append((k, place))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] += self.ends[state]
        self.ends[0] = []

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, parent: int, symbol: int) -> int:
        """The state of the parent's longest run and the symbol, made its own where it shares one."""
        target = self.next[parent][symbol]
        if self.length[target] == self.length[parent] + 1:
            return target
        copy = self._state(self.length[parent] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while parent >= 0 and self.next[parent].get(symbol) == target:
            self.next[parent][symbol] = copy
            parent = self.link[parent]
        return copy

    def _extended(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:  # another sequence has this run
            return self._split(last, symbol)
        new, at = self._state(self.length[last] + 1, 0, {}), last
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, symbol)
        return new

    def statistics(self, symbols: list[int]) -> Iterator[tuple[int, int]]:
        """(length, state) of the longest run that ends at each symbol."""
        state = length = 0
        for symbol in symbols:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.next[state]:
                state, length = self.next[state][symbol], length + 1
            yield length, state


class Scanner:
    """The automaton with its vocabulary; made in each task from the templates."""

    def __init__(self, templates: dict[str, list[str]], base: dict[str, str]) -> None:
        self.sequences, self.labels = [], []
        for label, text in [*((label, t) for label, texts in templates.items() for t in texts), *((label, p) for p, label in base.items())]:
            self.sequences.append(_words(text))
            self.labels.append(label)
        self.vocabulary = sorted({w for s in self.sequences for w in s})
        ids = {w: k for k, w in enumerate(self.vocabulary)}
        coded = [[ids[w] for w in s] for s in self.sequences]
        self.automaton = SuffixAutomaton(coded)
        self.first_base = len(coded) - len(base)
        self.sizes = [len(s) for s in coded]
        # A phrase ends at a state if the state's runs do and are long enough.
        self.phrases: dict[int, list[int]] = {}
        for k in range(self.first_base, len(coded)):
            states = [s for _, s in self.automaton.statistics(coded[k])]
            self.phrases.setdefault(states[-1], []).append(k)
        raw = [w.encode() for w in self.vocabulary]
        at = np.concatenate([[0], np.cumsum([len(w) for w in raw])]).astype(np.int64)
        codes = wd.word_codes(np.frombuffer(b"".join(raw), np.uint8), at[:-1], at[1:])
        self.order = np.argsort(codes)
        self.codes = codes[self.order]
        n = len(self.vocabulary)
        self.pairs = np.zeros((n + 1, n + 1), bool)  # the last row and column: other words
        for s in coded:
            self.pairs[s[:-1], s[1:]] = True
        self.base_pairs = np.zeros_like(self.pairs)
        for s in coded[self.first_base :]:
            self.base_pairs[s[:-1], s[1:]] = True

    def known(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.order[at], len(self.vocabulary))

    def run(self, symbols: list[int], start: int, found: list, matches: list) -> None:
        """Adds the phrases (place, label) and the runs (last word, length, state) of some words."""
        before = (0, 0)
        for k, (length, state) in enumerate([*self.automaton.statistics(symbols), (0, 0)]):
            if before[0] >= MIN_RUN and length <= before[0]:
                matches.append((start + k - 1, *before))
            at = state
            while at:
                for p in self.phrases.get(at, ()):
                    if self.sizes[p] <= length:
                        found.append((start + k - self.sizes[p] + 1, self.labels[p]))
                at = self.automaton.link[at]
            before = (length, state)

    def spans(self, matches: list) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, covered share) of the best chains of each template."""
        by_template: dict[int, list] = {}
        for end, length, state in matches:
            for k, place in self.automaton.ends[state]:
                if k < self.first_base:
                    by_template.setdefault(k, []).append((end - length + 1, end, place - length + 1, place))
        out = []
        for k, runs in by_template.items():
            chains: list[tuple[int, int]] = []  # words covered and the first word, by run
            for i, (a, b, p, q) in enumerate(runs):
                best = (q - p + 1, a)
                for j in range(i - 1, -1, -1):  # runs come in order of their last words
                    _, b2, _, q2 = runs[j]
                    if a - b2 > MAX_GAP:
                        break
                    over = max(0, b2 + 1 - a, q2 + 1 - p)
                    if over < q - p + 1 and q > q2 and b > b2:
                        best = max(best, (chains[j][0] + q - p + 1 - over, chains[j][1]), key=lambda c: (c[0], c[1]))
                chains.append(best)
            last = -1
            for i in sorted(range(len(runs)), key=lambda i: (-chains[i][0], runs[i][1])):
                if chains[i][0] < MIN_SHARE * self.sizes[k]:
                    break
                out.append((self.labels[k], chains[i][1], runs[i][1], chains[i][0] / self.sizes[k]))
                last = i
            if last < 0:
                i = max(range(len(runs)), key=lambda i: chains[i][0])
                out.append(("", chains[i][1], runs[i][1], chains[i][0] / self.sizes[k]))
        return out


def _apart(spans: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Of overlapping spans of one label, the one that covers most of its template."""
    kept: list[tuple[str, int, int, float]] = []
    ends: dict[str, list[tuple[int, int]]] = {}
    for span in sorted(spans, key=lambda s: (-s[3], s[1], s[2], s[0])):
        label, a, b, _ = span
        if label and not any(a <= d and c <= b for c, d in ends.get(label, ())):
            kept.append(span)
            ends.setdefault(label, []).append((a, b))
    return sorted(kept, key=lambda s: (s[1], s[2], s[0]))


_SPANS = "array<struct<label:string,first_word:bigint,last_word:bigint,share:double>>"
_RESULT = f"doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans {_SPANS}"
_SPAN_TYPE = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("share", pa.float64())]))


def _scan(templates: dict[str, list[str]], base: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, base)
        other = len(scanner.vocabulary)
        for batch in batches:
            buf, at = wd.text_buffer(batch.column("text"))
            buf = wd.lowered(buf)
            starts, ends, bounds = wd.find_words(buf, at, wd.ALNUM)
            symbols = scanner.known(wd.word_codes(buf, starts, ends))
            joined = scanner.pairs[symbols[:-1], symbols[1:]] if len(symbols) else np.zeros(0, bool)
            joined[bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(symbols))] - 1] = False
            # Runs of joined neighbours: from word a to word b. Two words alone matter only in a base phrase.
            edge = np.diff(np.concatenate([[0], joined.astype(np.int8), [0]]))
            a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            useful = (b - a > 1) | scanner.base_pairs[symbols[a], symbols[np.minimum(a + 1, len(symbols) - 1)]] if len(a) else np.zeros(0, bool)
            a, b = a[useful], b[useful]
            assert not len(a) or symbols[a].max() < other
            row = np.searchsorted(bounds, a, side="right") - 1
            found: dict[int, list] = {}
            matches: dict[int, list] = {}
            for i, j, r in zip(a.tolist(), b.tolist(), row.tolist(), strict=True):
                scanner.run(symbols[i : j + 1].tolist(), i - int(bounds[r]), found.setdefault(r, []), matches.setdefault(r, []))
            rows = []
            for r, (doc, n) in enumerate(zip(batch.column("doc_id").to_pylist(), np.diff(bounds).tolist(), strict=True)):
                places = [p for p, _ in found.get(r, ())]
                own = {label for _, label in found.get(r, ())}
                spans = scanner.spans(matches[r]) if matches.get(r) else []
                kept = _apart(spans)
                score = 1.0 if own else max((s[3] for s in spans), default=0.0)
                labels = own | {s[0] for s in kept}
                rows.append((doc, n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(sorted(labels)), min(1.0, score), [dict(zip(("label", "first_word", "last_word", "share"), s, strict=True)) for s in kept]))
            kinds = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.float64(), _SPAN_TYPE]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return run


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """Licenses named or quoted in documents (doc_id, text); one row for each row of docs.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z become a-z. n_base counts the places of
    base phrases; first_word and last_word are their smallest and largest start (null without any).
    base_labels and labels (with those of the spans) are distinct, sorted and comma-joined, empty
    without any. spans holds the chains that cover enough of a template, of one label apart. score
    is 1 with a base phrase, else the largest covered share of a template.

    A null text counts as empty: no words, score 0. A text of any length is one row, scanned whole. Repeated rows are scanned each; a null doc_id
    stays null; an empty table gives an empty table; other columns of docs are ignored.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return docs.mapInArrow(_scan(TEMPLATES if templates is None else templates, BASE if base is None else base), _RESULT)
