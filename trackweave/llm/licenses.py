"""Licence scans with a generalised suffix automaton over the words of licence templates."""

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import Words, batch_words, span_hash

# Phrases that name a licence, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Wording of well-known public licences and licence notices, by label.
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License",
        "Licensed under the MIT License",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU General Public License for more details.",
        "This work is licensed under the GNU General Public License, version 3",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "This work is licensed under the GNU Lesser General Public License, version 3",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Affero General Public License, version 3",
    ],
    "bsd": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, you can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "This work is dedicated to the public domain under CC0 1.0",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0"],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"],
    "all-rights-reserved": ["All rights reserved"],
}

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_ASCII = {c: c + 32 for c in range(65, 91)}
LEAST_MATCH = 3
LARGEST_GAP = 40
LEAST_COVERAGE = 0.75

OUT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,template:int,first:long,last:long,coverage:double>>"
)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate(_ASCII))


@dataclass
class Automaton:
    """Generalised suffix automaton of word-id sequences."""

    length: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = clone
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if (q := self.step[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def add(self, number: int, sequence: list[int]) -> None:
        last = 0
        for i, c in enumerate(sequence):
            last = self._extend(last, c)
            self.ends[last].add((number, i + 1))

    def close(self) -> None:
        """Give each state the ends of all states whose strings end in its own."""
        for s in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            self.ends[self.link[s]] |= self.ends[s]
        self.ends[0] = set()

    def walk(self, state: int, length: int, c: int) -> tuple[int, int]:
        """State and length of the longest suffix that still occurs after reading ``c``."""
        while state and c not in self.step[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.step[state].get(c)
        return (0, 0) if to is None else (to, length + 1)


class Scanner:
    """Automaton, vocabulary and phrases of a set of templates; ``phrases`` and ``templates`` as the constants above."""

    def __init__(self, phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES):
        self.texts = [(label, words_of(t)) for label, group in templates.items() for t in group]
        self.phrases = [(tuple(words_of(p)), label) for p, label in phrases.items()]
        vocabulary = sorted({w for _, ws in self.texts for w in ws} | {w for ws, _ in self.phrases for w in ws})
        self.number = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.automaton = Automaton()
        sequences = [[self.number[w] for w in ws] for _, ws in self.texts] + [[self.number[w] for w in ws] for ws, _ in self.phrases]
        for i, ids in enumerate(sequences):
            self.automaton.add(i, ids)
        self.automaton.close()
        whole = {(len(self.texts) + i, len(ws)): i for i, (ws, _) in enumerate(self.phrases)}
        # phrases that end the strings of each state: its own and those of the states that its suffixes lead to
        self.closing: list[list[int]] = [[] for _ in self.automaton.ends]
        for s in sorted(range(1, len(self.closing)), key=lambda s: self.automaton.length[s]):
            link = self.automaton.link[s]
            own = [whole[e] for e in self.automaton.ends[s] if e in whole and self.automaton.length[link] < e[1] <= self.automaton.length[s]]
            self.closing[s] = sorted({*own, *self.closing[link]})
        self.places = [[e for e in ends if e[0] < len(self.texts)] for ends in self.automaton.ends]
        v = len(vocabulary) + 1
        self.follows = np.zeros(v * v, dtype=bool)
        for ids in sequences:
            for a, b in zip(ids, ids[1:], strict=False):
                self.follows[a * v + b] = True
        self.names = np.zeros(v * v, dtype=bool)
        for ws, _ in self.phrases:
            if len(ws) < 2:
                raise ValueError("a phrase has two words or more")
            self.names[self.number[ws[0]] * v + self.number[ws[1]]] = True
        data = np.frombuffer("".join(vocabulary).encode(), dtype=np.uint8)
        at = np.concatenate(([0], np.cumsum([len(w.encode()) for w in vocabulary])))
        hashes = span_hash(data, at[:-1], at[1:])
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def ids(self, words: Words) -> np.ndarray:
        """Vocabulary numbers of the words; 0: not in any template."""
        h = words.hashes()
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.order[at] + 1, 0)

    def scan(self, words: Words) -> Iterator[tuple[int, list[tuple[int, int]], list[tuple]]]:
        """For each text that has a run of words of some template: its place, the phrases (phrase, first word) and the spans.

        Only where two neighbouring words follow each other in a template can a match be longer than one word,
        so the automaton reads just these runs; elsewhere the matching statistics are 0 or 1.
        """
        ids = self.ids(words)
        v = len(self.number) + 1
        joined = self.follows[ids[:-1] * v + ids[1:]] if len(ids) else np.zeros(0, dtype=bool)
        inner = words.first[1:-1]
        joined[inner[(inner > 0) & (inner < len(ids))] - 1] = False
        hit = np.flatnonzero(joined)
        if not len(hit):
            return
        cut = np.flatnonzero(np.diff(hit) > 1) + 1
        begin, end = hit[np.concatenate(([0], cut))], hit[np.concatenate((cut - 1, [len(hit) - 1]))] + 2
        text = np.searchsorted(words.first, begin, side="right") - 1
        long = (end - begin >= LEAST_MATCH) | self.names[ids[begin] * v + ids[begin + 1]]
        begin, end, text = begin[long].tolist(), end[long].tolist(), text[long].tolist()
        i = 0
        while i < len(begin):
            j = i
            while j < len(begin) and text[j] == text[i]:
                j += 1
            base = int(words.first[text[i]])
            found, matches = [], []
            for b, e in zip(begin[i:j], end[i:j], strict=True):
                self._stream(ids[b:e].tolist(), b - base, found, matches)
            yield text[i], found, self.chain(matches)
            i = j

    def _stream(self, run: list[int], at: int, found: list, matches: list) -> None:
        """Matching statistics over one run; a match that the next word does not prolong is maximal."""
        state = length = 0
        for i, c in enumerate(run):
            before, old = state, length
            state, length = self.automaton.walk(state, length, c)
            if old >= LEAST_MATCH and length != old + 1:
                matches.append((at + i - old, old, before))
            for p in self.closing[state]:
                if (n := len(self.phrases[p][0])) <= length:
                    found.append((p, at + i - n + 1))
        if length >= LEAST_MATCH:
            matches.append((at + len(run) - length, length, state))

    def chain(self, matches: list[tuple[int, int, int]]) -> list[tuple]:
        """Spans (label, template, first word, last word, share of the template covered), of the best collinear chains of matches."""
        of: dict[int, list[tuple[int, int, int]]] = {}
        for at, length, state in sorted(matches):
            # the match, and its ends that stand elsewhere, too
            n, known = length, set()
            while n >= LEAST_MATCH:
                for t, end in self.places[state]:
                    if (t, end) not in known:
                        known.add((t, end))
                        of.setdefault(t, []).append((at + length - n, end - n, n))
                state = self.automaton.link[state]
                n = self.automaton.length[state] if state >= 0 else 0
        return sorted((s for t, own in of.items() for s in self._covers(t, sorted(own))), key=lambda s: (s[2], s[1]))

    def _covers(self, t: int, own: list[tuple[int, int, int]]) -> list[tuple]:
        """Chains of matches (place in the text, in the template, length) that go on in both, at most LARGEST_GAP words of text apart, by the most template words covered.

        The best chain up to each match is found from those of the matches within a gap and a template's length before it. Of chains that overlap in the text the best one stays.
        """
        size = len(self.texts[t][1])
        best, first, low = [], [], 0
        for i, (x, y, n) in enumerate(own):
            while own[low][0] < x - LARGEST_GAP - size:
                low += 1
            most, begin = n, x
            for j in range(low, i):
                u, v, m = own[j]
                if u < x and v < y and u + m < x + n and v + m < y + n and x - u - m <= LARGEST_GAP:
                    covered = best[j] + n - max(0, u + m - x, v + m - y)
                    if covered > most:
                        most, begin = covered, first[j]
            best.append(most)
            first.append(begin)
        spans, taken = [], []
        for i in sorted((i for i in range(len(own)) if best[i] >= LEAST_COVERAGE * size), key=lambda i: (-best[i], first[i], own[i])):
            span = (first[i], own[i][0] + own[i][2] - 1)
            at = bisect_left(taken, span)
            if (at == 0 or taken[at - 1][1] < span[0]) and (at == len(taken) or taken[at][0] > span[1]):
                taken.insert(at, span)
                spans.append((self.texts[t][0], t, *span, min(1.0, best[i] / size)))
        return spans


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """Licence phrases and covered template spans of every text, one row per row; see ``OUT`` for the columns.

    n_base counts all places of the phrases, first_word and last_word are the smallest and the largest of their
    first words (null without any). ``labels`` joins the phrases' labels with those of templates of which
    a chain of matches of at least LEAST_MATCH words covers LEAST_COVERAGE; ``score`` is the best such share, 1 if there is
    a phrase, 0 if there is neither. Null counts as empty; a text without words has counts of 0 and empty labels.
    Whole texts are read; each row is judged alone, so nothing is shuffled.
    """
    ready = scanner or Scanner()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            n_words, n_base = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            first, last, spans = [None] * n, [None] * n, [[] for _ in range(n)]
            base, labels, score = [""] * n, [""] * n, np.zeros(n)
            for words in batch_words(batch.column(1)):
                n_words[words.row : words.row + words.n_texts] = words.counts()
                for i, found, got in ready.scan(words):
                    i += words.row
                    n_base[i] = len(found)
                    names = {ready.phrases[p][1] for p, _ in found}
                    if found:
                        first[i], last[i] = min(w for _, w in found), max(w for _, w in found)
                    base[i] = ",".join(sorted(names))
                    labels[i] = ",".join(sorted(names | {s[0] for s in got}))
                    score[i] = max([1.0 * bool(found), *(s[4] for s in got)])
                    spans[i] = [dict(zip(("label", "template", "first", "last", "coverage"), s, strict=True)) for s in got]
            kind = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n_words), pa.array(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base, pa.string()), pa.array(labels, pa.string()), pa.array(score), pa.array(spans, kind)],
                names=[f.split()[0] for f in OUT.split(", ")],
            )

    return docs.select(id_col, text_col).mapInArrow(run, OUT)
