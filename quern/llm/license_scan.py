"""License scans: matching statistics from a generalised suffix automaton of licence words, chained into template spans.

The automaton holds every run of words of all templates and base phrases. A text streams through it word by word: after
each word it stands at the longest suffix that some template holds, and its state tells where. Base phrases are found
there, as one of them ends where its own state is the current one or above it by suffix links. Matches of LEAST_MATCH
words or more that cannot go on in a template are chained, in the order of both text and template, into spans; a
template whose words a chain covers to COVERED gives its label.

Most words of a text are in no template. Numpy looks words up by their first eight bytes and length, and pairs of
neighbours in a table of those that stand side by side in some template; the automaton reads the runs of such pairs
that can hold a match or phrase, by the words' bytes. A text is read in pieces, cut between words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import keep, map_texts, read_table

#: Words of a match that counts for a chain, the share of a template that a chain must cover, and words between its matches at most.
LEAST_MATCH, COVERED, MOST_GAP = 4, 0.75, 24
#: Bytes of a text whose words are looked up at once.
PIECE = 1 << 20

#: Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Notices as their licences word them.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", 'you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
)

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of words, lower-cased: digits, a to z and everything beyond ASCII.
IN_WORD = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])
#: Masks that keep the first n bytes of eight.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def words_at(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of lower-cased bytes start and end."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = IN_WORD[np.frombuffer(data, dtype=np.uint8)]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def keys_of(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for every word, made of its first eight bytes and its length; words may share one."""
    buf = np.frombuffer(data + bytes(8), dtype=np.uint8)
    head = np.zeros(len(starts), dtype=np.uint64)
    for k in range(8):
        head |= buf[starts + k].astype(np.uint64) << np.uint64(8 * k)
    size = ends - starts
    return (head & MASKS[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def split(text: str) -> list[bytes]:
    data = text.encode().translate(LOWER)
    return [data[a:b] for a, b in zip(*words_at(data), strict=True)]


class Automaton:
    """A generalised suffix automaton over the words of templates and phrases."""

    def __init__(self, templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...], least: int):
        self.labels, self.least = [x for x, _ in templates], least
        self.phrases = [x for _, x in phrases]
        told, said = [split(t) for _, t in templates], [split(t) for t, _ in phrases]
        self.vocabulary: dict[bytes, int] = {}
        self.words = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in t] for t in told]
        spoken = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in t] for t in said]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]  # (template, place of the last word) of the whole prefixes
        for t, words in enumerate(self.words):
            last = 0
            for place, w in enumerate(words):
                last = self._extend(last, w, ends)
                ends[last].append((t, place))
        for words in spoken:
            last = 0
            for w in words:
                last = self._extend(last, w, ends)
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for s in order:  # a string stands wherever a longer one that ends with it does
            if self.link[s] >= 0:
                ends[self.link[s]] += ends[s]
        #: Of every state: (template, place of the last word, words; 0: as many as are matched) of each template's longest match.
        self.found: list[list[tuple[int, int, int]]] = [[] for _ in self.length]
        #: Of every state: (phrase, words) of the phrases that its strings end with, if they are that long.
        self.said: list[list[tuple[int, int]]] = [[] for _ in self.length]
        at_phrase: dict[int, list[tuple[int, int]]] = {}
        for k, words in enumerate(spoken):
            s = 0
            for w in words:
                s = self.next[s][w]
            if words:
                at_phrase.setdefault(s, []).append((k, len(words)))
        for s in reversed(order):
            up = self.link[s]
            self.said[s] = at_phrase.get(s, []) + self.said[up]
            own = set(ends[s])
            above = [(t, e, n or self.length[up]) for t, e, n in self.found[up] if (t, e) not in own]
            if self.length[s] >= least:
                self.found[s] = [(t, e, 0) for t, e in sorted(own)] + above
        # what stands in the way of most texts: classes of words by key, and which classes stand side by side
        texts = [*told, *said]
        self.keys = np.unique(np.concatenate([self._keys(t) for t in texts if t] or [np.zeros(0, dtype=np.uint64)]))
        n = len(self.keys)
        self.pairs, self.starts, self.single = np.zeros((n + 1, n + 1), dtype=bool), np.zeros((n + 1, n + 1), dtype=bool), np.zeros(n + 1, dtype=bool)
        for t in texts:
            c = np.searchsorted(self.keys, self._keys(t))
            self.pairs[c[:-1], c[1:]] = True
        for t in said:
            c = np.searchsorted(self.keys, self._keys(t))
            if len(c) == 1:
                self.single[c[0]] = True
            elif len(c):
                self.starts[c[0], c[1]] = True

    @staticmethod
    def _keys(words: list[bytes]) -> np.ndarray:
        data = b" ".join(words)
        return keys_of(data, *words_at(data))

    def _state(self, length: int, ends: list) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        ends.append([])
        return len(self.length) - 1

    def _extend(self, last: int, w: int, ends: list) -> int:
        """The state of a text's prefix, one word on from state last. States that exist are shared by several texts."""
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q, ends)
        new = self._state(self.length[last] + 1, ends)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q, ends)
        return new

    def _split(self, p: int, w: int, q: int, ends: list) -> int:
        """A state for the strings of q that are no longer than p's and one word."""
        twin = self._state(self.length[p] + 1, ends)
        self.next[twin], self.link[twin] = dict(self.next[q]), self.link[q]
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def stream(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest match that ends with each word; a word that no template holds is -1."""
        s = n = 0
        for w in words:
            while s and w not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if w in self.next[s]:
                s, n = self.next[s][w], n + 1
            yield s, n


@lru_cache(maxsize=4)
def automaton(templates: tuple, phrases: tuple, least: int) -> Automaton:
    return Automaton(templates, phrases, least)


def pieces(data: bytes, most: int) -> Iterator[tuple[int, bytes]]:
    """A text in pieces that end between words, with where they start."""
    at = 0
    while at < len(data):
        end = min(at + most, len(data))
        while end < len(data) and IN_WORD[data[end]]:
            rest = np.flatnonzero(~IN_WORD[np.frombuffer(data, dtype=np.uint8, count=min(most, len(data) - end), offset=end)])
            end = end + int(rest[0]) if len(rest) else min(end + most, len(data))
        yield at, data[at:end]
        at = end


def runs(auto: Automaton, data: bytes) -> tuple[int, list[tuple[int, list[bytes]]]]:
    """How many words lower-cased bytes have, and the runs (place of the first word, words) that the automaton has to read."""
    total, unknown = 0, len(auto.keys)
    classes, starts, ends = [], [], []
    for at, piece in pieces(data, PIECE):
        a, b = words_at(piece)
        keys = keys_of(piece, a, b)
        c = np.searchsorted(auto.keys, keys)
        known = auto.keys[np.minimum(c, unknown - 1)] == keys if unknown else np.zeros(len(c), dtype=bool)
        held = np.flatnonzero(known)
        classes.append((held + total, c[held]))
        starts.append(a[held] + at)
        ends.append(b[held] + at)
        total += len(a)
    if not classes:
        return 0, []
    place, kind = (np.concatenate([x[i] for x in classes]) for i in range(2))
    if not len(place):
        return total, []
    first, last = np.concatenate(starts), np.concatenate(ends)
    side = (place[1:] == place[:-1] + 1) & auto.pairs[kind[:-1], kind[1:]]
    edge = np.flatnonzero(np.r_[True, ~side])
    size = np.diff(np.r_[edge, len(place)])
    asked = auto.single[kind]
    asked[:-1] |= side & auto.starts[kind[:-1], kind[1:]]
    live = (size >= auto.least) | (np.add.reduceat(asked.astype(np.int64), edge) > 0)
    return total, [(int(place[e]), [data[x:y] for x, y in zip(first[e : e + n].tolist(), last[e : e + n].tolist(), strict=True)]) for e, n in zip(edge[live].tolist(), size[live].tolist(), strict=True)]


def scan(auto: Automaton, data: bytes) -> tuple[int, list[tuple[int, int]], dict[int, list[tuple[int, int, int]]]]:
    """How many words a text has, its base phrases (place, phrase) and its matches (place, place in the template, words) by template."""
    data = data.translate(LOWER)
    total, found = runs(auto, data)
    phrases: list[tuple[int, int]] = []
    matches: dict[int, list[tuple[int, int, int]]] = {}
    for place, run in found:
        words = [auto.vocabulary.get(w, -1) for w in run]
        for i, (s, n) in enumerate(auto.stream(words)):
            for k, size in auto.said[s]:
                if n >= size:
                    phrases.append((place + i - size + 1, k))
            if n >= auto.least:
                after = words[i + 1] if i + 1 < len(words) else -2
                for t, e, size in auto.found[s]:
                    size = size or n
                    if e + 1 >= len(auto.words[t]) or auto.words[t][e + 1] != after:  # it cannot go on
                        matches.setdefault(t, []).append((place + i - size + 1, e - size + 1, size))
    return total, phrases, matches


def chains(matches: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """(first word, last word, words covered) of chains of matches, best first; no match is in two of them."""
    matches = sorted(matches)
    best, back = [m[2] for m in matches], [-1] * len(matches)
    reach = max(m[2] for m in matches) + gap
    start = 0
    for i, (t, p, n) in enumerate(matches):
        while matches[start][0] + reach < t:
            start += 1
        for j in range(start, i):
            u, q, m = matches[j]
            if u + m + gap >= t and u < t and q < p:
                more = min(n, t + n - u - m, p + n - q - m)
                if more > 0 and best[j] + more > best[i]:
                    best[i], back[i] = best[j] + more, j
    used, out = [False] * len(matches), []
    for i in sorted(range(len(matches)), key=lambda i: (-best[i], i)):
        path, at = [], i
        while at >= 0 and not used[at]:
            path.append(at)
            at = back[at]
        if path and at < 0:
            for k in path:
                used[k] = True
            out.append((matches[path[-1]][0], matches[i][0] + matches[i][2] - 1, best[i]))
    return out


def spans(auto: Automaton, matches: dict[int, list[tuple[int, int, int]]], gap: int = MOST_GAP) -> list[tuple[int, int, int, int, int]]:
    """(template, first word, last word, words covered, words of the template) of every chain of every template."""
    return [(t, a, b, n, len(auto.words[t])) for t, found in sorted(matches.items()) for a, b, n in chains(found, gap)]


def license_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES, least: int = LEAST_MATCH, covered: float = COVERED, gap: int = MOST_GAP) -> DataFrame:
    """doc_id, label, first_word, last_word, covered and of (words of the template) of every template span of every row.

    Null and empty texts, and texts without licence words, have none; spans of a template do not share a match, those
    of several templates may. Repeated rows give their spans again. Other columns are not read. No shuffle.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.int64()), ("of", pa.int64())])

    def run(ids: list[int], texts: list[bytes | None]) -> dict:
        auto = automaton(templates, (), least)
        rows = [(i, auto.labels[t], a, b, n, of) for i, text in zip(ids, texts, strict=True) for t, a, b, n, of in spans(auto, scan(auto, text or b"")[2], gap) if n >= covered * of]
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        return dict(zip(schema.names, map(list, cols), strict=True))

    return map_texts(keep(df, id_col, text_col), run, schema, "doc_id long, label string, first_word long, last_word long, covered long, of long")


def license_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES, phrases: tuple = PHRASES, least: int = LEAST_MATCH, covered: float = COVERED, gap: int = MOST_GAP) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    n_base counts the base phrases' places, which may overlap; first_word and last_word are the least and greatest of
    their starts, null where there is none. score is 1 with a base phrase, else the greatest share of a template that
    a chain covers, 0 without any; labels has the templates covered to COVERED beside the base labels. A null text
    counts as empty: no words, no labels (empty strings), score 0. Repeated rows stay; an empty table gives no rows;
    other columns are not read. No shuffle.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def run(ids: list[int], texts: list[bytes | None]) -> dict:
        auto = automaton(templates, phrases, least)
        out: dict = {n: [] for n in schema.names}
        out["doc_id"] = ids
        for text in texts:
            total, places, matches = scan(auto, text or b"")
            chained = spans(auto, matches, gap)
            base = {auto.phrases[k] for _, k in places}
            more = {auto.labels[t] for t, _, _, n, of in chained if n >= covered * of}
            score = 1.0 if places else max((min(1.0, n / of) for *_, n, of in chained), default=0.0)
            for name, v in (("n_words", total), ("n_base", len(places)), ("first_word", min((p for p, _ in places), default=None)), ("last_word", max((p for p, _ in places), default=None)), ("base_labels", ",".join(sorted(base))), ("labels", ",".join(sorted(base | more))), ("score", score)):
                out[name].append(v)
        return out

    return map_texts(keep(df, id_col, text_col), run, schema, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(read_table(spark, sf_dir, "documents"))
