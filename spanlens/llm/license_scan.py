"""Licence scans by a generalised suffix automaton (operator 11).

The automaton holds every run of words of all licence texts and phrases in as
many states as they have words, times two at most. It is built once and goes
to the tasks as sorted arrays, so its size is that of the templates alone.
Texts stream through it word by word: at each word the state and the length of
the longest run of template words that ends there (the matching statistics).
All texts of a part step together. Words that follow each other nowhere in the
templates end a match, so only stretches whose every pair of neighbours is a pair
of the templates are walked; their words are compared byte by byte, not by hash.

A phrase stands wherever a match ends in the subtree of its state and is no
shorter than it. A match of at least `long` words that the next word does not
extend is placed at all its occurrences in the templates, and such matches of one
template are chained where they go on in the text and in the template with at
most `gap` words between. A chain that covers `share` of its template's words
names the template's label. The score of a text is the largest share covered of
any template, and 1 where a phrase stands.

Documents are not shuffled, so neither copies nor hot sources gather anywhere. A
text is never cut. Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing
A-Z. Null, empty and wordless texts have no words, places, spans or labels, and
score 0. Repeated rows come out as often as they went in. Columns of the input
stay; outputs (`n_words`, `places`, `spans`, `score`) replace columns of those names.
"""

from __future__ import annotations

from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, text_or_empty, tidy_batches
from .words import Among, Words, batch_parts, raw_texts

#: Phrases that stand for a label wherever they occur.
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))

#: Notices and grants of public licences, by label.
TEMPLATES = (
    ("agpl-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

PLACES, SPANS = "array<struct<label:string,start:bigint>>", "array<struct<label:string,start:bigint,end:bigint,share:double>>"


class Automaton:
    """Runs of words of all templates. A state is a set of runs that end at the same places; `link` leads to the longest shorter run that ends elsewhere too."""

    def __init__(self, texts: Sequence[str]):
        cut = [[w.word(i) for i in range(len(w.hash))] for w in (Words([t.encode()]) for t in texts)]
        self.vocabulary = sorted({x for words in cut for x in words})
        number = {x: i for i, x in enumerate(self.vocabulary)}
        self.texts = [[number[x] for x in words] for words in cut]
        self._next: list[dict[int, int]] = [{}]
        self._length, self._link, self.end_state = [0], [-1], []
        ends: list[list[tuple[int, int]]] = [[]]
        for t, words in enumerate(self.texts):
            last = 0
            for i, x in enumerate(words):
                last = self._extend(last, x)
                ends.extend([] for _ in range(len(self._length) - len(ends)))
                ends[last].append((t, i + 1))
            self.end_state.append(last)
        self.length, self.link = np.array(self._length), np.array(self._link)
        self._number_subtrees(ends)
        self.words = max(1, len(self.vocabulary))
        edges = sorted((s * self.words + x, to) for s, d in enumerate(self._next) for x, to in d.items())
        self.edge = np.array([e[0] for e in edges], np.int64)
        self.target = np.array([e[1] for e in edges], np.int64)
        self.pairs = np.unique(np.array([a * self.words + b for words in self.texts for a, b in zip(words, words[1:], strict=False)], np.int64))
        del self._next, self._length, self._link
        self.hashes = Words(self.vocabulary or [b""]).hash
        self.among = Among(self.hashes)
        self.by_hash = np.argsort(self.hashes)

    def _add(self, length: int, edges: dict[int, int], link: int) -> int:
        self._next.append(edges)
        self._length.append(length)
        self._link.append(link)
        return len(self._length) - 1

    def _split(self, p: int, x: int, q: int) -> int:
        """The state of the longest run of p followed by x, cut off from q, whose longest run is longer."""
        copy = self._add(self._length[p] + 1, dict(self._next[q]), self._link[q])
        self._link[q] = copy
        while p >= 0 and self._next[p].get(x) == q:
            self._next[p][x] = copy
            p = self._link[p]
        return copy

    def _extend(self, last: int, x: int) -> int:
        """The state of the text so far and x."""
        q = self._next[last].get(x)
        if q is not None:  # an earlier text has this run
            return q if self._length[q] == self._length[last] + 1 else self._split(last, x, q)
        new = self._add(self._length[last] + 1, {}, 0)
        p = last
        while p >= 0 and x not in self._next[p]:
            self._next[p][x] = new
            p = self._link[p]
        if p >= 0:
            q = self._next[p][x]
            self._link[new] = q if self._length[q] == self._length[p] + 1 else self._split(p, x, q)
        return new

    def _number_subtrees(self, ends: list[list[tuple[int, int]]]) -> None:
        """A state's runs end where those of its subtree of links do: one stretch of `ends` for each state."""
        ends.extend([] for _ in range(len(self.length) - len(ends)))
        below: list[list[int]] = [[] for _ in self.length]
        for s, up in enumerate(self.link.tolist()):
            if up >= 0:
                below[up].append(s)
        self.enter, self.leave = np.zeros(len(self.length), np.int64), np.zeros(len(self.length), np.int64)
        first, last = np.zeros(len(self.length), np.int64), np.zeros(len(self.length), np.int64)
        self.ends: list[tuple[int, int]] = []
        clock, stack = 0, [(0, False)]
        while stack:
            s, done = stack.pop()
            if done:
                self.leave[s], last[s] = clock, len(self.ends)
                continue
            self.enter[s], first[s] = clock, len(self.ends)
            clock += 1
            self.ends += ends[s]
            stack += [(s, True), *((b, False) for b in below[s])]
        self.first_end, self.last_end = first, last

    def occurrences(self, state: int) -> list[tuple[int, int]]:
        """(text, words up to the end) wherever the state's runs end."""
        return self.ends[self.first_end[state] : self.last_end[state]]

    def step(self, state: np.ndarray, size: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest run that ends with `word` for each of many walks; size is the length of the run so far."""
        state, size = state.copy(), size.copy()
        todo = np.arange(len(state))
        while len(todo):
            key = state[todo] * self.words + word[todo]
            at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            hit = self.edge[at] == key
            state[todo[hit]] = self.target[at[hit]]
            size[todo[hit]] += 1
            todo = todo[~hit]
            top = state[todo] == 0
            size[todo[top]] = 0
            todo = todo[~top]
            state[todo] = self.link[state[todo]]
            size[todo] = self.length[state[todo]]
        return state, size

    def statistics(self, w: Words, single: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place, state, length, and whether the next word goes on with the run, for each word inside a stretch of template words. single: stretches of one word count too."""
        none = np.zeros(0, np.int64)
        at, member = self.among.find(w.hash)
        if not len(at):
            return none, none, none, none.astype(bool)
        number = np.full(len(w.hash) + 1, -1, np.int64)
        number[at] = self.by_hash[member]
        near = at[:-1][np.diff(at) == 1]
        key = number[near] * self.words + number[near + 1]
        if len(self.pairs):
            near = near[self.pairs[np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)] == key]
        else:
            near = near[:0]
        near = near[np.searchsorted(w.bounds, near, "right") == np.searchsorted(w.bounds, near + 1, "right")]
        goes_on = np.zeros(len(w.hash) + 1, bool)
        goes_on[near] = True
        places = at if single else np.unique(np.concatenate([near, near + 1]))
        real = np.fromiter((w.word(i) == self.vocabulary[n] for i, n in zip(places.tolist(), number[places].tolist(), strict=True)), bool, len(places))
        goes_on[places[~real]] = goes_on[places[~real] - 1] = False
        places = places[real]
        head = np.flatnonzero(~np.concatenate([[False], goes_on[places[:-1]]])) if len(places) else none
        long = np.diff(np.append(head, len(places)))
        by_long = np.argsort(-long, kind="stable")
        head, long = head[by_long], long[by_long]
        states, sizes = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        state, size = np.zeros(len(head), np.int64), np.zeros(len(head), np.int64)
        for k in range(int(long[0]) if len(long) else 0):
            n = int(np.searchsorted(-long, -k))  # walks of more than k words
            here = head[:n] + k
            state, size = self.step(state[:n], size[:n], number[places[here]])
            states[here], sizes[here] = state, size
        extended = np.append((sizes[1:] == sizes[:-1] + 1) & goes_on[places[:-1]], False) if len(places) else none.astype(bool)
        return places, states, sizes, extended


def chains(matches: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Matches (start in the text, start in the template, words) of one template to disjoint (start, end, words covered), by start.

    A match follows another that ends before it in both, or overlaps its end by words that are then counted once, with at most `gap` words between in either. Chains that cover most words come first, then those that begin first; a chain that overlaps a better one is dropped.
    """
    matches = sorted(set(matches))
    best: list[tuple[int, int, int]] = []  # words covered, start of the chain, end in the text
    done: list[tuple[int, int, int]] = []
    open_at = 0
    for k, (s, t, n) in enumerate(matches):
        while open_at < k and matches[open_at][0] + matches[open_at][2] + gap < s:
            open_at += 1
        cover, begin = n, s
        for j in range(open_at, k):
            a, b, m = matches[j]
            over = max(0, a + m - s, b + m - t)
            if b < t and over < n and s - (a + m) <= gap and t - (b + m) <= gap and best[j][0] + n - over > cover:
                cover, begin = best[j][0] + n - over, best[j][1]
        best.append((cover, begin, s + n))
    for cover, begin, end in sorted(best, key=lambda c: (-c[0], c[1], c[2])):
        k = bisect(done, (begin, end, cover))
        if (k == 0 or done[k - 1][1] <= begin) and (k == len(done) or end <= done[k][0]):
            done.insert(k, (begin, end, cover))
    return done


class Scanner:
    """Phrases and templates as one automaton, and what is asked of a text."""

    def __init__(self, phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]], long: int, gap: int, share: float):
        self.labels = [name for name, _ in (*phrases, *templates)]
        self.phrases, self.long, self.gap, self.share = len(phrases), long, gap, share
        self.automaton = Automaton([text for _, text in (*phrases, *templates)])
        self.words = [len(t) for t in self.automaton.texts]
        if not all(self.words):
            raise ValueError("a phrase or template has no words")
        self.single = min(self.words, default=2) < 2

    def scan(self, w: Words) -> list[tuple[int, list, list, float]]:
        """n_words, places, spans and score of each text."""
        a = self.automaton
        places, state, size, extended = a.statistics(w, self.single)
        text = np.searchsorted(w.bounds, places, "right") - 1
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p in range(self.phrases):
            end = a.end_state[p]
            hit = np.flatnonzero((size >= self.words[p]) & (a.enter[state] >= a.enter[end]) & (a.enter[state] < a.leave[end]))
            for t, s in zip(text[hit].tolist(), (places[hit] - w.bounds[text[hit]] - self.words[p] + 1).tolist(), strict=True):
                found[t].append((s, p))
        matches: dict[int, dict[int, list[tuple[int, int, int]]]] = defaultdict(lambda: defaultdict(list))
        for i in np.flatnonzero((size >= self.long) & ~extended).tolist():
            t, n = int(text[i]), int(size[i])
            start = int(places[i] - w.bounds[t]) - n + 1
            for template, end in a.occurrences(int(state[i])):
                if template >= self.phrases:
                    matches[t][template].append((start, end - n, n))
        out = []
        for t, n_words in enumerate(np.diff(w.bounds).tolist()):
            spans, score = [], 1.0 if t in found else 0.0
            for template, own in matches.get(t, {}).items():
                for start, end, covered in chains(own, self.gap):
                    part = min(1.0, covered / self.words[template])
                    score = max(score, part)
                    if part >= self.share:
                        spans.append((start, end, self.labels[template], part))
            out.append((n_words, [(self.labels[p], s) for s, p in sorted(found.get(t, ()))], [(name, s, e, part) for s, e, name, part in sorted(set(spans))], score))
        return out


def _task(scanner, names: list[str]):
    place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Scanner = scanner.value
        for batch in batches:
            for part in batch_parts(batch, len(names)):
                rows = s.scan(Words(raw_texts(part.column(len(names)))))
                new = [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([[dict(zip(("label", "start"), x, strict=True)) for x in r[1]] for r in rows], place),
                    pa.array([[dict(zip(("label", "start", "end", "share"), x, strict=True)) for x in r[2]] for r in rows], span),
                    pa.array([r[3] for r in rows], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *new], [*names, "__n_words", "__places", "__spans", "__score"])

    return tidy_batches(run)


def scan(docs: DataFrame, text: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, long: int = 4, gap: int = 8, share: float = 0.8) -> DataFrame:
    """All columns of `docs`, with n_words, places (of phrases, by start), spans (covered templates: label, first word, one past the last, share of the template's words) and score."""
    if long < 2:
        raise ValueError("long matches have two words or more")
    spark = docs.sparkSession
    ship(spark)
    # As large as the templates, whatever the documents.
    scanner = spark.sparkContext.broadcast(Scanner(phrases, templates, long, gap, share))
    # Input columns are renamed by position, so that none can clash with the new ones.
    names = [f"__c{i}" for i in range(len(docs.columns))]
    df = docs.toDF(*names).withColumn("__text", text_or_empty(names[docs.columns.index(text)]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "__text")
    found = df.mapInArrow(_task(scanner, names), f"{fields}, __n_words bigint, __places {PLACES}, __spans {SPANS}, __score double")
    new = ("n_words", "places", "spans", "score")
    own = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c not in new]
    return found.select(*own, *(F.col(f"__{c}").alias(c) for c in new))


def labels(*lists: str) -> Column:
    """Distinct labels of columns of places or spans, sorted and joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.transform(c, lambda x: x["label"]) for c in lists)))), ",")
