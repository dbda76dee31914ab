"""Licence scans: a suffix automaton over the words of licence templates.

All templates go into one automaton, separated by symbols that no text has. A text is streamed through it once; the
longest match that ends at each word gives the matching statistics. Matches that can't be extended and are long enough
are chained per template, in the order of text and template with small gaps, and a template whose covered part is large
enough names its licence. The same pass finds the base phrases: a phrase ends where it is a suffix of the match.

Null is the empty text: no words, no labels, score 0. Rows stand alone: null ids, repeated rows, extra columns and empty
tables are passed through. Very long texts are streamed in whole.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from roadwatch.llm.common import id_field, map_texts, texts

#: fixed values: phrase -> label
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: fixed values: label and opening or notice of public licences
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
               "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
            "later version."),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]

#: words of a match that may enter a chain, words between two links of a chain, covered share of a template
MIN_MATCH, MAX_GAP, MIN_COVERED = 4, 8, 0.8

_FOLD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of a-z, 0-9 and whatever isn't ASCII."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


class SuffixAutomaton:
    """Automaton of all factors of several sequences. ``ends[s]`` lists (sequence, end) of the factors of state s."""

    def __init__(self, sequences: list[list]):
        self.next: list[dict] = [{}]
        self.link, self.len, self.ends = [-1], [0], [[]]
        last = 0
        for k, seq in enumerate(sequences):
            for end, symbol in enumerate([*seq, (k,)]):   # the separator occurs once
                last = self._extend(last, symbol)
                if end < len(seq):
                    self.ends[last].append((k, end))
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.ends[self.link[s]] += self.ends[s]

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.len.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.len) - 1

    def _extend(self, last: int, symbol) -> int:
        new, p = self._state(self.len[last] + 1, 0, {}), last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            if self.len[q] == self.len[p] + 1:
                self.link[new] = q
            else:
                clone = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
                self.link[q] = self.link[new] = clone
                while p >= 0 and self.next[p].get(symbol) == q:
                    self.next[p][symbol] = clone
                    p = self.link[p]
        return new

    def walk(self, seq) -> tuple[int, int]:
        s = 0
        for symbol in seq:
            s = self.next[s][symbol]
        return s, len(seq)


@dataclass
class Scan:
    """What one text holds."""

    n_words: int
    places: list[tuple[int, int, str]] = field(default_factory=list)   # (first word, last word, base label)
    spans: list[tuple[str, int, int, float]] = field(default_factory=list)   # (label, first word, last word, covered share)
    score: float = 0.0


class Scanner:
    """Templates and phrases compiled into one automaton."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]):
        self.labels = [label for label, _ in templates]
        self.sizes = [len(words(text)) for _, text in templates]
        self.phrases = [(words(p), label) for p, label in phrases.items()]
        self.auto = SuffixAutomaton([words(text) for _, text in templates] + [p for p, _ in self.phrases])
        at = {self.auto.walk(p)[0]: [] for p, _ in self.phrases}
        for p, label in self.phrases:
            at[self.auto.walk(p)[0]].append((len(p), label))
        self.suffixes: list[list[tuple[int, str]]] = []   # phrases that end a match in this state, with their lengths
        for s in range(len(self.auto.len)):
            found, p = [], s
            while p > 0:
                found += at.get(p, [])
                p = self.auto.link[p]
            self.suffixes.append(found)

    def scan(self, text: str | None) -> Scan:
        tokens = words(text)
        out, hits = Scan(len(tokens)), []
        edges, link, size, suffixes = self.auto.next, self.auto.link, self.auto.len, self.suffixes
        root = edges[0]
        state = length = 0
        for i, word in enumerate(tokens):
            go = edges[state].get(word)
            if go is None:
                if length >= MIN_MATCH:
                    hits.append((i - 1, length, state))
                if word not in root:
                    state = length = 0
                    continue
                while word not in edges[state]:
                    state = link[state]
                length = size[state] + 1
                state = edges[state][word]
            else:
                state = go
                length += 1
            for n, label in suffixes[state]:
                if n <= length:
                    out.places.append((i - n + 1, i, label))
        if length >= MIN_MATCH:
            hits.append((len(tokens) - 1, length, state))
        if hits:
            self._chain(hits, out)
        return out

    def _chain(self, hits: list[tuple[int, int, int]], out: Scan) -> None:
        """All chains that cover enough: matches in the order of the text, each as the longest continuation of an earlier one.
        Of chains of one template that share words of the text the one that covers most counts, the earlier on a tie."""
        chains: dict[int, list[tuple[int, int, int, int]]] = {}   # template -> (last text word, last template word, covered, first text word)
        ended: dict[int, dict[int, tuple[int, int]]] = {}   # template -> first text word -> (covered, last text word)
        for end, length, state in hits:
            for k, stop in self.auto.ends[state]:
                if k >= len(self.labels):
                    continue
                first, t_first = end - length + 1, stop - length + 1
                open_ = [c for c in chains.get(k, []) if first - c[0] <= MAX_GAP + 1]
                made = (end, stop, length, first)
                for d_end, t_end, covered, begin in open_:
                    overlap = max(0, d_end - first + 1, t_end - t_first + 1)
                    if overlap < length and t_first - t_end <= MAX_GAP + 1 and end > d_end and stop > t_end and covered + length - overlap > made[2]:
                        made = (end, stop, covered + length - overlap, begin)
                chains[k] = [*open_, made]
                at = ended.setdefault(k, {})
                if made[2] > at.get(made[3], (0,))[0]:
                    at[made[3]] = (made[2], end)
        for k, found in ended.items():
            out.score = max(out.score, min(1.0, max(c for c, _ in found.values()) / self.sizes[k]))
            taken: list[tuple[int, int]] = []       # disjoint, by first word
            for first, (covered, last) in sorted(found.items(), key=lambda x: (-x[1][0], x[0])):
                share = min(1.0, covered / self.sizes[k])
                if share < MIN_COVERED:
                    break
                i = bisect.bisect_left(taken, (first, last))
                if (i == 0 or taken[i - 1][1] < first) and (i == len(taken) or taken[i][0] > last):
                    taken.insert(i, (first, last))
                    out.spans.append((self.labels[k], first, last, share))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row per document: counts and places of the base phrases, labels of both kinds, best covered share, spans."""
    made = (templates or TEMPLATES, phrases or PHRASES)
    held: list[Scanner] = []

    def run(rows):
        if not held:
            held.append(Scanner(*made))
        scans = [held[0].scan(t) for t in rows["text"]]
        base = [sorted({label for *_, label in s.places}) for s in scans]
        return {
            "doc_id": rows["doc_id"], "n_words": [s.n_words for s in scans], "n_base": [len(s.places) for s in scans],
            "first_word": [min((p[0] for p in s.places), default=None) for s in scans],
            "last_word": [max((p[0] for p in s.places), default=None) for s in scans],
            "base_labels": [",".join(b) for b in base],
            "labels": [",".join(sorted({*b, *(x[0] for x in s.spans)})) for b, s in zip(base, scans)],
            "score": [s.score for s in scans],
            "spans": [[{"label": a, "first": b, "last": c, "covered": d} for a, b, c, d in sorted(s.spans)] for s in scans],
        }

    span = T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("covered", T.DoubleType())])
    fields = [T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")]
    fields += [T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))]
    return map_texts(texts(docs), run, T.StructType([id_field(docs), *fields]))
