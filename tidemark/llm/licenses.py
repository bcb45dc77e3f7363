"""Licence notices in whole texts, found with a generalised suffix automaton of their words.

All templates and phrases share one automaton. A text is streamed through it once: at each word the state
says how long a run of words, ending there, stands in some template. Runs that cannot grow become matches
with their places in the templates; for each template, matches in the same order in both chain into a span,
which counts by the share of the template that it covers.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Fixed values of the query: phrases that count wherever they stand, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label and wording of common notices, as their publishers give them.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)

#: Small letters for A-Z; every other ASCII character but letters and digits parts words.
_PLAIN = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    text = text or b""
    return (text.encode() if isinstance(text, str) else text).translate(_PLAIN).split()


@dataclass
class State:
    length: int
    link: int = -1
    next: dict[int, int] = field(default_factory=dict)
    #: (template, place after the last word) of every occurrence in a template
    ends: list[tuple[int, int]] = field(default_factory=list)
    #: phrases that are suffixes of all runs of this state, with their lengths
    phrases: list[tuple[int, int]] = field(default_factory=list)


class Automaton:
    """Generalised suffix automaton of several lists of words: its states are the runs that occur in them."""

    def __init__(self, lists: list[list[bytes]]):
        self.vocabulary: dict[bytes, int] = {}
        self.states = [State(0)]
        self.sizes = [len(x) for x in lists]
        at_end: list[tuple[int, int, int]] = []
        for t, words in enumerate(lists):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
                at_end.append((last, t, i + 1))
        for state, t, end in at_end:
            while state > 0:
                self.states[state].ends.append((t, end))
                state = self.states[state].link

    def _extend(self, last: int, c: int) -> int:
        s = self.states
        if c in s[last].next:
            q = s[last].next[c]
            return q if s[q].length == s[last].length + 1 else self._clone(last, q, c)
        new = len(s)
        s.append(State(s[last].length + 1))
        p = last
        while p >= 0 and c not in s[p].next:
            s[p].next[c] = new
            p = s[p].link
        if p < 0:
            s[new].link = 0
        else:
            q = s[p].next[c]
            s[new].link = q if s[q].length == s[p].length + 1 else self._clone(p, q, c)
        return new

    def _clone(self, p: int, q: int, c: int) -> int:
        s, copy = self.states, len(self.states)
        s.append(State(s[p].length + 1, s[q].link, dict(s[q].next)))
        while p >= 0 and s[p].next.get(c) == q:
            s[p].next[c] = copy
            p = s[p].link
        s[q].link = copy
        return copy

    def mark_phrases(self, phrases: list[list[bytes]]) -> None:
        """Says in each state which phrases its runs end with; the phrases are among the lists."""
        for k, words in enumerate(phrases):
            state = 0
            for w in words:
                state = self.states[state].next[self.vocabulary[w]]
            self.states[state].phrases.append((k, len(words)))
        for state in sorted(range(1, len(self.states)), key=lambda i: self.states[i].length):
            own = self.states[state]
            own.phrases = self.states[own.link].phrases + own.phrases

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """place, state, length of the longest run that ends at the place and is in some list, where there is one."""
        states, get = self.states, self.vocabulary.get
        state = length = 0
        for i, w in enumerate(words):
            c = get(w)
            if c is None:
                state = length = 0
                continue
            while state and c not in states[state].next:
                state = states[state].link
                length = states[state].length
            state = states[state].next.get(c, 0)
            length = length + 1 if state else 0
            if length:
                yield i, state, length


@dataclass(frozen=True)
class Match:
    """Words start to end (exclusive) of a text equal those of a template from ``at``."""

    start: int
    end: int
    at: int


def chain(matches: list[Match], size: int) -> list[tuple[int, int, int]]:
    """Spans (start, end, covered words of the template) of matches that follow one another in text and template.

    A match continues the chain before it that covers most, and adds the words that are new in both. A
    chain reaches over twice the template's words at most, so that a match looks back over a bounded part of
    the text. Of chains that overlap in the text, that which covers more stays; a text may hold a template many times.
    """
    matches = sorted(matches, key=lambda m: (m.start, m.at))
    best: list[tuple[int, int]] = []  # covered words and where the chain begins
    for i, m in enumerate(matches):
        own = m.end - m.start
        covered, begin = own, m.start
        for k in range(i - 1, -1, -1):
            p = matches[k]
            if m.end - p.start > 2 * size:
                break
            new = min(own, m.end - p.end, m.at + own - p.at - (p.end - p.start))
            if p.start < m.start and p.at < m.at and new > 0 and m.end - best[k][1] <= 2 * size:
                covered, begin = max((covered, begin), (best[k][0] + new, best[k][1]))
        best.append((covered, begin))
    spans: list[tuple[int, int, int]] = []
    starts: list[int] = []
    for covered, begin, end in sorted(((c, b, m.end) for (c, b), m in zip(best, matches, strict=True)), key=lambda x: (-x[0], x[1], x[2])):
        at = bisect.bisect_left(starts, begin)
        if (at == len(spans) or spans[at][0] >= end) and (at == 0 or spans[at - 1][1] <= begin):
            starts.insert(at, begin)
            spans.insert(at, (begin, end, covered))
    return spans


class Scanner:
    """Finds phrases and template spans in one text at a time."""

    def __init__(self, templates=TEMPLATES, phrases: dict[str, str] | None = None, *, least: int = 4, share: float = 0.75):
        self.labels = [label for label, _ in templates]
        own = [words_of(text) for _, text in templates]
        self.phrases = list((PHRASES if phrases is None else phrases).items())
        spoken = [words_of(p) for p, _ in self.phrases]
        self.automaton = Automaton(own + spoken)
        self.automaton.mark_phrases(spoken)
        self.sizes, self.least, self.share = [len(w) for w in own], least, share

    def scan(self, text: str | bytes | None) -> tuple[int, list[tuple[int, int]], list[tuple[str, int, int, int, float]]]:
        """Number of words; (phrase, first word) of all phrases; (label, template, first word, word after, share)."""
        words, states = words_of(text), self.automaton.states
        said: list[tuple[int, int]] = []
        found: dict[int, list[Match]] = {}
        before = (-2, 0, 0)

        def close(i: int, state: int, length: int) -> None:
            for t, end in states[state].ends:
                if t < len(self.sizes) and length >= min(self.least, self.sizes[t]):
                    found.setdefault(t, []).append(Match(i + 1 - length, i + 1, end - length))

        for i, state, length in self.automaton.statistics(words):
            if before[2] and (i != before[0] + 1 or length <= before[2]):
                close(*before)
            said += [(k, i + 1 - n) for k, n in states[state].phrases if n <= length]
            before = (i, state, length)
        if before[2]:
            close(*before)
        spans = []
        for t, matches in sorted(found.items()):
            for start, end, covered in chain(matches, self.sizes[t]):
                spans.append((self.labels[t], t, start, end, min(1.0, covered / self.sizes[t])))
        return len(words), said, spans


SPAN = "struct<label:string,template:int,start:int,end:int,share:double>"
SCHEMA = f"n_words long, base array<struct<phrase:string,label:string,start:int>>, spans array<{SPAN}>"


def license_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases: dict[str, str] | None = None, least: int = 4) -> DataFrame:
    """doc_id, found: words, places of phrases and spans of templates of every whole text, each row by itself.

    Null texts and texts without words have none. Rows with repeated or null ids are rows of their own;
    other columns are ignored; an empty table gives no rows. A text is read once, with a state of one
    number; matches are as many as the text has.
    """
    scanner = Scanner(templates, phrases, least=least)

    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            n, said, spans = scanner.scan(text)
            out.append((n, [{"phrase": scanner.phrases[k][0], "label": scanner.phrases[k][1], "start": s} for k, s in said], [dict(zip(("label", "template", "start", "end", "share"), s, strict=True)) for s in spans]))
        return pd.DataFrame(out, columns=["n_words", "base", "spans"])

    return docs.select(F.col(id_col).alias("doc_id"), F.pandas_udf(run, SCHEMA)(F.col(text_col).cast("binary")).alias("found"))


def licenses(docs: DataFrame, *, share: float = 0.75, **options) -> DataFrame:
    """One row per document: words, places of the phrases, labels of phrases and of spans that cover ``share``
    of a template, and a score: 1 with a phrase, else the largest share that is covered. Odd rows as
    ``license_spans`` says."""
    found = license_spans(docs, **options)
    base, spans = F.col("found.base"), F.col("found.spans")
    words = F.transform(base, lambda b: b["start"])
    own = F.transform(base, lambda b: b["label"])
    more = F.transform(F.filter(spans, lambda s: s["share"] >= share), lambda s: s["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(words).cast("long").alias("first_word"),
        F.array_max(words).cast("long").alias("last_word"),
        joined(own).alias("base_labels"),
        joined(F.concat(own, more)).alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(spans, lambda s: s["share"])), F.lit(0.0))).alias("score"),
    )


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of all documents; odd rows as ``license_spans`` says."""
    return licenses(table(spark, sf_dir, "documents"))
