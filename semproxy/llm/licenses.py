"""License scans: texts stream through a generalised suffix automaton of license words.

The automaton holds every substring of all templates. Feeding it a text word by word yields the
matching statistics: at each word, the longest template substring that ends there. Full matches of
a short phrase are its places; long matches are chained, in template and text order with bounded
gaps, into spans that cover a share of a longer template.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semproxy.llm.common import index_words, text_bytes

# Fixed phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices of common licenses as their publishers word them, by label.
NOTICES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this
        software and associated documentation files (the "Software"), to deal in the Software
        without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
        to whom the Software is furnished to do so, subject to the following conditions""",
    "apache": """you may not use this file except in compliance with the License. You may obtain a
        copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
        express or implied.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the
        terms of the GNU General Public License as published by the Free Software Foundation,
        either version 3 of the License, or (at your option) any later version.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are
        permitted provided that the following conditions are met: Redistributions of source code
        must retain the above copyright notice, this list of conditions and the following
        disclaimer.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with
        or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies.""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
        If a copy of the MPL was not distributed with this file, You can obtain one at
        http://mozilla.org/MPL/2.0/.""",
    "cc-by": """This work is licensed under the Creative Commons Attribution 4.0 International
        License. To view a copy of this license, visit
        http://creativecommons.org/licenses/by/4.0/""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone
        is free to copy, modify, publish, use, compile, sell, or distribute this software, either
        in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means.""",
}


@dataclass(frozen=True)
class Chaining:
    """Shortest match, widest gap (both in words) and least covered share of a reported span."""

    least_match: int = 6
    widest_gap: int = 40
    least_covered: float = 0.6


@dataclass
class Automaton:
    """Generalised suffix automaton; state 0 holds the empty word sequence."""

    words: dict[bytes, int] = field(default_factory=dict)
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[set] = field(default_factory=lambda: [set()])
    sizes: list[int] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    phrases: list[tuple] = field(default_factory=list)

    def _clone(self, state: int, length: int) -> int:
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _redirect(self, state: int, word: int, old: int, new: int) -> None:
        while state >= 0 and self.next[state].get(word) == old:
            self.next[state][word] = new
            state = self.link[state]

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            clone = self._clone(known, self.length[last] + 1)
            self.link[known] = clone
            self._redirect(last, word, known, clone)
            return clone
        state = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        self.ends.append(set())
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        if last >= 0:
            known = self.next[last][word]
            if self.length[known] == self.length[last] + 1:
                self.link[state] = known
            else:
                clone = self._clone(known, self.length[last] + 1)
                self.link[state] = self.link[known] = clone
                self._redirect(last, word, known, clone)
        return state

    def add(self, text: str, label: str) -> None:
        state, number = 0, len(self.sizes)
        words = index_words(text.encode())
        for position, word in enumerate(words):
            state = self._extend(state, self.words.setdefault(word, len(self.words)))
            self.ends[state].add((number, position + 1))
        self.sizes.append(len(words))
        self.labels.append(label)

    def finish(self, phrases: int) -> None:
        """Hand end positions up the suffix links; the first ``phrases`` templates are phrases."""
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]] |= self.ends[state]
        whole: list[tuple] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=lambda s: self.length[s]):
            own = [
                (t, self.sizes[t])
                for t, end in self.ends[state]
                if t < phrases and end == self.sizes[t] == self.length[state]
            ]
            whole[state] = (*whole[self.link[state]], *own)
        self.phrases = whole

    def run(self, words: list[int], first: int, least: int) -> tuple[list, list]:
        """Phrase places ``(template, start)`` and maximal matches ``(start, length, state)`` of a
        run of known words that begins at word ``first`` of the text."""
        places, matches = [], []
        state = length = 0
        for position, word in enumerate(words, first):
            following = self.next[state].get(word)
            if following is None and length >= least:
                matches.append((position - length, length, state))
            while following is None and state:
                state = self.link[state]
                length = self.length[state]
                following = self.next[state].get(word)
            state, length = (0, 0) if following is None else (following, length + 1)
            for template, size in self.phrases[state]:
                if length >= size:
                    places.append((template, position - size + 1))
        if length >= least:
            matches.append((first + len(words) - length, length, state))
        return places, matches


def build_automaton() -> Automaton:
    automaton = Automaton()
    for text, label in [*PHRASES.items(), *((text, label) for label, text in NOTICES.items())]:
        automaton.add(text, label)
    automaton.finish(len(PHRASES))
    return automaton


def chain(automaton: Automaton, matches: list, rules: Chaining) -> list[tuple]:
    """``(template, first word, end word, share)`` of the best chain around each covered region.

    A match extends the best earlier one that ends before it in text and template; only matches
    within the widest gap are looked at, so the cost follows the matches."""
    by_template: dict[int, list] = {}
    for start, length, state in matches:
        for template, end in automaton.ends[state]:
            by_template.setdefault(template, []).append((start, start + length, end - length, end))
    spans = []
    for template, found in by_template.items():
        found.sort()
        best: list[tuple[int, int]] = []  # covered words, first word of the chain
        regions: list[tuple[int, int, int]] = []
        oldest = 0
        for j, (start, stop, low, high) in enumerate(found):
            covered, first = high - low, start
            while found[oldest][1] + rules.widest_gap < start and oldest < j:
                oldest += 1
            for i in range(oldest, j):
                if found[i][1] <= start and found[i][3] <= low:
                    if found[i][1] + rules.widest_gap >= start and best[i][0] + high - low > covered:
                        covered, first = best[i][0] + high - low, best[i][1]
            best.append((covered, first))
            if regions and first < regions[-1][1]:
                regions[-1] = max(regions[-1], (covered, stop, first))
            else:
                regions.append((covered, stop, first))
        size = automaton.sizes[template]
        spans += [(template, first, stop, covered / size) for covered, stop, first in regions]
    return sorted(spans)


def scan_text(automaton: Automaton, text: bytes, rules: Chaining) -> tuple:
    """Number of words, phrase places and chained spans of one text."""
    words = index_words(text)
    known = np.fromiter((automaton.words.get(w, -1) for w in words), np.int64, len(words))
    inside = np.concatenate([[False], known >= 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
    places, matches = [], []
    for first, end in edges[edges[:, 1] - edges[:, 0] > 1].tolist():
        found = automaton.run(known[first:end].tolist(), first, rules.least_match)
        places += found[0]
        matches += found[1]
    return len(words), places, chain(automaton, matches, rules)


SCANNED = (
    "struct<n_words:bigint,places:array<struct<label:string,start:bigint,end:bigint>>,"
    "spans:array<struct<label:string,start:bigint,end:bigint,covered:double>>>"
)


def scan_licenses(docs: DataFrame, rules: Chaining = Chaining()) -> DataFrame:
    """``docs`` with ``license``: number of words, phrase places and covered template spans.

    Words count from 0, ends are exclusive. Null and empty texts have no words. Spans below the
    least covered share are left out of ``spans`` only if they cover nothing; the caller compares
    ``covered``. A column named ``license`` is replaced; rows are scanned each, whatever their ids.
    A task holds one batch of texts and the automaton, which is a few thousand states."""
    automaton = build_automaton()

    @F.arrow_udf(SCANNED)
    def scan(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            n_words, places, spans = scan_text(automaton, text, rules)
            rows.append(
                {
                    "n_words": n_words,
                    "places": [
                        {"label": automaton.labels[t], "start": s, "end": s + automaton.sizes[t]}
                        for t, s in places
                    ],
                    "spans": [
                        {"label": automaton.labels[t], "start": s, "end": e, "covered": c}
                        for t, s, e, c in spans
                    ],
                }
            )
        place = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        span = pa.struct([*place, pa.field("covered", pa.float64())])
        kind = pa.struct(
            [("n_words", pa.int64()), ("places", pa.list_(place)), ("spans", pa.list_(span))]
        )
        return pa.array(rows, kind)

    return docs.withColumn("license", scan(text_bytes(F.col("text"))))


def license_report(docs: DataFrame, rules: Chaining = Chaining()) -> DataFrame:
    """Phrase places and labels of every row of ``docs(doc_id, text)``."""
    scanned = scan_licenses(docs.select("doc_id", "text"), rules).select("doc_id", "license.*")
    covering = F.filter("spans", lambda s: s["covered"] >= rules.least_covered)
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    added = F.transform(covering, lambda s: s["label"])
    labels = F.array_sort(F.array_distinct(F.concat(base, added)))
    starts = F.transform("places", lambda p: p["start"])
    covered = F.array_max(F.transform("spans", lambda s: s["covered"]))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(covered, F.lit(0.0))).alias("score"),
    )
