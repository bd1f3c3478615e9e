"""Operator 7: licence scan with a generalised suffix automaton of licence tokens.

Templates are the whole texts in ``license_texts`` (label-name.txt), headers and names of common public licences; others can
be given. The automaton holds the tokens of all templates and of the base phrases. A text's matching statistics give, at each
word, the longest stretch ending there that some template has. Stretches of ``LONGEST_FROM`` words or more that can't
be extended become matches; matches near each other, in the order of one template, are chained, and a chain's covered
share of the template is its score. A template covered by ``COVERED`` or more adds its label; one of up to ``NAME_WORDS``
words is a name and must be there word by word, as those of different licences differ by a word. Whole texts and headers have
an automaton each, since a long match in a text would hide a header in it; what lies within a longer licence text adds no
label of its own. The base phrases are read off the automaton's states.

Only stretches whose adjacent words are adjacent in some template are walked, which loses no match of two words.
Null and empty texts have no words, no labels and score 0; repeated rows give repeated results; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import repeat
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from attrix.llm.common import id_and_bytes

# Base phrases and short public licence texts, with their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction including "
            "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies "
            "of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in "
               "compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("cc", "licensed under cc by nc 4 0"),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
]
HEADERS = [
    ("mpl", "the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this "
            "file except in compliance with the license you may obtain a copy of the license at"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
            "distributed with this file you can obtain one at"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
             "general public license as published by the free software foundation"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero "
             "general public license as published by the free software foundation"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: Names by which texts refer to a licence, as words.
NAMES = {
    "mit": ["the mit license"], "apache": ["apache license version 2 0", "apache license 2 0"],
    "gpl": ["gnu general public license"], "lgpl": ["lesser general public license", "library general public license"],
    "agpl": ["affero general public license"], "mpl": ["mozilla public license"],
    "bsd": ["the bsd license", "bsd 2 clause", "bsd 3 clause", "2 clause bsd", "3 clause bsd"],
    "isc": ["isc license"], "unlicense": ["the unlicense", "unlicense org"],
    "cc0": ["cc0 1 0 universal", "creative commons zero", "under cc0 1 0", "licensed under cc0"],
    "gfdl": ["gnu free documentation license"], "artistic": ["the artistic license", "artistic license 2 0"],
    "cc": ["creative commons attribution", *(f"cc {kind} {version}" for kind in (
        "by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd") for version in ("1 0", "2 0", "2 5", "3 0", "4 0"))],
}
SPDX = {"mit": ["mit"], "apache": ["apache 2 0"], "gpl": ["gpl 2 0", "gpl 3 0"], "lgpl": ["lgpl 2 1", "lgpl 3 0"],
        "agpl": ["agpl 3 0"], "mpl": ["mpl 1 1", "mpl 2 0"], "bsd": ["bsd 2 clause", "bsd 3 clause"], "isc": ["isc"],
        "unlicense": ["unlicense"], "cc0": ["cc0 1 0"]}
LONGEST_FROM = 3  # words of a match
NAME_WORDS = 8    # words of a template that counts only as a whole
WHOLE_FROM = 100  # words of a whole text; shorter ones have an automaton of their own, as long matches would hide theirs
GAP = 30          # words between two matches of a chain
COVERED = 0.6     # share of a template that adds its label

#: Letters and digits of ASCII, A-Z lower-cased, and all bytes beyond; the others part words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
               for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def public_licenses() -> list[tuple[str, str]]:
    """(label, text) of whole licence texts, headers and names."""
    whole = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    return [
        *((f.name.split("-")[0], f.read_text(encoding="utf-8")) for f in whole),
        *((label, text) for label, text in TEMPLATES if len(text.split()) > NAME_WORDS), *HEADERS,
        *((label, name) for label, names in NAMES.items() for name in names),
        *((label, f"spdx license identifier {name}") for label, names in SPDX.items() for name in names),
    ]


class Automaton:
    """Generalised suffix automaton over token numbers, with the places of each state in the templates."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, names=()):
        self.base = len(phrases)
        phrases = [*phrases, *((name, label) for label, name in names)]
        self.labels = [label for label, _ in templates]
        self.phrase_labels = [label for _, label in phrases]
        texts = [words_of(t.encode()) for _, t in templates] + [words_of(p.encode()) for p, _ in phrases]
        self.sizes, self.phrase_sizes = ([len(t) for t in some] for some in (texts[:len(templates)], texts[len(templates):]))
        self.numbers: dict[bytes, int] = {}
        rows = [[self.numbers.setdefault(w, len(self.numbers)) for w in t] for t in texts]
        size = len(self.numbers)
        self.adjacent = np.zeros((size + 1, size + 1), bool)  # the last row and column: words of no template
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for t, row in enumerate(rows):
            for a, b in zip(row, row[1:]):
                self.adjacent[a, b] = True
            state = 0
            for k, c in enumerate(row):
                state = self._extend(state, c)
                while len(ends) < len(self.next):
                    ends.append([])
                if t < len(templates):
                    ends[state].append((t, k))
        order = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        for s in order:
            if self.length[self.link[s]] >= LONGEST_FROM:  # shorter ones are no matches
                ends[self.link[s]] += ends[s]
        self.ends = [sorted(set(e)) for e in ends]
        # phrases that end where a state's strings end: (phrase, words, whether the match must be checked for length)
        home = {}
        for p, row in enumerate(rows[len(templates):]):
            state = 0
            for c in row:
                state = self.next[state][c]
            home.setdefault(state, []).append((p, len(row)))
        self.closing: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for s in range(len(self.next)):
            up = s
            while up > 0:
                self.closing[s] += home.get(up, [])
                up = self.link[up]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length

        def clone_of(p: int, q: int) -> int:
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            clone = len(nxt) - 1
            link[q] = clone
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = clone
                p = link[p]
            return clone

        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else clone_of(last, q)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        new, p = len(nxt) - 1, last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else clone_of(p, q)
        return new

    def walk(self, numbers: list[int], offset: int):
        """Base places (phrase, start) and unextended matches (start, words, state) of a stretch of template words."""
        places, matches = [], []
        state = size = 0
        for k, c in enumerate(numbers):
            before = state, size
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state, size = self.next[state][c], size + 1
            if size <= before[1] and before[1] >= LONGEST_FROM:
                matches.append((offset + k - before[1], before[1], before[0]))
            for p, words in self.closing[state]:
                if words <= size:
                    places.append((p, offset + k - words + 1))
        if size >= LONGEST_FROM:
            matches.append((offset + len(numbers) - size, size, state))
        return places, matches


def chains(matches: list[tuple[int, int, int]], automaton: Automaton) -> list[tuple[int, int, int, int]]:
    """(template, covered words, start, end) of the best chain of each run of near matches and each template."""
    of: dict[int, list[tuple[int, int, int]]] = {}
    for start, size, state in matches:
        for t, end in automaton.ends[state]:
            of.setdefault(t, []).append((start, end - size + 1, size))
    out = []
    for t, found in of.items():
        found.sort()
        run: list[tuple[int, int, int]] = []
        last = None
        for m in [*found, None]:
            if run and (m is None or m[0] > last + GAP):
                out.append((t, *_best_chain(run)))
                run = []
            if m is not None:
                last = m[0] + m[2] if not run else max(last, m[0] + m[2])
                run.append(m)
    return out


def _best_chain(run: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """Most template words covered by matches in ascending order of text and template, where the later of two that
    overlap counts from its first free word. Kept per template end: the chains that no other one beats."""
    ends: list[int] = []   # template ends, ascending, with ascending cover
    tops: list[tuple[int, int]] = []  # (cover, first word)
    last = (0, 0, 0)
    for start, place, size in run:
        end = place + size
        i = bisect_right(ends, place) - 1
        cover, first = (tops[i][0] + size, tops[i][1]) if i >= 0 else (size, start)
        j = i + 1
        while j < len(ends) and ends[j] < end:  # overlap within the template
            c = tops[j][0] + end - ends[j]
            if c > cover:
                cover, first = c, tops[j][1]
            j += 1
        at = bisect_right(ends, end)
        if not at or tops[at - 1][0] < cover:
            ends.insert(at, end)
            tops.insert(at, (cover, first))
            while at + 1 < len(ends) and tops[at + 1][0] <= cover:
                del ends[at + 1], tops[at + 1]
            if at and ends[at - 1] == end:
                del ends[at - 1], tops[at - 1]
        if cover > last[0]:
            last = (cover, first, start + size)
    return last


def automata(templates: list[tuple[str, str]]) -> list[Automaton]:
    """Of headers with all names and the base phrases, and of whole texts."""
    size = [len(words_of(text.encode())) for _, text in templates]
    names = [t for t, n in zip(templates, size) if 0 < n <= NAME_WORDS]
    headers = [t for t, n in zip(templates, size) if NAME_WORDS < n < WHOLE_FROM]
    return [Automaton(headers, names=names), Automaton([t for t, n in zip(templates, size) if n >= WHOLE_FROM], [])]


def _found(words: list[bytes], a: Automaton) -> tuple[list[tuple[int, int]], list[tuple[str, int, int, int, int]]]:
    """Places of base phrases, and (label, covered words, of how many, start, end) of chains and names."""
    known = np.fromiter(map(a.numbers.get, words, repeat(len(a.numbers))), np.int32, len(words))
    near = a.adjacent[known[:-1], known[1:]]
    places: list[tuple[int, int]] = []
    matches: list[tuple[int, int, int]] = []
    if near.any():
        edge = np.flatnonzero(np.diff(np.concatenate([[0], near.astype(np.int8), [0]])))
        for start, stop in zip(edge[::2].tolist(), edge[1::2].tolist()):
            p, m = a.walk(known[start:stop + 1].tolist(), start)
            places += p
            matches += m
    spans = [(a.labels[t], c, a.sizes[t], s, e) for t, c, s, e in (chains(matches, a) if matches else [])]
    spans += [(a.phrase_labels[p], n := a.phrase_sizes[p], n, s, s + n) for p, s in places if p >= a.base]
    return [x for x in places if x[0] < a.base], spans


def _outer(spans: list[tuple[str, int, int, int, int]]) -> list[tuple[str, int, int, int, int]]:
    """Spans that lie in none of more covered words: what a licence text says of others belongs to it."""
    out, around = [], []
    for x in sorted(spans, key=lambda x: (x[3], -x[4], -x[1])):
        around = [y for y in around if y[4] > x[3]]
        if not any(y[4] >= x[4] and y[1] > x[1] for y in around):
            out.append(x)
            around.append(x)
    return out


def scan(text: bytes, a: Automaton, *more: Automaton) -> dict:
    words = words_of(text)
    places, spans = _found(words, a)
    for b in more:
        spans += _found(words, b)[1]
    base = sorted({a.phrase_labels[p] for p, _ in places})
    covered = [x for x in spans if x[1] >= COVERED * x[2]]
    covered = _outer(covered)
    starts = [s for _, s in places]
    return {
        "n_words": len(words), "n_base": len(places), "first_word": min(starts, default=None),
        "last_word": max(starts, default=None), "base_labels": ",".join(base),
        "labels": ",".join(sorted({*base, *(x[0] for x in covered)})),
        "score": max((min(1.0, cover / size) for _, cover, size, _, _ in spans), default=0.0),
        "spans": [{"label": label, "first": s, "last": e - 1, "covered": c} for label, c, _, s, e in sorted(
            covered, key=lambda x: (x[3], x[0], x[4]))],
    }


def license_scan(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", templates=None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the covered spans of each text.

    ``templates`` are (label, text) pairs; public_licenses() if None.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automata(public_licenses() if templates is None else templates))

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = shared.value
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for frame in frames:
            out = pd.DataFrame([scan(t, *every) for t in frame["text"]], columns=names)
            out.insert(0, "doc_id", frame["doc_id"].astype("Int64").to_numpy())
            yield out.astype({"doc_id": "Int64", "first_word": "Int64", "last_word": "Int64"})

    return id_and_bytes(docs, doc_col, text_col).mapInPandas(
        rows, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
              "labels string, score double, spans array<struct<label: string, first: long, last: long, covered: long>>")
