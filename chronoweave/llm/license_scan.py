"""License scans with a generalised suffix automaton of license tokens.

The automaton holds every substring of every template (the base phrases are
templates too).  Streaming a text through it gives the matching statistics:
at each word, the longest run of words ending there that some template has.
Runs that cannot grow are matches; a phrase ends at a word iff it is a suffix
of the match there.  Matches of at least ``min_match`` words of one template are
chained in order, with gaps of at most ``max_gap`` words; the chain that covers
the largest share of the template is its span, and a template covered to
``min_cover`` labels the text.  Words outside all templates only reset the
automaton, so long stretches of other text are skipped at array speed.

Null or empty text: no words, empty labels, score 0.  Repeated rows repeat
results; an empty table gives no rows; extra columns are ignored.  Of chains
that cover a template equally the first found gives the span; labels do not
depend on it.  A very long text is scanned whole by one task, whose memory
follows its length.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from chronoweave.llm import vector_text as vt
from chronoweave.llm.common import ddl, id_text, map_docs, rows_in

#: Base phrases and their labels.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
#: Opening or notice sentences of public licenses.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2-or-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: Bytes that are not part of a word: U+0000-2F, 3A-60 and 7B-7F (A-Z are lower-cased first).
SEPARATORS = bytes(b for b in [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)] if not 65 <= b <= 90)


class Automaton:
    """Suffix automaton over several token sequences, with their places."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        places: list[list[tuple[int, int]]] = [[]]  # (sequence, last index) whose prefix is this state
        for s, tokens in enumerate(sequences):
            last = 0
            for i, c in enumerate(tokens):
                last = self._extend(last, c, places)
                places[last].append((s, i))
        # Every state also ends where the states below it in the link tree end.
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.link[v] > 0:
                places[self.link[v]].extend(places[v])
        self.places = [sorted(set(p)) for p in places]

    def _state(self, size: int, nexts: dict[int, int], link: int, places: list) -> int:
        self.next.append(nexts)
        self.size.append(size)
        self.link.append(link)
        places.append([])
        return len(self.size) - 1

    def _clone(self, p: int, c: int, places: list) -> int:
        q = self.next[p][c]
        if self.size[q] == self.size[p] + 1:
            return q
        copy = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q], places)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int, places: list) -> int:
        if c in self.next[last]:
            return self._clone(last, c, places)
        new = self._state(self.size[last] + 1, {}, 0, places)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._clone(p, c, places)
        return new


class Scanner:
    def __init__(self, templates=TEMPLATES, base=BASE, min_match: int = 4, max_gap: int = 12, min_cover: float = 0.6) -> None:
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        both = [*base, *templates]
        words = sorted({w.encode() for _, t in both for w in t.split()})
        self.code = {w: i for i, w in enumerate(words)}
        hashes = np.asarray([vt.word_hash(w) for w in words], np.uint64)
        self.order = np.argsort(hashes)
        self.keys = hashes[self.order]
        self.labels = [label for label, _ in both]
        self.sequences = [[self.code[w.encode()] for w in t.split()] for _, t in both]
        self.n_base = len(base)
        self.shortest = min(map(len, self.sequences[: self.n_base])) if base else min_match
        self.sam = Automaton(self.sequences)
        # Base phrases that are suffixes of the longest string of a state.
        whole = {(s, len(self.sequences[s]) - 1) for s in range(self.n_base)}
        self.ends = [[(s, len(self.sequences[s])) for s, i in p if (s, i) in whole] for p in self.sam.places]
        for v in sorted(range(1, len(self.ends)), key=self.sam.size.__getitem__):
            up = self.sam.link[v]
            if up > 0:
                self.ends[v] = sorted({*self.ends[up], *[(s, k) for s, k in self.ends[v] if k <= self.sam.size[v]]})
            else:
                self.ends[v] = [(s, k) for s, k in self.ends[v] if k <= self.sam.size[v]]

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Codes of words, -1 for words of no template."""
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == hashes, self.order[at], -1)

    def matching_statistics(self, codes: list[int]) -> list[tuple[int, int]]:
        """(state, length) after each word."""
        nexts, link, size = self.sam.next, self.sam.link, self.sam.size
        v = k = 0
        out = []
        for c in codes:
            while v and c not in nexts[v]:
                v = link[v]
                k = size[v]
            if c in nexts[v]:
                v = nexts[v][c]
                k += 1
            else:
                v = k = 0
            out.append((v, k))
        return out

    def scan(self, codes: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, float]]]:
        """Base places (first word, phrase) and spans (template, first word, last word, cover)."""
        known = codes >= 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], known.view(np.int8), [0]])))
        base, matches = [], {}
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a < min(self.shortest, self.min_match):
                continue
            stats = self.matching_statistics(codes[a:b].tolist())
            for i, (v, k) in enumerate(stats):
                base += [(a + i - n + 1, s) for s, n in self.ends[v] if n <= k]
                grows = i + 1 < len(stats) and stats[i + 1][1] == k + 1
                if k >= self.min_match and not grows:
                    for s, last in self.sam.places[v]:
                        matches.setdefault(s, []).append((a + i - k + 1, a + i, last - k + 1, last))
        return base, [(s, *self.chain(m, len(self.sequences[s]))) for s, m in matches.items()]

    def chain(self, matches: list[tuple[int, int, int, int]], size: int) -> tuple[int, int, float]:
        """The best chain of (first, last word; first, last template index): its span and cover.

        Matches advance in the text and in the template; each extends the best
        of the chains that end at most ``max_gap`` words before it.
        """
        best: list[tuple[int, int]] = []  # (covered, first word) of the best chain that ends with match i
        matches = sorted(matches)
        low = 0
        for i, (a, b, p, q) in enumerate(matches):
            cover, start = q - p + 1, a
            while matches[low][1] < a - self.max_gap - size:
                low += 1
            for j in range(low, i):
                _, bj, _, qj = matches[j]
                if bj < b and qj < q and a - bj <= self.max_gap + 1:
                    new = best[j][0] + q - max(p - 1, qj)
                    if new > cover and bj < a + max(0, qj - p + 1) + 1:
                        cover, start = new, best[j][1]
            best.append((cover, start))
        k = max(range(len(best)), key=lambda i: best[i][0])
        return best[k][1], matches[k][1], min(1.0, best[k][0] / size)


@lru_cache(maxsize=4)
def scanner(min_match: int, max_gap: int, min_cover: float) -> Scanner:
    return Scanner(min_match=min_match, max_gap=max_gap, min_cover=min_cover)


def scan(docs: DataFrame, min_match: int = 4, max_gap: int = 12, min_cover: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License places, spans and labels of every whole text.

    doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score
    and spans (label, first, last word, cover) of covered templates.  score: 1
    if a base phrase stands in the text, else the largest cover of a template.
    """
    df = id_text(docs, id_col, text_col)

    def run(batch):
        sc = scanner(min_match, max_gap, min_cover)
        for part in rows_in([batch], 1_000_000):
            w = vt.Words(part.column(1), SEPARATORS, lower=True)
            codes = sc.codes(w.hashes())
            rows = []
            for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
                base, spans = sc.scan(codes[a:b])
                places = [p for p, _ in base]
                held = [(sc.labels[s], f, t, c) for s, f, t, c in spans if c >= min_cover]
                own = {sc.labels[s] for _, s in base}
                score = 1.0 if base else max((c for *_, c in spans), default=0.0)
                rows.append((b - a, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(sorted(own | {h[0] for h in held})), score, [dict(zip(("label", "first", "last", "cover"), h)) for h in held]))
            names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
            yield {"doc_id": part.column(0)} | dict(zip(names, map(list, zip(*rows))))

    return map_docs(df, run, f"doc_id {ddl(df, 'doc_id')}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,cover:double>>")
