"""Licence scans with a generalised suffix automaton over licence tokens.

All templates are indexed in one automaton, small and the same in every task.
A text is streamed through it word by word; the state after a word stands for
the longest suffix read that occurs in any template (matching statistics).
Where a match can't be extended it is a maximal match; maximal matches of a
template that follow each other in text and template with small gaps are
chained, and a chain that covers enough of its template is a span.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Licence notices and characteristic sentences, by label.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Span(NamedTuple):
    label: str
    start: int  # first word
    stop: int  # one past the last word
    coverage: float


class SuffixAutomaton:
    """Generalised suffix automaton of token sequences, with the places of every state."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[set[tuple[int, int]]] = [set()]
        for number, tokens in enumerate(sequences):
            state = 0
            for at, token in enumerate(tokens):
                state = self._extend(state, token)
                self.places[state].add((number, at))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            self.places[self.link[state]] |= self.places[state]
        self.places[0] = set()

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.places.append(set())
        return len(self.next) - 1

    def _split(self, state: int, token: int) -> int:
        """The state of ``state``'s string plus ``token``, made its own if it shares one with longer strings."""
        there = self.next[state][token]
        if self.length[there] == self.length[state] + 1:
            return there
        own = self._state(self.length[state] + 1, self.link[there], dict(self.next[there]))
        self.link[there] = own
        while state >= 0 and self.next[state].get(token) == there:
            self.next[state][token] = own
            state = self.link[state]
        return own

    def _extend(self, state: int, token: int) -> int:
        if token in self.next[state]:
            return self._split(state, token)
        new = self._state(self.length[state] + 1, 0, {})
        while state >= 0 and token not in self.next[state]:
            self.next[state][token] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, token)
        return new

    def step(self, state: int, length: int, token: int) -> tuple[int, int]:
        while state and token not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if token in self.next[state]:
            return self.next[state][token], length + 1
        return 0, 0


class LicenceScanner:
    """Streams words; see ``scan``."""

    def __init__(self, templates: list[tuple[str, str]] | None = None, *, least: int = 3, gap: int = 8, coverage: float = 0.75, slice_bytes: int = 1 << 20):
        own = TEMPLATES if templates is None else templates
        every = [(label, phrase) for phrase, label in BASE.items()] + own
        self.labels = [label for label, _ in every]
        self.vocabulary: dict[bytes, int] = {}
        sequences = [
            [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in WORD.findall(text.encode())] for _, text in every
        ]
        self.sizes = [len(s) for s in sequences]
        self.automaton = SuffixAutomaton(sequences)
        self.least, self.gap, self.coverage, self.slice_bytes = least, gap, coverage, slice_bytes
        a = self.automaton
        homes = []
        for number in range(len(BASE)):
            state = length = 0
            for token in sequences[number]:
                state, length = a.step(state, length, token)
            homes.append(state)
        #: base phrases that every string of the state, if long enough, ends with
        self.ends: list[list[int]] = [[] for _ in a.next]
        for state in sorted(range(1, len(a.next)), key=lambda s: a.length[s]):
            self.ends[state] = self.ends[a.link[state]] + [n for n, home in enumerate(homes) if home == state]

    def words(self, data: bytes) -> Iterator[tuple[int, list[bytes]]]:
        """Words of a lower-cased text in slices that end between words, with the number of words before."""
        at = before = 0
        while at < len(data):
            stop = min(at + self.slice_bytes, len(data))
            while stop < len(data) and WORD.match(data, stop - 1, stop) and WORD.match(data, stop, stop + 1):
                stop += 1
            found = WORD.findall(data, at, stop)
            yield before, found
            before += len(found)
            at = stop

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], list[Span], float]:
        """Words, base places (start, label), spans of the templates and the best coverage of any template."""
        a, get = self.automaton, self.vocabulary.get
        state = length = total = 0
        last = -2
        base: list[tuple[int, str]] = []
        chains = _Chains(self.sizes, self.gap, self.coverage)
        data = (text or "").encode().lower()
        for before, words in self.words(data):
            total = before + len(words)
            tokens = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
            at = np.flatnonzero(tokens >= 0)
            if len(at) == 0:
                continue
            # a known word without a known neighbour matches nothing of two words
            near = np.zeros(len(at), bool)
            step = np.diff(at) == 1
            near[:-1] |= step
            near[1:] |= step
            near[(at == 0) | (at == len(words) - 1)] = True
            at = at[near]
            for i, token in zip((at + before).tolist(), tokens[at].tolist(), strict=True):
                if i != last + 1:
                    self._close(chains, state, length, last)
                    state = length = 0
                new, size = a.step(state, length, token)
                if size != length + 1:
                    self._close(chains, state, length, last)
                state, length, last = new, size, i
                for n in self.ends[state]:
                    if length >= self.sizes[n]:
                        base.append((i - self.sizes[n] + 1, self.labels[n]))
        self._close(chains, state, length, last)
        spans, best = chains.finish()
        named = [Span(self.labels[n], s, e, c) for n, s, e, c in spans if n >= len(BASE)]
        if base:
            best = 1.0
        return total, base, named, best

    def _close(self, chains: _Chains, state: int, length: int, last: int) -> None:
        if length >= self.least:
            for number, end in self.automaton.places[state]:
                chains.add(number, last - length + 1, last, end - length + 1, end)


class _Chains:
    """Chains of maximal matches for each template, kept while a later match can still extend them."""

    def __init__(self, sizes: list[int], gap: int, coverage: float):
        self.sizes, self.gap, self.coverage = sizes, gap, coverage
        self.open: dict[int, deque] = defaultdict(deque)
        self.spans: list[tuple[int, int, int, float]] = []
        self.best = 0.0

    def add(self, number: int, start: int, stop: int, low: int, high: int) -> None:
        held = self.open[number]
        while held and start - held[0][1] > self.gap + 1:
            self._end(number, held.popleft())
        covered, begin, used = 0, start, -1
        for i, (first, end, reach, got) in enumerate(held):
            if end < start and reach < low and low - reach <= self.gap + 1 and got > covered:
                covered, begin, used = got, first, i
        if used >= 0:
            del held[used]  # this match carries it on
        held.append((begin, stop, high, covered + high - low + 1))

    def _end(self, number: int, chain: tuple[int, int, int, int]) -> None:
        begin, stop, _, got = chain
        share = got / self.sizes[number]
        self.best = max(self.best, min(1.0, share))
        if share >= self.coverage:
            self.spans.append((number, begin, stop + 1, min(1.0, share)))

    def finish(self) -> tuple[list[tuple[int, int, int, float]], float]:
        for number, held in self.open.items():
            for chain in held:
                self._end(number, chain)
        return sorted(self.spans, key=lambda s: (s[1], s[0])), self.best


SCANNED = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,start:long,stop:long,coverage:double>>"
)


def scan_licences(documents: DataFrame, *, templates: list[tuple[str, str]] | None = None, least: int = 3, gap: int = 8, coverage: float = 0.75) -> DataFrame:
    """Licence places of every document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased, of
    whole texts. n_base counts all places of the base phrases, first_word and
    last_word are the smallest and largest of their starts (else null).
    spans are the chains that cover at least ``coverage`` of a template;
    labels joins the labels of spans and base phrases. score is the largest
    share of any template that a chain covers, 1 with a base phrase.

    Null and empty texts have no words. Every input row gives one row, rows
    without doc_id and repeated rows too. Extra columns are ignored; an empty
    table gives an empty result.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenceScanner(templates, least=least, gap=gap, coverage=coverage)
        names = [f.split()[0] for f in SCANNED.split(", ")[:8]] + ["spans"]
        span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("coverage", pa.float64())]))
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), span]
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, base, spans, best = scanner.scan(text.as_py())
                starts = [s for s, _ in base]
                plain = {label for _, label in base}
                out.append((
                    doc, n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(plain)),
                    ",".join(sorted(plain | {s.label for s in spans})), best, [s._asdict() for s in spans],
                ))
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return rows.mapInArrow(run, SCANNED)
