"""Licence scan: texts are streamed through a generalised suffix automaton of licence wordings.

Words are runs of 0-9, a-z and characters beyond ASCII, A-Z lower-cased first. The automaton holds all stretches of all
wordings; feeding it the words of a text gives, at every word, the longest stretch that ends there (the matching
statistics). Stretches that can't be prolonged and have ``LONG_WORDS`` words at least are chained in order, per wording,
into spans; the share of the wording's words that a span covers is its score, and a span with a share of
``LABEL_SHARE`` gives the wording's label. Phrases are wordings too, and count at every place where all their words
stand consecutively.

Null and empty texts have no words, labels or places (positions null, score 0). Repeated rows are scanned each on
its own, texts of any length whole, in memory that grows with one text only. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.batches import pieces, small_batches

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words of a stretch that counts for a span, words that may stand between two of its stretches, share for a label.
LONG_WORDS = 4
GAP_WORDS = 8
LABEL_SHARE = 0.6

#: Phrases that are labelled wherever they stand.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: The usual notices of common licences.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    ),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-4.0": ("licensed under a Creative Commons Attribution 4.0 International License",),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


@dataclass
class Scan:
    """What one text shows."""

    n_words: int = 0
    places: list[tuple[int, str]] = field(default_factory=list)
    spans: list[tuple[str, int, int, float]] = field(default_factory=list)


class Automaton:
    """Suffix automaton of several wordings; state 0 is the empty stretch."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, tuple[str, ...]]) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.phrase_labels = list(phrases.values())
        self.template_labels = [label for label, texts in templates.items() for _ in texts]
        phrase_words = [words_of(text) for text in phrases]
        self.template_words = [words_of(text) for texts in templates.values() for text in texts]
        for words in (*phrase_words, *self.template_words):
            last = 0
            for word in words:
                last = self._extend(last, word)
        longest_first = sorted(range(1, len(self.length)), key=lambda s: -self.length[s])
        self.holds = [0] * len(self.length)  # bit t: the state's stretches stand in template t
        for t, words in enumerate(self.template_words):
            state = 0
            for word in words:
                state = self.next[state][word]
                self.holds[state] |= 1 << t
        for state in longest_first:
            self.holds[self.link[state]] |= self.holds[state]
        own: list[list[tuple[int, int]]] = [[] for _ in self.length]
        for p, words in enumerate(phrase_words):
            state = 0
            for word in words:
                state = self.next[state][word]
            if words:
                own[state].append((len(words), p))
        self.ends = own  # phrases that end where a state's stretch does
        for state in reversed(longest_first):
            self.ends[state] = own[state] + (self.ends[self.link[state]] if self.link[state] > 0 else [])

    def _state(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, state: int, word: bytes, target: int) -> int:
        """The state of the stretch one word longer than ``state``'s, cut off from ``target`` if it is shorter there."""
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        if (target := self.next[last].get(word)) is not None:
            return self._split(last, word, target)
        new = self._state(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word, self.next[last][word])
        return new

    def stretches(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(place, state, length) for every word at which a stretch of at least one word ends."""
        moves, link, length = self.next, self.link, self.length
        start, state, n = moves[0], 0, 0
        for place, word in enumerate(words):
            if not n:
                if (to := start.get(word)) is not None:
                    state, n = to, 1
                    yield place, state, n
                continue
            while state and word not in moves[state]:
                state = link[state]
                n = length[state]
            if (to := moves[state].get(word)) is not None:
                state, n = to, n + 1
                yield place, state, n
            else:
                n = 0

    def scan(self, text: str | None) -> Scan:
        words = words_of(text)
        out = Scan(len(words))
        chains: dict[int, list[list[int]]] = {}
        before: tuple[int, int, int] | None = None
        for found in (*self.stretches(words), None):
            if before is not None:
                place, state, n = before
                for size, phrase in self.ends[state]:
                    if size <= n:
                        out.places.append((place - size + 1, self.phrase_labels[phrase]))
                prolonged = found is not None and found[0] == place + 1 and found[2] == n + 1
                if n >= LONG_WORDS and not prolonged:
                    self._chain(chains, place - n + 1, place + 1, self.holds[state])
            before = found
        for t, spans in chains.items():
            total = len(self.template_words[t])
            out.spans += [(self.template_labels[t], start, stop, min(1.0, covered / total)) for start, stop, covered in spans]
        out.spans.sort()
        return out

    def _chain(self, chains: dict[int, list[list[int]]], start: int, stop: int, holds: int) -> None:
        """Add a stretch to the last span of every wording that holds it, or begin a new span."""
        t = 0
        while holds:
            if holds & 1:
                spans = chains.setdefault(t, [])
                if spans and start - spans[-1][1] <= GAP_WORDS and spans[-1][2] + stop - max(start, spans[-1][1]) <= len(self.template_words[t]):
                    last = spans[-1]
                    last[2] += max(0, stop - max(start, last[1]))
                    last[1] = max(last[1], stop)
                else:
                    spans.append([start, stop, stop - start])
            holds >>= 1
            t += 1


SCHEMA = "n_words long, places array<struct<place: long, label: string>>, spans array<struct<label: string, start: long, stop: long, score: double>>"


def scan(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, tuple[str, ...]] = TEMPLATES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, n_words, places, spans) of every row: phrases by the word they start at, and covered spans of wordings."""
    places = pa.list_(pa.struct([("place", pa.int64()), ("label", pa.string())]))
    spans = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(phrases, templates)
        for batch in pieces(batches):
            found = [automaton.scan(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x.n_words for x in found], pa.int64()),
                    pa.array([[{"place": p, "label": label} for p, label in x.places] for x in found], places),
                    pa.array([[dict(zip(("label", "start", "stop", "score"), s)) for s in x.spans] for x in found], spans),
                ],
                names=[id_col, "n_words", "places", "spans"],
            )

    small_batches(docs.sparkSession)
    picked = docs.select(id_col, F.col(text_col).cast("string"))
    return picked.mapInArrow(run, f"{id_col} {picked.schema[0].dataType.simpleString()}, {SCHEMA}")


def summary(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per scanned text: counts and places of phrases, labels, best score."""
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base = F.transform("places", lambda x: x["label"])
    own = F.transform(F.filter("spans", lambda x: x["score"] >= LABEL_SHARE), lambda x: x["label"])
    best = F.coalesce(F.array_max(F.transform("spans", lambda x: x["score"])), F.lit(0.0))
    return scanned.select(
        id_col, "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places")["place"].alias("first_word"), F.array_max("places")["place"].alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, own)).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
