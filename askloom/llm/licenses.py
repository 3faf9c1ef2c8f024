"""Licence scan: a suffix automaton of licence texts' words, matching statistics, chained spans."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from askloom.llm.common import pieces, span_hashes, text_bytes, word_spans

#: Phrases whose every place counts, with their labels; fixed values.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices and passages of well-known licences, as words; fixed values.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nc-nd", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means"),
]

#: The GNU licences differ in a name and a number only: label, what it covers, name, version.
_GNU = [
    ("gpl-2", "program", "gnu general", "2"), ("gpl-3", "program", "gnu general", "3"),
    ("lgpl-2", "library", "gnu library general", "2"), ("lgpl-2", "library", "gnu lesser general", "2"),
    ("lgpl-2.1", "library", "gnu lesser general", "2 1"), ("lgpl-3", "library", "gnu lesser general", "3"),
    ("agpl-3", "program", "gnu affero general", "3"),
]
_GNU_FORMS = [
    "this {what} is free software you can redistribute it and or modify it under the terms of the {name} public license as published by the free software foundation either version {v} of the license or at your option any later version",
    "you can redistribute it and or modify it under the terms of the {name} public license as published by the free software foundation version {v} of the license",
    "you can redistribute it and or modify it under the terms of the {name} public license version {v} as published by the free software foundation",
    "this work is licensed under the {name} public license version {v}",
]
TEMPLATES += [(label, form.format(what=what, name=name, v=v)) for label, what, name, v in _GNU for form in _GNU_FORMS]

#: Runs of words that tell relatives apart, by a word that all of a family's templates hold. A chain
#: counts only if its matches hold every run of the family that stands in its template, each run whole.
MARKS = {
    "gnu": ["gnu general", "gnu library general", "gnu lesser general", "gnu affero general", "version 2", "version 2 1", "version 3"],
    "attribution": ["attribution noncommercial", "attribution sharealike", "attribution noderivatives",
                    "noncommercial sharealike", "noncommercial noderivatives"],
}

LEAST = 4       # words of a match that may join a chain
GAP = 6         # words between two matches of a chain, in the text and in the template
COVERED = 0.6   # share of a template that its label asks for, besides its MARKS, and
COVERED_WORDS = 5

_GAP_BYTES = np.ones(256, bool)
_GAP_BYTES[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


@dataclass
class State:
    length: int
    link: int
    arcs: dict
    ends: set       # (template, position of its last word) of the longest string's occurrences
    phrases: tuple = ()


class Automaton:
    """Generalised suffix automaton: every run of words in any template is a path from the start."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.labels = [label for label, _ in templates]
        texts = [t.split() for _, t in templates]
        self.lengths = [len(t) for t in texts]
        self.marks = [[(len(m), [k for k in range(len(t)) if t[k:k + len(m)] == m]) for m in marks]
                      for t in texts for marks in [[m.split() for word, runs in MARKS.items() if word in t for m in runs]]]
        self.marks = [[(n, at) for n, at in marks if at] for marks in self.marks]
        runs = [p.split() for p in phrases]
        vocabulary = sorted({w for t in texts + runs for w in t})
        self.ids = {w: i for i, w in enumerate(vocabulary)}
        self.states = [State(0, -1, {}, set())]
        for k, t in enumerate(texts + runs):
            last = 0
            for at, w in enumerate(t):
                last = self._add(last, self.ids[w])
                if k < len(texts):
                    self.states[last].ends.add((k, at))
        for s in sorted(self.states[1:], key=lambda s: -s.length):  # an occurrence is one of every suffix
            self.states[s.link].ends |= s.ends
        self.states[0].ends = set()
        self.phrase_label = list(phrases.values())
        self.phrase_length = [len(r) for r in runs]
        final = {}
        for p, r in enumerate(runs):
            s = 0
            for w in r:
                s = self.states[s].arcs[self.ids[w]]
            final.setdefault(s, []).append(p)
        for i, s in enumerate(self.states):
            found, at = [], i
            while at > 0:
                found += final.get(at, [])
                at = self.states[at].link
            s.phrases = tuple(found)
        pairs = {(self.ids[a], self.ids[b]) for t in texts + runs for a, b in zip(t, t[1:])}
        self.pairs = np.array(sorted(a * len(vocabulary) + b for a, b in pairs), np.int64)
        raw = [np.frombuffer(w.encode(), np.uint8) for w in vocabulary]
        keys = np.array([span_hashes(b, np.array([0]), np.array([len(b)]))[0] for b in raw], np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def _add(self, last: int, w: int) -> int:
        states = self.states
        if w in states[last].arcs:
            q = states[last].arcs[w]
            if states[q].length == states[last].length + 1:
                return q
            return self._clone(last, w, q)
        states.append(State(states[last].length + 1, 0, {}, set()))
        new, p = len(states) - 1, last
        while p >= 0 and w not in states[p].arcs:
            states[p].arcs[w] = new
            p = states[p].link
        if p >= 0:
            q = states[p].arcs[w]
            states[new].link = q if states[q].length == states[p].length + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        states = self.states
        states.append(State(states[p].length + 1, states[q].link, dict(states[q].arcs), set()))
        copy = len(states) - 1
        states[q].link = copy
        while p >= 0 and states[p].arcs.get(w) == q:
            states[p].arcs[w] = copy
            p = states[p].link
        return copy

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary ids of word hashes, -1 where a word is in no template."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.order[at], -1).astype(np.int32)

    def statistics(self, words) -> list[tuple[int, int]]:
        """For each word: the state and length of the longest run that ends there and is in a template."""
        out, s, n, states = [], 0, 0, self.states
        for w in words:
            while s and w not in states[s].arcs:
                s = states[s].link
                n = states[s].length
            if w in states[s].arcs:
                s, n = states[s].arcs[w], n + 1
            else:
                s, n = 0, 0
            out.append((s, n))
        return out


_AUTOMATON: list[Automaton] = []


def automaton() -> Automaton:
    if not _AUTOMATON:
        _AUTOMATON.append(Automaton())
    return _AUTOMATON[0]


def _told_apart(auto: Automaton, t: int, chain: list[tuple[int, int, int]]) -> bool:
    """Whether the chain's matches hold all words that tell template ``t`` from its relatives."""
    return all(any(b <= k and k + m <= b + n for k in at for _, b, n in chain) for m, at in auto.marks[t])


def _chained(matches):
    """(template, words covered, spans) of the best chain that ends with each match.

    matches: (part of the text, template, text start, template start, words), by text start. Each
    match joins the chain before it in its part that covers most of the template, among those
    within GAP on both sides.
    """
    open_: dict[tuple[int, int], list[tuple[int, int, int, list]]] = {}
    for part, t, a, b, n in matches:
        rows = open_[part, t] = [r for r in open_.get((part, t), []) if a - r[1] <= GAP]  # later matches start later
        choice = (0, None)
        for covered, ea, eb, chain in rows:
            if 0 <= a - ea and 0 <= b - eb <= GAP and covered > choice[0]:
                choice = (covered, chain)
        chain = (choice[1], (a, b, n))      # linked backwards: chains share their beginnings
        rows.append((choice[0] + n, a + n, b + n, chain))
        yield t, choice[0] + n, chain


def _unlinked(chain) -> list[tuple[int, int, int]]:
    out = []
    while chain:
        chain, span = chain
        out.append(span)
    return out[::-1]


def chains(matches: list[tuple[int, int, int, int]], passes) -> dict[int, tuple[int, list]]:
    """For each template: words covered by its best chain, and all its chains that pass.

    matches: (template, text start, template start, words), by text start. A chain is a list of
    spans (first word in the text, first word in the template, words); ``passes(template, covered, chain)``
    says whether it will do. Those that cover most come first, and of one template no two overlap in
    the text; what lies between the chosen ones is chained again until nothing there passes.
    """
    best: dict[int, int] = {}
    taken: dict[int, list[tuple[int, int, list]]] = {}
    left = [(0, *m) for m in matches]
    while left:
        found = []
        for t, covered, chain in _chained(left):
            best[t] = max(best.get(t, 0), covered)
            spans = _unlinked(chain)
            if passes(t, covered, spans):
                found.append((t, covered, spans))
        grown = set()
        for t, covered, spans in sorted(found, key=lambda f: -f[1]):
            row, have = (spans[0][0], spans[-1][0] + spans[-1][2], spans), taken.setdefault(t, [])
            at = bisect_left(have, row[:2])
            if (at == 0 or have[at - 1][1] <= row[0]) and (at == len(have) or row[1] <= have[at][0]):
                have.insert(at, row)
                grown.add(t)
        rest = []
        for _, t, a, b, n in left:
            if t in grown:
                at = bisect_left(taken[t], (a + n,))        # chosen chains that start before the match ends
                if at == 0 or taken[t][at - 1][1] <= a:
                    rest.append((at, t, a, b, n))
        left = rest
    return {t: (covered, [spans for *_, spans in taken.get(t, [])]) for t, covered in best.items()}


def _scan_text(auto: Automaton, runs: list[tuple[int, list[int]]]) -> dict:
    places, base, matches = [], set(), []
    for first, words in runs:
        stats = auto.statistics(words)
        for i, (s, n) in enumerate(stats):
            for p in auto.states[s].phrases:
                if n >= auto.phrase_length[p]:
                    places.append(first + i - auto.phrase_length[p] + 1)
                    base.add(auto.phrase_label[p])
            if n >= LEAST and (i + 1 == len(stats) or stats[i + 1][1] <= n):
                matches += [(t, first + i - n + 1, at - n + 1, n) for t, at in sorted(auto.states[s].ends)]
    labels, spans, score = set(base), [], 1.0 if base else 0.0
    enough = lambda t, covered, chain: (
        covered >= COVERED_WORDS and covered >= COVERED * auto.lengths[t] and _told_apart(auto, t, chain))
    found = chains(sorted(matches, key=lambda m: (m[1], m[0], m[2])), enough)
    for t, (covered, passed) in found.items():
        score = max(score, min(1.0, covered / auto.lengths[t]))
        for chain in passed:
            labels.add(auto.labels[t])
            spans.append((auto.labels[t], chain[0][0], chain[-1][0] + chain[-1][2], sum(n for _, _, n in chain)))
    return {"places": places, "base": base, "labels": labels, "spans": sorted(spans), "score": score}


_SCHEMA = ("doc_id long, n_words long, places array<long>, base_labels string, labels string, score double, "
           "spans array<struct<label:string,first:long,past:long,covered:long>>")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, places, base_labels, labels, score, spans for every whole text.

    Words are runs of digits, a-z (A-Z lowered) and bytes over 0x7F. ``places`` are the starts of
    all PHRASES; ``spans`` are all template spans covered by chained matches, none overlapping another
    of its template; ``score`` is the largest
    covered share of a template, 1 with a phrase. Labels are sorted and comma-joined. A null or
    empty text has no words and empty labels; ids may be null or repeat; other columns are dropped.
    A text is read in pieces; only runs of words of which each neighbouring pair is in a template
    enter the automaton, since nothing longer than one word can match across other pairs.
    """
    def run(batches):
        auto = automaton()
        size = len(auto.ids)
        lower = np.arange(256, dtype=np.uint8)
        lower[0x41:0x5B] += 0x20
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            all_words, all_texts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for first, part, offs in pieces(data, offsets, gap=_GAP_BYTES):
                low = lower[part]
                starts, ends = word_spans(low, offs, _GAP_BYTES)
                all_words.append(auto.words(span_hashes(low, starts, ends)))
                all_texts.append(first + np.searchsorted(offs, starts, "right") - 1)
            words, texts = np.concatenate(all_words), np.concatenate(all_texts)
            bounds = np.searchsorted(texts, np.arange(batch.num_rows + 1))
            near = (words[:-1] >= 0) & (words[1:] >= 0) & (texts[:-1] == texts[1:])
            near[near] = np.isin(words[:-1][near].astype(np.int64) * size + words[1:][near], auto.pairs)
            step = np.diff(np.concatenate([[0], near.astype(np.int8), [0]]))
            begin, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            keep = stop - begin >= 2
            found: dict[int, list] = {}
            for a, b in zip(begin[keep].tolist(), stop[keep].tolist()):
                t = int(texts[a])
                found.setdefault(t, []).append((a - int(bounds[t]), words[a:b + 1].tolist()))
            out = []
            for i, (doc_id, n) in enumerate(zip(batch.column(0).to_pylist(), np.diff(bounds).tolist())):
                r = _scan_text(auto, found.get(i, []))
                out.append({"doc_id": doc_id, "n_words": n, "places": r["places"], "base_labels": ",".join(sorted(r["base"])),
                            "labels": ",".join(sorted(r["labels"])), "score": r["score"],
                            "spans": [dict(zip(("label", "first", "past", "covered"), s)) for s in r["spans"]]})
            yield pa.RecordBatch.from_pylist(out, _ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(pa.int64())), ("base_labels", pa.string()),
    ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("past", pa.int64()), ("covered", pa.int64())])))])


def license_columns(scanned: DataFrame) -> DataFrame:
    """The scan as flat columns: n_base, first_word and last_word from the places."""
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"), "base_labels", "labels", "score")
