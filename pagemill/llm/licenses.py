"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A template is the set of words of a notice. Its blocks are the windows of 2L words at every L-th word, with L the
least power of two that holds the template, so each stretch of L words lies whole in a block. A block meets a template
if it holds at least `THRESHOLD` of the template's words; every such block is found:

- words are ordered by how often they occur in the whole corpus, rarest first (one pass counts the words of the
  templates; there are a few hundred);
- prefix filter: a block that shares a of a template's n words has one of the template's n - a + 1 rarest, so only places
  of those are looked up, in an inverted index of the templates' prefixes;
- length filter: the block has a words of templates at least;
- positional filter: from the first shared word on, both sides have enough words left;
- what remains is compared as sets.

Texts are scanned by tasks where they lie; nothing is shuffled but the counts. The templates are given by the caller
and held by every task: `scan` refuses more than `MOST_WORDS` words of them.

Defined cases: null and empty texts have no words and no labels; texts of any length are scanned whole, and a text shorter than a
block is one block; a block that holds just the threshold meets it; several blocks or templates of a label give it once;
repeated rows get equal results, rows may lack a doc_id; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import blocks, doc_of, prefix_sums, runs, span_hashes, tuned, utf8

#: Share of a template's words that a block has to hold.
THRESHOLD = 0.8
#: Words of all templates, at most.
MOST_WORDS = 100_000
#: Phrases whose words stand consecutively, and their labels (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices as licenses print them, and their labels (fixed values).
TEMPLATES = [
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("artistic-2", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0."),
    ("boost-1", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
]

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_IN_WORD = np.zeros(256, np.uint8)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def words(text: str) -> list[str]:
    """The words of a text, A-Z lower-cased."""
    return re.findall(WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), text))


class Lexicon:
    """Numbers of the words that templates and phrases have; texts as sequences of them."""

    def __init__(self, known: list[str]) -> None:
        self.words = sorted(set(known))
        raw = [w.encode() for w in self.words]
        ends = np.cumsum([len(w) for w in raw]) if raw else np.zeros(0, np.int64)
        size = np.diff(ends, prepend=0)
        h = span_hashes(prefix_sums(np.frombuffer(b"".join(raw), np.uint8)), ends - size, ends)
        self.by_hash = np.argsort(h)
        self.hashes, self.sizes = h[self.by_hash], size[self.by_hash]
        self.number = {w: i for i, w in enumerate(self.words)}

    def read(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word of a block of texts (-1: none of ours), and the texts' n + 1 offsets into them."""
        low = _LOWER[data]
        starts, ends = runs(_IN_WORD[low], offsets)
        h = span_hashes(prefix_sums(low), starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
        same = (self.hashes[at] == h) & (self.sizes[at] == ends - starts) if len(self.hashes) else np.zeros(len(h), bool)
        return np.where(same, self.by_hash[at] if len(self.hashes) else 0, -1), np.searchsorted(starts, offsets)


def frequencies(documents: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """How often each of the lexicon's words occurs in the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(lexicon.words), np.int64)
        for b in batches:
            data, offsets = utf8(b.column(0))
            for lo, hi in blocks(offsets):
                ids, _ = lexicon.read(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                n += np.bincount(ids[ids >= 0], minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some])], ["word", "n"])

    out = np.zeros(len(lexicon.words), np.int64)
    for r in documents.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():  # a row for each word of the templates
        out[r["word"]] = r["n"]
    return out


class Templates:
    """Templates as sets of words in the order of the corpus, with the inverted index of their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], lexicon: Lexicon, counts: np.ndarray, threshold: float) -> None:
        self.rank = np.empty(len(counts), np.int64)
        self.rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
        self.sets, self.need, self.half, self.labels = [], [], [], [label for label, _ in templates]
        index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, text) in enumerate(templates):
            own = words(text)
            ranks = np.sort(self.rank[[lexicon.number[w] for w in set(own)]])
            need = max(1, math.ceil(threshold * len(ranks) - 1e-9))
            self.sets.append(ranks)
            self.need.append(need)
            self.half.append(1 << max(0, len(own) - 1).bit_length())
            for i, r in enumerate(ranks[: len(ranks) - need + 1].tolist()):
                index[r].append((t, i))
        self.index = index
        self.in_prefix = np.zeros(len(counts) + 1, bool)  # the last is for words that aren't ours
        self.in_prefix[list(index)] = True

    def met(self, ranks: np.ndarray) -> tuple[set[int], set[int], float]:
        """Of one text's words (ranks; -1: none of ours): the templates that some block meets, those of them that stand in one for themselves, and the largest share.

        A template doesn't stand for itself in a block that overlaps one where another was met by more words, these among them.
        """
        first: dict[tuple[int, int, int], tuple[int, int]] = {}  # (half, block, template) -> least place in the template's prefix, and its word
        for p in np.flatnonzero(self.in_prefix[ranks]).tolist():
            r = int(ranks[p])
            for t, i in self.index[r]:
                for block in {p // self.half[t], max(0, p // self.half[t] - 1)}:
                    key = (self.half[t], block, t)
                    first[key] = min(first.get(key, (i, r)), (i, r))
        in_block: dict[tuple[int, int], np.ndarray] = {}
        found: list[tuple[int, int, int, set[int]]] = []  # first word and end of the block, template, shared words
        for (half, block, t), (i, r) in first.items():
            if (half, block) not in in_block:
                own = np.unique(ranks[block * half : (block + 2) * half])
                in_block[half, block] = own[own >= 0]
            own, template, need = in_block[half, block], self.sets[t], self.need[t]
            # lengths, then what is left on both sides from the first shared word on
            if len(own) < need or 1 + min(len(template) - i - 1, len(own) - int(np.searchsorted(own, r)) - 1) < need:
                continue
            shared = np.intersect1d(own, template, assume_unique=True)
            if len(shared) >= need:
                found.append((block * half, (block + 2) * half, t, set(shared.tolist())))
        found.sort(key=lambda f: f[:3])
        hidden, open_ = set(), []
        for f in found:  # each with the blocks before it that reach into it
            open_ = [o for o in open_ if o[1] > f[0]]
            hidden |= {o[:3] for o in open_ if o[3] < f[3]}
            if any(f[3] < o[3] for o in open_):
                hidden.add(f[:3])
            open_.append(f)
        share = max((len(shared) / len(self.sets[t]) for _, _, t, shared in found), default=0.0)
        return {f[2] for f in found}, {f[2] for f in found if f[:3] not in hidden}, share


def scan(documents: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 with a phrase, else the largest share of a template that was met, else 0) and met_labels.

    met_labels has every template that a block meets; labels those that stand for themselves: a notice of the Affero license
    also holds all but one word of the plain one's, and a notice of version 3 all but one of version 2's.
    """
    tuned(documents.sparkSession)
    lexicon = Lexicon([w for text in [*phrases, *(t for _, t in templates)] for w in words(text)])
    if len(lexicon.words) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words")
    known = Templates(templates, lexicon, frequencies(documents, lexicon), threshold)
    sequences = [([lexicon.number[w] for w in words(p)], label) for p, label in phrases.items()]
    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, met_labels string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks_of = np.append(known.rank, -1)
        for b in batches:
            out: list[tuple] = []
            data, offsets = utf8(b.column(1))
            for lo, hi in blocks(offsets):
                ids, cuts = lexicon.read(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                doc, ranks = doc_of(cuts), ranks_of[ids]
                places: dict[int, list[int]] = defaultdict(list)
                base: dict[int, set[str]] = defaultdict(set)
                for sequence, label in sequences:
                    n = len(ids) - len(sequence) + 1
                    hit = np.ones(max(0, n), bool)
                    for i, w in enumerate(sequence):
                        hit &= ids[i : i + max(0, n)] == w
                    for p in np.flatnonzero(hit).tolist():
                        if doc[p] == doc[p + len(sequence) - 1]:
                            places[doc[p]].append(p - int(cuts[doc[p]]))
                            base[doc[p]].add(label)
                some = set(doc[np.flatnonzero(known.in_prefix[ranks])].tolist())
                for d in range(hi - lo):
                    met, own, share = known.met(ranks[cuts[d] : cuts[d + 1]]) if d in some else (set(), set(), 0.0)
                    at, labels = places.get(d, []), base.get(d, set())
                    named = lambda templates: {known.labels[t] for t in templates}
                    row = [",".join(sorted(x)) for x in (labels, labels | named(own), named(met))]
                    out.append((int(cuts[d + 1] - cuts[d]), len(at), min(at, default=None), max(at, default=None), row[0], row[1], 1.0 if at else share, row[2]))
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "met_labels"])

    return documents.select("doc_id", "text").mapInArrow(run, schema)
