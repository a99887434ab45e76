"""Quality rules with repetition coverage: rolling hashes of several n-gram lengths, in numpy.

Words are hashed once per text; the hash of an n-gram rolls over the word hashes. For each length the characters
inside n-grams that occur twice or more are measured (overlaps once), and so are those of lines that repeat an
earlier line. A text is kept if the base rules pass and each share stays below its limit (`LIMITS`).

Defined cases: a null or empty text has no words and fails the base rules; texts of any length are measured whole; a share
that is just its limit passes; repeated rows get equal results, rows may lack a doc_id; an empty table gives no rows;
columns but doc_id and text, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.llm.common import blocks, doc_of, mixed, prefix_sums, runs, span_hashes, tuned, utf8

#: Share of a text's word characters that may lie inside repeated n-grams of n words. Below the base rule's 20 % of words,
#: the lower the longer the n-gram; of the 3,330 documents of sf0.1 labelled good that pass the base rules, at most four
#: exceed any one of them.
LIMITS = {5: 0.20, 6: 0.18, 8: 0.16, 10: 0.12}
#: Share that may lie in lines equal to an earlier line.
LINE_LIMIT = 0.30

_SPACE = np.ones(256, np.uint8)
_SPACE[[0x20, *range(0x09, 0x0E)]] = 0
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def repeated(key: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def later(key: np.ndarray) -> np.ndarray:
    """Which values occurred before."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    out = np.zeros(len(key), bool)
    out[order[1:][s[1:] == s[:-1]]] = True
    return out


def measured(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of a block of whole texts."""
    n = len(offsets) - 1
    starts, ends = runs(_SPACE[data], offsets)
    word_cuts = np.searchsorted(starts, offsets)
    doc = doc_of(word_cuts)
    code_points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    lengths = code_points[ends] - code_points[starts]
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    prefix = prefix_sums(data)
    word = span_hashes(prefix, starts, ends)
    seed = mixed(np.arange(1, n + 1, dtype=np.uint64))  # a gram repeats only within its own text
    out = {"n_words": np.diff(word_cuts), "word_chars": np.bincount(doc, lengths, n).astype(np.int64), "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]]}

    gram, size, chars = word, 1, np.maximum(out["word_chars"], 1)
    grams = {1: word}
    for size in range(2, max(LIMITS) + 1):
        gram = gram[:-1] * _STEP + mixed(word[size - 1 :] + np.uint64(size)) if len(gram) > 1 else gram[:0]
        grams[size] = gram
    for size in LIMITS:
        starts_at = len(grams[size])
        inside = doc[size - 1 :][:starts_at] == doc[:starts_at] if starts_at else np.zeros(0, bool)
        at = np.flatnonzero(inside)
        twice = at[repeated(mixed(grams[size][at]) ^ seed[doc[at]])] if len(at) else at
        cover = np.zeros(len(word) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + size, -1)
        covered = np.cumsum(cover[:-1]) > 0
        if size == 5:
            out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)
        out[f"share_{size}"] = np.bincount(doc[covered], lengths[covered], n) / chars

    newline = np.flatnonzero(data == 0x0A)
    line_starts = np.union1d(newline + 1, offsets[:-1])
    line_starts = line_starts[line_starts < len(data)]
    owner = np.searchsorted(offsets, line_starts, "right") - 1
    line_ends = np.minimum(np.append(newline, len(data))[np.searchsorted(newline, line_starts)], offsets[owner + 1])
    first, last = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    real = last > first  # a line with a word
    line_starts, line_ends, first, last, owner = line_starts[real], line_ends[real], first[real], last[real], owner[real]
    again = later(span_hashes(prefix, line_starts, line_ends) ^ seed[owner]) if len(owner) else np.zeros(0, bool)
    upto = np.concatenate([[0], np.cumsum(lengths)])
    out["n_dup_lines"] = np.bincount(owner[again], minlength=n)
    out["line_share"] = np.bincount(owner[again], (upto[last] - upto[first])[again], n) / chars
    return out


def apply_rules(documents: DataFrame) -> DataFrame:
    """Per document: the base measures, the shares of characters in repeated n-grams and lines, base_failed, kept."""
    tuned(documents.sparkSession)
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shares = [*[f"share_{n}" for n in LIMITS], "line_share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(1))
            parts = [measured(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in blocks(offsets)]
            m = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in longs + shares}
            failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
            kept = ~failed & (m["line_share"] <= LINE_LIMIT)
            for n, most in LIMITS.items():
                kept &= m[f"share_{n}"] <= most
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(m[k].astype(np.int64)) for k in longs], pa.array(failed), pa.array(kept), *[pa.array(m[k].astype(float)) for k in shares]], ["doc_id", *longs, "base_failed", "kept", *shares])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{k} long' for k in longs)}, base_failed boolean, kept boolean, {', '.join(f'{k} double' for k in shares)}")
