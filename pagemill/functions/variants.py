"""Comparing variants of a text: how much changed, and the same passage in each."""

from __future__ import annotations

import difflib
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.storage import bounded_batches

KEY_CHARS = 80


def similarity(base: str | None, text: str | None) -> float:
    """Twice the signs that both hold, as multisets, over the signs of both; 1 for two empty texts."""
    base, text = base or "", text or ""
    shared = (Counter(base) & Counter(text)).total()
    return 2 * shared / (len(base) + len(text)) if base or text else 1.0


def line_changes(base: str | None, text: str | None) -> tuple[int, int]:
    """Lines removed from `base` and added in `text`, by the blocks of lines they share."""
    a, b = (base or "").splitlines(), (text or "").splitlines()
    steps = [s for s in difflib.SequenceMatcher(None, a, b).get_opcodes() if s[0] != "equal"]
    return sum(s[2] - s[1] for s in steps), sum(s[4] - s[3] for s in steps)


def matched_window(text: str | None, anchor: str | None, size: int) -> str:
    """About `size` characters of whole paragraphs, from the one whose opening is most like that of `anchor` (the first of equals)."""
    paragraphs = [p for p in (text or "").split("\n\n") if p.strip()]
    if not paragraphs:
        return ""
    matcher = difflib.SequenceMatcher(None, "", "")
    matcher.set_seq1((anchor or "")[:KEY_CHARS])
    best, at = -1.0, 0
    for i, p in enumerate(paragraphs):
        matcher.set_seq2(p[:KEY_CHARS])
        if matcher.real_quick_ratio() > best and (r := matcher.ratio()) > best:
            best, at = r, i
    taken, n = [], 0
    while at < len(paragraphs) and n < size:
        taken.append(paragraphs[at])
        n += len(paragraphs[at])
        at += 1
    return "\n\n".join(taken)


def metrics(base: Column, text: Column) -> Column:
    """struct<chars, delta_chars, similarity, lines_removed, lines_added> of a variant against what it was made from."""
    bounded_batches()

    # apart, so that a plan that doesn't ask for lines doesn't compare them
    @F.pandas_udf("double")
    def shared(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([round(similarity(x, y), 4) for x, y in zip(a, b, strict=True)], dtype="float64")

    @F.pandas_udf("lines_removed long, lines_added long")
    def changes(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([line_changes(x, y) for x, y in zip(a, b, strict=True)], columns=["lines_removed", "lines_added"])

    got = changes(base, text)
    return F.struct(F.length(text).cast("long").alias("chars"), (F.length(text) - F.length(base)).cast("long").alias("delta_chars"), shared(base, text).alias("similarity"), got["lines_removed"].alias("lines_removed"), got["lines_added"].alias("lines_added"))


def matched_window_column(text: Column, anchor: Column, size: int) -> Column:
    bounded_batches()

    @F.pandas_udf("string")
    def run(texts: pd.Series, anchors: pd.Series) -> pd.Series:
        return pd.Series([matched_window(x, a, size) for x, a in zip(texts, anchors, strict=True)], dtype=object)

    return run(text, anchor)
