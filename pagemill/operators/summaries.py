"""Summaries by map and reduce around a pluggable model."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.folds import chunks_column
from pagemill.functions.rx import strip
from pagemill.storage import bounded_batches, stored

MOST_ROUNDS = 3


class Model(Protocol):
    """What a text model has to offer; instances are sent to the workers."""

    def points(self, chunk: str, number: int, of: int) -> list[str]: ...

    def summary(self, text: str) -> dict: ...


class Extractive:
    """A deterministic stand-in: first sentences, and the commonest long words as tags."""

    def points(self, chunk: str, number: int, of: int) -> list[str]:
        return [s.strip() for s in re.split(r"(?<=[.!?])\s+", chunk)[:2] if s.strip()]

    def summary(self, text: str) -> dict:
        first = re.split(r"(?<=[.!?])\s+", text.strip())
        words = sorted({w for w in re.findall(r"[^\W\d_]{7,}", text.lower())}, key=lambda w: (-text.lower().count(w), w))
        return {"title": first[0][:60], "tldr": first[0], "summary": " ".join(first[:3]), "tags": words[:3]}


def titled(title: Column, own: Column, source: Column) -> Column:
    """The model's title, else the document's own, else where it came from."""
    some = lambda c: F.nullif(strip(c), F.lit(""))
    return F.coalesce(some(title), some(own), some(source))


def _asked(rows: DataFrame, schema: str, ask: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield ask(b)

    bounded_batches(rows.sparkSession)
    return rows.mapInPandas(run, schema)


def summarized(docs: DataFrame, model: Model, budget: int, chunk: int, key: str = "doc_id") -> DataFrame:
    """key, title, tldr, summary, tags, truncated_chars, sections.

    A text within `budget` characters takes one call; a null text is empty. A longer one is cut into chunks, each condensed to points; while
    the points of a document are beyond the budget and shrink, they are condensed again, three times at most.
    """
    kind = dict(docs.dtypes)[key]
    rows = docs.select(key, F.coalesce("text", F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= budget).select(key, "text", F.lit(1).alias("sections"))
    long = rows.where(F.length("text") > budget)

    def condensed(texts: DataFrame) -> DataFrame:
        cut = texts.select(key, chunks_column(F.col("text"), chunk).alias("chunks"))
        each = cut.select(key, F.size("chunks").alias("n"), F.posexplode("chunks").alias("i", "chunk"))
        ask = lambda b: pd.DataFrame({key: b[key], "n": b["n"], "i": b["i"], "points": [model.points(c, i + 1, n) for c, i, n in zip(b["chunk"], b["i"], b["n"], strict=True)]})
        points = _asked(each, f"{key} {kind}, n int, i int, points array<string>", ask)
        kept = F.transform(F.filter(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "points"))), lambda x: x["points"])), lambda p: F.trim(p) != ""), F.trim)
        return points.groupBy(key).agg(F.array_join(F.transform(kept, lambda p: F.concat(F.lit("- "), p)), "\n").alias("text"), F.max("n").alias("sections"))

    # each round is stored, so the model sees a chunk once; only what is over the budget goes on to the next
    now, settled = stored(condensed(long), "points"), []
    for _ in range(MOST_ROUNDS - 1):
        over = now.where(F.length("text") > budget)
        settled.append(now.where(F.length("text") <= budget))
        if over.isEmpty():
            now = over
            break
        again = stored(condensed(over.select(key, "text")), "points").select(key, F.col("text").alias("less"))
        met = over.join(again, key, "left")
        now = met.select(key, F.when(F.col("less").isNotNull() & (F.col("less") != "") & (F.length("less") < F.length("text")), F.col("less")).otherwise(F.col("text")).alias("text"), "sections")
    ready = short.union(now)
    for part in settled:
        ready = ready.union(part)
    fitted = ready.select(key, F.substring("text", 1, budget).alias("text"), F.greatest(F.lit(0), F.length("text") - budget).alias("truncated_chars"), "sections")

    def ask(b: pd.DataFrame) -> pd.DataFrame:
        got = [model.summary(t) for t in b["text"]]
        return b[[key, "truncated_chars", "sections"]].assign(**{k: [g.get(k) for g in got] for k in ("title", "tldr", "summary", "tags")})

    return _asked(fitted, f"{key} {kind}, truncated_chars int, sections int, title string, tldr string, summary string, tags array<string>", ask)
