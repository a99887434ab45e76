"""Listening scripts: a summary chapter, then the document's own sections as chapters of bounded segments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import folds, rules, text as t
from pagemill.functions.rx import let, strip
from pagemill.operators.lines import prepared
from pagemill.storage import bounded_batches


def chapter_title(heading: Column) -> Column:
    """Without what text layers leave of accents, cleaned and cut at a word."""
    bare = F.regexp_replace(heading, r"(?U)\s?[¯˙˘´`\^¨˜]\s?|\.(?=[a-z])", "")
    return let(bare, lambda b: chapter_label(b, heading))


def chapter_label(heading: Column, otherwise: Column | None = None) -> Column:
    """A heading cleaned and cut at a word; `otherwise` (the heading itself) where cleaning leaves nothing."""
    otherwise = heading if otherwise is None else otherwise
    label = F.regexp_replace(strip(F.regexp_replace(t.clean_body(heading), r"\.+$", "")), r"^[™©®†‡*# ]+", "")
    label = F.coalesce(F.nullif(label, F.lit("")), strip(otherwise))

    def shortened(label: Column) -> Column:
        head = F.substring(label, 1, rules.CHAPTER_TITLE_CHARS)
        cut = F.when(head.contains(" "), F.regexp_replace(head, r"(?s) [^ ]*$", "")).otherwise(head)
        return F.when(F.length(label) <= rules.CHAPTER_TITLE_CHARS, label).otherwise(F.concat(cut, F.lit("...")))

    return let(label, shortened)


def scripts(docs: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """key, chapter_no, title, segment_no, segment. docs: key, kind, title, tldr, summary, text and, if known, words (`lines.known_words`).

    One row a document from beginning to end: sections and segments go through Python once each, nothing is joined.
    """
    words = F.col("words") if "words" in docs.columns else None
    base = docs.select(F.col(key).alias("key"), "kind", "title", "tldr", "summary", prepared(F.col("text"), words).alias("ready"))

    def structured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ready = [folds.reflow(t) if k == "pdf" else t for k, t in zip(b["kind"], b["ready"], strict=True)]
            parts = [[{"heading": h, "body": x} for h, x in folds.consolidated(folds.sections(t))] for t in ready]
            yield b.assign(ready=ready, parts=parts)

    schema = f"key {dict(docs.dtypes)[key]}, kind string, title string, tldr string, summary string, ready string, parts array<struct<heading:string,body:string>>"
    bounded_batches(docs.sparkSession)
    base = base.mapInPandas(structured, schema).withColumnRenamed("key", key)
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    opening = F.concat(F.coalesce(F.nullif(strip(F.col("title")), F.lit("")), F.lit("Untitled")), F.lit(".\n\nSummary.\n\n"), some("tldr"), F.lit("\n\n"), some("summary"))
    chapter = lambda n, title, spoken: F.struct(n.cast("int").alias("chapter_no"), title.alias("title"), spoken.alias("spoken"))
    led = lambda first, spoken: F.when(first & (spoken != ""), F.concat(F.lit(rules.LEAD + "\n\n"), spoken)).otherwise(spoken)

    def section(part: Column, i: Column) -> Column:
        bare = F.regexp_replace(part["heading"], r"(?U)\s?[¯˙˘´`\^¨˜]\s?|\.(?=[a-z])", "")
        return let(t.clean_body(F.concat(bare, F.lit(".\n\n"), part["body"])), lambda spoken: chapter(i + 1, chapter_title(part["heading"]), led(i == 0, spoken)))

    sections = F.filter(F.transform("parts", section), lambda c: c["spoken"] != "")
    flat = F.filter(F.array(let(t.clean_body(F.coalesce("ready", F.lit(""))), lambda body: chapter(F.lit(1), F.lit("Full article"), led(F.lit(True), body)))), lambda c: c["spoken"] != "")
    rest = let(F.when(F.size("parts") >= 2, sections).otherwise(F.array().cast("array<struct<chapter_no:int,title:string,spoken:string>>")), lambda found: F.when(F.size(found) > 0, found).otherwise(flat))
    chapters = F.concat(F.array(chapter(F.lit(0), F.lit("Summary"), t.clean_body(prepared(opening)))), rest)
    rows = base.select(key, F.explode(chapters).alias("c")).select(key, "c.*")
    return rows.select(key, "chapter_no", "title", F.posexplode(folds.segments_column(F.col("spoken"), most)).alias("segment_no", "segment"))
