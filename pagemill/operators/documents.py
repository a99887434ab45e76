"""Documents from pages: assembly, routing, profiles, notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import rules, text as t
from pagemill.functions.folds import collapse_column
from pagemill.functions.rx import strip, unspaced_length


def assembled(pages: DataFrame, key: str) -> DataFrame:
    """key and text: non-blank pages in order, a blank line between; empty for a document of blank pages. pages: key, number, text."""
    page = F.when(strip(F.col("text")) != "", F.struct("number", "text"))
    texts = F.transform(F.array_sort(F.collect_list(page)), lambda p: p["text"])
    return pages.groupBy(key).agg(F.array_join(texts, "\n\n").alias("text"))


def profile(pages: DataFrame, key: str) -> DataFrame:
    """pages, ocr_pages, seconds, methods and the summary line of each document. pages: key, method, seconds."""
    methods = F.array_sort(F.collect_set("method"))
    named = F.filter(methods, lambda m: m != "skipped")
    return pages.groupBy(key).agg(
        F.count("*").alias("pages"), F.count_if(F.col("method") == "ocr").alias("ocr_pages"), F.round(F.sum("seconds"), 6).alias("seconds"),
        F.coalesce(F.nullif(F.array_join(named, "+"), F.lit("")), F.lit("none")).alias("methods"),
        F.when(F.size(methods) > 1, "mixed").otherwise(methods[0]).alias("summary_line"),
    )


def routed(pages: DataFrame, key: str, cap: int = 0) -> DataFrame:
    """pages with method (text-layer, ocr, skipped) and reason; beyond `cap` OCR pages a document's are skipped (0: no cap)."""
    needs = F.coalesce(unspaced_length(F.col("text")) < rules.MIN_PAGE_CHARS, F.lit(True))
    ranked = pages.withColumn("needs", needs).withColumn("nth", F.sum(F.col("needs").cast("int")).over(Window.partitionBy(key).orderBy("number")))
    over = F.col("needs") & (F.lit(cap) > 0) & (F.col("nth") > cap)
    return ranked.select(*pages.columns, F.when(over, "skipped").when(F.col("needs"), "ocr").otherwise("text-layer").alias("method"), F.when(over, "OCR page cap").alias("reason"))


def size_scan(pages: DataFrame, key: str, most: int = 5, *more: Column) -> DataFrame:
    """chars of the pages with enough text and ocr_pages, how many lack it (`most` at most), and `more` aggregates in the same pass. pages: key, text."""
    enough = F.coalesce(unspaced_length(F.col("text")) >= rules.MIN_PAGE_CHARS, F.lit(False))
    chars = F.coalesce(F.sum(F.when(enough, F.length("text"))), F.lit(0)).cast("long")
    return pages.groupBy(key).agg(chars.alias("chars"), F.least(F.lit(most).cast("long"), F.count_if(~enough)).alias("ocr_pages"), *more)


def cached(pages: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Pages with what an earlier attempt stored, where it did. cache: key, number, text, method, reason."""
    old = cache.select(key, "number", F.col("text").alias("old_text"), F.col("method").alias("old_method"), F.col("reason").alias("old_reason"))
    met = pages.join(old, [key, "number"], "left")
    hit = F.col("old_method").isNotNull()
    return met.select(key, "number", *[F.when(hit, F.col(f"old_{c}")).otherwise(F.col(c)).alias(c) for c in ("text", "method", "reason")], hit.alias("from_cache"))


def ocr_outcome(text: Column, seconds: Column, complete: Column, timed_out: Column, limit_s: float, limit_tokens: int) -> Column:
    """struct<text, method, seconds, reason> of one page's OCR: a transcription that starts over is cut there; a timeout or a run to the cap skips the page, its text discarded."""
    empty = F.lit("")
    return (
        F.when(timed_out, F.struct(empty.alias("text"), F.lit("skipped").alias("method"), F.lit(float(limit_s)).alias("seconds"), F.lit(f"OCR timed out after {limit_s:.0f}s").alias("reason")))
        .when(~complete, F.struct(empty.alias("text"), F.lit("skipped").alias("method"), seconds.cast("double").alias("seconds"), F.lit(f"OCR runaway, cut at {limit_tokens} tokens").alias("reason")))
        .otherwise(F.struct(strip(t.normalize_latex(collapse_column(text)["text"])).alias("text"), F.lit("ocr").alias("method"), seconds.cast("double").alias("seconds"), F.lit(None).cast("string").alias("reason")))
    )


def scaled(width: Column, height: Column, longest: int = 1500) -> Column:
    """struct<width, height> with the longest edge capped, one pixel at least."""
    edge = F.greatest(width, height)
    side = lambda c: F.when(edge <= longest, c).otherwise(F.greatest(F.lit(1), F.bround(c * F.lit(longest) / edge, 0))).cast("int")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def dispatched(target: Column, exists: Column) -> tuple[Column, Column]:
    """kind (link, pdf, image) and error of a target."""
    suffix = F.lower(F.regexp_extract(target, r"\.([^./]+)$", 1))
    link = target.rlike(r"^https?://")
    kind = F.when(link, "link").when(exists & (suffix == "pdf"), "pdf").when(exists & suffix.isin(rules.IMAGE_SUFFIXES), "image")
    error = F.when(link, None).when(~exists, "not a file or URL").when(~((suffix == "pdf") | suffix.isin(rules.IMAGE_SUFFIXES)), "unsupported file type")
    return kind, error.cast("string")


def skip_reasons(pages: DataFrame, key: str) -> DataFrame:
    """skipped_pages and skip_reasons (distinct, sorted) of each document. pages: key, number, method, reason."""
    skipped = F.col("method") == "skipped"
    told = F.when(skipped & (F.coalesce("reason", F.lit("")) != ""), F.col("reason"))
    return pages.groupBy(key).agg(F.count_if(skipped).alias("skipped_pages"), F.sort_array(F.collect_set(told)).alias("skip_reasons"))


def provenance(docs: DataFrame, created: str, model: str) -> Column:
    """One line on how a document came about; parts that don't apply are left out."""
    c = F.col
    skipped = F.when(c("skipped_pages") > 0, F.concat(F.lit("**"), c("skipped_pages").cast("string"), F.lit(" page(s) SKIPPED"), F.when(F.size("skip_reasons") > 0, F.concat(F.lit(" ("), F.array_join("skip_reasons", "; "), F.lit(")"))).otherwise(""), F.lit("**")))
    return F.concat_ws(
        " · ", F.lit(f"Ingested: {created}"), F.concat(F.lit("Pages: "), c("pages").cast("string")), F.concat(F.lit("Extraction: "), c("methods")), F.lit(f"Model: {model}"),
        F.when(c("ocr_pages") > 0, F.format_string("OCR: %d page(s), %ss", c("ocr_pages"), F.bround(c("seconds"), 0).cast("long").cast("string"))), skipped,
        F.when(c("sections") > 1, F.format_string("Summarized in %d sections (map-reduce)", c("sections"))),
        F.when(c("truncated_chars") > 0, F.format_string("**%d chars truncated to fit context**", c("truncated_chars"))),
    )


def note(title: Column, source: Column, kind: Column, own_title: Column, tags: Column, created: str, origin: Column, tldr: Column, summary: Column, text: Column) -> Column:
    """A note in markdown: front matter, source, short and long summary, the text folded away."""
    link = F.concat(F.lit("["), F.coalesce(own_title, source), F.lit("]("), source, F.lit(")"))
    parts = [
        F.lit("---"), F.concat(F.lit("tags: ["), F.array_join(tags, ", "), F.lit("]")), F.lit(f"created: {created}"), F.concat(F.lit("Sources: "), source), F.concat(F.lit("type: "), kind), F.lit("---"),
        F.concat(F.lit("# "), title), F.lit(""), F.concat(F.lit("> Source: "), F.when(kind == "link", link).otherwise(F.concat(F.lit("`"), source, F.lit("`")))), F.concat(F.lit("> "), origin), F.lit(""),
        F.lit("## TL;DR"), F.lit(""), tldr, F.lit(""), F.lit("---"), F.lit(""), F.lit("## Summary"), F.lit(""), t.demote_headings(summary), F.lit(""), F.lit("---"), F.lit(""),
        F.lit("## Source Text"), F.lit(""), t.callout(text), F.lit(""),
    ]
    return F.array_join(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), "\n")
