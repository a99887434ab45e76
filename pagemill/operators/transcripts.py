"""Repeats in transcripts: sentences, their times, and runs of repeated ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions.text import sentence_key

MIN_WORDS = 8


def segment_offsets(transcript: DataFrame, key: str) -> DataFrame:
    """transcript (key, number, start, text) with the character at which each segment begins in the joined text."""
    before = Window.partitionBy(key).orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return transcript.withColumn("at", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))


def transcript_sentences(transcript: DataFrame, key: str) -> DataFrame:
    """key, n, sentence, k (normalized), words and at (character offset) over the joined transcript."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda s: s["text"])
    joined = transcript.groupBy(key).agg(F.array_join(texts, " ").alias("text"))
    parts = F.filter(F.transform(F.split("text", r"(?<=[.!?])\s+"), F.trim), lambda s: s != "")
    rows = joined.select(key, F.posexplode(parts).alias("n", "sentence"))
    before = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("sentence") + 1).over(before), F.lit(0))).withColumn("k", sentence_key(F.col("sentence")))
    return rows.withColumn("words", F.size(F.filter(F.split("k", " +"), lambda w: w != "")))


def repeated_sentences(rows: DataFrame, key: str, least: int = MIN_WORDS) -> DataFrame:
    """The sentences with `times`, how often they are spoken (1 for short ones)."""
    counts = rows.where(F.col("words") >= least).groupBy(key, "k").agg(F.count("*").alias("times"))
    return rows.join(counts, [key, "k"], "left").withColumn("times", F.coalesce("times", F.lit(1)))


def repeat_places(rows: DataFrame, key: str, most: int = 8) -> DataFrame:
    """key, k, times and places (n of the first `most`, in order) of each repeated sentence. rows: of `repeated_sentences`.

    Tasks pass on `most` rows of a sentence each (a rank limit works before the shuffle too), so one that is spoken everywhere isn't gathered.
    """
    rank = F.row_number().over(Window.partitionBy(key, "k").orderBy("n"))
    shown = rows.where("times > 1").select(key, "k", "n", "times", rank.alias("rank")).where(F.col("rank") <= most)
    return shown.groupBy(key, "k").agg(F.max("times").alias("times"), F.sort_array(F.collect_list("n")).alias("places"))


def repeat_runs(rows: DataFrame, key: str) -> DataFrame:
    """key, first, sentences: runs of two or more neighbouring repeated sentences, as islands."""
    marked = rows.where("times > 1").withColumn("island", F.col("n") - F.row_number().over(Window.partitionBy(key).orderBy("n")))
    return marked.groupBy(key, "island").agg(F.min("n").alias("first"), F.count("*").alias("sentences")).where("sentences >= 2").drop("island")


def timed(rows: DataFrame, offsets: DataFrame, key: str) -> DataFrame:
    """Sentences with the start of the last segment that begins at or before them: an as-of join as one window."""
    marks = offsets.select(key, F.col("at").alias("place"), F.lit(0).alias("kind"), F.col("start").alias("mark"), F.lit(None).cast("int").alias("n"))
    asks = rows.select(key, F.col("at").alias("place"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("mark"), "n")
    last = F.last("mark", ignorenulls=True).over(Window.partitionBy(key).orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = marks.unionByName(asks).withColumn("start", F.coalesce(last, F.lit(0.0))).where("kind = 1").select(key, "n", "start")
    return rows.join(found, [key, "n"])


def minutes(seconds: Column) -> Column:
    """mm:ss."""
    return F.format_string("%02d:%02d", F.floor(seconds / 60).cast("int"), F.floor(seconds % 60).cast("int"))
