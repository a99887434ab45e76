"""The shelf: who owns an item, which ones a back-fill may touch, tags, collections, chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import rules
from pagemill.functions.text import voice_group
from pagemill.operators.scans import numbered

SAMPLES_TITLE = "voice samples"


def known_people(items: DataFrame, person: str) -> DataFrame:
    """tag of everyone who owns something: tags that start with a capital, and the person."""
    tags = items.select(F.explode("tags").alias("tag")).where(F.col("tag").rlike(r"^\p{Lu}")).distinct()
    return tags.union(items.sparkSession.createDataFrame([(person,)], "tag string")).distinct()


def candidates(items: DataFrame, person: str, titles: list[str] | None = None, samples: str = SAMPLES_TITLE) -> DataFrame:
    """Items nobody else has claimed and that still lack the person or carry a leftover series."""
    owners = F.filter("tags", lambda x: x.rlike(r"^\p{Lu}") | (x == person))
    mine = F.array_contains("tags", person)
    rows = items.where((F.col("title") != samples) & ((F.size(owners) == 0) | F.forall(owners, lambda x: x == person)) & ~(mine & (F.coalesce(F.col("series"), F.lit("")) == "")))
    return rows.where(F.col("title").isin(titles)) if titles is not None else rows


def retagged(tags: Column, person: str) -> Column:
    """The tags with the person as their only owner, sorted."""
    others = F.filter(tags, lambda x: ~(x.rlike(r"^\p{Lu}") | (x == person)))
    return F.array_sort(F.array_distinct(F.concat(others, F.array(F.lit(person)))))


def cover_gaps(items: DataFrame, force: bool = False) -> DataFrame:
    return items.withColumn("status", F.when(F.col("has_cover") & F.lit(not force), "skipped").otherwise("todo"))


def collection_actions(wanted: DataFrame, collections: DataFrame) -> DataFrame:
    """wanted (item, library, name) with action: create, add, or none where it's already a member. collections: library, name, item of every member."""
    members = collections.select("library", "name", "item", F.lit(True).alias("member")).distinct()
    names = collections.select("library", "name", F.lit(True).alias("there")).distinct()
    met = wanted.join(members, ["library", "name", "item"], "left").join(names, ["library", "name"], "left")
    return met.withColumn("action", F.when(F.col("there").isNull(), "create").when(F.col("member"), "none").otherwise("add")).drop("member", "there")


def metadata_patch(title: Column, author: Column, narrator: Column, tags: Column, clear_series: bool = False) -> Column:
    """A JSON patch of the fields that aren't empty, with an empty list of series if they are to go; null when there is nothing to patch."""
    some = lambda c: F.nullif(c, F.lit(""))
    fields = [some(title).alias("title"), some(author).alias("author"), some(narrator).alias("narrator"), F.when(F.size(tags) > 0, tags).alias("tags")]
    fields = F.struct(*fields, *([F.array().cast("array<string>").alias("series")] if clear_series else []))
    return F.nullif(F.to_json(fields), F.lit("{}"))


def newest(items: DataFrame, n: int = 10) -> DataFrame:
    """The n items added last."""
    return items.orderBy(F.desc("added_at"), "id").limit(n)


def chapter_offsets(chapters: DataFrame, key: str) -> DataFrame:
    """chapters with start_ms and end_ms. chapters: key, chapter_no, seconds."""
    ms = F.bround(F.col("seconds") * 1000, 0).cast("long")
    before = Window.partitionBy(key).orderBy("chapter_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(ms).over(before), F.lit(0)).cast("long")
    return chapters.withColumn("start_ms", start).withColumn("end_ms", start + ms)


def outline(chapters: DataFrame, key: str, source: Column) -> DataFrame:
    """key and outline, what is known of an item without a summary: its source, and its chapters' titles but the generic ones. chapters: key, chapter_no, title."""
    own = F.when(~F.lower(F.trim("title")).isin(rules.GENERIC_CHAPTERS), F.struct("chapter_no", "title"))
    lines = F.transform(F.array_sort(F.collect_list(own)), lambda x: F.concat(F.lit("- "), x["title"]))
    found = chapters.groupBy(key).agg(lines.alias("lines"))
    body = F.when(F.size("lines") > 0, F.concat(F.lit("\n\nChapters:\n"), F.array_join("lines", "\n"))).otherwise("")
    return found.select(key, F.concat(F.lit("Source: "), source, body).alias("outline"))


def metadata_title(title: Column) -> Column:
    """A title that can't break a line-based metadata file."""
    return F.replace(F.replace(title, F.lit("\n"), F.lit(" ")), F.lit("="), F.lit("-"))


def wav_seconds(data: Column, rate: int = 24_000, frame_bytes: int = 2) -> Column:
    """Length of a WAV file's sound: what follows the head of its data chunk, whatever the lengths in the header say.

    Rate and width of a frame are the header's; the parameters count where it has none. Null without a data chunk.
    """
    place = lambda word: F.position(F.unhex(F.lit(word.encode().hex())), data)
    at, form = place("data"), place("fmt ")
    number = lambda first, n: F.conv(F.concat(*[F.hex(F.substring(data, form + first + i, 1)) for i in reversed(range(n))]), 16, 10).cast("long")
    frame = F.when(form > 0, number(10, 2) * number(22, 2) / 8).otherwise(F.lit(float(frame_bytes)))
    per_second = F.when(form > 0, number(12, 4)).otherwise(F.lit(rate)) * frame
    return F.when((at > 0) & (per_second > 0), (F.length(data) - (at - 1) - 8) / per_second)


def grouped_voices(voices: DataFrame) -> DataFrame:
    """group_rank, group, place (from 0) and voice: by language and gender, English first; newer voices before older ones of a group."""
    names = list(rules.LANGUAGES.values())
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.substring_index("group", ",", 1)), F.lit(0))
    rows = voices.select("voice", voice_group(F.col("voice")).alias("group"), F.col("voice").contains("_v0").cast("int").alias("old"))
    return numbered(rows, ["group"], ["old", "voice"], "place").select(F.when(rank == 0, len(names) + 1).otherwise(rank).alias("group_rank"), "group", "place", "voice")


def kept_voices(voices: DataFrame) -> DataFrame:
    """The voices of the languages that are offered."""
    return voices.where(F.substring("voice", 1, 3).isin(rules.KEPT_VOICES))


def near_voices(voices: DataFrame, wanted: str, most: int = 3) -> DataFrame:
    """The first voices, by name, that hold what was asked for in any case."""
    return voices.where(F.lower("voice").contains(wanted.lower())).orderBy("voice").limit(most)
