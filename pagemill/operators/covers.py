"""What a cover shows: the style that a setting or the model chooses, and the scene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import rules, text as t
from pagemill.functions.rx import strip

HEAD_CHARS = 6000


def planned(docs: DataFrame) -> DataFrame:
    """docs with style and scene. docs: choice, key (decides a random style), answer (the model's JSON, null if it failed).

    off and an empty choice give no cover; an unknown style, and a model's answer that isn't one, give the fallback; a
    failed answer has no scene.
    """
    choice = F.lower(strip(F.coalesce(F.col("choice"), F.lit(""))))
    names = F.array(*[F.lit(s) for s in rules.COVER_STYLES])
    answer = F.from_json("answer", "scene string, style string", {"mode": "PERMISSIVE"})
    drawn = F.element_at(names, (F.pmod(F.xxhash64("key"), F.lit(len(rules.COVER_STYLES))) + 1).cast("int"))
    picked = F.lower(strip(F.coalesce(answer["style"], F.lit(""))))
    auto = F.when(F.array_contains(names, picked), picked).otherwise(rules.FALLBACK_STYLE)
    style = F.when(choice.isin("", "off"), "off").when(choice == "random", drawn).when(choice == "auto", auto).when(F.array_contains(names, choice), choice).otherwise(rules.FALLBACK_STYLE)
    rows = docs.withColumn("style", style)
    return rows.withColumn("scene", F.when(F.col("style") == "off", "").otherwise(strip(F.coalesce(answer["scene"], F.lit("")))))


def asked(title: Column, tldr: Column, tags: Column, summary: Column) -> Column:
    """What the model is asked about: title, short summary, tags and the head of the summary."""
    return F.concat_ws("\n", F.concat(F.lit("Title: "), title), F.concat(F.lit("TL;DR: "), tldr), F.concat(F.lit("Tags: "), F.array_join(tags, ", ")), F.concat(F.lit("Summary: "), F.substring(summary, 1, HEAD_CHARS)))


def prompt(scene: Column, title: Column, style: Column) -> Column:
    """The picture's prompt: the scene without lettering, else the title, else a default; the style's words last."""
    words = F.element_at(F.create_map(*[F.lit(x) for pair in rules.COVER_STYLES.items() for x in pair]), style)
    some = lambda c: F.nullif(strip(c), F.lit(""))
    subject = F.coalesce(some(t.clean_scene(scene)), some(title), F.lit("an open book on a desk"))
    return F.concat(F.regexp_replace(subject, r"\.+$", ""), F.lit(", "), words)
