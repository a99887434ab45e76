"""Settings over time: commands become intervals in which a value holds; late ones split what was there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import rules
from pagemill.operators.scans import running
from pagemill.storage import stored

#: Whose a setting is (null: everyone's), its value (null: removed, which has to be known where commands come late), and from when until when it holds (null: still).
HISTORY = ["user", "key", "value", "valid_from", "valid_to"]


def intervals(commands: DataFrame) -> DataFrame:
    """`HISTORY` of commands (ts, seq, user, key, value): each value until the next command for that user and key; an empty one removes the setting (value null).

    Keys that chat may not set are left out; of commands of one time the last in seq counts. A value that is set again begins anew.
    """
    rows = commands.where(F.col("key").isin(rules.ALLOWED_KEYS)).select("ts", "seq", "user", "key", F.coalesce("value", F.lit("")).alias("value"))
    place = F.struct("ts", "seq")
    rows = rows.withColumns({"_back": -F.unix_micros(F.col("ts").cast("timestamp")), "_low": -F.col("seq"), "place": place})
    key = F.struct(F.col("_back").alias("back"), F.col("_low").alias("low"))
    # the next command is the nearest of those behind: the greatest so far, from the end backwards
    following = running(rows, ["user", "key"], ["_back", "_low"], F.max, key, "_next", inclusive=False)
    until = F.timestamp_micros(-F.col("_next.back")).cast(dict(commands.dtypes)["ts"])
    return following.withColumn("valid_to", until).where("valid_to is null or valid_to > ts").select("user", "key", F.nullif("value", F.lit("")).alias("value"), F.col("ts").alias("valid_from"), "valid_to")


def merged(history: DataFrame, commands: DataFrame) -> DataFrame:
    """history after more commands, some of which may be older than what it holds; only the users and keys they name are made anew.

    A command and a start of history at one time: the command counts.
    """
    touched = commands.select("user", "key").distinct().withColumnRenamed("user", "_user").withColumnRenamed("key", "_key")
    same = F.col("user").eqNullSafe(F.col("_user")) & F.col("key").eqNullSafe(F.col("_key"))
    stay, old = history.join(touched, same, "left_anti"), history.join(touched, same, "left_semi")
    starts = old.select(F.col("valid_from").alias("ts"), F.lit(-1).cast("long").alias("seq"), "user", "key", "value")
    new = commands.select("ts", F.col("seq").cast("long").alias("seq"), "user", "key", "value")
    return stay.select(*HISTORY).unionByName(intervals(starts.unionByName(new)))


def settings_at(asks: DataFrame, history: DataFrame) -> DataFrame:
    """asks (user, at, and more) with settings, a map of each key's value then: the user's own where there is one, else everyone's."""
    ask = stored(asks.withColumn("_ask", F.monotonically_increasing_id()), "asks")
    kind = dict(asks.dtypes)["at"]
    each = ask.select("_ask", "user", F.col("at"), F.explode(F.array(*map(F.lit, rules.ALLOWED_KEYS))).alias("key"))
    each = each.select("_ask", F.explode(F.array_distinct(F.array("user", F.lit(None).cast("string")))).alias("user"), "at", "key")
    marks = history.select(F.lit(None).cast("long").alias("_ask"), "user", F.col("valid_from").cast(kind).alias("at"), "key", F.struct("valid_from", "value", "valid_to").alias("mark"))
    both = each.withColumn("mark", F.when(F.lit(False), F.struct(*[F.lit(None).cast(dict(history.dtypes)[c]).alias(c) for c in ("valid_from", "value", "valid_to")])))
    both = marks.unionByName(both).withColumn("_kind", F.col("_ask").isNotNull().cast("int"))
    # starts come in order, so the last so far is the greatest
    found = running(both, ["user", "key"], ["at", "_kind"], F.max, F.col("mark"), "_last").where("_kind = 1")
    holds = F.col("_last.value").isNotNull() & (F.col("_last.valid_to").isNull() | (F.col("_last.valid_to") > F.col("at")))
    own = found.where(holds).groupBy("_ask", "key").agg(F.max_by("_last.value", F.col("user").isNotNull()).alias("value"))
    settings = own.groupBy("_ask").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("settings"))
    return ask.join(settings, "_ask", "left").withColumn("settings", F.coalesce("settings", F.create_map().cast("map<string,string>"))).drop("_ask")


def sections(layers: DataFrame) -> DataFrame:
    """user and body, the JSON of each user's settings (null: everyone's). layers: user, key, value."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))
    return layers.where(F.col("key").isin(rules.ALLOWED_KEYS) & F.col("value").isNotNull()).groupBy("user").agg(F.to_json(entries).alias("body"))


def layers(sections: DataFrame) -> DataFrame:
    """user, key and value of sections as they are read; one that isn't a JSON object holds nothing, and neither do keys that chat may not set."""
    found = sections.select("user", F.explode(F.from_json("body", "map<string,string>")).alias("key", "value"))
    return found.where(F.col("key").isin(rules.ALLOWED_KEYS) & F.col("value").isNotNull())

