"""Chat: which messages are work, what they ask for, and what commands set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import rules, text as t
from pagemill.functions.rx import strip
from pagemill.operators.queueing import settings_upsert

EVENT = "kind string, bot_id string, subtype string, channel_type string, channel string, ts string, thread_ts string, user string, text string, files array<string>"


def drop_channels(setting: Column) -> Column:
    """The channels of a comma-separated setting, in order, each once."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(setting, F.lit("")), ","), strip), lambda x: x != "")))


def actions(events: DataFrame, channels: Column, bot: str) -> DataFrame:
    """events with action (ignore, cancel, file, link, help, quiet), target and thread. events: `EVENT`'s columns.

    A bot's own messages, edits and other subtypes are ignored; so are messages of channels that aren't direct, unless
    the channel is one of `channels` (an array) and the bot isn't mentioned, for mentions come as events of their own.
    A cancel counts only as a reply without files.
    """
    c = F.col
    text = F.coalesce(c("text"), F.lit(""))
    own = c("bot_id").isNotNull() | F.coalesce(c("subtype") == "bot_message", F.lit(False))
    plain = c("subtype").isNull() | (c("subtype") == "file_share")
    dropped = (c("channel_type") == "channel") & F.array_contains(channels, c("channel")) & ~text.contains(f"<@{bot}>")
    heard = F.coalesce((c("kind") == "app_mention") | (c("channel_type") == "im") | dropped, F.lit(False))
    files = F.size(F.coalesce(c("files"), F.array().cast("array<string>"))) > 0
    link = t.first_url(text)
    action = (
        F.when(own | ~plain | ~heard, "ignore").when(c("thread_ts").isNotNull() & ~files & t.is_cancel(text), "cancel").when(files, "file")
        .when(link.isNotNull(), "link").when(t.is_help(text), "help").otherwise("quiet")
    )
    rows = events.withColumn("action", action)
    target = F.when(c("action") == "file", F.coalesce(F.nullif(F.get(c("files"), 0), F.lit("")), F.lit("upload"))).when(c("action") == "link", link)
    return rows.withColumns({"target": target, "thread": F.coalesce("thread_ts", "ts")})


def outcomes(jobs: DataFrame, most: int) -> DataFrame:
    """jobs with reply and requeue. jobs: label, attempts (before this one), error (null, input, transient, crash), detail."""
    c = F.col
    tries = c("attempts") + 1
    again = F.coalesce(c("error") == "transient", F.lit(False)) & (tries < most)
    failed = F.concat(F.lit("Sorry — "), c("label"), F.lit(" failed"))
    reply = (
        F.when(c("error") == "input", F.concat(failed, F.lit(": "), c("detail")))
        .when((c("error") == "transient") & ~again, F.concat(failed, F.lit(" after "), tries.cast("string"), F.lit(" attempts: "), c("detail")))
        .when(c("error") == "crash", F.concat(failed, F.lit(" unexpectedly.")))
    )
    return jobs.withColumns({"requeue": again, "reply": reply})


def scope(text: Column, user: Column) -> tuple[Column, Column]:
    """The argument of a command and whose setting it is: a last word 'default' means everyone's (null)."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    shared = F.coalesce(F.lower(F.try_element_at(words, F.lit(-1))) == "default", F.lit(False))
    return F.array_join(F.when(shared, F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words), " "), F.when(~shared, F.nullif(user, F.lit("")))


def commands(rows: DataFrame, voices: Column) -> DataFrame:
    """ts, user, key, value and reply of chat commands; value is null where nothing is set. rows: ts, user, command, text, current.

    command: voice, format, cover, tts (`rules.COMMANDS`); current: the sender's value of that setting, which a bare
    toggle flips. voices: an array of those that are served.
    """
    argument, whose = scope(F.col("text"), F.col("user"))
    key = F.element_at(F.create_map(*[F.lit(x) for pair in rules.COMMANDS.items() for x in pair]), F.col("command"))
    cut = rows.select("ts", "command", "current", whose.alias("user"), key.alias("key"), argument.alias("wanted"))
    low = F.lower("wanted")
    near = F.slice(F.filter(voices, lambda v: F.lower(v).contains(low)), 1, 3)
    voice = F.array_contains(voices, F.col("wanted"))
    hint = F.concat(F.lit("unknown voice"), F.when(F.size(near) > 0, F.concat(F.lit(", near "), F.array_join(near, ", "))).otherwise(""))
    listed = lambda names: low.isin(names)
    flipped = F.when(F.lower("current") == "true", "false").otherwise("true")
    value = (
        F.when((F.col("command") == "voice") & voice, F.col("wanted")).when((F.col("command") == "format") & listed(rules.NOTE_FORMATS), low)
        .when((F.col("command") == "cover") & listed(rules.COVER_CHOICES), low)
        .when(F.col("command") == "tts", F.when(low == "on", "true").when(low == "off", "false").when(low == "", flipped))
    )
    shown = F.when(F.col("user").isNull(), "for everyone by default").otherwise("for you")
    reply = (
        F.when(F.col("value").isNotNull(), F.concat(F.col("key"), F.lit(" is "), F.col("value"), F.lit(" "), shown)).when((F.col("command") != "tts") & (low == ""), F.concat(F.col("key"), F.lit(" is "), F.col("current")))
        .when(F.col("command") == "voice", hint).when(F.col("command") == "tts", "on, off, or nothing to flip").otherwise("one of the choices, please")
    )
    return cut.withColumn("value", value).withColumn("reply", reply).select("ts", "user", "key", "value", "reply")


def applied(layers: DataFrame, found: DataFrame) -> DataFrame:
    """Settings after `commands`."""
    return settings_upsert(layers, found.where("value is not null").select("ts", "user", "key", "value"))
