"""Queries of chat, commands, covers, hand-off between stages, and variants of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import rules, text as t, variants
from pagemill.functions.rx import quoted, sql_apply, sql_pattern, sql_strip
from pagemill.operators import chat, covers, documents as d, lines, queueing as q
from pagemill.plans.jobs import _CALIBRATED, _JOBS, _VOICES_SQL, _jobs, _observations, _replay_sql, _voices
from pagemill.plans.registry import query, table
from pagemill.plans.texts import _KEY_SQL, _MARKED_SQL, _clean_sql, _marked
from pagemill.sources import records
from pagemill.storage import own_folder
from pagemill.streaming import queue as streams

# --- chat ----------------------------------------------------------------------------------------


def _events(spark, sf_dir):
    """Turns as chat events of every kind."""
    c, m = F.col, F.col("turn") % 7
    text = F.when(m == 0, "cancel").when(m == 1, F.concat(F.lit("see <https://a.example/"), c("conv_id").cast("string"), F.lit("|it> "), "text")).when(m == 2, "!help").when(m == 3, F.concat(F.lit("<@B0> "), "text")).otherwise(c("text"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(c("turn") % 5 == 0, "app_mention").otherwise("message").alias("kind"), F.when(c("role") == "assistant", "B0").alias("bot_id"), F.when(c("conv_id") % 9 == 0, "message_changed").when(m == 4, "file_share").alias("subtype"),
        F.when(c("conv_id") % 3 == 0, "im").otherwise("channel").alias("channel_type"), F.concat(F.lit("C"), (c("conv_id") % 4).cast("string")).alias("channel"), F.concat(c("conv_id").cast("string"), F.lit("."), c("turn").cast("string")).alias("ts"),
        F.when(c("turn") % 2 == 0, c("conv_id").cast("string")).alias("thread_ts"), c("role").alias("user"), text.alias("text"), F.when(m == 4, F.array(F.concat(F.lit("f"), c("turn").cast("string"), F.lit(".pdf")))).alias("files"),
    )


@query(f"""
WITH e AS (SELECT conv_id, turn, turn % 5 = 0 AS mention, role = 'assistant' AS bot, conv_id % 9 = 0 AS changed, turn % 7 = 4 AS files, conv_id % 3 = 0 AS im, 'C' || conv_id % 4 AS channel, turn % 2 = 0 AS reply,
  CASE turn % 7 WHEN 0 THEN 'cancel' WHEN 1 THEN 'see <https://a.example/' || conv_id || '|it> ' || text WHEN 2 THEN '!help' WHEN 3 THEN '<@B0> ' || text ELSE text END AS text FROM conversations),
u AS (SELECT *, coalesce(nullif(regexp_extract(text, {quoted(rules.ANGLE_URL)}, 1), ''), nullif(regexp_replace(regexp_extract(text, {quoted(rules.BARE_URL)}, 0), '>+$', ''), '')) AS url,
  lower(regexp_replace(regexp_replace(trim(regexp_replace(text, '<@[^>]+>', '', 'g')), '^[!.]+', ''), '[!.]+$', '')) IN ('cancel', 'stop', 'abort', 'nevermind', 'nvm') AS cancel,
  regexp_replace(lower(trim(text)), '^[!/]+', '') IN ('help', '?', 'usage', 'how does this work?') AS help FROM e),
a AS (SELECT *, CASE WHEN bot OR changed OR NOT (mention OR im OR (channel IN ('C1', 'C2') AND NOT contains(text, '<@B0>'))) THEN 'ignore' WHEN reply AND NOT files AND cancel THEN 'cancel' WHEN files THEN 'file' WHEN url IS NOT NULL THEN 'link' WHEN help THEN 'help' ELSE 'quiet' END AS action FROM u)
SELECT conv_id, turn, action, CASE action WHEN 'file' THEN 'f' || turn || '.pdf' WHEN 'link' THEN url END AS target, CASE WHEN reply THEN conv_id::VARCHAR ELSE conv_id || '.' || turn END AS thread FROM a""")
def event_filter(spark, sf_dir):
    return chat.actions(_events(spark, sf_dir), chat.drop_channels(F.lit(" C2, C1,,C2")), "B0").select("conv_id", "turn", "action", "target", "thread")


@query("""
SELECT event_id, event_type = 'error' AND attempts + 1 < 3 AS requeue, CASE WHEN event_type = 'signup' THEN 'Sorry — job ' || event_id || ' failed: no such file' WHEN event_type = 'error' AND attempts + 1 >= 3 THEN 'Sorry — job ' || event_id || ' failed after ' || (attempts + 1) || ' attempts: no such file' WHEN event_type = 'purchase' THEN 'Sorry — job ' || event_id || ' failed unexpectedly.' END AS reply
FROM (SELECT event_id, event_type, event_id % 4 AS attempts FROM events)""")
def job_outcomes(spark, sf_dir):
    e = F.col("event_type")
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("job "), F.col("event_id").cast("string")).alias("label"), (F.col("event_id") % 4).alias("attempts"), F.when(e == "signup", "input").when(e == "error", "transient").when(e == "purchase", "crash").alias("error"), F.lit("no such file").alias("detail"))
    return chat.outcomes(rows, 3).select("event_id", "requeue", "reply")


_COMMAND_VOICES = ["af_bella", "af_sky", "am_adam", "bf_emma"]


def _commands(spark, sf_dir):
    c = F.col
    command = F.element_at(F.array(*map(F.lit, ["voice", "format", "cover", "tts"])), (c("event_id") % 4 + 1).cast("int"))
    text = F.element_at(F.array(*map(F.lit, ["af_sky", " MD ", "off", "on", "sky default", "", "woodcut default", "nonsense", "af_bella Default", "none", "auto"])), (c("event_id") % 11 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", c("event_id").alias("ts"), c("user_id").cast("string").alias("user"), command.alias("command"), text.alias("text"), F.when(c("event_id") % 2 == 0, "true").otherwise("false").alias("current"))


_COMMANDS_SQL = f"""
WITH c AS (SELECT event_id AS ts, user_id::VARCHAR AS u, ['voice', 'format', 'cover', 'tts'][event_id % 4 + 1] AS command, ['af_sky', 'MD', 'off', 'on', 'sky default', '', 'woodcut default', 'nonsense', 'af_bella Default', 'none', 'auto'][event_id % 11 + 1] AS text, event_id % 2 = 0 AS current FROM events),
w AS (SELECT ts, command, current, CASE WHEN NOT regexp_matches(lower(text), '(^| )default$') THEN u END AS "user", regexp_replace(text, ' ?[dD]efault$', '') AS wanted FROM c),
v AS (SELECT *, CASE command WHEN 'voice' THEN 'tts_voice' WHEN 'format' THEN 'note_format' WHEN 'cover' THEN 'cover_style' ELSE 'tts_enabled' END AS key,
  CASE command WHEN 'voice' THEN CASE WHEN wanted IN ('af_bella', 'af_sky', 'am_adam', 'bf_emma') THEN wanted END WHEN 'format' THEN CASE WHEN lower(wanted) IN ('pdf', 'md', 'docx', 'none') THEN lower(wanted) END
    WHEN 'cover' THEN CASE WHEN lower(wanted) IN ({', '.join(map(quoted, rules.COVER_CHOICES))}) THEN lower(wanted) END ELSE CASE lower(wanted) WHEN 'on' THEN 'true' WHEN 'off' THEN 'false' WHEN '' THEN CASE WHEN current THEN 'false' ELSE 'true' END END END AS value FROM w)"""


@query(f"""{_COMMANDS_SQL},
n AS (SELECT *, array_to_string(list_filter(['af_bella', 'af_sky', 'am_adam', 'bf_emma'], lambda x: contains(x, lower(wanted)))[1:3], ', ') AS near FROM v)
SELECT ts, "user", key, value, CASE WHEN value IS NOT NULL THEN key || ' is ' || value || CASE WHEN "user" IS NULL THEN ' for everyone by default' ELSE ' for you' END WHEN command <> 'tts' AND wanted = '' THEN key || ' is ' || current
  WHEN command = 'voice' THEN 'unknown voice' || CASE WHEN near <> '' THEN ', near ' || near ELSE '' END WHEN command = 'tts' THEN 'on, off, or nothing to flip' ELSE 'one of the choices, please' END AS reply FROM n""")
def chat_commands(spark, sf_dir):
    return chat.commands(_commands(spark, sf_dir), F.array(*map(F.lit, _COMMAND_VOICES)))


@query(f"""{_COMMANDS_SQL},
l AS (SELECT CASE WHEN "user" IS NULL THEN 'shared' ELSE 'user' END AS layer, "user", key, arg_max(value, ts) AS value FROM v WHERE value IS NOT NULL GROUP BY ALL),
b(layer, "user", key, value) AS (VALUES ('default', NULL, 'model', 'small'), ('shared', NULL, 'tts_voice', 'old'), ('user', '1', 'tts_voice', 'older'))
SELECT * FROM l UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.layer = b.layer AND l.key = b.key AND l."user" IS NOT DISTINCT FROM b."user")""")
def settings_after_commands(spark, sf_dir):
    layers = spark.createDataFrame([("default", None, "model", "small"), ("shared", None, "tts_voice", "old"), ("user", "1", "tts_voice", "older")], "layer string, user string, key string, value string")
    return chat.applied(layers, chat.commands(_commands(spark, sf_dir), F.array(*map(F.lit, _COMMAND_VOICES))))


# --- queues --------------------------------------------------------------------------------------


@query("""
WITH s AS (SELECT user_id, CASE event_id % 3 WHEN 0 THEN 'tts_voice' WHEN 1 THEN 'cover_style' ELSE 'note_format' END AS key, ts AS since, 'v' || event_id AS value FROM events WHERE event_type = 'signup'),
j AS (SELECT event_id AS job, user_id, ts AS handed FROM events WHERE event_type = 'purchase'),
o AS (SELECT job, key, arg_max(value, since) AS value FROM j JOIN s USING (user_id) WHERE since <= handed AND key <> 'note_format' GROUP BY job, key)
SELECT job, max(value) FILTER (key = 'tts_voice') AS tts_voice, max(value) FILTER (key = 'cover_style') AS cover_style FROM j LEFT JOIN o USING (job) GROUP BY job""")
def handed_settings(spark, sf_dir):
    """Settings frozen when a job goes from the first stage to the second."""
    events = table(spark, sf_dir, "events")
    key = F.when(F.col("event_id") % 3 == 0, "tts_voice").when(F.col("event_id") % 3 == 1, "cover_style").otherwise("note_format")
    settings = events.where("event_type = 'signup'").select(F.col("user_id").alias("user"), key.alias("key"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("value"), F.col("ts").alias("since"))
    jobs = events.where("event_type = 'purchase'").select(F.col("event_id").alias("job"), F.col("user_id").alias("user"), F.col("ts").alias("handed"))
    found = q.handed_off(jobs, settings)
    return found.select("job", *[F.try_element_at("overrides", F.lit(k)).alias(k) for k in ("tts_voice", "cover_style")])


@query("""
WITH j AS (SELECT user_id, event_id AS job, ts AS added, CASE WHEN event_id % 6 > 0 THEN ts + to_minutes(event_id % 600) END AS done, event_id % 6 = 3 AS again FROM events WHERE event_type IN ('view', 'purchase')),
w AS (SELECT user_id, job, added, CASE WHEN again THEN done + INTERVAL '1 hour' ELSE done END AS done FROM j)
SELECT user_id, job, EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'error' AND c.user_id = w.user_id AND c.ts >= w.added AND (w.done IS NULL OR c.ts < w.done)) AS canceled FROM w""")
def cancel_threads(spark, sf_dir):
    """A cancel in a thread stops the jobs that are open there; a job with two halves is open till the last is done."""
    events, c = table(spark, sf_dir, "events"), F.col
    jobs = events.where("event_type in ('view', 'purchase')").select("user_id", c("event_id").alias("job"), c("ts").alias("added"), F.when(c("event_id") % 6 > 0, c("ts") + F.make_dt_interval(mins=(c("event_id") % 600).cast("int"))).alias("done"))
    halves = jobs.where("job % 6 = 3").select("user_id", "job", c("done").alias("added"), (c("done") + F.expr("INTERVAL 1 HOUR")).alias("done"))
    return q.canceled(jobs.unionByName(halves), events.where("event_type = 'error'").select("user_id", "ts"), ["user_id"])


@query(f"""
WITH f AS (SELECT * FROM ({_replay_sql(_JOBS, 'event_type', 'arrival', 'service', 'arrival, event_id')})),
n AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY arrival, event_id) AS nth, arrival, finish FROM f)
SELECT n.event_id, (n.nth - 1 - count(d.event_id))::BIGINT AS jobs_ahead FROM n LEFT JOIN n d ON d.event_type = n.event_type AND d.nth < n.nth AND d.finish <= n.arrival GROUP BY n.event_id, n.nth""")
def jobs_ahead(spark, sf_dir):
    rows = q.replayed(_jobs(spark, sf_dir), ["event_type"], "arrival", "service", ["arrival", "event_id"])
    return q.jobs_ahead(rows, ["event_type"], "arrival", "finish", ["arrival", "event_id"]).select("event_id", "jobs_ahead")


@query(f"""
WITH k AS (SELECT stage, greatest(0.25::DOUBLE, least(8::DOUBLE, exp(log_factor + spread))) AS upper FROM ({_CALIBRATED.replace('round(m, 6)', 'm').replace('round(s, 6)', 's')})),
j AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'summarize_single' ELSE 'summarize_map' END AS branch, event_id % 5 * 190.0::DOUBLE AS ocr, abs(value) + 60 AS body, event_id % 7 * 30.0::DOUBLE AS audio, event_id % 900 * 1.0::DOUBLE AS ahead, event_id % 4000 * 1.0::DOUBLE AS audio_ahead FROM events),
s AS (SELECT *, ahead + ocr * coalesce((SELECT upper FROM k WHERE stage = 'ocr'), 1) + body * coalesce((SELECT upper FROM k WHERE stage = branch), 1) AS summary_at FROM j)
SELECT event_id, round(summary_at, 3) AS summary_at, CASE WHEN event_id % 3 > 0 THEN round(greatest(summary_at, audio_ahead) + audio * coalesce((SELECT upper FROM k WHERE stage = 'audio'), 1), 3) END AS audio_at FROM s""")
def ack_times(spark, sf_dir):
    """Both halves of an answer: when the summary and when the audio will be there, by what the stages have learnt."""
    factors, c = q.calibrated(_observations(table(spark, sf_dir, "events")), ["ts", "event_id"]), F.col
    number = lambda n, by: (c("event_id") % n * F.lit(float(by))).cast("double")
    jobs = table(spark, sf_dir, "events").select("event_id", F.when(c("event_id") % 2 == 0, "summarize_single").otherwise("summarize_map").alias("branch"), number(5, 190).alias("ocr_seconds"), (F.abs("value") + 60).alias("summarize_seconds"), number(7, 30).alias("audio_seconds"), number(900, 1).alias("seconds_ahead"), number(4000, 1).alias("audio_ahead"))
    found = q.quoted(jobs, factors, c("event_id") % 3 > 0)
    return found.select("event_id", F.round("summary_at", 3).alias("summary_at"), F.round("audio_at", 3).alias("audio_at"))


@query("SELECT 'audio' AS stage, lpad(event_id::VARCHAR, 8, '0') AS id FROM events WHERE event_type = 'view' UNION ALL SELECT 'summarize', lpad(event_id::VARCHAR, 8, '0') FROM events WHERE event_type = 'click'")
def restart_order(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.lpad(F.col("event_id").cast("string"), 8, "0").alias("id"))
    return q.restart_order(rows.where("event_type = 'click'").select("id"), rows.where("event_type = 'view'").select("id"))


@query("SELECT event_id, user_id, CASE WHEN event_type = 'view' THEN 2 ELSE 1 END AS weight FROM events WHERE event_type <> 'error'")
def stream_stages(spark, sf_dir):
    """Two durable stages, each with its own table and checkpoint: what the first has done is the second's input."""
    folder = own_folder(spark)
    rows = spark.readStream.schema(streams.EVENTS).parquet(f"{sf_dir}/events.parquet*").where("event_type <> 'error'")
    _, done = streams.chained(rows, f"{folder}/first", f"{folder}/second", lambda x: x.withColumn("weight", F.when(F.col("event_type") == "view", 2).otherwise(1)))
    return spark.read.parquet(done).select("event_id", "user_id", "weight")


# --- covers, items, skipped pages ----------------------------------------------------------------

_STYLE_LIST = ", ".join(map(quoted, rules.COVER_STYLES))


@query(f"""
WITH c AS (SELECT p_partkey, ['auto', ' Woodcut ', 'off', '', 'vanished', 'poster', 'auto'][p_partkey % 7 + 1] AS choice, p_name AS scene, ['painterly', 'nonsense', NULL][p_partkey % 3 + 1] AS style, p_partkey % 5 = 0 AS failed FROM part),
s AS (SELECT *, lower(trim(choice)) AS k FROM c), t AS (SELECT *, CASE WHEN k IN ('', 'off') THEN 'off' WHEN k = 'auto' THEN CASE WHEN NOT failed AND style IN ({_STYLE_LIST}) THEN style ELSE 'flat' END WHEN k IN ({_STYLE_LIST}) THEN k ELSE 'flat' END AS found FROM s)
SELECT p_partkey, found AS style, CASE WHEN found = 'off' OR failed THEN '' ELSE scene END AS scene FROM t""")
def cover_plan(spark, sf_dir):
    c = F.col
    choice = F.element_at(F.array(*map(F.lit, ["auto", " Woodcut ", "off", "", "vanished", "poster", "auto"])), (c("p_partkey") % 7 + 1).cast("int"))
    style = F.element_at(F.array(F.lit("painterly"), F.lit("nonsense"), F.lit(None)), (c("p_partkey") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", choice.alias("choice"), c("p_partkey").cast("string").alias("key"), F.when(c("p_partkey") % 5 != 0, F.to_json(F.struct(c("p_name").alias("scene"), style.alias("style")))).alias("answer"))
    return covers.planned(rows).select("p_partkey", "style", "scene")


@query("SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'Item ' || conv_id END AS title, '' AS description, CASE WHEN conv_id % 2 = 0 THEN '/c/' || conv_id ELSE '' END AS cover_path, string_agg('Part ' || turn, ',' ORDER BY turn) AS chapters FROM conversations GROUP BY conv_id")
def item_detail(spark, sf_dir):
    """Items as a listing service tells them, in JSON."""
    c = F.col
    parts = F.transform(F.array_sort(F.collect_list("turn")), lambda n: F.struct(F.concat(F.lit("Part "), n.cast("string")).alias("title")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(parts.alias("chapters"))
    body = F.to_json(F.struct(F.struct(F.struct(F.when(c("conv_id") % 3 != 0, F.concat(F.lit("Item "), c("conv_id").cast("string"))).alias("title")).alias("metadata"), F.when(c("conv_id") % 2 == 0, F.concat(F.lit("/c/"), c("conv_id").cast("string"))).alias("coverPath"), "chapters").alias("media")))
    return rows.select("conv_id", records.item_detail(body).alias("i")).select("conv_id", "i.title", "i.description", "i.cover_path", F.array_join("i.chapters", ",").alias("chapters"))


@query("""
WITH p AS (SELECT conv_id, turn, turn % 3 = 2 AS skipped, CASE WHEN turn % 12 = 2 THEN 'OCR timed out after 120s' WHEN turn % 6 = 5 THEN 'OCR page cap' ELSE '' END AS reason FROM conversations),
f AS (SELECT DISTINCT conv_id, reason FROM p WHERE skipped AND reason <> '')
SELECT p.conv_id, count(*) FILTER (skipped) AS skipped_pages, coalesce((SELECT string_agg(reason, '; ' ORDER BY reason) FROM f WHERE f.conv_id = p.conv_id), '') AS skip_reasons FROM p GROUP BY p.conv_id""")
def skip_reasons(spark, sf_dir):
    m = F.col("turn")
    pages = table(spark, sf_dir, "conversations").select("conv_id", m.alias("number"), F.when(m % 3 == 2, "skipped").otherwise("ocr").alias("method"), F.when(m % 12 == 2, "OCR timed out after 120s").when(m % 6 == 5, "OCR page cap").otherwise("").alias("reason"))
    return d.skip_reasons(pages, "conv_id").withColumn("skip_reasons", F.array_join("skip_reasons", "; "))


# --- texts ---------------------------------------------------------------------------------------


_FOUND = " UNION ALL ".join(
    f"SELECT page_id, {quoted(name)} AS pattern, length(regexp_extract_all(bare, {quoted(sql_pattern(p, f))}))::BIGINT AS hits, length(string_split_regex(bare, {quoted(sql_pattern(p, f))})[1]) + 1 AS place, bare FROM b WHERE regexp_matches(bare, {quoted(sql_pattern(p, f))})"
    for name, p, f in rules.LINT
)


@query(f"""
WITH b AS (SELECT page_id, {sql_apply('html', [rules.AUTHOR_BRACKET])} AS bare FROM pages),
p AS (SELECT page_id, paragraph, place, {_KEY_SQL} AS k FROM (SELECT page_id, unnest(string_split(html, chr(10) || chr(10))) AS paragraph, generate_subscripts(string_split(html, chr(10) || chr(10)), 1) AS place FROM pages) WHERE length(paragraph) >= {rules.REPEATED_PARAGRAPH_CHARS}),
r AS (SELECT page_id, k, arg_min(paragraph, place) AS paragraph, list_sort(list(place))[2] AS second FROM p GROUP BY page_id, k HAVING count(*) > 1)
SELECT page_id, pattern, hits, {sql_strip("regexp_replace(substring(bare, greatest(1, place - 40), place + 40 - greatest(1, place - 40)), '\\s+', ' ', 'g')")} AS context FROM ({_FOUND})
UNION ALL SELECT page_id, 'repeated paragraph', count(*), {sql_strip("regexp_replace(substring(arg_min(paragraph, second), 1, 80), '\\s+', ' ', 'g')")} FROM r GROUP BY page_id""")
def lint_findings(spark, sf_dir):
    """What raw pages hold that a voice would read out, with what stands around the first of each."""
    return lines.findings(table(spark, sf_dir, "pages"), "page_id", "html")


@query(f"""
WITH x AS (SELECT doc_id, text AS a, {_clean_sql('text')} AS b FROM ({_MARKED_SQL})),
c AS (SELECT doc_id, ch, count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb FROM (SELECT doc_id, 'a' AS side, unnest(string_split(a, '')) AS ch FROM x UNION ALL SELECT doc_id, 'b', unnest(string_split(b, '')) FROM x) GROUP BY doc_id, ch)
SELECT doc_id, length(b)::BIGINT AS chars, (length(b) - length(a))::BIGINT AS delta_chars, round(2 * sum(least(na, nb)) / (length(a) + length(b)), 4) AS similarity FROM x JOIN c USING (doc_id) GROUP BY doc_id, a, b""")
def variant_similarity(spark, sf_dir):
    rows = _marked(table(spark, sf_dir, "documents")).withColumn("cleaned", t.clean_body(F.col("text")))
    return rows.select("doc_id", variants.metrics(F.col("text"), F.col("cleaned")).alias("m")).select("doc_id", "m.chars", "m.delta_chars", "m.similarity")


@query()
def matched_windows(spark, sf_dir):
    """The passage of a document that begins most like its last line; a paragraph is a line here."""
    text = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return table(spark, sf_dir, "documents").select("doc_id", variants.matched_window_column(text, F.element_at(F.split("text", "\n"), -1), 2000).alias("passage"))


@query(f"SELECT voice, 'Hello, I''m ' || replace(voice, '_', ' ') || '. Does it work?' AS sample FROM ({_VOICES_SQL})")
def voice_samples(spark, sf_dir):
    """What each voice says of itself."""
    return _voices(spark, sf_dir).select("voice", t.voice_sample(F.col("voice"), "Does it work?").alias("sample"))
