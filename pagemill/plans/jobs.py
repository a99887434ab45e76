"""Queries of queues, estimates, settings, shelves, transcripts, summaries and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import rules, text as t
from pagemill.functions.rx import quoted, sql_strip
from pagemill.operators import queueing as q
from pagemill.operators import shelf, summaries, transcripts
from pagemill.plans.registry import query, table
from pagemill.storage import own_folder
from pagemill.streaming import queue as streams

_EVENTS = "SELECT *, epoch(ts)::DOUBLE AS arrival, abs(value) + 1 AS service FROM events"


def _jobs(spark, sf_dir):
    """Events as jobs: one queue a type, arrival in seconds, value as service."""
    return table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "ts", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("arrival"), (F.abs("value") + 1).alias("service"))


_JOBS = "SELECT event_id, event_type, user_id, ts, floor(epoch(ts))::DOUBLE AS arrival, abs(value) + 1 AS service FROM events"
_W = "OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _replay_sql(source: str, by: str, arrival: str, service: str, order: str) -> str:
    w = _W.format(by=by, order=order)
    return f"SELECT *, done + max({arrival} - (done - {service})) {w} AS finish FROM (SELECT *, sum({service}) {w} AS done FROM ({source}))"


@query(f"SELECT event_id, event_type, round(finish - service, 3) AS start, round(finish, 3) AS finish, round(finish - service - arrival, 3) + 0 AS wait FROM ({_replay_sql(_JOBS, 'event_type', 'arrival', 'service', 'arrival, event_id')})")
def queue_replay(spark, sf_dir):
    rows = q.replayed(_jobs(spark, sf_dir), ["event_type"], "arrival", "service", ["arrival", "event_id"])
    return rows.select("event_id", "event_type", *[F.round(c, 3).alias(c) for c in ("start", "finish", "wait")])


_FIRST = _replay_sql(_JOBS, "event_type", "arrival", "service", "arrival, event_id").replace("AS done", "AS done1").replace("done ", "done1 ").replace("(done ", "(done1 ")


@query(f"""
WITH a AS (SELECT event_id, event_type, arrival, service, finish FROM ({_replay_sql(_JOBS, 'event_type', 'arrival', 'service', 'arrival, event_id')})),
b AS (SELECT event_id, event_type, finish AS handed, service * 2 AS audio FROM a)
SELECT event_id, event_type, round(handed, 3) AS summary_at, round(finish, 3) AS audio_at FROM ({_replay_sql('SELECT * FROM b', 'event_type', 'handed', 'audio', 'handed, event_id')})""")
def tandem_replay(spark, sf_dir):
    """Two stages: what the first hands on arrives at the second."""
    one = q.replayed(_jobs(spark, sf_dir), ["event_type"], "arrival", "service", ["arrival", "event_id"]).select("event_id", "event_type", F.col("finish").alias("handed"), (F.col("service") * 2).alias("audio"))
    two = q.replayed(one, ["event_type"], "handed", "audio", ["handed", "event_id"])
    return two.select("event_id", "event_type", F.round("handed", 3).alias("summary_at"), F.round("finish", 3).alias("audio_at"))


@query(f"""
WITH f AS (SELECT * FROM ({_replay_sql(_JOBS, 'event_type', 'arrival', 'service', 'arrival, event_id')})), a AS (SELECT *, greatest(0, coalesce(max(finish) OVER (PARTITION BY event_type ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), arrival) - arrival) AS ahead FROM f)
SELECT event_id, round(ahead, 3) AS seconds_ahead, strftime(timezone('Europe/Berlin', timezone('UTC', date_trunc('second', ts) + to_seconds(ceil(ahead + service)::BIGINT))), '%H:%M') || CASE WHEN timezone('Europe/Berlin', timezone('UTC', date_trunc('second', ts) + to_seconds(ceil(ahead + service)::BIGINT)))::DATE <> timezone('Europe/Berlin', timezone('UTC', ts))::DATE THEN ' tomorrow' ELSE '' END AS summary_by FROM a""")
def ack_quote(spark, sf_dir):
    # whole seconds are rounded up, so ends that are whole hang on the last bits of the sums before them
    rows = q.replayed(_jobs(spark, sf_dir), ["event_type"], "arrival", "service", ["arrival", "event_id"], doubles=True)
    rows = q.ahead(rows, ["event_type"], "arrival", "finish", "service", ["arrival", "event_id"])
    by = q.clock(F.timestamp_seconds(F.col("arrival")), F.ceil(F.col("seconds_ahead") + F.col("service")).cast("decimal(18,6)"), F.lit("Europe/Berlin"))
    return rows.select("event_id", F.round("seconds_ahead", 3).alias("seconds_ahead"), by.alias("summary_by"))


@query("""
WITH k AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'link' WHEN 1 THEN 'image' WHEN 2 THEN 'pdf' ELSE 'unknown' END AS kind, n_chars, doc_id % 7 AS ocr FROM documents),
c AS (SELECT doc_id, kind, CASE kind WHEN 'image' THEN 1 WHEN 'pdf' THEN ocr ELSE 0 END AS pages, CASE kind WHEN 'image' THEN 1800 WHEN 'pdf' THEN n_chars + ocr * 1800 ELSE 6000 END AS chars FROM k)
SELECT doc_id, kind, chars::BIGINT AS chars, pages::BIGINT AS ocr_pages, CASE WHEN chars <= 6000 THEN 'summarize_single' ELSE 'summarize_map' END AS branch, pages * 190.0::DOUBLE AS ocr_seconds,
  round(CASE WHEN chars <= 6000 THEN 60 + chars * 0.02::DOUBLE ELSE (ceil(chars / 1000.0) + 1) * 480 END::DOUBLE, 6) AS summarize_seconds, round(chars / 30::DOUBLE, 6) AS audio_seconds FROM c""")
def eta_estimate(spark, sf_dir):
    m = F.col("doc_id") % 4
    kind = F.when(m == 0, "link").when(m == 1, "image").when(m == 2, "pdf").otherwise("unknown")
    rows = table(spark, sf_dir, "documents").select("doc_id", q.estimated(kind, F.col("n_chars"), F.col("doc_id") % 7, 6000, 1000).alias("e")).select("doc_id", "e.*")
    return rows.withColumns({c: F.round(c, 6) for c in ("summarize_seconds", "audio_seconds")})


_STAGE = "CASE event_type WHEN 'view' THEN 'ocr' WHEN 'click' THEN 'summarize_single' WHEN 'purchase' THEN 'summarize_map' WHEN 'signup' THEN 'audio' ELSE 'other' END"


def _observations(rows):
    stage = F.when(F.col("event_type") == "view", "ocr").when(F.col("event_type") == "click", "summarize_single").when(F.col("event_type") == "purchase", "summarize_map").when(F.col("event_type") == "signup", "audio").otherwise("other")
    predicted = F.try_element_at(F.from_json("props", "map<string,double>"), F.lit("k"))
    return rows.select(stage.alias("stage"), "ts", "event_id", F.coalesce(predicted, F.lit(0.0)).alias("predicted"), F.col("value").alias("actual"))


_CALIBRATED = f"""
WITH RECURSIVE o AS (SELECT {_STAGE} AS stage, ts, event_id, json_extract(props, '$.k')::DOUBLE AS p, value AS a FROM events),
r AS (SELECT stage, row_number() OVER (PARTITION BY stage ORDER BY ts, event_id) AS i, greatest(-2.5::DOUBLE, least(2.5::DOUBLE, ln(a / p))) AS r FROM o WHERE stage <> 'other' AND p > 0 AND a > 0),
f(stage, i, m, s) AS (
  SELECT DISTINCT stage, 0::BIGINT, 0::DOUBLE, 0::DOUBLE FROM r
  UNION ALL
  SELECT f.stage, f.i + 1, m + greatest(0.1::DOUBLE, 1::DOUBLE / (f.i + 1)) * (r.r - m), CASE WHEN f.i > 0 THEN s + greatest(0.1::DOUBLE, 1::DOUBLE / (f.i + 1)) * (abs(r.r - m) - s) ELSE s END
  FROM f JOIN r ON f.stage = r.stage AND r.i = f.i + 1)
SELECT stage, round(m, 6) AS log_factor, round(s, 6) AS spread, i AS n, round(greatest(0.25::DOUBLE, least(8::DOUBLE, exp(m))), 6) AS factor, round(greatest(0.25::DOUBLE, least(8::DOUBLE, exp(m + s))), 6) AS upper
FROM f QUALIFY row_number() OVER (PARTITION BY stage ORDER BY i DESC) = 1"""


@query(_CALIBRATED)
def calibration_replay(spark, sf_dir):
    found = q.calibrated(_observations(table(spark, sf_dir, "events")), ["ts", "event_id"])
    return found.withColumns({c: F.round(c, 6) for c in ("log_factor", "spread", "factor", "upper")})


def halves(events):
    """The events before and after the middle of their time."""
    middle = events.agg(F.timestamp_micros(((F.unix_micros(F.min("ts").cast("timestamp")) + F.unix_micros(F.max("ts").cast("timestamp"))) / 2).cast("long")).cast("timestamp_ntz").alias("m")).first()["m"]
    return events.where(F.col("ts") < F.lit(middle)), events.where(F.col("ts") >= F.lit(middle))


@query("SELECT stage, log_factor, spread, n FROM (" + _CALIBRATED.replace("round(m, 6)", "round(m, 6)") + ")")
def stream_calibration(spark, sf_dir):
    """The same fold carried from trigger to trigger, with a restart between the events' first half and their second."""
    folder = own_folder(spark)
    for half in halves(table(spark, sf_dir, "events")):
        half.write.mode("append").parquet(f"{folder}/events")
        rows = spark.readStream.schema(streams.EVENTS).parquet(f"{folder}/events")
        streams.calibrating(_observations(rows).where(F.col("stage").isin(rules.STAGES)), folder).awaitTermination()
    return streams.learnt(spark, folder).withColumns({c: F.round(c, 6) for c in ("log_factor", "spread")})


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    """Tumbling windows over the stream, complete after its last trigger."""
    events = streams.event_stream(spark, f"{sf_dir}/events.parquet*")
    return streams.finished(streams.windowed(events, "1 hour"), "complete").withColumn("total", F.round("total", 2))


@query("SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def event_sessions(spark, sf_dir):
    return streams.sessions(table(spark, sf_dir, "events"), "30 minutes")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'error'")
def stream_queue(spark, sf_dir):
    """Jobs through a durable queue: written by one query with a checkpoint, read back as a table."""
    folder = own_folder(spark)
    rows = spark.readStream.schema(streams.EVENTS).parquet(f"{sf_dir}/events.parquet*").where("event_type <> 'error'")
    streams.spooled(rows, f"{folder}/jobs", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/jobs").select("event_id", "user_id", "event_type")


_USER_VALUES = "user_id % 3 = 0"


@query("""
WITH d(key, value, layer, rank) AS (VALUES ('tts_voice', 'af_heart', 'default', 1), ('tts_enabled', 'true', 'default', 1), ('note_format', 'pdf', 'default', 1), ('model', 'small', 'default', 1), ('model', 'large', 'env', 2), ('note_format', 'docx', 'shared', 3), ('secret_key', 'x', 'shared', 3)),
u AS (SELECT DISTINCT user_id FROM events), s AS (SELECT key, value, layer FROM d WHERE layer <> 'shared' OR key IN ('tts_voice', 'tts_enabled', 'note_format', 'cover_style') QUALIFY row_number() OVER (PARTITION BY key ORDER BY rank DESC) = 1),
o AS (SELECT user_id, 'tts_voice' AS key, 'bm_' || user_id AS value FROM u WHERE user_id % 3 = 0)
SELECT u.user_id AS "user", s.key, coalesce(o.value, s.value) AS value, CASE WHEN o.value IS NOT NULL THEN 'user' ELSE s.layer END AS layer FROM u CROSS JOIN s LEFT JOIN o ON o.user_id = u.user_id AND o.key = s.key""")
def settings_resolve(spark, sf_dir):
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("user")).distinct()
    fixed = [("default", "tts_voice", "af_heart"), ("default", "tts_enabled", "true"), ("default", "note_format", "pdf"), ("default", "model", "small"), ("env", "model", "large"), ("shared", "note_format", "docx"), ("shared", "secret_key", "x")]
    layers = spark.createDataFrame([(a, None, k, v) for a, k, v in fixed], "layer string, user long, key string, value string")
    own = users.where("user % 3 = 0").select(F.lit("user").alias("layer"), "user", F.lit("tts_voice").alias("key"), F.concat(F.lit("bm_"), F.col("user").cast("string")).alias("value"))
    return q.resolved_settings(layers.unionByName(own), users)


@query("SELECT e.event_id, e.user_id FROM events e WHERE e.event_type IN ('view', 'purchase') AND NOT EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'error' AND c.user_id = e.user_id AND c.ts >= e.ts AND c.ts < e.ts + INTERVAL '2 hours')")
def cancel_jobs(spark, sf_dir):
    """Jobs of a thread (user) that no cancel (error) follows within two hours."""
    events = table(spark, sf_dir, "events")
    # the next cancel of each thread, by a window instead of a range join
    from pyspark.sql.window import Window

    after = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    rows = events.withColumn("next", F.min(F.when(F.col("event_type") == "error", F.col("ts"))).over(after))
    return rows.where(F.col("event_type").isin("view", "purchase") & (F.col("next").isNull() | (F.col("next") >= F.col("ts") + F.expr("INTERVAL 2 HOURS")))).select("event_id", "user_id")


@query("""
SELECT job, attempt::INT AS attempt, error, CASE WHEN error IS NULL THEN 'done' WHEN error = 'transient' AND attempt + 1 < 3 THEN 'requeued' WHEN error = 'transient' THEN 'gave up' WHEN error = 'input' THEN 'rejected' ELSE 'crashed' END AS outcome
FROM (SELECT event_id AS job, event_id % 3 AS attempt, CASE event_type WHEN 'error' THEN 'transient' WHEN 'signup' THEN 'input' WHEN 'purchase' THEN 'crash' END AS error FROM events)""")
def retry_outcomes(spark, sf_dir):
    e = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("job"), (F.col("event_id") % 3).cast("int").alias("attempt"), F.when(e == "error", "transient").when(e == "signup", "input").when(e == "purchase", "crash").alias("error"))
    return q.retried(rows)


_MESSAGE = "CASE turn % 6 WHEN 0 THEN '<@U1> Cancel!' WHEN 1 THEN 'look <https://a.example/' || conv_id || '|label> ok' WHEN 2 THEN 'see http://b.example/' || turn || '> now' WHEN 3 THEN ' /Help' ELSE text END"


def _messages(spark, sf_dir):
    m = F.col("turn") % 6
    text = F.when(m == 0, "<@U1> Cancel!").when(m == 1, F.concat(F.lit("look <https://a.example/"), F.col("conv_id").cast("string"), F.lit("|label> ok"))).when(m == 2, F.concat(F.lit("see http://b.example/"), F.col("turn").cast("string"), F.lit("> now"))).when(m == 3, " /Help").otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.alias("message"))


@query(f"""
WITH m AS (SELECT conv_id, turn, role, {_MESSAGE} AS message FROM conversations)
SELECT conv_id, turn, coalesce(nullif(regexp_extract(message, {quoted(rules.ANGLE_URL)}, 1), ''), nullif(regexp_replace(regexp_extract(message, {quoted(rules.BARE_URL)}, 0), '>+$', ''), '')) AS url,
  lower(regexp_replace(regexp_replace(trim(regexp_replace(message, '<@[^>]+>', '', 'g')), '^[!.]+', ''), '[!.]+$', '')) IN ('cancel', 'stop', 'abort', 'nevermind', 'nvm') AS cancel,
  regexp_replace(lower(trim(message)), '^[!/]+', '') IN ('help', '?', 'usage', 'how does this work?') AS help FROM m WHERE role <> 'system'""")
def event_router(spark, sf_dir):
    rows = _messages(spark, sf_dir).where("role <> 'system'")
    return rows.select("conv_id", "turn", t.first_url(F.col("message")).alias("url"), t.is_cancel(F.col("message")).alias("cancel"), t.is_help(F.col("message")).alias("help"))


_ITEMS = "SELECT doc_id AS id, 'Title ' || doc_id % 50 AS title, CASE WHEN doc_id % 4 = 0 THEN 'Old' ELSE '' END AS series, list_value(source, CASE doc_id % 3 WHEN 0 THEN 'Ana' WHEN 1 THEN 'Ben' ELSE lang END) AS tags, n_chars AS added_at FROM documents"


def _items(spark, sf_dir):
    who = F.when(F.col("doc_id") % 3 == 0, "Ana").when(F.col("doc_id") % 3 == 1, "Ben").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("Title "), (F.col("doc_id") % 50).cast("string")).alias("title"), F.when(F.col("doc_id") % 4 == 0, "Old").otherwise("").alias("series"), F.array("source", who).alias("tags"), F.col("n_chars").alias("added_at"))


@query(f"""
WITH o AS (SELECT *, list_filter(tags, lambda x: regexp_matches(x, '^[A-Z]')) AS owners FROM ({_ITEMS}))
SELECT id, title, array_to_string(list_sort(list_distinct(list_concat(list_filter(tags, lambda x: NOT regexp_matches(x, '^[A-Z]')), ['Ana']))), ',') AS new_tags FROM o
WHERE (len(owners) = 0 OR len(list_filter(owners, lambda x: x <> 'Ana')) = 0) AND NOT (list_contains(tags, 'Ana') AND series = '')""")
def backfill_candidates(spark, sf_dir):
    rows = shelf.candidates(_items(spark, sf_dir), "Ana")
    return rows.select("id", "title", F.array_join(shelf.retagged(F.col("tags"), "Ana"), ",").alias("new_tags"))


@query(f"SELECT id, title, added_at FROM ({_ITEMS}) ORDER BY added_at DESC, id LIMIT 10")
def newest_items(spark, sf_dir):
    return shelf.newest(_items(spark, sf_dir)).select("id", "title", "added_at")


@query(f"""
WITH w AS (SELECT id, 'L' || id % 3 AS library, 'C' || id % 5 AS name FROM ({_ITEMS})), c AS (SELECT library, name, list(id) AS members FROM w WHERE id % 2 = 0 AND name <> 'C4' GROUP BY library, name)
SELECT w.id AS item, w.library, w.name, CASE WHEN c.members IS NULL THEN 'create' WHEN list_contains(c.members, w.id) THEN 'none' ELSE 'add' END AS action FROM w LEFT JOIN c USING (library, name)""")
def collection_upsert(spark, sf_dir):
    wanted = _items(spark, sf_dir).select(F.col("id").alias("item"), F.concat(F.lit("L"), (F.col("id") % 3).cast("string")).alias("library"), F.concat(F.lit("C"), (F.col("id") % 5).cast("string")).alias("name"))
    have = wanted.where("item % 2 = 0 AND name <> 'C4'")
    return shelf.collection_actions(wanted, have)


_VOICES_SQL = "SELECT substring('abefhijpzxq', (p_partkey % 11 + 1)::INT, 1) || substring('fmo', (p_partkey % 3 + 1)::INT, 1) || CASE WHEN p_partkey % 13 = 0 THEN '' ELSE '_' END || CASE WHEN p_partkey % 7 = 0 THEN 'v0' ELSE '' END || replace(p_name, ' ', '_') || p_partkey AS voice FROM part"


def _voices(spark, sf_dir):
    """Parts as voices: a letter each of language and gender, some without the bar, some old."""
    n = F.col("p_partkey")
    letter = lambda letters, n: F.substring(F.lit(letters), n.cast("int") + 1, F.lit(1))
    name = F.concat(letter("abefhijpzxq", n % 11), letter("fmo", n % 3), F.when(n % 13 == 0, "").otherwise("_"), F.when(n % 7 == 0, "v0").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("_")), n.cast("string"))
    return table(spark, sf_dir, "part").select(name.alias("voice"))


@query(f"""
WITH v AS ({_VOICES_SQL}), l AS (SELECT unnest([{', '.join(map(quoted, rules.LANGUAGES))}]) AS k, unnest([{', '.join(map(quoted, rules.LANGUAGES.values()))}]) AS name, generate_subscripts([{', '.join(map(quoted, rules.LANGUAGES))}], 1) AS rank),
g AS (SELECT voice, l.name IS NOT NULL AND voice[2] IN ('f', 'm') AND voice[3] = '_' AS known, CASE WHEN known THEN l.name || ', ' || CASE voice[2] WHEN 'f' THEN 'female' ELSE 'male' END ELSE 'other' END AS "group", CASE WHEN known THEN rank ELSE 10 END AS group_rank FROM v LEFT JOIN l ON voice[1] = l.k)
SELECT group_rank::BIGINT AS group_rank, "group", row_number() OVER (PARTITION BY "group" ORDER BY contains(voice, '_v0'), voice) - 1 AS place, voice FROM g""")
def voice_groups(spark, sf_dir):
    return shelf.grouped_voices(_voices(spark, sf_dir)).withColumn("group_rank", F.col("group_rank").cast("long"))


@query("""
WITH c AS (SELECT conv_id, turn AS chapter_no, round_even(length(text) / 16.0::DOUBLE * 1000, 0)::BIGINT AS ms FROM conversations)
SELECT conv_id, chapter_no, coalesce(sum(ms) OVER w, 0)::BIGINT AS start_ms, (coalesce(sum(ms) OVER w, 0) + ms)::BIGINT AS end_ms FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY chapter_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def chapter_offsets(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("chapter_no"), (F.length("text") / F.lit(16.0)).alias("seconds"))
    return shelf.chapter_offsets(rows, "conv_id").drop("seconds")


def _transcript(spark, sf_dir):
    """Turns as segments; every third conversation's first turn is said again at its end."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("number"), (F.col("turn") * 7.5).alias("start"), F.regexp_replace("text", "\n", " ").alias("text"))
    return rows.union(rows.where("number = 0 AND conv_id % 3 = 0").select("conv_id", F.lit(1000).cast("long"), F.lit(7500.0), "text"))


_TRANSCRIPT = "SELECT conv_id, turn AS number, turn * 7.5::DOUBLE AS start, regexp_replace(text, chr(10), ' ', 'g') AS text FROM conversations UNION ALL SELECT conv_id, 1000, 7500.0, regexp_replace(text, chr(10), ' ', 'g') FROM conversations WHERE turn = 0 AND conv_id % 3 = 0"
_SENTENCES = f"""
  SELECT *, coalesce(sum(length(sentence) + 1) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at, trim(regexp_replace(lower(sentence), '[^a-z0-9 ]', '', 'g')) AS k FROM (
    SELECT conv_id, generate_subscripts(parts, 1) - 1 AS n, unnest(parts) AS sentence FROM (
      SELECT conv_id, list_filter(list_transform(string_split(regexp_replace(string_agg(text, ' ' ORDER BY number), '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda s: trim(s)), lambda s: s <> '') AS parts FROM ({_TRANSCRIPT}) GROUP BY conv_id))"""
_REPEATED = f"SELECT *, CASE WHEN words >= 8 THEN count(*) OVER (PARTITION BY conv_id, k) ELSE 1 END AS times FROM (SELECT *, len(list_filter(string_split_regex(k, ' +'), lambda w: w <> '')) AS words FROM ({_SENTENCES}))"


def _spoken(spark, sf_dir):
    return transcripts.repeated_sentences(transcripts.transcript_sentences(_transcript(spark, sf_dir), "conv_id"), "conv_id")


@query(f"SELECT conv_id, n::INT AS n, k, times FROM ({_REPEATED}) WHERE times > 1")
def transcript_repeats(spark, sf_dir):
    return _spoken(spark, sf_dir).where("times > 1").select("conv_id", "n", "k", "times")


@query(f"SELECT conv_id, min(n)::INT AS first, count(*) AS sentences FROM (SELECT conv_id, n, n - row_number() OVER (PARTITION BY conv_id ORDER BY n) AS island FROM ({_REPEATED}) WHERE times > 1) GROUP BY conv_id, island HAVING count(*) >= 2")
def repeat_runs(spark, sf_dir):
    return transcripts.repeat_runs(_spoken(spark, sf_dir), "conv_id")


@query(f"""
WITH o AS (SELECT conv_id, start, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM ({_TRANSCRIPT})), s AS (SELECT * FROM ({_SENTENCES}))
SELECT s.conv_id, s.n::INT AS n, coalesce(o.start, 0) AS start, printf('%02d:%02d', floor(coalesce(o.start, 0) / 60)::INT, floor(coalesce(o.start, 0) % 60)::INT) AS clock FROM s ASOF LEFT JOIN o ON s.conv_id = o.conv_id AND s.at >= o.at""")
def sentence_asof(spark, sf_dir):
    spoken = transcripts.transcript_sentences(_transcript(spark, sf_dir), "conv_id")
    rows = transcripts.timed(spoken, transcripts.segment_offsets(_transcript(spark, sf_dir), "conv_id"), "conv_id")
    return rows.select("conv_id", "n", "start", transcripts.minutes(F.col("start")).alias("clock"))


@query("SELECT doc_id, substring(text, 1, 6000) AS text, greatest(0, length(text) - 6000)::INT AS dropped FROM documents")
def fit_to_context(spark, sf_dir):
    head, dropped = t.fit_to_context(F.col("text"), 6000)
    return table(spark, sf_dir, "documents").select("doc_id", head.alias("text"), dropped.alias("dropped"))


def _condensed_sql(name: str, source: str, pieces: str) -> str:
    """name (doc_id, text, sections): the first two sentences of each chunk of 1,000 characters as points. pieces: of a text, blank-line parts as a list."""
    parts = f"flatten(list_transform({pieces}, lambda p: list_transform(range(0, ceil(length(p) / 1000.0)::BIGINT), lambda i: {{'done': []::VARCHAR[], 'held': substring(p, (i * 1000 + 1)::BIGINT, 1000), 'alone': i < ceil(length(p) / 1000.0) - 1}})))"
    done = "list_concat(a.done, CASE WHEN a.held <> '' THEN [a.held] ELSE []::VARCHAR[] END)"
    fold = f"""list_reduce({parts}, lambda a, x: CASE WHEN x.alone THEN {{'done': list_concat({done}, [x.held]), 'held': '', 'alone': false}}
      WHEN a.held <> '' AND length(a.held) + 2 + length(x.held) > 1000 THEN {{'done': {done}, 'held': x.held, 'alone': false}}
      ELSE {{'done': a.done, 'held': CASE WHEN a.held = '' THEN x.held ELSE a.held || chr(10) || chr(10) || x.held END, 'alone': false}} END, {{'done': []::VARCHAR[], 'held': '', 'alone': false}})"""
    points = _SPLIT_SQL.format(x="c") + "[1:2]"
    return f"""{name}f AS (SELECT doc_id, {fold} AS a FROM ({source})), {name}c AS (SELECT doc_id, {done} AS chunks FROM {name}f),
{name} AS (SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(flatten(list_transform(chunks, lambda c: {points})), lambda p: {sql_strip('p')}), lambda p: p <> ''), lambda p: '- ' || p), chr(10)) AS text, len(chunks) AS sections FROM {name}c)"""


#: Sentences as the stand-in model cuts them.
_SPLIT_SQL = "string_split(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31))"
_DOUBLED = "(SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents)"
_PARTS = f"list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda z: {sql_strip('z')}), lambda z: z <> '')"

_WHOLE = f"list_filter([{sql_strip('text')}], lambda z: z <> '')"
_LESS = "{now} AS (SELECT {before}.doc_id, CASE WHEN length({before}.text) > 6000 AND coalesce({again}.text, '') <> '' AND length({again}.text) < length({before}.text) THEN {again}.text ELSE {before}.text END AS text, {before}.sections FROM {before} LEFT JOIN {again} USING (doc_id))"


@query(f"""
WITH d AS {_DOUBLED}, {_condensed_sql('one', 'SELECT * FROM d WHERE length(text) > 6000', _PARTS)},
{_condensed_sql('two', 'SELECT * FROM one WHERE length(text) > 6000', _WHOLE)}, {_LESS.format(now='m', before='one', again='two')},
{_condensed_sql('three', 'SELECT * FROM m WHERE length(text) > 6000', _WHOLE)}, {_LESS.format(now='l', before='m', again='three')},
r AS (SELECT doc_id, text, 1 AS sections FROM d WHERE length(text) <= 6000 UNION ALL SELECT * FROM l),
t AS (SELECT doc_id, substring(text, 1, 6000) AS text, greatest(0, length(text) - 6000) AS truncated_chars, sections FROM r),
s AS (SELECT *, {_SPLIT_SQL.format(x=sql_strip('text'))} AS first, list_distinct(regexp_extract_all(lower(text), '\\p{{L}}{{7,}}')) AS words FROM t),
w AS (SELECT doc_id, word, (length(lower(text)) - length(replace(lower(text), word, ''))) / length(word) AS n FROM (SELECT doc_id, text, unnest(words) AS word FROM s)),
g AS (SELECT doc_id, array_to_string(list(word ORDER BY n DESC, word)[1:3], ',') AS tags FROM w GROUP BY doc_id)
SELECT doc_id, truncated_chars::INT AS truncated_chars, sections::INT AS sections, substring(first[1], 1, 60) AS title, first[1] AS tldr, array_to_string(first[1:3], ' ') AS summary, coalesce(tags, '') AS tags FROM s LEFT JOIN g USING (doc_id)""")
def map_reduce_summary(spark, sf_dir):
    """Short texts in one call, long ones by chunks and points, again where the points are too long; a paragraph is a line here."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    found = summaries.summarized(docs, summaries.Extractive(), 6000, 1000)
    return found.withColumn("tags", F.array_join("tags", ","))


@query("SELECT doc_id, list_filter(list_transform(['#' || source, ' ' || upper(lang) || ' ', '##', ''], lambda x: lower(regexp_replace(trim(x), '^#+', ''))), lambda x: x <> '')[1] AS first_tag, len(list_filter(list_transform(['#' || source, ' ' || upper(lang) || ' ', '##', ''], lambda x: lower(regexp_replace(trim(x), '^#+', ''))), lambda x: x <> ''))::INT AS tags FROM documents")
def tag_normalize(spark, sf_dir):
    tags = t.normal_tags(F.array(F.concat(F.lit("#"), "source"), F.concat(F.lit(" "), F.upper("lang"), F.lit(" ")), F.lit("##"), F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", tags[0].alias("first_tag"), F.size(tags).alias("tags"))
