"""Queries of streams that keep state across restarts, of retries, spools, settings over time and PDF files."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill import engine
from pagemill.functions import rules
from pagemill.operators import chat, clients, documents, queueing as q, settings, transcripts
from pagemill.plans.control import _COMMAND_VOICES, _COMMANDS_SQL, _commands
from pagemill.plans.jobs import _CALIBRATED, _REPEATED, _STAGE, _observations, _spoken, halves
from pagemill.plans.registry import query, table
from pagemill.sinks.files import write_files
from pagemill.sources import pdf, spool
from pagemill.storage import bounded_batches, own_folder
from pagemill.streaming import cancels, queue as streams


def _in_halves(spark, sf_dir, made: Callable[[Callable[[], DataFrame]], DataFrame]) -> DataFrame:
    """What a stream of events makes that is stopped after their first half and goes on with the second. made: gets what opens the source."""
    folder, out = own_folder(spark), None
    for half in halves(table(spark, sf_dir, "events")):
        half.write.mode("append").parquet(f"{folder}/events")
        out = streams.finished(made(lambda: spark.readStream.schema(streams.EVENTS).parquet(f"{folder}/events").withColumn("ts", F.col("ts").cast("timestamp"))), "append", folder)
    return out


# --- cancels -------------------------------------------------------------------------------------

_MARKS = """
e AS (SELECT user_id::VARCHAR AS thread, event_id::VARCHAR AS job, event_id, event_type, ts, ts + to_minutes(event_id % 600) AS done FROM events),
x AS (SELECT thread, job, 'add' AS kind, ts AS tick, event_id * 4 AS seq FROM e WHERE event_type IN ('view', 'purchase')
  UNION ALL SELECT thread, job, 'done', done, event_id * 4 + 2 FROM e WHERE event_type IN ('view', 'purchase') AND event_id % 6 > 0
  UNION ALL SELECT thread, job, 'add', done, event_id * 4 + 1 FROM e WHERE event_type IN ('view', 'purchase') AND event_id % 6 = 3
  UNION ALL SELECT thread, job, 'done', done + INTERVAL 1 HOUR, event_id * 4 + 3 FROM e WHERE event_type IN ('view', 'purchase') AND event_id % 6 = 3
  UNION ALL SELECT thread, NULL, 'cancel', ts, event_id * 4 FROM e WHERE event_type = 'error')"""
_LIVES = f"""
{_MARKS}, upto AS (SELECT date_trunc('minute', max(tick) - INTERVAL 12 HOURS) AS t FROM x),
r AS (SELECT *, sum(CASE kind WHEN 'add' THEN 1 ELSE -1 END) OVER (PARTITION BY thread, job ORDER BY tick, seq) AS n FROM x WHERE kind <> 'cancel'),
l AS (SELECT thread, job, min(struct_pack(tick := tick, seq := seq)) AS first, min(struct_pack(tick := tick, seq := seq)) FILTER (n = 0) AS last FROM r GROUP BY thread, job),
c AS (SELECT thread, struct_pack(tick := tick, seq := seq) AS place FROM x WHERE kind = 'cancel')"""


def _marks(events: DataFrame) -> DataFrame:
    """Adds, second adds, dones and cancels of events; every sixth job is never done, every sixth is queued again before its first run ends."""
    c = F.col
    work, done = c("event_type").isin("view", "purchase"), c("ts") + F.make_dt_interval(mins=(c("event_id") % 600).cast("int"))
    mark = lambda kind, at, k: F.struct(F.lit(kind).alias("kind"), at.alias("at"), (c("event_id") * 4 + k).alias("seq"))
    none = F.array().cast("array<struct<kind: string, at: timestamp, seq: bigint>>")
    again = F.when(c("event_id") % 6 == 3, F.array(mark("add", done, 1), mark("done", done + F.expr("INTERVAL 1 HOUR"), 3))).otherwise(none)
    own = F.concat(F.array(mark("add", c("ts"), 0)), F.when(c("event_id") % 6 > 0, F.array(mark("done", done, 2))).otherwise(none), again)
    marks = F.when(work, own).when(c("event_type") == "error", F.array(mark("cancel", c("ts"), 0)))
    return events.select(c("user_id").cast("string").alias("thread"), F.when(work, c("event_id").cast("string")).alias("job"), F.explode(marks).alias("m")).select("thread", "job", "m.*")


@query(f"""WITH {_LIVES}
SELECT thread, job, first.tick AS added, last.tick AS ended, (SELECT min(c.place).tick FROM c WHERE c.thread = l.thread AND c.place > l.first AND c.place < coalesce(l.last, struct_pack(tick := l.first.tick + INTERVAL 7 DAYS, seq := 0::BIGINT))) AS canceled_at
FROM l, upto WHERE last.tick < t OR last IS NULL AND first.tick + INTERVAL 7 DAYS < t""")
def stream_cancels(spark, sf_dir):
    """What cancels stop, as keyed state, with a restart: lives of jobs that are over or given up when the stream ends."""
    with cancels.state_store(spark):
        found = _in_halves(spark, sf_dir, lambda source: cancels.lives_stream(_marks(source()).withWatermark("at", "12 hours")))
    return found.select("thread", "job", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("added", "ended", "canceled_at")])


@query(f"""WITH {_LIVES}
SELECT thread, job, first.tick AS added, last.tick AS ended, (SELECT min(c.place).tick FROM c WHERE c.thread = l.thread AND c.place > l.first AND c.place < l.last) AS canceled_at FROM l WHERE last IS NOT NULL""")
def canceled_lives(spark, sf_dir):
    """The same of the whole table, by windows."""
    found = cancels.lives(_marks(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))))
    return found.select("thread", "job", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("added", "ended", "canceled_at")])


@query("SELECT event_id, event_type FROM events")
def stream_dedupe(spark, sf_dir):
    """Events that come twice within the watermark count once; a restart keeps what was seen, and two days drop it."""
    twice = lambda rows: rows.withWatermark("ts", "2 days").select("event_id", "event_type", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    found = _in_halves(spark, sf_dir, lambda source: streams.deduplicated(twice(source()), ["event_id"]))
    return found.select("event_id", "event_type")


# --- predictions and what came of them -----------------------------------------------------------

_DONE = "ts + to_minutes(event_id % 600)"
_PAIRS = f"""p AS (SELECT event_id AS job, {_STAGE} AS stage, json_extract(props, '$.k')::DOUBLE AS predicted, ts AS tick, value AS actual, CASE WHEN event_id % 6 > 0 THEN {_DONE} END AS done FROM events),
m AS (SELECT job, stage, predicted, tick, CASE WHEN done <= tick + INTERVAL 8 HOURS THEN actual END AS actual, CASE WHEN done <= tick + INTERVAL 8 HOURS THEN done END AS done FROM p)"""


def _pairs(source) -> DataFrame:
    c = F.col
    seen = _observations(source().withColumn("at", c("ts")))
    predictions = seen.select(c("event_id").alias("job"), "stage", "predicted", c("ts").alias("at")).withWatermark("at", "1 hour")
    done = c("ts") + F.make_dt_interval(mins=(c("event_id") % 600).cast("int"))
    actuals = source().where("event_id % 6 > 0").select(c("event_id").alias("job"), c("value").alias("actual"), done.alias("done")).withWatermark("done", "12 hours")
    return streams.matched(predictions, actuals, "8 HOURS")


@query(f"""WITH {_PAIRS}, w AS (SELECT least(max(tick) - INTERVAL 1 HOUR, max(CASE WHEN event_id % 6 > 0 THEN {_DONE} END) - INTERVAL 12 HOURS) AS t FROM (SELECT event_id, ts, ts AS tick FROM events))
SELECT job, stage, predicted, actual, done FROM m, w WHERE done IS NOT NULL OR tick + INTERVAL 8 HOURS < t""")
def stream_predictions(spark, sf_dir):
    """Predictions joined with actuals as two streams, with a restart; jobs that were never done once the watermark is past their time."""
    found = _in_halves(spark, sf_dir, _pairs)
    return found.select("job", "stage", "predicted", "actual", F.col("done").cast("timestamp_ntz").alias("done"))


@query(f"""WITH RECURSIVE {_PAIRS}, o AS (SELECT stage, done AS ts, job AS event_id, predicted AS p, actual AS a FROM m WHERE done IS NOT NULL),{_CALIBRATED.split("FROM events),", 1)[1]}""")
def calibration_of_matches(spark, sf_dir):
    """What the matched pairs of the two streams teach, in the order in which jobs were done."""
    found = _in_halves(spark, sf_dir, _pairs).where("done is not null")
    return q.calibrated(found, ["done", "job"]).withColumns({c: F.round(c, 6) for c in ("log_factor", "spread", "factor", "upper")})


# --- retries -------------------------------------------------------------------------------------

_TRIES = "CASE WHEN event_id % 13 = 0 THEN 3 WHEN event_id % 5 = 0 THEN 1 ELSE 0 END"


@query(f"""
WITH RECURSIVE j AS (SELECT event_type AS q, event_id AS job, (floor(epoch(ts)) * 1000)::BIGINT AS arrival, (floor(abs(value) * 12000) + 1000)::BIGINT AS service, {_TRIES} AS failures FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY arrival, job) AS nth FROM j),
s(q, nth, free, late, job, attempt, arrival, start, finish, outcome) AS (
  SELECT DISTINCT q, 1::BIGINT, 0::BIGINT, []::STRUCT(tick BIGINT, attempt BIGINT, job BIGINT, service BIGINT, failures BIGINT)[], NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR FROM j
  UNION ALL
  SELECT q, nth, finish, CASE WHEN outcome = 'requeued' THEN list_append(late, struct_pack(tick := finish, attempt := attempt + 1, job := job, service := service, failures := failures)) ELSE late END, job, attempt, arrival, start, finish, outcome
  FROM (SELECT *, greatest(free, arrival) AS start, greatest(free, arrival) + service AS finish, CASE WHEN attempt >= failures THEN 'done' WHEN attempt < 2 THEN 'requeued' ELSE 'gave up' END AS outcome
    FROM (SELECT s.q, CASE WHEN fresh THEN s.nth + 1 ELSE s.nth END AS nth, s.free, CASE WHEN fresh THEN s.late ELSE s.late[2:] END AS late,
        CASE WHEN fresh THEN n.job ELSE s.late[1].job END AS job, CASE WHEN fresh THEN 0 ELSE s.late[1].attempt END AS attempt, CASE WHEN fresh THEN n.arrival ELSE s.late[1].tick END AS arrival,
        CASE WHEN fresh THEN n.service ELSE s.late[1].service END AS service, CASE WHEN fresh THEN n.failures ELSE s.late[1].failures END AS failures
      FROM s LEFT JOIN n ON n.q = s.q AND n.nth = s.nth, LATERAL (SELECT n.job IS NOT NULL AND (len(s.late) = 0 OR n.arrival <= s.late[1].tick) AS fresh) f WHERE n.job IS NOT NULL OR len(s.late) > 0)))
SELECT job, q AS event_type, attempt::INTEGER AS attempt, arrival, start, finish, outcome FROM s WHERE job IS NOT NULL""")
def retry_replay(spark, sf_dir):
    """Queues under load in which failed jobs go to the back: when each attempt starts and ends, and how it ends."""
    c = F.col
    failures = F.when(c("event_id") % 13 == 0, 3).when(c("event_id") % 5 == 0, 1).otherwise(0)
    arrival = F.unix_timestamp(c("ts").cast("timestamp")) * 1000
    jobs = table(spark, sf_dir, "events").select(c("event_id").alias("job"), "event_type", arrival.alias("arrival"), (F.floor(F.abs("value") * 12000) + 1000).alias("service"), failures.alias("failures"))
    return q.replayed_with_retries(jobs, "event_type")


# --- spools --------------------------------------------------------------------------------------

_BAD = "conv_id % 10 = 3"


@query(f"""
SELECT lpad(conv_id::VARCHAR, 19, '0') || '.json' AS name, CASE WHEN NOT ({_BAD}) THEN lpad(conv_id::VARCHAR, 19, '0') END AS id, CASE WHEN NOT ({_BAD}) THEN string_agg(role, ',' ORDER BY turn) END AS source_label, CASE WHEN {_BAD} THEN NULL ELSE conv_id % 3 END::INTEGER AS attempts, {_BAD} AS bad
FROM conversations GROUP BY conv_id""")
def stream_spool(spark, sf_dir):
    """Conversations as records of a spool, read as a stream that is stopped between two loads; a tenth of them can't be read."""
    c, folder = F.col, own_folder(spark)
    who = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda t: t["role"]), ",")
    jobs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(who.alias("source_label")).select(
        F.lpad(c("conv_id").cast("string"), 19, "0").alias("id"), F.lit("C1").alias("channel"), c("conv_id").cast("string").alias("thread_ts"), F.lit("x").alias("target"), "source_label", (c("conv_id") % 3).cast("int").alias("attempts"), "conv_id",
    )
    body = F.to_json(F.struct(*[x for x in jobs.columns if x != "conv_id"]))
    files = jobs.select("id", F.concat("id", F.lit(".json")).alias("name"), F.when(F.expr(_BAD), F.substring(body, 1, 20)).otherwise(body).cast("binary").alias("content"))
    middle = jobs.agg((F.max("conv_id") / 2).cast("long").alias("m")).first()["m"]
    cut, out = F.lpad(F.lit(str(middle)), 19, "0"), None
    for part in (files.where(c("id") <= cut), files.where(c("id") > cut)):
        write_files(part, f"{folder}/spool").count()
        out = streams.finished(spool.spool_stream(spark, f"{folder}/spool"), "append", folder)
    return out.select("name", "id", "source_label", F.when(c("error").isNull(), c("attempts")).alias("attempts"), c("error").isNotNull().alias("bad"))


# --- settings over time --------------------------------------------------------------------------

_HISTORY = f"""{_COMMANDS_SQL},
a AS (SELECT ts AS event_id, "user", key, value FROM v WHERE value IS NOT NULL),
n AS (SELECT e.ts, a.*, CASE WHEN event_id % 8 = 5 THEN '' ELSE a.value END AS said FROM a JOIN events e USING (event_id)),
i AS (SELECT "user", key, said AS value, ts AS valid_from, lead(ts) OVER (PARTITION BY "user", key ORDER BY ts, event_id) AS valid_to FROM n),
h AS (SELECT * FROM i WHERE value <> '' AND (valid_to IS NULL OR valid_to > valid_from))"""


def _history(spark, sf_dir):
    """Every third command comes late, after the others have been made into a history."""
    c = F.col
    found = chat.commands(_commands(spark, sf_dir), F.array(*map(F.lit, _COMMAND_VOICES))).where("value is not null").withColumnRenamed("ts", "seq")
    times = table(spark, sf_dir, "events").select(c("event_id").alias("seq"), "ts")
    said = found.join(times, "seq").select("ts", "seq", "user", "key", F.when(c("seq") % 8 == 5, "").otherwise(c("value")).alias("value"))
    return settings.merged(settings.intervals(said.where("seq % 3 > 0")), said.where("seq % 3 = 0"))


@query(f'{_HISTORY} SELECT "user", key, value, valid_from, valid_to FROM h')
def settings_history(spark, sf_dir):
    """From when until when each setting held, made in two loads of which the second has commands from between the first's."""
    return _history(spark, sf_dir).where("value is not null")


@query(f"""{_HISTORY},
q AS (SELECT event_id, user_id::VARCHAR AS u, ts FROM events WHERE event_type = 'purchase'),
m AS (SELECT event_id, key, coalesce(max(value) FILTER (h."user" IS NOT NULL), max(value)) AS value FROM q JOIN h ON (h."user" = q.u OR h."user" IS NULL) AND h.valid_from <= q.ts AND (h.valid_to IS NULL OR h.valid_to > q.ts) GROUP BY event_id, key)
SELECT q.event_id, coalesce((SELECT string_agg(key || '=' || value, ';' ORDER BY key) FROM m WHERE m.event_id = q.event_id), '') AS settings FROM q""")
def settings_as_of(spark, sf_dir):
    """What held for a user at the time of each purchase: the user's own setting, else everyone's."""
    asks = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", F.col("user_id").cast("string").alias("user"), F.col("ts").alias("at"))
    found = settings.settings_at(asks, _history(spark, sf_dir))
    told = F.array_join(F.transform(F.map_entries("settings"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select("event_id", told.alias("settings"))


@query(f"""{_HISTORY}
SELECT "user", '{{' || string_agg('"' || key || '":"' || value || '"', ',' ORDER BY key) || '}}' AS body FROM h WHERE valid_to IS NULL GROUP BY ALL""")
def settings_sections(spark, sf_dir):
    """The settings that hold now as JSON sections, written and read again."""
    now = _history(spark, sf_dir).where("valid_to is null")
    return settings.sections(settings.layers(settings.sections(now)))


# --- repeated sentences --------------------------------------------------------------------------


@query(f"SELECT conv_id, k, count(*) AS times, array_to_string(list(n ORDER BY n)[1:3], ',') AS places FROM ({_REPEATED}) WHERE times > 1 GROUP BY conv_id, k")
def repeat_places(spark, sf_dir):
    """Where each repeated sentence is said: the first three places, and how many there are."""
    found = transcripts.repeat_places(_spoken(spark, sf_dir), "conv_id", 3)
    return found.select("conv_id", "k", "times", F.array_join(F.transform("places", lambda n: n.cast("string")), ",").alias("places"))


# --- PDF -----------------------------------------------------------------------------------------

PAGE_LINES = 40


def written(title: str, pages: list[list[str]]) -> bytes:
    """A PDF of lines: a Flate stream a page, codes of two bytes that are UTF-16."""
    cmap = b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange endcmap"
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 4 0 R >>", 4: b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap), 5: b"<< /Title <FEFF%s> >>" % title.encode("utf-16-be").hex().encode()}
    kids = []
    for lines in pages:
        shown = b" T* ".join(b"<%s> Tj" % x.encode("utf-16-be", "surrogatepass").hex().encode() for x in lines)
        body = zlib.compress(b"BT /F1 10 Tf 12 TL 1 0 0 1 50 780 Tm " + shown + b" ET")
        n = 6 + 2 * len(kids)
        objects[n] = b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (n + 1)
        objects[n + 1] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(body) + body + b"\nendstream"
        kids.append(b"%d 0 R" % n)
    objects[2] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(kids))
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % o for o in sorted(objects.items())) + b"trailer\n<< /Root 1 0 R /Info 5 0 R >>\n%%EOF"


def _pdfs(spark, sf_dir):
    """Documents as PDFs of pages of lines; every ninth is cut off, every seventh has a junk title."""

    def run(batches):
        for b in batches:
            content = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                data = written("Microsoft Word - final" if doc_id % 7 == 0 else f"A study of case {doc_id}", [lines[i : i + PAGE_LINES] for i in range(0, len(lines), PAGE_LINES)])
                content.append(data[:60] if doc_id % 9 == 0 else data)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(content, pa.binary())], ["doc_id", "content"])

    bounded_batches(spark)
    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "doc_id long, content binary")


_PDF_PAGES = f"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE doc_id % 9 > 0),
g AS (SELECT doc_id, (i // {PAGE_LINES} + 1)::INT AS number, string_agg(line, chr(10) ORDER BY i) AS text FROM l GROUP BY 1, 2)"""


@query(f"WITH {_PDF_PAGES} SELECT doc_id, number, text, false AS failed FROM g UNION ALL SELECT doc_id, NULL, NULL, true FROM documents WHERE doc_id % 9 = 0")
def pdf_pages(spark, sf_dir):
    """The text layer of documents that were written as PDFs; files that are cut off say so."""
    found = pdf.pages(_pdfs(spark, sf_dir), "doc_id")
    return found.select("doc_id", "number", "text", F.col("error").isNotNull().alias("failed"))


@query(f"""WITH {_PDF_PAGES}, s AS (SELECT doc_id, coalesce(sum(length(text)) FILTER (n >= {rules.MIN_PAGE_CHARS}), 0)::BIGINT AS chars, least(5, count(*) FILTER (n < {rules.MIN_PAGE_CHARS})) AS ocr_pages FROM (SELECT *, length(regexp_replace(text, '\\s+', '', 'g')) AS n FROM g) GROUP BY doc_id)
SELECT s.*, CASE WHEN doc_id % 7 > 0 THEN 'A study of case ' || doc_id END AS title FROM s""")
def pdf_scan(spark, sf_dir):
    """Sizes and titles of the same files, from their bytes."""
    found = pdf.pages(_pdfs(spark, sf_dir), "doc_id").where("error is null")
    return documents.size_scan(found, "doc_id", 5, pdf.title_of(F.col("title")).alias("title"))


# --- services outside ----------------------------------------------------------------------------


class Moody:
    """A stand-in for a service: by the length of what it gets it answers at once, at the second try, or not at all."""

    def __init__(self) -> None:
        self.waiting: set[str] = set()  # what was turned away once and not yet sent again

    def __call__(self, value: str) -> str:
        if len(value) % 7 == 0:
            raise clients.Rejected(f"too odd: {len(value)}")
        if len(value) % 11 == 0:
            raise clients.Unreachable("no answer")
        if len(value) % 5 == 0 and value not in self.waiting:
            self.waiting.add(value)
            raise clients.Unreachable("no answer")
        self.waiting.discard(value)
        if len(value) % 13 == 0:
            raise clients.TimedOut("no end")
        return value[::-1]


@query("""
SELECT doc_id, CASE WHEN failure IS NULL THEN sha256(reverse(text)) END AS digest, CASE failure WHEN 'unreachable' THEN 3 ELSE CASE WHEN failure IS DISTINCT FROM 'rejected' AND n % 5 = 0 THEN 2 ELSE 1 END END AS tries, failure, CASE failure WHEN 'rejected' THEN 'too odd: ' || n WHEN 'unreachable' THEN 'no answer' WHEN 'timed out' THEN 'no end' END AS detail
FROM (SELECT doc_id, text, n, CASE WHEN n % 7 = 0 THEN 'rejected' WHEN n % 11 = 0 THEN 'unreachable' WHEN n % 13 = 0 THEN 'timed out' END AS failure FROM (SELECT doc_id, 'Doc ' || doc_id || ' ' || text AS text, length('Doc ' || doc_id || ' ' || text) AS n FROM documents))""")
def service_calls(spark, sf_dir):
    """Whole texts sent to a service that is there only now and then: a row for every outcome."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Doc "), F.col("doc_id").cast("string"), F.lit(" "), "text").alias("text"))
    found = clients.called(rows, "doc_id", "text", Moody(), "string", (0.0, 0.0))
    return found.select("doc_id", F.sha2(F.col("result").cast("binary"), 256).alias("digest"), "tries", "failure", "detail")


@query("SELECT doc_id || '.txt' AS name, CASE WHEN doc_id % 2 = 0 THEN 'kept' ELSE 'created' END AS outcome FROM documents")
def excerpts_kept(spark, sf_dir):
    """Heads of documents as files, made in two runs: the second keeps what the first has made."""
    folder, docs = own_folder(spark), table(spark, sf_dir, "documents").select("doc_id", "text")
    engine.excerpts(docs.where("doc_id % 2 = 0"), f"{folder}/excerpts", 2000).count()
    return engine.excerpts(docs, f"{folder}/excerpts", 2000)
