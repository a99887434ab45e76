"""Operators of documents, queues, shelves, transcripts, sources, sinks and streams."""

import datetime
import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.operators import documents as d
from pagemill.operators import lines, queueing, scans, shelf, summaries, transcripts
from pagemill.plans import jobs as plans
from pagemill.plans import registry
from pagemill.sinks import notes
from pagemill.sources import records, web
from pagemill.streaming import queue as streams


def test_pages(spark):
    pages = spark.createDataFrame([(1, 2, "b" * 30), (1, 1, "short"), (1, 3, " "), (2, 1, ""), (1, 4, "x")], "doc int, number int, text string")
    assert sorted((r.doc, r.text) for r in d.assembled(pages, "doc").collect()) == [(1, "short\n\n" + "b" * 30 + "\n\nx"), (2, "")]
    got = {(r.doc, r.number): (r.method, r.reason) for r in d.routed(pages, "doc", 2).collect()}
    assert got[1, 2] == ("text-layer", None) and got[1, 1][0] == got[1, 3][0] == "ocr" and got[1, 4] == ("skipped", "OCR page cap") and got[2, 1][0] == "ocr"


def test_queue_against_a_loop(spark):
    jobs = [(i, i % 3, float(i * 7 % 50), float(i * 13 % 11 + 1)) for i in range(60)]
    rows = spark.createDataFrame(jobs, "id int, q int, arrival double, service double")
    got = {r.id: r.finish for r in queueing.replayed(rows, ["q"], "arrival", "service", ["arrival", "id"]).collect()}
    free = {}
    for i, q, a, s in sorted(jobs, key=lambda j: (j[2], j[0])):
        free[q] = max(free.get(q, 0.0), a) + s
        assert math.isclose(got[i], free[q])


def test_ends_do_not_hang_on_the_order_of_sums(spark):
    rows = spark.createDataFrame([(i, 0.0, 0.1) for i in range(1000)], "id int, arrival double, service double").withColumn("q", F.lit(1))
    got = {r.id: r.finish for r in queueing.replayed(rows, ["q"], "arrival", "service", ["arrival", "id"]).collect()}
    assert got == {i: (i + 1) / 10 for i in range(1000)}


def test_sums_of_doubles_go_by_nodes():
    values = [0.1 * (i % 7) + i for i in range(5000)]
    at = scans.sums(np.array(values))

    def node(size, i):
        if size == 1:
            return values[i]
        total = 0.0
        for j in range(scans.NODE):
            total += node(size // scans.NODE, i * scans.NODE + j)
        return total

    assert len(at) == 5001
    for n in (0, 1, 15, 16, 17, 255, 256, 700, 4095, 4096, 4097, 4999, 5000):
        total, size = 0.0, scans.NODE**3
        while size:
            for i in range(n // (size * scans.NODE) * scans.NODE, n // size):
                total += node(size, i)
            size //= scans.NODE
        assert at[n] == total


def test_sums_of_doubles_with_nulls_and_several_blocks(spark):
    values = [("a", i, None if i < 2 or i == 4100 else 0.1 * i) for i in range(9000)] + [(None, 1, 2.5), (None, 2, None), ("b", 1, None)]
    rows = spark.createDataFrame(values, "q string, n int, x double").repartition(7)
    got = {(r.q, r.n): (r.x, r.s) for r in scans.summed(rows, ["q"], ["n"], F.col("x"), "s").collect()}
    assert {k: v[0] for k, v in got.items()} == {(q, n): x for q, n, x in values}
    at = scans.sums(np.array([x or 0.0 for q, _, x in values if q == "a"]))
    assert all(got["a", n][1] == (None if n < 2 else at[n + 1]) for n in range(9000))
    assert (got[None, 1][1], got[None, 2][1], got["b", 1][1]) == (2.5, 2.5, None)
    assert scans.summed(rows.limit(0), ["q"], ["n"], F.col("x"), "s").collect() == []


def test_quotes_at_whole_minutes_are_those_of_the_sql(spark, tmp_path):
    events = spark.range(9000).select(F.col("id").alias("event_id"), F.lit("2024-01-01 00:00:59").cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("view").alias("event_type"), F.lit(30001.4).alias("value"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
    want = db.execute(registry.SQL["ack_quote"]).fetchall()
    got = [tuple(r) for r in plans.ack_quote(spark, str(tmp_path)).collect()]
    assert len(got) == 9000 and sorted(got) == sorted(want)


def test_calibration_against_the_stream_fold(spark):
    seen = [("audio", i, 10.0, 5.0 + i * i % 17) for i in range(30)] + [("audio", 99, 0.0, 5.0), ("other", 1, 1.0, 1.0), ("ocr", 1, 2.0, 4.0)]
    got = {r.stage: r for r in queueing.calibrated(spark.createDataFrame(seen, "stage string, n long, predicted double, actual double"), ["n"]).collect()}
    state = (0.0, 0.0, 0)
    for stage, _, p, a in seen:
        if stage == "audio":
            state = streams.observe(state, p, a)
    assert got["audio"].n == 30 == state[2] and math.isclose(got["audio"].log_factor, state[0]) and math.isclose(got["audio"].spread, state[1])
    assert set(got) == {"audio", "ocr"} and math.isclose(got["ocr"].factor, 2.0) and got["ocr"].spread == 0


def test_clock(spark):
    now = datetime.datetime(2024, 5, 6, 21, 50)
    row = spark.createDataFrame([(now,)], "now timestamp").select(queueing.clock(F.col("now"), F.lit(1200).cast("decimal(18,6)"), F.lit("Europe/Berlin")).alias("a"), queueing.clock(F.col("now"), F.lit(60).cast("decimal(18,6)"), F.lit(None).cast("string")).alias("b")).first()
    assert row.a == "00:10 tomorrow" and row.b == "21:51"


def test_settings(spark):
    layers = spark.createDataFrame([("default", None, "tts_voice", "a"), ("env", None, "tts_voice", "b"), ("shared", None, "tts_voice", "c"), ("user", "u", "tts_voice", "d"), ("user", "u", "model", "x"), ("default", None, "model", "m")], "layer string, user string, key string, value string")
    got = {(r.user, r.key): (r.value, r.layer) for r in queueing.resolved_settings(layers, spark.createDataFrame([("u",), ("v",)], "user string")).collect()}
    assert got == {("u", "tts_voice"): ("d", "user"), ("v", "tts_voice"): ("c", "shared"), ("u", "model"): ("m", "default"), ("v", "model"): ("m", "default")}


def test_shelf(spark):
    items = spark.createDataFrame([(1, "t1", "", ["x"]), (2, "t2", "", ["Ana"]), (3, "t3", "Old", ["Ana"]), (4, "t4", "", ["Ben"]), (5, "voice samples", "", [])], "id int, title string, series string, tags array<string>")
    assert sorted(r.id for r in shelf.candidates(items, "Ana").collect()) == [1, 3]
    assert items.select(shelf.retagged(F.array(F.lit("x"), F.lit("Ben")), "Ana").alias("o")).first().o == ["Ana", "x"]
    wav = b"RIFF" + b"\0" * 32 + b"data" + b"\0" * 4 + b"\0" * 48000
    assert spark.createDataFrame([(wav,)], "b binary").select(shelf.wav_seconds(F.col("b")).alias("s")).first().s == 1.0
    patch = spark.range(1).select(shelf.metadata_patch(F.lit("T"), F.lit(""), F.lit(None).cast("string"), F.array().cast("array<string>")).alias("p"), shelf.metadata_patch(F.lit(""), F.lit(""), F.lit(""), F.array().cast("array<string>")).alias("q")).first()
    assert json.loads(patch.p) == {"title": "T"} and patch.q is None


def test_repeated_paragraphs(spark):
    long = "The quick brown fox, again and again. " * 6
    docs = spark.createDataFrame([(1, f"{long}\n\nother\n\n{long.upper()}\n\n{long}"), (2, long)], "doc_id int, text string")
    got = lines.repeated_paragraphs(docs).collect()
    assert [(r.doc_id, r.paragraph, r.times, r.second) for r in got] == [(1, long, 3, 2)]
    assert [(r.documents, r.first) for r in lines.shared_paragraphs(docs, separator="\n\n").collect()] == [(2, 1)]


def test_transcripts(spark):
    said = "This sentence has at least eight words in it. And this one also has eight words in it."
    rows = spark.createDataFrame([(1, 0, 0.0, said), (1, 1, 9.5, "Short one. " + said)], "conv int, number int, start double, text string")
    spoken = transcripts.repeated_sentences(transcripts.transcript_sentences(rows, "conv"), "conv")
    assert [(r["first"], r.sentences) for r in transcripts.repeat_runs(spoken, "conv").orderBy("first").collect()] == [(0, 2), (3, 2)]
    timed = {r.n: r.start for r in transcripts.timed(spoken, transcripts.segment_offsets(rows, "conv"), "conv").collect()}
    assert timed == {0: 0.0, 1: 0.0, 2: 9.5, 3: 9.5, 4: 9.5}


def test_summaries(spark):
    text = "\n\n".join(f"Paragraph {i} begins. It goes on for a while with words. And it ends." for i in range(60))
    got = {r.doc_id: r for r in summaries.summarized(spark.createDataFrame([(1, "One. Two."), (2, text), (3, None)], "doc_id int, text string"), summaries.Extractive(), 1000, 400).collect()}
    assert got[1].sections == 1 and got[1].tldr == "One." and got[2].sections > 5 and got[2].truncated_chars >= 0 and got[3].summary == ""


def test_web(spark):
    html = "<html><title> A  B </title><nav>menu</nav><script>var t='</p>'</script><div class='ad'>buy</div><article><h2>Head</h2><p>One &amp; <a href='https://x.y'>two</a><br>three</p></article><footer>f</footer></html>"
    got = web.web_documents(spark.createDataFrame([(1, "http://u", html), (2, "http://v", "<p></p>")], "page_id int, url string, html string")).orderBy("page_id").collect()
    assert got[0].title == "A B" and got[0].text == "## Head\n\nOne & [two](https://x.y) three" and got[0].error is None
    assert got[1].title == "http://v" and "no article content" in got[1].error


def test_records(spark, tmp_path):
    job = {"id": "2", "channel": "c", "thread_ts": "t", "target": "x", "source_label": "l"}
    for name, text in (("b.json", json.dumps(job)), ("a.json", json.dumps(job | {"id": "1", "attempts": 2})), ("bad.json", "{"), ("more.json", json.dumps(job | {"odd": 1})), ("less.json", '{"id": "9"}'), ("x.audio", json.dumps(job | {"id": "7"}))):
        (tmp_path / name).write_text(text)
    assert [(r.id, r.attempts) for r in records.jobs(spark, str(tmp_path)).orderBy("id").collect()] == [("1", 2), ("2", 0)]
    assert [r.id for r in records.jobs(spark, str(tmp_path), "*.audio").collect()] == ["7"]
    (tmp_path / "t.jsonl").write_text('{"start": 0, "end": 1, "text": "a"}\n\nnot json\n{"start": 1, "end": 2, "text": "b"}\n')
    assert [r.text for r in records.transcript(spark, str(tmp_path / "t.jsonl")).collect()] == ["a", "b"]


def listing(page, size):
    """Five items in pages."""
    rows = [{"id": str(i), "title": f"t{i}", "series": "", "narrator": "n", "tags": ["x"]} for i in range(5)]
    return rows[page * size : (page + 1) * size], len(rows)


def test_paged_source(spark):
    spark.dataSource.register(records.PagedSource)
    assert listing(1, 2)[0][0]["id"] == "2"
    rows = spark.read.format("paged_listing").option("fetch", "test_operators.listing").option("page_size", "2").load()
    assert len(rows.columns) == 5


def test_notes(spark, tmp_path):
    rows = spark.createDataFrame([("A/B", "---\nx\n---\n# T")], "title string, markdown string")
    notes.write_markdown(rows.union(rows), f"file://{tmp_path}/n")
    assert {f.name for f in (tmp_path / "n").iterdir()} == {"AB.md", "AB 2.md"} and (tmp_path / "n" / "AB.md").read_text().endswith("# T")
    assert bytes(notes.exported(rows, "md").first().content).decode().endswith("# T")
    assert notes.exported(rows, "docx").first().error in (None, "pandoc is not installed")
    with pytest.raises(ValueError):
        notes.exported(rows, "none")


def test_streams(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [(i, base + datetime.timedelta(minutes=i), i % 2, "a", 1.0, "{}") for i in range(120)]
    spark.createDataFrame(rows, streams.EVENTS).write.parquet(str(tmp_path / "e.parquet"))
    got = streams.finished(streams.windowed(streams.event_stream(spark, str(tmp_path / "e.parquet")), "1 hour"), "complete").collect()
    assert sorted(r.n for r in got) == [60, 60]
    twice = streams.event_stream(spark, str(tmp_path / "e.parquet")).select("event_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    assert streams.finished(streams.deduplicated(twice, ["event_id"]), "append").count() == 120


def test_chained_stages_go_on_after_a_restart(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = lambda a, b: spark.createDataFrame([(i, base, i % 2, "a", 1.0, "{}") for i in range(a, b)], streams.EVENTS)
    rows(0, 5).write.parquet(str(tmp_path / "in"))
    for more in (None, rows(5, 9)):
        if more is not None:
            more.write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(streams.EVENTS).parquet(str(tmp_path / "in"))
        _, done = streams.chained(source, str(tmp_path / "one"), str(tmp_path / "two"), lambda x: x.withColumn("event_id", F.col("event_id") * 10))
    assert sorted(r.event_id for r in spark.read.parquet(done).collect()) == [10 * i for i in range(9)]


def test_catalog():
    from pagemill import catalog

    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.queries()) > 55


def test_engine(spark):
    from pagemill import engine

    docs = spark.createDataFrame([(1, "http://x.y/a", "link", "A page", "# Head\nOne sentence here. Another one there.\n## Part\nText."), (2, "/in/scan_3.pdf", "pdf", None, "Plain text of a file. It ends.")], "doc_id int, source string, kind string, title string, text string")
    found = {r.doc_id: r for r in engine.notes(docs, "2024-05-06").collect()}
    assert found[1].title == "A page" and "## TL;DR" in found[1].markdown and found[2].title == "Plain text of a file."
    spoken = engine.script(docs.withColumns({"tldr": F.lit("short"), "summary": F.lit("long")}), 500).collect()
    assert {r.title for r in spoken} >= {"Summary", "Full article"}
    assert {r.pattern: r.hits for r in engine.lint(spark.createDataFrame(spoken)).collect()}["url"] == 0
    pages = spark.createDataFrame([(1, 1, "x" * 40), (1, 2, "")], "doc int, number int, text string")
    assert engine.extract(pages, "doc").first().text == "x" * 40 and engine.probe(pages, "doc").first().has_text
