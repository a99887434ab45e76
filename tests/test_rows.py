"""Rows that must not get lost, multiply or end the session; expectations written by hand."""

import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from pagemill import storage
from pagemill.functions import folds, rules, rx, text as t, variants
from pagemill.operators import documents as d
from pagemill.operators import clients, lines, queueing, shelf, summaries
from pagemill.plans import control, live


def one(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    out = [r.o for r in rows.select("i", f(F.col("x")).alias("o")).orderBy("i").collect()]
    return out[0] if len(out) == 1 else out


def test_scenes(spark):
    assert one(spark, t.clean_scene, 'A wooden door with a brass plaque reading "Library" at the end of a hall.', "A desk with books under a banner that says Welcome, lit by a lamp.", "An old woman reading a book by a window.", "Signs labeled 'A', 'B', and 'C' to block it") == [
        "A wooden door at the end of a hall.", "A desk with books, lit by a lamp.", "An old woman reading a book by a window.", "Signs to block it"]
    assert one(spark, t.clean_scene, "labeled 'x'" + ", and 'x'" * 20_000 + " end", "a" + "," * 100_000 + " b", "a" + " " * 100_000 + "b", "labeled 'x'" + ", or" * 30_000 + " 'y'") == ["end", "a, b", "a b", ""]


def test_scenes_are_what_the_rules_make(spark):
    """Rules that run only where they can match give what they give over whole texts, and take less time."""
    r = random.Random(5)
    bits = ["labeled", "LABELED", "reading", "\u017fays", "t\u0130tled", "t\u0131tled", "mar\u212aed", "inscribed", "with", "the", "text", "that", "holding", "under", "sign", "\u017figns", "banners", "t\u0131tle", *"''\"\u2018\u2019\u201c\u201d,,;..    \n\r\x85\u2028\xa0-\u0301\u00e9a_", "and", "or"]
    rows = [(i, "".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randrange(40)))) for i in range(3000)] + [(-1, None), (-2, "")]
    whole = lambda x: F.regexp_replace(rx.apply(x, rules.SCENE), "^[ ,;]+|[ ,;]+$", "")
    found = spark.createDataFrame(rows, "i long, x string").select("x", t.clean_scene(F.col("x")).alias("a"), whole(F.col("x")).alias("b"))
    assert found.where("not (a <=> b)").collect() == []
    plain = spark.range(0, 400, 1, 1).select(F.repeat(F.concat(F.lit("the river ran past a mill. it was late and the road was long, "), "id", F.lit(". ")), 100).alias("x")).localCheckpoint()

    def took(f) -> float:
        begun = time.monotonic()
        plain.select(f(F.col("x"))).write.format("noop").mode("overwrite").save()
        return time.monotonic() - begun

    assert min(took(t.clean_scene) for _ in range(3)) < 0.8 * min(took(whole) for _ in range(3))


UNITS = ["a", " ", "\n", ",", ", ", "'x', ", "\"", "[", "](", "*", "_", "#", "`", "<", "<a>", "1/", "- ", "> ", "| ", "\\[", "holding a ", "x-"]


@pytest.mark.parametrize("unit", UNITS)
def test_no_pattern_overflows(spark, unit):
    """Every fixed rule over a long run of one unit, in Java's own matcher."""
    java = spark.sparkContext._jvm.java.util.regex.Pattern
    text = unit * 4_000
    for pattern, flags, new in [*rules.HYGIENE_LINES, *rules.HYGIENE_INLINE, rules.HYPHEN_BREAK, *rules.SCENE, *rules.LATEX]:
        java.compile(rx.spark_pattern(pattern, flags)).matcher(text).replaceAll(new)


def test_jobs_ahead_keeps_null_queues_and_repeated_rows(spark):
    jobs = [(1, "a", 0.0, 5.0), (2, "a", 1.0, 9.0), (2, "a", 1.0, 9.0), (3, None, 0.0, 2.0), (4, None, 1.0, 4.0), (5, "a", 6.0, 11.0)]
    rows = spark.createDataFrame(jobs, "id int, q string, arrival double, finish double")
    got = sorted(((r.id, r.q, r.jobs_ahead) for r in queueing.jobs_ahead(rows, ["q"], "arrival", "finish", ["arrival", "id"]).collect()), key=str)
    assert [(i, q) for i, q, _ in got] == [(1, "a"), (2, "a"), (2, "a"), (3, None), (4, None), (5, "a")]
    n = {(i, q): [x for a, b, x in got if (a, b) == (i, q)] for i, q, _ in got}
    assert n[1, "a"] == [0] and sorted(n[2, "a"]) == [1, 2] and n[3, None] == [0] and n[4, None] == [1] and n[5, "a"] == [2]


def test_skip_reasons_are_sorted(spark):
    pages = spark.createDataFrame([(1, 1, "skipped", "z"), (1, 2, "skipped", "a"), (1, 3, "skipped", "z"), (1, 4, "skipped", None), (1, 5, "ocr", "b"), (2, 1, "ocr", None)], "doc int, number int, method string, reason string")
    assert {r.doc: (r.skipped_pages, r.skip_reasons) for r in d.skip_reasons(pages, "doc").collect()} == {1: (4, ["a", "z"]), 2: (0, [])}


def test_python_workers_get_rows_by_bytes(spark):
    name, text = "spark.sql.execution.arrow.maxBytesPerBatch", F.col("text")
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    makers = [lambda: folds.segments_column(text, 9), lambda: folds.collapse_column(text), lambda: folds.sections_column(text), lambda: variants.metrics(text, text), lambda: clients.called(docs, "doc_id", "text", len, "int"), lambda: summaries.summarized(docs, summaries.Extractive(), 9, 9)]
    for make in makers:
        spark.conf.set(name, "64m")
        make()
        assert spark.conf.get(name) == str(storage.BYTES_PER_BATCH)


def test_lines_are_compared_where_they_are_asked_for(spark):
    rows = spark.createDataFrame([("a\nb", "a\nc")], "a string, b string").select(variants.metrics(F.col("a"), F.col("b")).alias("m"))
    planned = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "lines_removed" in planned(rows) and "lines_removed" not in planned(rows.select("m.similarity"))
    assert tuple(rows.first().m) == (3, 0, 0.6667, 1, 1)


def test_the_moody_service_keeps_no_texts():
    moody = live.Moody()
    for i in range(100):
        clients.tried(moody, "x" * i, (0.0, 0.0))
    assert not moody.waiting


def test_skipped_pages_without_a_reason(spark, tmp_path):
    spark.createDataFrame([(1, 8), (2, 2), (2, 5), (2, 8)], "conv_id long, turn long").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(map(tuple, control.skip_reasons(spark, str(tmp_path)).collect())) == [(1, 1, ""), (2, 3, "OCR page cap; OCR timed out after 120s")]


def test_documents_of_blank_pages(spark):
    pages = spark.createDataFrame([(1, 1, " \n"), (1, 2, None), (2, 2, "b"), (2, 1, "a"), (2, 3, " ")], "doc int, number int, text string")
    assert {r.doc: r.text for r in d.assembled(pages, "doc").collect()} == {1: "", 2: "a\n\nb"}


def test_running_headers_at_all_line_ends(spark):
    gone = one(spark, lines.without_running_headers, "Head er\x0cone\x0cHead er\r\ntwo Head er\n", "a\r\nb\r\n", "Same\nx\nSame\nx\ny\n", "Tops\nTops\nTops\n", "ab\nab\nab")
    assert gone == ["one\ntwo", "a\r\nb\r\n", "Same\nx\nSame\nx\ny\n", "", "ab\nab\nab"]


def test_wav_lengths(spark):
    def wav(rate, channels, bits, sound, extra=b""):
        return b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits) + extra + b"data\xff\xff\xff\xff" + b"\0" * sound

    rows = spark.createDataFrame([(1, wav(24_000, 1, 16, 48_000)), (2, wav(8_000, 2, 16, 64_000)), (3, wav(24_000, 1, 16, 48_000, b"\x06\x46\x17\x46\x1f")), (4, b"RIFF"), (5, b"RIFF" + b"\0" * 32 + b"data" + b"\0" * 4 + b"\0" * 24_000)], "i int, b binary")
    assert {r.i: r.s for r in rows.select("i", shelf.wav_seconds(F.col("b")).alias("s")).collect()} == {1: 1.0, 2: 2.0, 3: 1.0, 4: None, 5: 0.5}
