"""Calls outside, and what the engine makes of pages and of runs that are repeated."""

import pytest
from pyspark.sql import functions as F

from pagemill import engine
from pagemill.functions import text as t
from pagemill.operators import clients, summaries


def test_waits_between_tries():
    def service(answers):
        def call(_):
            a = answers.pop(0)
            if isinstance(a, Exception):
                raise a
            return a

        return call

    def run(*answers):
        waited = []
        result, tries, _, failure, detail = clients.tried(service(list(answers)), "x", (10.0, 60.0), waited.append)
        return result, tries, failure, detail, waited

    no = clients.Unreachable("no")
    assert run("ok") == ("ok", 1, None, None, [])
    assert run(no, "ok") == ("ok", 2, None, None, [10.0])
    assert run(no, no, no) == (None, 3, "unreachable", "no", [10.0, 60.0])
    assert run(no, clients.Rejected("y" * 500)) == (None, 2, "rejected", "y" * 200, [10.0])
    assert run(clients.TimedOut("late")) == (None, 1, "timed out", "late", [])
    with pytest.raises(KeyError):  # a fault of our own isn't an outcome
        run(KeyError("bug"))


def test_pages_are_read(spark):
    def reader(image):
        say = bytes(image).decode()
        if say == "gone":
            raise clients.Unreachable("down")
        if say == "slow":
            raise clients.TimedOut("slow")
        if say == "bad":
            raise clients.Rejected("400: odd")
        return say.upper(), say != "loop"

    rows = spark.createDataFrame([(i, s.encode()) for i, s in enumerate(["text", "gone", "slow", "bad", "loop"])], "page int, image binary")
    got = {r.page: (r.text, r.method, r.reason, r.outage) for r in clients.read_pages(rows, "page", reader, 120, 500, (0.0,)).collect()}
    assert got == {0: ("TEXT", "ocr", None, False), 1: (None, None, None, True), 2: ("", "skipped", "OCR timed out after 120s", False), 3: ("", "skipped", "OCR refused: 400: odd", False), 4: ("", "skipped", "OCR runaway, cut at 500 tokens", False)}


def test_notes_tell_how_their_pages_came_about(spark):
    docs = spark.createDataFrame([(1, "/x/scan.pdf", "pdf", None, "A first sentence. More of it."), (2, "http://u", "link", None, "Other.")], "doc_id long, source string, kind string, title string, text string")
    pages = spark.createDataFrame([(1, 1, "ocr", 2.0, None), (1, 2, "text-layer", 0.0, None), (1, 3, "skipped", 0.0, "OCR page cap")], "doc_id long, number int, method string, seconds double, reason string")
    got = {r.doc_id: r.markdown for r in engine.notes(docs, "2024-05-06", pages=pages).collect()}
    assert "Pages: 3 · Extraction: ocr+text-layer" in got[1] and "OCR: 1 page(s), 2s" in got[1] and "**1 page(s) SKIPPED (OCR page cap)**" in got[1]
    assert "Pages: 1 · Extraction: web" in got[2] and "SKIPPED" not in got[2]
    plain = {r.doc_id: r.markdown for r in engine.notes(docs, "2024-05-06").collect()}
    assert "Pages: 1 · Extraction: text-layer" in plain[1]


def test_titles_fall_back(spark):
    rows = spark.createDataFrame([("m", "o", "s"), (" ", "o", "s"), (None, "", " s ")], "a string, b string, c string")
    assert [r.t for r in rows.select(summaries.titled(F.col("a"), F.col("b"), F.col("c")).alias("t")).collect()] == ["m", "o", "s"]


def test_excerpts_are_made_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"First part {i}.\n\n" + "word " * 40) for i in range(4)], "doc_id long, text string")
    path = f"file://{tmp_path}/e"
    assert {r.outcome for r in engine.excerpts(docs.where("doc_id < 2"), path, 20).collect()} == {"created"}
    (tmp_path / "e" / "0.txt").write_text("edited")
    assert {r.name: r.outcome for r in engine.excerpts(docs, path, 20).collect()} == {"0.txt": "kept", "1.txt": "kept", "2.txt": "created", "3.txt": "created"}
    assert (tmp_path / "e" / "0.txt").read_text() == "edited" and (tmp_path / "e" / "3.txt").read_text() == "First part 3."


def test_excerpts_list_no_folder_and_join_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(i // 2, f"Part {i // 2}.") for i in range(40)], "doc_id long, text string")
    first = engine.excerpts(docs.where("doc_id < 10"), f"file://{tmp_path}/e", 20)
    assert {(r.name, r.outcome) for r in first.collect()} == {(f"{i}.txt", "created") for i in range(10)} and first.count() == 20
    got = engine.excerpts(docs, f"file://{tmp_path}/e", 20)
    assert sorted((r.name, r.outcome) for r in got.collect()) == sorted((f"{i}.txt", "kept" if i < 10 else "created") for i in range(20) for _ in range(2))
    plan = got._jdf.queryExecution().toString()
    assert "Join" not in plan and "binaryFile" not in plan and len(list((tmp_path / "e").iterdir())) == 20


def test_a_head_is_prepared_once(spark):
    plan = spark.range(1).select(t.cut_at_paragraph(F.upper(F.lower(F.col("id").cast("string"))), 20).alias("head"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("upper(") == 1


def test_scripts_take_words_from_the_documents(spark):
    docs = spark.createDataFrame([(1, "link", "t", "", "", "The de￾ne and the o￾ce."), (2, "link", "t", "", "", "They define an office.")], "doc_id long, kind string, title string, tldr string, summary string, text string")
    spoken = " ".join(r.segment for r in engine.script(docs).where("doc_id = 1 AND chapter_no = 1").collect())
    assert "define" in spoken and "office" in spoken
