"""Golden cases of the text operators, native and folded, and the laws they keep."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import folds
from pagemill.functions import text as t
from pagemill.operators import lines, scripts


def one(spark, make, *values):
    """The column that `make` gives for each value."""
    rows = [r.out for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(make(F.col("v")).alias("out")).collect()]
    return rows if len(values) > 1 else rows[0]


def test_clean_body(spark):
    got = one(spark, t.clean_body, "# Big *Title*:\n\nSee [the page](http://x.y/z) now [1].", "***all*** and **bold _both_**", "a [sic] b [left over", "```\nx\n```\nafter", "<b>kept</b><sup>9</sup> tail", "| a | b |\ntext", "> quote\n- item\n3. third", "  \n ")
    assert got == ["Big Title.\n\nSee the page now .", "all and bold both", "a [sic] b left over", "Code example omitted. \nafter", "kept tail", "text", "quote\nitem\nthird", ""]


def test_hygiene_and_end_matter(spark):
    text = "Title\n\n3/54\nPage 2 of 9\nbody hyphen-\nated\n© 2020 Someone\nISSN 1234-567X end (cid:7)"
    got = one(spark, t.hygiene, text)
    assert "3/54" not in got and "Page 2" not in got and "hyphenated" in got and "2020" not in got and "ISSN" not in got and "cid" not in got
    assert one(spark, t.cut_end_matter, "a\n## References\nb", "references inside a line stay\nx") == ["a\n", "references inside a line stay\nx"]


def test_running_headers(spark):
    text = "Head\na\nHead\nb\n Head \nabc\nabc\nabc\nx\nx\nx"
    assert one(spark, lines.without_running_headers, text) == "a\nb\nabc\nabc\nabc\nx\nx\nx"
    assert one(spark, lines.without_running_headers, "same line\nsame line\nsame line") == ""


def test_lint(spark):
    docs = spark.createDataFrame([(1, "plain [sic] text"), (2, "<i>x</i> [left http://a \\[ ```")], "doc_id int, text string")
    got = {(r.doc_id, r.pattern): r.hits for r in lines.lint(docs).collect()}
    assert all(got[1, p] == 0 for p in ("html tag", "bracket residue", "url"))
    assert got[2, "html tag"] == 2 and got[2, "url"] == 1 and got[2, "code fence"] == 1 and got[2, "bracket residue"] == 2


def test_titles(spark):
    assert one(spark, t.is_junk_title, "03-dynprog", "Microsoft Word - final", "A real title", "Dune", "x", "notes.pdf", "12 34 56", None) == [True, True, False, False, True, True, True, True]
    rows = spark.createDataFrame([("scan_01", "Model title", "file-9"), ("", "", "file-9"), ("Own title", "Other", "s")], "a string, b string, c string")
    assert [r.o for r in rows.select(t.title_ladder(F.col("a"), F.col("b"), F.col("c")).alias("o")).collect()] == ["Model title", "file-9", "Own title"]
    assert one(spark, t.slug, 'a/b: "c" ', "...", "x" * 100) == ["ab c", "Untitled note", "x" * 80]
    assert one(spark, lambda c: t.cover_title(c, True), "Lighthouse - The Site", "Part 1 - Origins of a long story", "a_b") == ["Lighthouse", "Part 1 - Origins of a long story", "a b"]


def test_notes(spark):
    assert one(spark, t.demote_headings, "# a\n### b\n###### c", "### kept", "none") == ["### a\n##### b\n###### c", "### kept", "none"]
    assert one(spark, t.callout, "a\n\nb") == "> [!note]- Full extracted text\n> a\n>\n> b"
    assert one(spark, t.portable_markdown, "---\nx: 1\n---\n# T\n> [!note]- Lead \n> body\n> [!tip]") == "# T\n> **Lead**\n>\n> body\n>"


def test_headings_native_and_folded_agree(spark):
    cases = ["3.2 Decidability", "Chapter 4 The End", "IV. Results", "Introduction", "ALL CAPS WORDS", "ALTR U", "a sentence here", "Ends with stop.", "0 if j > n", "The The The The", "Word*", "Averyveryverylongword Here", "Sets and Maps", "Sets And Maps", "", "ab", "x" * 81, "Été Des Mots", "12"]
    assert one(spark, t.looks_like_heading, *cases) == [folds.is_heading(c) for c in cases]
    assert folds.is_heading("3.2 Decidability") and folds.is_heading("Sets And Maps") and not folds.is_heading("Sets and Maps")


def test_sentences_native_and_folded_agree(spark):
    cases = ['See Fig. 3 for more. Then "go." Next', "A. Smith came. He left.", "1. First item. Second", "No end", "e.g. This and etc. That! Really? Yes"]
    assert one(spark, t.sentences, *cases) == [folds.sentences(c) for c in cases]
    assert folds.sentences("See Fig. 3 for more. Then go.") == ["See Fig. 3 for more.", "Then go."]


def test_segments_and_chunks():
    assert folds.segments("aa\n\nbb\n\ncc", 8) == ["aa\n\nbb", "cc"]
    assert folds.segments("One here. Two there. Three.", 12) == ["One here.", "Two there.", "Three."]
    assert folds.segments("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    assert folds.chunks("# A\naa\n# B\nbb\n# C\ncc", 15) == ["# A\naa\n\n# B\nbb", "# C\ncc"]
    assert folds.chunks("short", 10) == ["short"] and folds.chunks("y" * 25, 10) == ["y" * 10, "y" * 10, "y" * 5]
    assert folds.paragraph_chunks("aaaa\n\nb\n\ncccc", 8) == ["aaaa", "b", "cccc"] or folds.paragraph_chunks("aaaa\n\nb\n\ncccc", 8) == ["aaaa\n\nb", "cccc"]
    assert folds.cut_at_paragraph("aaaa\n\nbbbb", 7) == "aaaa" and folds.cut_at_paragraph("abcdefghij", 4) == "abcd"


def test_reflow_and_glyphs():
    wide = "w" * 50
    text = f"The first line is long enough to be body {wide} and goes on\nto here.\nIntroduction\nNew text that is also quite long for this page {wide} hy-\nphen end.\nF1\nF2 x\nF3\n"
    assert folds.reflow(text).split("\n\n")[1] == "Introduction" and "hyphen end." in folds.reflow(text) and "F2" not in folds.reflow(text)
    assert folds.repair_glyphs("e￾ect di￾cult ￾nd it￾The 5￾", frozenset({"effect", "difficult", "find"})) == "effect difficult find it The 5"


def test_collapse_repetition():
    page = "\n".join(f"line number {i} with some words of its own" for i in range(8))
    assert folds.collapse_repetition(page + "\nheader\n" + page) == (page, True)
    assert folds.collapse_repetition(page) == (page, False)


def test_sections():
    body = "b" * 20
    assert folds.sections(f"# T\nlead\n## One\n{body}\n## Two\n{body}") == [("Introduction", "lead"), ("One", body), ("Two", body)]
    assert folds.sections("## only\ntext") == [] and folds.sections("plain text") == []
    assert folds.sections("1 First Part\ntext ends.\n2 Second Part\nmore") == [("1 First Part", "text ends."), ("2 Second Part", "more")]
    long = "x" * 800
    assert folds.consolidated([("A", long), ("B", "short"), ("C", long)]) == [("A", f"{long}\n\nB.\n\nshort"), ("C", long)]
    assert len(folds.consolidated([(str(i), long) for i in range(30)])) == 20


def test_chapter_title(spark):
    got = one(spark, scripts.chapter_title, "**Bold** heading.", "word " * 20)
    assert got[0] == "Bold heading" and got[1].endswith("...") and len(got[1]) <= 63


def test_chapter_label_keeps_what_isnt_of_a_text_layer(spark):
    assert one(spark, scripts.chapter_label, "**Mail a.b@c.example.com** now.", "***") == ["Mail a.b@c.example.com now", "***"]
    assert one(spark, scripts.chapter_title, "Matr ¯ avr ¯ .tta") == "Matravrtta"


def test_small_columns(spark):
    assert one(spark, t.first_url, "see <https://a.b/c|x> y", "http://q.r> z", "none", None) == ["https://a.b/c", "http://q.r", None, None]
    assert one(spark, t.is_cancel, "<@U1> Cancel!", "please cancel it", None) == [True, False, False]
    assert one(spark, t.normalize_latex, r"$\frac{1}{2}$ and $x$") == "1/2 and x"
    assert one(spark, t.voice_group, "af_bella", "bm_x", "odd") == ["American English, female", "British English, male", "other"]
    assert one(spark, t.clean_scene, "a plaque reading 'Library', a woman reading a book , holding signs") == "a plaque, a woman reading a book"


TEXT = st.text(alphabet="ab A.\n[]*#1￾!", max_size=300)


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(TEXT, st.integers(5, 60))
def test_laws(text, most):
    assert all(0 < len(s) <= most for s in folds.segments(text, most))
    chunks = folds.chunks(text, most)
    assert all(len(c) <= most for c in chunks)
    assert "".join("".join(chunks).split()) == "".join(text.split())
    assert len(folds.collapse_repetition(text)[0]) <= len(text)
    folds.reflow(text), folds.sections(text), folds.repair_glyphs(text, frozenset())


@pytest.mark.parametrize("text", ["", None, " ", "\n\n"])
def test_nothing_crashes_on_nothing(text):
    assert folds.segments(text, 10) == [] and folds.sections(text) == [] and folds.reflow(text) == ""
