"""Results stated by hand, for rules whose SQL is made from the same patterns, and plain loops for the rest."""

import difflib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from pagemill import engine
from pagemill.functions import folds, rules, rx, variants
from pagemill.functions import text as t
from pagemill.operators import chat, covers, lines, queueing, scans, shelf, summaries
from pagemill.sources import records, web


def one(spark, make, *values):
    return [r.out for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(make(F.col("v")).alias("out")).collect()]


def spoken(text):
    return t.clean_body(lines.prepared(text))


CLEAN = {
    "read [the manual](https://a.b/c) first": "read the manual first",
    "left ![a cat](cat.png) right": "left right",
    "visit https://a.b/c?d=e today": "visit today",
    "a fact [12] and [^3] but [sic] stays": "a fact and but [sic] stays",
    "before\n```python\nx = 1\n```\nafter": "before\n Code example omitted. \nafter",
    "## The Middle Part": "The Middle Part.",
    "## Ends already.": "Ends already.",
    "One.\n\nPhoto: a cat\n\nTwo.": "One.\n\nTwo.",
    "Photography changed " + "x" * 220: "Photography changed " + "x" * 220,
    "- **bold** thing\n- *soft* thing": "bold thing\nsoft thing",
    'odd")<sup>[\\[1\\]](#cite_note-A-1)</sup> is it': 'odd") is it',
    "in 1960.[\\[2\\]](#cite_note-B-2) First": "in 1960. First",
    "Johnson (<https://a.b/Kelly>).": "Johnson ().",
    "claim[a] and[note 3] but [sic] stays": "claim and but [sic] stays",
    "a <em>stressed</em> word": "a stressed word",
    "Body.\n\n## See also\n\n- thing\n\n## References\n\n1. cited": "Body.",
    "Body.\nREFERENCES\n1. cited": "Body.",
    "Head\n\n[edit]\n\n(#citeref-A-0)text": "Headtext",
    "[\n[edit](/w/index)\n]\nrest": "rest",
    "One.\n\n3/54\n\nPage 12 of 54\n\n- 7 -\n\n42\n\nTwo.": "One.\n\nTwo.",
    "Found.\n\nDownloaded from a.org at X\n\nCopyright 2024 Y\n\nDOI: 10.1126/a.b123 goes on": "Found.\n\n goes on",
    "One.\n\nPHOTOGRAPH BY SOMEONE\n\nwho@uni.edu\n\nTwo.": "One.\n\nTwo.",
    "deep under-\nstanding of it": "deep understanding of it",
    "It was(cid:31) seen 1/30/26, 6:57 PM by all.": "It was seen by all.",
    "| a | b |\n| - | - |\nafter": "after",
    "use `code` here": "use code here",
    "***all*** of __it__": "all of it",
    "2 ** 3 stays odd": "2 3 stays odd",
    "> said\n> again": "said\nagain",
    "[left": "left",
    "a\n\n\n\nb  c": "a\n\nb c",
    "e\ufffe\ufffeect": "effect",
    "it\ue000The end": "it The end",
    "plain": "plain",
    "": "",
}


def test_spoken_texts(spark):
    got = dict(zip(CLEAN, one(spark, spoken, *CLEAN), strict=True))
    assert got == CLEAN


def test_every_rule_by_itself(spark):
    """A line or a sign for each rule of the page furniture, gone, and a like one that stays."""
    gone = ["7/9", "Page 3", "page 3 of 8", "- 4 -", "123", "1/2/2024", "Vol. 3 Issue 4 more", "downloaded from x y", "Published by Wiley and so on", "(c) 2020 X", "© 1999", "All rights reserved.", "Reprints and permissions here", "*Corresponding author: x", "a.b@c.de", "PHOTO: me", "A screenshot of it", "Figure 3 shows", "12 COMMENTS", "SUBSCRIBE", "Sign up for our newsletter today"]
    kept = ["7/9 of it", "Pages 3", "1234", "1/2/3", "Vol 3", "we downloaded from x", "Published by us", "c 2020", "all rights reserved to him", "a.b@c.de writes", "photons", "SUBSCRIBE now"]
    assert one(spark, t.hygiene, *gone) == [""] * len(gone)
    assert one(spark, t.hygiene, *kept) == kept


@pytest.mark.parametrize("text", ["```" + "x " * 500_000, "<sup>" + "y" * 1_000_000, "[" * 300_000, "`" * 300_001, "_a " * 200_000, "![" * 3000, "(#" * 3000, "\n" * 2000, "<" * 3000])
def test_long_texts_with_what_never_closes(spark, text):
    """A million signs with an open fence, bracket or mark: done in bounded time and stack."""
    got = one(spark, spoken, text + "\nend")[0]
    assert got.endswith("end")
    assert one(spark, t.lint_counts, text)[0] is not None


def test_gated_rules_are_the_rules(spark):
    """Signs and probes only spare searches: over texts of constructs the result is that of every rule in turn."""
    rng = random.Random(6)
    bits = ["```", "[edit]", "[EDIT](x)", "(#a)", "<sup>", "</sup>", "<b>", "\\[", "\\]", "<https://a.b>", "![", "](", "[1]", "[", "]", "http://q", "|", "\n", "\n\n\n", "# h", "`", "*", "**", "_", "> ", "- ", "3. ", "  ", "\t", "word", "fig. ", "Photo", "ſource", "12", "7/8", "page 4", "@", "a@b.cd", "ISSN 12", "doi:10.1234/x", "x.PNG", "under-\nway", " ", "\x02", "\x01"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(1500)]
    plain = lambda c, some: rx.apply(c, some)
    headed = [(r"^#{1,6}\s+(.*?)[^\S\n]*$", "m", "\x03$1\x04"), (r"[.:]+\x04", "", "\x04"), (r"\x03", "", ""), (r"\x04", "", ".")]
    want = one(spark, lambda c: rx.strip(plain(plain(plain(c, rules.CLEAN_BEFORE_HEADINGS), headed), [rules.INLINE_CODE, rules.EMPHASIS, rules.EMPHASIS, *rules.CLEAN_AFTER_EMPHASIS])), *texts)
    assert one(spark, t.clean_body, *texts) == want
    assert one(spark, t.hygiene, *texts) == one(spark, lambda c: plain(c, [*rules.HYGIENE_LINES, *rules.HYGIENE_INLINE, rules.HYPHEN_BREAK]), *texts)
    counts = one(spark, t.lint_counts, *texts)
    ungated = one(spark, lambda c: F.array(*[F.regexp_count(t.without_author_brackets(c), F.lit(rx.spark_pattern(p, f))) for _, p, f in rules.LINT]), *texts)
    assert [[x.hits for x in r] for r in counts] == [list(r) for r in ungated]


def test_sentences_of_many_kinds(spark):
    rng = random.Random(1)
    bits = ["A. ", "Dr. ", "e.g. ", "et al. ", "1. ", "12. ", "1234. ", "End. ", "Why? ", 'said "so." ', "(See ", "Word ", "é. ", "ÉT. ", "No. ", "U.S. ", " ", "x\n"]
    cases = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 12))) for _ in range(600)] + ["One. Two\x1f. Three Dr. Four", None]
    assert one(spark, t.sentences, *cases[:-1]) == [folds.sentences(c) for c in cases[:-1]]
    assert folds.sentences(None) == [""]


def test_lint_findings(spark):
    long = "A paragraph that is said again, long enough to count as one and not a refrain. " * 3
    docs = spark.createDataFrame([(1, f"fine <i>x</i> here [sic]\n\n{long}\n\n{long.upper()}"), (2, "clean")], "doc_id int, text string")
    got = {(r.doc_id, r.pattern): (r.hits, r.context) for r in lines.findings(docs).collect()}
    assert set(got) == {(1, "html tag"), (1, "repeated paragraph")}
    assert got[1, "html tag"][0] == 2 and got[1, "html tag"][1].startswith("fine <i>x</i> here sic A paragraph") and got[1, "repeated paragraph"] == (1, long[:80].strip())


def test_dry_run_and_script(spark):
    body = "Words that are said in this part of the article, again and again until it is long. " * 12
    text = f"# Top\nlead of it\n## One\n{body}\n## Two: it\n{body}\n## References\n1. x"
    docs = spark.createDataFrame([(1, "link", "A title", "short", "long", text), (2, "link", None, None, "s", "no parts e\ufffeect"), (3, "pdf", "P", "t", "s", None)], "doc_id int, kind string, title string, tldr string, summary string, text string")
    rows = engine.script(docs, 100_000, spark.createDataFrame([("effect",)], "word string")).orderBy("doc_id", "chapter_no").collect()
    got = {(r.doc_id, r.chapter_no): (r.title, r.segment) for r in rows}
    assert {k: v[0] for k, v in got.items()} == {(1, 0): "Summary", (1, 1): "Introduction", (1, 2): "One", (1, 3): "Two: it", (2, 0): "Summary", (2, 1): "Full article", (3, 0): "Summary"}
    assert got[1, 0][1] == "A title.\n\nSummary.\n\nshort\n\nlong" and got[1, 1][1] == rules.LEAD + "\n\nIntroduction.\n\nlead of it" and got[1, 2][1].startswith("One.\n\nWords that") and got[1, 3][1].startswith("Two: it.\n\nWords that")
    assert got[2, 1][1] == rules.LEAD + "\n\nno parts effect" and got[2, 0][1] == "Untitled.\n\nSummary.\n\ns"
    found, clean = engine.dry_run(docs.where("doc_id = 2"))
    assert clean and found.count() == 0


def test_glyphs_over_a_whole_vocabulary(spark):
    words = [f"{a}ff{b}" for a in "abcdefghij" for b in "klmnopqrstu"] + ["offi" + c for c in "abcdefghij" * 3] + ["difficult", "affix"]
    docs = spark.createDataFrame([(i, f"{w} and more") for i, w in enumerate(words)], "doc_id int, text string")
    vocabulary = lines.vocabulary(docs)
    assert vocabulary.count() == len(set(words)) > 110
    holed = spark.createDataFrame([(1, "di\ufffecult a\ufffex o\ufffea \ue000nd"), (2, "no holes"), (3, None)], "doc_id int, text string")
    known = {r.doc_id: set(r.words) for r in lines.known_words(holed, vocabulary).collect()}
    assert known == {1: {"difficult", "affix", "offia"}}
    got = holed.join(lines.known_words(holed, vocabulary), "doc_id", "left").select("doc_id", folds.repair_glyphs_column(F.col("text"), F.col("words")).alias("x")).orderBy("doc_id").collect()
    assert [r.x for r in got] == ["difficult affix offia find", "no holes", None]


def test_repair_against_a_plain_loop():
    rng = random.Random(3)
    known = frozenset({"effect", "find", "difficult", "off", "flow"})
    for _ in range(500):
        s = "".join(rng.choice(["e", "ect", "\ufffe", "\ue000\ue001", " ", "The", "di", "cult", "nd", "1", ".", "o", "low"]) for _ in range(8))
        out, i, whole = [], 0, s
        hole = re.compile(f"[{rules.MISSING_GLYPH}]+")
        while i < len(s):  # holes inside words, by what stands in the text as it came
            m = hole.match(s, i)
            if not m:
                out.append(s[i])
                i += 1
                continue
            a, z = m.span()
            if a and whole[a - 1].islower() and whole[a - 1].isascii() and z < len(s) and "a" <= whole[z] <= "z":
                b, e = a, z
                while b and whole[b - 1].isalpha():
                    b -= 1
                while e < len(whole) and whole[e].isalpha():
                    e += 1
                out.append(next((x for x in rules.LIGATURES if (whole[b:a] + x + whole[z:e]).lower() in known), "ff"))
            else:
                out.append(m[0])
            i = z
        s = "".join(out)
        s = re.sub(f"(?<=[a-z.,;:!?])[{rules.MISSING_GLYPH}]+(?=[A-Z])", " ", s)
        parts = hole.split(s)
        for k in range(1, len(parts)):
            before, after = parts[k - 1], re.match("[^\\W\\d_]*", parts[k])[0]
            start = not re.search("[A-Za-z]$", before) and re.match("[a-z]{2}", parts[k])
            parts[k] = (next((x for x in rules.LIGATURES if (x + after).lower() in known), "fi") if start else "") + parts[k]
        assert folds.repair_glyphs(whole, known) == "".join(parts), repr(whole)


def test_the_model_sees_each_chunk_once(spark, tmp_path):
    class Counting(summaries.Extractive):
        def __init__(self, folder):
            self.folder = folder

        def points(self, chunk, number, of):
            with open(f"{self.folder}/calls", "a") as f:
                f.write(f"{number} {of} {len(chunk)}\n")
            return super().points(chunk, number, of)

    text = "\n\n".join(f"Paragraph {i} begins. It goes on for a while with words. And it ends." for i in range(60))
    got = summaries.summarized(spark.createDataFrame([(1, text), (2, "Short. Text.")], "doc_id int, text string"), Counting(str(tmp_path)), 1000, 400)
    row = {r.doc_id: r for r in got.collect()}
    calls = (tmp_path / "calls").read_text().splitlines()
    first = [c for c in calls if c.split()[1] == str(row[1].sections)]
    assert len(first) == row[1].sections == len(set(first)) or sorted(int(c.split()[0]) for c in first) == list(range(1, row[1].sections + 1))
    assert row[1].sections > 5 and len(calls) < 2 * row[1].sections + 20


# --- queues, chat, covers ------------------------------------------------------------------------


def test_running_totals_over_spans_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(scans, "spanned", lambda rows, by, order: rows.withColumn("_span", F.floor(F.col("at") / 10)))
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", None]), float(rng.randrange(60)), float(rng.randrange(9))) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, q string, at double, v double")
    for total, fold in ((F.sum, lambda a, b: a + b), (F.max, max)):
        for inclusive in (True, False):
            got = {r.id: r.out for r in scans.running(df, ["q"], ["at", "id"], total, F.col("v"), "out", inclusive).collect()}
            last = {}
            for i, q, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
                now = v if q not in last else fold(last[q], v)
                assert got[i] == (now if inclusive else last.get(q))
                last[q] = now


def test_queue_with_jobs_ahead(spark):
    rows = [(i, "q", float(i * 7 % 50), float(i * 13 % 11 + 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, q string, arrival double, service double")
    done = queueing.replayed(df, ["q"], "arrival", "service", ["arrival", "id"])
    got = {r.id: r.jobs_ahead for r in queueing.jobs_ahead(done, ["q"], "arrival", "finish", ["arrival", "id"]).collect()}
    free, ends = 0.0, []
    for i, _, a, s in sorted(rows, key=lambda r: (r[2], r[0])):
        assert got[i] == sum(e > a for e in ends)
        free = max(free, a) + s
        ends.append(free)


def test_settings_of_very_many_keys(spark):
    layers = spark.createDataFrame([("default", None, f"key{i}", "v") for i in range(1500)], "layer string, user string, key string, value string")
    got = queueing.resolved_settings(layers, spark.createDataFrame([("u",), ("v",)], "user string"))
    assert got.count() == 3000


def test_chat(spark):
    event = {"kind": "message", "channel_type": "im", "ts": "1", "text": ""}
    cases = [
        ({"text": "see https://a.b"}, "link", "https://a.b"), ({"text": "cancel", "thread_ts": "0"}, "cancel", None), ({"text": "cancel"}, "quiet", None), ({"text": "help"}, "help", None),
        ({"bot_id": "B", "text": "https://a.b"}, "ignore", None), ({"subtype": "message_changed", "text": "https://a.b"}, "ignore", None), ({"subtype": "file_share", "files": ["x.pdf"], "text": "cancel", "thread_ts": "0"}, "file", "x.pdf"),
        ({"channel_type": "channel", "channel": "C1", "text": "https://a.b"}, "link", "https://a.b"), ({"channel_type": "channel", "channel": "C2", "text": "https://a.b"}, "ignore", None),
        ({"channel_type": "channel", "channel": "C1", "text": "<@B> https://a.b"}, "ignore", None), ({"kind": "app_mention", "channel_type": "channel", "channel": "C2", "text": "<@B> https://a.b"}, "link", "https://a.b"), ({"text": None}, "quiet", None),
    ]
    names = [c.split()[0] for c in chat.EVENT.split(", ")]
    rows = spark.createDataFrame([(i, *[{**event, **e}.get(n) for n in names]) for i, (e, _, _) in enumerate(cases)], "i int, " + chat.EVENT)
    got = chat.actions(rows, chat.drop_channels(F.lit(" C1,, C1 ")), "B").orderBy("i").collect()
    assert [(r.action, r.target) for r in got] == [(a, x) for _, a, x in cases] and got[1].thread == "0" and got[0].thread == "1"


def test_commands(spark):
    rows = spark.createDataFrame([(1, "u", "voice", "af_sky", "x"), (2, "u", "voice", "sky", "x"), (3, "u", "tts", "", "true"), (4, "u", "tts", "default", "false"), (5, "u", "format", "Md default", "pdf"), (6, "u", "cover", "vanished", "off"), (7, None, "cover", "auto", "off"), (8, "u", "tts", "maybe", "true")], "ts int, user string, command string, text string, current string")
    got = {r.ts: r for r in chat.commands(rows, F.array(F.lit("af_sky"), F.lit("bf_sky"))).collect()}
    assert [(got[i].user, got[i].key, got[i].value) for i in range(1, 9)] == [("u", "tts_voice", "af_sky"), ("u", "tts_voice", None), ("u", "tts_enabled", "false"), (None, "tts_enabled", "true"), (None, "note_format", "md"), ("u", "cover_style", None), (None, "cover_style", "auto"), ("u", "tts_enabled", None)]
    assert "af_sky, bf_sky" in got[2].reply


def test_hand_off_freezes_settings(spark):
    jobs = spark.createDataFrame([("j1", "u", 5), ("j2", "u", 15), ("j3", "v", 5)], "job string, user string, handed int")
    settings = spark.createDataFrame([("u", "tts_voice", "a", 1), ("u", "tts_voice", "b", 10), ("u", "tts_voice", "c", 15), ("u", "note_format", "md", 1), ("v", "tts_voice", "z", 9)], "user string, key string, value string, since int")
    got = {r.job: r.overrides for r in queueing.handed_off(jobs, settings).collect()}
    assert got == {"j1": {"tts_voice": "a"}, "j2": {"tts_voice": "c"}, "j3": {}}


def test_covers(spark):
    rows = spark.createDataFrame([("auto", "k", '{"scene": " A hill ", "style": "Poster"}'), ("auto", "k", None), ("auto", "k", "not json"), ("random", "k", '{"scene": "x"}'), ("gone", "k", None), ("off", "k", None), (None, "k", None)], "choice string, key string, answer string")
    got = covers.planned(rows).collect()
    assert [(r.style, r.scene) for r in got[:3]] == [("poster", "A hill"), ("flat", ""), ("flat", "")] and got[3].style in rules.COVER_STYLES and [r.style for r in got[4:]] == ["flat", "off", "off"]
    assert one(spark, lambda c: covers.prompt(F.lit(""), c, F.lit("flat")), "A title.", "")[0] == "A title, " + rules.COVER_STYLES["flat"]


def test_shelf_and_records(spark, tmp_path):
    wanted = spark.createDataFrame([(1, "l", "c"), (2, "l", "c"), (3, "l", "d")], "item int, library string, name string")
    have = spark.createDataFrame([("l", "c", 1), ("l", "c", 1), ("l", "c", 9)], "library string, name string, item int")
    assert {(r["item"], r.action) for r in shelf.collection_actions(wanted, have).collect()} == {(1, "none"), (2, "add"), (3, "create")}
    patch = spark.range(1).select(shelf.metadata_patch(F.lit(""), F.lit(""), F.lit(""), F.array().cast("array<string>"), clear_series=True).alias("p")).first().p
    assert json.loads(patch) == {"series": []}
    assert one(spark, records.item_detail, '{"media": {"chapters": [{"title": "x"}, {}]}}', "{")[0].chapters == ["x", ""]
    jobs = spark.createDataFrame([("1", "c", "t", "x", "l", 0), ("2", "c", "t", "x", "l", 1)], "id string, channel string, thread_ts string, target string, source_label string, attempts int")
    assert {tuple(r) for r in records.write_jobs(jobs, f"file://{tmp_path}/spool").collect()} == {("1.json", "created"), ("2.json", "created")}
    assert sorted(r.id for r in records.jobs(spark, f"{tmp_path}/spool").collect()) == ["1", "2"] and not [f for f in (tmp_path / "spool").iterdir() if f.name.startswith(".run")]
    one_job = jobs.where("id = 1")
    assert [[r.outcome for r in records.completed(one_job, f"file://{tmp_path}/spool").orderBy("file").collect()] for _ in range(2)] == [["removed", "gone"], ["gone", "gone"]]
    assert [r.id for r in records.jobs(spark, f"{tmp_path}/spool").collect()] == ["2"]


def test_variants():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc \n") for _ in range(rng.randrange(30))) for _ in range(2))
        assert variants.similarity(a, b) == pytest.approx(difflib.SequenceMatcher(None, a, b, autojunk=False).quick_ratio())
        removed, added = variants.line_changes(a, b)
        diff = [d for d in difflib.unified_diff(a.splitlines(), b.splitlines(), lineterm="", n=0) if not d.startswith(("---", "+++", "@@"))]
        assert (removed, added) == (sum(d[0] == "-" for d in diff), sum(d[0] == "+" for d in diff))
    text = "one thing\n\nthe other thing\n\nlast of all"
    assert variants.matched_window(text, "the other thinh", 20) == "the other thing\n\nlast of all" and variants.matched_window("", "x", 5) == ""
    for _ in range(100):
        paragraphs = ["".join(rng.choice("abcd ") for _ in range(12)) + "x" for _ in range(6)]
        anchor = "".join(rng.choice("abcd ") for _ in range(12))
        best = max(range(6), key=lambda i: difflib.SequenceMatcher(None, anchor[:80], paragraphs[i][:80]).ratio())
        assert variants.matched_window("\n\n".join(paragraphs), anchor, 1) == paragraphs[best]


def test_web_tables_and_asides():
    html = "<body><div class='Site-Menu'><p>menu</p></div><main><h1>T</h1><table><tr><th>a</th><th>b|c</th></tr><tr><td>1 <b>2</b></td><td><a href='http://x.y'>l</a></td></tr></table><div id='promo'><div><p>buy</div><br></div><p>end</p><p role='navigation'>no</p></main><p>outside</p></body>"
    assert web.article(html) == "# T\n\n| a | b\\|c |\n| --- | --- |\n| 1 2 | [l](http://x.y) |\n\nend"
    assert web.article("<p>only</p>") == "only" and web.article(None) == ""


def test_segments_in_sql(spark):
    folds.register(spark)
    spark.createDataFrame([(1, "aa\n\nbb\n\ncc"), (2, None)], "id int, text string").createOrReplaceTempView("some_docs")
    got = spark.sql("SELECT id, number, segment FROM some_docs, LATERAL segments(text, 8)").collect()
    assert {(r.id, r.number, r.segment) for r in got} == {(1, 0, "aa\n\nbb"), (1, 1, "cc")}
