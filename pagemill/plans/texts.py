"""Queries of the text operators.

The corpus has no blank lines, links or headings, so several queries put such constructs in, by the same rule on both
sides: every fifth line becomes a heading, and so on. In these queries a paragraph is a line where it says so.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill import engine
from pagemill.functions import folds, rules, text as t
from pagemill.functions.rx import literal, quoted, sql_apply, sql_pattern, sql_strip, strip
from pagemill.operators import lines
from pagemill.plans.registry import query, table

# --- SQL forms -----------------------------------------------------------------------------------
_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents"


def _emphasis(x: str) -> str:
    marks = "|".join("".join("\\" + c if c == "*" else c for c in m) + r"(\S(?:.*?\S)?)" + "".join("\\" + c if c == "*" else c for c in m) for m in rules.EMPHASIS_MARKS)
    return f"regexp_replace({x}, {quoted(marks)}, '\\1\\2\\3\\4\\5\\6', 'g')"


def _clean_sql(x: str) -> str:
    x = sql_apply(x, rules.CLEAN_BEFORE_HEADINGS)
    x = sql_apply(x, [(r"^#{1,6}\s+(.*?)[^\S\n]*$", "m", "\x03$1\x04"), (r"[.:]+\x04", "", "\x04"), (r"\x03", "", ""), (r"\x04", "", ".")])
    x = _emphasis(_emphasis(sql_apply(x, [rules.INLINE_CODE])))
    return sql_strip(sql_apply(x, rules.CLEAN_AFTER_EMPHASIS))


def _hygiene_sql(x: str) -> str:
    return sql_apply(x, [*rules.HYGIENE_LINES, *rules.HYGIENE_INLINE, rules.HYPHEN_BREAK])


_END = sql_pattern(*rules.END_MATTER)


def _cut_sql(x: str) -> str:
    return f"string_split_regex({x}, {quoted(_END)})[1]"


_DROPPED = f"""
  SELECT doc_id, CASE WHEN bool_or(often) THEN coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT often), '') ELSE max(whole) END AS text FROM (
    SELECT *, count(*) OVER (PARTITION BY doc_id, {sql_strip('line')}) >= {rules.REPEATED_LINE_TIMES} AND length({sql_strip('line')}) > {rules.REPEATED_LINE_LONGER} AS often FROM ({{lines}}) WHERE NOT (line_no = n AND line = '')
  ) GROUP BY doc_id"""


def _without_headers_sql(source: str) -> str:
    """doc_id and text less running headers; documents that lose every line get an empty text."""
    parts = f"SELECT doc_id, text AS whole, string_split(regexp_replace(text, '{rules.LINE_ENDS}', chr(10), 'g'), chr(10)) AS parts FROM ({source})"
    split = f"SELECT doc_id, whole, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no, len(parts) AS n FROM ({parts})"
    return f"SELECT doc_id, coalesce(k.text, '') AS text FROM ({source}) s LEFT JOIN ({_DROPPED.format(lines=split)}) k USING (doc_id)"


#: Furniture put around each document, by both sides.
_AROUND = [("Running header\x0c", "\nRunning header\n3/54\nPage 4 of 9\n- 12 -\n"), ("", "\n12/05/2021\nVOL. 3 ISSUE 4 spring\nDownloaded from http://x.y by z\nRunning header\nISSN 1234-5678 and fig.png stay (cid:12)\nAll rights reserved.\nhyphen-\nated words")]
_BEFORE, _AFTER = _AROUND[0][0], _AROUND[0][1] + _AROUND[1][1]
_FURNISHED_SQL = f"SELECT doc_id, {literal(_BEFORE)} || text || {literal(_AFTER)} AS text FROM documents"
#: Markup put around each document, by both sides.
_MARKUP_A = "# A *Title*:\n\n> quoted [link](https://a.b/c) and [1] ![img](x.png) `code` **bold** [sic] [note 4]\n\n- item\n| a | b |\nFigure 3 shows\n"
_MARKUP_B = "\n```\ncode\n```\nsee https://x.y/z <b>tag</b> <sup>2</sup> \\[x\\] (#anchor) [edit](/w) __it__ tail  end"
_MARKED_SQL = f"SELECT doc_id, {literal(_MARKUP_A)} || text || {literal(_MARKUP_B)} AS text FROM documents"


def _furnished(docs):
    return docs.select("doc_id", F.concat(F.lit(_BEFORE), "text", F.lit(_AFTER)).alias("text"))


def _marked(docs):
    return docs.select("doc_id", F.concat(F.lit(_MARKUP_A), "text", F.lit(_MARKUP_B)).alias("text"))


# --- Queries -------------------------------------------------------------------------------------


@query(_without_headers_sql(_FURNISHED_SQL))
def repeated_header_removal(spark, sf_dir):
    docs = _furnished(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", lines.without_running_headers(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {_hygiene_sql('text')} AS text FROM ({_FURNISHED_SQL})")
def hygiene(spark, sf_dir):
    return _furnished(table(spark, sf_dir, "documents")).select("doc_id", t.hygiene(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {_cut_sql('text')} AS text FROM (SELECT doc_id, text || chr(10) || '## References' || chr(10) || text AS text FROM documents)")
def end_matter_cut(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\n## References\n"), "text").alias("text"))
    return docs.select("doc_id", t.cut_end_matter(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {_clean_sql('text')} AS text FROM ({_MARKED_SQL})")
def clean_body(spark, sf_dir):
    return _marked(table(spark, sf_dir, "documents")).select("doc_id", t.clean_body(F.col("text")).alias("text"))


_LINT_ROWS = " UNION ALL ".join(f"SELECT doc_id, {quoted(name)} AS pattern, length(regexp_extract_all(bare, {quoted(sql_pattern(p, f))}))::BIGINT AS hits FROM x" for name, p, f in rules.LINT)
_PREPARED_SQL = f"SELECT doc_id, {_cut_sql(_hygiene_sql('text'))} AS text FROM ({_without_headers_sql('SELECT doc_id, text FROM documents')})"


@query(f"WITH x AS (SELECT doc_id, {sql_apply(_clean_sql('text'), [rules.AUTHOR_BRACKET])} AS bare FROM ({_PREPARED_SQL})) SELECT pattern, sum(hits)::BIGINT AS hits, count(*) FILTER (hits > 0) AS documents FROM ({_LINT_ROWS}) GROUP BY pattern")
def lint_counts(spark, sf_dir):
    """The flagship: whole documents prepared, cleaned and linted; one row a pattern, zero hits included."""
    docs = table(spark, sf_dir, "documents").select("doc_id", t.clean_body(lines.prepared(F.col("text"))).alias("text"))
    return lines.lint(docs).groupBy("pattern").agg(F.sum("hits").alias("hits"), F.count_if(F.col("hits") > 0).alias("documents"))


@query(" UNION ALL ".join(f"SELECT page_id, {quoted(name)} AS pattern, length(regexp_extract_all(html, {quoted(sql_pattern(p, f))}))::BIGINT AS hits FROM (SELECT page_id, {sql_apply('html', [rules.AUTHOR_BRACKET])} AS html FROM pages)" for name, p, f in rules.LINT))
def lint_pages(spark, sf_dir):
    return lines.lint(table(spark, sf_dir, "pages"), "page_id", "html")


_KEY_SQL = "regexp_replace(trim(regexp_replace(lower(paragraph), '\\s+', ' ', 'g')), '[^a-z0-9 ]+', '', 'g')"


@query(f"""
WITH p AS (SELECT doc_id, line_no AS place, line AS paragraph, {_KEY_SQL.replace('paragraph', 'line')} AS k FROM ({_LINES}) WHERE length(line) >= {rules.REPEATED_PARAGRAPH_CHARS}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY place) AS nth, count(*) OVER (PARTITION BY doc_id, k) AS times FROM p),
f AS (SELECT a.doc_id, a.paragraph, a.times, b.place::INT AS second FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.k = b.k AND a.nth = 1 AND b.nth = 2)
SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY second))::INT AS rank FROM f""")
def repeated_paragraphs(spark, sf_dir):
    """A paragraph is a line here."""
    return lines.repeated_paragraphs(table(spark, sf_dir, "documents"), separator="\n")


@query(f"""
SELECT sha256({_KEY_SQL}) AS digest, count(DISTINCT doc_id) AS documents, min(doc_id) AS first
FROM (SELECT doc_id, line AS paragraph FROM ({_LINES}) WHERE length(line) >= {rules.REPEATED_PARAGRAPH_CHARS}) GROUP BY 1 HAVING count(DISTINCT doc_id) > 1""")
def cross_doc_paragraphs(spark, sf_dir):
    return lines.shared_paragraphs(table(spark, sf_dir, "documents"))


def _heading_sql(x: str) -> str:
    s = "s"
    numbered = quoted(sql_pattern(rules.NUMBERED_HEADING, "i"))
    residue = quoted(r"\s?[¯˙˘´`\^¨˜]\s?")
    letters = lambda c: f"length(regexp_replace({c}, '[^\\p{{L}}]', '', 'g'))"
    return f"""
  WITH a AS (SELECT doc_id, line_no, line, {sql_strip(f"regexp_replace(regexp_replace(line, {residue}, '', 'g'), '[.]([a-z])', chr(92) || '1', 'g')").replace("chr(92) || '1'", "'\\1'")} AS s FROM ({x})),
  b AS (SELECT *, regexp_matches(s, {numbered}) AS numbered, CASE WHEN regexp_matches(s, {numbered}) THEN regexp_extract(s, {numbered}, 1) ELSE s END AS core,
        list_filter(string_split_regex(s, '\\s+'), lambda w: w <> '') AS words FROM a)
  SELECT doc_id, line_no, coalesce(length({s}) BETWEEN 3 AND 80 AND NOT regexp_matches(s, '[.,;:?!]$')
    AND length(regexp_replace(core, '[^\\p{{L}}\\s]', '', 'g')) / length(core) >= 0.75
    AND NOT regexp_matches(s, '[{rules.AFFILIATION_MARKS}{rules.BULLETS}]') AND len(list_filter(words, lambda w: {letters('w')} >= 3)) > 0
    AND NOT (len(words) >= 4 AND len(list_distinct(words)) <= len(words) // 2) AND len(list_filter(words, lambda w: length(w) > 16)) = 0
    AND CASE WHEN numbered THEN regexp_matches(core, '^\\p{{Lu}}')
        ELSE len(words) <= 10 AND CASE WHEN regexp_matches(s, '\\p{{Lu}}') AND NOT regexp_matches(s, '\\p{{Ll}}') THEN len(list_filter(words, lambda w: {letters('w')} >= 3)) >= 2
             ELSE len(list_filter(words, lambda w: NOT regexp_matches(w, '^(?:\\p{{Lu}}|[^\\p{{L}}])'))) = 0 AND len(list_filter(words, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) > 0 END END, false) AS heading
  FROM b"""


_LINE_KINDS = "CASE line_no % 4 WHEN 0 THEN 'Section ' || line_no || ' Of Many Results' WHEN 1 THEN '3.' || line_no || ' ' || line WHEN 2 THEN line ELSE '4.1 Results Of Line' END"


@query(_heading_sql(f"SELECT doc_id, line_no, {_LINE_KINDS} AS line FROM ({_LINES})"))
def pdf_heading_flags(spark, sf_dir):
    """Lines as they are, numbered lines and headings put among them, tested for being headings."""
    rows = lines.lines_of(table(spark, sf_dir, "documents"))
    m, no = F.col("line_no") % 4, F.col("line_no").cast("string")
    line = F.when(m == 0, F.concat(F.lit("Section "), no, F.lit(" Of Many Results"))).when(m == 1, F.concat(F.lit("3."), no, F.lit(" "), "line")).when(m == 2, F.col("line")).otherwise("4.1 Results Of Line")
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), t.looks_like_heading(line).alias("heading"))


_SECTION_LINES = "CASE WHEN doc_id % 2 = 0 THEN CASE line_no % 4 WHEN 3 THEN ' ' WHEN 0 THEN 'Section Of Many Results' WHEN 1 THEN '3.1 ' || line ELSE line END ELSE CASE line_no % 3 WHEN 0 THEN line || '.' WHEN 1 THEN '3.2 Results Of Line' ELSE line END END"


@query(f"""
WITH x AS (SELECT doc_id, line_no, {_SECTION_LINES} AS line FROM ({_LINES})), h AS (SELECT x.*, heading FROM x JOIN ({_heading_sql(f"SELECT doc_id, line_no, {_SECTION_LINES} AS line FROM ({_LINES})")}) USING (doc_id, line_no)),
b AS (SELECT *, coalesce({sql_strip('lag(line) OVER (PARTITION BY doc_id ORDER BY line_no)')}, '') AS before FROM h)
SELECT doc_id, line_no::INT AS line_no, heading AND (before = '' OR regexp_matches(before, '(?:[.!?]|[.]["”])$') AND regexp_matches({sql_strip('line')}, {quoted(sql_pattern(rules.NUMBERED_HEADING, 'i'))})) AS starts FROM b""")
def section_starts(spark, sf_dir):
    """Lines at which a section begins: headings after blank lines, numbered ones after sentences too."""
    even, c = F.col("doc_id") % 2 == 0, F.col
    of_four = F.when(c("line_no") % 4 == 3, " ").when(c("line_no") % 4 == 0, "Section Of Many Results").when(c("line_no") % 4 == 1, F.concat(F.lit("3.1 "), "line")).otherwise(c("line"))
    of_three = F.when(c("line_no") % 3 == 0, F.concat("line", F.lit("."))).when(c("line_no") % 3 == 1, "3.2 Results Of Line").otherwise(c("line"))
    rows = lines.lines_of(table(spark, sf_dir, "documents")).withColumn("line", F.when(even, of_four).otherwise(of_three))
    return lines.section_starts(rows).select("doc_id", "line_no", "starts")


_LABELLED = "text || chr(10) || 'F5' || chr(10) || 'F3 F4' || chr(10) || 'return 0' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE 'x = y' END || chr(10) || 'end' || chr(10) || 'if' || chr(10) || 'It ends.'"


@query(f"""
WITH x AS (SELECT doc_id, unnest(string_split({_LABELLED}, chr(10))) AS line, generate_subscripts(string_split({_LABELLED}, chr(10)), 1) - 1 AS line_no FROM documents),
l AS (SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM (SELECT *, {sql_strip('line')} AS s FROM x) WHERE length(s) BETWEEN 1 AND 32 AND NOT regexp_matches(s, '[.!?\"”’):]$'))
SELECT doc_id, min(line_no)::INT AS first, count(*) AS lines FROM l GROUP BY doc_id, island HAVING count(*) >= 3""")
def label_runs(spark, sf_dir):
    """Runs of three and more short lines that end no sentence, as reflowing drops them."""
    tail = F.concat(F.lit("\nF5\nF3 F4\nreturn 0\n"), F.when(F.col("doc_id") % 3 == 0, " ").otherwise("x = y"), F.lit("\nend\nif\nIt ends."))
    return lines.label_runs(lines.lines_of(table(spark, sf_dir, "documents").withColumn("text", F.concat("text", tail))))


_HEADED_SQL = f"SELECT doc_id, string_agg(CASE WHEN line_no % 4 = 1 THEN '## Part ' || line_no || chr(10) || line ELSE line END, chr(10) ORDER BY line_no) AS text FROM ({_LINES}) GROUP BY doc_id"


def _headed(docs):
    parts = F.transform(F.split("text", "\n"), lambda line, i: F.when(i % 4 == 1, F.concat(F.lit("## Part "), i.cast("string"), F.lit("\n"), line)).otherwise(line))
    return docs.select("doc_id", F.array_join(parts, "\n").alias("text"))


@query(f"""
WITH l AS (SELECT doc_id, line_no, line, (line_no % 4 = 1)::INT AS mark FROM ({_LINES})),
g AS (SELECT *, sum(mark) OVER (PARTITION BY doc_id ORDER BY line_no) AS section, sum(mark) OVER (PARTITION BY doc_id) AS marks FROM l),
s AS (SELECT doc_id, section, min(line_no) AS first, {sql_strip("string_agg(line, chr(10) ORDER BY line_no)")} AS body FROM g WHERE marks >= 2 GROUP BY doc_id, section),
k AS (SELECT * FROM s WHERE section > 0 OR body <> '')
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY section) - 1)::INT AS section_no, CASE WHEN section = 0 THEN 'Introduction' ELSE 'Part ' || first END AS heading, body FROM k""")
def section_split(spark, sf_dir):
    docs = _headed(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.posexplode(folds.sections_column(F.col("text"))).alias("section_no", "s")).select("doc_id", "section_no", "s.heading", "s.body")


def _let_sql(value: str, name: str, use: str) -> str:
    return f"list_transform([{value}], lambda {name}: {use})[1]"


_SECTIONS_SQL = f"""
WITH l AS (SELECT doc_id, line_no, line, (line_no % 4 = 1)::INT AS mark FROM ({_LINES})),
g AS (SELECT *, sum(mark) OVER (PARTITION BY doc_id ORDER BY line_no) AS section, sum(mark) OVER (PARTITION BY doc_id) AS marks FROM l),
s AS (SELECT doc_id, section, min(line_no) AS first, {sql_strip("string_agg(line, chr(10) ORDER BY line_no)")} AS body FROM g WHERE marks >= 2 GROUP BY doc_id, section),
k AS (SELECT doc_id, list({{'heading': CASE WHEN section = 0 THEN 'Introduction' ELSE 'Part ' || first END, 'body': body}} ORDER BY section) AS found FROM s WHERE section > 0 OR body <> '' GROUP BY doc_id)"""
#: What a section adds to the body of the one before it.
_INTO = sql_strip("{a}.body || chr(10) || chr(10) || {b}.heading || '.' || chr(10) || chr(10) || {b}.body")
_MERGED = f"list_reduce(list_transform(found, lambda x: [x]), lambda a, x: CASE WHEN length(x[1].body) < {rules.MIN_CHAPTER_CHARS} THEN list_concat(a[:-2], [{{'heading': a[-1].heading, 'body': {_INTO.format(a='a[-1]', b='x[1]')}}}]) ELSE list_concat(a, x) END)"
_SHORTEST = "list_position(list_transform(a[2:], lambda z: length(z.body)), list_min(list_transform(a[2:], lambda z: length(z.body))))"  # place of the one before it
_FOLDED = f"list_reduce(list_transform(range(0, greatest(1, len(merged))), lambda i: merged[:0]), lambda a, x: CASE WHEN len(a) <= {rules.MAX_CHAPTERS} THEN a ELSE {_let_sql(_SHORTEST, 'p', 'list_concat(a[:p - 1], [{{heading: a[p].heading, body: ' + _INTO.format(a='a[p]', b='a[p + 1]') + '}}], a[p + 2:])').replace('{{', '{').replace('}}', '}')} END, merged)"


@query(f"""{_SECTIONS_SQL}, m AS (SELECT doc_id, {_MERGED} AS merged FROM k), f AS (SELECT doc_id, {_FOLDED} AS chapters FROM m)
SELECT doc_id, (i - 1)::INT AS chapter_no, chapters[i].heading AS heading, chapters[i].body AS body FROM (SELECT *, unnest(range(1, len(chapters) + 1)) AS i FROM f)""")
def chapter_consolidate(spark, sf_dir):
    docs = _headed(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.posexplode(folds.sections_column(F.col("text"), merge=True)).alias("chapter_no", "s")).select("doc_id", "chapter_no", "s.heading", "s.body")


_RAW = "string_split(regexp_replace({x}, '([.!?][\"”’)]?)\\s+([A-Z0-9\"“(])', '\\1' || chr(31) || '\\2', 'g'), chr(31))"


def _sentences_sql(x: str) -> str:
    """Raw sentences folded: one is joined to those before it where they end in an abbreviation or are a number."""
    # the other dialect's \\b knows ASCII words only
    short = rules.ABBREVIATION.replace("\\b", r"(?:^|[^\p{L}\p{N}_])", 1)
    open_end = f"regexp_matches(a[-1], {quoted(sql_pattern(short, 'i'))}) OR regexp_matches({sql_strip('a[-1]')}, '^\\d{{1,3}}\\.$')"
    return f"list_reduce(list_transform({_RAW.format(x=x)}, lambda z: [z]), lambda a, s: CASE WHEN {open_end} THEN list_concat(a[:-2], [a[-1] || ' ' || s[1]]) ELSE list_concat(a, s) END)"


def _hard_sql(x: str, most: int) -> str:
    return f"list_transform(range(0, greatest(1, ceil(length({x}) / {most}.0))::BIGINT), lambda k: substring({x}, k * {most} + 1, {most}))"


def _segments_sql(most: int) -> str:
    """Paragraphs (lines) packed; the sentences of one that is too long packed by themselves, one that is too long cut."""
    grown = f"CASE WHEN c[-1] <> '' AND length(c[-1]) + length(s[1]) + 1 > {most} THEN list_concat(c, s) ELSE list_concat(c[:-2], [{sql_strip('c[-1] || chr(32) || s[1]')}]) END"
    cut = f"list_filter(list_reduce(list_transform({_sentences_sql('p')}, lambda z: [z]), lambda c, s: {_let_sql(grown, 'g', f'list_concat(g[:-2], ' + _hard_sql('g[-1]', most) + ')')}, ['']), lambda z: z <> '')"
    paragraphs = f"list_filter(list_transform(string_split(text, chr(10)), lambda z: {sql_strip('z')}), lambda z: z <> '')"
    parts = f"list_transform({paragraphs}, lambda p: {{'done': CASE WHEN length(p) > {most} THEN {cut} ELSE []::VARCHAR[] END, 'held': CASE WHEN length(p) > {most} THEN '' ELSE p END, 'size': length(p) + 2}})"
    flushed = "list_concat(a.done, CASE WHEN a.held <> '' THEN [a.held] ELSE []::VARCHAR[] END)"
    step = f"""CASE WHEN x.held = '' THEN {{'done': list_concat({flushed}, x.done), 'held': '', 'size': 0::BIGINT}}
      WHEN a.size > 0 AND a.size + x.size > {most} THEN {{'done': {flushed}, 'held': x.held, 'size': x.size}}
      ELSE {{'done': a.done, 'held': CASE WHEN a.held = '' THEN x.held ELSE a.held || chr(10) || chr(10) || x.held END, 'size': a.size + x.size}} END"""
    packed = f"list_reduce({parts}, lambda a, x: {step}, {{'done': []::VARCHAR[], 'held': '', 'size': 0::BIGINT}})"
    return f"""
WITH f AS (SELECT doc_id, {packed} AS a FROM documents), g AS (SELECT doc_id, {flushed} AS out FROM f)
SELECT doc_id, (i - 1)::INT AS segment_no, out[i] AS segment FROM (SELECT *, unnest(range(1, len(out) + 1)) AS i FROM g)"""


def _segmented(spark, sf_dir, most):
    """A paragraph is a line here."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(folds.segments_column(F.replace("text", F.lit("\n"), F.lit("\n\n")), most)).alias("segment_no", "segment"))


@query(_segments_sql(3000))
def segments(spark, sf_dir):
    return _segmented(spark, sf_dir, 3000)


@query(_segments_sql(300))
def sentence_segments(spark, sf_dir):
    return _segmented(spark, sf_dir, 300)


_BLANK_LINED = "regexp_replace(text, chr(10), chr(10) || chr(10), 'g')"
_PIECES = f"list_filter(list_transform(string_split(text, chr(10)), lambda z: {sql_strip('z')}), lambda z: z <> '')"
_CUT_PIECES = f"flatten(list_transform({_PIECES}, lambda p: list_transform({_hard_sql('p', 1000)}, lambda z, i: {{'done': []::VARCHAR[], 'held': z, 'alone': i < ceil(length(p) / 1000.0)}})))"
_CHUNKED = "list_concat(a.done, CASE WHEN a.held <> '' THEN [a.held] ELSE []::VARCHAR[] END)"


@query(f"""
WITH f AS (SELECT doc_id, text, list_reduce({_CUT_PIECES}, lambda a, x: CASE
    WHEN x.alone THEN {{'done': list_concat({_CHUNKED}, [x.held]), 'held': '', 'alone': false}}
    WHEN a.held <> '' AND length(a.held) + 2 + length(x.held) > 1000 THEN {{'done': {_CHUNKED}, 'held': x.held, 'alone': false}}
    ELSE {{'done': a.done, 'held': CASE WHEN a.held = '' THEN x.held ELSE a.held || chr(10) || chr(10) || x.held END, 'alone': false}} END, {{'done': []::VARCHAR[], 'held': '', 'alone': false}}) AS a FROM documents),
g AS (SELECT doc_id, CASE WHEN length({_BLANK_LINED}) <= 1000 THEN [{_BLANK_LINED}] ELSE {_CHUNKED} END AS out FROM f)
SELECT doc_id, (i - 1)::INT AS chunk_no, out[i] AS chunk FROM (SELECT *, unnest(range(1, len(out) + 1)) AS i FROM g)""")
def chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(folds.chunks_column(F.replace("text", F.lit("\n"), F.lit("\n\n")), 1000)).alias("chunk_no", "chunk"))


@query("""
WITH m AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?]["”’)]?)\\s+([A-Z0-9"“(])', '\\1' || chr(31) || '\\2', 'g'), chr(31)) AS parts FROM documents)
SELECT doc_id, (generate_subscripts(parts, 1) - 1)::INT AS n, unnest(parts) AS sentence FROM m""")
def sentence_ends(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(t.raw_sentences(F.col("text"))).alias("n", "sentence"))


@query(f"SELECT doc_id, (generate_subscripts(parts, 1) - 1)::INT AS n, unnest(parts) AS sentence FROM (SELECT doc_id, {_sentences_sql('text')} AS parts FROM documents)")
def sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(t.sentences(F.col("text"))).alias("n", "sentence"))


@query()
def reflow(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    wrapped = F.regexp_replace("text", r"(.{40,60}) ", "$1\n")
    return docs.select("doc_id", folds.reflow_column(wrapped).alias("text"))


@query()
def glyph_repair(spark, sf_dir):
    """Every ff and fi of the corpus becomes a hole; the known words are all its words with a ligature."""
    docs = table(spark, sf_dir, "documents")
    holed = docs.select("doc_id", F.regexp_replace(F.regexp_replace("text", "ff", "\ufffe"), "fi", "\ue000").alias("text"))
    known = lines.known_words(holed, lines.vocabulary(docs))
    return holed.join(known, "doc_id", "left").select("doc_id", folds.repair_glyphs_column(F.col("text"), F.col("words")).alias("text"))


_WINDOW = rules.REPEAT_WINDOW


@query(f"""
WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM (SELECT doc_id, text || chr(10) || text AS text FROM documents)),
l AS (SELECT doc_id, i, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS flat FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM s)),
f AS (SELECT *, coalesce(sum(length(flat) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins FROM l WHERE flat <> ''),
j AS (SELECT doc_id, string_agg(flat, ' ' ORDER BY i) AS joined FROM f GROUP BY doc_id),
h AS (SELECT doc_id, i, begins, begins + instr(substring(joined, begins + 2), substring(joined, begins + 1, {_WINDOW})) AS again FROM f JOIN j USING (doc_id) WHERE length(joined) >= 2 * {_WINDOW} AND begins + {_WINDOW} <= length(joined)),
p AS (SELECT h.doc_id, h.i, max(k.i) AS place FROM h JOIN f AS k ON k.doc_id = h.doc_id AND k.begins <= h.again AND k.i > h.i WHERE h.again > h.begins GROUP BY h.doc_id, h.i),
c AS (SELECT doc_id, arg_min(place, i) AS place FROM p GROUP BY doc_id),
b AS (SELECT c.doc_id, place, CASE WHEN length(flat) BETWEEN 1 AND {rules.HEADER_CHARS} THEN 1 ELSE 0 END AS header FROM c LEFT JOIN l ON l.doc_id = c.doc_id AND l.i = c.place - 1)
SELECT doc_id, CASE WHEN place IS NULL THEN text ELSE regexp_replace(array_to_string(parts[1:place - 1 - header], chr(10)), '\\s+$', '') END AS text, place IS NOT NULL AS cut FROM s LEFT JOIN b USING (doc_id)""")
def collapse_repetition(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", folds.collapse_column(F.concat("text", F.lit("\n"), "text")).alias("r"))
    return docs.select("doc_id", "r.text", "r.cut")


@query(f"SELECT doc_id, {sql_apply('text', rules.LATEX)} AS text FROM (SELECT doc_id, text || ' $\\frac{{1}}{{2}}$ and $2$ or \\dfrac{{a}}{{b}} end' AS text FROM documents)")
def normalize_latex(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(r" $\frac{1}{2}$ and $2$ or \dfrac{a}{b} end")).alias("text"))
    return docs.select("doc_id", t.normalize_latex(F.col("text")).alias("text"))


@query()
def listening_scripts(spark, sf_dir):
    docs = _headed(table(spark, sf_dir, "documents")).withColumns({"kind": F.lit("link"), "title": F.concat(F.lit("Document "), F.col("doc_id").cast("string")), "tldr": F.substring("text", 1, 80), "summary": F.substring("text", 1, 200)})
    return engine.script(docs)


@query(f"""
SELECT doc_id, length(a)::BIGINT AS chars_before, length(b)::BIGINT AS chars_after, (length(b) - length(a))::BIGINT AS delta
FROM (SELECT doc_id, text AS a, {_clean_sql('text')} AS b FROM ({_MARKED_SQL}))""")
def variant_metrics(spark, sf_dir):
    rows = _marked(table(spark, sf_dir, "documents")).withColumn("cleaned", t.clean_body(F.col("text")))
    return rows.select("doc_id", F.length("text").cast("long").alias("chars_before"), F.length("cleaned").cast("long").alias("chars_after"), (F.length("cleaned") - F.length("text")).cast("long").alias("delta"))


@query(f"SELECT doc_id, max(n)::BIGINT AS longest FROM (SELECT doc_id, island, count(*) AS n FROM (SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM (SELECT * FROM ({_LINES}) WHERE length({sql_strip('line')}) BETWEEN 1 AND 80 AND NOT regexp_matches({sql_strip('line')}, '[.!?\"”’):]$'))) GROUP BY doc_id, island) GROUP BY doc_id")
def short_line_runs(spark, sf_dir):
    """The longest run of short lines without a sentence's end in each document (80 characters here), as islands."""
    rows = lines.lines_of(table(spark, sf_dir, "documents")).withColumn("s", strip(F.col("line")))
    rows = rows.where((F.length("s") >= 1) & (F.length("s") <= 80) & ~F.col("s").rlike(f"[{rules.TERMINAL}]$"))
    islands = rows.withColumn("island", F.col("line_no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")))
    return islands.groupBy("doc_id", "island").count().groupBy("doc_id").agg(F.max("count").alias("longest"))
