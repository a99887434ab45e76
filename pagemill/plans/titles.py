"""Queries of documents' assembly, titles, notes, covers and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import rules, text as t
from pagemill.functions.rx import literal, plain, quoted, sql_pattern, sql_strip
from pagemill.operators import documents as d
from pagemill.plans.registry import query, table
from pagemill.sources import web

_NONWS = "length(regexp_replace({x}, '\\s+', '', 'g'))"


def _turn_pages(spark, sf_dir):
    """A conversation is a document and its turns are its pages."""
    method = F.when(F.col("role") == "user", "text-layer").when(F.col("role") == "assistant", "ocr").otherwise("skipped")
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("number"), "text", method.alias("method"), (F.length("text") / 100.0).alias("seconds"))


@query("SELECT conv_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (trim(text) <> '' AND conv_id % 7 > 0), '') AS text FROM conversations GROUP BY conv_id")
def doc_assemble(spark, sf_dir):
    """Pages of every seventh document are blank."""
    pages = _turn_pages(spark, sf_dir).withColumn("text", F.when(F.col("conv_id") % 7 == 0, " \n").otherwise(F.col("text")))
    return d.assembled(pages, "conv_id")


@query("""
WITH p AS (SELECT conv_id, CASE role WHEN 'user' THEN 'text-layer' WHEN 'assistant' THEN 'ocr' ELSE 'skipped' END AS method, length(text) / 100.0::DOUBLE AS seconds FROM conversations)
SELECT conv_id, count(*) AS pages, count(*) FILTER (method = 'ocr') AS ocr_pages, round(sum(seconds), 6) AS seconds,
  coalesce(string_agg(DISTINCT method, '+' ORDER BY method) FILTER (method <> 'skipped'), 'none') AS methods,
  CASE WHEN count(DISTINCT method) > 1 THEN 'mixed' ELSE min(method) END AS summary_line FROM p GROUP BY conv_id""")
def doc_profile(spark, sf_dir):
    return d.profile(_turn_pages(spark, sf_dir), "conv_id")


_LINE_PAGES = "SELECT doc_id, number, CASE WHEN (number + doc_id) % 4 = 3 THEN ' Scan ' || number || ' ' ELSE line END AS text FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS number, unnest(string_split(text, chr(10))) AS line FROM documents)"


def _line_pages(spark, sf_dir):
    """Lines as pages; every fourth place is a scan with a few signs of text."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("number", "line"))
    scan = F.concat(F.lit(" Scan "), F.col("number").cast("string"), F.lit(" "))
    return rows.select("doc_id", F.col("number").cast("long").alias("number"), F.when((F.col("number") + F.col("doc_id")) % 4 == 3, scan).otherwise(F.col("line")).alias("text"))


@query(f"SELECT doc_id, number, text, CASE WHEN {_NONWS.format(x='text')} < {rules.MIN_PAGE_CHARS} THEN 'ocr' ELSE 'text-layer' END AS method, NULL::VARCHAR AS reason FROM ({_LINE_PAGES})")
def page_route(spark, sf_dir):
    return d.routed(_line_pages(spark, sf_dir), "doc_id")


@query(f"""
WITH p AS (SELECT *, ({_NONWS.format(x='text')} < {rules.MIN_PAGE_CHARS})::INT AS needs FROM ({_LINE_PAGES})), q AS (SELECT *, sum(needs) OVER (PARTITION BY doc_id ORDER BY number) AS nth FROM p)
SELECT doc_id, number, text, CASE WHEN needs = 1 AND nth > 3 THEN 'skipped' WHEN needs = 1 THEN 'ocr' ELSE 'text-layer' END AS method, CASE WHEN needs = 1 AND nth > 3 THEN 'OCR page cap' END AS reason FROM q""")
def ocr_page_cap(spark, sf_dir):
    return d.routed(_line_pages(spark, sf_dir), "doc_id", 3)


@query(f"""
WITH p AS (SELECT *, CASE WHEN {_NONWS.format(x='text')} < {rules.MIN_PAGE_CHARS} THEN 'ocr' ELSE 'text-layer' END AS method FROM ({_LINE_PAGES}))
SELECT doc_id, number, CASE WHEN number % 3 = 0 THEN 'cached ' || text ELSE text END AS text, CASE WHEN number % 3 = 0 THEN 'ocr' ELSE method END AS method, NULL::VARCHAR AS reason, number % 3 = 0 AS from_cache FROM p""")
def page_cache(spark, sf_dir):
    pages = d.routed(_line_pages(spark, sf_dir), "doc_id")
    cache = pages.where("number % 3 = 0").select("doc_id", "number", F.concat(F.lit("cached "), "text").alias("text"), F.lit("ocr").alias("method"), F.lit(None).cast("string").alias("reason"))
    return d.cached(pages, cache, "doc_id")


@query(f"""
SELECT conv_id, turn, CASE WHEN turn % 5 = 4 OR turn % 5 = 3 THEN '' ELSE {sql_strip('text')} END AS text, CASE WHEN turn % 5 >= 3 THEN 'skipped' ELSE 'ocr' END AS method,
  CASE WHEN turn % 5 = 4 THEN 120.0 ELSE turn::DOUBLE END AS seconds, CASE turn % 5 WHEN 4 THEN 'OCR timed out after 120s' WHEN 3 THEN 'OCR runaway, cut at 4096 tokens' END AS reason FROM conversations""")
def ocr_outcomes(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    out = d.ocr_outcome(F.col("text"), F.col("turn"), F.col("turn") % 5 != 3, F.col("turn") % 5 == 4, 120, 4096)
    return rows.select("conv_id", "turn", out.alias("o")).select("conv_id", "turn", "o.*")


@query("""
SELECT p_partkey, CASE WHEN w <= 1500 AND h <= 1500 THEN w ELSE greatest(1, round_even(w * 1500 / greatest(w, h)::DOUBLE, 0))::INT END AS width,
  CASE WHEN w <= 1500 AND h <= 1500 THEN h ELSE greatest(1, round_even(h * 1500 / greatest(w, h)::DOUBLE, 0))::INT END AS height
FROM (SELECT p_partkey, (p_partkey * 7 % 4000 + 1)::INT AS w, (p_partkey * 13 % 3000 + 1)::INT AS h FROM part)""")
def image_downscale(spark, sf_dir):
    side = lambda a, b: (F.col("p_partkey") * a % b + 1).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", d.scaled(side(7, 4000), side(13, 3000)).alias("s")).select("p_partkey", "s.*")


_TARGETS = "SELECT url AS target, false AS present FROM pages UNION ALL SELECT p_name || CASE p_partkey % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.jpg' WHEN 2 THEN '.xyz' ELSE '' END, p_partkey % 5 <> 0 FROM part"


@query(f"""
WITH x AS (SELECT target, present, lower(regexp_extract(target, '\\.([^./]+)$', 1)) AS suffix, regexp_matches(target, '^https?://') AS link FROM ({_TARGETS})), k AS (SELECT list_value('png','jpg','jpeg','webp','tif','tiff','bmp','gif') AS images)
SELECT target, CASE WHEN link THEN 'link' WHEN present AND suffix = 'pdf' THEN 'pdf' WHEN present AND list_contains(images, suffix) THEN 'image' END AS kind,
  CASE WHEN link THEN NULL WHEN NOT present THEN 'not a file or URL' WHEN NOT (suffix = 'pdf' OR list_contains(images, suffix)) THEN 'unsupported file type' END AS error FROM x, k""")
def target_dispatch(spark, sf_dir):
    suffix = F.when(F.col("p_partkey") % 4 == 0, ".PDF").when(F.col("p_partkey") % 4 == 1, ".jpg").when(F.col("p_partkey") % 4 == 2, ".xyz").otherwise("")
    files = table(spark, sf_dir, "part").select(F.concat("p_name", suffix).alias("target"), (F.col("p_partkey") % 5 != 0).alias("present"))
    rows = table(spark, sf_dir, "pages").select(F.col("url").alias("target"), F.lit(False).alias("present")).union(files)
    kind, error = d.dispatched(F.col("target"), F.col("present"))
    return rows.select("target", kind.alias("kind"), error.alias("error"))


_TITLE = f"nullif({sql_strip(chr(39).join(['regexp_replace(regexp_extract(html, ', '(?is)<title[^>]*>(.*?)</title>', ', 1), ', chr(92) + 's+', ', ', ' ', ', ', 'g', ')']))}, '')"


@query(f"SELECT page_id, {_TITLE} AS title FROM pages")
def web_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", web.page_title(F.col("html")).alias("title"))


@query()
def web_documents(spark, sf_dir):
    return web.web_documents(table(spark, sf_dir, "pages"))


_JUNK = f"""(length({{s}}) < 3 OR list_bool_or(list_transform([{', '.join(map(quoted, rules.JUNK_PREFIXES))}], lambda p: starts_with(lower({{s}}), p)))
  OR list_bool_or(list_transform([{', '.join(map(quoted, rules.JUNK_SUFFIXES))}], lambda p: ends_with(lower({{s}}), p)))
  OR CASE WHEN NOT contains({{s}}, ' ') THEN regexp_matches({{s}}, '[0-9._-]') ELSE length(regexp_replace({{s}}, '[^\\p{{{{L}}}}\\s]', '', 'g')) / length({{s}}) < 0.6 END)"""


def _junk_sql(x: str) -> str:
    return _JUNK.format(s=x).replace("{{L}}", "{L}")


_CANDIDATES = "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '_') || '-' || p_partkey WHEN 2 THEN 'Microsoft Word - ' || p_name WHEN 3 THEN p_name || '.docx' WHEN 4 THEN 'ab' ELSE '12 34 56 ' || p_brand END AS title, p_name, p_type, p_brand FROM part"


def _candidates(spark, sf_dir):
    m = F.col("p_partkey") % 6
    title = F.when(m == 0, F.col("p_name")).when(m == 1, F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("-"), F.col("p_partkey").cast("string"))).when(m == 2, F.concat(F.lit("Microsoft Word - "), "p_name")).when(m == 3, F.concat("p_name", F.lit(".docx"))).when(m == 4, "ab").otherwise(F.concat(F.lit("12 34 56 "), "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", title.alias("title"), "p_name", "p_type", "p_brand")


@query(f"SELECT p_partkey, title, {_junk_sql('title')} AS junk FROM ({_CANDIDATES})")
def junk_title(spark, sf_dir):
    return _candidates(spark, sf_dir).select("p_partkey", "title", t.is_junk_title(F.col("title")).alias("junk"))


@query(f"""
WITH x AS (SELECT p_partkey, title AS own, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS model, '/in/' || p_brand || '.pdf' AS source, p_brand AS stem FROM ({_CANDIDATES}))
SELECT p_partkey, CASE WHEN NOT {_junk_sql('own')} THEN own WHEN NOT {_junk_sql('model')} THEN model WHEN NOT {_junk_sql('stem')} THEN stem ELSE coalesce(nullif(stem, ''), nullif(own, ''), nullif(model, ''), '') END AS title FROM x""")
def title_ladder(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    source = F.concat(F.lit("/in/"), "p_brand", F.lit(".pdf"))
    return rows.select("p_partkey", t.title_ladder(F.col("title"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(""), t.stem(source)).alias("title"))


_UNSAFE = quoted(rules.UNSAFE_IN_NAMES)


def _slug_sql(x: str) -> str:
    plain = f"regexp_replace(regexp_replace({x}, {_UNSAFE}, '', 'g'), '\\s+', ' ', 'g')"
    plain = f"regexp_replace(regexp_replace({plain}, '^[ .]+', ''), '[ .]+$', '')"
    return f"coalesce(nullif({sql_strip(f'substring({plain}, 1, 80)')}, ''), 'Untitled note')"


@query(f"SELECT doc_id, {_slug_sql(chr(39) + '..A: ' + chr(39) + ' || text')} AS name FROM documents UNION ALL SELECT -p_partkey, {_slug_sql('p_name || p_type')} FROM part")
def slugify(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", t.slug(F.concat(F.lit("..A: "), "text")).alias("name"))
    return docs.union(table(spark, sf_dir, "part").select(-F.col("p_partkey"), t.slug(F.concat("p_name", "p_type"))))


_MD = "'# Top' || chr(10) || text || chr(10) || '### Low' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '###### Six' || chr(10) ELSE '' END || 'tail'"


@query(f"SELECT doc_id, regexp_replace(regexp_replace({_MD}, '(?m)^(#{{1,6}})(\\s)', '##\\1\\2', 'g'), '(?m)^#{{7,}}(\\s)', '######\\1', 'g') AS text FROM documents")
def demote_headings(spark, sf_dir):
    md = F.concat(F.lit("# Top\n"), "text", F.lit("\n### Low\n"), F.when(F.col("doc_id") % 2 == 0, "###### Six\n").otherwise(""), F.lit("tail"))
    return table(spark, sf_dir, "documents").select("doc_id", t.demote_headings(md).alias("text"))


_CALLOUT = "'> [!note]- Full extracted text' || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN trim(x) = '' THEN '>' ELSE '> ' || x END), chr(10))"
_NOTE = f"""'---' || chr(10) || 'tags: [generated, ' || lang || ', ' || source || ']' || chr(10) || 'created: 2024-05-06' || chr(10) || 'Sources: http://x.example/' || doc_id || chr(10) || 'type: link' || chr(10) || '---' || chr(10)
 || '# Document ' || doc_id || chr(10) || chr(10) || '> Source: [Document ' || doc_id || '](http://x.example/' || doc_id || ')' || chr(10) || '> Ingested: 2024-05-06 · Pages: 1 · Extraction: web · Model: stub' || CASE WHEN n_chars > 5000 THEN ' · Summarized in 2 sections (map-reduce)' ELSE '' END || chr(10) || chr(10)
 || '## TL;DR' || chr(10) || chr(10) || substring(text, 1, 40) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10) || '### Points' || chr(10) || substring(text, 1, 90) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Source Text' || chr(10) || chr(10) || {_CALLOUT} || chr(10)"""


def _notes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumns({
        "pages": F.lit(1), "methods": F.lit("web"), "ocr_pages": F.lit(0), "seconds": F.lit(0.0), "skipped_pages": F.lit(0), "skip_reasons": F.array().cast("array<string>"),
        "sections": F.when(F.col("n_chars") > 5000, 2).otherwise(1), "truncated_chars": F.lit(0),
    })
    title, source = F.concat(F.lit("Document "), F.col("doc_id").cast("string")), F.concat(F.lit("http://x.example/"), F.col("doc_id").cast("string"))
    text = F.col("text")
    return docs.select("doc_id", d.note(title, source, F.lit("link"), title, F.array(F.lit("generated"), F.col("lang"), F.col("source")), "2024-05-06", d.provenance(docs, "2024-05-06", "stub"), F.substring(text, 1, 40), F.concat(F.lit("# Points\n"), F.substring(text, 1, 90)), text).alias("note"))


@query(f"SELECT doc_id, {_NOTE} AS note FROM documents")
def note_render(spark, sf_dir):
    return _notes(spark, sf_dir)


@query(f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(note, '(?s)\\A---\\n.*?\\n---\\n', ''), '(?m)^> \\[!\\w+\\][+-]? ?[ \\t]*(\\S.*?)[ \\t]*$', '> **\\1**' || chr(10) || '>', 'g'), '(?m)^> \\[!\\w+\\][+-]? ?[ \\t]*$', '>', 'g') AS note FROM (SELECT doc_id, {_NOTE} AS note FROM documents)""")
def portable_note(spark, sf_dir):
    return _notes(spark, sf_dir).select("doc_id", t.portable_markdown(F.col("note")).alias("note"))


@query("SELECT doc_id, 'obsidian://open?vault=My%20Vault&file=' || url_encode('Notes/' || text || ' ~*') AS uri FROM documents")
def note_uri(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.note_uri("My Vault", F.concat(F.lit("Notes/"), "text", F.lit(" ~*.md"))).alias("uri"))


_SITE = "^(.{3,})\\s+[|-]\\s+([^|]+)$"


@query(f"""
WITH x AS (SELECT page_id, {sql_strip("regexp_replace(title || CASE page_id % 3 WHEN 0 THEN ' - The_Site' WHEN 1 THEN ' | one two three four' ELSE '' END, '[\\s_]+', ' ', 'g')")} AS o FROM (SELECT page_id, coalesce({_TITLE}, '') AS title FROM pages))
SELECT page_id, CASE WHEN regexp_matches(o, '{_SITE}') AND len(string_split_regex({sql_strip(f"regexp_extract(o, '{_SITE}', 2)")}, '\\s+')) <= 3 THEN {sql_strip(f"regexp_extract(o, '{_SITE}', 1)")} ELSE o END AS title FROM x""")
def cover_title(spark, sf_dir):
    tail = F.when(F.col("page_id") % 3 == 0, " - The_Site").when(F.col("page_id") % 3 == 1, " | one two three four").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", t.cover_title(F.concat(F.coalesce(web.page_title(F.col("html")), F.lit("")), tail), True).alias("title"))


@query("SELECT doc_id, ('0x' || substring(sha256(doc_id::VARCHAR), 1, 8))::BIGINT AS seed FROM documents")
def cover_seed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.seed(F.col("doc_id").cast("string")).alias("seed"))


def _scene_sql(x: str) -> str:
    """The rules one by one; words that hold something are marked first, so that none of them is taken for a filler (there is no look ahead)."""
    for pattern, flags, new in rules.SCENE:
        bare = sql_pattern(plain(pattern), flags)
        if "(?!" in bare:
            x = f"regexp_replace(regexp_replace({x}, '(?i)(^|[^\\p{{L}}\\p{{N}}_-])({rules.SCENE_HELD})\\b', '\\1' || chr(1) || '\\2', 'g'), '(?i)-({rules.SCENE_HELD})\\b', '-' || chr(2) || '\\1', 'g')"
            x = f"regexp_replace({x}, '(?i)\\s*[' || chr(1) || chr(2) || ']{rules.SCENE_HELD}\\s+(?:[\\p{{L}}\\p{{N}}_' || chr(2) || '-]+\\s+){{0,3}}?{rules.SCENE_LETTERED}\\b', '', 'g')"
            x = f"regexp_replace({x}, '[' || chr(1) || chr(2) || ']', '', 'g')"
        else:
            x = f"regexp_replace({x}, {quoted(bare)}, '{new.replace('$', chr(92))}', 'g')"
    return f"regexp_replace({x}, '^[ ,;]+|[ ,;]+$', '', 'g')"


_SCENE = ("A figure holding signs labeled 'Vote' and \"Now\", a plaque reading 'Library', a woman reading a book with well-under signs, ", " under a banner titled Peace; the end ,")


@query(f"SELECT doc_id, {_scene_sql(f'{literal(_SCENE[0])} || text || {literal(_SCENE[1])}')} AS scene FROM documents")
def clean_scene(spark, sf_dir):
    scene = F.concat(F.lit(_SCENE[0]), "text", F.lit(_SCENE[1]))
    return table(spark, sf_dir, "documents").select("doc_id", t.clean_scene(scene).alias("scene"))
