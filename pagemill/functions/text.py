"""Scalar text functions as Spark columns: JVM-side, one projection, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import rules
from pagemill.functions.rx import SPACES, apply, apply_gated, apply_probed, holds, let, spark_pattern, strip

Text = Column


def hygiene(text: Column) -> Column:
    """Without page furniture and boilerplate, broken words healed. Running headers are a window (`operators.lines`)."""
    return apply_probed(apply_probed(text, rules.HYGIENE_LINES, rules.SIGNS), [*rules.HYGIENE_INLINE, rules.HYPHEN_BREAK], rules.SIGNS)


def cut_end_matter(text: Column) -> Column:
    """What stands before the first end-matter heading."""
    pattern, flags = rules.END_MATTER
    return F.split(text, spark_pattern(pattern, flags), 2)[0]


def headings_spoken(text: Column) -> Column:
    """A heading line becomes a sentence: its marks go, one full stop ends it."""
    spoken = [(r"^#{1,6}\s+(.*?)[^\S\n]*$", "m", "\x03$1\x04"), (r"[.:]+\x04", "", "\x04"), (r"\x03", "", ""), (r"\x04", "", ".")]
    return let(text, lambda x: F.when(holds(x, ["#", "\x03", "\x04"]), apply(x, spoken)).otherwise(x))


def clean_body(text: Column) -> Column:
    """Without what is painful to hear; every sentence of the author stays."""
    text = headings_spoken(apply_gated(text, rules.CLEAN_BEFORE_HEADINGS, rules.SIGNS))
    # a pair ends in a mark after a sign; without one, every mark would be tried against all that follows it
    paired = lambda x: F.when(x.rlike(r"[^ \t\n\r][*_]"), apply(x, [rules.EMPHASIS, rules.EMPHASIS])).otherwise(x)
    text = let(apply_gated(text, [rules.INLINE_CODE], rules.SIGNS), paired)
    return strip(apply_gated(text, rules.CLEAN_AFTER_EMPHASIS, rules.SIGNS))


def lint_counts(text: Column) -> Column:
    """An array of (pattern, hits): what is left that a voice would read out."""
    return let(without_author_brackets(text), lambda bare: F.array(*[F.struct(F.lit(name).alias("pattern"), _counted(bare, name, p, f).alias("hits")) for name, p, f in rules.LINT]))


def _counted(text: Column, name: str, pattern: str, flags: str) -> Column:
    hits = F.regexp_count(text, F.lit(spark_pattern(pattern, flags))).cast("long")
    return F.when(holds(text, rules.LINT_SIGNS[name]), hits).otherwise(F.when(text.isNotNull(), F.lit(0).cast("long"))) if name in rules.LINT_SIGNS else hits


def without_author_brackets(text: Column) -> Column:
    """Short words in brackets are the author's own: only the word stays."""
    return apply_gated(text, [rules.AUTHOR_BRACKET], {rules.AUTHOR_BRACKET[0]: ["["]})


def lint_findings(text: Column) -> Column:
    """An array of (pattern, hits, context) of what a text still holds, the first hit of each with what stands around it."""

    def found(bare: Column) -> Column:
        each = [F.struct(F.lit(name).alias("pattern"), _counted(bare, name, p, f).alias("hits"), lint_context(bare, p, f).alias("context")) for name, p, f in rules.LINT]
        return F.filter(F.array(*each), lambda x: x["hits"] > 0)

    return let(without_author_brackets(text), found)


def lint_context(text: Column, pattern: str, flags: str) -> Column:
    """Forty characters around the first hit."""
    at = F.regexp_instr(text, F.lit(spark_pattern(pattern, flags)))
    start = F.greatest(F.lit(1), at - 40)
    return F.when(at > 0, strip(F.regexp_replace(F.substring(text, start, at + 40 - start), r"(?U)\s+", " ")))


def paragraph_key(text: Column) -> Column:
    """Small letters, single spaces, ASCII letters and digits only."""
    return F.regexp_replace(strip(F.regexp_replace(F.lower(text), r"(?U)\s+", " ")), "[^a-z0-9 ]+", "")


def sentence_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", ""))


def raw_sentences(text: Column) -> Column:
    """Split where a sentence ends before a capital, a digit or an opening sign."""
    return F.split(text, r'(?U)(?:(?<=[.!?])|(?<=[.!?]["\u201d\u2019)]))\s+(?=[A-Z0-9"\u201c(])')


#: Stand where a sentence ends, and where it doesn't though a gap looks like it.
_END, _ON = "\x1f", "\x1e"


def sentences(text: Column) -> Column:
    """The same, rejoined after abbreviations, initials and bare list numbers: passes over the text, no fold.

    A gap after an abbreviation becomes a space, any other a mark; a list number keeps the gap after it unless it was
    itself joined, so of numbers in a row every other one is. Texts that hold the marks are folded instead.
    """
    gap = r'\s+(?=[A-Z0-9"\u201c(])'
    # white space is looked for first, then the full stop, then the words before it
    short = rf"(?U)(?=\s)(?<=\.)(?<=(?i:{rules.ABBREVIATION.removesuffix('$')}))"

    def split(x: Column) -> Column:
        marked = F.regexp_replace(F.regexp_replace(x, short + gap, _ON), r'(?U)(?=\s)(?:(?<=[.!?])|(?<=[.!?]["\u201d\u2019)]))' + gap, _END)
        numbered = F.regexp_replace(marked, rf"(?U)(^|{_END})(\s*\d{{1,3}}\.){_END}", "$1$2 ")
        return F.split(F.translate(numbered, _ON, " "), _END)

    return let(text, lambda x: F.when(x.contains(_END) | x.contains(_ON), _folded_sentences(x)).otherwise(split(x)))


def _folded_sentences(text: Column) -> Column:
    joined = lambda last, part: F.concat(last, F.lit(" "), part)
    not_end = lambda s: s.rlike(spark_pattern(rules.ABBREVIATION, "i")) | strip(s).rlike(r"^\d{1,3}\.$")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("last"))
    step = lambda a, p: F.when(a["last"].isNull(), F.struct(a["done"].alias("done"), p.alias("last"))).when(not_end(a["last"]), F.struct(a["done"].alias("done"), joined(a["last"], p).alias("last"))).otherwise(F.struct(F.concat(a["done"], F.array(a["last"])).alias("done"), p.alias("last")))
    return F.aggregate(raw_sentences(text), start, step, lambda a: F.concat(a["done"], F.array(a["last"])))


def normalize_latex(text: Column) -> Column:
    return apply(text, rules.LATEX)


def slug(title: Column, longest: int = 80) -> Column:
    """A file name that people can read."""
    plain = F.regexp_replace(F.regexp_replace(title, rules.UNSAFE_IN_NAMES, ""), r"(?U)\s+", " ")
    plain = F.regexp_replace(plain, r"^[ .]+|[ .]+$", "")
    return F.coalesce(F.nullif(strip(F.substring(plain, 1, longest)), F.lit("")), F.lit("Untitled note"))


def demote_headings(markdown: Column, floor: int = 3) -> Column:
    """All headings deeper by one offset, so that the highest is at `floor`; none deeper than six."""
    levels = F.transform(F.regexp_extract_all(markdown, F.lit(r"(?Udm)^(#{1,6})\s"), F.lit(1)), F.length)
    shift = F.lit(floor) - F.array_min(levels)
    moved = F.regexp_replace(F.regexp_replace(markdown, r"(?Udm)^(#{1,6})(\s)", "\x03$1$2"), F.lit("\x03"), F.repeat(F.lit("#"), shift))
    return F.when(shift > 0, F.regexp_replace(moved, r"(?Udm)^#{7,}(\s)", "######$1")).otherwise(markdown)


def callout(body: Column) -> Column:
    """A folded quote of a text, line by line."""
    lines = F.transform(F.split(body, "\n"), lambda line: F.when(strip(line) == "", ">").otherwise(F.concat(F.lit("> "), line)))
    return F.array_join(F.concat(F.array(F.lit("> [!note]- Full extracted text")), lines), "\n")


def portable_markdown(markdown: Column) -> Column:
    """Without front matter; callout heads become bold leads in the same quote."""
    body = F.regexp_replace(markdown, r"(?s)\A---\n.*?\n---\n", "")
    led = F.regexp_replace(body, r"(?Udm)^> \[!\w+\][+-]? ?[ \t]*(\S.*?)[ \t]*$", "> **$1**\n>")
    return F.regexp_replace(led, r"(?Udm)^> \[!\w+\][+-]? ?[ \t]*$", ">")


def is_junk_title(title: Column) -> Column:
    """Whether a title is a file name in disguise."""
    s = strip(F.coalesce(title, F.lit("")))
    low = F.lower(s)
    named = F.lit(False)
    for p in rules.JUNK_PREFIXES:
        named = named | low.startswith(p)
    for p in rules.JUNK_SUFFIXES:
        named = named | low.endswith(p)
    letters = F.length(F.regexp_replace(s, r"(?U)[^\p{L}\s]", "")) / F.length(s)
    return (F.length(s) < 3) | named | F.when(~s.contains(" "), s.rlike(r"(?U)[\d\-_.]")).otherwise(letters < 0.6)


def title_ladder(own: Column, model: Column, stem: Column) -> Column:
    """The first that isn't junk of the source's title, the model's and the file's; else whatever isn't empty."""
    own, model = strip(F.coalesce(own, F.lit(""))), strip(F.coalesce(model, F.lit("")))
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(*[F.when(~is_junk_title(c), c) for c in (own, model, stem)], some(stem), some(own), some(model), F.lit(""))


def stem(source: Column) -> Column:
    """The file's name without its last suffix."""
    name = F.regexp_extract(source, r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def note_uri(vault: str, path: Column) -> Column:
    quote = lambda c: F.regexp_replace(F.regexp_replace(F.url_encode(c), r"\+", "%20"), r"\*", "%2A")
    tilde = lambda c: F.regexp_replace(c, "%7E", "~")
    return F.concat(F.lit("obsidian://open?vault="), tilde(quote(F.lit(vault))), F.lit("&file="), tilde(quote(F.regexp_replace(path, r"\.md$", ""))))


def clean_scene(scene: Column) -> Column:
    """A picture's description without lettering: `rules.SCENE`, each rule only where it can match.

    What the first two take ends in a quote's end, so they run up to the last one. The next two never cross a full stop, so
    they run in the pieces between full stops that hold one of their words in any case.
    """
    quoted, worded, tidied = rules.SCENE[:2], rules.SCENE[2:4], rules.SCENE[4:]
    last = lambda x: F.length(x) - F.least(*[F.length(F.substring_index(x, end, -1)) for end in rules.QUOTE_ENDS])
    up_to = lambda x, n: F.when(n > 0, F.concat(apply(F.left(x, n), quoted), F.substring(x, n + 1, F.length(x)))).otherwise(x)
    # where case doesn't count, these are letters of a to z that lower case doesn't make so (lower of upper won't do: Spark takes the inner one away)
    folded = lambda x: F.lower(F.replace(F.replace(F.replace(x, F.lit("\u0130"), F.lit("i")), F.lit("\u0131"), F.lit("i")), F.lit("\u017f"), F.lit("s")))

    def piece(x: Column, low: Column) -> Column:
        for rule, words in zip(worded, rules.SCENE_WORDS, strict=True):
            x = F.when(holds(low, words), apply(x, [rule])).otherwise(x)
        return x

    def stripped(x: Column) -> Column:
        x = F.ltrim(x, F.lit(" ,;"))
        ended = F.lit(False)
        for sign in "\n\r\x85\u2028\u2029":
            ended = ended | x.endswith(sign)
        return F.when(ended, F.regexp_replace(x, r"[ ,;]+$", "")).otherwise(F.rtrim(x, F.lit(" ,;")))

    text = let(scene, lambda x: let(last(x), lambda n: up_to(x, n)))
    text = let(text, lambda x: F.array_join(F.zip_with(F.split(x, r"\.", -1), F.split(folded(x), r"\.", -1), piece), "."))
    return let(apply(text, tidied), stripped)


def cover_title(title: Column, of_page: bool = False) -> Column:
    """The title as printed; a page's short site name after the last separator goes."""
    out = strip(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)[\s_]+", " "))
    if not of_page:
        return out
    shape = r"^(.{3,})\s+[|-]\s+([^|]+)$"
    tail = F.regexp_extract(out, shape, 2)
    return F.when(out.rlike(shape) & (F.size(F.split(strip(tail), r"(?U)\s+")) <= rules.SITE_SUFFIX_WORDS), strip(F.regexp_extract(out, shape, 1))).otherwise(out)


def seed(job_id: Column) -> Column:
    """A number that the job's id fixes."""
    return F.conv(F.substring(F.sha2(job_id.cast("binary"), 256), 1, 8), 16, 10).cast("long")


def first_url(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(some(F.regexp_extract(text, "(?U)" + rules.ANGLE_URL, 1)), some(F.regexp_replace(F.regexp_extract(text, "(?U)" + rules.BARE_URL, 0), ">+$", "")))


def is_cancel(text: Column) -> Column:
    bare = strip(F.regexp_replace(F.coalesce(text, F.lit("")), "<@[^>]+>", ""))
    return F.lower(F.regexp_replace(bare, r"^[!.]+|[!.]+$", "")).isin(rules.CANCEL_WORDS)


def is_help(text: Column) -> Column:
    return F.regexp_replace(F.lower(strip(F.coalesce(text, F.lit("")))), "^[!/]+", "").isin(rules.HELP_WORDS)


def normal_tags(tags: Column) -> Column:
    return F.filter(F.transform(tags, lambda t: F.lower(F.regexp_replace(strip(t), "^#+", ""))), lambda t: t != "")


def fit_to_context(text: Column, budget: int) -> tuple[Column, Column]:
    """The text's head that fits, and how many characters don't."""
    return F.substring(text, 1, budget), F.greatest(F.lit(0), F.length(text) - budget)


def cut_at_paragraph(text: Column, most: int) -> Column:
    """The head of a text, cut at its last blank line unless that loses over half."""

    def cut(head: Column) -> Column:
        seam = F.length(head) - F.length(F.substring_index(head, "\n\n", -1)) - 2
        return F.rtrim(F.when(seam > most // 2, F.substring(head, F.lit(1), seam)).otherwise(head), F.lit(SPACES))

    return let(text, lambda x: F.when(F.length(x) <= most, x).otherwise(let(F.substring(x, 1, most), cut)))


def voice_group(voice: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in rules.LANGUAGES.items() for x in pair])
    genders = F.create_map(*[F.lit(x) for pair in rules.GENDERS.items() for x in pair])
    language, gender = F.try_element_at(names, F.substring(voice, 1, 1)), F.try_element_at(genders, F.substring(voice, 2, 1))
    return F.when((F.substring(voice, 3, 1) == "_") & language.isNotNull() & gender.isNotNull(), F.concat(language, F.lit(", "), gender)).otherwise("other")


def voice_sample(voice: Column, passage: str) -> Column:
    """What a voice says of itself."""
    return F.concat(F.lit("Hello, I'm "), F.replace(voice, F.lit("_"), F.lit(" ")), F.lit(". " + passage))


def looks_like_heading(line: Column) -> Column:
    """A strict test for headings in text layers without markup."""
    s = strip(F.regexp_replace(line, rf"(?U)\s?[{rules.DIACRITIC_RESIDUE}]\s?|\.(?=[a-z])".replace("[¯˙˘´`^", "[¯˙˘´`\\^"), ""))
    numbered = F.regexp_extract(s, spark_pattern(rules.NUMBERED_HEADING, "i"), 1)
    is_numbered = s.rlike(spark_pattern(rules.NUMBERED_HEADING, "i"))
    core = F.when(is_numbered, numbered).otherwise(s)
    letters = F.length(F.regexp_replace(core, r"(?U)[^\p{L}\s]", "")) / F.length(core)
    words = F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")
    alpha = lambda w: F.length(F.regexp_replace(w, r"[^\p{L}]", ""))
    shape = (F.length(s) >= 3) & (F.length(s) <= 80) & ~s.rlike(r"[.,;:?!]$")
    plain = ~s.rlike(f"[{rules.AFFILIATION_MARKS}]") & F.exists(words, lambda w: alpha(w) >= 3) & ~((F.size(words) >= 4) & (F.size(F.array_distinct(words)) <= F.floor(F.size(words) / 2)))
    plain = plain & ~s.rlike(f"[{rules.BULLETS}]") & ~F.exists(words, lambda w: F.length(w) > 16)
    titled = numbered.rlike(r"^\p{Lu}")
    capitals = s.rlike(r"\p{Lu}") & ~s.rlike(r"\p{Ll}")
    loud = F.size(F.filter(words, lambda w: alpha(w) >= 3)) >= 2
    title_case = F.forall(words, lambda w: w.rlike(r"^(?:\p{Lu}|[^\p{L}])")) & F.exists(words, lambda w: w.rlike(r"^\p{Lu}"))
    return F.coalesce(shape & (letters >= 0.75) & plain & F.when(is_numbered, titled).otherwise((F.size(words) <= 10) & F.when(capitals, loud).otherwise(title_case)), F.lit(False))
