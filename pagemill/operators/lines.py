"""Operators on the lines and paragraphs of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.functions import rules, text as t
from pagemill.functions.folds import candidate_words, repair_glyphs_column
from pagemill.functions.rx import let, spark_pattern, strip


def lines_of(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, line_no (from 0) and line."""
    return docs.select(key, F.posexplode(F.split(column, "\n")).alias("line_no", "line"))


def without_running_headers(text: Column) -> Column:
    """Lines that stand in a document three times or more, and are longer than three characters, go wherever they stand.

    Form feeds, carriage returns and the like end lines too. A text that loses none stays as it is; else its lines end with newlines.
    Per row: in sorted lines, one stands three times where it equals those beside it or two places off; what is left is
    sorted by place again. Nothing is shuffled, and a long document costs two sorts.
    """
    step = rules.REPEATED_LINE_TIMES - 1

    def rare(ordered: Column) -> Column:
        def alone(x: Column, i: Column) -> Column:
            same = lambda k: F.coalesce(F.get(ordered, i + k)["s"] == x["s"], F.lit(False))
            first = [same(k + step) & (same(k) if k else F.lit(True)) for k in range(-step, 1)]
            often = first[0]
            for f in first[1:]:
                often = often | f
            return ~(often & (F.length(x["s"]) > rules.REPEATED_LINE_LONGER))

        left = F.sort_array(F.transform(F.filter(ordered, alone), lambda x: F.struct(x["i"].alias("i"), x["line"].alias("line"))))
        return F.transform(left, lambda x: x["line"])

    def dropped(lines: Column) -> Column:
        ordered = F.sort_array(F.transform(lines, lambda line, i: F.struct(strip(line).alias("s"), i.alias("i"), line.alias("line"))))
        return let(ordered, rare)

    def of_lines(x: Column, lines: Column) -> Column:
        # a line that stands three times leaves two distinct ones fewer than there are
        few = F.size(lines) - F.size(F.array_distinct(F.transform(lines, strip))) < step
        return F.when(few, x).otherwise(let(dropped(lines), lambda kept: F.when(F.size(kept) == F.size(lines), x).otherwise(F.array_join(kept, "\n"))))

    def split(x: Column) -> Column:
        lines = F.split(F.regexp_replace(x, rules.LINE_ENDS, "\n"), "\n")
        return let(lines, lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a))

    return let(text, lambda x: let(split(x), lambda lines: of_lines(x, lines)))


def label_runs(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, first and lines of the runs of neighbouring short lines that end no sentence: listings and labels of figures. rows: key, line_no, line.

    A blank line ends a run; three lines make one (`rules.SHORT_LINE_RUN`).
    """
    own = strip(F.col("line"))
    labels = rows.where((F.length(own) >= 1) & (F.length(own) <= rules.SHORT_LINE_CHARS) & ~F.substring(own, -1, 1).isin(*rules.TERMINAL))
    islands = labels.withColumn("island", F.col("line_no") - F.row_number().over(Window.partitionBy(key).orderBy("line_no")))
    return islands.groupBy(key, "island").agg(F.min("line_no").alias("first"), F.count("*").alias("lines")).where(F.col("lines") >= rules.SHORT_LINE_RUN).drop("island")


def section_starts(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows (key, line_no, line) with starts: whether a section of a text layer begins with the line.

    A heading does where the line before is blank; a numbered one also where that ends a sentence.
    """
    before = F.coalesce(strip(F.lag("line").over(Window.partitionBy(key).orderBy("line_no"))), F.lit(""))
    numbered = strip(F.col("line")).rlike(spark_pattern(rules.NUMBERED_HEADING, "i"))
    ended = before.rlike(r"(?:[.!?]|\.[\"\u201d])$")
    marked = rows.withColumn("_before", before).withColumn("_ended", ended)
    return marked.withColumn("starts", t.looks_like_heading(F.col("line")) & ((F.col("_before") == "") | (F.col("_ended") & numbered))).drop("_before", "_ended")


def prepared(text: Column, words: Column | None = None) -> Column:
    """Document level: missing glyphs, running headers, furniture, end matter.

    words: the known words that holes in a text may stand for (`known_words`); without any, ligatures are guessed by place.
    """
    return t.cut_end_matter(t.hygiene(without_running_headers(repair_glyphs_column(text, words))))


def known_words(docs: DataFrame, vocabulary: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key and words (array): of all words that a text's holes could make, those in `vocabulary` (word); only texts with holes."""
    holed = docs.where(F.col(column).rlike(f"[{rules.MISSING_GLYPH}]")).select(key, F.explode(candidate_words(F.col(column))).alias("word"))
    return holed.distinct().join(vocabulary.select("word").distinct(), "word", "left_semi").groupBy(key).agg(F.collect_list("word").alias("words"))


def vocabulary(docs: DataFrame, column: str = "text", least: int = 1) -> DataFrame:
    """word and n: every word of a corpus with a ligature in it, counted over all texts; pre-aggregated per task."""
    words = F.regexp_extract_all(F.lower(column), F.lit(r"(\p{L}*(?:" + "|".join(rules.LIGATURES) + r")\p{L}*)"), F.lit(1))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def lint(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, pattern, hits for every lint pattern of every document, zero included."""
    counts = docs.select(key, F.explode(t.lint_counts(F.col(column))).alias("c"))
    return counts.select(key, "c.pattern", "c.hits")


def findings(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, pattern, hits and context of the first hit, for what documents still hold; repeated paragraphs among them."""
    left = docs.select(key, F.explode(t.lint_findings(F.col(column))).alias("c")).select(key, "c.*")
    again = repeated_paragraphs(docs, key, column).groupBy(key).agg(F.count("*").alias("hits"), F.min_by("paragraph", "rank").alias("first"))
    shown = strip(F.regexp_replace(F.substring("first", 1, 80), r"(?U)\s+", " "))
    return left.unionByName(again.select(key, F.lit("repeated paragraph").alias("pattern"), "hits", shown.alias("context")))


def repeated_paragraphs(docs: DataFrame, key: str = "doc_id", column: str = "text", separator: str = "\n\n", least: int = rules.REPEATED_PARAGRAPH_CHARS) -> DataFrame:
    """Long paragraphs that come again within a document: their number, the first text, in the order of second places."""
    parts = docs.select(key, F.posexplode(F.split(column, separator)).alias("at", "paragraph")).where(F.length("paragraph") >= least)
    parts = parts.withColumn("k", t.paragraph_key(F.col("paragraph")))
    by_key = parts.groupBy(key, "k").agg(F.min(F.struct("at", "paragraph")).alias("first"), F.sort_array(F.collect_list("at")).alias("places"), F.count("*").alias("times")).where("times > 1")
    order = Window.partitionBy(key).orderBy("second")
    return by_key.select(key, F.col("first.paragraph").alias("paragraph"), "times", F.col("places")[1].alias("second")).withColumn("rank", F.row_number().over(order))


def shared_paragraphs(docs: DataFrame, key: str = "doc_id", column: str = "text", separator: str = "\n", least: int = rules.REPEATED_PARAGRAPH_CHARS) -> DataFrame:
    """Paragraph keys found in more than one document, with how many and the first; pre-aggregated, so a common one isn't a hot task."""
    parts = docs.select(key, F.explode(F.split(column, separator)).alias("paragraph")).where(F.length("paragraph") >= least)
    digest = F.sha2(t.paragraph_key(F.col("paragraph")).cast("binary"), 256).alias("digest")
    return parts.select(key, digest).distinct().groupBy("digest").agg(F.count("*").alias("documents"), F.min(key).alias("first")).where("documents > 1")
