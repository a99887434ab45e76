"""Article text and title from HTML pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.rx import strip

_SKIP = {"script", "style", "nav", "footer", "header", "aside", "template", "noscript", "form", "button", "svg", "iframe"}
#: Words of a class, id or role that say an element isn't the article's.
_ASIDE = {"ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comments", "cookie", "menu", "navigation", "newsletter", "popup", "promo", "related", "share", "sidebar", "social", "sponsor", "sponsored", "widget"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCKS = {"p", "div", "li", "ul", "ol", "table", "tr", "blockquote", "pre", "section", "article", "figure", "h1", "h2", "h3", "h4", "h5", "h6"}


class _Article(HTMLParser):
    """Markdown of what stands in <article> or <main>, or of the body where neither is: headings, lists, links, tables."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[bool, str]] = []
        self.run: list[str] = []
        self.prefix, self.inside, self.link = "", 0, None
        self.hidden: list[str] = []  # the elements open within one that isn't read
        self.rows: list[list[str]] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        if self.rows is not None and self.rows and self.rows[-1]:
            self.rows[-1][-1] = f"{self.rows[-1][-1]} {text}".strip()
        elif text:
            self.blocks.append((self.inside > 0, self.prefix + text))
        self.run, self.prefix = [], ""

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.hidden:
            if tag not in _VOID:
                self.hidden.append(tag)
            return
        words = set(" ".join(a.get(k) or "" for k in ("class", "id", "role")).lower().replace("-", " ").replace("_", " ").split())
        if (tag in _SKIP or words & _ASIDE) and tag not in ("html", "body", "main", "article"):
            if tag not in _VOID:
                self.hidden.append(tag)
            return
        if tag in _BLOCKS:
            self.flush()
        if tag in ("article", "main"):
            self.inside += 1
        if tag == "table":
            self.rows = []
        elif self.rows is not None and tag == "tr":
            self.rows.append([])
        elif self.rows is not None and tag in ("td", "th") and self.rows:
            self.flush()
            self.rows[-1].append("")
        elif tag[0] == "h" and tag[1:].isdigit():
            self.prefix = "#" * int(tag[1]) + " "
        elif tag == "li":
            self.prefix = "- "
        elif tag == "br":
            self.run.append(" ")
        elif tag == "a" and (a.get("href") or "").startswith("http"):
            self.link = a["href"]
            self.run.append("[")

    def handle_endtag(self, tag):
        if self.hidden:
            if tag in self.hidden:  # what was left open within it ends too
                del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]
            return
        if tag in _BLOCKS or tag in ("td", "th"):
            self.flush()
        if tag == "table" and self.rows is not None:
            rows, self.rows = [r for r in self.rows if any(r)], None
            if rows:
                lines = ["| " + " | ".join(c.replace("|", "\\|") for c in r) + " |" for r in rows]
                lines.insert(1, "|" + " --- |" * len(rows[0]))
                self.blocks.append((self.inside > 0, "\n".join(lines)))
        if tag in ("article", "main"):
            self.inside = max(0, self.inside - 1)
        if tag == "a" and self.link:
            self.run.append(f"]({self.link})")
            self.link = None

    def handle_data(self, data):
        if not self.hidden:
            self.run.append(data)


def article(html: str | None) -> str:
    parser = _Article()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    within = [text for inside, text in parser.blocks if inside]
    return "\n\n".join(within or [text for _, text in parser.blocks])


def page_title(html: Column) -> Column:
    """The <title>, white space tidied; null without one."""
    found = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.nullif(strip(F.regexp_replace(found, r"(?U)\s+", " ")), F.lit(""))


def web_documents(pages: DataFrame) -> DataFrame:
    """page_id, source, title (the URL where there is none), text and error. pages: page_id, url, html."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(text=[article(h) for h in b["html"]]).drop(columns=["html"])

    rows = pages.select("page_id", F.col("url").alias("source"), F.coalesce(page_title(F.col("html")), "url").alias("title"), "html")
    out = rows.mapInPandas(run, f"page_id {dict(pages.dtypes)['page_id']}, source string, title string, text string")
    return out.withColumn("error", F.when(strip(F.col("text")) == "", F.concat(F.lit("no article content found at "), F.col("source"))))
