"""HTML: counts, title and language as columns; text and Markdown by the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose content is no text of the article.
SKIPPED = frozenset({"script", "style", "noscript", "template", "nav", "aside", "footer", "header", "form", "svg", "head"})
BLOCKS = frozenset({"p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "blockquote", "figure", "pre", "dl", "dt", "dd", "address"})
VOID = frozenset({"img", "br", "hr", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "track"})


def count_elements(html: Column, name: str) -> Column:
    return F.regexp_count(html, F.lit(rf"(?i)<{name}(?=[\s/>])"))


def title_of(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def language_of(html: Column) -> Column:
    """The primary part of the lang attribute, else und."""
    lang = F.regexp_extract(html, r"(?is)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", 1)
    return F.coalesce(F.nullif(F.lower(F.split_part(lang, F.lit("-"), F.lit(1))), F.lit("")), F.lit("und"))


class _Markdown(HTMLParser):
    """Events of the page become Markdown: an article if there is one, else the body."""

    def __init__(self, links: bool, images: bool):
        super().__init__(convert_charrefs=True)
        self.links, self.images = links, images
        self.out: list[str] = []
        self.skip: list[str] = []
        self.lists: list[list] = []
        self.href: list[str | None] = []
        self.pre = 0
        self.row: list[str] | None = None
        self.rows = 0

    def block(self) -> None:
        self.out.append("\n\n")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SKIPPED and tag not in VOID:
            self.skip.append(tag)
        if self.skip:
            return
        a = dict(attrs)
        if re.fullmatch(r"h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.block()
        elif tag == "li":
            if self.lists:
                self.lists[-1][1] += 1
            mark = f"{self.lists[-1][1]}." if self.lists and self.lists[-1][0] == "ol" else "-"
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + mark + " ")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("_")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a":
            self.href.append(a.get("href"))
            if self.links and a.get("href"):
                self.out.append("[")
        elif tag == "img" and self.images:
            self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag == "table":
            self.rows = 0
            self.block()
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.out.append("\x00")
        elif tag in BLOCKS:
            self.block()

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
            return
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.block()
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("_")
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a" and self.href:
            href = self.href.pop()
            if self.links and href:
                self.out.append(f"]({href})")
        elif tag in ("td", "th") and self.row is not None:
            cell = ""
            while self.out and self.out[-1] != "\x00":
                cell = self.out.pop() + cell
            if self.out:
                self.out.pop()
            self.row.append(" ".join(cell.split()).replace("|", "\\|"))
        elif tag == "tr" and self.row is not None:
            self.out.append("| " + " | ".join(self.row) + " |\n")
            if not self.rows:
                self.out.append("|" + " --- |" * len(self.row) + "\n")
            self.rows, self.row = self.rows + 1, None
        elif re.fullmatch(r"h[1-6]", tag) or tag in BLOCKS:
            self.block()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def _article(html: str) -> str:
    for name in ("article", "main", "body"):
        m = re.search(rf"(?is)<{name}[\s>].*</{name}>", html)
        if m:
            return m.group()
    return html


def to_markdown(html: str | None, links: bool = True, images: bool = True) -> str:
    """Markdown of a page's article; null and empty pages give an empty text."""
    if not html:
        return ""
    p = _Markdown(links, images)
    p.feed(_article(html))
    p.close()
    text = re.sub(r"[ \t]+\n", "\n", "".join(p.out).replace("\x00", ""))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def markdown(html: Column | str, links: bool = True, images: bool = True) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([to_markdown(x if isinstance(x, str) else None, links, images) for x in b])

    return run(html)
