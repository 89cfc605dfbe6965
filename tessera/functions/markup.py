"""Web pages as Markdown, by one pass over their tags; unclosed tags are closed where they must be."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = {"p", "div", "section", "article", "header", "footer", "nav", "main", "body", "ul", "ol", "table", "blockquote", "figure"}
SILENT = {"script", "style", "template", "noscript"}
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}
SCHEMES = re.compile(r"(?:https?:|mailto:|(?![A-Za-z][A-Za-z0-9+.-]*:))", re.I)


class _Renderer(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.title: list[str] = []
        self.lists: list[int] = []
        self.row: list[str] | None = None
        self.rows: list[list[str]] = []
        self.links: list[str | None] = []
        self.silent = self.pre = self.in_title = 0

    def _put(self, text: str) -> None:
        if self.row is not None and self.row:
            self.row[-1] += text
        else:
            self.out.append(text)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SILENT:
            self.silent += 1
        elif tag == "title":
            self.in_title += 1
        elif re.fullmatch("h[1-6]", tag):
            self._put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "br":
            self._put("<br>" if self.row is not None else "\n")
        elif tag == "hr":
            self._put("\n\n---\n\n")
        elif tag == "pre":
            self.pre += 1
            self._put("\n\n```\n")
        elif tag == "table":
            self.rows = []
        elif tag == "tr":
            self._end_row()
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.row.append("")
        elif tag == "li":
            depth = max(len(self.lists) - 1, 0)
            if self.lists and self.lists[-1] >= 0:
                self.lists[-1] += 1
            self._put("\n" + "  " * depth + (f"{self.lists[-1]}. " if self.lists and self.lists[-1] > 0 else "- "))
        elif tag == "a":
            href = dict(attrs).get("href") or ""
            self.links.append(href if href and SCHEMES.match(href) else None)
            self._put("[" if self.links[-1] else "")
        elif tag in MARKS and not self.pre:
            self._put(MARKS[tag])
        elif tag in BLOCKS:
            self._put("\n\n")
        if tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ol" else -1)

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(self.silent - 1, 0)
        elif tag == "title":
            self.in_title = max(self.in_title - 1, 0)
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self._put("\n```\n\n")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self._put("\n\n")
        elif tag == "a" and self.links:
            href = self.links.pop()
            self._put(f"]({href})" if href else "")
        elif tag == "tr":
            self._end_row()
        elif tag == "table":
            self._end_table()
        elif tag in MARKS and not self.pre:
            self._put(MARKS[tag])
        elif tag in BLOCKS or re.fullmatch("h[1-6]", tag):
            self._put("\n\n")

    def _end_row(self) -> None:
        if self.row:
            self.rows.append([re.sub(r"\s+", " ", c).strip().replace("|", r"\|") for c in self.row])
        self.row = None

    def _end_table(self) -> None:
        self._end_row()
        if self.rows:
            width = max(map(len, self.rows))
            rows = [[*r, *[""] * (width - len(r))] for r in self.rows]
            lines = ["| " + " | ".join(r) + " |" for r in rows]
            self.out.append("\n\n" + "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]) + "\n\n")
        self.rows = []

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        if self.in_title:
            self.title.append(data)
        elif self.pre:
            self._put(data)
        else:
            self._put(re.sub(r"([\\*_])", r"\\\1", re.sub(r"\s+", " ", data)))


def render(html: str) -> tuple[str, str]:
    """Title and Markdown. Scripts and styles go, only web, mail and relative links stay links."""
    r = _Renderer()
    r.feed(html)
    r.close()
    r._end_table()
    text = re.sub(r"[ \t]+(?=\n|$)|(?<=\n) (?=\S)", "", "".join(r.out))
    return re.sub(r"\s+", " ", "".join(r.title)).strip(), re.sub(r"\n{3,}", "\n\n", text).strip()


def to_markdown(pages: DataFrame) -> DataFrame:
    """``pages`` with title and text in place of html. A null page has a null text."""

    @F.pandas_udf("struct<title:string,text:string>")
    def convert(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if x is None else render(x) for x in html], columns=["title", "text"], dtype=object)

    return pages.withColumn("__m", convert("html")).select(*[c for c in pages.columns if c not in ("html", "title", "text")], "__m.title", "__m.text")
