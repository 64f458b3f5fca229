"""HTML to plain text for feeds and pasted pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BREAKS = frozenset("p br div li h1 h2 h3 h4 tr blockquote pre".split())
SILENT = frozenset("script style noscript".split())


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent = self.linked = 0

    def handle_starttag(self, tag, attrs) -> None:
        if tag in SILENT:
            self.silent += 1
        if tag in BREAKS:
            self.out.append("\n")
        if tag == "a":
            given = dict(attrs)
            classes, href = given.get("class") or "", given.get("href") or ""
            if href.startswith("http") and not ("hashtag" in classes or "mention" in classes):
                self.out.append(f" {href} ")
                self.linked += 1

    def handle_endtag(self, tag) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        if tag == "a":
            self.linked = max(0, self.linked - 1)

    def handle_data(self, data) -> None:
        if not (self.silent or self.linked):
            self.out.append(data)


def plain_text(page: str | None) -> str:
    """Visible text, one line per block; a link shows its address instead of its
    text, unless it is a hashtag or mention.  Null gives an empty text."""
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    lines = (" ".join(line.split()) for line in "".join(reader.out).splitlines())
    return "\n".join(line for line in lines if line)


def _each(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in pages:
        yield series.map(plain_text)


def html_to_text(page: Column | str) -> Column:
    """``plain_text`` of a column, in Arrow batches."""
    return F.pandas_udf(_each, "string")(page)
