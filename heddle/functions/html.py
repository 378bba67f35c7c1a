"""Visible text of HTML."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements whose text is not shown, and elements that break lines.
HIDDEN = frozenset({"script", "style", "textarea", "mark", "template", "noscript"})
BREAKS = frozenset({"p", "div", "br", "li", "h1", "h2", "h3", "h4", "tr", "section", "article", "nav", "header", "footer", "pre", "ul", "title"})


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in HIDDEN
        if tag in BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in HIDDEN and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def visible(text: str | None) -> str | None:
    if text is None:
        return None
    parser = _Visible()
    parser.feed(text)
    parser.close()
    lines = (" ".join(line.split()) for line in "".join(parser.parts).split("\n"))
    return "\n".join(line for line in lines if line)


def _each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(visible)


def visible_text(col: Column) -> Column:
    return F.pandas_udf(_each, "string")(col)
