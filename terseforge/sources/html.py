"""Markup to text in Arrow batches, with the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements after whose only text a blank is added.
_SPACED = frozenset("p br div li h1 h2 h3".split())
_SILENT = frozenset(("script", "style"))


class _Reader(HTMLParser):
    """Collects text; an element with a single text child is followed by a blank where its kind asks for it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[list] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.open:
            self.open[-1][1] += 2
        if tag not in ("br", "hr", "img", "input", "meta", "link"):
            self.open.append([tag, 0])

    def handle_endtag(self, tag: str) -> None:
        while self.open:
            name, children = self.open.pop()
            if name in _SPACED and children == 1:
                self.out.append(" ")
            if name == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.open:
            if self.open[-1][0] in _SILENT:
                return
            self.open[-1][1] += 1
        self.out.append(data)


def markup_to_text(text: str | None) -> str | None:
    """Text of a piece of markup; plain text comes back as it is."""
    if text is None or ("<" not in text and "&" not in text):
        return text
    reader = _Reader()
    reader.feed(text)
    reader.close()
    while reader.open:
        name, children = reader.open.pop()
        if name in _SPACED and children == 1:
            reader.out.append(" ")
    return "".join(reader.out)


def plain_text(c: str | Column) -> Column:
    """The text of a column of markup; null stays null."""
    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(markup_to_text, na_action="ignore").astype(object)

    return run(c)
