"""Text similarity and HTML to text, as pandas functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

KNOWN_PAIRS, KNOWN_CHARS = 1 << 15, 400  # pairs that a task remembers, and how long they are at most


def remembered() -> Callable[[str, str], float]:
    """Ratcliff-Obershelp similarity of two texts, in the given order (it isn't symmetric). Short pairs, which often come again, are remembered."""
    plain = lambda x, y: SequenceMatcher(None, x, y).ratio()
    known = lru_cache(KNOWN_PAIRS)(plain)
    return lambda x, y: (known if len(x) + len(y) <= KNOWN_CHARS else plain)(x, y)


@F.pandas_udf(DoubleType())
def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """``remembered`` of two columns; nulls are empty."""
    score = remembered()
    for a, b in batches:
        yield pd.Series([score(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


class VisibleText(HTMLParser):
    HIDDEN = {"script", "style"}

    def __init__(self):
        super().__init__()
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.HIDDEN

    def handle_endtag(self, tag):
        self.depth = max(0, self.depth - (tag in self.HIDDEN))

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.parts.append(data.strip())


def visible_text(html: str) -> str:
    parser = VisibleText()
    parser.feed(html)
    return "\n".join(parser.parts)


@F.udf(StringType(), useArrow=False)
def html_text(html: str | None) -> str | None:
    """Pieces of visible text, one a line; scripts and styles are left out; null stays null. Spark sends pages in
    batches of 100, where Arrow's would hold 10,000 at once."""
    return None if html is None else visible_text(html)
