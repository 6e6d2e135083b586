"""Careless HTML to paragraphs: block tags end one, scripts and heads go, references are decoded last."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags that end a paragraph and those whose content goes.
BLOCK = {"p", "div", "br", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "tr", "table", "blockquote", "section", "article", "hr", "center", "mbp:pagebreak", "pre", "dt", "dd", "dl", "td"}
DROP = {"script", "style", "head", "title"}
_TAG = re.compile(r"<(/?)\s*([!?]?[\w:]*)[^<>]*?(/?)>")
_SPACE = re.compile(r"[ \t\r\n]+")


def flatten(source: str) -> str:
    """The paragraphs of a page, each followed by a blank line."""
    paras: list[str] = []
    current: list[str] = []
    hidden = None
    at = 0

    def flush() -> None:
        s = _SPACE.sub(" ", "".join(current)).strip()
        current.clear()
        if s:
            paras.append(s)

    for m in _TAG.finditer(source):
        if hidden is None:
            current.append(source[at : m.start()])
        at = m.end()
        closing, name = bool(m.group(1)), m.group(2).lower()
        if hidden is not None:
            hidden = None if closing and name == hidden else hidden
        elif name in DROP and not closing:
            hidden = None if m.group(3) else name
        elif name in BLOCK:
            flush()
    if hidden is None:
        current.append(source[at:])
    flush()
    return html.unescape("".join(p + "\n\n" for p in paras))


def flattened(column: str) -> Column:
    """Column of HTML to text, in Arrow batches."""

    def run(source):
        return source.map(lambda s: None if s is None else flatten(s))

    run.__annotations__ = {"source": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(F.col(column))
