"""Bytes to text: byte order marks, ASCII, then strict decoders in a fixed order."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The order in which decoders are tried, and the labels that mean the same.
CHAIN = ("gb18030", "big5")
LABELS = {"gb-18030": "gb18030", "gbk": "gb18030", "gb2312": "gb18030", "windows-1252": "cp1252", "iso-8859-1": "cp1252", "utf8": "utf-8"}


def normal_label(name: Column) -> Column:
    """A charset label in its usual form."""
    low = F.lower(F.trim(name))
    out = low
    for a, b in LABELS.items():
        out = F.when(low == a, b).otherwise(out)
    return out


def garbled(text: str) -> bool:
    """More than one replacement character in a hundred bytes."""
    return text.count("�") * 100 > len(text.encode("utf-8", "replace"))


# Byte pairs of characters that are frequent in GB 2312 (first level) and in Big5 (first level), with marks and letters of their width.
_GB, _BIG5 = re.compile(rb"[\xb0-\xd7][\xa1-\xfe]|[\xa1-\xa9][\xa1-\xfe]"), re.compile(rb"[\xa4-\xc6][\x40-\x7e\xa1-\xfe]|\xa1[\x40-\x7e\xa1-\xfe]")
_FOUR = re.compile(rb"[\x81-\xfe][0-9][\x81-\xfe][0-9]")
_PAIR, _HIGH = re.compile(rb"[\x81-\xfe][\x40-\x7e\x80-\xfe]"), re.compile(rb"[\x80-\xff]+")


def likely(data: bytes) -> str:
    """The most likely charset of bytes that are no UTF-8: Western where high bytes stand alone among ASCII letters, else the Chinese one whose frequent characters make up more of the pairs."""
    runs = _HIGH.findall(data)
    if len(_FOUR.findall(data)) * 4 >= len(runs):
        return "gb18030"
    if sum(len(r) == 1 for r in runs) * 10 >= len(runs) * 8 and sum(map(len, runs)) * 4 < len(data):
        return "cp1252"
    pairs = _PAIR.findall(data)
    gb, big5 = (sum(p.fullmatch(x) is not None for x in pairs) for p in (_GB, _BIG5))
    return "big5" if big5 > gb else "gb18030"


def decode(data: bytes) -> tuple[str, str]:
    """(encoding, text) of a file's bytes; 'utf-8?' with '?' for bad bytes where nothing fits."""
    if not data:
        return "utf-8", ""
    if data.startswith(b"\xef\xbb\xbf"):
        return "utf-8", data[3:].decode("utf-8", "replace")
    for mark, name in ((b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be")):
        if data.startswith(mark):
            text = data[2:].decode(name, "replace")
            if text and not garbled(text):
                return name, text
    if data.isascii():
        return "utf-8", data.decode("ascii")
    try:
        return "utf-8", data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    guess = likely(data)
    for name in (guess, *[x for x in CHAIN if x != guess]):
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            text = data.decode(name, "replace")
            if garbled(text):
                continue
        return name, text
    return "utf-8?", data.decode("utf-8", "one-mark")


codecs.register_error("one-mark", lambda e: ("?", e.end))


def decoded(column) -> Column:
    """Column of bytes to a struct (encoding, text), in Arrow batches."""

    def run(content: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if c is None else decode(bytes(c)) for c in content]
        return pd.DataFrame(rows, columns=["encoding", "text"])

    run.__annotations__ = {"content": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "encoding string, text string")(column)
