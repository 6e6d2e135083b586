"""Column expressions for text: Unicode trimming, folding, hashing, normalising. No Python runs on rows."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters with the White_Space property, which trimming and splitting heed.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE_CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITE) + "]"
#: Marks behind which no white space stays before a Han character.
TIGHT = "，。！？；：、「」『』（）《》…—"


def btrim(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(c, F.lit(WHITE))


@lru_cache(maxsize=1)
def fold_map() -> tuple[str, str]:
    """(from, to) of a one-to-one folding: width first, then simple lower case."""
    src, dst = [], []
    for cp in range(0x20, 0x110000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        d = unicodedata.decomposition(ch)
        to = chr(int(d.split()[1], 16)) if d.startswith(("<wide>", "<narrow>")) and len(d.split()) == 2 else ch
        low = "i" if to == "\u0130" else to.lower()
        to = low if len(low) == 1 else to
        if to != ch:
            src.append(ch)
            dst.append(to)
    return "".join(src), "".join(dst)


def fold(c: Column) -> Column:
    """Text for searching: width and case folded, each character to one character, so offsets stay."""
    return F.translate(c, *fold_map())


def non_space(c: Column) -> Column:
    """Number of characters that are no white space."""
    return F.length(F.regexp_replace(c, WHITE_CLASS, ""))


def normal_export(c: Column, replace: list[tuple[str, str]] | None = None) -> Column:
    """Marks and spacing of a paragraph for export: literal replacements, ellipses, repeated marks, half-width marks behind Han characters, runs of spaces."""
    for a, b in replace or []:
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.regexp_replace(c, "[.。．·]{3,}|…{3,}", "……")
    c = F.regexp_replace(c, "([！？~～—])\\1{2,}", "$1")
    for half, full in ((",", "，"), (";", "；"), (":", "："), ("!", "！"), ("\\?", "？")):
        c = F.regexp_replace(c, f"(?<=\\p{{IsHan}}){half}", full)
    return btrim(spaces_export(c))


def spaces_export(c: Column) -> Column:
    """Runs of white space: none between Han characters (or behind their punctuation) and Han, else one space."""
    c = F.regexp_replace(c, f"(?<=[\\p{{IsHan}}{TIGHT}]){WHITE_CLASS}+(?=\\p{{IsHan}})", "")
    return btrim(F.regexp_replace(c, f"{WHITE_CLASS}+", " "))


def edge_key(c: Column) -> Column:
    """Form in which first and last lines are compared: no white space, numbers as '#'."""
    return F.regexp_replace(F.regexp_replace(c, WHITE_CLASS, ""), "[0-9零〇一二三四五六七八九十百千万]+", "#")


def strip_tags(c: Column) -> Column:
    """Without HTML tags of one line."""
    return F.regexp_replace(c, "<[^<>\\r\\n]*>", "")


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a hash of a text's UTF-8 bytes, as a long."""
    codes = F.transform(F.sequence(F.lit(0), F.octet_length(c) - 1), lambda i: F.conv(F.substring(F.hex(F.encode(c, "UTF-8")), i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    codes = F.when(F.length(c) > 0, codes).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * 16777619) % 4294967296)


def chapter_id(idx: Column) -> Column:
    return F.format_string("chapter-%04d", idx)


def safe_component(c: Column) -> Column:
    """A text as part of a path: control characters and reserved signs become '_'."""
    s = btrim(F.regexp_replace(c, '[\\x00-\\x1f\\x7f/\\\\:*?"<>|]', "_"))
    return F.when(s == "", "_").otherwise(s)


def xml_text(c: Column) -> Column:
    """Escaped for XML, without code points that XML forbids."""
    c = F.regexp_replace(c, "[^\\t\\n\\r\\x20-\\x{d7ff}\\x{e000}-\\x{fffd}\\x{10000}-\\x{10ffff}]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def byte_offset(text: Column, chars: Column) -> Column:
    """Offset in UTF-8 bytes of an offset in code points."""
    return F.octet_length(F.substring(text, F.lit(1), chars))


def filename_meta(name: Column) -> tuple[Column, Column]:
    """(title, author) of a file name, split at the last ' - '."""
    stem = F.regexp_replace(name, "\\.[^./]+\\z", "")
    has = stem.contains(" - ")
    return F.when(has, btrim(F.regexp_extract(stem, "(?s)^(.*) - (.*)\\z", 1))).otherwise(btrim(stem)), F.when(has, btrim(F.regexp_extract(stem, "(?s)^(.*) - (.*)\\z", 2))).otherwise(F.lit(""))


def chapter_number(title: Column) -> Column:
    """The number in a chapter's title: ASCII digits, or Chinese numerals added up unit by unit (十, 百, 千, 万; a unit without a digit in front, or behind a zero, counts once); null without one. Chinese zero is none."""
    t = btrim(title)
    numeral = "([0-9零〇一二三四五六七八九十百千万]+)"
    run = F.when(F.lower(t).startswith("chapter"), F.regexp_extract(t, f"^(?i:chapter)[ \\t]*{numeral}", 1)).otherwise(F.regexp_extract(t, f"^第?[ \\t\\u3000]*「?『?【?〈?\\[?（?\\(?{numeral}", 1))
    digits = F.create_map(*[x for i, c in enumerate("零一二三四五六七八九") for x in (F.lit(c), F.lit(i).cast("long"))], F.lit("〇"), F.lit(0).cast("long"))
    units = F.create_map(*[x for c, n in (("十", 10), ("百", 100), ("千", 1000), ("万", 10000)) for x in (F.lit(c), F.lit(n).cast("long"))])
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("digit"), F.lit(True).alias("alone"))

    def step(a, ch):
        d, u = digits[ch], units[ch]
        one = F.when((a["digit"] == 0) & a["alone"], F.lit(1).cast("long")).otherwise(a["digit"])
        return F.when(u.isNotNull(), F.struct((a["total"] + one * u).alias("total"), F.lit(0).cast("long").alias("digit"), F.lit(False).alias("alone"))).otherwise(F.struct(a["total"].alias("total"), F.coalesce(d, F.lit(0).cast("long")).alias("digit"), (d == 0).alias("alone")))

    han = F.aggregate(F.split(run, "(?<=.)(?=.)"), start, step, lambda a: a["total"] + a["digit"])
    return F.when(run == "", None).when(run.rlike("^[0-9]+\\z"), run.try_cast("long")).when(~run.rlike("[0-9]") & (han > 0), han)


def cover(title: Column, author: Column) -> tuple[Column, Column]:
    """(number of the palette's colour, label) of a book without a cover."""
    title, author = F.coalesce(title, F.lit("")), F.coalesce(author, F.lit(""))
    seed = btrim(F.concat(title, F.lit("\0"), author))
    seed = F.when(seed.isin("\0", ""), "zreader").otherwise(seed)
    return fnv1a(seed) % 8, F.coalesce(F.nullif(F.upper(F.substring(btrim(title), 1, 1)), F.lit("")), F.lit("书"))
