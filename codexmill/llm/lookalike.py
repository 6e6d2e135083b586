"""Problem 3: text that looks the same but differs in its characters.

Method: the texts of a batch are exploded to positioned code points (flat arrays of code point and text number); a
broadcast mapping of bounded size (Unicode's compatibility decompositions, invisible characters, kinds of space and
look-alike letters) is joined to them by code point; combining marks are ordered by their class, the sequences are
recomposed and the strings rebuilt. Texts compare equal if their rebuilt strings (skeletons) do. Rows are not
exploded in a shuffle, since a text's code points never leave its batch.

The operator's result is one row for each text with its class (p3_classes); p3_found expands the classes of more than
one string to pairs, as TESTDATA.md asks: strings first, then their books, hot strings split over tasks.

Defined results: null stays null and is never a case; an empty text stays empty; repeated rows of a book collapse;
equal strings are no pair, whatever their number; columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexmill.llm.common import code_points, table
from codexmill.operators.skew import hot_join, sized_join
from codexmill.session import materialise, texts

# Letters of other scripts and the Latin letters they look like.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮԌԚԜҺӀаеѕіјорсухһԁԛԝӏԍүк", "ABESIJKMHOPCTYXYGQWHIaesijopcyxhdqwlgyk"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳοανικρυϲγ", "ABEZHIKMNOPTYXCjoavikpucy"))
ARMENIAN = dict(zip("ՍՕՏԼօսհոցզյ", "UOSLouhngqj"))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᎻᏆᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEHIJKLMPRSTVWZ"))
LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"))
COPTIC = dict(zip("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "HIKMNOPCTYXopc"))
OTHER = {"ı": "i", "ȷ": "j", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ᴏ": "o", "ᴄ": "c", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s"}
LOOKALIKE = CYRILLIC | GREEK | ARMENIAN | CHEROKEE | LISU | COPTIC | OTHER
#: Letters of the Cyrillic alphabet for words that are mainly Cyrillic.
TO_CYRILLIC = {v: k for k, v in CYRILLIC.items() if k in "АВЕКМНОРСТУХаеорсухк"}


def _invisible(c: int) -> bool:
    ch = chr(c)
    return unicodedata.category(ch) == "Cf" or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF or c in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0)


@lru_cache(maxsize=2)
def mapping(lookalikes: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, length, values, class): the code points that code point c becomes are values[first[c]:first[c] + length[c]].

    Built by rule from the interpreter's Unicode tables; its size is bounded by the number of code points."""
    first = np.arange(sys.maxunicode + 1, dtype=np.int32)
    length = np.ones(sys.maxunicode + 1, dtype=np.uint8)
    values = list(range(sys.maxunicode + 1))
    ccc = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    for c in range(128, sys.maxunicode + 1):
        if 0xD800 <= c <= 0xDFFF:
            continue
        ch = chr(c)
        ccc[c] = unicodedata.combining(ch)
        if _invisible(c):
            length[c] = 0
            continue
        if 0xAC00 <= c <= 0xD7A3:
            continue  # precomposed syllables are composed again anyway
        to = unicodedata.normalize("NFKD", ch)
        if lookalikes:
            to = "".join(LOOKALIKE.get(x, x) for x in to)
        if unicodedata.category(ch) == "Zs":
            to = " "
        if to != ch:
            first[c], length[c] = len(values), len(to)
            values += map(ord, to)
    return first, length, np.array(values, dtype="<u4"), ccc


def rebuild(texts: list[str], maps) -> list[str]:
    """The texts in their consistent form."""
    first, length, values, ccc = maps
    arrays = [code_points(t) for t in texts]
    sizes = np.array([len(a) for a in arrays])
    cp = np.concatenate(arrays) if arrays else np.zeros(0, "<u4")
    doc = np.repeat(np.arange(len(texts)), sizes)
    n = length[cp].astype(np.int64)
    start = np.cumsum(n) - n
    within = np.arange(int(n.sum())) - np.repeat(start, n)
    out = values[np.repeat(first[cp], n) + within]
    odoc = np.repeat(doc, n)
    cls = ccc[out]
    marks = np.flatnonzero(cls)
    if len(marks):  # order the marks of each base by class, stable
        group = np.cumsum((cls == 0) | np.concatenate([[True], odoc[1:] != odoc[:-1]]))
        order = np.lexsort((marks, cls[marks], group[marks]))
        out[marks] = out[marks[order]]
    ends = np.searchsorted(odoc, np.arange(len(texts)), side="right")
    data, at, res = out.astype("<u4").tobytes(), 0, []
    marked = set(odoc[marks].tolist())
    for k, e in enumerate(ends.tolist()):
        s = data[at * 4 : e * 4].decode("utf-32-le", "surrogatepass")
        res.append(unicodedata.normalize("NFC", s) if k in marked or not s.isascii() else s)
        at = e
    return res


def _scripted(text: str, skeleton_free: str) -> str:
    """Readable form: look-alike letters go over to the script that most letters of their word have."""
    import regex

    def word(m):
        w = m.group()
        latin = sum("a" <= c.lower() <= "z" for c in w)
        alike = sum(c in LOOKALIKE for c in w)
        other = len(w) - latin - alike
        if latin and alike and latin >= other:
            return "".join(LOOKALIKE.get(c, c) for c in w)
        if latin and alike + other > latin:
            return "".join(TO_CYRILLIC.get(c, c) for c in w)
        return w

    return regex.sub(r"[\p{Latin}\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}]{2,}", word, skeleton_free)


def keys(df: DataFrame, key: str, text: str, field: str) -> DataFrame:
    """(field, book_id, look, raw): 16-byte hashes of each text's consistent form and of the text itself."""
    maps = df.sparkSession.sparkContext.broadcast(mapping())

    def digest(t: str) -> bytes:
        return hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = b["t"].tolist()
            forms = own.copy()
            odd = [i for i, t in enumerate(own) if not t.isascii()]
            for k in range(0, len(odd), 256):
                for i, s in zip(odd[k : k + 256], rebuild([own[i] for i in odd[k : k + 256]], maps.value)):
                    forms[i] = s
            yield pd.DataFrame({"field": field, "book_id": b["k"], "look": [digest(t) for t in forms], "raw": [digest(t) for t in own]})

    rows = df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInPandas(part, "field string, book_id long, look binary, raw binary")


def strings(rows: DataFrame) -> DataFrame:
    """(field, look, raw, n): the strings of every form that has at least two, with the number of books of each."""
    n = rows.groupBy("field", "look", "raw").agg(F.count("*").alias("n"))
    many = n.groupBy("field", "look").agg(F.count("*").alias("k")).where("k > 1").select("field", "look")
    return n.join(many, ["field", "look"], "left_semi")


def classes(rows: DataFrame) -> DataFrame:
    """(field, book_id, class_id, links): every book's class (the least id that has its form) and the number of books whose text looks the same but is another string. One row for each book and string."""
    rows = materialise(rows.dropDuplicates(["field", "book_id", "look", "raw"]), "looks")
    forms = rows.groupBy("field", "look").agg(F.min("book_id").alias("class_id"), F.count("*").alias("total"))
    each = rows.groupBy("field", "look", "raw").agg(F.count("*").alias("n")).join(forms, ["field", "look"]).select("field", "raw", "class_id", (F.col("total") - F.col("n")).alias("links"))
    return hot_join(each, rows.select("field", "raw", "book_id"), ["field", "raw"], ["book_id"]).select("field", "book_id", "class_id", "links")


def alike(rows: DataFrame) -> DataFrame:
    """Pairs of different books whose texts look the same but are not the same string, the smaller id first.

    Only forms with at least two different strings go on. The strings of one form are paired first and then expanded
    to their books, so that copies of one string, however many, never meet each other; a hot string is split."""
    rows = materialise(rows.dropDuplicates(["field", "book_id", "look", "raw"]), "looks")
    few = strings(rows).select("field", "look", "raw")
    a, b = few.withColumnRenamed("raw", "raw_a"), few.withColumnRenamed("raw", "raw_b")
    pairs = a.join(b, ["field", "look"]).where("raw_a < raw_b").select("field", "raw_a", "raw_b")
    kept = sized_join(rows, few.select("field", "raw"), ["field", "raw"], "left_semi").select("field", "raw", "book_id")
    left = hot_join(pairs, kept.select("field", F.col("raw").alias("raw_a"), F.col("book_id").alias("x")), ["field", "raw_a"], ["x"]).select("field", "raw_b", "x")
    right = kept.select("field", F.col("raw").alias("raw_b"), F.col("book_id").alias("y"))
    out = left.join(right, ["field", "raw_b"]).where("x <> y")
    return out.select("field", F.least("x", "y").alias("book_id_a"), F.greatest("x", "y").alias("book_id_b")).distinct()


def looks(spark, sf_dir) -> DataFrame:
    """Keys of books.title and epub_books.flat_text."""
    titles = table(spark, sf_dir, "books").select("id", "title").distinct()
    return keys(titles, "id", "title", "title").unionByName(keys(texts(spark, sf_dir, "epub_books"), "book_id", "flat_text", "flat_text"))


def p3_found(spark, sf_dir):
    """(field, book_id_a, book_id_b) of books.title and epub_books.flat_text."""
    return alike(looks(spark, sf_dir))


def p3_classes(spark, sf_dir):
    """(field, book_id, class_id, links) of all titles and texts."""
    return classes(looks(spark, sf_dir))


def p3_normalised(spark, sf_dir):
    """book_id and flat_text in one consistent, readable form."""
    maps = spark.sparkContext.broadcast(mapping(False))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            forms = rebuild(b["flat_text"].fillna("").tolist(), maps.value)
            yield pd.DataFrame({"book_id": b["book_id"], "text": [None if old is None else new if new.isascii() else _scripted(old, new) for old, new in zip(b["flat_text"], forms)]})

    return table(spark, sf_dir, "epub_books").select("book_id", "flat_text").mapInPandas(part, "book_id long, text string")


QUERIES = {"p3_found": p3_found, "p3_classes": p3_classes, "p3_normalised": p3_normalised}
SQL: dict[str, str] = {}
