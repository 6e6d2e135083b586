"""Problem 5: chapters above a size limit are cut into pieces at natural boundaries, with an overlap.

Method: pointer doubling. Every possible end of a piece is joined to its farthest legal successor (the best natural
boundary in the window that the size limit and the overlap leave); squaring the successor table doubles the number of
cuts known in each round, so all greedy cuts of a chapter, however long, come out after log2(pieces) rounds of array
look-ups. Pieces have at most chunk_chars code points; piece k + 1 begins overlap_chars before the end of piece k.

Defined results: a null limit or overlap takes the default option's; an overlap is held below half of the limit; a
limit below 2 counts as 2; chapters without a text (null or missing book) have no pieces; plain duplicate rows
collapse, and of several rows for one idx the earliest offset holds; a repeated book row repeats its pieces; offsets beyond the text end at its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexmill.llm.common import book_sites, code_points, table

# Characters that end a sentence (closing quotes may follow) and that close a quotation.
SENTENCE_END = "。！？!?…．.;；"
CLOSERS = "”’\"'»）)』」］]"


def boundaries(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether a cut before code point p (0..n) is at the end of a paragraph, of a sentence, of a word."""
    n = len(a)
    para, sent, word = (np.zeros(n + 1, dtype=bool) for _ in range(3))
    nl = a == 10
    if n > 1:
        para[1:n] = nl[:-1] & ~nl[1:]
        end = np.isin(a, [ord(c) for c in SENTENCE_END])
        close = np.isin(a, [ord(c) for c in CLOSERS])
        prev_end = end | (close & np.concatenate([[False], end[:-1]]))
        space = np.isin(a, (9, 10, 13, 32, 0xA0, 0x3000))
        wide = np.isin(a, [ord(c) for c in "。！？…．；"])
        full = wide | (close & np.concatenate([[False], wide[:-1]]))
        after_space = np.concatenate([[False], space[:-1]]) & ~space
        before = np.concatenate([[False], prev_end[:-1]])
        # Latin: behind the space that follows the sentence; Han: behind the closing mark itself
        sent[1:n] = (after_space[1:] & before[1:]) | (full[:-1] & ~close[1:] & ~end[1:])
        word[1:n] = after_space[1:] | ((a[1:] >= 0x4E00) & (a[1:] <= 0x9FFF) & (a[:-1] >= 0x3000) & (a[:-1] < 0x4E00))
    return para, sent, word


def successors(a: np.ndarray, limit: int, overlap: int) -> np.ndarray:
    """Of each position e as the end of a piece: the end of the next, which begins at e - overlap."""
    n = len(a)
    pos = np.arange(n + 1)
    start = np.where(pos > 0, np.maximum(pos - overlap, 0), 0)
    far = np.minimum(start + limit, n)
    least = np.maximum(pos + 1, start + limit // 2)  # a boundary in the second half of the window is natural enough
    nxt = far.copy()
    done = far >= n
    for kind in boundaries(a):
        last = np.maximum.accumulate(np.where(kind, pos, -1))[far]
        use = ~done & (last >= least)
        nxt[use] = last[use]
        done |= use
    return nxt


def cuts(a: np.ndarray, limit: int, overlap: int) -> np.ndarray:
    """Ends of the pieces of one chapter, by doubling the successor table."""
    table_ = successors(a, limit, overlap)
    known = table_[:1]
    while known[-1] < len(a):
        known = np.concatenate([known, table_[known]])
        table_ = table_[table_]
    return known[: int(np.searchsorted(known, len(a))) + 1]


def sizes(spark, sf_dir: str) -> DataFrame:
    """One row for each chapter of a book with text: its span and its folder's limit and overlap."""
    o = table(spark, sf_dir, "export_options")
    default = o.where("folder_id is null").agg(F.first("chunk_chars").alias("d_chunk"), F.first("overlap_chars").alias("d_over"))
    own = o.where("folder_id is not null").groupBy("folder_id").agg(F.first("chunk_chars").alias("chunk_chars"), F.first("overlap_chars").alias("overlap_chars"))
    books = table(spark, sf_dir, "epub_books").where("flat_text is not null").groupBy("book_id").agg(F.max(F.length("flat_text")).cast("long").alias("n"))
    ch = table(spark, sf_dir, "chapters").groupBy("book_id", "idx").agg(F.min("char_offset").alias("start"))
    nxt = F.lead("start").over(Window.partitionBy("book_id").orderBy("idx"))
    rows = ch.join(books, "book_id").withColumn("stop", F.coalesce(nxt, F.col("n")))
    # export_options and its default are a fixed table of 33 rows
    rows = rows.join(book_sites(spark, sf_dir), "book_id", "left").join(F.broadcast(own), "folder_id", "left").join(F.broadcast(default))
    limit = F.coalesce("chunk_chars", "d_chunk")
    return rows.select("book_id", "idx", "start", "stop", limit.alias("chunk"), F.coalesce("overlap_chars", "d_over", F.lit(0)).alias("overlap"))


def pieces(spark, sf_dir: str) -> DataFrame:
    """(book_id, idx, piece, char_offset, text) of the oversized chapters; only their books' texts are moved."""
    big = sizes(spark, sf_dir).where("stop - start > chunk")
    spans = big.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("idx", "start", "stop", "chunk", "overlap"))).alias("spans"))
    rows = table(spark, sf_dir, "epub_books").where("flat_text is not null").select("book_id", "flat_text").join(spans, "book_id")

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for book, text, chapters in zip(b["book_id"], b["flat_text"], b["spans"]):
                for s in chapters:
                    chunk = max(int(s["chunk"]), 2)
                    over = min(max(int(s["overlap"]), 0), (chunk - 1) // 2)
                    body = text[s["start"] : s["stop"]]
                    begin = 0
                    for k, e in enumerate(cuts(code_points(body), chunk, over).tolist(), 1):
                        out.append((book, s["idx"], k, s["start"] + begin, body[begin:e]))
                        begin = max(e - over, 0)
            yield pd.DataFrame(out, columns=["book_id", "idx", "piece", "char_offset", "text"])

    return rows.mapInPandas(part, "book_id long, idx long, piece long, char_offset long, text string")


def p5_found(spark, sf_dir):
    """(book_id, idx) of the chapters that had to be cut: those with a second piece, however the offsets lie."""
    return pieces(spark, sf_dir).where("piece = 1").select("book_id", "idx").distinct()


def p5_pieces(spark, sf_dir):
    """The pieces: number, offset in flat_text, text."""
    return pieces(spark, sf_dir)


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces}
SQL = {
    "p5_found": """
with o as (select * from export_options), d as (select chunk_chars c from o where folder_id is null),
b as (select distinct id, folder_id from books),
ch as (select book_id, idx, min(char_offset) s from chapters group by 1, 2),
x as (select ch.book_id, ch.idx, ch.s, coalesce(lead(ch.s) over (partition by ch.book_id order by ch.idx), length(e.flat_text)) t
      from ch join epub_books e on e.book_id = ch.book_id where e.flat_text is not null)
select x.book_id, x.idx from x left join b on b.id = x.book_id left join o on o.folder_id = b.folder_id cross join d
where x.t - x.s > coalesce(o.chunk_chars, d.c)
""",
}
