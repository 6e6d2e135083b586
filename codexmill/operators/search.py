"""Full-text search over folded texts: hits, their chapters, snippets, pages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexmill.functions import text as T

RADIUS, LIMIT = 36, (20, 100)


def hits(texts: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """(key, offset): every occurrence, overlapping ones included, in code points; width and case are folded.

    The text is split in front of each occurrence, so only books with hits make rows, as many as there are hits."""
    q = query.translate(str.maketrans(*T.fold_map()))
    if not q:
        return texts.select(key, F.lit(0).cast("long").alias("offset")).where("false")
    folded = T.fold(F.col(text))
    parts = F.split(folded, f"(?={_java_quote(q)})", -1)
    sizes = F.transform(parts, lambda p: F.length(p).cast("long"))
    rows = texts.where(folded.contains(q)).select(key, folded.startswith(q).alias("at_start"), F.posexplode(sizes).alias("i", "n"))
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return rows.where("i > 0 or at_start").select(key, "offset")


def _java_quote(q: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}&~#\-])", r"\\\1", q)


def in_chapters(found: DataFrame, chapters: DataFrame, key: str) -> DataFrame:
    """Hits with the chapter that begins last at or before them; before the first chapter, the first; without chapters 1.

    As-of join by union and a window over the book, one shuffle."""
    h = found.select(key, "offset", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("idx"))
    c = chapters.select(key, F.col("char_offset").alias("offset"), F.lit(0).alias("kind"), "idx")
    w = Window.partitionBy(key).orderBy("offset", "kind", "idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = h.unionByName(c).withColumns({"at": F.last("idx", True).over(w), "first": F.min("idx").over(Window.partitionBy(key))})
    return rows.where("kind = 1").select(key, "offset", F.coalesce("at", "first", F.lit(1)).alias("chapter_idx"))


def snippets(found: DataFrame, texts: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """Hits with the text around them: RADIUS characters on both sides, white space single, '...' where it goes on."""
    per_book = found.groupBy(key).agg(F.collect_list("offset").alias("offsets"))
    rows = texts.select(key, F.col(text).alias("_t")).join(per_book, key).select(key, "_t", F.explode("offsets").alias("offset"))
    lo = F.greatest(F.col("offset") - RADIUS, F.lit(0))
    hi = F.least(F.col("offset") + length + RADIUS, F.length("_t").cast("long"))
    body = T.btrim(F.regexp_replace(F.substring("_t", (lo + 1).cast("int"), (hi - lo).cast("int")), f"{T.WHITE_CLASS}+", " "))
    return rows.select(key, "offset", F.concat(F.when(lo > 0, "...").otherwise(""), body, F.when(hi < F.length("_t"), "...").otherwise("")).alias("snippet"))


def page(found: DataFrame, key: str, start: int, limit: int) -> DataFrame:
    """Per book: hits from an offset on, `limit` of them (a page), with total and the offset of the next page."""
    limit = min(max(limit, LIMIT[0]), LIMIT[1])
    totals = found.groupBy(key).agg(F.count("*").alias("total"))
    w = Window.partitionBy(key).orderBy("offset")
    rows = found.where(F.col("offset") >= start).withColumns({"n": F.row_number().over(w).cast("long"), "next_from": F.lead("offset").over(w)}).where(F.col("n") <= limit)
    rows = rows.withColumn("next_from", F.max(F.when(F.col("n") == limit, F.col("next_from"))).over(Window.partitionBy(key)))
    return rows.join(totals, key).select(key, "offset", "n", "total", "next_from")
