"""Smaller operators of the library: bookmarks, batch actions, validation, previews, sinks of children, registration in SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.functions import text as T
from codexmill.operators.catalog import READING, add_tags, remove_tags
from codexmill.session import materialise

# Lengths that notes and tags may have.
NOTE, TAG = 500, 32


def split_tags(raw: Column) -> Column:
    """Distinct tags of a text, split at commas of both widths and white space, in order."""
    return F.array_distinct(F.filter(F.split(raw, f"(?:[,，]|{T.WHITE_CLASS})+"), lambda x: x != ""))


def valid_status(c: Column) -> Column:
    """A reading state in its usual form; '' is unread, anything else null."""
    s = F.lower(T.btrim(F.coalesce(c, F.lit(""))))
    return F.when(s == "", "unread").when(s.isin(*READING), s)


def valid_bookmarks(marks: DataFrame, books: DataFrame) -> DataFrame:
    """Bookmarks whose offset lies in the book and whose note is short enough."""
    return marks.join(books.select(F.col("id").alias("book_id"), "char_count"), "book_id").where((F.col("char_offset") >= 0) & (F.col("char_offset") <= F.coalesce("char_count", F.lit(0))) & (F.length(F.coalesce("note", F.lit(""))) <= NOTE)).drop("char_count")


def put_note(marks: DataFrame, mark_id: int, user: str, book: int, note: str) -> DataFrame:
    """A new note on one bookmark of one user and book; others stay."""
    mine = (F.col("id") == mark_id) & (F.col("user_id") == user) & (F.col("book_id") == book)
    return marks.withColumn("note", F.when(mine, F.nullif(F.lit(note.strip()), F.lit(""))).otherwise(F.col("note")))


def percent(offset: Column, total: Column) -> Column:
    """Position in a book in whole percent, between 0 and 100."""
    return F.when(total.isNull() | (total <= 0), 0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), offset / total)) * 100)).cast("int")


def removed_percent(chars_in: Column, chars_out: Column) -> Column:
    return F.when(chars_in > 0, F.round((chars_in - chars_out) / chars_in * 100, 1)).otherwise(F.lit(0.0))


def render(slice_: Column, title: Column) -> Column:
    """Paragraphs of a chapter for display: split at line feeds, trimmed, without the title's own paragraph."""
    ps = F.filter(F.transform(F.split(slice_, "\n+"), T.btrim), lambda p: p != "")
    return F.when((F.size(ps) > 0) & (F.element_at(F.concat(ps, F.array(F.lit(""))), 1) == T.btrim(title)), F.slice(ps, 2, F.greatest(F.size(ps), F.lit(1)))).otherwise(ps)


def preview(stats: DataFrame, records: DataFrame, n: int = 3) -> tuple[DataFrame, DataFrame]:
    """Statistics and the first records of an export (the limit is the feature)."""
    return stats, records.orderBy("id").limit(n)


def batch(action: str, books: DataFrame, book_tags: DataFrame, ids: DataFrame, **arg) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(books, book_tags, failures) after one action on a set of books: tag, untag, status, favorite, delete.

    Ids without a book are failures, with their reason."""
    chosen = ids.select(F.col("book_id").alias("id")).distinct()
    failures = chosen.join(books.select("id"), "id", "left_anti").select("id", F.lit("not found").alias("reason"))
    hit = chosen.withColumn("_hit", F.lit(True))
    if action in ("tag", "untag"):
        known = chosen.join(books.select("id"), "id", "left_semi").select(F.col("id").alias("book_id"))
        book_tags = (add_tags if action == "tag" else remove_tags)(book_tags, known, arg["names"])
    elif action == "delete":
        books = books.join(chosen, "id", "left_anti")
        book_tags = book_tags.join(ids.select("book_id").distinct(), "book_id", "left_anti")
    elif action in ("status", "favorite"):
        col, value = ("reading_status", arg["status"]) if action == "status" else ("favorite", arg["favorite"])
        if action == "status" and value not in READING:
            raise ValueError(f"no reading state: {value}")
        cols = books.columns
        books = books.join(hit, "id", "left").withColumn(col, F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(col))).select(cols)
    else:
        raise ValueError(f"no action: {action}")
    return books, book_tags, failures


BUCKETS = 64


def replace_children(rows: DataFrame, path: str, key: str = "book_id", buckets: int = BUCKETS) -> None:
    """Writes the rows of some books over their old ones. Books share `buckets` folders; only those that hold one of the books are written anew, each at once (dynamic overwrite)."""
    spark = rows.sparkSession
    new = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    try:
        old = spark.read.parquet(path).select(new.columns)
    except AnalysisException:  # the first time
        old = new.where("false")
    touched = new.select("bucket").distinct()
    kept = old.join(F.broadcast(touched), "bucket", "left_semi").join(new.select(key).distinct(), key, "left_anti").select(new.columns)
    full = materialise(kept.unionByName(new), "children")
    full.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def touch(folders: DataFrame, folder: int, now: int) -> DataFrame:
    return folders.withColumn("last_scan_at", F.when(F.col("id") == folder, F.lit(now)).otherwise(F.col("last_scan_at")))


def register(spark: SparkSession) -> None:
    """The engine's functions in SQL: codex_fold and codex_normal (expressions of the engine itself), codex_flatten and codex_decode (Arrow batches), and codex_lines as a table function."""
    from pyspark.sql.functions import udtf

    from codexmill.sources.decode import decode
    from codexmill.sources.epub import EpubSource
    from codexmill.sources.html import flatten

    lit = lambda s: "r'" + s.replace("'", "\\'") + "'"
    a, b = (x.replace("\\", "\\\\").replace("'", "\\'") for x in T.fold_map())
    spark.sql(f"create or replace temporary function codex_fold(s string) returns string return translate(s, '{a}', '{b}')")
    steps = [("[.。．·]{3,}|…{3,}", "……"), ("([！？~～—])\\1{2,}", "$1"), *[(f"(?<=\\p{{IsHan}}){h}", f) for h, f in ((",", "，"), (";", "；"), (":", "："), ("!", "！"), ("\\?", "？"))]]
    steps += [(f"(?<=[\\p{{IsHan}}{T.TIGHT}]){T.WHITE_CLASS}+(?=\\p{{IsHan}})", ""), (f"{T.WHITE_CLASS}+", " "), ("^ | \\z", "")]
    body = "s"
    for pattern, to in steps:
        body = f"regexp_replace({body}, {lit(pattern)}, {lit(to)})"
    spark.sql(f"create or replace temporary function codex_normal(s string) returns string return {body}")

    def flat(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else flatten(x))

    def text(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else decode(bytes(x))[1])

    for name, f in (("codex_flatten", flat), ("codex_decode", text)):
        f.__annotations__ = {"s": pd.Series, "return": pd.Series}
        spark.udf.register(name, F.pandas_udf(f, "string"))

    @udtf(returnType="line_no int, char_offset long, line string")
    class Lines:
        def eval(self, text: str):
            at = 0
            for i, line in enumerate((text or "").split("\n")):
                yield i, at, line
                at += len(line) + 1

    spark.udtf.register("codex_lines", Lines)
    spark.dataSource.register(EpubSource)
