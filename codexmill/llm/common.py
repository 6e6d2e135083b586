"""Helpers shared by the text operators: code points, site keys, latest rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codexmill.session import table


def code_points(text: str) -> np.ndarray:
    """Code points of a text as uint32; lone surrogates survive."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def book_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each book id with its folder; rescans and plain copies collapse (the folder never changes)."""
    return table(spark, sf_dir, "books").where("id is not null").groupBy(F.col("id").alias("book_id")).agg(F.max("folder_id").alias("folder_id"))


def latest_books(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """The latest scan of each book id (ties: by file_mtime), with the columns asked for."""
    b = table(spark, sf_dir, "books").where("id is not null")
    best = F.max_by(F.struct(*cols), F.struct("scanned_at", "file_mtime"))
    return b.groupBy(F.col("id").alias("book_id")).agg(best.alias("b")).select("book_id", *[F.col(f"b.{c}").alias(c) for c in cols])


__all__ = ["F", "Window", "book_sites", "code_points", "latest_books", "table"]
