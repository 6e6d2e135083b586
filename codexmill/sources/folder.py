"""Folders of books: which files count, reading them by format, chapter sidecars, cleaning rules."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.functions import text as T
from codexmill.operators.clean import Rules
from codexmill.sources import epub, mobi, pdf
from codexmill.sources.decode import decode

# Extensions of books, and the bytes that a file is known by.
EXTENSIONS = ("txt", "epub", "pdf", "mobi", "azw", "azw3")
HEAD = 65_536


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1))


def roots(value: str) -> list[str]:
    """Folders of a list as the environment has it: apart by the system's separator, blanks off, each once."""
    return list(dict.fromkeys(p for x in value.split(os.pathsep) if (p := x.strip())))


def scan(spark: SparkSession, folder: str, paths: list[str] | None = None) -> DataFrame:
    """The supported files at the top of a folder (or the ones named, and no others), dot files left out, with their fingerprints.

    binaryFile splits by file, so a file's bytes are read by one task and never reach the driver."""
    files = spark.read.format("binaryFile").load(folder if paths is None else paths)
    name = F.regexp_extract("path", r"([^/]+)\z", 1)
    ok = extension(F.col("path")).isin(*EXTENSIONS) & ~name.startswith(".")
    return files.where(ok).select("path", name.alias("file"), extension(F.col("path")).alias("format"), F.col("length").alias("size_bytes"), F.unix_timestamp("modificationTime").alias("file_mtime"), F.sha2(F.substring("content", 1, HEAD), 256).alias("file_hash"), "content")


def ingest(files: DataFrame, converters: dict[str, Callable[[bytes], bytes]] | None = None) -> DataFrame:
    """One row for each file: encoding, metadata, text, chapters of EPUB files; an error instead where it cannot be read.

    `converters` has, for a format, a function from a file's bytes to those of an EPUB (an external converter, or optical
    recognition for PDF files without a text layer; sources.convert makes one of a command). It is asked where the
    format's own reader fails. If files have a column `sidecar` (JSON text), its chapters replace the found ones."""
    schema = "path string, file string, format string, size_bytes long, file_mtime long, file_hash string, encoding string, title string, author string, text string, chapters array<struct<title:string,level:int,char_offset:long>>, error string"

    def one(fmt: str, data: bytes) -> dict:
        if fmt == "txt":
            encoding, text = decode(data)
            return {"encoding": encoding, "title": "", "author": "", "text": text}
        if fmt == "epub":
            b = epub.read(data)
            if not b.text.strip():
                raise ValueError("no text")
            return {"encoding": "utf-8", "title": b.title, "author": b.author, "text": b.text, "chapters": [{"title": t, "level": lv, "char_offset": o} for t, lv, o in b.chapters]}
        if fmt == "pdf":
            return {"encoding": "utf-8", **{k: v for k, v in pdf.read(data).items() if k != "pages"}}
        return mobi.read(data)

    def converted(fmt: str, data: bytes) -> dict:
        try:
            return one(fmt, data)
        except Exception:
            if fmt not in (converters or {}):
                raise
            return one("epub", converters[fmt](data))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                row = {"path": r.path, "file": r.file, "format": r.format, "size_bytes": r.size_bytes, "file_mtime": r.file_mtime, "file_hash": r.file_hash, "encoding": None, "title": None, "author": None, "text": None, "chapters": None, "error": None}
                try:
                    row |= converted(r.format, bytes(r.content))
                    side = getattr(r, "sidecar", None)
                    if side:
                        row["chapters"] = [{"title": t, "level": lv, "char_offset": o} for t, lv, o in sidecar_chapters(json.loads(side), row["text"])]
                except Exception as e:  # a file that cannot be read must not end the scan
                    row["error"] = f"{type(e).__name__}: {e}"[:200]
                out.append(row)
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in schema.replace("array<struct<title:string,level:int,char_offset:long>>", "x").split(", ")])

    return files.mapInPandas(part, schema)


def with_sidecars(files: DataFrame, folder: str) -> DataFrame:
    """Files with the text of '<stem>.chapters.json' beside them, where there is one."""
    side = files.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.chapters.json").load(folder)
    side = side.select(F.regexp_replace("path", r"\.chapters\.json\z", "").alias("stem"), F.decode("content", "UTF-8").alias("sidecar"))
    return files.withColumn("stem", F.regexp_replace("path", r"\.[^./]+\z", "")).join(side, "stem", "left").drop("stem")


def with_metadata(rows: DataFrame) -> DataFrame:
    """Title and author from the file's own data, else from its name."""
    t, a = T.filename_meta(F.col("file"))
    return rows.withColumns({"title": F.coalesce(F.nullif(F.trim("title"), F.lit("")), t), "author": F.coalesce(F.nullif(F.trim("author"), F.lit("")), F.nullif(a, F.lit("")))})


def sidecar_chapters(side: dict, text: str) -> list[tuple[str, int, int]]:
    """(title, level, offset) that a sidecar states: by `match`, searched onwards from the last one, or by `char_offset`.

    Entries without a title or a place are errors; the result is in order of the text."""
    out, cursor = [], 0
    for k, e in enumerate(side.get("chapters") or []):
        title = str(e.get("title") or "").strip()
        if not title:
            raise ValueError(f"chapter {k + 1} has no title")
        if e.get("match"):
            at = text.find(e["match"], cursor)
            if at < 0:
                raise ValueError(f"chapter {k + 1}: text not found")
            cursor = at + len(e["match"])
        elif isinstance(e.get("char_offset"), int) and 0 <= e["char_offset"] <= len(text):
            at = e["char_offset"]
        else:
            raise ValueError(f"chapter {k + 1} has no place")
        out.append((title, int(e.get("level") or 0), at))
    return sorted(out, key=lambda x: x[2])


def load_rules(path: str) -> tuple[Rules, str | None]:
    """Cleaning rules with those of a JSON file added, and what was wrong with it; rules read before an error stay."""
    import re

    rules, error = Rules(), None
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        for name, to in (("promo", rules.promo), ("author_notes", rules.notes)):
            for p in data.get(name) or []:
                re.compile(p)
                to.append(p)
        rules.replace += [(a, b) for a, b in data.get("replace") or []]
    except FileNotFoundError:
        pass
    except (OSError, ValueError, re.error) as e:
        error = str(e)
    return rules, error
