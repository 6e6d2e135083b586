"""What the catalog's service does with data: names, versions, validation, selections, positions on screen, uploads, jobs' payloads.

All of it is column expressions and joins; nothing is gathered by key but the few rows of one parent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from codexmill.functions import text as T

# Lengths of names and passwords, of a cover's lines, of an upload's numbering.
NAME_LENGTH, PASSWORD_CHARS, PASSWORD_BYTES = (2, 32), 8, 72
COVER_HAN, COVER_LATIN, COVER_LINES = 5, 12, 4
MOST_COPIES = 1000
PAYLOAD = "folder_ids array<long>, paths array<string>, failures array<string>"


def etag(kind: str, *parts: Column) -> Column:
    """Version of a response: its kind and numbers, in quotes."""
    return F.concat(F.lit(f'"{kind}-'), F.concat_ws("-", *[p.cast("string") for p in parts]), F.lit('"'))


def rfc3339(seconds: Column) -> Column:
    """Seconds since the epoch as a UTC time."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def username(c: Column) -> Column:
    return F.lower(T.btrim(c))


def username_error(name: Column) -> Column:
    """Why a normalised user name is refused; null if it is not."""
    n = F.octet_length(name)
    return F.when((n < NAME_LENGTH[0]) | (n > NAME_LENGTH[1]), "length").when(~name.rlike(r"^[a-z0-9_.-]*\z"), "characters")


def password_error(word: Column) -> Column:
    """Why a password is refused: too few characters, or more bytes than count."""
    return F.when(F.length(word) < PASSWORD_CHARS, "short").when(F.octet_length(word) > PASSWORD_BYTES, "long")


def percent_escape(c: Column) -> Column:
    """UTF-8 bytes outside the unreserved set as %XX."""
    codes = F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit("(..)"), F.lit(1))
    return F.array_join(F.transform(codes, lambda h: F.when(F.conv(h, 16, 10).cast("int").between(0x30, 0x39) | F.conv(h, 16, 10).cast("int").between(0x41, 0x5A) | F.conv(h, 16, 10).cast("int").between(0x61, 0x7A) | h.isin("2D", "2E", "5F", "7E"), F.chr(F.conv(h, 16, 10).cast("int"))).otherwise(F.concat(F.lit("%"), h))), "")


def attachment(name: Column) -> Column:
    """Header value for a file to save, with a plain name for old clients."""
    plain = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]", ""), "^[.\\-_]+", "")
    plain = F.when(plain.rlike(r"^.+\.[^.]*\z"), plain).otherwise(F.lit("export.jsonl"))
    return F.concat(F.lit('attachment; filename="'), plain, F.lit("\"; filename*=UTF-8''"), percent_escape(name))


def cover_lines(title: Column) -> Column:
    """A title in at most four short lines; what is left out shows as an ellipsis."""
    clean = T.btrim(F.coalesce(title, F.lit("")))
    han = clean.rlike("[\\u3400-\\u9fff\\uf900-\\ufaff]")
    blocks = F.slice(F.regexp_extract_all(clean, F.lit(f"(?s).{{1,{COVER_HAN}}}"), F.lit(0)), 1, COVER_LINES)
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def add(a, w):
        both = F.concat(a["line"], F.lit(" "), w)
        over = (a["line"] != "") & (F.length(both) > COVER_LATIN)
        nxt = F.struct(F.when(over, F.concat(a["lines"], F.array(a["line"]))).otherwise(a["lines"]).alias("lines"), F.when(over | (a["line"] == ""), w).otherwise(both).alias("line"))
        return F.when(F.size(a["lines"]) >= COVER_LINES, a).otherwise(nxt)

    latin = F.aggregate(F.split(clean, f"{T.WHITE_CLASS}+"), start, add, lambda a: F.when((a["line"] != "") & (F.size(a["lines"]) < COVER_LINES), F.concat(a["lines"], F.array(a["line"]))).otherwise(a["lines"]))
    lines = F.when(clean == "", F.array().cast("array<string>")).when(han, blocks).otherwise(latin)
    most = F.when(han, COVER_HAN * COVER_LINES).otherwise(COVER_LATIN * COVER_LINES)
    last = lines[COVER_LINES - 1]
    cut = F.concat(F.slice(lines, 1, COVER_LINES - 1), F.array(F.concat(F.substring(last, F.lit(1), F.length(last) - 1), F.lit("…"))))
    return F.when((F.size(lines) == COVER_LINES) & (F.length(clean) > most), cut).otherwise(lines)


def marked(text: Column, term: str) -> Column:
    """Pieces of a text: every second one is a hit of the term, case ignored, hits not overlapping."""
    if not term:
        return F.array(text)
    return F.split(F.regexp_replace(text, f"(?iu)\\Q{term}\\E", "\x01$0\x01"), "\x01", -1)


def clean_path(path: Column) -> Column:
    """An absolute path without '.', '..' and repeated or trailing slashes."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    keep = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(keep, "/"))


def add_folders(folders: DataFrame, paths: DataFrame, now: int) -> DataFrame:
    """Folders with those of the paths that are new, each once, under their clean path."""
    new = paths.select(clean_path(F.col("path")).alias("path")).distinct().join(folders.select("path"), "path", "left_anti")
    return folders.unionByName(new.select(F.lit(None).cast("long").alias("id"), "path", F.lit(now).cast("long").alias("added_at"), F.lit(None).cast("long").alias("last_scan_at")))


def set_tags(book_tags: DataFrame, wanted: DataFrame) -> DataFrame:
    """Tags after those of some books were replaced: wanted has (book_id, names); names are trimmed and distinct, an empty list clears."""
    kept = book_tags.join(wanted.select("book_id").distinct(), "book_id", "left_anti")
    new = wanted.select("book_id", F.explode("names").alias("name")).select("book_id", T.btrim(F.col("name")).alias("name")).where("name <> ''").distinct()
    return kept.select("book_id", "name").unionByName(new)


def toggled(selected: DataFrame, clicked: DataFrame, live: DataFrame) -> DataFrame:
    """Ids selected after some were clicked (each click turns one over), of the books that are still there."""
    both = selected.select("id").distinct().unionByName(clicked.select("id").distinct()).groupBy("id").agg(F.count("*").alias("n")).where("n = 1")
    return both.select("id").join(live.select("id").distinct(), "id", "left_semi")


def nearest(wanted: DataFrame, chapters: DataFrame, key: str) -> DataFrame:
    """(key, at, idx) of the chapter whose beginning lies nearest to each position wanted (ties: the earlier one), by its neighbours before and behind."""
    a = wanted.select(key, F.col("at").alias("pos"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("idx"))
    b = chapters.select(key, F.col("char_offset").alias("pos"), F.lit(0).alias("kind"), "idx")
    here = F.when(F.col("kind") == 0, F.struct("pos", "idx"))
    w = Window.partitionBy(key).orderBy("pos", "kind", "idx")
    rows = a.unionByName(b).withColumns({"prev": F.last(here, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "nxt": F.first(here, True).over(w.rowsBetween(0, Window.unboundedFollowing))}).where("kind = 1")
    far = F.lit(1 << 60)
    d1, d2 = F.coalesce(F.col("pos") - F.col("prev.pos"), far), F.coalesce(F.col("nxt.pos") - F.col("pos"), far)
    return rows.select(key, F.col("pos").alias("at"), F.when(d1 <= d2, F.col("prev.idx")).otherwise(F.col("nxt.idx")).alias("idx")).where("idx is not null")


def visible(items: DataFrame, key: str, order: str, height: str, top: int, bottom: int, overscan: int) -> DataFrame:
    """Rows of each list that are drawn for the stretch [top, bottom) of its height, with some more on both sides; `y` is where a row begins."""
    w = Window.partitionBy(key).orderBy(order)
    rows = items.withColumns({"i": F.row_number().over(w) - 1, "y": F.coalesce(F.sum(height).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    whole = Window.partitionBy(key)
    at = lambda y: F.least(F.sum((F.col("y") + F.col(height) <= y).cast("int")).over(whole), F.count("*").over(whole) - 1)
    rows = rows.withColumns({"a": at(max(0, top)), "b": at(max(0, bottom))})
    return rows.where((F.col("i") >= F.col("a") - overscan) & (F.col("i") <= F.col("b") + overscan)).drop("a", "b")


def upload_name(name: Column) -> Column:
    """A safe file name for an upload: base name, lower-case extension, reserved signs as '_', 'book' if nothing is left."""
    base = F.regexp_extract(T.btrim(name), r"([^/]*)\z", 1)
    ext = F.regexp_extract(base, r"(\.[^.]*)\z", 1)
    stem = F.regexp_replace(T.btrim(F.substring(base, F.lit(1), F.length(base) - F.length(ext))), r"^\.+|\.+\z", "")
    stem = F.when(stem == "", "book").otherwise(stem)
    stem = T.btrim(F.regexp_replace(stem, '[\\x00-\\x1f/\\\\:*?"<>|]', "_"))
    return F.concat(F.when(stem == "", "book").otherwise(stem), F.lower(ext))


def unique_names(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """incoming (folder_id, upload_id, name) with `target`: the name, or its first free form 'stem (i).ext'; null beyond MOST_COPIES.

    Taken numbers of a name come as one array of at most MOST_COPIES + 1; the k-th upload takes the k-th free one."""
    ext = lambda c: F.regexp_extract(c, r"(\.[^.]*)\z", 1)
    stem = lambda c: F.substring(c, F.lit(1), F.length(c) - F.length(ext(c)))
    n = F.col("name")
    up = incoming.select("folder_id", "upload_id", stem(n).alias("stem"), ext(n).alias("ext"))
    old = existing.select("folder_id", ext(n).alias("ext"), stem(n).alias("s"))
    plain = old.select("folder_id", "ext", F.col("s").alias("stem"), F.lit(0).alias("i"))
    numbered = old.where(F.col("s").rlike(r" \([0-9]{1,4}\)\z")).select("folder_id", "ext", F.regexp_extract("s", r"(?s)^(.*) \([0-9]+\)\z", 1).alias("stem"), F.regexp_extract("s", r"\(([0-9]+)\)\z", 1).try_cast("int").alias("i"))
    key = ["folder_id", "stem", "ext"]
    taken = plain.unionByName(numbered.where((F.col("i") >= 1) & (F.col("i") <= MOST_COPIES))).groupBy(*key).agg(F.collect_set("i").alias("taken"))
    rows = up.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("upload_id"))).join(taken, key, "left")
    free = F.array_except(F.sequence(F.lit(0), F.lit(MOST_COPIES)), F.coalesce("taken", F.array().cast("array<int>")))
    i = F.try_element_at(free, F.col("k"))
    return rows.select("folder_id", "upload_id", F.when(i == 0, F.concat("stem", "ext")).when(i.isNotNull(), F.concat("stem", F.lit(" ("), i.cast("string"), F.lit(")"), "ext")).alias("target"))


def payload(c: Column) -> Column:
    """A job's payload; what is no such JSON gives nulls."""
    return F.from_json(c, PAYLOAD, {"mode": "PERMISSIVE"})


def create_users(users: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Users with the new ones (username, password_hash, role) whose normalised name is valid and free; of equal names the first by role."""
    named = new.select(username(F.col("username")).alias("username"), "password_hash", "role").where(username_error(F.col("username")).isNull())
    one = named.groupBy("username").agg(F.min(F.struct("role", "password_hash")).alias("u")).join(users.select("username"), "username", "left_anti")
    return users.unionByName(one.select("username", "u.password_hash", "u.role", F.lit(now).cast("long").alias("created_at")))


def with_progress(df: DataFrame, report: Callable[[int], None], name: str = "scan") -> tuple[DataFrame, Callable[[], None]]:
    """df and a function to call after it was run: report gets the number of rows that went through."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n")), lambda: report(int(seen.get["n"]))
