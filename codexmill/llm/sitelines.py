"""Problem 6: lines that a site repeats over its texts.

Method: identical texts collapse first: only the first of the copies is read, split into lines and given keys, and every
key is then counted over the clusters of copies, each with the number of a site's records that it stands for (and with
its publication days). A line is a case if it occurs in at least MIN_RECORDS and in at least MIN_SHARE of the site's
records with a non-blank text (the definition of TESTDATA.md, which counts records); clusters and days are reported
beside it by p6_lines. What is found in a cluster is mapped back to all its records at the end.

Two lines are the same if they differ only in numbers, dates, names of persons, case, spacing, and punctuation or
signs at their ends. Names are the words of the author columns, told by 64-bit hashes: an array of them is broadcast
after they were counted; if there are more than NAMES_MAX, each text gets its own names by a join.

Defined results: null or blank texts are no records and have no lines; a null source or folder is no site; a repeated
row counts once, and a record with several texts once; ties at the threshold are cases; chapter headings never are.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexmill.llm.common import book_sites, table
from codexmill.operators.skew import hot_join, sized_join
from codexmill.session import materialise, texts

MIN_RECORDS, MIN_SHARE = 3, 0.1
#: Names that are broadcast at most (8 bytes each); with more, every text gets its own by a join.
NAMES_MAX = 4_000_000

# What chapter headings begin with.
HEADING = re.compile(
    r"^(?:chapter|part|book|volume|section|kapitel|teil|buch|band|abschnitt|chapitre|partie|livre|tome|cap[ií]tulo|parte|libro|tomo|глава|часть|книга|том)\W+(?:#|[ivxlcdm]+\b|one|two|three|the)"
    r"|^第[#一二三四五六七八九十百千零〇两\s]+[章节節回卷部集篇折]"
    r"|^(?:prologue?|epilogue?|épilogue|prólogo|epílogo|prolog|epilog|пролог|эпилог|foreword|preface|vorwort|nachwort|avant-propos|预告|楔子|序章|序言|引子|前言|尾声|后记|番外|终章)\b"
)
_NUMBER = re.compile(r"\d+")
_FORMAT = frozenset(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) == "Cf")
_TOKEN = re.compile(r"(\w+)")
_WORD = re.compile(r"[^\W\d_]+")
_DATE = re.compile(r"#(?:\s*[-./年月]\s*#)+日?")
_NAMES = re.compile(r"@(?:[\s\-'’.·]*@)*")


def name_hash(word: str) -> int:
    """64-bit hash by which a word is known as a name."""
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def name_words(*authors: DataFrame) -> DataFrame:
    """(name): hashes of all words of the author columns given, each once."""
    rows = None
    for a in authors:
        a = a.toDF("a").where("a is not null").distinct()
        rows = a if rows is None else rows.unionByName(a)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = {name_hash(w) for a in b.column(0).to_pylist() for w in _WORD.findall(fold(a))}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(got), pa.int64())], ["name"])

    return rows.mapInArrow(part, "name long").distinct()


def fold(line: str) -> str:
    """Case, width, invisible characters and spacing out of the way."""
    if not line.isascii():
        if not unicodedata.is_normalized("NFKC", line):
            line = unicodedata.normalize("NFKC", line)
        if not _FORMAT.isdisjoint(line):
            line = "".join(c for c in line if c not in _FORMAT)
    return " ".join(line.casefold().split())


class _Tokens(dict):
    """What becomes of each token of a folded line: numbers and names give way to # and @."""

    def __init__(self, names):
        super().__init__()
        self.names = names

    def __missing__(self, w: str) -> str:
        if len(self) > 400_000:
            self.clear()
        s = w
        if any(c.isdigit() for c in w):
            s = _NUMBER.sub("#", w)
        elif len(w) > 1 and _WORD.fullmatch(w) and self.names(name_hash(w)):
            s = "@"
        self[w] = s
        return s


class LineKeys:
    """Keys of lines, with a memory of the words that are names; names are a sorted array or a set of hashes."""

    def __init__(self, names):
        if isinstance(names, np.ndarray):
            array = names

            def known(h: int) -> bool:
                i = int(np.searchsorted(array, h))
                return i < len(array) and int(array[i]) == h

        else:
            known = names.__contains__
        self.token = _Tokens(known).__getitem__

    def key(self, line: str) -> str | None:
        """The line's normal form; None for a blank line, a heading or a line without letters."""
        return self.key_of(_TOKEN.split(fold(line)))

    def key_of(self, parts: list[str]) -> str | None:
        """The same of a folded line that is split at its words (odd places)."""
        out = parts.copy()
        out[1::2] = map(self.token, parts[1::2])
        s = _strip("".join(out))
        if not s or not _WORD.search(s.replace("@", "")):
            return None
        if HEADING.match(s):
            return None
        if "#" in s:
            s = _DATE.sub("#", s)
        return _NAMES.sub("@", s) if "@" in s else s


def _strip(s: str) -> str:
    """The line without punctuation and signs at its ends (numbers and names stay)."""
    i, j = 0, len(s)
    while i < j and not (s[i].isalnum() or s[i] in "#@"):
        i += 1
    while j > i and not (s[j - 1].isalnum() or s[j - 1] in "#@"):
        j -= 1
    return s[i:j]


def _hash(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).digest()


def hashed(df: DataFrame) -> DataFrame:
    """df (with text) and h, the 128-bit hash of the text; rows without a text go."""
    return df.where("text is not null").withColumn("h", F.unhex(F.md5(F.encode("text", "UTF-8"))))


def first_copies(rows: DataFrame, ids: list[str], narrow: DataFrame) -> DataFrame:
    """rows (ids, h, text, ...) without the later copies of a text, each text once (more often only where a row is repeated).

    Texts are not moved: the copies to leave out are found by the hashes and ids in `narrow`, hot hashes split."""
    me = F.struct(*ids)
    multi = narrow.groupBy("h").agg(F.count("*").alias("n"), F.min(me).alias("first")).where("n > 1").select("h", "first")
    later = hot_join(multi, narrow, ["h"], ids).where(me != F.col("first")).select(*ids, "h").distinct()
    return sized_join(rows, later, [*ids, "h"], "left_anti")


def with_names(rows: DataFrame, names: DataFrame, most: int | None = None):
    """(rows, array of name hashes or None): beyond `most` names, rows get a column of the names in their own text instead."""
    spark = rows.sparkSession
    names = materialise(names, "names")
    if names.count() <= (NAMES_MAX if most is None else most):
        return rows.withColumn("names", F.lit(None).cast("array<bigint>")), np.sort(names.toPandas()["name"].to_numpy().astype(np.int64))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                got = {name_hash(w) for w in set(_TOKEN.findall(fold(t))) if len(w) > 1 and _WORD.fullmatch(w)}
                at += [i] * len(got)
                out += got
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(out, pa.int64())], ["h", "name"])

    own = rows.select("h", "text").mapInArrow(words, "h binary, name long").join(names, "name").groupBy("h").agg(F.collect_set("name").alias("names"))
    return rows.join(own, "h", "left").withColumn("names", F.coalesce("names", F.array().cast("array<bigint>"))), None


def keys_for(shared):
    """key functions of rows with their names: one for all where names are shared, else one for each row."""
    common = LineKeys(shared.value) if shared.value is not None else None
    return lambda names: common if common is not None else LineKeys(set(names))


def line_rows(distinct: DataFrame, names: DataFrame, most: int | None = None) -> DataFrame:
    """(h, line_no, key) of each line of distinct texts (h, text) that may be a site's."""
    rows, array = with_names(distinct, names, most)
    shared = distinct.sparkSession.sparkContext.broadcast(array)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = keys_for(shared)
        for b in batches:
            at: list[int] = []
            nos: list[int] = []
            ks: list[bytes] = []
            for i, (t, own) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                key = of(own).key
                for n, line in enumerate(t.split("\n"), 1):
                    k = key(line)
                    if k is not None:
                        at.append(i)
                        nos.append(n)
                        ks.append(_hash(k))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(nos, pa.int64()), pa.array(ks, pa.binary())], ["h", "line_no", "key"])

    return rows.select("h", "text", "names").mapInArrow(part, "h binary, line_no long, key binary")


BLANK = r"[^\s\p{Z}]"


def count_records(lines: DataFrame, rec: DataFrame, titles: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(per_key, sizes): n_records of each (site, key), n_site of each site.

    lines: (h, key) of the clusters of copies; rec: (site, record, h); titles: (site, record, key) of further lines of the
    records. A cluster counts for all its records at once. Records with several texts are counted one by one, and a
    title only where the record's text has not the same line; both are summed before they meet a hot text."""
    pairs = lines.select("h", "key").distinct()
    rec = rec.select("site", "record", "h").distinct()
    texts_of = rec.groupBy("site", "record").agg(F.count("*").alias("n_texts"), F.min("h").alias("h"))
    sizes = texts_of.groupBy("site").agg(F.count("*").alias("n_site"))
    single = texts_of.where("n_texts = 1").select("site", "record", "h")
    several = rec.join(texts_of.where("n_texts > 1").select("site", "record"), ["site", "record"], "left_semi")
    clusters = single.groupBy("site", "h").agg(F.count("*").alias("n"))
    counts = pairs.join(clusters, "h").groupBy("site", "key").agg(F.sum("n").alias("n"))
    one_by_one = several.join(pairs, "h").select("site", "record", "key")
    if titles is not None:
        titles = titles.select("site", "record", "key").distinct()
        extra = titles.join(single, ["site", "record"]).groupBy("site", "key", "h").agg(F.count("*").alias("n"))
        extra = extra.join(pairs, ["h", "key"], "left_anti").groupBy("site", "key").agg(F.sum("n").alias("n"))
        counts = counts.unionByName(extra)
        one_by_one = one_by_one.unionByName(titles.join(several.select("site", "record").distinct(), ["site", "record"], "left_semi"))
    counts = counts.unionByName(one_by_one.distinct().groupBy("site", "key").agg(F.count("*").alias("n")))
    return counts.groupBy("site", "key").agg(F.sum("n").alias("n_records")), sizes


def cases_of(per_key: DataFrame, sizes: DataFrame) -> DataFrame:
    """The keys that are a site's lines."""
    return per_key.where(F.col("n_records") >= MIN_RECORDS).join(sizes, "site").where(F.col("n_records") >= F.col("n_site") * MIN_SHARE)


class Lines:
    """Everything that the queries share: records, lines of distinct texts, lines of titles, and the cases among them."""

    def __init__(self, spark, sf_dir: str, most_names: int | None = None):
        docs = hashed(texts(spark, sf_dir, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").alias("record_id"), "source", F.to_date("published_at").alias("day"), "text"))
        books = hashed(texts(spark, sf_dir, "epub_books").select(F.lit("epub_books").alias("src"), F.col("book_id").alias("record_id"), F.col("flat_text").alias("text")))
        sites = book_sites(spark, sf_dir).where("folder_id is not null").select("book_id", F.concat(F.lit("f:"), F.col("folder_id").cast("string")).alias("site"))
        full = F.col("text").rlike(BLANK) & F.col("record_id").isNotNull()
        own = docs.where(full & F.col("source").isNotNull()).select("src", F.concat(F.lit("d:"), "source").alias("site"), "record_id", "day", "h")
        shelved = books.where(full).select("src", "record_id", "h").join(sites.withColumnRenamed("book_id", "record_id"), "record_id").select("src", "site", "record_id", F.lit(None).cast("date").alias("day"), "h")
        self.rec = materialise(own.unionByName(shelved).withColumn("record", F.col("record_id")).distinct(), "site-records")
        names = name_words(table(spark, sf_dir, "documents").select("author"), table(spark, sf_dir, "books").select("author"))
        rows = docs.where(full & F.col("source").isNotNull()).select("src", "record_id", "h", "text").unionByName(books.where(full).select("src", "record_id", "h", "text"))
        self.lines = materialise(line_rows(first_copies(rows, ["src", "record_id"], self.rec.select("src", "record_id", "h")).select("h", "text"), names, most_names), "site-lines")
        titles = table(spark, sf_dir, "chapters").where("title is not null").select("id", "book_id", F.col("title").alias("text")).distinct().join(sites, "book_id")
        distinct_titles = hashed(titles.select("text").distinct()).select("h", "text")
        title_keys = line_rows(distinct_titles, names, most_names).where("line_no = 1").select("h", "key")
        titles = hashed(titles).select("site", F.col("book_id").alias("record"), F.col("id").alias("record_id"), "h")
        self.titles = materialise(hot_join(title_keys, titles, ["h"], ["record_id"]).select("site", "record", "record_id", "key"), "site-titles")
        self.per_key, sizes = count_records(self.lines, self.rec, self.titles)
        self.cases = materialise(cases_of(self.per_key, sizes), "site-cases")

    def found(self) -> DataFrame:
        """(site, key, src, record_id, line_no): clusters first, then all their records."""
        at = self.lines.join(self.rec.select("site", "h").distinct(), "h")
        keys = self.cases.select("site", "key")
        at = sized_join(at, keys, ["site", "key"], "left_semi")
        rows = hot_join(at, self.rec.select("site", "h", "src", "record_id").distinct(), ["site", "h"], ["src", "record_id"]).select("site", "key", "src", "record_id", "line_no")
        titles = sized_join(self.titles, keys, ["site", "key"], "left_semi").select("site", "key", F.lit("chapters").alias("src"), "record_id", F.lit(1).cast("long").alias("line_no"))
        return rows.unionByName(titles).distinct()


def p6_found(spark, sf_dir):
    """(src, record_id, line_no) of every occurrence of a site's line."""
    return Lines(spark, sf_dir).found().select("src", "record_id", "line_no")


def p6_lines(spark, sf_dir):
    """The sites' lines: an example's place, records, distinct texts and distinct days that have it."""
    x = Lines(spark, sf_dir)
    example = x.found().groupBy("site", "key").agg(F.min(F.struct("src", "record_id", "line_no")).alias("e"))
    keys = x.cases.select("site", "key")
    clusters = sized_join(x.lines.select("h", "key").join(x.rec.select("site", "h").distinct(), "h"), keys, ["site", "key"], "left_semi").select("site", "key", "h")
    titled = sized_join(x.titles, keys, ["site", "key"], "left_semi").join(x.rec.select("site", "record", "h"), ["site", "record"]).select("site", "key", "h")
    n_texts = clusters.unionByName(titled).groupBy("site", "key").agg(F.count_distinct("h").alias("n_texts"))
    days = clusters.distinct().join(x.rec.where("day is not null").select("site", "h", "day").distinct(), ["site", "h"]).groupBy("site", "key").agg(F.count_distinct("day").alias("n_days"))
    out = x.cases.join(example, ["site", "key"]).join(n_texts, ["site", "key"]).join(days, ["site", "key"], "left")
    return out.select(F.substring("site", 3, 999).alias("site"), "e.*", "n_records", "n_texts", F.coalesce("n_days", F.lit(0)).alias("n_days"), "n_site")


def p6_cleaned(spark, sf_dir):
    """(src, record_id, text): documents and books without their site's lines."""
    found = p6_found(spark, sf_dir).where("src <> 'chapters'").groupBy("src", "record_id").agg(F.collect_list("line_no").alias("nos"))
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").alias("record_id"), "text")
    books = table(spark, sf_dir, "epub_books").select(F.lit("epub_books").alias("src"), F.col("book_id").alias("record_id"), F.col("flat_text").alias("text"))
    rows = docs.unionByName(books).join(found, ["src", "record_id"], "left")
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col("nos"), (i + 1).cast("long")))
    return rows.select("src", "record_id", F.when(F.col("nos").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))


QUERIES = {"p6_found": p6_found, "p6_lines": p6_lines, "p6_cleaned": p6_cleaned}
SQL: dict[str, str] = {}
