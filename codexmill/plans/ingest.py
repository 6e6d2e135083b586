"""Source queries: decoding, flattening, round trips of containers, over whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from codexmill.functions import text as T
from codexmill.session import table
from codexmill.sources import decode as D
from codexmill.sources import epub, mobi, pdf
from codexmill.sources.html import flattened


def html_flatten(spark, d):
    """SRC-31, SRC-32: the books' careless HTML as paragraphs."""
    return table(spark, d, "mobi_books").select("book_id", flattened("html").alias("text"))


def encoding_labels(spark, d):
    """SRC-09: the encoding column's labels in one form."""
    return table(spark, d, "books").select("id", "scanned_at", "path", D.normal_label(F.col("encoding")).alias("encoding")).distinct()


def decoded_texts(spark, d):
    """SRC-04..10: the texts as bytes with a byte order mark (UTF-8, UTF-16 of both orders) or as GB18030, by book, decoded again."""
    e = table(spark, d, "epub_books").select("book_id", "flat_text")

    def encode(k, s):
        forms = (("utf-8-sig", b""), ("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"), ("gb18030", b""), ("gb18030", b""))
        return pd.Series([None if t is None else forms[i % 5][1] + t.replace("\ufffd", "?").encode(forms[i % 5][0], "replace") for i, t in zip(k, s)])

    encode.__annotations__ = {"k": pd.Series, "s": pd.Series, "return": pd.Series}
    as_bytes = F.pandas_udf(encode, "binary")
    return e.select("book_id", D.decoded(as_bytes("book_id", "flat_text")).alias("r")).select("book_id", "r.encoding", F.length("r.text").cast("long").alias("n"))


def epub_round_trip(spark, d):
    """SNK-04..07, SRC-20..23: books written as EPUB archives and read again: chapters and sizes."""
    ch = table(spark, d, "epub_sections").select("book_id", "id", "title", "level", "body").groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("id", "title", "level", "body"))).alias("cs"))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for book, cs in zip(b["book_id"], b["cs"]):
                data = epub.write(f"book {book}", "", [(c["title"] or "", max(int(c["level"] or 1) - 1, 0), c["body"] or "") for c in cs])
                got = epub.read(data)
                out.append((book, len(got.chapters), len(got.text), got.title))
            yield pd.DataFrame(out, columns=["book_id", "chapters", "chars", "title"])

    return ch.mapInPandas(part, "book_id long, chapters long, chars long, title string")


def mobi_round_trip(spark, d):
    """SRC-25..30: books written as compressed MOBI files and read again."""
    rows = table(spark, d, "mobi_books").where("html is not null").select("book_id", "html", "title", "author")

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for book, source, title, author in zip(b["book_id"], b["html"], b["title"], b["author"]):
                raw = mobi.write(title or "", author or "", source)
                head, *recs = mobi.records(raw)
                got = mobi.read(raw)
                out.append((book, got["title"], got["author"], got["encoding"], hashlib.sha256(b"".join(map(mobi.expand, recs))).hexdigest()))
            yield pd.DataFrame(out, columns=["book_id", "title", "author", "encoding", "h"])

    return rows.mapInPandas(part, "book_id long, title string, author string, encoding string, h string")


def pdf_round_trip(spark, d, per_page: int = 40):
    """SRC-11..19: texts set as PDF files, forty lines a page, and read again: pages, metadata, and the lines that came back."""
    rows = table(spark, d, "pdf_texts").where("text is not null and text <> ''").select("book_id", "title", "author", "text")

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for book, title, author, text in zip(b["book_id"], b["title"], b["author"], b["text"]):
                lines = [f"{i} {s}" for i, line in enumerate(text.split("\n")) if (s := " ".join(line.split()))]
                got = pdf.read(pdf.write(title or "", author or "", [lines[i : i + per_page] for i in range(0, len(lines), per_page)]))
                out.append((book, got["title"], got["author"], got["pages"], len(got["text"].split("\n\n")), hashlib.sha256(" ".join(got["text"].split()).encode()).hexdigest()))
            yield pd.DataFrame(out, columns=["book_id", "title", "author", "pages", "lines", "h"])

    return rows.mapInPandas(part, "book_id long, title string, author string, pages long, lines long, h string")


def xml_bodies(spark, d):
    """SNK-06, SNK-07: chapter bodies as escaped paragraphs, the title's own paragraph left out."""
    s = table(spark, d, "epub_sections")
    ps = F.filter(F.transform(F.split("body", "\n\n"), lambda p: T.btrim(p)), lambda p: p != "")
    ps = F.when(F.element_at(F.concat(ps, F.array(F.lit(""))), 1) == T.btrim(F.col("title")), F.slice(ps, 2, F.greatest(F.size(ps), F.lit(1)))).otherwise(ps)
    return s.select("id", F.size(ps).alias("n"), F.sha2(F.array_join(F.transform(ps, lambda p: F.concat(F.lit("<p>"), T.xml_text(p), F.lit("</p>"))), ""), 256).alias("h"))


def safe_names(spark, d):
    """STRF-07, STRF-10: file names to metadata and safe path components."""
    b = table(spark, d, "books").select("id", F.concat(F.col("title"), F.lit(" - "), F.coalesce("author", F.lit("x/y:z")), F.lit(".txt")).alias("file")).distinct()
    t, a = T.filename_meta(F.col("file"))
    return b.select("id", T.safe_component(t).alias("title"), T.safe_component(a).alias("author"))


_N = [html_flatten, encoding_labels, decoded_texts, epub_round_trip, mobi_round_trip, pdf_round_trip, xml_bodies, safe_names]
QUERIES = {f.__name__: f for f in _N}
_W = T.WHITE.replace("'", "''")
_SAFE = lambda x: f"coalesce(nullif(trim(regexp_replace({x}, '[\\x00-\\x1f\\x7f/\\\\:*?\"<>|]', '_', 'g'), '{_W}'), ''), '_')"
_WC = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in T.WHITE) + "\\x1c-\\x1f]"
SQL = {
    "mobi_round_trip": f"select book_id, trim(coalesce(title, ''), '{_W}') title, trim(coalesce(author, ''), '{_W}') author, 'utf-8' encoding, sha256(html) h from mobi_books where html is not null",
    "pdf_round_trip": f"with l as (select book_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 i, trim(regexp_replace(unnest(string_split(text, chr(10))), '{_WC}+', ' ', 'g')) s from pdf_texts where text <> ''), j as (select book_id, count(*) lines, string_agg(i || ' ' || s, ' ' order by i) as body from l where s <> '' group by 1) select p.book_id, trim(coalesce(title, ''), '{_W}') title, trim(coalesce(author, ''), '{_W}') author, ceil(lines / 40)::bigint pages, lines, sha256(body) h from pdf_texts p join j on j.book_id = p.book_id",
    "encoding_labels": "select distinct id, scanned_at, path, case lower(trim(encoding)) when 'gb-18030' then 'gb18030' when 'gbk' then 'gb18030' when 'gb2312' then 'gb18030' when 'windows-1252' then 'cp1252' when 'iso-8859-1' then 'cp1252' when 'utf8' then 'utf-8' else lower(trim(encoding)) end encoding from books",
    "xml_bodies": f"with p as (select id, trim(title, '{_W}') t, list_filter(list_transform(string_split(body, chr(10) || chr(10)), lambda x: trim(x, '{_W}')), lambda x: x <> '') ps from epub_sections), q as (select id, case when len(ps) > 0 and ps[1] = t then ps[2:] else ps end ps from p) select id, len(ps)::int n, sha256(array_to_string(list_transform(ps, lambda x: '<p>' || replace(replace(replace(replace(replace(regexp_replace(x, '[^\\t\\n\\r\\x{{20}}-\\x{{d7ff}}\\x{{e000}}-\\x{{fffd}}\\x{{10000}}-\\x{{10ffff}}]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&#34;'), chr(39), '&#39;') || '</p>'), '')) h from q",
    "safe_names": f"with f as (select distinct id, title || ' - ' || coalesce(author, 'x/y:z') as f from books) select id, {_SAFE(f'''trim(regexp_extract(f, '(?s)^(.*) - (.*)$', 1), '{_W}')''')} title, {_SAFE(f'''trim(regexp_extract(f, '(?s)^(.*) - (.*)$', 2), '{_W}')''')} author from f",
    "decoded_texts": "select book_id, case book_id % 5 when 0 then 'utf-8' when 1 then 'utf-16le' when 2 then 'utf-16be' else case when length(flat_text) = strlen(flat_text) then 'utf-8' else 'gb18030' end end encoding, length(flat_text) n from epub_books",
}
