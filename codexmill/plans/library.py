"""Queries of the library's smaller operators, with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codexmill.functions import text as T
from codexmill.operators import catalog as C
from codexmill.operators import clean as K
from codexmill.operators import library as L
from codexmill.operators.skew import ranked
from codexmill.session import table, texts


def _books(spark, d):
    return C.current_books(table(spark, d, "books"))


def _marks(spark, d):
    """Bookmarks from the write log: a position every user kept, with notes in the first chapters, some of them too long."""
    p = table(spark, d, "user_progress").distinct()
    return p.select("user_id", "book_id", "char_offset", "chapter_idx", "chapter_offset", F.when(F.col("chapter_idx") == 1, "start").when(F.col("chapter_idx") == 2, F.repeat(F.lit("n"), 501)).when(F.col("chapter_idx") == 3, F.repeat(F.lit("注"), 500)).alias("note"), F.col("updated_at").alias("created_at"))


def bookmarks(spark, d):
    """SRT-06, DML-12, FIL-17: valid bookmarks."""
    m = L.valid_bookmarks(_marks(spark, d), _books(spark, d))
    w = Window.partitionBy("user_id", "book_id").orderBy("char_offset", "created_at", "chapter_idx", "chapter_offset")
    return m.select("user_id", "book_id", "char_offset", "created_at", "note", F.row_number().over(w).cast("long").alias("rank"))


def typed_tags(spark, d):
    """STRF-25, AGG-15: tags typed into one field."""
    b = _books(spark, d)
    return b.select("id", F.array_join(L.split_tags(F.concat_ws(", ", "category", "format", "category", "reading_status")), "|").alias("tags"))


def statuses(spark, d):
    """STRF-28."""
    b = table(spark, d, "books")
    raw = F.when(F.col("id") % 3 == 0, F.upper("reading_status")).when(F.col("id") % 3 == 1, F.concat(F.lit("  "), "reading_status")).otherwise(F.lit("gone"))
    return b.select("id", "scanned_at", "path", L.valid_status(raw).alias("status")).distinct()


def positions_percent(spark, d):
    """FN-12: latest positions in percent of the book."""
    p = C.progress_latest(table(spark, d, "user_progress"))
    b = _books(spark, d).select(F.col("id").alias("book_id"), "char_count")
    return p.join(b, "book_id").select("user_id", "book_id", L.percent(F.col("char_offset"), F.col("char_count")).alias("percent"))


def batch_status(spark, d):
    """DML-14: a state for every favourite and a few ids that are no books."""
    b = _books(spark, d)
    ids = b.where("favorite").select(F.col("id").alias("book_id")).unionByName(b.where("id % 50 = 0").select((-F.col("id")).alias("book_id")))
    books, _, failures = L.batch("status", b, C.tags_of(b)[1], ids, status="paused")
    return books.select("id", F.col("reading_status").alias("what")).unionByName(failures.select("id", F.col("reason").alias("what")))


def batch_delete(spark, d):
    """DML-14: what stays of books and tags."""
    b = _books(spark, d)
    books, tags, _ = L.batch("delete", b, C.tags_of(b)[1], b.where("folder_id = 2").select(F.col("id").alias("book_id")))
    return books.select("id", F.lit("").alias("name")).unionByName(tags.select(F.col("book_id").alias("id"), "name"))


def rendered_chapters(spark, d):
    """STRF-30: paragraphs of every chapter as shown."""
    t = texts(spark, d, "epub_books").select("book_id", F.col("flat_text").alias("text"))
    ch = table(spark, d, "chapters").select("book_id", "idx", "title", "level", "char_offset").distinct()
    s = K.slices(t, ch, "book_id").join(ch.select("book_id", "idx", "title"), ["book_id", "idx"])
    ps = L.render(F.col("slice"), F.col("title"))
    return s.select("book_id", "idx", F.size(ps).alias("n"), F.sha2(F.array_join(ps, "\n"), 256).alias("h"))


def titles_collated(spark, d):
    """SRT-09: titles in the order of Chinese collation (rank in the order; ties by id)."""
    b = _books(spark, d).select("id", "title")
    return ranked(b, F.collate("title", "zh"), "id")


def touched_folders(spark, d):
    """DML-15."""
    return L.touch(table(spark, d, "library_folders"), 2, 1_800_000_000)


def single_chapter_books(spark, d):
    """FIL-13: books whose only chapter has a title that says nothing."""
    ch = table(spark, d, "chapters").distinct()
    one = ch.groupBy("book_id").agg(F.count("*").alias("n"), F.min(T.btrim(F.col("title"))).alias("title"))
    return one.where("n = 1").select("book_id", F.col("title").isin(*K.GENERIC_TITLES).alias("generic"))


_N = [bookmarks, typed_tags, statuses, positions_percent, batch_status, batch_delete, rendered_chapters, titles_collated, touched_folders, single_chapter_books]
QUERIES = {f.__name__: f for f in _N}

_W = T.WHITE.replace("'", "''")
_B = "b as (select * from (select *, row_number() over (partition by id order by scanned_at desc, file_mtime desc, reading_status desc) rn from books) where rn = 1)"
_T = "t as (select distinct id book_id, trim(x) as name from (select id, category x from b union all select id, format x from b) where x is not null and trim(x) <> '')"
_P = "p as (select * from (select *, row_number() over (partition by user_id, book_id order by updated_at desc, char_offset desc, chapter_idx desc, chapter_offset desc) rn from user_progress) where rn = 1)"
SQL = {
    "bookmarks": f"with {_B} select user_id, book_id, m.char_offset, updated_at created_at, case chapter_idx when 1 then 'start' when 3 then repeat('注', 500) end note, row_number() over (partition by user_id, book_id order by m.char_offset, updated_at, chapter_idx, chapter_offset) \"rank\" from (select distinct * from user_progress) m join b on b.id = m.book_id where m.char_offset between 0 and coalesce(b.char_count, 0) and chapter_idx is distinct from 2",
    "typed_tags": f"with {_B} select id, case when category is null or trim(category) in (format, '') then concat_ws('|', format, reading_status) else concat_ws('|', trim(category), format, reading_status) end tags from b",
    "statuses": "select distinct id, scanned_at, path, case when id % 3 = 2 then null else reading_status end status from books",
    "positions_percent": f"with {_B}, {_P} select p.user_id, p.book_id, (case when b.char_count is null or b.char_count <= 0 then 0 else round(greatest(0, least(1, p.char_offset / b.char_count)) * 100) end)::int \"percent\" from p join b on b.id = p.book_id",
    "batch_status": f"with {_B} select id, case when favorite then 'paused' else reading_status end what from b union all select -id, 'not found' from b where id % 50 = 0",
    "batch_delete": f"with {_B}, {_T} select id, '' as name from b where folder_id <> 2 union all select t.book_id, t.name from t join b on b.id = t.book_id where b.folder_id <> 2",
    "rendered_chapters": f"with ch as (select distinct book_id, idx, title, char_offset from chapters), r as (select ch.book_id, idx, ch.title, substring(flat_text, char_offset + 1, greatest(coalesce(lead(char_offset) over (partition by ch.book_id order by idx), length(flat_text)) - char_offset, 0)) s from ch join epub_books e on e.book_id = ch.book_id), p as (select book_id, idx, title, list_filter(list_transform(string_split(s, chr(10)), lambda x: trim(x, '{_W}')), lambda x: x <> '') ps from r), q as (select book_id, idx, case when len(ps) > 0 and ps[1] = trim(title, '{_W}') then ps[2:] else ps end ps from p) select book_id, idx, len(ps)::int n, sha256(array_to_string(ps, chr(10))) h from q",
    "titles_collated": f"with {_B} select id, title, row_number() over (order by title collate zh, id) \"rank\" from b",
    "touched_folders": "select id, path, added_at, case when id = 2 then 1800000000 else last_scan_at end last_scan_at from library_folders",
    "single_chapter_books": f"select book_id, trim(min(title), '{_W}') in ('正文', '全文', '未分章') as generic from (select distinct * from chapters) group by 1 having count(*) = 1",
}
