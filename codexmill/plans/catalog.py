"""Catalog queries over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codexmill.operators import catalog as C
from codexmill.functions import text as T
from codexmill.operators.skew import ranked
from codexmill.session import table


def _books(spark, d):
    return C.current_books(table(spark, d, "books"))


def list_books(spark, d):
    """FIL-01, SRT-01, DML-03: current rows with defaults filled."""
    b = _books(spark, d)
    b = b.select("id", "folder_id", "title", F.coalesce("author", F.lit("")).alias("author"), F.coalesce("reading_status", F.lit("unread")).alias("reading_status"), F.coalesce("char_count", F.lit(0)).alias("char_count"), "scanned_at")
    return ranked(b, F.desc("scanned_at"), "id")


def books_in_folder(spark, d, folder: int = 2):
    """FIL-02, FIL-19."""
    b = _books(spark, d)
    return (b if folder <= 0 else b.where(F.col("folder_id") == folder)).select("id", "title", "path")


def get_book(spark, d, book: int = 7):
    """FIL-03."""
    return _books(spark, d).where(F.col("id") == book).select("id", "folder_id", "path", "format")


def shelf_search(spark, d, query: str = "river"):
    """FIL-04, JOI-08: substring of title, author, category or a tag."""
    b = _books(spark, d)
    return C.shelf(b, C.tags_of(b)[1], query).select("id", "title")


def shelf_filter(spark, d):
    """FIL-05: state, favourite and tag together."""
    b = _books(spark, d)
    return C.shelf(b, C.tags_of(b)[1], status="reading", favorite=True, tag="epub").select("id", "reading_status")


def tags_for_books(spark, d):
    """JOI-01, JOI-08, AGG-14: the sorted tags of every book."""
    b = _books(spark, d)
    return C.tag_lists(b, C.tags_of(b)[1]).select("id", F.array_join("tags", ",").alias("tags"))


def tag_counts(spark, d):
    """JOI-01, SRT-03."""
    b = _books(spark, d)
    t = C.tags_of(b)[1].groupBy("name").agg(F.count("*").alias("n_books"))
    return ranked(t, C.ascii_lower(F.col("name")), "name")


def tags_added(spark, d):
    """JOI-16, SET-03, DML-05: two tags on every favourite."""
    b = _books(spark, d)
    return C.add_tags(C.tags_of(b)[1], b.where("favorite").select(F.col("id").alias("book_id")), ["shelf", " epub ", "shelf"]).select("book_id", "name")


def tags_removed(spark, d):
    """JOI-04, DML-05."""
    b = _books(spark, d)
    return C.remove_tags(C.tags_of(b)[1], b.where("favorite").select(F.col("id").alias("book_id")), ["epub"])


def folder_counts(spark, d):
    """JOI-06, AGG-04."""
    return C.folder_counts(table(spark, d, "library_folders"), _books(spark, d))


def duplicate_groups(spark, d):
    """AGG-03, SRT-02."""
    return ranked(C.duplicate_groups(_books(spark, d)), F.desc("n"), "file_hash")


def duplicate_members(spark, d):
    """JOI-07, SRT-02."""
    return ranked(C.duplicate_members(_books(spark, d)), F.desc("n"), "file_hash", "title", "id")


def prune_missing(spark, d):
    """JOI-05, SET-02: books that stay when a scan of folder 2 sees EPUB sources only."""
    b = _books(spark, d)
    return C.prune_missing(b, 2, b.where("source_path like '%.epub'").select("path")).select("id", "folder_id")


def delete_folder(spark, d):
    """DML-07: cascade to chapters and positions."""
    b = _books(spark, d)
    latest = C.progress_latest(table(spark, d, "user_progress"))
    f, bb, kids = C.delete_folder(2, table(spark, d, "library_folders"), b, {"chapters": table(spark, d, "chapters").select("id", "book_id").distinct(), "progress": latest})
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return one(f, "folders").unionByName(one(bb, "books")).unionByName(one(kids["chapters"], "chapters")).unionByName(one(kids["progress"], "progress"))


def upsert_rescan(spark, d, now: int = 1_800_000_000):
    """DML-01, SNK-08: a rescan of folder 3 with changed sizes and one new path for each of its books."""
    b = _books(spark, d)
    old = b.where("folder_id = 3")
    seen = old.withColumn("size_bytes", F.col("size_bytes") + 1)
    new = old.withColumn("path", F.concat("path", F.lit(".new")))
    return C.upsert_books(b, seen.unionByName(new), now).select("path", "id", "size_bytes", "favorite", "reading_status", "added_at", "scanned_at")


def metadata_update(spark, d):
    """DML-02: trims, empties and keeps."""
    b = _books(spark, d).select("id", "title", "author", "category")
    ch = b.where("id % 2 = 0").select("id", F.lit("  ").alias("title"), F.lit(" New Author ").alias("author"), F.when(F.col("id") % 4 == 0, F.lit("")).alias("category"))
    return C.update_books(b, ch)


def progress_latest(spark, d):
    """DML-03, FIL-07: a write log folded to the newest position."""
    return C.progress_latest(table(spark, d, "user_progress"))


def progress_map(spark, d):
    """FIL-06: positions of one user in a set of books (semi-join)."""
    p = C.progress_latest(table(spark, d, "user_progress"))
    favs = _books(spark, d).where("favorite").select(F.col("id").alias("book_id"))
    return p.join(favs, "book_id", "left_semi").select("user_id", "book_id", "char_offset")


def _reader(spark, d):
    """The user with the most writes (ties: the smaller id)."""
    return table(spark, d, "user_progress").groupBy("user_id").count().orderBy(F.desc("count"), "user_id").limit(1).select("user_id")


def shelf_recent(spark, d):
    """JOI-03, SRT-10: every book with the busiest user's last position."""
    p = C.progress_latest(table(spark, d, "user_progress")).join(_reader(spark, d), "user_id", "left_semi").select("book_id", F.col("updated_at").alias("read_at"))
    b = _books(spark, d)
    return b.join(p, b.id == p.book_id, "left").select("id", F.coalesce("read_at", F.lit(0)).alias("read_at"), "scanned_at")


def shelf_in_order(spark, d):
    """SRT-10: the same, read last first, then scanned last."""
    return ranked(shelf_recent(spark, d), F.desc("read_at"), F.desc("scanned_at"), "id")


def continue_reading(spark, d):
    """SRT-11: the five books read last (a report of its nature)."""
    return shelf_recent(spark, d).where("read_at > 0").orderBy(F.desc("read_at"), F.desc("scanned_at"), "id").limit(C.CONTINUE_LIMIT).select("id", "read_at")


def at_book_end(spark, d):
    """FIL-11."""
    p = C.progress_latest(table(spark, d, "user_progress"))
    b = _books(spark, d).select(F.col("id").alias("book_id"), "char_count", "format")
    return p.join(b, "book_id").select("user_id", "book_id", C.at_book_end(F.col("char_offset"), F.col("char_count"), F.col("format")).alias("ended"))


def reading_status_advance(spark, d):
    """STR-02, DML-09."""
    return C.reading_status(C.progress_latest(table(spark, d, "user_progress")), _books(spark, d))


def progress_stats(spark, d):
    """AGG-01, AGG-02: counts per user with filtered counts."""
    p = C.progress_latest(table(spark, d, "user_progress"))
    return p.groupBy("user_id").agg(F.count("*").alias("books"), F.count_if(F.col("chapter_idx") > 2).alias("deep"), F.max("updated_at").alias("last_at"))


def progress_merge(spark, d):
    """STR-01: optimistic writes in order of arrival, which is the rows' place in the log's files."""
    log = table(spark, d, "user_progress").select("user_id", "book_id", F.struct("_metadata.file_name", "_metadata.row_index").alias("seq"), F.col("base_updated_at").alias("base"), "updated_at", "char_offset")
    return C.merge_progress(log)


def login_throttle(spark, d, gap: int = 86_400, limit: int = 3):
    """STR-03 over events: errors are failures, signups successes, and a day ends a session."""
    e = table(spark, d, "events").where("event_type in ('error', 'signup')").select(F.col("user_id").alias("key"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), (F.col("event_type") == "signup").alias("ok"))
    return C.throttle(e, gap, limit)


def login_throttle_minute(spark, d):
    """STR-03 with its own limits: five failures, sixty seconds."""
    return login_throttle(spark, d, 60, 5)


def live_sessions(spark, d, days: int = 30):
    """FIL-08, FIL-09, JOI-02, STR-04: events as sessions that live thirty days, a day before the last one ends."""
    e = table(spark, d, "events").select(F.col("event_id").alias("token"), "user_id", (F.unix_timestamp(F.col("ts").cast("timestamp")) + days * 86_400).alias("expires_at"))
    now = e.agg((F.max("expires_at") - 86_400).alias("now"))
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("role"))
    return e.crossJoin(F.broadcast(now)).where("expires_at > now").join(users, "user_id").select("token", "user_id", "role", "expires_at")


def job_rollup(spark, d):
    """AGG-13: folders' scan results summed for each job (a job for every format)."""
    b = table(spark, d, "books")
    part = b.groupBy(F.col("format").alias("job_id"), "folder_id").agg(F.count_distinct("id").alias("added"), F.count("*").alias("updated"), F.count_if(F.col("file_hash").isNull()).alias("removed"), F.collect_set(F.when(F.col("encoding").isNull(), F.col("path"))).alias("failures"))
    return C.job_rollup(part).select("job_id", "total", "added", "updated", "removed", F.size("failures").alias("n_failures"))


def active_job(spark, d):
    """SRT-04, FIL-10: newest open job, by (created_at, id)."""
    j = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("created_at"), F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("done").alias("status"))
    return j.where(F.col("status").isin(*C.OPEN_JOBS)).orderBy(F.desc("created_at"), F.desc("id")).limit(1)


def latest_jobs(spark, d, n: int = 50):
    """SRT-05: the newest jobs (a report; the limit is clamped to 1..100, else 50)."""
    n = n if 1 <= n <= 100 else 50
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("created_at")).orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def stale_jobs(spark, d):
    """DML-10, STR-07."""
    j = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("done").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("long").alias("finished_at"))
    return C.fail_stale_jobs(j, 1_800_000_000).groupBy("status").agg(F.count("*").alias("n"), F.count("error").alias("errors"), F.max("finished_at").alias("at"))


def adopt_legacy(spark, d):
    """DML-11: one user's rows go over to another."""
    who = "legacy"
    p = C.progress_latest(table(spark, d, "user_progress")).join(F.broadcast(_reader(spark, d).withColumn("hit", F.lit(True))), "user_id", "left")
    p = p.withColumn("user_id", F.when(F.col("hit"), "default").otherwise(F.col("user_id"))).drop("hit")
    return C.adopt(p, who).where(F.col("user_id") == who).select("user_id", "book_id", "char_offset")


def chapter_list(spark, d):
    """SRT-07, SNK-09: chapters without plain copies, titles filled (STRF-24)."""
    c = table(spark, d, "chapters").distinct()
    return c.select("book_id", "idx", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.concat(F.lit("Chapter "), F.col("idx").cast("string"))).alias("title"), "char_offset", F.row_number().over(Window.partitionBy("book_id").orderBy("idx", "id")).alias("rank"))


def toc_tree(spark, d):
    """WIN-13, AGG-19: containers and first children by the neighbours' levels."""
    c = table(spark, d, "chapters").distinct()
    w = Window.partitionBy("book_id").orderBy("idx")
    return c.select("book_id", "idx", "level", F.coalesce(F.lead("level").over(w) > F.col("level"), F.lit(False)).alias("container"), F.coalesce(F.lag("level").over(w) < F.col("level"), F.lit(False)).alias("first_child"))


def relocate_sources(spark, d):
    """SRC-38, JOI-15: books whose source is lost, found again by (size, mtime, hash) among the rows of all scans."""
    b = _books(spark, d)
    files = table(spark, d, "books").where("source_path is not null and file_hash is not null").select("size_bytes", "file_mtime", "file_hash", F.col("source_path").alias("found")).groupBy("size_bytes", "file_mtime", "file_hash").agg(F.min("found").alias("found"))
    lost = b.where("file_hash is not null").select("id", "source_path", "size_bytes", "file_mtime", "file_hash")
    return lost.join(files, ["size_bytes", "file_mtime", "file_hash"], "left").select("id", F.coalesce("source_path", "found").alias("source"))


def public_books(spark, d):
    """FIL-16: base name of the path, and paths within a message cut to their base names."""
    message = F.concat(F.lit("  open "), F.col("path"), F.lit(": no such file, nor C:\\shelf\\old\\"), F.col("title"), F.lit(" "))
    return _books(spark, d).select("id", F.regexp_extract("path", r"([^/\\]+)\z", 1).alias("name"), C.public_message(message).alias("message"))


def default_cover(spark, d):
    """FN-04: palette colour by FNV-1a of title and author, and the label of the first letter."""
    colour, label = T.cover(F.col("title"), F.col("author"))
    return _books(spark, d).select("id", colour.alias("colour"), label.alias("label"))


def head_hashes(spark, d):
    """FN-01, FN-02, FN-09: content hash, hash of the first 64 KiB and anonymous name of every book's text (twice, so that most are longer)."""
    e = table(spark, d, "epub_books")
    twice = F.encode(F.repeat("flat_text", 40), "UTF-8")
    return e.select("book_id", F.sha2(F.substring(twice, 1, 65536), 256).alias("head"), F.sha2("flat_text", 256).alias("hash"), F.concat(F.lit("document-"), F.substring(F.sha2("flat_text", 256), 1, 12)).alias("name"), F.concat(F.lit("corpus-"), F.substring(F.sha2("flat_text", 256), 1, 12), F.lit(".reader-v1.jsonl")).alias("file"))


_N = [list_books, books_in_folder, get_book, shelf_search, shelf_filter, tags_for_books, tag_counts, tags_added, tags_removed, folder_counts, duplicate_groups, duplicate_members, prune_missing, delete_folder, upsert_rescan, metadata_update, progress_latest, progress_map, shelf_recent, shelf_in_order, continue_reading, at_book_end, reading_status_advance, progress_stats, progress_merge, login_throttle, login_throttle_minute, live_sessions, job_rollup, active_job, latest_jobs, stale_jobs, adopt_legacy, chapter_list, toc_tree, relocate_sources, public_books, default_cover, head_hashes]
QUERIES = {f.__name__: f for f in _N}

_B = "b as (select * from (select *, row_number() over (partition by id order by scanned_at desc, file_mtime desc, reading_status desc) rn from books) where rn = 1)"
_T = "t as (select distinct id book_id, trim(x) as name from (select id, category x from b union all select id, format x from b) where x is not null and trim(x) <> '')"
_P = "p as (select * from (select *, row_number() over (partition by user_id, book_id order by updated_at desc, char_offset desc, chapter_idx desc, chapter_offset desc) rn from user_progress) where rn = 1)"
_R = "r as (select user_id from user_progress group by 1 order by count(*) desc, user_id limit 1)"
_END = "case when b.char_count is null or b.char_count <= 0 then false when b.format = 'pdf-image' then p.char_offset >= b.char_count - 1 else p.char_offset >= b.char_count - greatest(1000, least(3000, b.char_count // 100)) end"
_J = "j as (select o_orderkey id, floor(epoch(o_orderdate))::bigint created_at, case o_orderstatus when 'O' then 'queued' when 'P' then 'running' else 'done' end status from orders)"
SQL = {
    "list_books": f"with {_B} select id, folder_id, title, coalesce(author, '') author, coalesce(reading_status, 'unread') reading_status, coalesce(char_count, 0) char_count, scanned_at, row_number() over (order by scanned_at desc, id) \"rank\" from b",
    "books_in_folder": f"with {_B} select id, title, path from b where folder_id = 2",
    "get_book": f"with {_B} select id, folder_id, path, format from b where id = 7",
    "shelf_search": f"with {_B}, {_T} select id, title from b where contains(lower(title), 'river') or contains(lower(coalesce(author, '')), 'river') or contains(lower(coalesce(category, '')), 'river') or id in (select book_id from t where contains(lower(name), 'river'))",
    "shelf_filter": f"with {_B}, {_T} select id, reading_status from b where reading_status = 'reading' and favorite and id in (select book_id from t where name = 'epub')",
    "tags_for_books": f"with {_B}, {_T} select b.id, coalesce(string_agg(t.name, ',' order by lower(t.name), t.name), '') tags from b left join t on t.book_id = b.id group by b.id",
    "tag_counts": f"with {_B}, {_T} select name, count(*) n_books, row_number() over (order by translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), name) \"rank\" from t group by 1",
    "tags_added": f"with {_B}, {_T} select book_id, name from t union select id, unnest(['shelf', 'epub']) from b where favorite",
    "tags_removed": f"with {_B}, {_T} select book_id, name from t where not (name = 'epub' and book_id in (select id from b where favorite))",
    "folder_counts": f"with {_B} select f.id, f.path, (select count(*) from b where b.folder_id = f.id) n_books from library_folders f",
    "duplicate_groups": f"with {_B} select file_hash, count(*) n, row_number() over (order by count(*) desc, file_hash) \"rank\" from b where file_hash is not null and file_hash <> '' group by 1 having count(*) > 1",
    "duplicate_members": f"with {_B} select *, row_number() over (order by n desc, file_hash, title, id) \"rank\" from (select file_hash, count(*) over (partition by file_hash) n, id, title from b where file_hash is not null and file_hash <> '') where n > 1",
    "prune_missing": f"with {_B} select id, folder_id from b where folder_id <> 2 or path in (select path from b where source_path like '%.epub')",
    "delete_folder": f"with {_B}, {_P}, g as (select id from b where folder_id = 2) select 'folders' what, count(*) n from library_folders where id <> 2 union all select 'books', count(*) from b where folder_id <> 2 union all select 'chapters', count(*) from (select distinct id, book_id from chapters) where book_id not in (select id from g) union all select 'progress', count(*) from p where book_id not in (select id from g)",
    "upsert_rescan": f"with {_B} select path, id, size_bytes + (case when folder_id = 3 then 1 else 0 end) size_bytes, favorite, reading_status, added_at, case when folder_id = 3 then 1800000000 else scanned_at end scanned_at from b union all select path || '.new', null, size_bytes, false, 'unread', 1800000000, 1800000000 from b where folder_id = 3",
    "metadata_update": f"with {_B} select id, title, case when id % 2 = 0 then 'New Author' else author end author, case when id % 4 = 0 then null else category end category from b",
    "progress_latest": f"with {_P} select user_id, book_id, char_offset, chapter_idx, chapter_offset, updated_at from p",
    "progress_map": f"with {_B}, {_P} select user_id, book_id, char_offset from p where book_id in (select id from b where favorite)",
    "shelf_recent": f"with {_B}, {_P}, {_R} select b.id, coalesce(p.updated_at, 0) read_at, b.scanned_at from b left join (select * from p where user_id in (select user_id from r)) p on p.book_id = b.id",
    "shelf_in_order": f"with {_B}, {_P}, {_R} select b.id, coalesce(p.updated_at, 0) read_at, b.scanned_at, row_number() over (order by coalesce(p.updated_at, 0) desc, b.scanned_at desc, b.id) \"rank\" from b left join (select * from p where user_id in (select user_id from r)) p on p.book_id = b.id",
    "progress_merge": "with l as (select *, row_number() over () rn from user_progress), g as (select user_id, book_id, list_reduce(list_prepend({'v': 0::bigint, 'o': null::bigint, 'r': 0::bigint, 'b': 0::bigint}, list({'v': updated_at, 'o': char_offset, 'r': 0::bigint, 'b': coalesce(base_updated_at, 0)} order by rn)), lambda a, x: case when x.b = 0 or a.v <= x.b then {'v': x.v, 'o': x.o, 'r': a.r, 'b': 0::bigint} else {'v': a.v, 'o': a.o, 'r': a.r + 1, 'b': 0::bigint} end) s from l group by 1, 2) select user_id, book_id, s.v \"version\", s.o char_offset, s.r refused from g",
    "continue_reading": f"with {_B}, {_P}, {_R} select b.id, p.updated_at read_at from b join p on p.book_id = b.id where user_id in (select user_id from r) and p.updated_at > 0 order by p.updated_at desc, b.scanned_at desc, b.id limit 5",
    "at_book_end": f"with {_B}, {_P} select p.user_id, p.book_id, {_END} ended from p join b on b.id = p.book_id",
    "reading_status_advance": f"with {_B}, {_P}, e as (select p.book_id, bool_or({_END}) ended from p join b on b.id = p.book_id group by 1) select b.id, case when reading_status in ('finished', 'paused') or e.ended is null then reading_status when e.ended then 'finished' when reading_status = 'unread' then 'reading' else reading_status end reading_status from b left join e on e.book_id = b.id",
    "progress_stats": f"with {_P} select user_id, count(*) books, count(*) filter (chapter_idx > 2) deep, max(updated_at) last_at from p group by 1",
    "login_throttle": """with recursive e as (select user_id k, floor(epoch(ts))::bigint t, event_type = 'signup' ok from events where event_type in ('error', 'signup')),
o as (select *, row_number() over (partition by k order by t, ok) i from e),
r as (select k, i, t, ok, 0::bigint n0, case when ok then 0 else 1 end::bigint n, t f, t l, null::bigint df, null::bigint dl, 0::bigint dn from o where i = 1 union all
  select o.k, o.i, o.t, o.ok, x.n, case when x.n >= 3 and o.t <= x.l + 86400 then x.n when o.ok then 0 when x.n > 0 and o.t > x.l + 86400 then 1 else x.n + 1 end,
    case when x.n >= 3 and o.t <= x.l + 86400 then x.f when x.n > 0 and o.t <= x.l + 86400 then x.f else o.t end, case when x.n >= 3 and o.t <= x.l + 86400 then x.l when o.ok then x.l else o.t end,
    x.f, x.l, case when x.n > 0 and (o.t > x.l + 86400 or (o.ok and x.n < 3)) then x.n else 0 end from o join r x on x.k = o.k and x.i + 1 = o.i),
z as (select k, df f, dl l, dn n from r where dn > 0 union all select k, f, l, n from (select *, row_number() over (partition by k order by i desc) q from r) where q = 1 and n > 0)
select k as key, f first_t, l last_t, n failures, n >= 3 blocked from z""",
    "login_throttle_minute": """with recursive e as (select user_id k, floor(epoch(ts))::bigint t, event_type = 'signup' ok from events where event_type in ('error', 'signup')),
o as (select *, row_number() over (partition by k order by t, ok) i from e),
r as (select k, i, t, ok, 0::bigint n0, case when ok then 0 else 1 end::bigint n, t f, t l, null::bigint df, null::bigint dl, 0::bigint dn from o where i = 1 union all
  select o.k, o.i, o.t, o.ok, x.n, case when x.n >= 5 and o.t <= x.l + 60 then x.n when o.ok then 0 when x.n > 0 and o.t > x.l + 60 then 1 else x.n + 1 end,
    case when x.n >= 5 and o.t <= x.l + 60 then x.f when x.n > 0 and o.t <= x.l + 60 then x.f else o.t end, case when x.n >= 5 and o.t <= x.l + 60 then x.l when o.ok then x.l else o.t end,
    x.f, x.l, case when x.n > 0 and (o.t > x.l + 60 or (o.ok and x.n < 5)) then x.n else 0 end from o join r x on x.k = o.k and x.i + 1 = o.i),
z as (select k, df f, dl l, dn n from r where dn > 0 union all select k, f, l, n from (select *, row_number() over (partition by k order by i desc) q from r) where q = 1 and n > 0)
select k as key, f first_t, l last_t, n failures, n >= 5 blocked from z""",
    "live_sessions": "with e as (select event_id token, user_id, floor(epoch(ts))::bigint + 2592000 expires_at from events) select token, e.user_id, c_mktsegment as role, expires_at from e join customer on c_custkey = e.user_id where expires_at > (select max(expires_at) - 86400 from e)",
    "job_rollup": "with p as (select format job_id, folder_id, count(distinct id) added, count(*) updated, count(*) filter (file_hash is null) removed, count(distinct case when encoding is null then path end) f from books group by 1, 2) select job_id, count(distinct folder_id) total, sum(added)::bigint added, sum(updated)::bigint updated, sum(removed)::bigint removed, sum(f)::int n_failures from p group by 1",
    "active_job": f"with {_J} select id, created_at, status from j where status in ('queued', 'running') order by created_at desc, id desc limit 1",
    "latest_jobs": f"with {_J} select id, created_at from j order by created_at desc, id desc limit 50",
    "stale_jobs": f"with {_J} select case when status in ('queued', 'running') then 'failed' else status end status, count(*) n, count(*) filter (status in ('queued', 'running')) errors, max(case when status in ('queued', 'running') then 1800000000 end)::bigint \"at\" from j group by 1",
    "adopt_legacy": f"with {_P}, {_R} select 'legacy' user_id, book_id, char_offset from p where user_id in (select user_id from r)",
    "chapter_list": "select book_id, idx, coalesce(nullif(trim(title), ''), 'Chapter ' || idx) title, char_offset, row_number() over (partition by book_id order by idx, id)::int \"rank\" from (select distinct * from chapters)",
    "toc_tree": "select book_id, idx, level, coalesce(lead(level) over w > level, false) container, coalesce(lag(level) over w < level, false) first_child from (select distinct * from chapters) window w as (partition by book_id order by idx)",
    "relocate_sources": f"with {_B}, f as (select size_bytes, file_mtime, file_hash, min(source_path) found from books where source_path is not null and file_hash is not null group by 1, 2, 3) select b.id, coalesce(b.source_path, f.found) as source from b left join f using (size_bytes, file_mtime, file_hash) where b.file_hash is not null",
    "public_books": f"with {_B} select id, regexp_extract(path, '([^/\\\\]+)$', 1) as name, trim(regexp_replace('  open ' || path || ': no such file, nor C:\\shelf\\old\\' || title || ' ', '(?:[A-Za-z]:)?(?:[\\\\/][^\\\\/\\s:]+)*[\\\\/]', '', 'g')) message from b",
    "head_hashes": "select book_id, sha256(encode(repeat(flat_text, 40))[1:65536]) head, sha256(flat_text) hash, 'document-' || substring(sha256(flat_text), 1, 12) as name, 'corpus-' || substring(sha256(flat_text), 1, 12) || '.reader-v1.jsonl' file from epub_books",
    "default_cover": f"with {_B}, s as (select id, title, hex(trim(title || chr(0) || coalesce(author, ''))) x from b), h as (select id, title, list_reduce(list_prepend(2166136261::bigint, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substring(x, i * 2 + 1, 2))::bigint)), lambda a, c: (xor(a, c) * 16777619) % 4294967296) f from s) select id, f % 8 colour, coalesce(nullif(upper(substring(trim(title), 1, 1)), ''), '书') \"label\" from h",
}
