"""Queries of the service's operators, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexmill.functions import text as T
from codexmill.operators import catalog as C
from codexmill.operators import library as L
from codexmill.operators import service as S
from codexmill.operators.skew import ranked
from codexmill.plans.text import SQL as _TEXT_SQL
from codexmill.plans.text import corpus_records, promo_clean_stats
from codexmill.session import table

_PROMO_STATS = _TEXT_SQL["promo_clean_stats"]


def _books(spark, d):
    return C.current_books(table(spark, d, "books"))


def session_hashes(spark, d):
    """FN-03: tokens are kept as hashes only."""
    return table(spark, d, "events").select("event_id", F.sha2(F.concat(F.lit("token-"), F.col("event_id").cast("string")), 256).alias("token_hash"))


def etags(spark, d):
    """FN-14: versions of covers and of ranges of content."""
    b = _books(spark, d)
    return b.select("id", S.etag("cover", F.col("id"), F.col("scanned_at")).alias("cover"), S.etag("content", F.col("id"), F.col("scanned_at"), F.col("id") * 10, F.lit(5000)).alias("content"))


def scan_times(spark, d):
    """FN-05, FN-06: seconds of the clock as UTC times."""
    return _books(spark, d).select("id", S.rfc3339(F.col("scanned_at")).alias("at"))


def usernames(spark, d):
    """STRF-27: names and passwords from titles and authors, normalised and judged."""
    b = _books(spark, d)
    name = S.username(F.concat(F.lit("  "), F.coalesce("author", F.lit("X")), F.lit(" ")))
    return b.select("id", name.alias("name"), S.username_error(name).alias("name_error"), S.password_error(F.col("title")).alias("password_error"))


def new_users(spark, d):
    """DML-13: accounts for the customers' segments and nations that are not taken."""
    users = table(spark, d, "nation").select(F.lower("n_name").alias("username"), F.lit("x").alias("password_hash"), F.lit("reader").alias("role"), F.lit(0).cast("long").alias("created_at"))
    wanted = table(spark, d, "customer").select(F.concat(F.lit(" "), "c_mktsegment").alias("username"), F.lit("y").alias("password_hash"), F.when(F.col("c_custkey") % 2 == 0, "admin").otherwise("reader").alias("role"))
    more = table(spark, d, "nation").select(F.col("n_name").alias("username"), F.lit("z").alias("password_hash"), F.lit("admin").alias("role"))
    return S.create_users(users, wanted.unionByName(more), 5).select("username", "password_hash", "role", "created_at")


def export_names(spark, d):
    """STRF-29: header values for exports named by title."""
    return _books(spark, d).select("id", S.attachment(F.concat("title", F.lit(".jsonl"))).alias("header"))


def cover_titles(spark, d):
    """STRF-31: titles in lines for a cover."""
    return _books(spark, d).select("id", F.array_join(S.cover_lines(F.col("title")), "|").alias("lines"))


def highlighted_titles(spark, d, term: str = "the"):
    """STRF-26: hits of a term in the titles."""
    p = S.marked(F.col("title"), term)
    return _books(spark, d).select("id", F.array_join(p, "|").alias("pieces"), ((F.size(p) - 1) / 2).cast("long").alias("hits"))


def book_folders(spark, d):
    """JOI-09: every book with its folder."""
    b, f = _books(spark, d), table(spark, d, "library_folders")
    return b.join(f.select(F.col("id").alias("folder_id"), F.col("path").alias("folder")), "folder_id").select("id", "folder_id", "folder", "path")


def folders_listed(spark, d):
    """SRT-08: folders by the time they were added, with their numbers of books."""
    f = table(spark, d, "library_folders").select("id", "added_at")
    n = C.folder_counts(table(spark, d, "library_folders"), _books(spark, d)).select("id", "n_books")
    return ranked(f.join(n, "id"), "added_at", "id")


def folders_added(spark, d):
    """DML-06: paths in several spellings, some of them known."""
    f = table(spark, d, "library_folders")
    paths = f.select(F.concat("path", F.lit("/./x/../")).alias("path")).unionByName(f.select(F.concat("path", F.lit("//new/")).alias("path")))
    return S.add_folders(f, paths, 7).select("id", "path", "added_at")


def tags_replaced(spark, d):
    """DML-04: the tags of every third book replaced, of every sixth cleared."""
    b = _books(spark, d)
    names = F.when(F.col("id") % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit(" new "), F.lit("new"), F.lit(""), F.col("format")))
    return S.set_tags(C.tags_of(b)[1], b.where("id % 3 = 0").select(F.col("id").alias("book_id"), names.alias("names")))


def selection(spark, d):
    """SET-04: favourites selected, EPUB books clicked, one folder gone."""
    b = _books(spark, d)
    return S.toggled(b.where("favorite"), b.where("format = 'epub'"), b.where("folder_id <> 2"))


def nearest_chapters(spark, d):
    """SRT-15: the chapter that begins nearest to each reader's position."""
    p = table(spark, d, "user_progress").select("book_id", F.col("char_offset").alias("at")).distinct()
    ch = table(spark, d, "chapters").select("book_id", "idx", "char_offset").distinct()
    return S.nearest(p, ch, "book_id")


def visible_chapters(spark, d):
    """WIN-17: rows of each book's contents list that a window of it shows."""
    ch = table(spark, d, "chapters").distinct().select("book_id", "idx", (F.lit(20) + F.length("title")).cast("long").alias("height"))
    return S.visible(ch, "book_id", "idx", "height", 60, 130, 1).select("book_id", "idx", F.col("i").cast("long").alias("i"), F.col("y").cast("long").alias("y"))


def uploaded_names(spark, d):
    """SRC-36: every book uploaded again to its folder, beside what is there."""
    b = _books(spark, d)
    name = S.upload_name(F.concat(F.lit(" /tmp/"), F.regexp_replace("title", "[0-9]", "?"), F.lit("."), F.upper("format")))
    there = b.where("id % 2 = 0").select("folder_id", name.alias("name")).distinct()
    return S.unique_names(b.select("folder_id", F.col("id").alias("upload_id"), name.alias("name")), there)


def job_payloads(spark, d):
    """FN-11: payloads written as JSON and read back, some of them broken."""
    b = _books(spark, d)
    js = F.when(F.col("id") % 5 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.array("folder_id").alias("folder_ids"), F.array("path").alias("paths"))))
    p = S.payload(js)
    return b.select("id", p["folder_ids"][0].alias("folder_id"), p["paths"][0].alias("path"), p["failures"].isNull().alias("no_failures"))


def removed_shares(spark, d):
    """FN-13: how much of every document the promotional pass removes, in percent."""
    return promo_clean_stats(spark, d).select("doc_id", L.removed_percent(F.col("chars_in"), F.col("chars_out")).alias("removed"))


def job_reports(spark, d):
    """STR-06: progress reports of jobs, at most one in 200 ms but the last."""
    e = table(spark, d, "events").select((F.col("user_id") % 7).alias("job_id"), (F.unix_millis(F.col("ts").cast("timestamp")) / 10_000_000).cast("long").alias("t"), (F.col("event_id") % 100).alias("done"), F.lit(99).cast("long").alias("total"))
    return C.paced(e.distinct())


def export_preview(spark, d):
    """SNK-10, SRT-14: the first three records of the export of the first book that has chapters (the limit is the feature)."""
    first = table(spark, d, "chapters").agg(F.min("book_id").alias("book_id"))
    r = corpus_records(spark, d).join(F.broadcast(first), "book_id", "left_semi")
    return r.orderBy("chapter_index").limit(3).select("id", "chapter_index", "title", "chars")


def evolved_books(spark, d):
    """DDL-01: an older table with the columns that came later."""
    b = _books(spark, d).select("id", "title", "favorite")
    return C.evolve(b, {"favorite": ("boolean", False), "language": ("string", "und"), "rating": ("long", 0), "note": ("string", None)})


def users_deleted(spark, d):
    """DML-08: a user goes with all their rows; the last administrator stays."""
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("user_id"), "c_custkey")
    users = c.select("user_id").distinct().withColumn("role", F.when(F.col("user_id") == "BUILDING", "admin").otherwise("reader"))
    kept, kids = C.delete_user("MACHINERY", users, {"marks": c})
    kept, kids = C.delete_user("BUILDING", kept, kids)
    n = kids["marks"].groupBy("user_id").agg(F.count("*").alias("marks"))
    return kept.join(n, "user_id", "left").select("user_id", "role", F.coalesce("marks", F.lit(0)).alias("marks"))


_N = [export_preview, evolved_books, users_deleted, session_hashes, etags, scan_times, usernames, new_users, export_names, cover_titles, highlighted_titles, book_folders, folders_listed, folders_added, tags_replaced, selection, nearest_chapters, visible_chapters, uploaded_names, job_payloads, removed_shares, job_reports]
QUERIES = {f.__name__: f for f in _N}

_W = T.WHITE.replace("'", "''")
_WC = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in T.WHITE) + "]"
_B = "b as (select * from (select *, row_number() over (partition by id order by scanned_at desc, file_mtime desc, reading_status desc) rn from books) where rn = 1)"
_T = "t as (select distinct id book_id, trim(x) as name from (select id, category x from b union all select id, format x from b) where x is not null and trim(x) <> '')"
SQL = {
    "export_preview": f"with x as ({_TEXT_SQL['corpus_records']}) select id, chapter_index, title, chars from x where book_id = (select min(book_id) from chapters) order by chapter_index limit 3",
    "evolved_books": f"with {_B} select id, title, favorite, 'und' \"language\", 0::bigint rating, null::varchar note from b",
    "users_deleted": "select c_mktsegment user_id, case when c_mktsegment = 'BUILDING' then 'admin' else 'reader' end as role, count(*) marks from customer where c_mktsegment <> 'MACHINERY' group by 1",
    "session_hashes": "select event_id, sha256('token-' || event_id) token_hash from events",
    "etags": f"with {_B} select id, '\"cover-' || id || '-' || scanned_at || '\"' cover, '\"content-' || id || '-' || scanned_at || '-' || id * 10 || '-5000\"' content from b",
    "scan_times": f"with {_B} select id, strftime(make_timestamp(scanned_at * 1000000), '%Y-%m-%dT%H:%M:%SZ') \"at\" from b",
    "usernames": f"with {_B}, n as (select id, title, lower(trim(coalesce(author, 'X'), '{_W}')) as name from b) select id, name, case when strlen(name) not between 2 and 32 then 'length' when not regexp_full_match(name, '[a-z0-9_.-]*') then 'characters' end name_error, case when length(title) < 8 then 'short' when strlen(title) > 72 then 'long' end password_error from n",
    "new_users": "with w as (select lower(trim(c_mktsegment)) username, 'y' password_hash, case when c_custkey % 2 = 0 then 'admin' else 'reader' end as role from customer union all select lower(n_name), 'z', 'admin' from nation) select lower(n_name) username, 'x' password_hash, 'reader' as role, 0::bigint created_at from nation union all select username, 'y', min(role), 5 from w where username not in (select lower(n_name) from nation) and regexp_full_match(username, '[a-z0-9_.-]{2,32}') group by 1",
    "export_names": f"with {_B}, f as (select id, title || '.jsonl' as f, ltrim(regexp_replace(title || '.jsonl', '[^A-Za-z0-9._-]', '', 'g'), '.-_') a from b) select id, 'attachment; filename=\"' || (case when regexp_matches(a, '^.+\\.[^.]*$') then a else 'export.jsonl' end) || '\"; filename*=UTF-8''''' || array_to_string(list_transform(regexp_extract_all(hex(f), '..'), lambda h: case when regexp_matches(h, '^(3[0-9]|4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A]|2D|2E|5F|7E)$') then chr(('0x' || h)::int) else '%' || h end), '') header from f",
    "cover_titles": f"""with {_B}, c as (select id, trim(title, '{_W}') t, regexp_matches(title, '[\\x{{3400}}-\\x{{9fff}}\\x{{f900}}-\\x{{faff}}]') han from b where title is not null),
f as (select *, list_reduce(list_prepend({{'ls': []::varchar[], 'l': ''}}, list_transform(regexp_split_to_array(t, '{_WC}+'), lambda w: {{'ls': []::varchar[], 'l': w}})), lambda a, w: case when len(a.ls) >= 4 then a when a.l <> '' and length(a.l || ' ' || w.l) > 12 then {{'ls': list_append(a.ls, a.l), 'l': w.l}} when a.l = '' then {{'ls': a.ls, 'l': w.l}} else {{'ls': a.ls, 'l': a.l || ' ' || w.l}} end) x from c),
l as (select *, case when t = '' then []::varchar[] when han then regexp_extract_all(t, '(?s).{{1,5}}')[1:4] when len(x.ls) < 4 and x.l <> '' then list_append(x.ls, x.l) else x.ls end r from f)
select id, array_to_string(case when len(r) = 4 and length(t) > (case when han then 20 else 48 end) then list_append(r[1:3], left(r[4], length(r[4]) - 1) || '…') else r end, '|') \"lines\" from l""",
    "highlighted_titles": f"with {_B} select id, regexp_replace(title, '(?i)(the)', '|\\1|', 'g') pieces, ((length(title) - length(regexp_replace(title, '(?i)the', '', 'g'))) // 3)::bigint hits from b",
    "book_folders": f"with {_B} select b.id, folder_id, f.path folder, b.path from b join library_folders f on f.id = b.folder_id",
    "folders_listed": f"with {_B} select f.id, added_at, (select count(*) from b where b.folder_id = f.id) n_books, row_number() over (order by added_at, f.id) \"rank\" from library_folders f",
    "folders_added": "select id, path, added_at from library_folders union all select null, path || '/new', 7 from library_folders",
    "tags_replaced": f"with {_B}, {_T} select book_id, name from t where book_id % 3 <> 0 union all select id, 'new' from b where id % 3 = 0 and id % 6 <> 0 union all select id, format from b where id % 3 = 0 and id % 6 <> 0",
    "selection": f"with {_B} select id from b where (favorite <> (format = 'epub')) and folder_id <> 2",
    "nearest_chapters": "with p as (select distinct book_id, char_offset a from user_progress), c as (select distinct book_id, idx, char_offset o from chapters), r as (select p.book_id, a, idx, row_number() over (partition by p.book_id, a order by abs(o - a), o, idx desc) n from p join c on c.book_id = p.book_id) select book_id, a as \"at\", idx from r where n = 1",
    "visible_chapters": "with h as (select book_id, idx, 20 + length(title) h, row_number() over (partition by book_id order by idx) - 1 i from (select distinct * from chapters)), y as (select *, coalesce(sum(h) over (partition by book_id order by idx rows between unbounded preceding and 1 preceding), 0)::bigint y from h), z as (select *, least(count(*) filter (y + h <= 60) over (partition by book_id), count(*) over (partition by book_id) - 1) a, least(count(*) filter (y + h <= 130) over (partition by book_id), count(*) over (partition by book_id) - 1) b from y) select book_id, idx, i, y from z where i between a - 1 and b + 1",
    "job_payloads": f"with {_B} select id, case when id % 5 <> 0 then folder_id end folder_id, case when id % 5 <> 0 then path end path, true no_failures from b",
    "uploaded_names": f"""with {_B}, n as (select folder_id, id, trim(regexp_replace(regexp_replace(title, '[0-9]', '?', 'g'), '^.*/', ''), '{_W}') stem, '.' || lower(format) ext from b),
m as (select folder_id, id, coalesce(nullif(trim(regexp_replace(coalesce(nullif(regexp_replace(stem, '^\\.+|\\.+$', '', 'g'), ''), 'book'), '[\\x00-\\x1f/\\\\:*?"<>|]', '_', 'g'), '{_W}'), ''), 'book') stem, ext from n),
k as (select *, row_number() over (partition by folder_id, stem, ext order by id) k, exists (select 1 from m o where o.folder_id = m.folder_id and o.stem = m.stem and o.ext = m.ext and o.id % 2 = 0) taken from m),
i as (select *, k - 1 + taken::int i from k) select folder_id, id upload_id, case when i = 0 then stem || ext when i <= 1000 then stem || ' (' || i || ')' || ext end target from i""",
    "removed_shares": f"with x as ({_PROMO_STATS}) select doc_id, case when chars_in > 0 then round((chars_in - chars_out) / chars_in * 100, 1) else 0.0 end removed from x",
    "job_reports": """with recursive e as (select distinct user_id % 7 j, (epoch_ms(ts::timestamp) // 10000000)::bigint t, event_id % 100 d from events), o as (select *, row_number() over (partition by j order by t, d) i from e),
r as (select j, t, d, i, t l, true keep from o where i = 1 union all select o.j, o.t, o.d, o.i, case when o.t - r.l >= 200 or o.d = 99 then o.t else r.l end, o.t - r.l >= 200 or o.d = 99 from o join r on r.j = o.j and r.i + 1 = o.i)
select j job_id, t, d done, 99::bigint total from r where keep""",
}
