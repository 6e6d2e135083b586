"""Text queries over whole tables: paragraphs, cleaning, export, search. Each with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexmill.functions import text as T
from codexmill.operators import clean as K
from codexmill.operators import search as S
from codexmill.session import table, texts

NEEDLE = "The River"


def _texts(spark, d):
    return texts(spark, d, "epub_books").select("book_id", F.col("flat_text").alias("text"))


def _chapters(spark, d):
    return table(spark, d, "chapters").select("book_id", "idx", "title", "level", "char_offset").distinct()


def _paras(spark, d):
    return K.in_chapters(K.paragraphs(_texts(spark, d), "book_id", "text"), _chapters(spark, d), "book_id")


def lines_with_offsets(spark, d):
    """WIN-01."""
    return K.lines(_texts(spark, d), "book_id", "text").select("book_id", "line_no", "offset", F.length("line").cast("long").alias("n"))


def paragraphs_with_offsets(spark, d):
    """WIN-02."""
    return K.paragraphs(_texts(spark, d), "book_id", "text").select("book_id", "line_no", "offset", F.sha2("text", 256).alias("h"))


def paragraphs_in_chapters(spark, d):
    """JOI-11."""
    return _paras(spark, d).select("book_id", "line_no", "chapter", F.length("text").cast("long").alias("n"))


def title_lines(spark, d):
    """WIN-07."""
    return K.drop_titles(_paras(spark, d), "book_id").where("dropped = 'title'").select("book_id", "chapter", "line_no")


def edge_lines(spark, d):
    """AGG-06, AGG-07, WIN-08."""
    rows = K.drop_edges(K.drop_titles(_paras(spark, d), "book_id"), "book_id")
    return rows.where("dropped = 'edge'").select("book_id", "chapter", "line_no", "text")


def author_notes(spark, d):
    """WIN-09, with the notes' patterns extended by the sites' own requests (UDF-03)."""
    rules = K.Rules(notes=[*K.AUTHOR_NOTES, "^Share this", "^Enjoying the story", "^求推荐票"])
    rows = K.drop_notes(K.drop_titles(_paras(spark, d), "book_id"), "book_id", rules)
    return rows.where("dropped = 'note'").select("book_id", "chapter", "line_no")


def promo_clean_stats(spark, d):
    """STRF-19, AGG-05, FN-01: every document without promotional lines, and what was removed."""
    p = K.paragraphs(texts(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    rows = K.clean_promo(p.withColumns({"chars": F.length("text"), "dropped": F.lit(None).cast("string")}), K.Rules())
    live = F.col("dropped").isNull()
    return rows.groupBy("doc_id").agg(F.sum("chars").alias("chars_in"), F.coalesce(F.sum(F.when(live, F.length("text"))), F.lit(0)).alias("chars_out"), F.count_if(~live).alias("dropped"), F.sum("rewritten").alias("rewritten"))


def clean_stats(spark, d):
    """AGG-05, all passes."""
    return K.stats(K.clean(_paras(spark, d), "book_id"), "book_id", _texts(spark, d), _chapters(spark, d))


def normalised_paragraphs(spark, d):
    """STRF-15..18, WIN-14."""
    p = K.paragraphs(_texts(spark, d), "book_id", "text")
    return p.select("book_id", "line_no", F.sha2(T.normal_export(F.col("text"), [("coins", "pennies")]), 256).alias("h"))


def _records(spark, d, anonymous: bool = False):
    meta = table(spark, d, "epub_books").select("book_id", F.col("title").alias("book"), "author")
    return K.records(K.clean(_paras(spark, d), "book_id"), "book_id", _texts(spark, d), _chapters(spark, d), meta, anonymous)


def corpus_records(spark, d):
    """AGG-16, AGG-20, FN-01, FN-08, FIL-13, FIL-14: the export, one record for each chapter."""
    r = _records(spark, d)
    return r.select("book_id", "id", "chapter_index", "title", "offset", "chars", "cleaned_sha256", "source_sha256", F.array_join("warnings", ",").alias("warnings"))


def corpus_anonymous(spark, d):
    """FN-09."""
    return _records(spark, d, anonymous=True).select("book_id", "id", "book", "author", "title")


def corpus_jsonl(spark, d):
    """SNK-01, SNK-02, FN-10: the records as JSON lines."""
    return K.to_jsonl(_records(spark, d))


def packed_chunks(spark, d, target: int = 500):
    """WIN-15, STRF-21, SNK-01."""
    return K.chunks(K.clean(_paras(spark, d), "book_id"), "book_id", target).select("book_id", "chapter", F.col("chunk").cast("long").alias("chunk"), "offset", "chars", F.sha2("text", 256).alias("h"))


def chapter_ranges(spark, d):
    """JOI-12, WIN-04, FIL-15."""
    totals = _texts(spark, d).select("book_id", F.length("text").cast("long").alias("n"))
    return K.ranges(_chapters(spark, d), totals, "book_id").select("book_id", "idx", "start", "stop")


def chapter_slices(spark, d):
    """JOI-13."""
    return K.slices(_texts(spark, d), _chapters(spark, d), "book_id").select("book_id", "idx", F.length("slice").cast("long").alias("n"), F.sha2("slice", 256).alias("h"))


def byte_offsets(spark, d):
    """FN-07: offsets of chapters in bytes of UTF-8."""
    j = _texts(spark, d).join(_chapters(spark, d), "book_id")
    return j.select("book_id", "idx", T.byte_offset(F.col("text"), F.col("char_offset").cast("int")).cast("long").alias("byte_offset"))


def search_hits(spark, d):
    """STRF-11, STRF-12."""
    return S.hits(_texts(spark, d), "book_id", "text", NEEDLE)


def hit_chapters(spark, d):
    """JOI-10."""
    return S.in_chapters(search_hits(spark, d), _chapters(spark, d), "book_id")


def search_snippets(spark, d):
    """STRF-13."""
    return S.snippets(search_hits(spark, d), _texts(spark, d), "book_id", "text", len(NEEDLE))


def search_page(spark, d):
    """SRT-12, FIL-18: a page of hits from offset 500 on for each book."""
    return S.page(search_hits(spark, d), "book_id", 500, 20)


def joined_offsets(spark, d):
    """WIN-03: offsets of the sections of a book when they are joined by a blank line."""
    s = table(spark, d, "epub_sections").select("book_id", "id", F.length("body").alias("n"))
    from pyspark.sql import Window

    w = Window.partitionBy("book_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return s.select("book_id", "id", F.coalesce(F.sum(F.col("n") + 2).over(w), F.lit(0)).alias("offset"))


def lost_characters(spark, d):
    """FIL-14, SRC-08: books whose text has replacement characters, by the byte-based gate."""
    n = F.length("text") - F.length(F.replace(F.col("text"), F.lit("�"), F.lit("")))
    return _texts(spark, d).select("book_id", n.cast("long").alias("lost"), (n * 100 > F.octet_length("text")).alias("rejected")).where("lost > 0")


_N = [lines_with_offsets, paragraphs_with_offsets, paragraphs_in_chapters, title_lines, edge_lines, author_notes, promo_clean_stats, clean_stats, normalised_paragraphs, corpus_records, corpus_anonymous, corpus_jsonl, packed_chunks, chapter_ranges, chapter_slices, byte_offsets, search_hits, hit_chapters, search_snippets, search_page, joined_offsets, lost_characters]
QUERIES = {f.__name__: f for f in _N}

_W = T.WHITE.replace("'", "''")
_WC = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in T.WHITE) + "]"
_L = "l as (select book_id, generate_subscripts(string_split(flat_text, chr(10)), 1) - 1 line_no, unnest(string_split(flat_text, chr(10))) line from epub_books), o as (select *, coalesce(sum(length(line) + 1) over (partition by book_id order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint \"offset\" from l)"
_PA = _L + f", p as (select book_id, line_no, trim(line, '{_W}') as text, \"offset\" from o where trim(line, '{_W}') <> '')"
_CH = "ch as (select distinct book_id, idx, title, char_offset from chapters)"
_PC = f"{_PA}, {_CH}, pc as (select p.*, coalesce(c.idx, f.idx, 0) chapter, case when c.idx is not null then c.title else f.title end title from p asof left join (select * from ch) c on p.book_id = c.book_id and p.\"offset\" >= c.char_offset left join (select book_id, min(idx) idx, arg_min(title, idx) title from ch group by 1) f on f.book_id = p.book_id)"
_DT = f"{_PC}, dt as (select *, line_no = min(line_no) over (partition by book_id, chapter) and text = trim(title, '{_W}') as is_title from pc), lv as (select * from dt where not coalesce(is_title, false))"
_H = "h as (select book_id, unnest(list_filter(range(0, length(flat_text)), lambda i: substring(lower(flat_text), i + 1, 9) = 'the river'))::bigint as \"offset\" from epub_books where contains(lower(flat_text), 'the river'))"
_PROMO = " or ".join(f"regexp_matches(t, '{p}')" for p in [x.replace("(?![0-9A-Za-z_])", "\\b").replace("\\z", "$") for x in K.PROMO])
_CUT = "t"
for _p in K.PROMO:
    _CUT = f"regexp_replace({_CUT}, '{_p.replace('(?![0-9A-Za-z_])', chr(92) + 'b').replace(chr(92) + 'z', '$')}', '', 'g')"
_HP = "[\\p{Han}，。！？；：、「」『』（）《》…—]"


def _spaces(x: str) -> str:
    one = f"regexp_replace({x}, '({_HP}){_WC}+(\\p{{Han}})', '\\1\\2', 'g')"
    two = f"regexp_replace({one}, '({_HP}){_WC}+(\\p{{Han}})', '\\1\\2', 'g')"
    return f"trim(regexp_replace({two}, '{_WC}+', ' ', 'g'), '{_W}')"


def _normal(x: str) -> str:
    x = f"regexp_replace({x}, '[.。．·]{{3,}}|…{{3,}}', '……', 'g')"
    for c in "！？~～—":
        x = f"regexp_replace({x}, '{c}{{3,}}', '{c}', 'g')"
    for a, b in ((",", "，"), (";", "；"), (":", "："), ("!", "！"), ("\\?", "？")):
        x = f"regexp_replace({x}, '(\\p{{Han}}){a}', '\\1{b}', 'g')"
    return _spaces(x)


_ED = f"""{_DT}, e as (select *, line_no = min(line_no) over (partition by book_id, chapter) is_first, line_no = max(line_no) over (partition by book_id, chapter) is_last,
  regexp_replace(regexp_replace(text, '{_WC}', '', 'g'), '[0-9零〇一二三四五六七八九十百千万]+', '#', 'g') k from lv),
f as (select *, sum(is_first::int) over (partition by book_id, k) fc, sum(is_last::int) over (partition by book_id, k) lc, sum(is_first::int) over (partition by book_id) nch from e),
ed as (select *, nch >= 3 and length(text) <= 40 and ((is_first and fc >= greatest(3, nch // 3)) or (is_last and lc >= greatest(3, nch // 3))) edge from f)"""
_NOTES = " or ".join(f"regexp_matches(text, '{x}')" for x in K.AUTHOR_NOTES)
# every pass of the cleaning: lv (titles gone), ed (edges told), nt and tl (notes), gg (promotion cut), z (normal marks; '' goes)
_ALL = f"""{_ED}, nt as (select *, ({_NOTES}) m, row_number() over (partition by book_id, chapter order by line_no) - 1 p, count(*) over (partition by book_id, chapter) n from ed where not edge),
tl as (select *, max((m and p >= n - greatest(3, n // 5))::int) over (partition by book_id, chapter order by line_no rows unbounded preceding) = 1 tail from nt),
cc as (select *, ({_PROMO}) hit, {_spaces(_CUT)} cut from (select *, text t from tl where not m and not tail)),
gg as (select *, hit and length(t) > 60 and cut <> '' rw, case when not hit then t when length(t) > 60 and cut <> '' then cut end t2 from cc),
z as (select *, {_normal("t2")} fin from gg where t2 is not null), live as (select * from z where fin <> '')"""
_REC = f"""{_ALL}, body as (select book_id, chapter, max(title) title, min("offset") "offset", string_agg(fin, chr(10) || chr(10) order by line_no) as text from live group by 1, 2),
sl as (select ch.book_id, idx, flat_text, substring(flat_text, char_offset + 1, greatest(coalesce(lead(char_offset) over (partition by ch.book_id order by idx), length(flat_text)) - char_offset, 0)) s from ch join epub_books e on e.book_id = ch.book_id),
rec as (select b.book_id, 'sha256:' || sha256(e.flat_text) doc, 'chapter-' || lpad(chapter::varchar, greatest(4, length(chapter::varchar))::int, '0') cid, chapter, coalesce(b.title, '') title, b.text, "offset", sha256(s) src, contains(s, chr(65533)) lost, coalesce(e.title, '') book, coalesce(e.author, '') author
  from body b join sl on sl.book_id = b.book_id and sl.idx = b.chapter join epub_books e on e.book_id = b.book_id)"""
_SENT = "[。！？…][」』】）\"'']*"
_PACK = f"""with recursive {_ALL}, sp as (select book_id, chapter, line_no, "offset", fin, length(fin) > 500 and regexp_matches(fin, '{_SENT}') big, regexp_extract_all(fin, '(?s).*?{_SENT}|.+') segs from live),
rs as (select book_id, line_no, segs, 1 i, segs[1] acc from sp where big union all select book_id, line_no, segs, i + 1, case when length(acc) >= 500 then segs[i + 1] else acc || segs[i + 1] end from rs where i < len(segs)),
pz as (select book_id, chapter, line_no, "offset", 0 part, fin piece from sp where not big union all
  select sp.book_id, chapter, sp.line_no, "offset", i, trim(acc, '{_W}') from sp join rs on rs.book_id = sp.book_id and rs.line_no = sp.line_no where length(acc) >= 500 or (i = len(rs.segs) and trim(acc, '{_W}') <> '')),
pk as (select *, row_number() over (partition by book_id, chapter order by line_no, part) k from pz),
gr as (select book_id, chapter, k, 0::bigint chunk, length(piece) n from pk where k = 1 union all
  select pk.book_id, pk.chapter, pk.k, case when gr.n + length(piece) > 500 then chunk + 1 else chunk end, case when gr.n + length(piece) > 500 then length(piece) else gr.n + length(piece) end from gr join pk on pk.book_id = gr.book_id and pk.chapter = gr.chapter and pk.k = gr.k + 1),
ck as (select pk.book_id, pk.chapter, chunk, arg_min("offset", pk.k) "offset", string_agg(piece, chr(10) || chr(10) order by pk.k) as text from pk join gr on gr.book_id = pk.book_id and gr.chapter = pk.chapter and gr.k = pk.k group by 1, 2, 3)"""
SQL = {
    "clean_stats": f"""with {_ALL}, n as (select book_id, sum(length(text)) chars_in, count(*) n from pc group by 1),
lv2 as (select book_id, sum(length(fin)) chars_out, count(*) n, count(distinct chapter) records from live group by 1), w as (select book_id, sum(rw::int + (fin <> '' and fin <> t2)::int) rewritten from z group by 1),
g as (select book_id, count(*) chapters, count(*) = 1 and trim(min(title), '{_W}') in ('正文', '全文', '未分章') generic from ch group by 1)
select n.book_id, coalesce(chapters, 0) chapters, chars_in::bigint chars_in, coalesce(chars_out, 0)::bigint chars_out, n.n - coalesce(l.n, 0) dropped, coalesce(rewritten, 0)::bigint rewritten, coalesce(records, 0) records, length(flat_text) - length(replace(flat_text, chr(65533), '')) lost_chars, coalesce(generic, false) generic_structure
from n join epub_books e on e.book_id = n.book_id left join lv2 l on l.book_id = n.book_id left join w on w.book_id = n.book_id left join g on g.book_id = n.book_id""",
    "corpus_records": f"with {_REC} select book_id, doc || '/' || cid id, chapter chapter_index, title, \"offset\", length(text) chars, sha256(text) cleaned_sha256, src source_sha256, case when lost then 'replacement_character' end warnings from rec",
    "corpus_anonymous": f"with {_REC} select book_id, doc || '/' || cid id, 'document-' || substring(doc, 8, 12) book, '' author, cid title from rec",
    "corpus_jsonl": f"""with {_REC} select replace(replace('{{"schema_version":1,"id":"' || doc || '/' || cid || '","document_id":"' || doc || '","chapter_id":"' || cid || '","chapter_index":' || chapter || ',"title":' || to_json(title) || ',"text":' || to_json(text) || ',"metadata":{{"book":' || to_json(book) || case when author <> '' then ',"author":' || to_json(author) else '' end ||
'}},"cleaning":{{"promo":true,"edge_lines":true,"normalise":true,"author_notes":true,"anonymized":false' || case when lost then ',"warnings":["replacement_character"]' else '' end || '}},"offset":' || "offset" || ',"chars":' || length(text) || ',"source_sha256":"' || src || '","cleaned_sha256":"' || sha256(text) || '"}}', chr(8232), '\\u2028'), chr(8233), '\\u2029') as "value" from rec""",
    "packed_chunks": f"{_PACK} select book_id, chapter, chunk, \"offset\", length(text) chars, sha256(text) h from ck",
    "lines_with_offsets": f"with {_L} select book_id, line_no, \"offset\", length(line) n from o",
    "paragraphs_with_offsets": f"with {_PA} select book_id, line_no, \"offset\", sha256(text) h from p",
    "paragraphs_in_chapters": f"with {_PC} select book_id, line_no, chapter, length(text) n from pc",
    "title_lines": f"with {_DT} select book_id, chapter, line_no from dt where is_title",
    "edge_lines": f"with {_ED} select book_id, chapter, line_no, text from ed where edge",
    "author_notes": f"with {_DT}, m as (select *, ({' or '.join(f'regexp_matches(text, {chr(39)}{x}{chr(39)})' for x in [*K.AUTHOR_NOTES, '^Share this', '^Enjoying the story', '^求推荐票'])}) m, row_number() over (partition by book_id, chapter order by line_no) - 1 p, count(*) over (partition by book_id, chapter) n from lv), t as (select *, max((m and p >= n - greatest(3, n // 5))::int) over (partition by book_id, chapter order by line_no rows unbounded preceding) = 1 as tail from m) select book_id, chapter, line_no from t where m or tail",
    "promo_clean_stats": f"with l as (select doc_id, unnest(string_split(text, chr(10))) line from documents), p as (select doc_id, trim(line, '{_W}') t from l where trim(line, '{_W}') <> ''), c as (select doc_id, t, ({_PROMO}) hit, {_spaces(_CUT)} cut from p), g as (select *, hit and (length(t) <= 60 or cut = '') gone from c) select doc_id, sum(length(t))::bigint chars_in, coalesce(sum(case when gone then 0 when hit then length(cut) else length(t) end), 0)::bigint chars_out, count(*) filter (gone) dropped, count(*) filter (hit and not gone) rewritten from g group by 1",
    "normalised_paragraphs": f"with {_PA} select book_id, line_no, sha256({_normal("replace(text, 'coins', 'pennies')")}) h from p",
    "chapter_ranges": f"with {_CH} select ch.book_id, idx, char_offset as start, coalesce(lead(char_offset) over (partition by ch.book_id order by idx), length(flat_text)) as stop from ch join epub_books e on e.book_id = ch.book_id",
    "chapter_slices": f"with {_CH}, r as (select ch.book_id, idx, flat_text, char_offset a, coalesce(lead(char_offset) over (partition by ch.book_id order by idx), length(flat_text)) b from ch join epub_books e on e.book_id = ch.book_id) select book_id, idx, length(substring(flat_text, a + 1, greatest(b - a, 0))) n, sha256(substring(flat_text, a + 1, greatest(b - a, 0))) h from r",
    "byte_offsets": f"with {_CH} select ch.book_id, idx, strlen(substring(flat_text, 1, char_offset)) byte_offset from ch join epub_books e on e.book_id = ch.book_id",
    "search_hits": f"with {_H} select book_id, \"offset\" from h",
    "hit_chapters": f"with {_H}, {_CH} select h.book_id, h.\"offset\", coalesce(c.idx, f.idx, 1) chapter_idx from h asof left join ch c on h.book_id = c.book_id and h.\"offset\" >= c.char_offset left join (select book_id, min(idx) idx from ch group by 1) f on f.book_id = h.book_id",
    "search_snippets": f"with {_H}, x as (select h.book_id, h.\"offset\", flat_text t, greatest(h.\"offset\" - 36, 0) lo, least(h.\"offset\" + 45, length(flat_text)) hi from h join epub_books e on e.book_id = h.book_id) select book_id, \"offset\", (case when lo > 0 then '...' else '' end) || trim(regexp_replace(substring(t, lo + 1, hi - lo), '{_WC}+', ' ', 'g'), '{_W}') || (case when hi < length(t) then '...' else '' end) snippet from x",
    "search_page": f"with {_H}, t as (select book_id, count(*) total from h group by 1), n as (select book_id, \"offset\", row_number() over w n, lead(\"offset\") over w nx from h where \"offset\" >= 500 window w as (partition by book_id order by \"offset\")) select n.book_id, \"offset\", n, total, max(case when n = 20 then nx end) over (partition by n.book_id) next_from from n join t on t.book_id = n.book_id where n <= 20",
    "joined_offsets": "select book_id, id, coalesce(sum(length(body) + 2) over (partition by book_id order by id rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from epub_sections",
    "lost_characters": "select book_id, length(flat_text) - length(replace(flat_text, '�', '')) lost, (length(flat_text) - length(replace(flat_text, '�', ''))) * 100 > strlen(flat_text) rejected from epub_books where contains(flat_text, '�')",
}
