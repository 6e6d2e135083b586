"""Chapter structure and formatting over whole tables; the rules' matches have SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexmill.functions import text as T
from codexmill.operators import chapters as C
from codexmill.operators import format as M
from codexmill.operators.clean import lines
from codexmill.session import table, texts


def _texts(spark, d):
    return texts(spark, d, "epub_books").select("book_id", F.col("flat_text").alias("text"))


def rule_matches(spark, d):
    """SET-01: lines against the registry of heading rules."""
    names = F.array(*[F.lit(r.name) for r in C.RULES])
    return C.matches(_texts(spark, d), "book_id", "text").select("book_id", "line_no", "offset", F.element_at(names, F.col("rule_no") + 1).alias("rule"), "title")


def rule_scores(spark, d):
    """AGG-08..10, WIN-05."""
    return C.scores(C.matches(_texts(spark, d), "book_id", "text"), "book_id").select("book_id", "rule_no", "n", F.round("ratio", 6).alias("ratio"), F.round("score", 6).alias("score"))


def rule_selection(spark, d):
    """AGG-08: the rules that win in each book."""
    return C.kept_rules(C.scores(C.matches(_texts(spark, d), "book_id", "text"), "book_id"), "book_id")


def detected_chapters(spark, d):
    """UDF-02, WIN-06, WIN-12, SRT-13: chapters found in the texts."""
    return C.detect(_texts(spark, d), "book_id", "text")


def chapter_levels(spark, d):
    """WIN-12: depth by open headings, over the stored chapters (their levels as ranks)."""
    ch = table(spark, d, "chapters").distinct().select("book_id", F.col("char_offset").alias("offset"), "title", F.greatest(F.least("level", F.lit(2)), F.lit(0)).alias("rank"))
    return C.depth(ch.groupBy("book_id", "offset").agg(F.min("title").alias("title"), F.min("rank").alias("rank")), "book_id").select("book_id", "idx", "level", "offset")


def contents_runs(spark, d):
    """WIN-10, WIN-11, AGG-18."""
    ch = table(spark, d, "chapters").distinct().select("book_id", "idx", "title", "level", F.col("char_offset").alias("offset"))
    return C.contents_runs(ch, _texts(spark, d), "book_id", "text").select("book_id", "idx", "hollow", "fate")


def stripped_contents(spark, d):
    """WIN-11: the texts without contents lists, chapters renumbered."""
    return C.strip_contents(detected_chapters(spark, d), _texts(spark, d), "book_id", "text")[1]


def chapter_numbers(spark, d):
    """STRF-22."""
    return table(spark, d, "chapters").distinct().select("id", T.chapter_number(F.col("title")).alias("number"))


def conventions(spark, d):
    """AGG-11, AGG-12."""
    return M.conventions(lines(texts(spark, d, "documents").select("doc_id", "text"), "doc_id", "text"), "doc_id")


def formatted_texts(spark, d):
    """STRF-01..06, WIN-16."""
    t = texts(spark, d, "documents").select("doc_id", "text", "title", "author")
    return M.format_texts(t.select("doc_id", "text"), "doc_id", "text", t.select("doc_id", "title", "author")).select("doc_id", F.sha2("text", 256).alias("h"), F.length("text").alias("n"))


def detected_metadata(spark, d):
    """STRF-08, STRF-09: author lines of the documents, resolved against a file name."""
    t = texts(spark, d, "documents")
    found = M.detect_metadata(lines(t.select("doc_id", "text"), "doc_id", "text"), "doc_id")
    files = t.select("doc_id", F.concat(F.coalesce("title", F.lit("untitled")), F.lit(" - "), F.coalesce("author", F.lit("")), F.lit(".txt")).alias("file"))
    return M.resolve_metadata(found, files, "doc_id")


OWN = r"^(?:Chapter|Kapitel|Chapitre) [0-9]+: (.*)$"


def chapters_by_pattern(spark, d):
    """UDF-01: one pattern of the caller's own."""
    return C.by_pattern(_texts(spark, d), "book_id", "text", OWN)


def number_forms(spark, d):
    """STRF-22 over every chapter number as headings write it, in digits and in Chinese numerals."""
    n = F.col("idx").cast("int")
    han = lambda c: F.translate(c.cast("string"), "0123456789", "零一二三四五六七八九")
    forms = F.array(F.concat(F.lit("Chapter "), n.cast("string"), F.lit(": x")), F.concat(F.lit("第"), han(n % 10), F.lit("十"), han(F.floor(n / 10) % 10), F.lit("章")), F.concat(F.lit("【"), han(n % 10), F.lit("万"), han(n % 7), F.lit("千零"), han(n % 9), F.lit("】")), F.concat(F.lit("十"), han(n % 10), F.lit("、x")), F.concat(n.cast("string"), F.lit("零")), F.lit("序章"), F.lit("chapter 0"))
    rows = table(spark, d, "chapters").select("idx").distinct().select("idx", F.posexplode(forms).alias("form", "title"))
    return rows.select("idx", "form", "title", T.chapter_number(F.col("title")).alias("number"))


_N = [rule_matches, rule_scores, rule_selection, detected_chapters, chapter_levels, contents_runs, stripped_contents, chapter_numbers, conventions, formatted_texts, detected_metadata, number_forms, chapters_by_pattern]
QUERIES = {f.__name__: f for f in _N}

_W = T.WHITE.replace("'", "''")
_RE2 = [(r.name, r.pattern.replace("\\z", "$")) for r in C.RULES]
_ROWS = " union all ".join(f"select book_id, line_no, off, '{n}' as rule, {i} rule_no, trim(regexp_extract(t, '{p}', 1), '{_W}') title from s where regexp_matches(t, '{p}')" for i, (n, p) in enumerate([*_RE2, ("loose", C.LOOSE.replace("\\z", "$"))]))
_CN = "0-9零〇一二三四五六七八九十百千万"


def _number(t: str) -> str:
    """The number of a heading in SQL: a fold over its numerals."""
    run = f"case when starts_with(lower(trim({t}, '{_W}')), 'chapter') then regexp_extract(trim({t}, '{_W}'), '^(?i:chapter)[ \\t]*([{_CN}]+)', 1) else regexp_extract(trim({t}, '{_W}'), '^第?[ \\t　]*「?『?【?〈?\\[?（?\\(?([{_CN}]+)', 1) end"
    digit = "greatest(instr('零一二三四五六七八九', b.c) - 1, 0)"
    unit = "case b.c when '十' then 10 when '百' then 100 when '千' then 1000 else 10000 end"
    fold = f"list_reduce(list_prepend({{'t': 0::bigint, 'g': 0::bigint, 'z': true, 'c': ''}}, list_transform(string_split({run}, ''), lambda x: {{'t': 0::bigint, 'g': 0::bigint, 'z': true, 'c': x}})), lambda a, b: case when b.c in ('十', '百', '千', '万') then {{'t': (a.t + (case when a.g = 0 and a.z then 1 else a.g end) * {unit})::bigint, 'g': 0::bigint, 'z': false, 'c': ''}} else {{'t': a.t, 'g': ({digit})::bigint, 'z': {digit} = 0, 'c': ''}} end)"
    return f"(case when {run} = '' then null when regexp_matches({run}, '^[0-9]+$') then try_cast({run} as bigint) when regexp_matches({run}, '[0-9]') then null else nullif({fold}.t + {fold}.g, 0) end)"


_RM = f"l as (select book_id, generate_subscripts(string_split(flat_text, chr(10)), 1) - 1 line_no, unnest(string_split(flat_text, chr(10))) line from epub_books), o as (select *, coalesce(sum(length(line) + 1) over (partition by book_id order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint off from l), s as (select book_id, line_no, off, trim(line, '{_W}') t from o where trim(line, '{_W}') <> ''), r as ({_ROWS})"
_BY, _LABEL = "(?i)^(.*?)\\bby\\s*[:：]\\s*([^\\r\\n]+?)\\s*$", "^([^\\r\\n]{0,30}?)作者\\s*[:：]\\s*([^\\r\\n，。！？,.!?\\s]{1,16})\\s*$"
_RULES = ", ".join(f"({i}, {r.rank}, {r.trusted}, {r.least})" for i, r in enumerate(C.RULES))
_SC = f"{_RM}, nu as (select *, {_number('title')} num from r where rule <> 'loose'), st as (select book_id, rule_no, avg((num = pv + 1)::int) ratio from (select *, lag(num) over (partition by book_id, rule_no order by off) pv from nu where num is not null) where pv is not null group by 1, 2), sc as (select n.book_id, n.rule_no, n.n, coalesce(ratio, 1.0) ratio, n.n * (0.3 + 0.7 * coalesce(ratio, 1.0)) score from (select book_id, rule_no, count(*) n from nu group by 1, 2) n left join st on st.book_id = n.book_id and st.rule_no = n.rule_no)"
_KR = f"{_SC}, ru as (select * from (values {_RULES}) v(rule_no, rank, trusted, least)), sw as (select sc.*, rank, trusted, least, max(case when not trusted then score end) over (partition by book_id, rank) best, sum(case when trusted then n else 0 end) over (partition by book_id, rank) trust from sc join ru on ru.rule_no = sc.rule_no), kp as (select *, sum(n) over (partition by book_id, rank) total from sw where trusted or (n >= least and score >= greatest(best * 0.5, trust))), kr as (select book_id, rule_no, rank from kp where total >= case rank when 2 then 1 else 2 end)"
_DC = f"{_KR}, gd as (select r.book_id, off, r.rule_no, title, rank from r join kr on kr.book_id = r.book_id and kr.rule_no = r.rule_no), lf as (select book_id, count(*) n from (select book_id, off, arg_min(rank, rule_no) rank from gd group by 1, 2) where rank = 2 group by 1), lo as (select book_id, off, rule_no, title, 2 rank from r where rule = 'loose' and book_id in (select book_id from r where rule = 'loose' group by 1 having count(*) >= 2) and book_id not in (select book_id from lf where n >= 3)), me as (select book_id, off, arg_min(title, rule_no) title, arg_min(rank, rule_no) rank from (select * from gd union all select * from lo) group by 1, 2), al as (select * from me union all select book_id, 0, '正文', 2 from epub_books where book_id not in (select book_id from me)), nx as (select *, row_number() over (partition by book_id order by off) idx from al), dl as (select *, coalesce(max(case when rank = 0 then idx end) over w, -1) l0, coalesce(max(case when rank = 1 then idx end) over w, -1) l1 from nx window w as (partition by book_id order by off rows between unbounded preceding and 1 preceding)), dc as (select book_id, idx, title, (case rank when 0 then 0 when 1 then (l0 >= 0)::int else (l0 >= 0)::int + (l1 > l0)::int end)::int as level, off from dl)"
_WCS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in T.WHITE) + "]"
SQL = {
    "chapters_by_pattern": f"with l as (select book_id, generate_subscripts(string_split(flat_text, chr(10)), 1) - 1 line_no, unnest(string_split(flat_text, chr(10))) line from epub_books), o as (select *, coalesce(sum(length(line) + 1) over (partition by book_id order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint off, trim(line, '{_W}') t from l), m as (select book_id, off, coalesce(nullif(trim(regexp_extract(t, '{OWN}', 1), '{_W}'), ''), t) title from o where regexp_matches(t, '{OWN}') union all select book_id, 0, '正文' from epub_books where book_id not in (select book_id from o where regexp_matches(t, '{OWN}'))) select book_id, row_number() over (partition by book_id order by off) idx, title, 0 as level, off as \"offset\" from m",
    "rule_matches": f"with {_RM} select book_id, line_no, off as \"offset\", rule, title from r where rule <> 'loose'",
    "rule_scores": f"with {_SC} select book_id, rule_no, n, round(ratio, 6) ratio, round(score, 6) score from sc",
    "rule_selection": f"with {_KR} select * from kr",
    "detected_chapters": f"with {_DC} select book_id, idx, title, level, off as \"offset\" from dc",
    "stripped_contents": f"""with {_DC}, rr as (select dc.*, coalesce(lead(off) over (partition by dc.book_id order by idx), length(flat_text)) b, flat_text from dc join epub_books e on e.book_id = dc.book_id where flat_text is not null),
hh as (select *, substring(flat_text, off + 1, b - off) s, case when contains(substring(flat_text, off + 1, b - off), chr(10)) then length(regexp_replace(regexp_extract(substring(flat_text, off + 1, b - off), '(?s)^[^\\n]*\\n(.*)$', 1), '{_WCS}', '', 'g')) else 0 end <= 40 hollow from rr),
ii as (select *, count(*) over (partition by book_id) n, sum(hollow::int) over (partition by book_id) nh, row_number() over (partition by book_id order by idx) - row_number() over (partition by book_id, hollow order by idx) g from hh),
jj as (select *, count(*) over (partition by book_id, hollow, g) rn, lead(level) over (partition by book_id, hollow, g order by idx) nl from ii), kk as (select *, max(case when level < nl then idx end) over (partition by book_id, hollow, g) wider from jj),
ff as (select *, case when not (hollow and rn >= 4 and n >= 4 and nh <= n * 0.8) then 'keep' when idx = wider then 'divider' else 'drop' end fate from kk),
pp as (select *, case fate when 'keep' then b - off when 'divider' then length(regexp_extract(s, '^[^\\n]*')) + contains(s, chr(10))::int else 0 end len, min(off) over (partition by book_id) front from ff),
oo as (select *, front + coalesce(sum(len) over (partition by book_id order by idx rows between unbounded preceding and 1 preceding), 0) o from pp)
select book_id, row_number() over (partition by book_id order by idx) idx, title, level, o::bigint as \"offset\" from oo where fate <> 'drop'""",
    "chapter_numbers": f"select id, {_number('title')} number from (select distinct * from chapters)",
    "number_forms": f"with f as (select distinct idx, idx % 10 a, (idx // 10) % 10 b, idx % 7 c, idx % 9 e from chapters), h as (select *, '零一二三四五六七八九' z from f), t as (select idx, unnest(range(7))::int form, unnest(['Chapter ' || idx || ': x', '第' || substring(z, a + 1, 1) || '十' || substring(z, b + 1, 1) || '章', '【' || substring(z, a + 1, 1) || '万' || substring(z, c + 1, 1) || '千零' || substring(z, e + 1, 1) || '】', '十' || substring(z, a + 1, 1) || '、x', idx || '零', '序章', 'chapter 0']) title from h) select idx, form, title, {_number('title')} number from t",
    "detected_metadata": f"""with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 no, trim(unnest(string_split(text, chr(10))), '{_W}') t from documents),
m as (select *, regexp_matches(t, '{_BY}') is_by from l where no < 30 and (regexp_matches(t, '{_BY}') or regexp_matches(t, '{_LABEL}'))),
g as (select doc_id, arg_min(case when is_by then trim(regexp_extract(t, '{_BY}', 1), '{_W}') else trim(regexp_extract(t, '{_LABEL}', 1), '{_W}') end, no) ti, arg_min(case when is_by then trim(regexp_extract(t, '{_BY}', 2), '{_W}') else trim(regexp_extract(t, '{_LABEL}', 2), '{_W}') end, no) au from m group by 1),
f as (select doc_id, coalesce(title, 'untitled') || ' - ' || coalesce(author, '') stem from documents)
select f.doc_id, coalesce(nullif(ti, ''), nullif(trim(regexp_extract(stem, '(?s)^(.*) - (.*)$', 1), '{_W}'), '')) title, coalesce(nullif(au, ''), nullif(trim(regexp_extract(stem, '(?s)^(.*) - (.*)$', 2), '{_W}'), ''), '佚名') author from f left join g on g.doc_id = f.doc_id""",
    "chapter_levels": "with c as (select book_id, char_offset o, min(greatest(least(level, 2), 0)) r from (select distinct * from chapters) group by 1, 2), n as (select *, row_number() over (partition by book_id order by o) idx from c), x as (select *, coalesce(max(case when r = 0 then idx end) over w, -1) l0, coalesce(max(case when r = 1 then idx end) over w, -1) l1 from n window w as (partition by book_id order by o rows between unbounded preceding and 1 preceding)) select book_id, idx, (case r when 0 then 0 when 1 then (l0 >= 0)::int else (l0 >= 0)::int + (l1 > l0)::int end) as level, o as \"offset\" from x",
    "conventions": "with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) no, unnest(string_split(text, chr(10))) line from documents), c as (select *, rtrim(line, chr(13)) c from l), d as (select *, coalesce(lag(c) over (partition by doc_id order by no), '') pv, (c <> '')::int f, regexp_matches(c, '^[ \\t\\x{3000}\\x{a0}]')::int ind from c), e as (select *, sum(f) over (partition by doc_id order by no rows unbounded preceding) nth, f * (pv = '')::int st from d), i as (select doc_id, case when sum(st) > 1 then sum(st * ind) * 2 > sum(st) else sum(ind) * 2 > count(*) end indented from e where f = 1 and nth <= 100 group by 1), t as (select *, row_number() over (partition by doc_id order by no) k from (select doc_id, no, rtrim(line, chr(13) || ' ' || chr(9) || '　') c from l) where c <> ''), u as (select doc_id, avg((contains('。！？…」』”’）.!?)', right(c, 1)))::int) > 0.5 terminated from t where k <= 50 group by 1) select coalesce(i.doc_id, u.doc_id) doc_id, coalesce(indented, false) indented, coalesce(terminated, false) terminated from i full join u on u.doc_id = i.doc_id",
    "contents_runs": f"with ch as (select distinct book_id, idx, title, level, char_offset o from chapters), r as (select ch.*, coalesce(lead(o) over (partition by ch.book_id order by idx), length(flat_text)) b, flat_text from ch join epub_books e on e.book_id = ch.book_id), h as (select *, case when contains(substring(flat_text, o + 1, b - o), chr(10)) then length(regexp_replace(regexp_extract(substring(flat_text, o + 1, b - o), '(?s)^[^\\n]*\\n(.*)$', 1), '[{''.join(f'{chr(92)}x{{{ord(c):x}}}' for c in T.WHITE)}]', '', 'g')) else 0 end <= 40 hollow from r), i as (select *, count(*) over (partition by book_id) n, sum(hollow::int) over (partition by book_id) nh, row_number() over (partition by book_id order by idx) - row_number() over (partition by book_id, hollow order by idx) g from h), j as (select *, count(*) over (partition by book_id, hollow, g) rn, lead(level) over (partition by book_id, hollow, g order by idx) nl from i), k as (select *, max(case when level < nl then idx end) over (partition by book_id, hollow, g) wider from j) select book_id, idx, hollow, case when not (hollow and rn >= 4 and n >= 4 and nh <= n * 0.8) then 'keep' when idx = wider then 'divider' else 'drop' end fate from k",
}
