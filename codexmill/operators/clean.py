"""Cleaning and export: texts to paragraphs, passes that mark what goes, statistics, records and chunks.

Passes annotate rows (`dropped`, `rewritten`) instead of removing them, so the statistics are one aggregate over the
same rows. Windows run over (book, chapter) or over the lines of a book, never over the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexmill.functions import text as T

# Promotional lines and authors' notes (patterns that results must agree on), and the passes' limits.
PROMO = [
    r"(?i)(https?://|www\.)[\w.\-/?=&%#]+",
    r"(?i)[\w\-]+\.(com|net|org|cc|co|top|xyz|info|vip)(?![0-9A-Za-z_])",
    r"(更多|最新|全本|免费|无弹窗|手打)[^。！？]{0,10}(小说|章节|内容|全文|更新)[^。！？]{0,10}(尽在|请上|请到|访问|首发)",
    r"(请)?记住(本站|我们的)?(域名|网址|地址)",
    r"本(书|文|章)由[^。！？]{0,20}(整理|制作|提供|录入|校对)",
    r"(手机|移动|wap)[^。！？]{0,6}(阅读|访问|用户)[^。！？]{0,10}(请|地址|网址)",
    r"^[※*＊]?(声明|免责声明)[:：].*(电子书|下载).*(删除|正版|商业用途).*[※*＊]?\z",
    r"^[（(\[【]?(本章完|未完待续|全文完|正文完)[）)\]】]?\z",
    r"^[-—=*·~＊]{4,}\z",
]
AUTHOR_NOTES = [
    r"^[（(\[【]?(作者(有话说|的话|按)|作者君|ps|PS|Ps)[）)\]】]?[:：、]?",
    r"^(求|跪求|继续求)[^。！？]{0,12}(推荐票|月票|收藏|订阅|打赏|评论|鲜花)",
    r"^感谢[^。！？]{0,20}(打赏|月票|推荐票|订阅|捧场)",
    r"^(今天|明天|本周|下周)[^。！？]{0,10}(加更|两更|三更|爆更|请假|断更)",
    r"^(新书|老书|本书)[^。！？]{0,12}(求支持|已上传|求收藏|推荐一下)",
]
PROMO_LINE, EDGE_LINE, EDGE_CHAPTERS = 60, 40, 3
GENERIC_TITLES = ("正文", "全文", "未分章")


@dataclass
class Rules:
    """What the passes look for; every list can be extended."""

    promo: list[str] = field(default_factory=lambda: list(PROMO))
    notes: list[str] = field(default_factory=lambda: list(AUTHOR_NOTES))
    replace: list[tuple[str, str]] = field(default_factory=list)


#: Patterns whose match is decided by a shorter one (one character in front of a domain's dot is enough).
DECIDES = {PROMO[0]: r"(?i)(https?://|www\.)[\w.\-/?=&%#]", PROMO[1]: PROMO[1].replace(r"[\w\-]+", r"[\w\-]")}


def any_match(c: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found."""
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(DECIDES.get(p, p))
    return out


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 0, line, offset): every line with its offset in code points.

    Arrow's own kernels split whole batches and add up lengths, so no line has to be shuffled for its offset."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = pc.split_pattern(b.column(1), "\n")
            flat, sizes = parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
            owner, first = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
            n = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            before = np.cumsum(n) - n
            start = before[np.minimum(first, max(len(before) - 1, 0))] if len(before) else first
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), pa.array(np.arange(len(owner)) - first[owner]), flat, pa.array(before - start[owner])], [key, "line_no", "line", "offset"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.where(F.col(text).isNotNull()).select(key, text).mapInArrow(part, f"{key} {kind}, line_no long, line string, offset long")


def paragraphs(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Non-blank lines, trimmed, with the offset of their line."""
    return lines(texts, key, text).select(key, "line_no", T.btrim(F.col("line")).alias("text"), "offset").where("text <> ''")


def in_chapters(paras: DataFrame, chapters: DataFrame, key: str) -> DataFrame:
    """Each paragraph with its chapter: the last that begins at or before it, else the first; 0 without chapters.

    An as-of lookup by union and window over the book's rows, in one shuffle."""
    p = paras.select(key, "offset", F.lit(1).alias("kind"), "line_no", "text", F.lit(None).cast("long").alias("idx"), F.lit(None).cast("string").alias("title"))
    c = chapters.select(key, F.col("char_offset").alias("offset"), F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("line_no"), F.lit(None).cast("string").alias("text"), "idx", "title")
    w = Window.partitionBy(key).orderBy("offset", "kind", "line_no", "idx").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    got = p.unionByName(c).withColumns({"at": F.last(F.when(F.col("kind") == 0, F.struct("idx", "title")), True).over(w), "first": F.min(F.when(F.col("kind") == 0, F.struct("idx", "title"))).over(whole)})
    ch = F.coalesce("at", "first")
    return got.where("kind = 1").select(key, "line_no", "text", "offset", F.coalesce(ch["idx"], F.lit(0)).alias("chapter"), ch["title"].alias("title"))


def drop_titles(rows: DataFrame, key: str) -> DataFrame:
    """Marks a chapter's first paragraph where it repeats the title."""
    w = Window.partitionBy(key, "chapter").orderBy("line_no")
    hit = (F.row_number().over(w) == 1) & (F.col("text") == T.btrim(F.col("title")))
    return rows.withColumn("dropped", F.when(hit, "title"))


def drop_edges(rows: DataFrame, key: str) -> DataFrame:
    """Marks short first and last paragraphs that come back in a third of the book's chapters (3 at least).

    Rows that are marked already stay in place but count nowhere."""
    live = F.col("dropped").isNull()
    no = F.when(live, F.col("line_no"))
    w = Window.partitionBy(key, "chapter")
    out = rows.withColumns({"is_first": live & (F.col("line_no") == F.min(no).over(w)), "is_last": live & (F.col("line_no") == F.max(no).over(w)), "k": T.edge_key(F.col("text"))})
    by_key, book = Window.partitionBy(key, "k"), Window.partitionBy(key)
    out = out.withColumns({"fc": F.sum(F.col("is_first").cast("int")).over(by_key), "lc": F.sum(F.col("is_last").cast("int")).over(by_key), "nch": F.sum(F.col("is_first").cast("int")).over(book)})
    least = F.greatest(F.lit(EDGE_CHAPTERS), F.floor(F.col("nch") / 3))
    hit = live & (F.col("nch") >= EDGE_CHAPTERS) & (F.length("text") <= EDGE_LINE) & ((F.col("is_first") & (F.col("fc") >= least)) | (F.col("is_last") & (F.col("lc") >= least)))
    return out.withColumn("dropped", F.when(hit, "edge").otherwise(F.col("dropped"))).select(rows.columns)


def drop_notes(rows: DataFrame, key: str, rules: Rules) -> DataFrame:
    """Marks authors' notes: in the tail of a chapter with all that follows, elsewhere alone."""
    live = F.col("dropped").isNull()
    one = live.cast("int")
    w = Window.partitionBy(key, "chapter").orderBy("line_no")
    so_far, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(key, "chapter")
    out = rows.withColumns({"m": live & any_match(F.col("text"), rules.notes), "p": F.sum(one).over(so_far) - 1, "n": F.sum(one).over(whole)})
    tail = F.col("m") & (F.col("p") >= F.col("n") - F.greatest(F.lit(3), F.floor(F.col("n") / 5)))
    out = out.withColumn("hit", live & (F.col("m") | F.max(tail).over(so_far)))
    return out.withColumn("dropped", F.when(F.col("hit"), "note").otherwise(F.col("dropped"))).select(rows.columns)


def clean_promo(rows: DataFrame, rules: Rules) -> DataFrame:
    """Marks short promotional paragraphs; cuts the matches out of long ones."""
    t = F.col("text")
    cut = t
    for p in rules.promo:
        cut = F.regexp_replace(cut, p, "")
    # each step is a column of its own, so that patterns run once a row and cuts only where one matches
    out = rows.withColumn("_hit", F.col("dropped").isNull() & any_match(t, rules.promo))
    out = out.withColumn("_cut", F.when(F.col("_hit") & (F.length(t) > PROMO_LINE), T.spaces_export(cut)))
    hit, long = F.col("_hit"), F.coalesce(F.col("_cut"), F.lit("")) != ""
    keep = [c for c in rows.columns if c not in ("text", "dropped", "rewritten")]
    return out.select(*keep, F.when(hit & long, F.col("_cut")).otherwise(t).alias("text"), F.when(hit & ~long, "promo").otherwise(F.col("dropped")).alias("dropped"), F.when(hit & long, F.lit(1)).otherwise(F.lit(0)).alias("rewritten"))


def normalise(rows: DataFrame, rules: Rules) -> DataFrame:
    """Normal marks and spacing; a paragraph that becomes empty is marked."""
    new = T.normal_export(F.col("text"), rules.replace)
    live = F.col("dropped").isNull()
    return rows.withColumns({"_new": new}).withColumns({"rewritten": F.col("rewritten") + F.when(live & (F.col("_new") != F.col("text")) & (F.col("_new") != ""), 1).otherwise(0), "dropped": F.when(live & (F.col("_new") == ""), "empty").otherwise(F.col("dropped")), "text": F.when(live, F.col("_new")).otherwise(F.col("text"))}).drop("_new")


def clean(paras: DataFrame, key: str, rules: Rules | None = None, promo: bool = True, edges: bool = True, normal: bool = True, notes: bool = True) -> DataFrame:
    """All passes in their order over paragraphs with chapters."""
    rules = rules or Rules()
    rows = drop_titles(paras.withColumn("chars", F.length("text")), key)
    rows = drop_edges(rows, key) if edges else rows
    rows = drop_notes(rows, key, rules) if notes else rows
    rows = clean_promo(rows, rules) if promo else rows.withColumn("rewritten", F.lit(0))
    return normalise(rows, rules) if normal else rows


def stats(rows: DataFrame, key: str, texts: DataFrame, chapters: DataFrame) -> DataFrame:
    """Counters of a cleaning, one row for each book with a paragraph, by one aggregate; lost characters are those of the source."""
    live = F.col("dropped").isNull()
    n = rows.groupBy(key).agg(
        F.sum("chars").alias("chars_in"), F.coalesce(F.sum(F.when(live, F.length("text"))), F.lit(0)).alias("chars_out"), F.count_if(~live).alias("dropped"), F.sum("rewritten").alias("rewritten"),
        F.count_distinct(F.when(live, F.col("chapter"))).alias("records"),
    )
    lost = texts.select(key, (F.length("text") - F.length(F.replace(F.col("text"), F.lit("\ufffd"), F.lit("")))).alias("lost_chars"))
    ch = chapters.groupBy(key).agg(F.count("*").alias("chapters"), F.min(T.btrim(F.col("title"))).alias("only"))
    generic = (F.col("chapters") == 1) & F.col("only").isin(*GENERIC_TITLES)
    return n.join(lost, key).join(ch, key, "left").select(key, F.coalesce("chapters", F.lit(0)).alias("chapters"), "chars_in", "chars_out", "dropped", "rewritten", "records", "lost_chars", F.coalesce(generic, F.lit(False)).alias("generic_structure"))


SCHEMA_VERSION = 1


def records(rows: DataFrame, key: str, texts: DataFrame, chapters: DataFrame, meta: DataFrame, anonymous: bool = False) -> DataFrame:
    """One record for each chapter that has text left: ids by the source's hash, hashes of the cleaned text and of its source, warnings."""
    body = rows.where("dropped is null").groupBy(key, "chapter").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("ps"), F.max("title").alias("title"), F.min("offset").alias("offset"))
    body = body.select(key, "chapter", "title", "offset", F.array_join(F.transform("ps", lambda x: x["text"]), "\n\n").alias("text"))
    own = slices(texts, chapters, key)
    src = own.select(key, F.col("idx").alias("chapter"), "doc_hash", F.sha2("slice", 256).alias("source_sha256"), F.col("slice").contains("\ufffd").alias("lost"))
    out = body.join(src, [key, "chapter"]).join(meta, key, "left")
    cid = T.chapter_id(F.col("chapter"))
    doc = F.concat(F.lit("sha256:"), F.col("doc_hash"))
    name = F.concat(F.lit("document-"), F.substring("doc_hash", 1, 12)) if anonymous else F.coalesce("book", F.lit(""))
    return out.select(
        key, F.concat(doc, F.lit("/"), cid).alias("id"), doc.alias("document_id"), cid.alias("chapter_id"), F.col("chapter").alias("chapter_index"), (cid if anonymous else F.coalesce("title", F.lit(""))).alias("title"), "text",
        name.alias("book"), (F.lit("") if anonymous else F.coalesce("author", F.lit(""))).alias("author"), F.when(F.col("lost"), F.array(F.lit("replacement_character"))).alias("warnings"),
        "offset", F.length("text").cast("long").alias("chars"), "source_sha256", F.sha2("text", 256).alias("cleaned_sha256"),
    )


def ranges(chapters: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """Chapters as [start, stop): to the next chapter or the end of the text."""
    nxt = F.lead("char_offset").over(Window.partitionBy(key).orderBy("idx"))
    return chapters.join(totals, key).select(key, "idx", "title", F.col("char_offset").alias("start"), F.coalesce(nxt, F.col("n")).alias("stop"))


def slices(texts: DataFrame, chapters: DataFrame, key: str) -> DataFrame:
    """(key, idx, slice, doc_hash): the source text of each chapter and the hash of the whole; texts go through the shuffle once, as arrays of ranges come to them."""
    w = Window.partitionBy(key).orderBy("idx")
    r = chapters.withColumn("stop", F.lead("char_offset").over(w)).groupBy(key).agg(F.collect_list(F.struct("idx", F.col("char_offset").alias("start"), "stop")).alias("r"))
    got = texts.select(key, F.col("text").alias("_t")).join(r, key).select(key, "_t", F.sha2("_t", 256).alias("doc_hash"), F.explode("r").alias("r"))
    stop = F.coalesce(F.col("r.stop"), F.length("_t").cast("long"))
    return got.select(key, F.col("r.idx").alias("idx"), F.substring(F.col("_t"), (F.col("r.start") + 1).cast("int"), F.greatest(stop - F.col("r.start"), F.lit(0)).cast("int")).alias("slice"), "doc_hash")


# Fixed value: what ends a sentence, with what closes behind it.
SENTENCE = "[。！？…][」』】）\"']*"


def packed(lengths: Column, target: int) -> Column:
    """Array of (first, count) of the greedy chunks of an array of lengths: a chunk is closed before the length that would lead beyond the target. Only numbers leave the JVM; time is linear."""

    def run(column: pd.Series) -> pd.Series:
        out = []
        for ns in column:
            chunks, size = [], 0
            for i, n in enumerate(ns.tolist()):
                if not chunks or (size > 0 and size + n > target):
                    chunks.append([i, 0])
                    size = 0
                chunks[-1][1] += 1
                size += n
            out.append([{"first": a, "count": c} for a, c in chunks])
        return pd.Series(out)

    run.__annotations__ = {"column": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<struct<first:int,count:int>>")(lengths)


def sentences(text: Column, target: int) -> Column:
    """Pieces of an oversized paragraph: cut behind the first sentence end at which a piece has reached the target; trimmed."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def join_up(a, s):
        cur = F.concat(a["cur"], s)
        full = F.length(cur) >= target
        return F.struct(F.when(full, F.concat(a["out"], F.array(T.btrim(cur)))).otherwise(a["out"]).alias("out"), F.when(full, F.lit("")).otherwise(cur).alias("cur"))

    parts = F.regexp_extract_all(text, F.lit(f"(?s).*?{SENTENCE}|.+"), F.lit(0))
    whole = F.aggregate(parts, start, join_up, lambda a: F.concat(a["out"], F.filter(F.array(T.btrim(a["cur"])), lambda x: x != "")))
    return F.when(text.rlike(SENTENCE), whole).otherwise(F.array(text))


def chunks(rows: DataFrame, key: str, target: int) -> DataFrame:
    """Paragraphs of each chapter packed greedily to pieces of at most `target` characters, oversized paragraphs cut at sentence ends first; `chars` counts the joined text, with its blank lines.

    One shuffle brings a chapter's paragraphs together; the packing sees their lengths only."""
    live = rows.where("dropped is null")
    pieces = live.select(key, "chapter", "title", "line_no", "offset", F.posexplode(F.when(F.length("text") <= target, F.array("text")).otherwise(sentences(F.col("text"), target))).alias("part", "piece"))
    g = pieces.groupBy(key, "chapter").agg(F.max("title").alias("title"), F.sort_array(F.collect_list(F.struct("line_no", "part", "offset", "piece"))).alias("ps"))
    g = g.withColumn("cs", packed(F.transform("ps", lambda p: F.length(p["piece"])), target))
    out = g.select(key, "chapter", "title", "ps", F.posexplode("cs").alias("chunk", "c")).withColumn("own", F.slice("ps", F.col("c.first") + 1, F.col("c.count")))
    text = F.array_join(F.transform("own", lambda p: p["piece"]), "\n\n")
    return out.select(key, "chapter", "chunk", "title", F.col("own")[0]["offset"].alias("offset"), F.length(text).cast("long").alias("chars"), text.alias("text"))


def to_jsonl(rows: DataFrame, passes: dict[str, bool] | None = None) -> DataFrame:
    """One JSON text for each record; an empty author and missing warnings are left out; line separators of Unicode are escaped."""
    on = {"promo": True, "edge_lines": True, "normalise": True, "author_notes": True, "anonymized": False} | (passes or {})
    meta = F.struct("book", F.nullif("author", F.lit("")).alias("author"))
    report = F.struct(*[F.lit(v).alias(k) for k, v in on.items()], "warnings")
    value = F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), "id", "document_id", "chapter_id", "chapter_index", "title", "text", meta.alias("metadata"), report.alias("cleaning"), "offset", "chars", "source_sha256", "cleaned_sha256"))
    for c in "\u2028\u2029":
        value = F.replace(value, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return rows.select(value.alias("value"))


def write_corpus(rows: DataFrame, path: str) -> None:
    """JSON lines of records; nothing is written if a title, text, book or author has a replacement character."""
    bad = F.lit(False)
    for c in ("title", "text", "book", "author"):
        bad = bad | F.coalesce(F.col(c).contains("\ufffd"), F.lit(False))
    if rows.where(bad).limit(1).count():
        raise ValueError("a record holds a replacement character")
    to_jsonl(rows).write.mode("overwrite").text(path)
