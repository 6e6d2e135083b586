"""Plain texts to canonical paragraphs: the convention is inferred per text, lines are joined, glued headings split off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexmill.functions import text as T
from codexmill.operators.chapters import BRACKETED, NUMERAL
from codexmill.operators.clean import lines

# Characters that end a sentence, sampling limits, what a heading may follow, subtitle shapes.
TERMINATORS = "。！？…」』”’）.!?)"
SAMPLE_LINES, SAMPLE_ENDS, META_LINES = 100, 50, 30
UNIT = "[章节回卷篇集部折]"
SYMMETRIC = r"(?:\p{IsHan}{4}，\p{IsHan}{4}|\p{IsHan}{5}，\p{IsHan}{5}|\p{IsHan}{3}，\p{IsHan}{3})"
UNKNOWN_AUTHOR = "佚名"
#: A character that no text holds, between pieces.
MARK = ""


def conventions(rows: DataFrame, key: str) -> DataFrame:
    """(key, indented, terminated) from the first lines of each text.

    Input: lines with line_no. Indented: more than half of the paragraph starts (after blank lines, where there are
    any, else of all lines) begin with white space. Terminated: more than half of the lines end a sentence."""
    w = Window.partitionBy(key).orderBy("line_no")
    c = rows.withColumn("c", F.regexp_replace("line", "\\r+\\z", ""))
    c = c.withColumns({"full": (F.col("c") != "").cast("int"), "prev": F.coalesce(F.lag("c").over(w), F.lit("")), "indent": F.col("c").rlike("^[ \\t\\u3000\\u00a0]").cast("int")})
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumns({"nth": F.sum("full").over(run), "is_start": F.col("full") * (F.col("prev") == "").cast("int")})
    s = c.where((F.col("full") == 1) & (F.col("nth") <= SAMPLE_LINES))
    i = s.groupBy(key).agg(F.sum("is_start").alias("starts"), F.sum(F.col("is_start") * F.col("indent")).alias("s_ind"), F.count("*").alias("n"), F.sum("indent").alias("n_ind"))
    i = i.select(key, F.when(F.col("starts") > 1, F.col("s_ind") * 2 > F.col("starts")).otherwise(F.col("n_ind") * 2 > F.col("n")).alias("indented"))
    e = rows.withColumn("c", F.rtrim(F.regexp_replace("line", "[\\r \\t\\u3000]+\\z", ""))).where("c <> ''")
    e = e.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= SAMPLE_ENDS)
    e = e.groupBy(key).agg((F.avg(F.substring("c", -1, 1).isin(*TERMINATORS).cast("int")) > 0.5).alias("terminated"))
    return i.join(e, key, "full_outer").select(key, F.coalesce("indented", F.lit(False)).alias("indented"), F.coalesce("terminated", F.lit(False)).alias("terminated"))


def logical_lines(rows: DataFrame, conv: DataFrame, key: str) -> DataFrame:
    """Lines joined to paragraphs: in indented texts, a line without an indent goes on with the paragraph before it."""
    w = Window.partitionBy(key).orderBy("line_no")
    c = rows.join(conv, key).withColumn("c", F.regexp_replace("line", "\\r\\z", ""))
    begins = ~F.col("indented") | F.col("c").rlike("^[ \\t\\u3000\\u00a0]") | (F.coalesce(F.lag("c").over(w), F.lit("")) == "")
    c = c.withColumn("begins", begins.cast("int")).where("c <> ''")
    c = c.withColumn("para", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = c.groupBy(key, "para").agg(F.sort_array(F.collect_list(F.struct("line_no", "c"))).alias("ls"), F.first("indented").alias("indented"), F.first("terminated").alias("terminated"))
    return g.select(key, "para", "indented", "terminated", F.array_join(F.transform("ls", lambda x: x["c"]), "").alias("text"))


def split_headings(c: Column) -> Column:
    """Array of pieces: headings glued into a paragraph begin a piece, and a heading with its symmetric subtitle ends one."""
    heading = rf"第\s*{NUMERAL}+\s*{UNIT}|(?:Chapter|CHAPTER)\s+[0-9]+"
    c = F.regexp_replace(c, rf"(?<=[」』）)。！？.!?…”’])(?={heading}|[（(]\s*{NUMERAL}+\s*[）)])", MARK)
    c = F.regexp_replace(c, rf"(?<=.)(?<!{MARK})(?=[「『【〈\[]\s*{NUMERAL}+\s*[」』】〉\]）)])", MARK)
    title = rf"^([\s\p{{Zs}}]*(?:第\s*{NUMERAL}+\s*{UNIT}[\s\p{{Zs}}]*{SYMMETRIC}(?:（[^）\r\n]{{1,6}}）)?|{BRACKETED}|{NUMERAL}{{1,4}}\s*、\s*{SYMMETRIC}))(?s:(.{{3,}}))\z"
    pieces = F.split(c, MARK)
    return F.flatten(F.transform(pieces, lambda p: F.when(p.rlike(title), F.array(F.regexp_extract(p, title, 1), F.regexp_extract(p, title, 2))).otherwise(F.array(p))))


def tidy(c: Column) -> Column:
    """A piece without tags; volume headings in one form; one wide space between a heading's number and its title."""
    c = T.btrim(T.strip_tags(T.btrim(c)))
    c = F.regexp_replace(c, rf"^([\s\p{{Zs}}]*)卷\s*({NUMERAL}+)", "$1第$2卷")
    return F.regexp_replace(c, rf"^([\s\p{{Zs}}]*第\s*{NUMERAL}+\s*{UNIT})[\s\p{{Zs}}]*(\p{{IsHan}})", "$1　$2")


def is_metadata(c: Column, title: Column, author: Column) -> Column:
    """Whether a paragraph is nothing but the title, the author, or both."""
    title, author = F.coalesce(title, F.lit("")), F.coalesce(author, F.lit(""))
    has_title = (title != "") & c.startswith(title)
    rest = F.when(has_title, F.regexp_replace(F.substring(c, F.length(title) + 1, F.length(c)), "^[ \\t\\u3000]+", "")).otherwise(c)
    rest = F.regexp_replace(F.regexp_replace(rest, "^(?i)(by\\s*[:：]|author\\s*[:：]|作者\\s*[:：]|[:：])", ""), "^[ \\t\\u3000]+", "")
    return (has_title & (rest == "")) | ((author != "") & (rest == author))


def detect_metadata(rows: DataFrame, key: str) -> DataFrame:
    """(key, title, author) of the first of the first lines that names an author."""
    by, label = r"(?i)^(.*?)(?<![0-9A-Za-z_])by\s*[:：]\s*([^\r\n]+?)\s*\z", r"^([^\r\n]{0,30}?)作者\s*[:：]\s*([^\r\n，。！？,.!?\s]{1,16})\s*\z"
    t = T.btrim(F.col("line"))
    found = rows.where(F.col("line_no") < META_LINES).withColumn("t", t).where(F.col("t").rlike(by) | F.col("t").rlike(label))
    pick = lambda g: F.when(F.col("t").rlike(by), F.regexp_extract("t", by, g)).otherwise(F.regexp_extract("t", label, g))
    best = F.min_by(F.struct(T.btrim(pick(1)).alias("title"), T.btrim(pick(2)).alias("author")), "line_no")
    return found.groupBy(key).agg(best.alias("m")).select(key, "m.title", "m.author")


def resolve_metadata(found: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Title and author: from the text, else from the file name, else unknown."""
    ft, fa = T.filename_meta(F.col("file"))
    j = files.join(found, key, "left")
    return j.select(key, F.coalesce(F.nullif("title", F.lit("")), F.nullif(ft, F.lit(""))).alias("title"), F.coalesce(F.nullif("author", F.lit("")), F.nullif(fa, F.lit("")), F.lit(UNKNOWN_AUTHOR)).alias("author"))


def format_texts(texts: DataFrame, key: str, text: str, meta: DataFrame | None = None) -> DataFrame:
    """Canonical texts: paragraphs apart by a blank line, one line feed at the end; texts of neither convention stay as they are."""
    rows = lines(texts, key, text)
    conv = conventions(rows, key)
    paras = logical_lines(rows, conv.where("indented or terminated"), key)
    pieces = paras.select(key, "para", F.posexplode(split_headings(F.col("text"))).alias("i", "p")).withColumn("p", tidy(F.col("p"))).where("p <> ''")
    if meta is not None:
        pieces = pieces.join(meta.select(key, F.col("title").alias("_ti"), F.col("author").alias("_au")), key, "left").where(~F.coalesce(is_metadata(F.col("p"), F.col("_ti"), F.col("_au")), F.lit(False)))
    g = pieces.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("para", "i", "p"))).alias("ps"))
    new = g.select(key, F.concat(F.array_join(F.transform("ps", lambda x: x["p"]), "\n\n"), F.lit("\n")).alias("_new"))
    return texts.join(new, key, "left").select(key, F.coalesce("_new", F.col(text)).alias(text))
