"""Text expressions, cleaning passes, chapters and formatting against expected values and brute force."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from codexmill.functions import text as T
from codexmill.operators import chapters as C
from codexmill.operators import clean as K
from codexmill.operators import format as M
from codexmill.operators import search as S


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s")).alias("r")).first().r


@pytest.mark.parametrize(
    "raw, want",
    [("等等。。。。", "等等……"), ("好！！！！", "好！"), ("好！！", "好！！"), ("他,说:好!", "他，说：好！"), ("他说「好」 我走", "他说「好」我走"), ("“好” 我走", "“好” 我走"), ("【注】 我", "【注】 我"), ("》 书", "》书"), ("汉 字 汉", "汉字汉"), ("a   b", "a b"), ("　x　", "x"), ("", ""), ("~~~~", "~")],
)
def test_normal_export(spark, raw, want):
    assert one(spark, T.normal_export, raw) == want


@pytest.mark.parametrize("title, want", [("第十二章 X", 12), ("第一百零三回", 103), ("第二十章", 20), ("Chapter 7: A", 7), ("【三】", 3), ("第一万二千章", 12000), ("第零章", None), ("Chapter 0", 0), ("十二万", 20010), ("百十", 100), ("CHAPTER 4", 4), ("第 【三", 3), ("1二", None), ("第一百零十章", 110), ("【 三】", None), ("Prologue", None), ("第十章", 10), ("12、开端", 12)])
def test_chapter_number(spark, title, want):
    assert one(spark, T.chapter_number, title) == want


def test_fold_keeps_offsets(spark):
    for s in ("ＡＢＣ！", "İstanbul", "ΣΑΣ", "ｶﾞ𐐀"):
        r = one(spark, T.fold, s)
        assert len(r) == len(s)
    assert one(spark, T.fold, "ＨＥＬＬＯ") == "hello"


def test_fnv(spark):
    assert one(spark, T.fnv1a, "hello") == 1335831723
    assert one(spark, T.fnv1a, "") == 2166136261


def test_xml_and_names(spark):
    assert one(spark, T.xml_text, "a<b>&\"'\x00") == "a&lt;b&gt;&amp;&#34;&#39;"
    assert one(spark, T.safe_component, ' a/b:c* ') == "a_b_c_"
    assert one(spark, T.safe_component, "  ") == "_"
    t, a = T.filename_meta(F.col("s"))
    row = spark.createDataFrame([("A - B - C.txt",), ("Solo.txt",)], "s string").select(t.alias("t"), a.alias("a")).collect()
    assert [tuple(r) for r in row] == [("A - B", "C"), ("Solo", "")]


def test_search_overlaps_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("aAｂb.\n𠀀") for _ in range(rng.randint(0, 30)))) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, t string")
    for q in ("aa", "b", "a.", "𠀀"):
        got = {(r.k, r.offset) for r in S.hits(df, "k", "t", q).collect()}
        fold = {c: d for c, d in zip(*T.fold_map())}
        want = set()
        for k, t in rows:
            f = "".join(fold.get(c, c) for c in t)
            want |= {(k, i) for i in range(len(f)) if f.startswith(q, i)}
        assert got == want


def book(chapters):
    flat, marks, at = [], [], 0
    for i, paras in enumerate(chapters, 1):
        body = "\n\n".join(paras)
        marks.append((1, i, paras[0], at))
        flat.append(body)
        at += len(body) + 2
    return "\n\n".join(flat), marks


def cleaned(spark, chapters, **kw):
    flat, marks = book(chapters)
    t = spark.createDataFrame([(1, flat)], "b long, text string")
    c = spark.createDataFrame(marks, "b long, idx long, title string, char_offset long")
    rows = K.clean(K.in_chapters(K.paragraphs(t, "b", "text"), c, "b"), "b", **kw)
    return rows, flat, t, c


def test_passes(spark):
    chapters = [[f"第{i}章", "本站首发", "他走了很远的路，才来到这里。", "访问 www.example.com/x", "作者有话说：求票", "谢谢大家"] for i in range(1, 7)]
    rows, flat, t, c = cleaned(spark, chapters)
    live = [r.text for r in rows.where("dropped is null").orderBy("line_no").collect()]
    assert live == ["他走了很远的路，才来到这里。"] * 6
    why = {r.dropped: r["count"] for r in rows.groupBy("dropped").count().collect()}
    assert why["title"] == 6 and why["edge"] >= 6 and why["note"] >= 6
    s = K.stats(rows, "b", t, c).first()
    assert s.chars_out == 14 * 6 and s.chapters == 6 and s.records == 6 and s.lost_chars == 0 and not s.generic_structure
    for r in rows.where("dropped = 'title'").collect():
        assert flat[r.offset :].startswith(r.text)
    lead = K.paragraphs(spark.createDataFrame([(1, "a\n　　b")], "b long, text string"), "b", "text").collect()
    assert [(r.text, r.offset) for r in lead] == [("a", 0), ("b", 2)], "a paragraph's offset is that of its line"


def test_url_in_long_paragraph_is_cut(spark):
    long = "很长的一段话" * 12 + " https://a.example/b " + "继续" * 10
    rows, *_ = cleaned(spark, [["第一章", long]])
    r = rows.where("dropped is null").first()
    assert "https" not in r.text and r.rewritten >= 1


def test_records_and_jsonl(spark, tmp_path):
    rows, flat, t, c = cleaned(spark, [["第一章", "甲乙丙。"], ["第二章", "丁戊己�"]])
    meta = spark.createDataFrame([(1, "书", None)], "b long, book string, author string")
    r = K.records(rows, "b", t, c, meta)
    got = r.orderBy("chapter_index").collect()
    h = hashlib.sha256(flat.encode()).hexdigest()
    assert [x.id for x in got] == [f"sha256:{h}/chapter-0001", f"sha256:{h}/chapter-0002"]
    assert got[0].cleaned_sha256 == hashlib.sha256("甲乙丙。".encode()).hexdigest() and got[0].source_sha256 == hashlib.sha256("第一章\n\n甲乙丙。\n\n".encode()).hexdigest()
    assert got[0].warnings is None and got[1].warnings == ["replacement_character"]
    js = json.loads(K.to_jsonl(r.where("chapter_index = 1")).first().value)
    assert list(js) == ["schema_version", "id", "document_id", "chapter_id", "chapter_index", "title", "text", "metadata", "cleaning", "offset", "chars", "source_sha256", "cleaned_sha256"]
    assert js["metadata"] == {"book": "书"} and "warnings" not in js["cleaning"]
    anon = K.records(rows, "b", t, c, meta, anonymous=True).orderBy("chapter_index").first()
    assert (anon.book, anon.author, anon.title) == (f"document-{h[:12]}", "", "chapter-0001")
    with pytest.raises(ValueError):
        K.write_corpus(r, str(tmp_path / "x"))
    assert not (tmp_path / "x").exists()
    K.write_corpus(r.where("chapter_index = 1"), str(tmp_path / "y"))
    assert spark.read.json(str(tmp_path / "y")).count() == 1


def test_chunks(spark):
    paras = ["第一章"] + ["字" * n for n in (100, 150, 200, 10)] + ["句子很长。" * 80]
    rows, *_ = cleaned(spark, [paras])
    ch = K.chunks(rows, "b", 300).orderBy("chunk").collect()
    assert "".join(r.text.replace("\n\n", "") for r in ch) == "".join(paras[1:])
    assert [r.chars for r in ch][:2] == [252, 212] and all(r.chars == len(r.text) for r in ch)
    rows, *_ = cleaned(spark, [["第一章", "This is a sentence! Is it? " * 30, "「好。」 他说！」" + "字" * 400 + "。尾"]])
    got = [r.text for r in K.chunks(rows, "b", 300).orderBy("chunk").collect()]
    assert got[0] == ("This is a sentence! Is it? " * 30).strip(), "ASCII marks end no sentence"
    assert got[1:] == ["「好。」他说！」" + "字" * 400 + "。", "尾"]
    n = K.packed(F.col("a"), 10)
    for lens in ([3, 4, 5, 10, 1], [20, 1], [], [10, 10], [0, 11, 0]):
        want, size = [], 0
        for i, x in enumerate(lens):
            if want and not (size > 0 and size + x > 10):
                want[-1] = (want[-1][0], want[-1][1] + 1)
            else:
                want.append((i, 1))
                size = 0
            size += x
        assert [tuple(r) for r in spark.createDataFrame([(lens,)], "a array<int>").select(n.alias("r")).first().r] == want


def chapters_of(spark, text):
    t = spark.createDataFrame([(1, text)], "b long, text string")
    return [(r.title, r.level) for r in C.detect(t, "b", "text").orderBy("idx").collect()]


def test_chapter_detection(spark):
    body = "\n正文内容在这里。\n"
    assert [x[0] for x in chapters_of(spark, "".join(f"第{c}章 标题{body}" for c in "一二三"))] == ["第一章 标题", "第二章 标题", "第三章 标题"]
    assert chapters_of(spark, "没有标题\n的文字") == [("正文", 0)]
    vol = "".join(f"第{v}卷{body}" + "".join(f"第{c}章{body}" for c in "一二") for v in "一二")
    assert [x[1] for x in chapters_of(spark, vol)] == [0, 1, 1, 0, 1, 1]
    lone = "第一卷" + body + "".join(f"第{c}章{body}" for c in "一二三")
    assert len(chapters_of(spark, lone)) == 3
    digits = "".join(f"{i}{body}" for i in range(1, 5))
    assert len(chapters_of(spark, digits)) == 4


def test_contents_list_goes(spark):
    body = "这是真正的正文内容。" * 10
    toc = "第一卷 起\n" + "".join(f"第{c}章 甲\n" for c in "一二三四五")
    text = toc + "第一卷 起\n" + "".join(f"第{c}章 甲\n{body}\n" for c in "一二三四五")
    t = spark.createDataFrame([(1, text)], "b long, text string")
    found = C.detect(t, "b", "text")
    new, ch = C.strip_contents(found, t, "b", "text")
    flat = new.first().text
    got = ch.orderBy("idx").collect()
    assert len(got) == 6 and all(flat[r.offset :].startswith(r.title) for r in got)


def test_format(spark):
    def fmt(text, title="", author=""):
        t = spark.createDataFrame([(1, text, title, author)], "k long, text string, title string, author string")
        return M.format_texts(t.select("k", "text"), "k", "text", t.select("k", "title", "author")).first().text

    assert fmt("　　第一段开头\n继续这一段。\n　　第二段。\n") == "第一段开头继续这一段。\n\n第二段。\n"
    assert fmt("一行一段。\n又一段。<b>粗</b>\n末段。\n") == "一行一段。\n\n又一段。粗\n\n末段。\n"
    assert fmt("no convention here\nat all") == "no convention here\nat all"
    assert fmt("书名\n作者：某人\n第一段。\n第二段。\n第三段。\n", "书名", "某人") == "第一段。\n\n第二段。\n\n第三段。\n"
    assert "\n\n第二章　新的" in fmt("　　前文结束了。第二章新的开始\n　　下一段。\n　　再一段。\n")
    assert fmt("　　卷一 起点\n　　正文。\n").startswith("第一卷")


def test_metadata(spark):
    t = spark.createDataFrame([(1, "书名 by: Some One\nx"), (2, "长篇 作者：张三\ny"), (3, "nothing")], "k long, text string")
    got = {r.k: (r.title, r.author) for r in M.detect_metadata(K.lines(t, "k", "text"), "k").collect()}
    assert got == {1: ("书名", "Some One"), 2: ("长篇", "张三")}


def test_heading_of_any_length(spark):
    long = "第一部" + "很" * 200
    assert C.matches(spark.createDataFrame([(1, "Chapter 1 " + " " * 300 + "x")], "b long, text string"), "b", "text", (C.Rule("own", 2, r"^(Chapter [0-9]+.*)\z"),)).count() == 1
    assert chapters_of(spark, f"{long}\n正文") == [("正文", 0)], "the rules have their own bounds"


def test_format_properties(spark):
    """Texts of no convention stay; the others lose nothing but white space, tags and their own names."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    conv = {r.doc_id for r in M.conventions(K.lines(d, "doc_id", "text"), "doc_id").where("indented or terminated").collect()}
    new = {r.doc_id: r.text for r in M.format_texts(d, "doc_id", "text").collect()}
    assert conv and len(new) == d.count()
    for r in d.collect():
        if r.doc_id not in conv or r.text is None:
            assert new[r.doc_id] == r.text
        else:
            t = new[r.doc_id]
            assert t.endswith("\n") and "\n\n\n" not in t
            bare = lambda s: "".join(c for c in re.sub("<[^<>\\r\\n]*>", "", s) if not c.isspace())
            assert bare(t).replace("第", "") == bare(r.text).replace("第", ""), r.doc_id
