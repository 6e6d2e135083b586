"""Containers read what was written; bytes decode as stated; streams agree with their batch twins."""

import struct
import zlib

import random

import pytest

from codexmill.functions import text as T
from codexmill.operators import catalog as C
from codexmill.sources import epub, folder, mobi, pdf
from codexmill.sources.decode import decode
from codexmill.sources.html import flatten
from codexmill.streaming import progress as P


@pytest.mark.parametrize(
    "data, want",
    [(b"", ("utf-8", "")), (b"abc", ("utf-8", "abc")), ("汉".encode(), ("utf-8", "汉")), (b"\xef\xbb\xbfx", ("utf-8", "x")), ("汉字".encode("gb18030"), ("gb18030", "汉字")), (b"\xff\xfe" + "汉x".encode("utf-16-le"), ("utf-16le", "汉x")), (b"\xfe\xff" + "汉x".encode("utf-16-be"), ("utf-16be", "汉x"))],
)
def test_decode(data, want):
    assert decode(data) == want


def test_html():
    assert flatten("<head><title>x</title></head><p>A&amp;B<p>C <b>d</b>\n e<script>if(a<b){}</script><br>f") == "A&B\n\nC d e\n\nf\n\n"
    assert flatten("a < b") == "a < b\n\n"


def test_epub_round_trip():
    chapters = [("卷一", 0, "卷一\n\n开头。"), ("第一章 <A>", 1, "正文&内容。\n\n第二段。"), ("卷二", 0, "结尾。")]
    b = epub.read(epub.write("书 & 名", "作者", chapters))
    assert (b.title, b.author) == ("书 & 名", "作者")
    assert [(t, lv) for t, lv, _ in b.chapters] == [("卷一", 0), ("第一章 <A>", 1), ("卷二", 0)]
    assert all(b.text[o:].startswith(t) for t, _, o in b.chapters)
    assert "正文&内容。\n\n第二段。" in b.text


def build_mobi(text, compression=1, code=65001, title="T", author="A", drm=0):
    body = text.encode("utf-8" if code == 65001 else "cp1252")
    name = title.encode()
    exth = b"EXTH" + struct.pack(">II", 12 + 8 + len(author), 1) + struct.pack(">II", 100, 8 + len(author)) + author.encode()
    head = struct.pack(">HHIHHHH", compression, 0, len(body), 1, 4096, drm, 0) + b"MOBI" + struct.pack(">III", 232, 2, code)
    head = head.ljust(84, b"\0") + struct.pack(">II", 248 + len(exth), len(name))
    head = head.ljust(128, b"\0") + struct.pack(">I", 0x40)
    head = head.ljust(248, b"\0") + exth + name
    recs = [head, body]
    at, table = 78 + 8 * len(recs), b""
    for r in recs:
        table += struct.pack(">II", at, 0)
        at += len(r)
    return b"x".ljust(76, b"\0") + struct.pack(">H", len(recs)) + table + b"".join(recs)


def test_mobi():
    got = mobi.read(build_mobi("<p>Héllo</p><p>World</p>", title="Titel", author="Someone"))
    assert got["title"] == "Titel" and got["author"] == "Someone" and got["text"] == "Héllo\n\nWorld\n\n"
    with pytest.raises(ValueError):
        mobi.read(build_mobi("x", drm=1))
    with pytest.raises(ValueError):
        mobi.records(b"short")
    assert mobi.expand(b"abc\x80\x18\xe1") == b"abcabc a"


def build_pdf(pages):
    objs, kids = {}, []
    n = 4
    for lines in pages:
        data = b"BT /F1 12 Tf 72 700 Td 14 TL " + b"".join(b"(%s) Tj T* " % s.encode() for s in lines) + b"ET"
        z = zlib.compress(data)
        objs[n] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(z) + z + b"\nendstream"
        objs[n + 1] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> >> >>" % n
        kids.append(b"%d 0 R" % (n + 1))
        n += 2
    objs |= {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(kids), len(kids)), 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", n: b"<< /Title (My Title) /Author (Me) >>"}
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, v) for k, v in sorted(objs.items()))


def test_pdf():
    got = pdf.read(build_pdf([["HEADER", "first page has some words", "1"], ["HEADER", "second page has others (here)".replace("(", "\\(").replace(")", "\\)"), "2"], ["HEADER", "third", "3"]]))
    assert got["pages"] == 3 and got["title"] == "My Title" and "HEADER" not in got["text"]
    assert "second page has others (here)" in got["text"]
    with pytest.raises(ValueError):
        pdf.read(build_pdf([["x"]]))


def test_folder(spark, tmp_path):
    (tmp_path / "A - B.txt").write_bytes("第一章\n正文".encode("gb18030"))
    (tmp_path / "b.epub").write_bytes(epub.write("E", "", [("One", 0, "text one")]))
    (tmp_path / "c.MOBI").write_bytes(build_mobi("<p>m</p>"))
    (tmp_path / "bad.pdf").write_bytes(b"%PDF nothing")
    (tmp_path / ".hidden.txt").write_text("x")
    (tmp_path / "d.doc").write_text("x")
    rows = {r.file: r for r in folder.with_metadata(folder.ingest(folder.scan(spark, str(tmp_path)))).collect()}
    assert set(rows) == {"A - B.txt", "b.epub", "c.MOBI", "bad.pdf"}
    assert rows["A - B.txt"].encoding == "gb18030" and rows["A - B.txt"].author == "B"
    assert rows["b.epub"].chapters[0].title == "One" and rows["bad.pdf"].error and rows["c.MOBI"].text == "m\n\n"
    spark.dataSource.register(epub.EpubSource)
    assert spark.read.format("codex_epub").load(str(tmp_path)).first().text.startswith("One")


def test_sidecar_and_rules(tmp_path):
    assert folder.sidecar_chapters({"chapters": [{"title": "b", "char_offset": 5}, {"title": "a", "match": "xx", "level": 1}]}, "..xx..") == [("a", 1, 2), ("b", 0, 5)]
    with pytest.raises(ValueError):
        folder.sidecar_chapters({"chapters": [{"title": "a", "match": "zz"}]}, "x")
    f = tmp_path / "r.json"
    f.write_text('{"promo": ["^AD$", "("], "replace": [["a", "b"]]}')
    rules, error = folder.load_rules(str(f))
    assert error and "^AD$" in rules.promo and rules.replace == []
    assert folder.load_rules(str(tmp_path / "none.json"))[1] is None


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = [("u", 1, 1, None, 10, 5), ("u", 1, 2, 5, 20, 6), ("u", 1, 3, 10, 30, 7), ("v", 1, 1, 0, 9, 1), ("v", 1, 2, 9, 12, 2), ("v", 2, 1, 3, 4, 4)]
    df = spark.createDataFrame(rows, "user_id string, book_id long, seq long, base long, updated_at long, char_offset long")
    batch = {(r.user_id, r.book_id): (r.version, r.char_offset, r.refused) for r in C.merge_progress(df).collect()}
    assert batch[("u", 1)] == (30, 7, 1)
    for k in (1, 2, 3):
        df.where(f"seq = {k}").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = P.merge_progress(stream).writeStream.outputMode("update").format("memory").queryName("merge").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {}
    for r in spark.table("merge").collect():
        k = (r.user_id, r.book_id)
        got[k] = max(got.get(k, (0, 0, 0)), (r.version, r.char_offset, r.refused))
    assert got[("u", 1)][:2] == (30, 7) and got[("v", 1)] == batch[("v", 1)]


def test_throttle(spark):
    rows = [(1, t, False) for t in (0, 10, 20, 30, 40)] + [(1, 200, False), (2, 0, False), (2, 5, True), (2, 9, False)]
    df = spark.createDataFrame(rows, "key long, t long, ok boolean")
    got = sorted(tuple(r) for r in C.throttle(df).collect())
    assert got == [(1, 0, 40, 5, True), (1, 200, 200, 1, False), (2, 0, 0, 1, False), (2, 9, 9, 1, False)]
    rng = random.Random(7)
    rows, want = [], []
    for k in range(40):
        t, state = 0, (0, 0, 0, False)
        for _ in range(rng.randint(1, 60)):
            t += rng.choice([1, 5, 20, 59, 60, 61, 200, 90_000])
            ok = rng.random() < 0.15
            rows.append((k, t, ok))
            state, done = C.attempt(state, t, ok, 60, 5)  # the same that the stream's state takes
            want += [(k, *done)] if done else []
        want += [(k, state[1], state[2], state[0], state[0] >= 5)] if state[0] else []
    got = C.throttle(spark.createDataFrame(rows, "key long, t long, ok boolean")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert any(r.blocked for r in got)


def test_catalog_edges(spark):
    users = spark.createDataFrame([("a", "admin"), ("b", "user")], "user_id string, role string")
    kept, _ = C.delete_user("a", users, {})
    assert kept.count() == 2  # the last admin stays
    kept, kids = C.delete_user("b", users, {"p": spark.createDataFrame([("a", 1), ("b", 2)], "user_id string, x int")})
    assert kept.count() == 1 and kids["p"].count() == 1
    assert C.evolve(users, {"has_cover": ("boolean", False)}).first().has_cover is False


def test_core_does_not_import_llm():
    import os
    import re

    import codexmill

    root = os.path.dirname(codexmill.__file__)
    for folder_, _, files in os.walk(root):
        if os.sep + "llm" in folder_:
            continue
        for f in files:
            if f.endswith(".py"):
                assert not re.search(r"^\s*(from|import)\s+codexmill\.llm", open(os.path.join(folder_, f), encoding="utf-8").read(), re.M)


def test_library(spark, tmp_path):
    from codexmill.operators import library as L
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("a, b，a c", " Reading ", "T\n\n p1 \n\np2", "T")], "s string, st string, x string, t string")
    r = row.select(L.split_tags(F.col("s")).alias("tags"), L.valid_status(F.col("st")).alias("st"), L.render(F.col("x"), F.col("t")).alias("ps"), L.percent(F.lit(1), F.lit(3)).alias("p"), L.removed_percent(F.lit(8), F.lit(7)).alias("q")).first()
    assert r.tags == ["a", "b", "c"] and r.st == "reading" and r.ps == ["p1", "p2"] and r.p == 33 and r.q == 12.5
    books = spark.createDataFrame([(1, "unread", False), (2, "reading", True)], "id long, reading_status string, favorite boolean")
    tags = spark.createDataFrame([(1, "x"), (2, "y")], "book_id long, name string")
    ids = spark.createDataFrame([(1,), (9,)], "book_id long")
    b, t, f = L.batch("tag", books, tags, ids, names=["x", "z"])
    assert sorted(map(tuple, t.collect())) == [(1, "x"), (1, "z"), (2, "y")] and [x.id for x in f.collect()] == [9]
    assert L.batch("favorite", books, tags, ids, favorite=True)[0].where("favorite").count() == 2
    with pytest.raises(ValueError):
        L.batch("status", books, tags, ids, status="lost")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "book_id long, title string")
    L.replace_children(rows, str(tmp_path / "c"))
    L.replace_children(rows.where("book_id = 2").withColumn("title", F.lit("new")), str(tmp_path / "c"))
    assert sorted((x.book_id, x.title) for x in spark.read.parquet(str(tmp_path / "c")).collect()) == [(1, "a"), (2, "new")]
    L.register(spark)
    assert spark.sql("select codex_fold('ＡＢ') f, codex_flatten('<p>x') h").first()[0] == "ab"
    for x in ("他说「好」 我走。。。", "  a   b!!!! ", "好！！！！ ok", "it's \\ x"):
        one = spark.createDataFrame([(x,)], "s string")
        one.createOrReplaceTempView("one")
        assert spark.sql("select codex_normal(s) from one").first()[0] == one.select(T.normal_export(F.col("s"))).first()[0]
    assert spark.sql("select codex_decode(encode('Grüße', 'UTF-16LE')) d").first().d is not None
    assert spark.sql("select * from codex_lines('a\nbc')").count() == 2


def test_progress_versions(spark):
    """A base of zero wins without a legacy version and gives way to one."""
    rows = [("u", 1, 1, 0, None, 10, 5), ("u", 1, 2, 0, None, 20, 6), ("v", 1, 1, 0, None, 10, 5), ("v", 1, 2, 0, 9, 20, 6), ("w", 1, 1, None, None, 10, 5), ("w", 1, 2, None, 10, 20, 6)]
    df = spark.createDataFrame(rows, "user_id string, book_id long, seq long, base long, legacy long, updated_at long, char_offset long")
    assert {r.user_id: (r.version, r.refused) for r in C.merge_progress(df).collect()} == {"u": (20, 0), "v": (10, 1), "w": (20, 0)}


def test_decode_is_linear():
    import time

    def seconds(n):
        began = time.perf_counter()
        decode((b"abc \xe4\xb8" + b"\xff\x81 ") * n)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(200_000) < 5
    for text, name in (("这是一本关于河流和城门的书，没有人知道它从哪里来。" * 3, "gb18030"), ("這是一本關於河流和城門的書，沒有人知道它從哪裡來。" * 3, "big5"), ("Der Müller hörte die grüne Tür. " * 5, "cp1252")):
        assert decode(text.encode(name)) == (name, text)


def test_ingest_with_sidecars_and_converters(spark, tmp_path):
    import json

    from codexmill.sources import convert, epub, folder

    (tmp_path / "a.txt").write_text("Start\n\nPart two begins", "utf-8")
    (tmp_path / "a.chapters.json").write_text(json.dumps({"chapters": [{"title": "Two", "match": "Part two"}]}), "utf-8")
    (tmp_path / "b.mobi").write_bytes(b"broken")
    (tmp_path / "c.txt").write_text("other", "utf-8")
    files = folder.with_sidecars(folder.scan(spark, str(tmp_path)), str(tmp_path))
    book = epub.write("T", "A", [("One", 0, "text of the book")])
    got = {r.file: r for r in folder.ingest(files, {"mobi": lambda data: book}).collect()}
    assert [(c.title, c.char_offset) for c in got["a.txt"].chapters] == [("Two", 7)] and got["b.mobi"].error is None and "text of the book" in got["b.mobi"].text
    assert [r.file for r in folder.scan(spark, "", [str(tmp_path / "c.txt")]).collect()] == ["c.txt"]
    copy = convert.command(["cp", "{in}", "{out}"], ".x", ".y", cache=str(tmp_path / "cache"))
    assert copy(b"data") == b"data" == copy(b"data") and len(list((tmp_path / "cache").iterdir())) == 1
    with pytest.raises(Exception):
        convert.command(["false"], ".x", ".y")(b"data")
    with pytest.raises(Exception):
        convert.command(["sleep", "5"], ".x", ".y", timeout=1)(b"data")
    assert folder.roots(" /a : /b:/a::") == ["/a", "/b"]
    convert.publish(str(tmp_path / "p" / "x"), b"1")
    convert.publish(str(tmp_path / "p" / "x"), b"2")
    assert (tmp_path / "p" / "x").read_bytes() == b"2" and len(list((tmp_path / "p").iterdir())) == 1
    for i in (1, 2):
        spark.range(i).write.parquet(str(tmp_path / f"w{i}"))
        convert.publish_table(spark, str(tmp_path / f"w{i}"), str(tmp_path / "t"))
        assert spark.read.parquet(str(tmp_path / "t")).count() == i


def test_mobi_and_pdf_written(spark):
    from codexmill.sources import mobi, pdf

    rng = random.Random(3)
    for n in (0, 1, 50, 5000):
        data = bytes(rng.randrange(256) for _ in range(n)) + b" Ab \x01\x02" * (n // 10)
        assert mobi.expand(mobi.pack(data)) == data
    got = pdf.read(pdf.write("书 (a)", "Zoë", [[f"{i} 第{i}行 of the page"] for i in range(30)]))
    assert (got["title"], got["author"], got["pages"]) == ("书 (a)", "Zoë", 30) and got["text"].split("\n\n")[29] == "29 第29行 of the page"
