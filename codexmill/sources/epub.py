"""EPUB: reading (container, package, spine, navigation, chapters) and writing, and a Spark data source over files."""

from __future__ import annotations

import glob
import html
import io
import os
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Elements whose text is a paragraph, and elements that are headings.
PARAGRAPHS = {"p", "li", "blockquote", "aside"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


@dataclass
class Book:
    """A book as read: its text, and chapters as (title, level, offset in code points)."""

    title: str = ""
    author: str = ""
    text: str = ""
    chapters: list[tuple[str, int, int]] = field(default_factory=list)


class _Chapter(HTMLParser):
    """First heading and the outermost paragraphs of one chapter."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.paras, self.inside, self.buffer = "", [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in PARAGRAPHS | HEADINGS:
            if not self.inside:
                self.buffer = []
            self.inside.append(tag)
        elif tag == "br" and self.inside:
            self._flush(self.inside[0])
        elif tag in ("img", "image") and self.inside:
            self.buffer.append("[" + (dict(attrs).get("alt") or "image") + "]")

    def handle_endtag(self, tag):
        if tag in self.inside:
            outer = self.inside[0]
            del self.inside[len(self.inside) - 1 - self.inside[::-1].index(tag) :]
            if not self.inside:
                self._flush(outer)

    def handle_data(self, data):
        if self.inside:
            self.buffer.append(data)

    def _flush(self, tag):
        s = re.sub(r"[ \t\r\n]+", " ", "".join(self.buffer)).strip()
        self.buffer = []
        if not s:
            return
        if tag in HEADINGS and not self.title:
            self.title = s
        elif tag in PARAGRAPHS:
            self.paras.append(s)


class _Nav(HTMLParser):
    """href -> (level, title) of a navigation document; the first link to a file wins."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.href, self.text, self.items = 0, None, [], {}

    def handle_starttag(self, tag, attrs):
        if tag == "li":
            self.depth += 1
        elif tag == "a":
            self.href, self.text = (dict(attrs).get("href") or "").partition("#")[0], []

    def handle_endtag(self, tag):
        if tag == "li":
            self.depth -= 1
        elif tag == "a" and self.href is not None:
            self.items.setdefault(self.href, (max(self.depth - 1, 0), " ".join("".join(self.text).split())))
            self.href = None

    def handle_data(self, data):
        if self.href is not None:
            self.text.append(data)


def _local(e) -> str:
    return e.tag.rpartition("}")[2]


def read(data: bytes) -> Book:
    """A book from the bytes of an EPUB file; a spine item that the manifest lacks is an error."""
    z = zipfile.ZipFile(io.BytesIO(data))
    container = ET.fromstring(z.read("META-INF/container.xml"))
    opf_path = next(e.get("full-path") for e in container.iter() if _local(e) == "rootfile")
    opf = ET.fromstring(z.read(opf_path))
    base = posixpath.dirname(opf_path)
    manifest = {e.get("id"): (posixpath.join(base, e.get("href") or ""), e.get("properties") or "") for e in opf.iter() if _local(e) == "item"}
    book = Book(*(next((e.text or "" for e in opf.iter() if _local(e) == n), "").strip() for n in ("title", "creator")))
    nav: dict[str, tuple[int, str]] = {}
    for path, props in manifest.values():
        if "nav" in props.split() and path in z.namelist():
            p = _Nav()
            p.feed(z.read(path).decode("utf-8", "replace"))
            nav = {posixpath.normpath(posixpath.join(posixpath.dirname(path), h)): v for h, v in p.items.items()}
    parts: list[str] = []
    at = 0
    for k, ref in enumerate((e.get("idref") for e in opf.iter() if _local(e) == "itemref"), 1):
        if ref not in manifest:
            raise ValueError(f"spine item {ref!r} is not in the manifest")
        path, props = manifest[ref]
        if "nav" in props.split():
            continue
        c = _Chapter()
        c.feed(z.read(path).decode("utf-8", "replace"))
        level, nav_title = nav.get(posixpath.normpath(path), (0, ""))
        title = c.title or nav_title or f"Chapter {k}"
        body = "\n\n".join([title, *c.paras])
        book.chapters.append((title, level, at))
        parts.append(body)
        at += len(body) + 2
    book.text = "\n\n".join(parts)
    return book


def _xml(s: str) -> str:
    s = re.sub("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]", "", s)
    return html.escape(s, quote=True)


def write(title: str, author: str, chapters: list[tuple[str, int, str]]) -> bytes:
    """The bytes of an EPUB 3 file; chapters are (title, level, text). The mimetype comes first and is stored."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        names = [f"chap-{i:04d}.xhtml" for i in range(1, len(chapters) + 1)]
        items = "".join(f'<item id="c{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(names, 1))
        spine = "".join(f'<itemref idref="c{i}"/>' for i in range(1, len(names) + 1))
        z.writestr("OEBPS/content.opf", f'<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">urn:x:{_xml(title)}</dc:identifier><dc:title>{_xml(title)}</dc:title><dc:creator>{_xml(author)}</dc:creator><dc:language>und</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{items}</manifest><spine toc="ncx">{spine}</spine></package>')
        nav, level = ["<ol>"], 0
        for k, (t, lv, _) in enumerate(chapters):
            lv = min(lv, level + 1) if k else 0
            nav.append("<ol>" if lv > level else "</li>" * bool(k) + "</ol></li>" * (level - lv))
            nav.append(f'<li><a href="{names[k]}">{_xml(t)}</a>')
            level = lv
        nav.append("</li>" * bool(chapters) + "</ol></li>" * level + "</ol>")
        z.writestr("OEBPS/nav.xhtml", f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{_xml(title)}</title></head><body><nav epub:type="toc">{"".join(nav)}</nav></body></html>')
        points = "".join(f'<navPoint id="n{i}" playOrder="{i}"><navLabel><text>{_xml(t)}</text></navLabel><content src="{names[i - 1]}"/></navPoint>' for i, (t, _, _) in enumerate(chapters, 1))
        z.writestr("OEBPS/toc.ncx", f'<?xml version="1.0" encoding="utf-8"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><docTitle><text>{_xml(title)}</text></docTitle><navMap>{points}</navMap></ncx>')
        for n, (t, lv, text) in zip(names, chapters):
            paras = [p.strip() for p in text.split("\n\n") if p.strip()]
            if paras and paras[0] == t.strip():
                paras = paras[1:]
            h = min(lv + 1, 6)
            z.writestr(f"OEBPS/{n}", f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title>{_xml(t)}</title></head><body><h{h}>{_xml(t)}</h{h}>{"".join(f"<p>{_xml(p)}</p>" for p in paras)}</body></html>')
    return out.getvalue()


class EpubSource(DataSource):
    """spark.read.format("codex_epub").load(folder): one row for each chapter of each EPUB file in a folder."""

    @classmethod
    def name(cls) -> str:
        return "codex_epub"

    def schema(self) -> str:
        return "path string, book string, author string, idx long, title string, level int, char_offset long, text string"

    def reader(self, schema) -> DataSourceReader:
        return _EpubReader(self.options)


@dataclass
class _File(InputPartition):
    path: str


class _EpubReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.folder = options.get("path", "")

    def partitions(self):
        return [_File(p) for p in sorted(glob.glob(os.path.join(self.folder, "*"))) if p.lower().endswith(".epub")]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            book = read(f.read())
        ends = [c[2] - 2 for c in book.chapters[1:]] + [len(book.text)]
        for i, ((title, level, at), end) in enumerate(zip(book.chapters, ends), 1):
            yield partition.path, book.title, book.author, i, title, level, at, book.text[at:end]
