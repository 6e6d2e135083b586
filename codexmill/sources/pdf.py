"""PDF text layers: objects, Flate streams, content operators, ToUnicode maps, glyphs to lines.

Covers documents whose objects are plain or in object streams and whose page contents are plain or Flate-coded.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

# Tolerances of the layout.
SAME_LINE, SPACE_GAP, SPACE_SHARE, LEAST_TEXT = 2.5, 1.5, 0.20, 20

_OBJ = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)


def objects(raw: bytes) -> dict[int, bytes]:
    """Numbered objects, those in object streams included."""
    out = {int(m.group(1)): m.group(2) for m in _OBJ.finditer(raw)}
    for body in list(out.values()):
        if b"/ObjStm" in body:
            data = stream(body)
            n, first = (int(re.search(rb"/%s\s+(\d+)" % k, body).group(1)) for k in (b"N", b"First"))
            nums = list(map(int, data[:first].split()))[: 2 * n]
            at = nums[1::2] + [len(data) - first]
            for k, num in enumerate(nums[::2]):
                out.setdefault(num, data[first + at[k] : first + at[k + 1]])
    return out


def stream(body: bytes) -> bytes:
    m = _STREAM.search(body)
    if not m:
        return b""
    if b"/FlateDecode" in body[: m.start()]:
        try:
            return zlib.decompressobj().decompress(m.group(1))
        except zlib.error:
            return b""
    return m.group(1)


def cmap(data: bytes) -> dict[int, str]:
    """Codes to text of a ToUnicode map."""
    out: dict[int, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[int(a, 16)] = text(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            base = text(c)
            for k in range(int(a, 16), min(int(b, 16), int(a, 16) + 65535) + 1):
                out[k] = base[:-1] + chr(ord(base[-1]) + k - int(a, 16))
    return out


def _string(t: bytes) -> bytes:
    if t[:1] == b"<":
        h = re.sub(rb"\s", b"", t[1:-1])
        return bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
    names = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
    return re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m.group(1), 8) & 255]) if m.group(1)[:1] in b"01234567" else names.get(m.group(1), m.group(1)), t[1:-1], flags=re.S)


def glyphs(data: bytes, fonts: dict[bytes, dict[int, str]], wide: set[bytes]) -> list[tuple[float, float, float, str]]:
    """(x, y, size, text) of what a content stream shows."""
    out, stack = [], []
    font, size, leading = b"", 12.0, 0.0
    x = y = lx = ly = 0.0
    scale = 1.0

    def show(s: bytes) -> None:
        nonlocal x
        table = fonts.get(font)
        if font in wide:
            t = "".join((table or {}).get(c, chr(c) if table is None else "") for c in (int.from_bytes(s[i : i + 2], "big") for i in range(0, len(s) - 1, 2)))
        else:
            t = "".join((table or {}).get(c, bytes([c]).decode("cp1252", "replace")) for c in s)
        if t:
            out.append((x, y, size * scale, t))
            x += 0.5 * size * scale * sum(2 if ord(c) > 0x2E80 else 1 for c in t)

    for m in _TOKEN.finditer(data):
        t = m.group()
        if not t[:1].isalpha() and t not in (b"'", b'"', b"T*"):
            stack.append(t)
            continue
        num = [float(s) for s in stack if re.fullmatch(rb"[-+]?\d*\.?\d+", s)]
        if t == b"Tf" and num:
            font, size = stack[-2][1:] if len(stack) > 1 else b"", num[-1]
        elif t == b"BT":
            x = y = lx = ly = 0.0
        elif t in (b"Td", b"TD") and len(num) >= 2:
            lx, ly = lx + num[-2] * scale, ly + num[-1] * scale
            x, y = lx, ly
            leading = -num[-1] if t == b"TD" else leading
        elif t == b"Tm" and len(num) >= 6:
            scale = abs(num[-6]) or 1.0
            x, y = lx, ly = num[-2], num[-1]
        elif t == b"TL" and num:
            leading = num[-1]
        elif t in (b"T*", b"'", b'"'):
            ly -= leading * scale
            x, y = lx, ly
            if t != b"T*" and stack:
                show(_string(stack[-1]))
        elif t == b"Tj" and stack:
            show(_string(stack[-1]))
        elif t == b"TJ":
            for s in stack:
                if s[:1] in b"(<":
                    show(_string(s))
                elif re.fullmatch(rb"[-+]?\d*\.?\d+", s):
                    x -= float(s) / 1000 * size * scale
        stack = []
    return out


def page_text(items: list[tuple[float, float, float, str]]) -> str:
    """Glyphs to lines by height, words apart where the gap is wide."""
    rows: list[list] = []
    for g in sorted(items, key=lambda g: (-g[1], g[0])):
        if rows and abs(rows[-1][0] - g[1]) <= SAME_LINE:
            row = rows[-1]
            row[0] = (row[0] * len(row[1]) + g[1]) / (len(row[1]) + 1)
            row[1].append(g)
        else:
            rows.append([g[1], [g]])
    out = []
    for _, gs in rows:
        gs.sort(key=lambda g: g[0])
        s, end = "", None
        for x, _, size, t in gs:
            if s and end is not None and x - end > max(SPACE_GAP, SPACE_SHARE * size) and s[-1].isascii() and s[-1].isalnum() and t[0].isascii() and t[0].isalnum():
                s += " "
            s += t
            end = x + 0.5 * size * sum(2 if ord(c) > 0x2E80 else 1 for c in t)
        out.append(" ".join(s.split()))
    return "\n\n".join(s for s in out if s)


def strip_edges(pages: list[str]) -> list[str]:
    """Pages without first and last lines that come back on more than half of them."""
    norm = lambda s: " ".join(s.split())
    split = [[s for s in p.split("\n\n") if s.strip()] for p in pages]
    if len(pages) < 2:
        return pages
    count = Counter(k for ls in split if ls for k in {norm(ls[0]), norm(ls[-1])})
    out = []
    for ls in split:
        if ls and count[norm(ls[0])] * 2 > len(pages):
            ls = ls[1:]
        if ls and count[norm(ls[-1])] * 2 > len(pages):
            ls = ls[:-1]
        out.append("\n\n".join(ls))
    return out


def read(raw: bytes) -> dict:
    """title, author, pages and text of a PDF; an error where its text layer is too thin."""
    objs = objects(raw)
    pages = [b for b in objs.values() if re.search(rb"/Type\s*/Page\b(?!s)", b)]
    resolve = lambda b: objs.get(int(m.group(1)), b) if (m := _REF.fullmatch(b.strip())) else b
    texts = []
    for p in pages:
        fonts: dict[bytes, dict[int, str]] = {}
        wide: set[bytes] = set()
        res = re.search(rb"/Resources\s*(\d+\s+\d+\s+R)", p)
        scope = resolve(res.group(1)) if res else p
        fref = re.search(rb"/Font\s*(\d+\s+\d+\s+R)", scope)
        table = resolve(fref.group(1)) if fref else (re.search(rb"/Font\s*<<(.*?)>>", scope, re.S) or [b"", b""])[1]
        for name, num in re.findall(rb"/([^\s/<>]+)\s+(\d+)\s+\d+\s+R", table):
            f = objs.get(int(num), b"")
            u = re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", f)
            if u:
                fonts[name] = cmap(stream(objs.get(int(u.group(1)), b"")))
            if b"/Identity-H" in f:
                wide.add(name)
        c = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", p)
        data = b"\n".join(stream(objs.get(int(n), b"")) for n in _REF.findall(c.group(1))) if c else b""
        texts.append(page_text(glyphs(data, fonts, wide)))
    text = "\n\n".join(t for t in strip_edges(texts) if t)
    if len(re.sub(r"\s", "", text)) < LEAST_TEXT:
        raise ValueError("no text layer")
    info = {k: (lambda m: _string(m.group(1)).decode("utf-16" if m.group(1)[1:3] == b"\xfe\xff" else "latin-1") if m else "")(re.search(rb"/%s\s*(\((?:\\.|[^\\()])*\))" % k.encode(), raw, re.S)) for k in ("Title", "Author")}
    return {"title": info["Title"].strip(), "author": info["Author"].strip(), "pages": len(pages), "text": text}


def write(title: str, author: str, pages: list[list[str]]) -> bytes:
    """A PDF of lines, page by page, with a text layer that maps back to Unicode."""
    used = sorted({c for p in pages for s in p for c in s if ord(c) < 0x10000})
    code = {c: i + 1 for i, c in enumerate(used)}
    rows = "\n".join(f"<{i:04X}> <{ord(c):04X}>" for c, i in code.items())
    to_unicode = f"{len(used)} beginbfchar\n{rows}\nendbfchar".encode()
    info = lambda s: b"(" + b"".join(b"\\" + bytes([b]) if b in b"()\\" else bytes([b]) for b in (s.encode("latin-1") if s.isascii() else b"\xfe\xff" + s.encode("utf-16-be"))) + b")"
    objs = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 4 0 R >>", 4: b"<< /Length %d >>\nstream\n%s\nendstream" % (len(to_unicode), to_unicode), 5: b"<< /Title %s /Author %s >>" % (info(title), info(author))}
    kids = []
    for p in pages:
        k = len(objs) + 2
        k = max(k, max(objs) + 1)
        show = "\n".join(f"1 0 0 1 50 {800 - 15 * y} Tm <{''.join(f'{code[c]:04X}' for c in s if c in code)}> Tj" for y, s in enumerate(p) if s)
        body = zlib.compress(f"BT /F1 10 Tf\n{show}\nET".encode())
        objs[k] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(body), body)
        objs[k + 1] = b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % k
        kids.append(b"%d 0 R" % (k + 1))
    objs[2] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(kids), len(kids))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, v) for k, v in sorted(objs.items())) + b"trailer << /Root 1 0 R /Info 5 0 R >>\n%%EOF"
