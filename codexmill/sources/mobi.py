"""MOBI and AZW: Palm database records, headers, PalmDOC text, metadata."""

from __future__ import annotations

import struct

from codexmill.sources.decode import decode
from codexmill.sources.html import flatten

# Compression and encoding codes of the format.
PLAIN, PALMDOC, HUFF, UTF8 = 1, 2, 17480, 65001


def records(raw: bytes) -> list[bytes]:
    """The records of a Palm database; offsets must grow and lie inside the file."""
    if len(raw) < 78:
        raise ValueError("too short for a Palm database")
    n = struct.unpack_from(">H", raw, 76)[0]
    if len(raw) < 78 + 8 * n or n == 0:
        raise ValueError("record list is cut off")
    offsets = [struct.unpack_from(">I", raw, 78 + 8 * i)[0] for i in range(n)] + [len(raw)]
    if any(a > b for a, b in zip(offsets, offsets[1:])):
        raise ValueError("record offsets do not grow")
    return [raw[a:b] for a, b in zip(offsets, offsets[1:])]


def expand(record: bytes) -> bytes:
    """A PalmDOC record unpacked: literals, runs, a space with a letter, and back references of 3 to 10 bytes."""
    out = bytearray()
    i, n = 0, len(record)
    while i < n:
        c = record[i]
        i += 1
        if 1 <= c <= 8:
            out += record[i : i + c]
            i += c
        elif c < 0x80:
            out.append(c)
        elif c >= 0xC0:
            out += bytes((0x20, c ^ 0x80))
        else:
            if i >= n:
                break
            v = (c << 8 | record[i]) & 0x3FFF
            i += 1
            back, size = v >> 3, (v & 7) + 3
            if not 0 < back <= len(out):
                raise ValueError("back reference before the start")
            for _ in range(size):
                out.append(out[-back])
    return bytes(out)


def _trim(record: bytes, flags: int) -> bytes:
    """Without the trailing entries that the header's flags announce."""
    end = len(record)
    for bit in range(1, 16):
        if flags >> bit & 1 and end:
            size = shift = 0
            for k in range(1, 5):
                b = record[end - k] if end - k >= 0 else 0x80
                size |= (b & 0x7F) << shift
                shift += 7
                if b & 0x80:
                    break
            end = max(end - size, 0)
    if flags & 1 and end:
        end = max(end - (record[end - 1] & 3) - 1, 0)
    return record[:end]


def read(raw: bytes) -> dict:
    """title, author, encoding and text (paragraphs) of a book without DRM."""
    recs = records(raw)
    head = recs[0]
    compression, _, length, count, _, drm = struct.unpack_from(">HHIHHH", head, 0)
    if drm:
        raise ValueError("the book is protected")
    if compression == HUFF or compression not in (PLAIN, PALMDOC):
        raise ValueError(f"compression {compression} is not supported")
    mobi = head[16:20] == b"MOBI"
    size = struct.unpack_from(">I", head, 20)[0] if mobi else 0
    code = struct.unpack_from(">I", head, 28)[0] if mobi else 1252
    flags = struct.unpack_from(">H", head, 242)[0] if mobi and size >= 228 and len(head) >= 244 else 0
    body = b"".join((expand(r) if compression == PALMDOC else r) for r in (_trim(r, flags) for r in recs[1 : 1 + count]))[:length]
    encoding, source = ("utf-8", body.decode("utf-8", "replace")) if code == UTF8 else decode(body)
    title = author = ""
    if mobi and len(head) >= 92:
        at, n = struct.unpack_from(">II", head, 84)
        title = head[at : at + n].decode("utf-8" if code == UTF8 else "cp1252", "replace")
        if struct.unpack_from(">I", head, 128)[0] & 0x40 if len(head) >= 132 else 0:
            seen: dict[int, str] = {}
            p = 16 + size
            if head[p : p + 4] == b"EXTH":
                total = struct.unpack_from(">I", head, p + 8)[0]
                p += 12
                for _ in range(total):
                    if p + 8 > len(head):
                        break
                    kind, n = struct.unpack_from(">II", head, p)
                    seen.setdefault(kind, head[p + 8 : p + n].decode("utf-8" if code == UTF8 else "cp1252", "replace"))
                    p += max(n, 8)
            author, title = seen.get(100, ""), seen.get(503, title)
    return {"title": title.strip(), "author": author.strip(), "encoding": encoding, "text": flatten(source)}


def pack(data: bytes) -> bytes:
    """Bytes as a PalmDOC record: a space with a letter in one byte, counted runs of what is no literal, else literals."""
    out = bytearray()
    i, n = 0, len(data)
    while i < n:
        c = data[i]
        if c == 0x20 and i + 1 < n and 0x40 <= data[i + 1] < 0x80:
            out.append(data[i + 1] ^ 0x80)
            i += 2
        elif c == 0 or 9 <= c < 0x80:
            out.append(c)
            i += 1
        else:
            j = i
            while j < n and j - i < 8 and (1 <= data[j] <= 8 or data[j] >= 0x80):
                j += 1
            out.append(j - i)
            out += data[i:j]
            i = j
    return bytes(out)


def write(title: str, author: str, source: str, record: int = 4096) -> bytes:
    """A book of one HTML source, compressed, with its metadata."""
    body = source.encode("utf-8")
    parts = [pack(body[i : i + record]) for i in range(0, len(body), record)]
    fields = [(k, v.encode("utf-8")) for k, v in ((100, author), (503, title)) if v]
    exth = b"EXTH" + struct.pack(">II", 12 + sum(8 + len(v) for _, v in fields), len(fields)) + b"".join(struct.pack(">II", k, 8 + len(v)) + v for k, v in fields)
    name = title.encode("utf-8")
    head = bytearray(16 + 232)
    struct.pack_into(">HHIHHH", head, 0, PALMDOC, 0, len(body), len(parts), record, 0)
    head[16:20] = b"MOBI"
    struct.pack_into(">III", head, 20, 232, 2, UTF8)
    struct.pack_into(">II", head, 84, len(head) + len(exth), len(name))
    struct.pack_into(">I", head, 128, 0x40)
    recs = [bytes(head) + exth + name, *parts]
    at, offsets = 78 + 8 * len(recs), []
    for r in recs:
        offsets.append(at)
        at += len(r)
    top = b"book".ljust(32, b"\0") + bytes(28) + b"BOOKMOBI" + bytes(8) + struct.pack(">H", len(recs))
    return top + b"".join(struct.pack(">II", o, i) for i, o in enumerate(offsets)) + b"".join(recs)
