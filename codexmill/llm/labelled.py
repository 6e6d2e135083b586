"""Documents labelled by how they were made, for rules that tell prose from lists, tables and junk.

Prose is taken from books: consecutive paragraphs, dialogue, lines of verse, prose with a few rows of a list or a table or
with a refrain. The rest is put together from the books' words by a form: lists, contents, tables, addresses, codes,
signs, letters, unconnected words, one phrase over and over. No statistic takes part in the labels, so rules induced on
some of these documents can be measured on others.

Bounds: PASSAGES books at most, and as many documents as are asked for; the same books and seed give the same ones.
"""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Books that passages are taken from, at most.
PASSAGES = 400
_SENTENCE = re.compile(r"[^.!?。！？…]+[.!?。！？…]+[”’»\"」』]*\s*")
_WORD = re.compile(r"[^\W\d_]+")
_HAN = re.compile(r"[一-鿿]")


def passages(books: DataFrame, most: int = PASSAGES) -> list[list[str]]:
    """Paragraphs of `most` books (by book_id), those that end as sentences do."""
    rows = books.where("flat_text is not null and book_id is not null").groupBy("book_id").agg(F.min("flat_text").alias("t")).orderBy("book_id").limit(most).collect()
    out = []
    for r in rows:
        ps = [p.strip() for p in r.t.split("\n") if len(p.strip()) > 30 and re.search(r"[.!?。！？…”’»]\s*\Z", p)]
        if len(ps) > 3:
            out.append(ps)
    return out


class _Maker:
    def __init__(self, books: list[list[str]], seed: int):
        self.r, self.books = random.Random(seed), books

    def paragraphs(self, n: int) -> list[str]:
        ps = self.r.choice(self.books)
        i = self.r.randrange(max(len(ps) - n, 1))
        return ps[i : i + n]

    def sentences(self, n: int) -> list[str]:
        out: list[str] = []
        while len(out) < n:
            out += [s.strip() for s in _SENTENCE.findall(" ".join(self.paragraphs(3)))]
        return out[:n]

    def words(self) -> list[str]:
        """Words of one passage, in its order (two characters each in Chinese)."""
        text = " ".join(self.paragraphs(4))
        if len(_HAN.findall(text)) > len(text) / 4:
            return ["".join(x) for run in re.findall(r"[一-鿿]{2,}", text) for x in zip(run[::2], run[1::2])]
        return _WORD.findall(text) or ["x"]

    def phrase(self, least: int = 1, most: int = 3) -> str:
        w = self.words()
        n = self.r.randint(least, most)
        i = self.r.randrange(max(len(w) - n, 1))
        got = w[i : i + n]
        return ("" if _HAN.match(got[0]) else " ").join(got)

    def rows(self, kind: str, n: int) -> list[str]:
        r = self.r
        if kind == "bullets":
            mark = r.choice(["- ", "* ", "• ", "· ", "– "])
            return [mark + self.phrase() for _ in range(n)]
        if kind == "numbered":
            form = r.choice(["{}. {}", "{}) {}", "({}) {}"])
            return [form.format(i + 1, self.phrase()) for i in range(n)]
        if kind == "bare":
            return [self.phrase() for _ in range(n)]
        if kind == "contents":
            return [f"{self.phrase(1, 4)} {r.choice(['.', '…', '-']) * r.randint(5, 30)} {r.randint(1, 400)}" for _ in range(n)]
        if kind == "keyed":
            return [f"{self.phrase(1, 2)}: {self.phrase(1, 3)}" for _ in range(n)]
        if kind == "table":
            mark, k = r.choice([" | ", "\t", "    ", ";"]), r.randint(2, 5)
            cell = lambda: r.choice([self.phrase(1, 2), str(r.randint(1, 9999)), f"{r.random() * 100:.2f}", f"20{r.randint(10, 26)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}"])
            out = [mark.join(cell() for _ in range(k)) for _ in range(n)]
            return [f"| {x} |" for x in out] if mark == " | " and r.random() < 0.7 else out
        if kind == "addresses":
            name = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(4, 10)))
            form = r.choice(["https://www.{}.org/{}/{}", "{}.net/{}?{}=1", "{}@{}.{}.com"])
            return [form.format(name(), name(), name()) for _ in range(n)]
        if kind == "signs":
            return ["".join(r.choice("!#$%&*+-/:;<=>?@[]^_{|}~\\.") for _ in range(r.randint(10, 70))) for _ in range(n)]
        if kind == "codes":
            return [" ".join("".join(r.choice("0123456789abcdef") for _ in range(r.randint(4, 16))) for _ in range(r.randint(1, 7))) for _ in range(n)]
        if kind == "numbers":
            return [" ".join(str(r.randint(0, 10 ** r.randint(1, 7))) for _ in range(r.randint(1, 10))) for _ in range(n)]
        if kind == "letters":
            return [" ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(r.randint(2, 12))) for _ in range(r.randint(2, 10))) for _ in range(n)]
        if kind == "words":
            out = []
            for _ in range(n):
                w = sorted(set(self.words()))
                out.append(" ".join(r.choice(w) for _ in range(r.randint(6, 20))))
            return out
        p = self.phrase(1, 4) + r.choice(["", "", ",", "!", "."])  # one phrase over and over
        return [("" if _HAN.match(p) else " ").join([p] * k) for k in [r.randint(1, 14) for _ in range(n)]] if r.random() < 0.7 else [self.r.choice([p, self.sentences(1)[0]])] * max(n, 5)

    def other(self) -> tuple[str, str]:
        r = self.r
        kind = r.choice(["bullets", "numbered", "bare", "contents", "keyed", "table", "table", "addresses", "signs", "codes", "numbers", "letters", "words", "phrase"])
        rows = self.rows(kind, r.randint(4, 30))
        if kind in ("bullets", "numbered", "words", "keyed") and r.random() < 0.3:  # full stops make no prose
            rows = [x + "." if r.random() < 0.9 else x for x in rows]
        if r.random() < 0.25:
            rows.insert(0, self.sentences(1)[0])
        elif r.random() < 0.25 and len(rows) > 7:  # a note between the rows
            rows.insert(r.randrange(len(rows)), self.sentences(1)[0])
        return r.choice(["\n", "\n\n"]).join(rows), kind

    def prose(self) -> tuple[str, str]:
        r = self.r
        kind = r.choice(["prose", "prose", "prose", "short", "dialogue", "verse", "with rows", "refrain"])
        if kind == "short":
            return " ".join(self.sentences(r.randint(1, 3))), kind
        if kind == "dialogue":
            mark = r.choice(["“{}”", "— {}", "«{}»", "„{}“"])
            return "\n\n".join(mark.format(s) if r.random() < 0.8 else s for s in self.sentences(r.randint(3, 20))), kind
        if kind == "verse":
            lines: list[str] = []
            for s in self.sentences(r.randint(3, 10)):
                if _HAN.search(s):
                    lines += [x for x in re.split(r"(?<=[，、；：])", s) if x]
                else:
                    w = s.split()
                    n = r.randint(5, 9)
                    lines += [" ".join(w[i : i + n]) for i in range(0, len(w), n)]
            return "\n".join(lines), kind
        ps = self.paragraphs(r.randint(3, 14))
        if kind == "with rows":
            at, rows = r.randrange(len(ps) + 1), self.rows(r.choice(["bullets", "numbered", "table", "keyed"]), r.randint(2, 4))
            ps = [*ps[:at], *rows, *ps[at:]]
        elif kind == "refrain":
            s = self.sentences(1)[0]
            ps = [x for p in ps for x in ([p, s] if r.random() < 0.4 else [p])]
        return r.choice(["\n", "\n\n"]).join(ps), kind


def documents(books: list[list[str]], n: int, seed: int = 1) -> list[tuple[str, bool, str]]:
    """(text, is other, form) of n documents, half of them prose."""
    m = _Maker(books, seed)
    out = []
    for i in range(n):
        text, form = m.other() if i % 2 else m.prose()
        out.append((text, bool(i % 2), form))
    return out
