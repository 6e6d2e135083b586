"""Problem 1: text decoded with the wrong character encoding.

Method: pairs of adjacent characters are scored by their contribution to the corpus' mutual information
(document frequencies of pairs and characters, counted over every distinct text in one distributed pass, without the
lines that show traces of a wrong decoding); maximum-scoring
segments (Ruzzo-Tompa) isolate the improbable runs; only inside those runs are inverse mappings tried, i.e. the run
is encoded with a codec that may have been applied by mistake and decoded with the right one. A mapping counts if
the restored run is clearly more probable than the garbled one.

Defined results: null or empty texts have no runs; a text is returned unchanged where nothing can be restored;
repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexmill.llm.common import code_points
from codexmill.llm.lookalike import CYRILLIC
from codexmill.session import materialise, texts

#: Pairs in less than this share of the documents count as unseen (in a corpus of up to 65,536 documents none is left out). What is broadcast,
#: 12 bytes a pair, so stops growing with the corpus: a share has no more pairs however many documents there are.
FLOOR = 2.0**-16
#: Pairs that a task holds before it adds them up.
HELD = 4_000_000
#: Characters are counted exactly (there are at most 0x110000).
N_CHARS = 0x110000
#: A pair in less than this share of the documents is improbable (log2 of the share times its mutual information).
RARE = -3.3
#: The same for passages amid text of a rarer language, whose own pairs are improbable as well.
VERY_RARE = -7.0
#: Bits by which a restored run's mean pair score must exceed the garbled run's.
MARGIN = 1.0
#: Bits that a span must gain in all; UTF-8 sequences prove much by being valid.
LEAST, LEAST_UTF8 = 4.5, 2.0

# Codecs a text may have been read with by mistake, each with those it may have been written in.
INVERSES = {
    "latin": ("utf-8", "utf-8 twice", "gb18030", "big5", "mac_roman", "cp1251", "koi8_r", "cp866", "cp437", "cp850"),
    "cp437": ("utf-8", "latin", "gb18030"),
    "cp850": ("utf-8", "latin", "gb18030"),
    "mac_roman": ("utf-8", "latin", "gb18030"),
    "gb18030": ("utf-8", "big5"),
    "big5": ("gb18030", "utf-8"),
    "cp1251": ("utf-8", "koi8_r", "cp866", "mac_cyrillic", "latin"),
    "koi8_r": ("utf-8", "cp1251", "cp866", "latin"),
    "cp866": ("utf-8", "cp1251", "koi8_r", "latin"),
    "mac_cyrillic": ("utf-8", "cp1251", "koi8_r"),
    "cp1250": ("utf-8", "latin"),
    "utf-8": ("gb18030",),
}
#: Codecs that map single bytes and multiple bytes.
SINGLE = {"latin", "cp437", "cp850", "mac_roman", "cp1251", "koi8_r", "cp866", "mac_cyrillic", "cp1250"}


def _byte_maps() -> dict[str, dict[int, int]]:
    """Per single-byte codec: code point -> byte for str.translate into latin-1. 'latin' joins cp1252 with the C1 controls of latin-1."""
    out = {}
    for name in SINGLE:
        m: dict[int, int] = {}
        for b in range(128, 256):
            try:
                m[ord(bytes([b]).decode("cp1252" if name == "latin" else name))] = b
            except UnicodeDecodeError:
                m[b] = b
        if name == "latin":
            for b in range(128, 160):
                m.setdefault(b, b)
        out[name] = m
    return out


BYTE_OF = _byte_maps()
_TABLE = {name: "".join(map(chr, range(128))) + "".join({v: chr(k) for k, v in sorted(m.items(), key=lambda x: (x[0] < 160, x[0]), reverse=True)}[v] for v in range(128, 256)) for name, m in BYTE_OF.items()}
_CHARMAP = {name: codecs.charmap_build(t) for name, t in _TABLE.items()}


def encode(text: str, codec: str) -> bytes | None:
    """The bytes that the codec reads as this text, or None."""
    try:
        if codec in _CHARMAP:
            return codecs.charmap_encode(text, "strict", _CHARMAP[codec])[0]
        return text.encode(codec, "surrogatepass" if codec.startswith("utf") else "strict")
    except UnicodeEncodeError:
        if codec != "latin":
            return None
    try:  # C1 controls of latin-1 and what cp1252 has in their place, mixed
        return text.translate(BYTE_OF["latin"]).encode("latin-1")
    except UnicodeEncodeError:
        return None


def decode(data: bytes, codec: str) -> str | None:
    """The text of these bytes, or None where they are not valid."""
    if codec in _TABLE:
        return codecs.charmap_decode(data, "strict", _TABLE[codec])[0]
    try:
        if codec == "utf-8 twice":
            again = encode(data.decode("utf-8"), "latin")
            return None if again is None else again.decode("utf-8")
        return data.decode(codec)
    except UnicodeDecodeError:
        if codec == "utf-8 twice":
            return None
        lossy = data.decode(codec, "replace")  # some bytes did not survive
        return lossy if lossy.count("\ufffd") * 10 <= len(lossy) else None


def _suspect() -> re.Pattern:
    """What a line of correct text does not hold: UTF-8 sequences read as single bytes, runs of accented letters, double
    bytes or C1 controls, signs within words, Cyrillic words in inverted case."""

    def some(codec: str, *ranges: tuple[int, int]) -> str:
        return "[" + "".join(re.escape(_TABLE[codec][b]) for i, j in ranges for b in range(i, j + 1)) + "]"

    out = []
    for codec in sorted(SINGLE):
        cont = some(codec, (0x80, 0xBF))
        two, cyrillic = some(codec, (0xC2, 0xC5)) + cont, some(codec, (0xD0, 0xD1)) + cont
        dash, han = some(codec, (0xE2, 0xE2)) + some(codec, (0x80, 0x84)) + cont, some(codec, (0xE3, 0xE9), (0xEF, 0xEF)) + cont * 2
        # a single sequence may be a letter and a mark: in Cyrillic text, or in a word of capitals
        out += [f"(?:{cyrillic}){{2}}", f"(?:{han}){{2}}", some(codec, (0xF0, 0xF0)) + cont * 3]
        out += [f"(?:{two}){{2}}"] + ([f"(?:{dash}){{2}}"] if codec in _CYRILLIC else [f"(?<=[a-z]){two}|{two}[a-z]", dash])
    signs = "‚„†‡ˆ‰Š‹ŒŽ•˜™›Ÿƒ¡-\xac\xae-¶¸-Þ×÷ΘΦΩΣΓδφεπστ\u2190-\u25ff"
    out += ["[\x80-\x9f\ufffd]", "[À-ÿ]{4}", "(?:[\xb0-\xf7][\xa1-\xfe]){2}", f"(?<=[a-z])[{signs}]+[a-z]"]
    out += ["(?<![\u0400-\u04ff])[а-яё][А-ЯЁ]{3}", "(?<=[а-я])[‚ѓ„†‡€‰Љ‹ЊЌЋЏђ™љ›њќћџЎўЈ¤Ґ¦§©Є¬®Ї°±Ііґµ¶№єјЅѕї\u2200-\u25ff]+[а-я]", "[\u0400-\u04ff][\u2500-\u25ff]|[\u2500-\u25ff][\u0400-\u04ff]"]
    # none begins with an ASCII or a Chinese character
    return re.compile(f"(?=[\x80-\u2e7f\ufffd])(?:{'|'.join(out)})")


_CYRILLIC = ("cp1251", "koi8_r", "cp866", "mac_cyrillic")
_SUSPECT, _HAN = _suspect(), re.compile("[\u3400-\u9fff]{6,}")


def _double(run: str) -> bool:
    """Whether a run of Chinese characters is valid UTF-8 that was read as GB18030."""
    try:
        codecs.utf_8_decode(run.encode("gb18030"), "strict", False)
    except UnicodeDecodeError:
        return False
    return True


def unsuspected(text: str) -> str:
    """The lines that show no trace of a wrong decoding: only these may vouch for pairs, however many books share a fault."""
    return "\n".join(s for s in text.split("\n") if s.isascii() or not (_SUSPECT.search(s) or any(map(_double, _HAN.findall(s)))))


class Counts:
    """Document frequencies of adjacent pairs with a character beyond ASCII, and of characters, exactly."""

    def __init__(self):
        self.chars, self.docs = np.zeros(N_CHARS, dtype=np.int64), 0
        self.keys, self.n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.new: list[np.ndarray] = []
        self.held = 0

    def add(self, text: str) -> None:
        self.docs += 1
        text = unsuspected(text)
        a = code_points(f" {text} ")
        self.chars[np.unique(a)] += 1
        if not text.isascii():
            self.new.append(np.unique(pair_keys(a[:-1], a[1:])))
            self.held += len(self.new[-1])
            if self.held > HELD:
                self.fold()

    def fold(self) -> None:
        """Adds up what came since the last time."""
        keys = np.concatenate([self.keys, *self.new])
        n = np.concatenate([self.n, np.ones(len(keys) - len(self.n), dtype=np.int64)])
        self.keys, at = np.unique(keys, return_inverse=True)
        self.n = np.bincount(at, weights=n, minlength=len(self.keys)).astype(np.int64)
        self.new, self.held = [], 0


def pair_keys(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers of the pairs that have a character beyond ASCII."""
    keep = (x > 127) | (y > 127)
    return x[keep].astype(np.int64) << 21 | y[keep].astype(np.int64)


def count_pairs(texts: DataFrame, col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(keys, document frequencies, character frequencies, documents) over the lines of the distinct texts that show no
    trace of a wrong decoding: neither copies nor a fault that many books share make garbled pairs probable.

    Each task adds up its own counts first; pairs below FLOOR stay on the executors."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = Counts()
        for b in batches:
            for t in b[col]:
                if t:
                    c.add(t)
        c.fold()
        k = np.nonzero(c.chars)[0]
        yield pd.DataFrame({"kind": np.repeat([0, 1, 2], [len(c.keys), len(k), 1]).astype("int8"), "k": np.concatenate([c.keys, k, [0]]).astype("int64"), "n": np.concatenate([c.n, c.chars[k], [c.docs]]).astype("int64")})

    got = materialise(texts.select(col).distinct().mapInPandas(part, "kind byte, k long, n long").groupBy("kind", "k").agg(F.sum("n").alias("n")), "pair-counts")
    docs = int(got.where("kind = 2").agg(F.sum("n")).first()[0] or 0)
    got = got.where((F.col("kind") == 1) | ((F.col("kind") == 0) & (F.col("n") >= docs * FLOOR))).toPandas()
    p, c = got[got.kind == 0].sort_values("k"), got[got.kind == 1]
    chars = np.zeros(N_CHARS, dtype=np.float32)
    chars[c.k.to_numpy()] = c.n
    return p.k.to_numpy().astype(np.int64), p.n.to_numpy().astype(np.float32), chars, docs


class PairModel:
    """Scores pairs: log2 of the pair's contribution p(xy) * log2(p(xy) / p(x)p(y)) to the mutual information."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, chars: np.ndarray, docs: int):
        self.keys, self.docs = keys, max(docs, 1)
        self.log_n = np.log2(np.append(n, 0.25)).astype(np.float32)  # the last is that of unseen pairs
        self.chars = np.log2(np.maximum(chars, 0.5)).astype(np.float32)
        #: Candidates of runs and of parts of runs that came before.
        self.runs: dict[tuple[str, str, str], list[tuple]] = {}
        self.parts: dict[tuple[str, str], tuple] = {}

    def scores(self, a: np.ndarray) -> np.ndarray:
        """Of each adjacent pair of code points; pairs of ASCII characters give nan."""
        x, y = a[:-1], a[1:]
        out = np.full(len(x), np.nan, dtype=np.float32)
        at = np.flatnonzero((x > 127) | (y > 127))
        x, y = x[at], y[at]
        if not len(at) or not len(self.keys):
            out[at] = -2.0 - np.log2(self.docs) - 2.0
            return out
        k = x.astype(np.int64) << 21 | y.astype(np.int64)
        i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        ln = np.where(self.keys[i] == k, self.log_n[i], self.log_n[-1])
        # unclipped, or with wider bounds, chance pairs of rare characters are taken for probable ones (figures in the README)
        mi = np.clip(ln + np.log2(self.docs) - self.chars[x] - self.chars[y], 0.25, 4.0)
        out[at] = ln - np.log2(self.docs) + np.log2(mi)
        return out


def segments(score: np.ndarray) -> list[tuple[int, int]]:
    """Maximal scoring segments [i, j) of a score array (Ruzzo-Tompa over runs of one sign)."""
    if not len(score) or score.max() <= 0:
        return []
    sign = score > 0
    cut = np.flatnonzero(np.diff(sign)) + 1
    starts = np.concatenate([[0], cut])
    ends = np.concatenate([cut, [len(score)]])
    sums = np.add.reduceat(score, starts)
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    lower: list[int] = []  # of each segment on the stack, the last one below it whose sum before is smaller
    total = 0.0
    for i, j, s in zip(starts.tolist(), ends.tolist(), sums.tolist()):
        if s <= 0:
            total += s
            continue
        cur = (i, j, total, total + s)
        total += s
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= cur[2]:
                k = lower[k]
            if k < 0 or stack[k][3] >= cur[3]:
                stack.append(cur)
                lower.append(k)
                break
            cur = (stack[k][0], cur[1], stack[k][2], cur[3])
            del stack[k:], lower[k:]
    return [(a, b) for a, b, _, _ in stack]


def improbable_runs(text: str, model: PairModel) -> list[tuple[int, int]]:
    """Spans of the text whose pairs are improbable, widened to whole runs of characters beyond ASCII."""
    a = code_points(f" {text} ")
    s = model.scores(a)
    s = np.where(np.isnan(s), -0.35, np.clip(RARE - s, -6.0, 6.0))
    # score k is of positions k-1, k of the text
    out: list[tuple[int, int]] = []
    for i, j in segments(s):
        i, j = max(i - 1, 0), min(j, len(text))
        while i > 0 and ord(text[i - 1]) > 127 and ord(text[i]) > 127 and _same_side(text[i - 1], text[i]):
            i -= 1
        while j < len(text) and ord(text[j - 1]) > 127 and ord(text[j]) > 127 and _same_side(text[j - 1], text[j]):
            j += 1
        if out and i <= out[-1][1]:
            out[-1] = (out[-1][0], max(j, out[-1][1]))
        else:
            out.append((i, j))
    return out


def strict_runs(text: str, model: PairModel) -> list[tuple[int, int]]:
    """Spans whose pairs are very improbable, exactly: a garbled passage inside a sentence, without its neighbours."""
    s = model.scores(code_points(f" {text} "))
    s = np.where(np.isnan(s), -0.8, np.clip(VERY_RARE - s, -6.0, 6.0))
    out = []
    for i, j in segments(s):
        if j - i > 2:
            out.append((i, j - 1))
    return out


def _same_side(a: str, b: str) -> bool:
    return (ord(a) >= 0x2E80) == (ord(b) >= 0x2E80)


def _usable(codec: str):
    """Regular expression of the maximal spans of a run that a codec can have produced."""
    if codec in BYTE_OF:
        return re.compile("[\x00-\x7f" + "".join(re.escape(chr(c)) for c in BYTE_OF[codec]) + "]*[" + "".join(re.escape(chr(c)) for c in BYTE_OF[codec]) + "][\x00-\x7f" + "".join(re.escape(chr(c)) for c in BYTE_OF[codec]) + "]*")
    if codec in ("gb18030", "big5"):
        return re.compile("[\x00-\x7f\u00a0-\ud7ff\ue000-\uffee\U00020000-\U0002ffff]*[\u00a0-\ud7ff\ue000-\uffee\U00020000-\U0002ffff][\x00-\x7f\u00a0-\ud7ff\ue000-\uffee\U00020000-\U0002ffff]*")
    return re.compile("[^\ufffd]*[^\x00-\x7f\ufffd][^\ufffd]*")


_SPANS = {c: _usable(c) for c in INVERSES}
_NON_ASCII = re.compile("[^\x00-\x7f]")
_SCRIPT = {"gb18030": re.compile("[\u4e00-\u9fff]"), "big5": re.compile("[\u4e00-\u9fff]"), "cp1251": re.compile("[\u0410-\u044f]"), "koi8_r": re.compile("[\u0410-\u044f]"), "cp866": re.compile("[\u0410-\u044f]"), "mac_cyrillic": re.compile("[\u0410-\u044f]")}
_CONTROL = re.compile("[\x00-\x08\x0b\x0e-\x1f\x7f-\x9f]")


class _Of(dict):
    """A property of each character, remembered."""

    def __init__(self, test):
        super().__init__()
        self.test = test

    def __missing__(self, c: str) -> bool:
        got = self[c] = bool(self.test(c))
        return got


_SIGNS = {"So", "Sm", "Sc", "Sk", "Co", "Cn", "Cf", "No"}
_SIGN = _Of(lambda c: unicodedata.category(c) in _SIGNS).__getitem__
_SEEN = _Of(lambda c: c > "\x7f" and not c.isspace() and unicodedata.category(c) != "Cf").__getitem__


def _plain(new: str, old: str, right: str) -> bool:
    """Whether a restored span consists of letters, digits and punctuation (signs only where the span had them); a soft hyphen is a byte of codecs of several bytes only."""
    if "\xad" in old and right not in ("utf-8", "utf-8 twice", "gb18030"):
        return False
    return any(map(_SEEN, old)) and not any(map(_SIGN, set(new).difference(old)))


def _proper(span: str) -> bool:
    """Whether most Cyrillic letters of a span look like no Latin letter."""
    own = [c for c in span if c > "\x7f" and c.isalpha()]
    return sum(c not in CYRILLIC for c in own) * 2 > len(own)


def _mean_scores(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: PairModel) -> np.ndarray:
    """Mean pair score of each piece [start, end) of the code points."""
    s = np.append(model.scores(joined), np.nan)
    s[ends - 1] = np.nan
    ok = ~np.isnan(s)
    return np.add.reduceat(np.where(ok, s, 0.0), starts) / np.maximum(np.add.reduceat(ok.astype(np.int64), starts), 1)


def _means(texts: list[str], model: PairModel) -> np.ndarray:
    """Mean pair score of each text (each begins and ends with its neighbour in the document)."""
    ends = np.cumsum([len(t) for t in texts])
    return _mean_scores(code_points("".join(texts)), np.concatenate([[0], ends[:-1]]), ends, model)


_LINE, _TOKEN = re.compile("[^\n]*[^\x00-\x7f][^\n]*"), re.compile("\\S*[^\x00-\x7f\\s]\\S*(?:[\xa0\x85]\\S*)?")


def _parts(text: str, i: int, j: int) -> list[tuple[int, int]]:
    """The span itself, its lines and its tokens: a passage may be garbled beside correct ones."""
    out = [(i, j)]
    for m in _LINE.finditer(text, i, j):
        out.append(m.span())
        out += [t.span() for t in _TOKEN.finditer(text, *m.span())]
    return list(dict.fromkeys(out))


def _to() -> dict[tuple[str, str], np.ndarray]:
    """Of each two single-byte codecs: the character that each character of the wrong one becomes."""
    out = {}
    for wrong, rights in INVERSES.items():
        for right in set(rights) & SINGLE if wrong in SINGLE else ():
            t = np.arange(N_CHARS, dtype="<u4")
            for c, byte in BYTE_OF[wrong].items():
                t[c] = ord(_TABLE[right][byte])
            out[wrong, right] = t[:0x10000]
    return out


_TO = _to()
_NO_TWO_BYTES = re.compile("[\xa0\xad\u0800-\U0010ffff]")
#: A lead and a continuation byte of UTF-8, as each single-byte codec shows them.
_LEADS = {w: re.compile("[" + "".join(re.escape(_TABLE[w][b]) for b in range(0xC2, 0xF5)) + "][" + "".join(re.escape(c) for b in range(0x80, 0xC0) for c in {_TABLE[w][b], *(chr(k) for k, v in BYTE_OF[w].items() if v == b)}) + "]") for w in SINGLE}


def _fit(span: str, new: str | None, wrong: str, right: str) -> bool:
    """Whether a reading may be the right one, however probable it is."""
    if new is None or new == span or _CONTROL.search(new) or not _plain(new, span, right):
        return False
    if right in _SCRIPT and len(_SCRIPT[right].findall(new)) < 2:
        return False
    return not (right == "latin" and wrong in _SCRIPT and not _proper(span))  # letters that look like Latin ones prove nothing


def reading(span: str, wrong: str, right: str) -> str | None:
    """What a span may have been before it was read with the codec `wrong` instead of `right` (a codec of several bytes)."""
    if wrong in _LEADS and right.startswith("utf-8") and not _LEADS[wrong].search(span):
        return None
    # bytes that were no UTF-8 but taken for it give two-byte sequences only
    data = None if wrong == "utf-8" and _NO_TWO_BYTES.search(span) else encode(span, wrong)
    new = None if data is None else decode(data, right)
    return new if _fit(span, new, wrong, right) else None


#: Length of runs and of their parts whose candidates are remembered, and entries of each memory (beyond it it starts anew; results do not change).
SHORT, MEMORY = 64, 200_000


_WIDE = re.compile("[\u2500-\u27bf\u2e80-\U0010ffff]")


class _Candidates:
    """Candidates of the parts of some runs, collected for one vectorised scoring for each codec."""

    def __init__(self, text: str, model: PairModel):
        self.text, self.model = text, model

    def of(self, runs: list[tuple[int, int]]) -> list[list[tuple]]:
        """Of each run: (gain in bits, i, j, restored, wrong, right) of every accepted mapping of a part of it."""
        out: list[list[tuple]] = [[] for _ in runs]
        parts: dict[tuple[int, int], list[tuple[int, int]]] = {}
        text, known = self.text, self.model.parts
        wide = [_WIDE.search(text, i, j) is not None for i, j in runs]
        n = len(text)
        number: dict[tuple[int, int], int] = {}  # of each part that some codec has to be tried on
        tried: list[tuple[str, dict[int, list[int]]]] = []  # of each codec: its parts, with their runs
        for wrong in INVERSES:
            todo: dict[int, list[int]] = {}
            for k, (i, j) in enumerate(runs):
                if wrong in ("gb18030", "big5") and not wide[k]:
                    continue  # two-byte codecs give Chinese characters, or kana and forms of their width
                mine = out[k]
                for m in _SPANS[wrong].finditer(text, i, j):
                    at = m.span()
                    p = parts.get(at)
                    if p is None:
                        p = parts[at] = _parts(text, *at)
                    for part in p:
                        x, y = part
                        if y - x <= SHORT and x and y < n:
                            got = known.get((wrong, text[x - 1 : y + 1]))
                            if got is not None:
                                for g, new, right in got:
                                    mine.append((g, x, y, new, wrong, right))
                                continue
                        todo.setdefault(number.setdefault(part, len(number)), []).append(k)
            tried.append((wrong, todo))
        if not number:
            return out
        spans = list(number)
        self._measure(spans)
        for wrong, todo in tried:
            if not todo:
                continue
            for part, got in zip(todo, self._scored(spans, np.fromiter(todo, np.int64, len(todo)), wrong)):
                x, y = spans[part]
                if y - x <= SHORT and x and y < n:
                    if len(known) > MEMORY:
                        known.clear()
                    known[wrong, text[x - 1 : y + 1]] = got
                for k in todo[part]:
                    out[k] += [(g, x, y, new, wrong, right) for g, new, right in got]
        return out

    def _measure(self, spans: list[tuple[int, int]]) -> None:
        """Code points of all parts with their neighbours, their mean scores and numbers of characters beyond ASCII: once for all codecs."""
        text, n_text = self.text, len(self.text)
        self.points = code_points("".join([(text[i - 1] if i else " ") + text[i:j] + (text[j] if j < n_text else " ") for i, j in spans]))
        self.ends = np.cumsum([j - i + 2 for i, j in spans])
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.wide = self.points > 127
        self.wide[self.starts] = False
        self.wide[self.ends - 1] = False
        self.n = np.add.reduceat(self.wide.astype(np.int64), self.starts)
        self.old = _mean_scores(self.points, self.starts, self.ends, self.model)

    def _scored(self, spans: list[tuple[int, int]], at: np.ndarray, wrong: str) -> list[tuple]:
        """Of each part spans[k], k in at, the accepted readings: (gain in bits, restored, right).

        Single-byte codecs map characters to characters, so all parts are mapped and scored at once, and only those that
        gain enough are looked at; of the others, what is valid is scored together."""
        text, n_text = self.text, len(self.text)
        out: list[tuple] = [()] * len(at)
        sizes = self.ends[at] - self.starts[at]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        where = np.repeat(self.starts[at] - starts, sizes) + np.arange(int(ends[-1]))
        joined, wide, n, old = self.points[where], self.wide[where], self.n[at], self.old[at]
        spans = [spans[k] for k in at.tolist()]
        for right in INVERSES[wrong]:
            enough = n >= (2 if right in _SCRIPT else 1)
            if not enough.any():
                continue
            if (wrong, right) in _TO:
                mapped = joined.copy()
                mapped[wide] = _TO[wrong, right][joined[wide]]
                gain = _mean_scores(mapped, starts, ends, self.model) - old
                need, least = _needed(wrong, right)
                good = enough & (gain > need + np.where(n <= 3, 1.0, 0.0)) & (gain * n > least)
                for k in np.flatnonzero(good).tolist():
                    i, j = spans[k]
                    new = decode(encode(text[i:j], wrong), right)
                    if _fit(text[i:j], new, wrong, right):
                        out[k] += ((float(gain[k] * n[k]), new, right),)
                continue
            tried = [(k, new) for k in np.flatnonzero(enough).tolist() if (new := reading(text[slice(*spans[k])], wrong, right)) is not None]
            if not tried:
                continue
            around = [((text[i - 1] if i else " "), (text[j] if j < n_text else " ")) for k, _ in tried for i, j in (spans[k],)]
            means = _means([a + t + b for (a, b), (_, t) in zip(around, tried)], self.model)
            need, least = _needed(wrong, right)
            short = 0.0 if right.startswith("utf-8") else 1.0
            for (k, t), mean in zip(tried, means.tolist()):
                gain = mean - float(old[k])
                if gain > need + (short if n[k] <= 3 else 0.0) + t.count("\ufffd") * 4.0 / n[k] and gain > 0 and gain * n[k] > least:
                    out[k] += ((float(gain * n[k]), t, right),)
        return out


def _needed(wrong: str, right: str) -> tuple[float, float]:
    """(mean gain, gain in all) that a mapping must exceed."""
    utf8 = right.startswith("utf-8")
    if wrong in _CYRILLIC and right in _CYRILLIC:
        return MARGIN + 2.0, 20.0  # both readings are Cyrillic
    if wrong in ("gb18030", "big5"):
        return MARGIN - utf8, 6.0 if utf8 else 20.0  # rare names are improbable as well
    return MARGIN - utf8, LEAST_UTF8 if utf8 else LEAST


def _candidates(text: str, runs: list[tuple[int, int]], model: PairModel) -> list[tuple]:
    """Candidates of all runs; those of short runs are remembered with the characters beside them."""
    found: list[tuple] = []
    todo = []
    for i, j in runs:
        got = model.runs.get((text[i - 1 : i] if i else "", text[i:j], text[j : j + 1])) if j - i <= SHORT else None
        if got is None:
            todo.append((i, j))
        else:
            found += [(g, i + x, i + y, new, wrong, right) for g, x, y, new, wrong, right in got]
    for (i, j), got in zip(todo, _Candidates(text, model).of(todo)):
        found += got
        if j - i <= SHORT:
            if len(model.runs) > MEMORY:
                model.runs.clear()
            model.runs[(text[i - 1 : i] if i else "", text[i:j], text[j : j + 1])] = [(g, x - i, y - i, new, wrong, right) for g, x, y, new, wrong, right in got]
    return found


_ORDER = {c: k for k, c in enumerate(INVERSES)}


def inverse(text: str, runs: list[tuple[int, int]], model: PairModel) -> list[tuple[float, int, int, str]]:
    """Accepted inverse mappings (gain, i, j, restored) of spans inside the runs, the best ones, not overlapping."""
    found = list(dict.fromkeys(_candidates(text, runs, model)))
    # a lone rare sign may be correct: that it stands for another one takes a second passage with the same codecs
    pairs: dict[tuple[str, str], tuple[int, int]] = {}  # of each two codecs: where the first passage ends, where the last begins
    for _, i, j, _, wrong, right in found:
        first, last = pairs.get((wrong, right), (j, i))
        pairs[wrong, right] = min(first, j), max(last, i)
    kept = []
    for x in found:
        _, i, j, _, wrong, right = x
        if not right.startswith("utf-8") and len(own := _NON_ASCII.findall(text, i, j)) == 1 and _SIGN(own[0]):
            first, last = pairs[wrong, right]
            if not (first <= i or last >= j):
                continue
        kept.append(x)
    kept.sort(key=lambda x: (-x[0], x[1], _ORDER[x[4]]))
    out: list[tuple[float, int, int, str]] = []
    taken = np.zeros(len(text) + 1, dtype=bool)
    for x in kept:
        if not taken[x[1] : x[2]].any():
            taken[x[1] : x[2]] = True
            out.append(x[:4])
    return sorted(out, key=lambda x: x[1])


def _lost(text: str) -> bool:
    """Signs of a wrong decoding that no text holds otherwise: replacement characters, C1 controls, unassigned code points."""
    return any(c == "�" or "\x80" <= c <= "\x9f" or (c > "˿" and unicodedata.category(c) in ("Cn", "Co")) for c in text)


def repair(text: str | None, model: PairModel) -> tuple[str | None, bool, int]:
    """(text with what could be restored, whether a garbled passage was found, number of restored spans)."""
    if not text or text.isascii():
        return text, False, 0
    found, n, seen = False, 0, set()
    while text not in seen:  # text may have been read wrongly more than once
        seen.add(text)
        runs = improbable_runs(text, model)
        good = inverse(text, list(dict.fromkeys(runs + strict_runs(text, model))), model)
        if not good:
            break
        found, n = True, n + len(good)
        out, at = [], 0
        for _, i, j, new in good:
            out += [text[at:i], new]
            at = j
        text = "".join(out) + text[at:]
    return text, found or any(_lost(text[i:j]) for i, j in runs), n


def detect(df: DataFrame, key: str, text: str) -> DataFrame:
    """Every row with its key, whether it is garbled, the restored text and the number of restored runs."""
    model = df.sparkSession.sparkContext.broadcast(count_pairs(df, text))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = PairModel(*model.value)
        for b in batches:
            got = [repair(t, m) for t in b["t"]]
            yield pd.DataFrame({"k": b["k"], "garbled": [g[1] for g in got], "restored": [g[0] for g in got], "n_runs": [g[2] for g in got]})

    kind = df.schema[key].dataType.simpleString()
    return (
        df.select(F.col(key).alias("k"), F.col(text).alias("t"))
        .mapInPandas(part, f"k {kind}, garbled boolean, restored string, n_runs long")
        .withColumnRenamed("k", key)
    )


def p1_found(spark, sf_dir):
    """book_id of each book with a wrongly decoded passage."""
    return detect(texts(spark, sf_dir, "epub_books"), "book_id", "flat_text").where("garbled").select("book_id")


def p1_restored(spark, sf_dir):
    """Affected books with their text as far as it can be restored."""
    return detect(texts(spark, sf_dir, "epub_books"), "book_id", "flat_text").where("garbled").select("book_id", "restored", "n_runs")


QUERIES = {"p1_found": p1_found, "p1_restored": p1_restored}
SQL: dict[str, str] = {}
