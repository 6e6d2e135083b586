"""Problem 4: noise in text from scanned pages.

Method: the lines of a text are a sequence labelled by a hidden Markov model with the states body, break (body that ends
within a word), header (running header or footer) and number (page number); a line's observation is a symbol of layout
features (does its normal form come back at other page edges, is it the title, does it look like a page number, does it
stand at a page's edge, is it in capitals, what its end and the next line make together). The model starts from stated
factors and is trained on the whole corpus by Viterbi counts. What a line's end makes with the next line (a word, a
compound, neither) is told by the corpus' document frequencies. Misread words of body lines are told from rare ones by
document frequencies of words and of adjacent Chinese characters. Which letters are taken for which is learned from the
corpus (`confusions`): the stated ones are where it starts from. Paragraphs are then put together without headers, page
numbers and breaks.

Defined results: null, empty and blank texts have no lines; line numbers count every line; a line may be a break and
misread at once; headers and page numbers have no further kind; repeated rows of a book give one result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from codexmill.session import materialise, scratch, texts


#: Words whose counts are broadcast at most (12 bytes each). The counts of more lie sorted in files of the shared folder and are looked up there.
WORDS_MAX = 4_000_000
#: Of those files: words in one (about), words read at a time, and the first bits of a key by which most unseen words are told without reading (a bit each, 16 MB).
FILE_WORDS, BLOCK, FILTER_BITS = 8_000_000, 256, 27
_COUNT = np.dtype([("k", "<i8"), ("n", "<i8")])
STATES = ("body", "header", "number", "break")
#: Weight, in lines, of the stated factors against the corpus' counts.
PRIOR = 200.0

# How scanned characters are often misread (what is seen -> what was printed); the corpus confirms, refutes and adds.
CONFUSED = {
    "c": "e", "@": "aà", "f": "t", "l": "iIí", "5": "sS", "1": "lIi", "0": "oOóö", "b": "h", "6": "bB", "9": "gq", "8": "B", "I": "l", "i": "l", "$": "S", "3": "зЗ", "O": "0",
    "ri": "n", "cl": "d", "ii": "u", "rn": "m", "vv": "w", "li": "h", "nn": "m", "a": "а", "o": "о", "e": "е", "p": "р", "y": "у", "x": "х", "C": "С",
}
CONFUSED["c"] += "сé"
MERGED = {"m": ["rn"], "d": ["cl"], "w": ["vv"]}
_STATED = [(a, list(b)) for a, b in CONFUSED.items()] + list(MERGED.items())
_HAS_CYRILLIC = re.compile("[а-яА-Я]").search
HAN_CONFUSED = {
    "丼": "井", "入": "人", "太": "大", "犬": "大", "八": "人", "己": "已", "巳": "已", "已": "己", "末": "未", "未": "末", "土": "士", "士": "土", "曰": "日", "囗": "口",
    "千": "干", "干": "千", "夭": "天", "本": "木", "木": "本", "玉": "王", "王": "玉", "自": "白", "白": "自", "力": "刀", "刀": "力", "乌": "鸟", "鸟": "乌", "贝": "见",
    "见": "贝", "间": "问", "问": "间", "令": "今", "今": "令", "午": "牛", "牛": "午", "各": "名", "名": "各", "往": "住", "住": "往", "睛": "晴", "晴": "睛", "人": "入",
    "大": "太", "日": "曰", "目": "日", "候": "侯", "沒": "没", "没": "设", "设": "没", "拔": "拨", "拨": "拔", "免": "兔", "兔": "免", "风": "凤", "凤": "风", "折": "拆",
    "拆": "折", "戍": "戌", "戊": "戌", "夫": "天", "无": "天", "天": "夫", "申": "由", "甲": "由", "田": "由", "由": "田", "厂": "广", "广": "厂", "几": "儿", "儿": "几",
    "旦": "但", "的": "旳", "旳": "的", "說": "说", "説": "说", "门": "问", "闩": "门", "治": "冶", "冶": "治", "亨": "享", "享": "亨", "卷": "券", "券": "卷", "辛": "幸",
    "幸": "辛", "史": "吏", "吏": "史", "了": "子", "子": "了", "孑": "子", "冫": "氵", "古": "占", "占": "古", "右": "石", "石": "右",
}
HYPHENS = "-\xad¬‐"
_WORD = re.compile(r"[^\W_]+(?:[@$][^\W_]+)*(?:['’][^\W_]+)*|[@$]|(?<!\S)[@$][^\W_]+")
_TOKEN = re.compile(r"[^\s.,;:!?“”«»„‘…()\[\]—–\-¬\xad‐，。？！：；、\x0c\"]+")
_COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
_HAN = re.compile(r"[一-鿿，。“”、：；？！]+")
_DIGITISH = r"[0-9lOoISBgGzZ]"
_NUMBER = re.compile(rf"[\W_]*(?:(?:page|pag|p|seite|s|página|стр|страница|第)[.\s]*)?((?=[^\d]*\d|[lOoIi]+\W*\Z|[ivxlcdm]+\W*\Z)(?:{_DIGITISH}{{1,5}}|{_DIGITISH}(?:\s{_DIGITISH}){{1,4}}|[ivxlcdm]{{1,8}}))(?:\s*页)?[\W_]*\Z", re.I)
_FRAME = re.compile(rf"^\s*{_DIGITISH}{{1,4}}\s{{2,}}|\s{{2,}}{_DIGITISH}{{1,4}}\s*$")
_FOLD = str.maketrans("0158@cfb69iI", "olsbaethhgll")


_GAP, _HAS_NUMBER, _NO_LETTERS = re.compile(r"\s\s"), re.compile(r"[\d第]"), re.compile(r"[\W\d_]+")
_NUMBERED = re.compile(r"第.{1,4}(?=[章回节卷])|(?<!\w)\d+(?!\w)")


def normal(line: str) -> str:
    """Normal form of a possible header: page number off, misreadings and case folded, letters only."""
    s = line.strip("\x0c").rstrip()
    if _GAP.search(s):
        s = _FRAME.sub("", s)
    if _HAS_NUMBER.search(s):
        s = _NUMBERED.sub("", s)
    s = s.casefold().replace("rn", "m").replace("cl", "d").replace("vv", "w").replace("ii", "u").replace("ri", "n").translate(_FOLD)
    return _NO_LETTERS.sub("", s)


def _value(shape: str) -> int | None:
    s = shape.strip().replace(" ", "")
    fixed = s.translate(str.maketrans("lIiOoSsBgGzZ", "111005589622"))
    if fixed.isdigit():
        return int(fixed)
    roman = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    v = [roman.get(c) for c in s.lower()]
    return None if None in v else sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0]))


def _capitals(s: str) -> int:
    """Whether a short line is in capitals."""
    if len(s) >= 80 or s.islower():
        return 0
    letters = sum(map(str.isalpha, s))
    return int(letters > 0 and sum(map(str.isupper, s)) * 10 >= letters * 7)


_LAST, _FIRST = re.compile(r"([^\s.,;:!?“”«»„(—–]+)[-\xad¬‐]\Z"), re.compile(r"[^\s.,;:!?“”«»„‘…()\[\]—–，。]+")


def observe(text: str, title: str | None, reader: Reader) -> tuple[list[int], list[tuple[int, ...]]]:
    """Line numbers (from 0) of the non-blank lines and the features of each: repeats, title, number, edge, capitals, ending."""
    lines = text.split("\n")
    at = [i for i, s in enumerate(lines) if s.strip(" \t\r\x0c\xa0　")]
    forms = [normal(lines[i]) for i in at]
    edge = []
    for k, i in enumerate(at):
        first = k == 0 or at[k - 1] != i - 1 or "\x0c" in lines[i - 1] or lines[i].startswith("\x0c")
        last = k == len(at) - 1 or at[k + 1] != i + 1 or "\x0c" in lines[i + 1] or lines[i].endswith("\x0c")
        edge.append(int(first or last))
    t = normal(title or "")
    numbers = []
    for i in at:
        m = _NUMBER.match(lines[i].strip("\x0c ")) if len(lines[i]) < 60 else None
        numbers.append(_value(m.group(1)) if m else None)
    for k in range(len(at)):  # what stands next to a page number stands at the edge too
        if (k and numbers[k - 1] is not None and edge[k - 1]) or (k + 1 < len(at) and numbers[k + 1] is not None and edge[k + 1]):
            edge[k] = 1
    again, at_edge = Counter(forms), {f for f, e in zip(forms, edge) if e}
    edge = [1 if again[f] > 1 and f in at_edge and len(f) > 5 else e for f, e in zip(forms, edge)]
    seen = Counter(f for f, e in zip(forms, edge) if e and len(f) > 3)
    known = Counter(n for n in numbers if n is not None)
    out = []
    following: str | None = None  # the next line that is no plain header or number
    for k in range(len(at) - 1, -1, -1):
        s, f, n = lines[at[k]], forms[k], numbers[k]
        same = min(seen[f], 3) - 1 if edge[k] and seen[f] else 0
        is_title = int(bool(t) and len(t) > 3 and (f == t or f.startswith(t)) and len(f) < len(t) + 12)
        num = 0 if n is None else 2 if known[n - 1] or known[n + 1] or known[n - 2] or known[n + 2] else 1
        out.append((same, is_title, num, edge[k], _capitals(s.strip()), reader.ending(s.strip("\x0c").rstrip(), following)))
        if not (edge[k] and (same or is_title or num)):
            following = s.strip("\x0c ")
    return at, out[::-1]


SIZES = (3, 2, 3, 2, 2, 4)
N_SYMBOLS = int(np.prod(SIZES))
_STEPS = [int(np.prod(SIZES[i + 1 :])) for i in range(len(SIZES))]


def symbol(f: tuple[int, ...]) -> int:
    return sum(a * b for a, b in zip(f, _STEPS))


def initial() -> tuple[np.ndarray, np.ndarray]:
    """(transitions, emissions) before training, from a factor for each feature and state."""
    # Odds of each feature's values in the lines of each state; of an ending: none, a word, a compound, a sign that stands only within words.
    body = ((0.985, 0.014, 0.001), (0.998, 0.002), (0.997, 0.002, 0.001), (0.8, 0.2), (0.97, 0.03))
    factors = {
        "body": (*body, (0.95, 0.0005, 0.0494, 0.0001)),
        "header": ((0.10, 0.30, 0.60), (0.4, 0.6), (0.98, 0.01, 0.01), (0.01, 0.99), (0.5, 0.5), (0.97, 0.01, 0.01, 0.01)),
        "number": ((0.8, 0.1, 0.1), (0.99, 0.01), (0.001, 0.15, 0.849), (0.05, 0.95), (0.9, 0.1), (0.97, 0.01, 0.01, 0.01)),
        "break": (*body, (0.0001, 0.6, 0.0009, 0.399)),
    }
    emit = np.ones((len(STATES), N_SYMBOLS))
    for s, name in enumerate(STATES):
        for k in range(N_SYMBOLS):
            for j, v in enumerate(np.unravel_index(k, SIZES)):
                emit[s, k] *= factors[name][j][v]
    move = np.array([[0.82, 0.03, 0.04, 0.11], [0.75, 0.01, 0.14, 0.10], [0.49, 0.40, 0.05, 0.06], [0.82, 0.03, 0.04, 0.11]])
    return move, emit / emit.sum(1, keepdims=True)


def viterbi(symbols: list[int], move: np.ndarray, emit: np.ndarray) -> list[int]:
    """The most probable states of a sequence of symbols."""
    if not len(symbols):
        return []
    n = len(STATES)
    lm, rows = np.log(move), np.log(emit).T[np.asarray(symbols)]
    score = rows[0] + np.log([0.45, 0.4, 0.1, 0.05])
    back = np.zeros((len(symbols), n), dtype=np.int8)
    each = np.arange(n)
    for k in range(1, len(symbols)):
        step = score[:, None] + lm
        back[k] = b = step.argmax(0)
        score = step[b, each] + rows[k]
    path = [int(score.argmax())]
    for b in back[:0:-1]:
        path.append(int(b[path[-1]]))
    return path[::-1]


def train(observed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Transitions and emissions after a round of Viterbi counts over the symbols of all texts; n * (n + N_SYMBOLS) numbers come to the driver."""
    move, emit = initial()
    n = len(STATES)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, e = np.zeros((n, n)), np.zeros((n, N_SYMBOLS))
        for b in batches:
            for syms in b["symbols"]:
                path = viterbi(syms, move, emit)
                np.add.at(e, (path, np.asarray(syms, dtype=int)), 1)
                np.add.at(m, (path[:-1], path[1:]), 1)
        yield pd.DataFrame({"k": np.arange(n * n + n * N_SYMBOLS), "n": np.concatenate([m.ravel(), e.ravel()])})

    got = observed.select("symbols").mapInPandas(part, "k long, n double").groupBy("k").agg(F.sum("n").alias("n")).toPandas().sort_values("k")
    if not len(got):
        return move, emit
    c = got["n"].to_numpy()
    m, e = c[: n * n].reshape(n, n) + PRIOR * move, c[n * n :].reshape(n, N_SYMBOLS) + PRIOR * emit
    return m / m.sum(1, keepdims=True), e / e.sum(1, keepdims=True)


def word_key(word: str) -> int:
    """64-bit hash by which a word's frequency is looked up."""
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _words_of(text: str) -> set[str]:
    """Words, compounds and pairs of Chinese characters of a text, without the parts of words at line ends."""
    out: set[str] = set()
    lines = [s for s in text.split("\n") if s.strip()]
    broken = False
    for s in lines:
        s = s.strip(" \x0c\r\t")
        words = _TOKEN.findall(s)
        if broken and words:
            words = words[1:]
        broken = bool(s) and s[-1] in HYPHENS
        if broken and words:
            words = words[:-1]
        out.update(w.casefold() for w in words if not _HAN.match(w))
        out.update(w.casefold() for w in _COMPOUND.findall(s))
    flat = "".join(s.strip() for s in lines)
    for run in _HAN.findall(flat):
        out.update(map("".join, zip(run, run[1:])))
    return out


class Stored:
    """Document frequencies by key in sorted files. parts: (path, words, least key, greatest key) of each file, in order; bits: which beginnings of keys there are."""

    def __init__(self, parts: list[tuple[str, int, int, int]], bits: bytes):
        self.parts, self.bits = parts, bits
        self.least = [p[2] for p in parts]
        self.files: dict = {}

    def __reduce__(self):
        return Stored, (self.parts, self.bits)

    def get(self, k: int) -> int:
        """The frequency of a key, or 0. Keys are hashes, so where one lies follows from its value: one or two blocks are read."""
        at = (k + 2**63) >> (64 - FILTER_BITS)
        if not self.bits[at >> 3] >> (at & 7) & 1:
            return 0
        i = bisect_right(self.least, k) - 1
        if i < 0 or k > self.parts[i][3]:
            return 0
        path, hi, a, b = self.parts[i]
        lo = 0
        while lo < hi:
            guess = lo + (k - a) * (hi - lo) // (b - a + 1)
            start = max(lo, min(guess - BLOCK // 2, hi - BLOCK))
            stop = min(hi, start + BLOCK)
            block = np.frombuffer(self._file(path).read_at((stop - start) * _COUNT.itemsize, start * _COUNT.itemsize), _COUNT)
            first, last = int(block["k"][0]), int(block["k"][-1])
            if k < first:
                hi, b = start, first
            elif k > last:
                lo, a = stop, last
            else:
                j = int(np.searchsorted(block["k"], k))
                return int(block["n"][j]) if int(block["k"][j]) == k else 0
        return 0

    def _file(self, path: str):
        f = self.files.get(path)
        if f is None:
            if len(self.files) >= 100:
                self.files.clear()
            fs, name = FileSystem.from_uri(path)
            f = self.files[path] = fs.open_input_file(name)
        return f


def stored(words: DataFrame, size: int) -> Stored:
    """The counts (k, n) of `size` words in files of the shared folder; a row for each file and the bits of its keys come to the driver."""
    folder = scratch(words.sparkSession, "word-files")

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, name = FileSystem.from_uri(folder)
        fs.create_dir(name, recursive=True)
        file = uuid.uuid4().hex  # one for each attempt of a task
        bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        n, least, most = 0, 0, 0
        with fs.open_output_stream(f"{name}/{file}", buffer_size=1 << 20) as f:
            for b in batches:
                if len(b):
                    rows = np.empty(len(b), _COUNT)
                    rows["k"], rows["n"] = b["k"], b["n"]
                    f.write(rows.tobytes())
                    at = (rows["k"].astype(np.uint64) ^ np.uint64(2**63)) >> np.uint64(64 - FILTER_BITS)
                    np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.int64)).astype(np.uint8))
                    least, most, n = int(rows["k"][0]) if not n else least, int(rows["k"][-1]), n + len(b)
        if n:
            low, high = ((k + 2**63) >> (67 - FILTER_BITS) for k in (least, most))
            yield pd.DataFrame({"path": [f"{folder}/{file}"], "n": [n], "least": [least], "most": [most], "bits": [bits[low : high + 1].tobytes()]})

    files = words.select("k", "n").repartitionByRange(-(-size // FILE_WORDS), "k").sortWithinPartitions("k").mapInPandas(part, "path string, n long, least long, most long, bits binary").collect()
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in files:
        low = (r.least + 2**63) >> (67 - FILTER_BITS)
        bits[low : low + len(r.bits)] |= np.frombuffer(r.bits, np.uint8)
    return Stored(sorted(((r.path, r.n, r.least, r.most) for r in files), key=lambda p: p[2]), bits.tobytes())


def vocabulary(rows: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray] | Stored, DataFrame]:
    """Document frequencies of all words by key, in memory or stored, and (word, n) of each, over all distinct texts: copies do not vouch for their own errors."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for b in batches:
            for text in b["text"]:
                counts.update(_words_of(text))
                if len(counts) > 2_000_000:
                    yield _counted(counts)
                    counts = Counter()
        yield _counted(counts)

    got = materialise(rows.select("text").distinct().mapInPandas(part, "word string, k long, n long").groupBy("word", "k").agg(F.sum("n").alias("n")), "word-counts")
    words = got.select("word", "n")
    size = got.count()
    if size > WORDS_MAX:
        return stored(got, size), words
    table = got.select("k", "n").toPandas().sort_values("k")
    return (table["k"].to_numpy().astype(np.int64), table["n"].to_numpy().astype(np.int32)), words


def _counted(counts: Counter) -> pd.DataFrame:
    return pd.DataFrame({"word": list(counts), "k": np.fromiter(map(word_key, counts), np.int64, len(counts)), "n": np.fromiter(counts.values(), np.int64, len(counts))})


#: A word is common from this number of texts on, and its misread form must be so many times rarer.
COMMON, RARER = 6, 6
#: A confusion must be seen in so many different words, and these must hold this share of what all words hold that would show it if it came about evenly.
LEAST_WORDS, EVEN = 8, 0.5


def confusions(words: DataFrame) -> list[tuple[str, str]]:
    """(seen, printed) of the confusions of one or two letters, by the counts of the corpus' words: those that it shows, and those of the stated ones that it is too small to refute.

    A noisy channel: rare words are paired with common ones that differ in one place. What printers and scanners
    confuse comes about at one rate wherever the letters stand, so the common words that have a misread form hold as
    much of the printed letters as that rate lets expect; what grammar exchanges (endings, plurals) sits in few words.
    Words weigh by their frequency: in a large corpus most words are rare names and misread forms, which would all be
    expected to have misread forms too; their number grows with the corpus, their share of its letters does not.
    Pairs meet by what is left of both words without the place, so a key has no more words than the alphabet has pairs;
    what comes to the driver is bounded by the alphabet too."""
    w = words.where(F.length("word").between(4, 30) & ~F.col("word").rlike("[\u2e80-\uffff]"))
    at = w.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i")).select("word", "n", "i", F.explode(F.array(F.lit(1), F.lit(2))).alias("g")).where(F.col("i") + F.col("g") - 1 <= F.length("word"))
    at = at.select("word", "n", F.substring("word", F.col("i"), F.col("g")).alias("seg"), F.xxhash64(F.substring("word", F.lit(1), F.col("i") - 1), F.substring("word", F.col("i") + F.col("g"), F.length("word"))).alias("key"))
    common = at.where(F.col("n") >= COMMON)
    seen = at.select("key", F.col("seg").alias("seen"), F.col("n").alias("rare"))
    met = common.join(seen, "key").where((F.col("seen") != F.col("seg")) & (F.length("seen") + F.length("seg") < 4) & (F.col("n") >= RARER * F.col("rare")))
    stated = [(a, c.casefold()) for a, b in _STATED for c in b]
    pairs = met.groupBy("seen", F.col("seg").alias("printed")).agg(F.sum("rare").alias("n"), F.sum("n").alias("m"), F.count_distinct("word").alias("words"))
    found = pairs.where((F.col("words") >= LEAST_WORDS) | F.concat("seen", F.lit(" "), "printed").isin([" ".join(x) for x in stated])).toPandas()
    if not len(found):
        return stated
    sizes = common.groupBy("seg", F.floor(F.log2("n")).alias("size")).agg(F.count("*").alias("count"), F.sum("n").alias("m"))
    sizes = sizes.where(F.col("seg").isin(sorted({*found.printed, *(b for _, b in stated)}))).toPandas()

    def expected(printed: str, rate: float, of: str) -> float:
        own = sizes[sizes.seg == printed]
        return float((own[of] * -np.expm1(-rate * own.m / own["count"])).sum())

    out, rates = [], {}
    for r in found.sort_values(["seen", "printed"]).itertuples():
        rate = rates[r.seen, r.printed] = float(r.n / sizes[sizes.seg == r.printed].m.sum())
        if r.words >= LEAST_WORDS and r.m >= EVEN * expected(r.printed, rate, "m") and any(c.isalpha() for c in r.printed):
            out.append((rate, int(r.n), (r.seen, r.printed)))
    if not out:
        return stated
    # the usual rate is that of the median misread word: of confusions, those of misread forms again would be most
    shown = np.cumsum([n for _, n, _ in sorted(out)])
    usual = sorted(out)[int(np.searchsorted(shown, shown[-1] / 2))][0]
    known = [x for rate, _, x in out if rate * 10 >= usual or x in stated]
    # a stated one that the corpus would show at the usual rate, and does not, in whatever words, is none here
    return known + [x for x in stated if x not in known and (rates.get(x, 0) * 10 >= usual or expected(x[1], usual, "count") < 2 * LEAST_WORDS)]


STATE_KINDS = {1: "header", 2: "page_number"}
_NEAR_NUMBER, _TO_NUMBER, _ODD = re.compile(r"\d*[lOI]\d+|\d+[lOI]\d*|\d+[lOI]+\d*"), str.maketrans("lOI", "101"), re.compile("[0-9@$]").search


class Reader:
    """Labels the lines of one text after another."""

    def __init__(self, move: np.ndarray, emit: np.ndarray, words: tuple[np.ndarray, np.ndarray] | Stored, pairs: list[tuple[str, str]] | None = None):
        self.move, self.emit = move, emit
        by_seen: dict[str, list[str]] = {}
        for seen, printed in [(a, c) for a, b in _STATED for c in b] if pairs is None else pairs:
            by_seen.setdefault(seen, []).append(printed)
        self.with_cyrillic = list(by_seen.items())
        self.without = [(a, [c for c in b if not "\u0400" <= c[0] < "\u0500"]) for a, b in self.with_cyrillic]
        self.stored = words if isinstance(words, Stored) else None
        self.keys, self.counts = (None, None) if self.stored else words
        self.cache: dict[str, int] = {}
        self.known: dict[str, tuple] = {}
        #: Words that no text has another reading of, whatever their own text says.
        self.plain: set[str] = set()

    def df(self, word: str) -> int:
        word = word.casefold()
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) > 300_000:
                self.cache.clear()
            k = word_key(word)
            if self.stored:
                got = self.stored.get(k)
            else:
                i = int(np.searchsorted(self.keys, k))
                got = int(self.counts[i]) if i < len(self.keys) and int(self.keys[i]) == k else 0
            self.cache[word] = got
        return got

    def ending(self, s: str, following: str | None) -> int:
        """What a line's end makes with the next line: 0 nothing, 1 a word, 2 a compound (or a new sentence), 3 the sign stands only within words."""
        if len(s) < 2 or s[-1] not in HYPHENS or not s[-2].isalnum() or following is None:
            return 0
        m, n = _LAST.search(s), _FIRST.match(following)
        if not m or not n:
            return 0
        if s[-1] != "-":
            return 3
        last, b = m.group(1).split("-")[-1], n.group().rstrip(HYPHENS)
        first = b.split("-")[0]
        compound, word = self.df(f"{last}-{first}"), self.df(last + first)
        if not word:
            word = max([self.df(v) for v in self._readings(last + first)] or [0])
        return 1 if word >= compound and not b[:1].isupper() else 2

    def _readings(self, w: str) -> Iterator[str]:
        """What a word may have been before one misreading (or the same one several times)."""
        for seen, printed in self.with_cyrillic if _HAS_CYRILLIC(w) else self.without:
            i = w.find(seen)
            while i >= 0:
                for p in printed:
                    yield w[:i] + p + w[i + len(seen) :]
                i = w.find(seen, i + 1)

    def readings(self, w: str) -> tuple[tuple[str, int], ...]:
        """The readings of a word that some text has, with their frequencies; remembered."""
        got = self.known.get(w)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[w] = tuple((v, n) for v in self._readings(w) if (n := self.df(v)))
        return got

    def misread(self, w: str, own: Counter) -> str | None:
        """The word that w was misread from, or None."""
        if w in self.plain:
            return None
        if len(w) < 2:
            return {"@": "a"}.get(w)
        if w.isdigit():
            return None
        if w[0] in "0123456789lOI" and _NEAR_NUMBER.fullmatch(w):
            return w.translate(_TO_NUMBER)
        odd = _ODD(w) is not None
        if not odd and not self.readings(w):
            if len(self.plain) > 300_000:
                self.plain.clear()
            self.plain.add(w)
            return None
        n = self.df(w)
        again = own[w.casefold()]
        best, who = 0, None
        for v, d in self.readings(w):
            mine = own[v.casefold()]
            d += 3 * mine if mine > again else 0
            if d > best:
                best, who = d, v
        if odd and best < 2:
            for v in self._readings(w):
                for u in self._readings(v):
                    d = self.df(u) + 3 * (own[u.casefold()] if own[u.casefold()] > again else 0)
                    if d > best:
                        best, who = d, u
        if who is not None and best >= max(3 if odd else 4, 6 * max(n, again)):
            return who
        return None

    def misread_han_all(self, flat: str, i: int) -> str | None:
        """The likeliest of the characters that flat[i] may have been misread from."""
        got = [(min(self.df(flat[i - 1] + c), self.df(c + flat[i + 1])), c) for c in HAN_CONFUSED.get(flat[i], "") if 0 < i < len(flat) - 1 and self.misread_han(flat, i, c)]
        return max(got)[1] if got else None

    def misread_han(self, flat: str, i: int, to: str) -> bool:
        """Whether flat[i] was misread from the character `to`; both neighbours must speak for it."""
        a, b = flat[i - 1], flat[i + 1]
        now, then = (self.df(a + flat[i]), self.df(flat[i] + b)), (self.df(a + to), self.df(to + b))
        return min(then) >= 2 and min(then) >= 4 * min(now) and max(then) >= 2 * max(now)

    def label(self, text: str | None, title: str | None, seen: tuple | None = None) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
        """(cases, body): (line number from 0, kind) of the cases, and (line number, repaired line) of body lines; a line that ends within a word keeps a soft hyphen at its end."""
        if not text or not text.strip():
            return [], []
        if seen is None:
            at, features = observe(text, title, self)
            seen = at, [symbol(f) for f in features]
        at = [int(i) for i in seen[0]]
        path = viterbi(seen[1], self.move, self.emit)
        lines = text.split("\n")
        cases = [(i, STATE_KINDS[s]) for i, s in zip(at, path) if s in STATE_KINDS]
        body = [i for i, s in zip(at, path) if STATES[s] in ("body", "break")]
        broken = {i for i, s in zip(at, path) if STATES[s] == "break"}
        own: Counter = Counter()
        for i in body:
            own.update(w.casefold() for w in _TOKEN.findall(lines[i]))
        out = []
        flat = "".join(lines[i].strip(" \x0c\r　") for i in body)
        pos, plain = 0, self.plain
        for k, i in enumerate(body):
            s = lines[i].strip("\x0c").rstrip()
            bare = lines[i].strip(" \x0c\r　")
            nxt = lines[body[k + 1]].strip("\x0c ") if k + 1 < len(body) else ""
            prev = lines[body[k - 1]].rstrip("\x0c ") if k else ""
            fixes: list[tuple[str, str]] = []
            tokens = _TOKEN.findall(s)
            ends_broken = i in broken
            joined = None
            if ends_broken:
                m, n = _LAST.search(s), _FIRST.match(nxt)
                if m and n:
                    last = m.group(1).split("-")[-1]
                    joined = last + n.group().rstrip(HYPHENS).split("-")[0]
            begins_broken = bool(prev) and len(prev) > 1 and prev[-1] in HYPHENS and prev[-2].isalnum()
            for j, w in enumerate(tokens):
                if w in plain or _HAN.match(w) or (j == 0 and begins_broken) or (j == len(tokens) - 1 and s[-1:] in HYPHENS):
                    continue
                v = self.misread(w, own)
                if v is not None:
                    fixes.append((w, v))
            part_misread = False
            if joined and ends_broken:
                v = self.misread(joined, own)
                if v is not None and len(v) == len(joined):
                    part_misread = v[: len(last)] != joined[: len(last)]
            if begins_broken and k:
                m = re.search(r"([^\s.,;:!?“”«»„(—–\-]+)[-\xad¬‐]\Z", prev)
                n = re.match(r"[^\s.,;:!?“”«»„‘…()\[\]—–，。\-]+", bare)
                if m and n:
                    v = self.misread(m.group(1) + n.group(), own)
                    c = len(m.group(1))
                    if v is not None and v[c:] != n.group() and v[:c] == m.group(1):
                        part_misread = True
            han = [(j, self.misread_han_all(flat, pos + j)) for j in range(len(bare)) if bare[j] in HAN_CONFUSED]
            han = [(j, c) for j, c in han if c]
            pos += len(bare)
            if ends_broken:
                cases.append((i, "hyphen"))
            if fixes or han or part_misread:
                cases.append((i, "misread"))
            fixed = s
            for w, v in fixes:
                fixed = re.sub(rf"(?<![^\W_]){re.escape(w)}(?![^\W_])", v.replace("\\", "\\\\"), fixed, count=1)
            if han and not fixes:
                lead = len(s) - len(s.lstrip(" 　"))
                chars = list(fixed)
                for j, c in han:
                    if lead + j < len(chars):
                        chars[lead + j] = c
                fixed = "".join(chars)
            if ends_broken:
                fixed = fixed[:-1] + "\xad"
            out.append((i, fixed))
        return cases, out


def paragraphs(text: str, body: list[tuple[int, str]]) -> str:
    """Body lines as paragraphs: an indent, a blank line amid a page or a short line that ends a sentence begins a new one."""
    out: list[str] = []
    lines = text.split("\n")
    width = max([len(s) for _, s in body] or [0])
    for k, (i, s) in enumerate(body):
        prev = body[k - 1] if k else None
        blank = prev is not None and i - prev[0] == 2 and not lines[i - 1].strip()
        ended = prev is None or bool(re.search(r"[.!?。！？…»”\"]\s*\Z", prev[1]))
        new = prev is None or (s[:1] in " \t　" and s.strip() != "") or (blank and ended) or (ended and prev is not None and len(prev[1]) < width * 0.8 and not blank and i - prev[0] == 1)
        s = s.strip()
        if new or not out:
            out.append(s)
        elif out[-1].endswith("\xad"):
            out[-1] = out[-1][:-1] + s
        elif out[-1].endswith("-") or (out[-1][-1:] >= "⺀" and s[:1] >= "⺀"):
            out[-1] += s
        else:
            out[-1] += " " + s
    return "\n\n".join(out)


def _rows(spark, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "pdf_texts").where("text is not null and book_id is not null").select("book_id", "title", "text")


def observed(rows: DataFrame, words) -> DataFrame:
    """The texts with the lines that are not blank and their symbols, written once for training and labelling."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(*initial(), *words.value)
        for b in batches:
            got = [observe(t, title, reader) for t, title in zip(b["text"], b["title"])]
            yield pd.DataFrame({"book_id": b["book_id"], "title": b["title"], "text": b["text"], "at": [g[0] for g in got], "symbols": [[symbol(f) for f in g[1]] for g in got]})

    return materialise(rows.select("book_id", "title", "text").mapInPandas(part, "book_id long, title string, text string, at array<int>, symbols array<int>"), "scan-lines")


def labelled(spark, sf_dir: str, make, schema: str) -> DataFrame:
    """make(book_id, text, cases, body) of every text, as rows of the schema."""
    rows = _rows(spark, sf_dir)
    table, counted = vocabulary(rows)
    words = spark.sparkContext.broadcast((table, confusions(counted)))
    seen = observed(rows, words)
    model = spark.sparkContext.broadcast(train(seen))
    names = [c.split()[0] for c in schema.split(", ")]

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(*model.value, *words.value)
        for b in batches:
            out = [x for book, title, text, at, syms in zip(b["book_id"], b["title"], b["text"], b["at"], b["symbols"]) for x in make(book, text, *reader.label(text, title, (at, syms)))]
            yield pd.DataFrame(out, columns=names)

    return seen.mapInPandas(part, schema)


def p4_found(spark, sf_dir):
    """(book_id, line_no, kind) of headers, page numbers, breaks within words and misread lines."""
    return labelled(spark, sf_dir, lambda book, text, cases, body: [(book, i + 1, kind) for i, kind in cases], "book_id long, line_no long, kind string").distinct()


def p4_paragraphs(spark, sf_dir):
    """(book_id, text): continuous paragraphs."""
    return labelled(spark, sf_dir, lambda book, text, cases, body: [(book, paragraphs(text, body))], "book_id long, text string")


QUERIES = {"p4_found": p4_found, "p4_paragraphs": p4_paragraphs}
SQL: dict[str, str] = {}
