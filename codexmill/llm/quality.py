"""Problem 9: per-document statistics of text quality, and what they tell: natural prose, or lists, tables and junk.

Method: copies of a text collapse first; statistics of every line of the distinct texts are taken in one pass; lines
that the site repeats (the operator of problem 6 over documents) are left out and the rest is summed for each source
and text. An ordered rule list, induced by incremental reduced-error pruning (llm/rules.py) on documents that are
labelled by how they were made (llm/labelled.py), is exported to an SQL CASE expression and applied natively.

Defined results: null, empty and blank texts have zero statistics and no kind and are never found; of a text of nothing
but the site's lines that holds for its own statistics; a document without source keeps all its lines; repeated rows
give one row, a doc_id with several texts one for each of them, and it is found if one of them is.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexmill.session import texts
from codexmill.llm.common import table
from codexmill.llm import labelled, rules
from codexmill.llm.rules import case_expression
from codexmill.llm.sitelines import _NUMBER, _TOKEN, BLANK, HEADING, cases_of, count_records, first_copies, fold, keys_for, name_words, with_names
from codexmill.operators.skew import hot_join
from codexmill.session import materialise

# Characters and forms that the statistics look for.
_HAN = re.compile(r"[㐀-鿿]")
_BULLET = re.compile(r"(?:[-*+•·▪◦‣○●□■※☆★]|[(（\[]?(?:\d{1,4}|[ivxIVX]{1,5}|[a-zA-Z]|[一二三四五六七八九十]{1,3})[.)）\]、．])\s*\S")
_LINK = re.compile(r"(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,8}/\S*|\S+@\S+\.\w+")
_CELL = re.compile(r"\S(?: {3,}|\t)\S|\|")
_LEADER = re.compile(r"\.{4,}|…{3,}|·{4,}|-{4,}|_{4,}")
_END = re.compile(r"[.!?。！？…．][\s\"'”’»)）」』*_\]]*\Z")
_INNER_END = re.compile(r"[.!?。！？…．](?=[\s\"'”’»)）」』*_\]])")
_CODE = re.compile(r"\b(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{2,}\b|\b\d[\d.,:/-]*\b")
_KEYED = re.compile(r"[^:：]{1,60}[:：] ?\S[^.!?。！？]{0,60}\Z")
_VOWEL = re.compile(r"[aeiouyäöüàáâèéêëíîïóôœùúûæøåõãìòаеёиоуыэюя]", re.I)

#: Statistics of a line, in the order of the columns; all are numbers of characters, words or lines.
LINE = ("chars", "letters", "digits", "symbols", "words", "word_chars", "common", "han", "han_common", "end_chars", "end_lines", "list_chars", "table_chars", "link_chars", "code_chars", "keyed_chars", "dull_chars", "novowel", "head_chars", "head_lines")


class _Class(dict):
    """A number for each token, remembered."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, w: str) -> int:
        if len(self) > 400_000:
            self.clear()
        got = self[w] = int(self.of(w))
        return got


#: Bits of each number in a token's packed numbers (letters, digits, is a word, is common, has no vowel), which are added up in one go.
_FIELD = 32
_MASK = (1 << _FIELD) - 1


class LineStats:
    """Statistics of lines against a bounded list of common words (the fixed table common_words)."""

    def __init__(self, common: list[str]):
        latin = {w.casefold() for w in common if not _HAN.search(w)}
        han = sorted((w for w in common if _HAN.search(w)), key=len, reverse=True)
        self.han = re.compile("|".join(map(re.escape, han)) or r"(?!)")

        def numbers(w: str) -> int:
            word = w.isalpha()
            fields = sum(map(str.isalpha, w)), sum(map(str.isdigit, w)), word, w in latin, word and len(w) > 3 and not _VOWEL.search(w)
            return sum(int(x) << _FIELD * k for k, x in enumerate(fields))

        self.numbers = _Class(numbers).__getitem__

    def of(self, line: str, tokens: list[str]) -> tuple[int, ...]:
        """Of a line and the tokens of its folded form."""
        s = line.strip()
        n = len(s)
        packed = sum(map(self.numbers, tokens))
        letters, digits, words, common, novowel = packed & _MASK, packed >> _FIELD & _MASK, packed >> 2 * _FIELD & _MASK, packed >> 3 * _FIELD & _MASK, packed >> 4 * _FIELD
        spaces = s.count(" ") + s.count("\t") + s.count("\u3000") + s.count("\xa0")
        plain = sum(map(s.count, ".,;:!?'\"-")) + (0 if s.isascii() else sum(map(s.count, "，。！？、；：“”‘’«»—…（）")))
        symbols = max(n - letters - digits - spaces - plain, 0)
        chars: list[str] = [] if s.isascii() else _HAN.findall(s)
        han = len(chars)
        han_common = len(self.han.findall(s)) if han else 0
        listed = n if _BULLET.match(s) or (("..." in s or "…" in s or "·" in s or "--" in s or "__" in s) and _LEADER.search(s)) else 0
        end = n if _END.search(s, max(0, n - 16)) else 0
        if not end and not listed:  # something may follow the last sentence
            inner = [m.end() for m in _INNER_END.finditer(s, max(0, n - 60))]
            end = inner[-1] if inner else 0
        dull = 0
        if han > 11:
            dull = n if len(set(zip(chars, chars[1:]))) * 3 < han else 0
        elif words > 7:
            dull = n if len(set(tokens)) * 3 < len(tokens) else 0
        novowel = 0 if common or han else novowel
        cells = n if ("|" in s or "\t" in s or "   " in s) and _CELL.search(s) else 0
        link = sum(map(len, _LINK.findall(s))) if ("." in s and "/" in s) or "@" in s else 0
        code = sum(map(len, _CODE.findall(s))) if digits * 10 > n else 0
        keyed = n if not end and n < 125 and (":" in s or "：" in s) and _KEYED.match(s) else 0
        if letters * 10 < n * 3:
            end = 0  # signs and numbers are no sentence
        head = n if n < 120 and not end and not listed and HEADING.match(_NUMBER.sub("#", fold(s))) else 0
        return n, letters, digits, symbols, words, letters, common, han, han_common, end, 1 if end else 0, listed, cells, link, code, keyed, dull, novowel, head, 1 if head else 0


def _key(site: str, key: str) -> int:
    """64-bit hash of a site's line."""
    return int.from_bytes(hashlib.blake2b(f"{site}\0{key}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def line_table(distinct: DataFrame, names: DataFrame, common: list[str]) -> DataFrame:
    """One row for each distinct text (h, site, text): keys of its non-blank lines as a site's lines (null where one cannot be), and their hashes and statistics, one line after another."""
    rows, array = with_names(distinct, names)
    shared = distinct.sparkSession.sparkContext.broadcast(array)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, stats = keys_for(shared), LineStats(common)
        for b in batches:
            keys, flat, ends = [], [], [0]
            for site, t, mine in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                key_of = of(mine).key_of
                for line in t.split("\n"):
                    if not line or line.isspace():
                        continue
                    parts = _TOKEN.split(fold(line))
                    k = None if site == NO_SITE else key_of(parts)
                    keys.append(None if k is None else _key(site, k))
                    flat.append(zlib.crc32(line.strip().encode("utf-8", "surrogatepass")) & 0x7FFFFFFF)
                    flat += stats.of(line, parts[1::2])
                ends.append(len(keys))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(keys, pa.int64())), pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32) * WIDTH), pa.array(flat, pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["h", "site", "keys", "flat"])

    return rows.select("h", "site", "text", "names").mapInArrow(part, "h binary, site string, keys array<bigint>, flat array<int>")


#: Numbers of a line in `flat`: its hash and its statistics.
WIDTH = 1 + len(LINE)
NO_SITE = "-"
#: Keys of sites' lines that are broadcast at most (8 bytes each); with more, every text gets its own by a join.
CASES_MAX = 4_000_000


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, a / np.maximum(b, 1), 0.0)


def features(flat: np.ndarray, doc: np.ndarray, keep: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Statistics and shares of n texts, from the numbers of their lines (rows of flat), the text of each line, and whether it is the text's own."""
    whole = {c: np.bincount(doc, flat[:, k + 1], n) for k, c in enumerate(LINE)}
    lines = np.bincount(doc, minlength=n)
    han = whole["han"] * 3 > whole["letters"]
    common = np.where(han, _share(whole["han_common"], whole["han"]), _share(whole["common"], whole["words"]))
    out = {"words": whole["words"], "mean_word": _share(whole["word_chars"], whole["words"]), "symbol_ratio": _share(whole["symbols"], whole["chars"]), "end_line_share": _share(whole["end_lines"], lines), "common_share": common}
    out = {f"whole_{c}": x for c, x in out.items()}
    flat, doc = flat[keep], doc[keep]
    s = {c: np.bincount(doc, flat[:, k + 1], n) for k, c in enumerate(LINE)}
    lines = np.bincount(doc, minlength=n)
    pairs = np.unique(doc.astype(np.int64) << 31 | flat[:, 0].astype(np.int64))
    distinct = np.bincount(pairs >> 31, minlength=n)
    first = np.zeros((n, len(LINE)))
    at, where = np.unique(doc, return_index=True)
    first[at] = flat[where, 1:]
    first = dict(zip(LINE, first.T))
    # an introduction of one sentence before something else is left out
    intro = (lines > 2) & (first["end_chars"] > 0) & (first["chars"] < 250) & (s["end_lines"] <= lines / 2)
    s = {c: x - np.where(intro, first[c], 0) for c, x in s.items()}
    lines = lines - intro
    one = (s["end_lines"] == 1) & (lines > 3) & (s["end_chars"] < 250)  # a single sentence in a list
    s["chars"] = s["chars"] - np.where(one, s["end_chars"], 0)
    s["end_chars"], s["end_lines"] = np.where(one, 0, s["end_chars"]), np.where(one, 0, s["end_lines"])
    few = s["head_lines"] <= 2  # a heading or two say nothing; a list of them does
    s["chars"], lines = s["chars"] - np.where(few, s["head_chars"], 0), lines - np.where(few, s["head_lines"], 0)
    han = s["han"] * 3 > s["letters"]
    return out | s | {
        "lines": lines,
        "mean_word": _share(s["word_chars"], s["words"]), "symbol_ratio": _share(s["symbols"], s["chars"]), "digit_ratio": _share(s["digits"], s["chars"]), "letter_ratio": _share(s["letters"], s["chars"]),
        "end_share": _share(s["end_chars"], s["chars"]), "end_line_share": _share(s["end_lines"], lines), "list_share": _share(s["list_chars"], s["chars"]), "table_share": _share(s["table_chars"], s["chars"]),
        "link_share": _share(s["link_chars"], s["chars"]), "code_share": _share(s["code_chars"], s["chars"]), "keyed_share": _share(s["keyed_chars"], s["chars"]), "dull_share": _share(s["dull_chars"], s["chars"]),
        "novowel_share": _share(s["novowel"], s["words"]), "distinct_share": _share(distinct, lines), "common_share": np.where(han, _share(s["han_common"], s["han"]), _share(s["common"], s["words"])),
    }


#: Columns of the features.
OWN = ("chars", "words", "lines", "mean_word", "symbol_ratio", "digit_ratio", "letter_ratio", "end_share", "end_line_share", "list_share", "table_share", "link_share", "code_share", "keyed_share", "dull_share", "novowel_share", "distinct_share", "common_share")
SHOWN = ("mean_word", "symbol_ratio", "end_line_share", "common_share")
COLUMNS = (*OWN, "whole_words", *(f"whole_{c}" for c in SHOWN))


class Stats:
    """Statistics of documents (doc_id, source, text): `rec` has (site, record, h) of every document with a text that is not blank, `own` the features of each h.

    h stands for the source and the text, so copies within a source collapse and a site's lines are told without a join."""

    def __init__(self, docs: DataFrame, names: DataFrame, common: list[str], most_cases: int | None = None):
        site = F.coalesce(F.concat(F.lit("d:"), "source"), F.lit(NO_SITE))
        rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike(BLANK)).select("doc_id", site.alias("site"), "text")
        rows = rows.withColumn("h", F.unhex(F.md5(F.encode(F.concat_ws("\0", "site", "text"), "UTF-8"))))
        self.rec = materialise(rows.select("site", F.col("doc_id").alias("record"), "h"), "stat-records")
        first = first_copies(rows, ["doc_id"], self.rec.select(F.col("record").alias("doc_id"), "h"))
        table_ = materialise(line_table(first, names, common), "line-stats")
        lines = table_.where(F.col("site") != NO_SITE).select("h", F.explode(F.array_distinct("keys")).alias("key")).where("key is not null")
        cases = materialise(cases_of(*count_records(lines, self.rec.where(F.col("site") != NO_SITE))).select("key"), "stat-cases")
        if cases.count() <= (CASES_MAX if most_cases is None else most_cases):
            shared = docs.sparkSession.sparkContext.broadcast(np.unique(cases.toPandas()["key"].to_numpy().astype(np.int64)))
            table_ = table_.withColumn("gone", F.lit(None).cast("array<bigint>"))
        else:
            shared = docs.sparkSession.sparkContext.broadcast(None)
            gone = lines.join(cases.distinct(), "key").groupBy("h").agg(F.collect_set("key").alias("gone"))
            table_ = table_.join(gone, "h", "left")

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = b.column(1)
                sizes = np.diff(keys.offsets.to_numpy())
                doc = np.repeat(np.arange(b.num_rows), sizes)
                flat = b.column(2).flatten().to_numpy().reshape(-1, WIDTH)
                k = keys.flatten()
                known, k = ~k.is_null().to_numpy(zero_copy_only=False), k.fill_null(0).to_numpy()
                if shared.value is not None:
                    hit = np.isin(k, shared.value)
                else:
                    own = b.column(3).to_pylist()
                    hit = np.array([own[d] is not None and x in own[d] for d, x in zip(doc.tolist(), k.tolist())], dtype=bool)
                f = features(flat, doc, ~(hit & known), b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(f[c], pa.float64()) for c in COLUMNS]], ["h", *COLUMNS])

        got = table_.select("h", "keys", "flat", "gone").mapInArrow(part, "h binary, " + ", ".join(f"{c} double" for c in COLUMNS))
        self.own = got.dropDuplicates(["h"])


def stats(spark, sf_dir: str) -> Stats:
    """Of the table documents."""
    docs = texts(spark, sf_dir, "documents").select("doc_id", "source", "text")
    names = name_words(table(spark, sf_dir, "documents").select("author"), table(spark, sf_dir, "books").select("author"))
    return Stats(docs, names, common_words(spark, sf_dir))


def common_words(spark, sf_dir: str) -> list[str]:
    """The fixed table of common words (125 rows)."""
    return sorted(r.word for r in table(spark, sf_dir, "common_words").select("word").distinct().toLocalIterator() if r.word)


def fit(spark, sf_dir: str, sample: int = rules.SAMPLE, seed: int = 1) -> list:
    """The rule list induced on `sample` documents at most whose labels tell how they were made: how rules.RULES came about."""
    made = labelled.documents(labelled.passages(table(spark, sf_dir, "epub_books")), sample, seed)
    docs = spark.createDataFrame([(i, None, t) for i, (t, _, _) in enumerate(made)], "doc_id long, source string, text string")
    none = spark.createDataFrame([], "name long")
    s = Stats(docs, none, common_words(spark, sf_dir))
    rows = s.own.join(s.rec.select("h", "record"), "h").where("chars > 0").toPandas().sort_values("record").reset_index(drop=True)
    rows["other"] = [made[i][1] for i in rows.record]
    rows["form"] = [made[i][2] for i in rows.record]
    return rules.induce(rows), rows


def classify(rows: DataFrame) -> DataFrame:
    """Statistics with `kind`: prose or other, by the exported rule list."""
    return rows.withColumn("kind", F.expr(case_expression()))


def p9_found(spark, sf_dir):
    """doc_id of documents that are a list, a table or junk."""
    s = stats(spark, sf_dir)
    other = classify(s.own).where("kind = 'other'").select("h")
    return hot_join(other, s.rec, ["h"], ["record"]).select(F.col("record").alias("doc_id")).distinct()


def p9_stats(spark, sf_dir):
    """Statistics of every document's whole text, the same of its own lines (own_...), and its kind by the latter."""
    s = stats(spark, sf_dir)
    told = hot_join(classify(s.own), s.rec.distinct(), ["h"], ["record"]).withColumnRenamed("record", "doc_id")
    every = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id").distinct()
    places = {"mean_word": 3}

    def shown(of: str, name: str):
        return [F.coalesce(F.col(f"{of}words"), F.lit(0)).cast("long").alias(f"{name}words"), *[F.round(F.coalesce(F.col(f"{of}{c}"), F.lit(0.0)), places.get(c, 4)).alias(f"{name}{c}") for c in SHOWN]]

    return every.join(told, "doc_id", "left").select("doc_id", *shown("whole_", ""), *shown("", "own_"), "kind")


QUERIES = {"p9_found": p9_found, "p9_stats": p9_stats}
SQL: dict[str, str] = {}
