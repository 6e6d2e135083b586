"""Problem 7: encoding of the whole corpus with a public byte-level BPE tokenizer.

Method: dynamic programming over prefixes. For every prefix of a pre-token the one last token of its encoding is
stored: of the vocabulary's matches that end there (found by an automaton over the vocabulary), it is the one
that is the whole prefix or is compatible with the last token of what is before it. Two tokens are compatible if no
merge joins parts of both before their own merges are done. Following the stored tokens backwards gives the exact ids
in time linear in the length, however long a text without spaces is. Pre-tokens that came before are looked up.

Defined results: null and empty texts have an empty list of ids; blank texts are encoded as they are; strings that
look like special tokens are ordinary text; repeated rows give repeated results; lone surrogates, which no Parquet
string holds, do not occur.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from codexmill.session import texts


#: Folder of the public vocabularies; a parameter of every function here.
TOKENIZERS = os.environ.get("CODEXMILL_TOKENIZERS", "/opt/tokenizers")
# Fixed value: how the byte-level tokenizers split a text into pre-tokens.
PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of the look-up tables of pre-tokens and of token pairs; beyond it they start anew (results do not change).
CACHE = 300_000


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixEncoder:
    """Encoder of pre-tokens by the last token of every prefix."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
        import ahocorasick
        import regex

        with open(f"{folder}/{name}.json", encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        ids = {bytes(letters[c] for c in t).decode("latin-1"): i for t, i in model["vocab"].items() if all(c in letters for c in t) and not t.startswith("<|")}
        self.vocab = ids
        self.size = max(ids.values()) + 1
        self.length = [0] * self.size
        automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            self.length[i] = len(t)
            automaton.add_word(t, i)
        automaton.make_automaton()
        self.matches = automaton.iter
        never = len(model["merges"]) + 1
        self.merge: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            a, b = (bytes(letters[c] for c in x).decode("latin-1") for x in (a, b))
            self.merge[ids[a], ids[b]] = rank
            self.parts.setdefault(ids[a + b], (ids[a], ids[b], rank))
        # The tokens at each token's right and left edge, each with the rank at which its own token takes it in.
        self.right = [self._edge(i, 1, never) for i in range(self.size)]
        self.left = [self._edge(i, 0, never) for i in range(self.size)]
        self.words: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.split = regex.compile(PATTERN).findall
        #: Tokens that an encoding of their own bytes gives back; the others are never the whole of a prefix.
        self.whole = [True] * self.size

    def _edge(self, token: int, side: int, never: int) -> list[tuple[int, int]]:
        out, until = [(token, never)], never
        while token in self.parts:
            until = self.parts[token][2]
            token = self.parts[token][side]
            out.append((token, until))
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay two tokens when they meet: no merge over the border comes first."""
        merge = self.merge
        for x, x_until in self.right[a]:
            for y, y_until in self.left[b]:
                r = merge.get((x, y))
                if r is not None and r < x_until and r <= y_until:
                    return False
        return True

    def prefixes(self, data: str) -> tuple[int, ...]:
        """Ids of one pre-token, given as bytes in latin-1."""
        last = [-1] * (len(data) + 1)
        length, pairs = self.length, self.pairs
        for e, t in self.matches(data):
            if last[e + 1] >= 0:
                continue
            s = e + 1 - length[t]
            if s == 0:
                last[e + 1] = t
                continue
            p = last[s]
            if p < 0:
                continue
            k = p << 17 | t
            ok = pairs.get(k)
            if ok is None:
                if len(pairs) > 4 * CACHE:
                    pairs.clear()
                ok = pairs[k] = self.compatible(p, t)
            if ok:
                last[e + 1] = t
        out, e = [], len(data)
        while e:
            out.append(last[e])
            e -= length[last[e]]
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        out: list[int] = []
        words, vocab = self.words, self.vocab
        for w in self.split(text):
            got = words.get(w)
            if got is None:
                data = w.encode("utf-8").decode("latin-1")
                one = vocab.get(data)
                got = (one,) if one is not None else self.prefixes(data)
                if len(w) <= 64:
                    if len(words) > CACHE:
                        words.clear()
                    words[w] = got
            out += got
        return out


def encode_column(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, ids: bool = True) -> DataFrame:
    """(key, ids) of every row, or (key, n_tokens) with ids=False."""
    kind = df.schema[key].dataType.simpleString()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = PrefixEncoder(name, folder)
        for b in batches:
            step = max(1, min(1000, b.num_rows))
            for at in range(0, b.num_rows, step):
                c = b.slice(at, step)
                lists = [enc.encode(t) if t else [] for t in c.column(1).to_pylist()]
                sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
                if not ids:
                    yield pa.RecordBatch.from_arrays([c.column(0), pa.array(sizes)], ["k", "n_tokens"])
                    continue
                flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(sizes.sum()))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([c.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["k", "ids"])

    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(part, f"k {kind}, " + ("ids array<int>" if ids else "n_tokens long"))
    return out.withColumnRenamed("k", key)


def p7_ids(spark, sf_dir):
    """doc_id and ids of every document by byte_bpe_50k."""
    return encode_column(texts(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p7_ids": p7_ids}
SQL: dict[str, str] = {}
