"""The text operators: brute force, round trips, edge tables."""

import random
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from codexmill.llm import chunking, lookalike, markup, mixing, mojibake, quality, registry, rules, scans, sitelines, tokenize

SF = "/root/testdata/sf0.001"


def _pairs(texts):
    c = mojibake.Counts()
    for t in texts:
        c.add(t)
    c.fold()
    return mojibake.PairModel(c.keys, c.n.astype(np.float32), c.chars.astype(np.float32), c.docs)


@pytest.fixture(scope="module")
def model():
    """Pair statistics of the small books, without a cluster."""
    return _pairs(set(pd.read_parquet("/root/testdata/sf0.01/epub_books.parquet").flat_text.dropna()))


CASES = [
    ("“别动那钥匙，”他说，“它比城门还要古老。”没有人知道遥远的古井里藏着什么。", "utf-8", "latin"),
    ("“别动那钥匙，”他说，“它比城门还要古老。”没有人知道遥远的古井里藏着什么。", "gb18030", "latin"),
    ("La veille, elle découvrit le château abandonné près de la rivière.", "utf-8", "latin"),
    ("Der Müller hörte die grüne Tür und später auch den südlichen Turm.", "utf-8", "cp437"),
    ("“Who opened the silver window?” asked Lioor — but the tower gave no sign.", "utf-8", "mac_roman"),
]


@pytest.mark.parametrize("text, right, wrong", CASES)
def test_mojibake_round_trip(model, text, right, wrong):
    bad = mojibake.decode(text.encode(right), wrong)
    good = "The quiet river waited by the gate.\n\n"
    got, found, n = mojibake.repair(good + bad + "\n\n" + good, model)
    assert found and n and text in got


def test_mojibake_edges(model):
    for t in (None, "", " \n ", "plain ascii", "Read ÉTÉ ©1904 MAÇÃ ½.", "x" * 200_000):
        assert mojibake.repair(t, model)[:2] == (t, False)
    assert mojibake.repair("lost � here", model)[1]
    once = mojibake.decode("Müller hörte".encode("utf-8"), "latin")
    thrice = mojibake.decode(mojibake.decode(once.encode("utf-8"), "latin").encode("utf-8"), "latin")
    assert "Müller hörte" in mojibake.repair(f"Then {thrice} it.", model)[0]


@pytest.mark.parametrize("right, wrong, copies", [("utf-8", "latin", 1), ("utf-8", "latin", 130), ("gb18030", "latin", 130), ("utf-8", "gb18030", 130)])
def test_mojibake_hot_group(spark, right, wrong, copies):
    """Books that share a fault, and copies of one garbled book, do not make it probable."""
    e = pd.read_parquet("/root/testdata/sf0.01/epub_books.parquet").flat_text.dropna()
    own = "[\u4e00-\u9fff]" if right == "gb18030" or wrong == "gb18030" else "[éèê]"
    whole = [t for t in e if len(pd.Series([t]).str.findall(own)[0]) > 20 and mojibake.encode(t, right) and not any(c in t for c in "\ufffdÃâ€")]
    bad = [mojibake.decode(mojibake.encode(t, right), wrong) for t in whole[: len(whole) // 2]]
    bad = [t for t in bad if t and t not in whole]
    group = bad * 3 if copies == 1 else bad[:1] * copies
    rows = [(i, t) for i, t in enumerate([*whole[len(whole) // 2 :], *[t for t in e if t.isascii()], *group])]
    rows += [(len(rows) + i, "The quiet river waited by the gate.") for i in range(max(0, 2 * len(group) - len(rows)))]
    got = mojibake.detect(spark.createDataFrame(rows, "book_id long, flat_text string"), "book_id", "flat_text").where("garbled")
    assert {r.flat_text for r in got.join(spark.createDataFrame(rows, "book_id long, flat_text string"), "book_id").collect()} >= set(group)


def test_segments_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(300):
        s = rng.normal(size=rng.integers(1, 30))
        got = mojibake.segments(s)
        if (s > 0).any():
            best = max((s[i:j].sum(), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1))
            assert any(abs(s[i:j].sum() - best[0]) < 1e-9 for i, j in got)
        else:
            assert got == []
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))


def test_lookalike_against_unicode():
    maps = lookalike.mapping()
    plain = lookalike.mapping(False)
    rng = random.Random(2)
    letters = "aeéṇ̃́̈Åﬁ１Ｆ⼈한  ​­中"
    for _ in range(500):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 12)))
        t = "".join(c for c in s if not lookalike._invisible(ord(c)))
        t = "".join(" " if unicodedata.category(c) == "Zs" else c for c in t)
        assert lookalike.rebuild([s], plain) == [unicodedata.normalize("NFKC", t)]
    assert lookalike.rebuild(["Сhарtеr", "", "Chapter"], maps) == ["Chapter", "", "Chapter"]


def test_lookalike_pairs(spark):
    rows = [(1, "abc"), (2, "ａbc"), (3, "abc"), (4, None), (5, ""), (6, "ABC"), (2, "ａbc")]
    df = spark.createDataFrame(rows, "id long, t string").withColumn("book_id", F.lit("clash"))
    got = sorted(tuple(r) for r in lookalike.alike(lookalike.keys(df, "id", "t", "x")).collect())
    assert got == [("x", 1, 2), ("x", 2, 3)]
    assert lookalike.alike(lookalike.keys(df.where("false"), "id", "t", "x")).count() == 0


def test_tokenizer_against_library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(f"{tokenize.TOKENIZERS}/byte_bpe_50k.json")
    lib.encode_special_tokens = True
    enc = tokenize.PrefixEncoder()
    rng = random.Random(3)
    docs = pd.read_parquet(f"{SF}/documents.parquet").text.dropna().tolist()
    parts = ["a", "é", "的", "aaaa", " ", "  ", "\n", "1", "22", "<|endoftext|>", "'s", "ﬁ", "🌙", "ing", "\t", "zzzzzzzz"]
    docs += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    docs += ["", " ", "a" * 5000, "的" * 3000]
    for d in docs:
        assert enc.encode(d) == lib.encode(d, add_special_tokens=False).ids


def test_tokenizer_edges(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "  ", 0), (4, "<|endoftext|>", 0), (4, "<|endoftext|>", 0)], "doc_id long, text string, k int")
    got = sorted((r.doc_id, list(r.ids)) for r in tokenize.encode_column(df, "doc_id", "text").collect())
    assert got[0] == (1, []) and got[1] == (2, []) and got[2][1] and 50256 not in got[3][1] and got[3] == got[4]


def test_cuts_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        t = "".join(rng.choice(["word ", "sentence. ", "段落。", "\n\n", "x" * 30]) for _ in range(rng.randint(1, 60)))
        limit = rng.randint(5, 80)
        over = rng.randint(0, (limit - 1) // 2)
        a = chunking.code_points(t)
        got = chunking.cuts(a, limit, over).tolist()
        nxt, want, e = chunking.successors(a, limit, over), [], 0
        while e < len(a):
            e = int(nxt[e])
            want.append(e)
        assert got == want
        begin = 0
        for e in got:
            assert 0 < e - begin <= limit
            begin = e - over


def test_site_keys():
    names = np.array(sorted(sitelines.name_hash(w) for w in ("sabovar", "oake", "lunil", "dunmarch")))
    assert sitelines.LineKeys(names).key("By Oake") == sitelines.LineKeys(set(names.tolist())).key("By Oake") == "by @"
    k = sitelines.LineKeys(names).key
    assert k("By Sabovar Oake | Tales | 2023/05/15") == k("» BY  LUNIL DUNMARCH | TALES | 2020-01-02!!")
    assert k("Vote: 12 so far") == k("vote: 7 so far >>") != k("vote: 7 so near")
    assert k("Chapter 3: River") is None and k("第三章") is None and k(" ") is None and k("# 12 -") is None


def test_mixing(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 10 == 0], "word " * (20 + i % 7)) for i in range(300)] + [(900, None, "x"), (901, "a", None), (902, "a", "")], "doc_id long, source string, text string")
    mix = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 4), ("c", 0.0, 1), ("d", None, None)], "source string, target_weight double, max_repeats int")
    m, report = mixing.mix(docs, mix, block=64)
    r = {x.source: x for x in report.collect()}
    rows = m.collect()
    uses = {}
    for x in rows:
        uses[x.doc_id] = max(uses.get(x.doc_id, 0), x.repetition + 1)
    parts = {}
    for x in rows:
        parts.setdefault((x.doc_id, x.repetition), []).append((x.token_offset, x.n_tokens))
    for p in parts.values():  # parts of one use do not overlap
        p.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(p, p[1:]))
    assert max(n for d, n in uses.items() if d % 10) <= 3 and max(n for d, n in uses.items() if d % 10 == 0) <= 4
    assert r["c"].tokens == 0 and r["d"].tokens == 0
    assert abs(r["a"].actual_share + r["b"].actual_share - 1) < 1e-9
    assert r["b"].most_used == 4
    one, _ = mixing.mix(docs, mix.where("source in ('a', 'b')").withColumn("max_repeats", F.lit(50)), block=16)
    t = {x.source: x.t for x in one.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    assert abs(t["a"] / sum(t.values()) - 0.5) < 0.005
    per_slot = one.groupBy("slot").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()
    assert sorted(x.slot for x in per_slot) == list(range(len(per_slot))), "no slot is empty"
    assert sum(x.t != 16 for x in per_slot) <= 2 * 50 and all(x.t <= 16 for x in per_slot)
    targets = {x.source: x for x in mixing.mix(docs, mix, total="targets", block=16)[1].collect()}
    assert abs(targets["a"].actual_share - 0.5) < 0.01 and targets["b"].most_used <= 4
    assert mixing.mix(docs.where("false"), mix)[0].count() == 0


def test_markup():
    fam = lambda t: {n.family if n.family != "?" else "markdown" for n in markup.scan(t)}
    assert fam("<p>a</p>") == {"html"} and fam("a &lt;p&gt;b") == {"html"} and fam("AT&amp;T") == {"html"}
    assert fam("**bold** and\n\n- one\n- two") == {"markdown"} and fam("# Title\n\ntext") == {"markdown"}
    assert fam("== Title ==\n\n* one\n# two\n\n''x''") == {"wiki"} and fam("{|\n|-\n| a\n|}") == {"wiki"}
    assert fam("\\section{A} text \\textbf{b}") == {"latex"} and fam("$$x^2$$") == {"latex"}
    for t in ("", "3-2 = 1", "It cost $5 for the map and $6 for it.", "C:\\shelf\\new and tide_table_old", "• one\n• two", "x + y = 0", "1. one\n2. two", "a < b and c > d", "(see {note})"):
        assert fam(t) == set(), t
    assert "# Title" in markup.clean("<h1>Title</h1><p>A<br>b", markup.scan("<h1>Title</h1><p>A<br>b"))
    assert markup.clean("<pre><code>x &lt; 1\n  y</code></pre>", markup.scan("<pre><code>x &lt; 1\n  y</code></pre>")).strip("\n") == "    x < 1\n      y"
    assert "$$a^2$$" in markup.clean("text $$a^2$$ more", markup.scan("text $$a^2$$ more"))


def test_style_tree_drops_banners(spark):
    rows = [("s", i, 1, f"<div class='nav'>Home | Shop</div><p>own text {chr(97 + i)}{chr(98 + i)}</p>") for i in range(6)]
    df = spark.createDataFrame(rows, "src string, record_id long, site long, text string")
    low = [r for r in markup.style_tree(markup.branches(df)).collect() if r.importance < markup.IMPORTANCE]
    assert len(low) == 1 and low[0].records == 6 and bytes(low[0].place) == markup._place(b"", "div")


def _low(spark, texts):
    df = spark.createDataFrame([("s", i, 1, t) for i, t in enumerate(texts)], "src string, record_id long, site long, text string")
    names = {markup._place(b"", n): n for n in ("div", "p")}
    return [(names[bytes(r.place)], r.records) for r in markup.style_tree(markup.branches(df)).collect() if r.importance < markup.IMPORTANCE]


def test_style_tree_entropies(spark):
    word = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    # four banners in turn
    assert sorted(_low(spark, [f"<div>Shop of {'abcd'[i % 4]}</div><p>text {word(i)}</p>" for i in range(2000)])) == [("div", 500)] * 4
    # the same words on two fifths of the records, at a place that differs on the others
    assert not _low(spark, [f"<p>{'Once upon a time.' if i % 5 < 2 else word(i)}</p>" for i in range(1000)])
    # the place differs, but its last branch is a banner
    assert _low(spark, ["".join(f"<p>text {word(i * 9 + k)}</p>" for k in range(i % 5 + 1)) + "<p>Visit our shop</p>" for i in range(40)]) == [("p", 40)]
    # records without any markup belong to the site
    assert not _low(spark, [f"<div>Home</div><p>text {word(i)}</p>" for i in range(4)] + ["plain", None] * 4)


LONG_MARKS = [
    ("html", '<img src="data:image/png;base64,' + "A" * 9000 + '">'),
    ("html", "&lt;p " + "x" * 3000 + "&gt;"),
    ("latex", "$$" + "x + " * 20000 + "1$$"),
    ("latex", "\\begin{verbatim}" + "line\n" * 60000 + "\\end{verbatim}"),
    ("latex", "\\begin{equation}" + "x + " * 9000 + "\\end{equation}"),
    ("wiki", "{{Infobox | a = {{b | c}} | d = " + "e " * 2000 + "}}"),
    ("wiki", "[[" + "a" * 4000 + "|b]]"),
    ("markdown", "**" + "a" * 5000 + "**"),
    ("markdown", "[" + "a" * 2000 + "](http://x.org)"),
]


@pytest.mark.parametrize("family, text", LONG_MARKS)
def test_marks_of_any_length(family, text):
    nodes = markup.scan(f"before\n\n{text}\n\nafter")
    assert {n.family for n in nodes} == {family} and any(n.stop - n.start == len(text) for n in nodes)
    a, b = (markup.tree(t, markup.scan(t)) for t in (f'<div class="{"a" * 300}{c}">x</div>' for c in "bc"))
    assert a[0][2] != b[0][2], "presentations that differ behind 200 characters differ"


def test_linear_time():
    import time

    def seconds(n):
        began = time.perf_counter()
        for t in ("<div>a" * n, "<script>" * n, "$$ {{ <!-- &lt;p " * n, "\\emph{a {b} \n===\n" * n, "<pre>a</pre>\nx\n---\n" * n):
            k = markup.scan(t)
            markup.tree(t, k)
            markup.clean(t, k)
        return time.perf_counter() - began

    seconds(500)
    assert seconds(16000) < 12 * max(seconds(4000), 0.05)


def test_shared_markers_go_with_the_site(spark):
    """Only '#' lines: wiki where all the site's other records have wiki there, else Markdown."""
    wiki = "# one\n# two\n\n== Title ==\n\n[[link]]"
    rows = [("s", i, 1, wiki) for i in range(3)] + [("s", 9, 1, "# one\n# two"), ("s", 8, 2, "# one\n# two"), ("s", 7, None, "# one")]
    df = spark.createDataFrame(rows, "src string, record_id long, site long, text string")
    got = {(r.record_id, r.markup) for r in markup.settled(markup.branches(df)).collect()}
    assert {x for x in got if x[0] > 3} == {(9, "wiki"), (8, "markdown"), (7, "markdown")}


def test_scans():
    page = lambda n: f"THE TITLE OF BOOK\nA long {'abcdef'[n - 40] * 4} line of the body which ends within a com-\nmon word and goes {'uvwxyz'[n - 40] * 4} on.\n- {n} -\n\x0c\n"
    text = "".join(page(n) for n in range(40, 46))
    keys = np.array(sorted(scans.word_key(w) for w in ("common", "which", "body")))
    r = scans.Reader(*scans.initial(), (keys, np.full(3, 50)))
    cases, body = r.label(text.replace("which", "whicb", 1), "The Title of Book")
    kinds = {}
    for i, k in cases:
        kinds.setdefault(k, []).append(i)
    assert len(kinds["header"]) == 6 and len(kinds["page_number"]) == 6 and len(kinds["hyphen"]) == 6 and kinds["misread"] == [1]
    path = scans.viterbi([scans.symbol(f) for f in scans.observe(text, "The Title of Book", r)[1]], r.move, r.emit)
    assert path.count(scans.STATES.index("break")) == 6
    assert "common word" in scans.paragraphs(text, r.label(text, "The Title of Book")[1])
    for t in (None, "", "  \n "):
        assert r.label(t, None) == ([], [])


def test_copies_do_not_vouch_for_misreadings(spark):
    texts = [f"The line which {'abcdefghijklmnop'[i] * 5} goes on.\n" for i in range(12)] + ["The line whicb goes on.\n"] * 10
    words, _ = scans.vocabulary(spark.createDataFrame([(t,) for t in texts], "text string"))
    r = scans.Reader(*scans.initial(), words)
    assert r.df("whicb") == 1 and r.misread("whicb", Counter(whicb=1)) == "which"


def test_rare_words_of_many_texts_count(spark):
    """A word in 7 of 1,900,000 texts tells a misread one, as it does in a small corpus."""
    texts = spark.range(1_900_000).select(F.concat(F.lit("a"), F.expr("id % 1400"), F.lit(" b"), F.expr("id div 1400")).alias("text"))
    rare = spark.createDataFrame([(f"the lanthorn {i}",) for i in range(7)] + [("the lantborn",)], "text string")
    words, counted = scans.vocabulary(texts.union(rare))
    r = scans.Reader(*scans.initial(), words)
    assert r.df("lanthorn") == 7 and r.df("the") == 8 and r.misread("lantborn", Counter(lantborn=1)) == "lanthorn"
    assert {(w, n) for w, n in counted.where("word like 'lant%'").collect()} == {("lanthorn", 7), ("lantborn", 1)}


def test_words_too_many_to_broadcast(spark, monkeypatch):
    """Counts looked up in files are the counts, of unseen words too, and the found lines are the same."""
    want = {name: sorted(_rows(spark, name)) for name in ("p4_found", "p4_paragraphs")}
    texts = set(_table("pdf_texts", SF.replace("0.001", "0.01")).text.dropna())
    counts = Counter(w for t in texts for w in scans._words_of(t))
    monkeypatch.setattr(scans, "WORDS_MAX", 10)
    monkeypatch.setattr(scans, "FILE_WORDS", 1000)
    words, _ = scans.vocabulary(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert sum(p[1] for p in words.parts) == len(counts) and len(words.parts) > 2
    r = scans.Reader(*scans.initial(), words)
    assert all(r.df(w) == n for w, n in counts.items())
    unfiltered = scans.Stored(words.parts, b"\xff" * len(words.bits))
    keys = {scans.word_key(w) for w in counts}
    unseen = [k for p in words.parts for k in (p[2] - 1, p[2] + 1, p[3] - 1, p[3] + 1, (p[2] + p[3]) // 2) if k not in keys] + [scans.word_key(w + "~") for w in counts]
    assert all(s.get(k) == 0 for s in (words, unfiltered) for k in [*unseen, -(2**63), 2**63 - 1])
    assert {name: sorted(_rows(spark, name)) for name in want} == want
    assert scans.vocabulary(spark.createDataFrame([], "text string"))[0][0].size == 0


def test_confusions_are_learned(spark):
    """Letters taken for others at one rate wherever they stand are found, whatever they are; endings are not."""
    rng = random.Random(5)
    stems = sorted({"".join(rng.choice("bdfghklmnprstvz") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)})
    counts = Counter()
    for w in stems:
        n = rng.randint(10, 400)
        counts[w] += n
        for seen, printed in (("q", "k"), ("hn", "m"), ("w", "va")):  # none of them is stated
            at = [i for i in range(len(w)) if w.startswith(printed, i)]
            if at and rng.random() < 1 - np.exp(-0.01 * n):
                i = rng.choice(at)
                counts[w[:i] + seen + w[i + len(printed) :]] += 1
    for w in stems[:12]:
        counts[w + "s"] += counts[w] // 8  # a few words with an ending
    got = set(scans.confusions(spark.createDataFrame(list(counts.items()), "word string, n long")))
    stated = {(a, c.casefold()) for a, b in scans._STATED for c in b}
    assert got - stated == {("q", "k"), ("hn", "m"), ("w", "va")}
    assert ("b", "h") in stated - got and ("vv", "w") in got & stated, "what would show and does not is refuted; what cannot show stays"
    assert set(scans.confusions(spark.createDataFrame([], "word string, n long"))) == stated


def test_confusions_of_a_large_corpus(spark):
    """Where every word that is ever misread has all its misread forms, names and those forms do not make the confusions uneven; a stated one seen in few words stays."""
    rng = random.Random(6)
    word = lambda syllables, vowels: "".join(rng.choice("bdfghklmnprstvz") + rng.choice(vowels) for _ in range(syllables))
    shown = [("q", "k"), ("hn", "m"), ("c", "e"), ("l", "i"), ("f", "t"), ("0", "o")]
    stems = sorted({word(3, "aeiou") for _ in range(300)}) + ["zazurna", "vavorna"]
    counts = Counter({w: rng.randint(20_000, 2_000_000) for w in stems})
    for w in sorted({word(5, "aeiou") for _ in range(1500)} | {word(3, "a") + "rn" + word(1, "a") for _ in range(40)}):
        counts[w] = rng.randint(1_000, 4_000)  # names, which none misreads
    for w in stems:
        for seen, printed in [*shown, ("m", "rn")]:
            for i in (i for i in range(len(w)) if w.startswith(printed, i)):
                counts[w[:i] + seen + w[i + len(printed) :]] += counts[w] // 400
    got = set(scans.confusions(spark.createDataFrame(list(counts.items()), "word string, n long")))
    stated = {(a, c.casefold()) for a, b in scans._STATED for c in b}
    assert {*shown, ("m", "rn")} <= got and got - stated == {("q", "k"), ("hn", "m")} and ("b", "h") not in got


def test_rules_held_out():
    rng = np.random.default_rng(5)
    df = pd.DataFrame({f: rng.random(2000) for f in rules.FEATURES})
    df["other"] = (df.end_share < 0.3) | ((df.list_share > 0.8) & (df.common_share < 0.5))
    got = rules.induce(df.iloc[:1400])
    pred = np.any([rules.covers(r, df.iloc[1400:]) for r in got], axis=0)
    assert (pred == df.other.iloc[1400:]).mean() > 0.97
    assert rules.case_expression([[("end_share", "<=", 0.3)]]).count("when") == 2


def test_quality_lines():
    st = quality.LineStats(["the", "and", "的"])
    row = dict(zip(quality.LINE, st.of("- item one", ["item", "one"])))
    assert row["list_chars"] == 10 and row["end_chars"] == 0
    row = dict(zip(quality.LINE, st.of("The end and all. 🌙", ["the", "end", "and", "all"])))
    assert row["common"] == 2 and row["end_chars"] == 16
    assert len(st.of("", [])) == len(quality.LINE)


def _table(name, sf=SF):
    return pd.read_parquet(f"{sf}/{name}.parquet")


def _rows(spark, name, sf=SF):
    return [tuple(r) for r in registry.queries()[name](spark, sf).collect()]


def test_p1_brute_force(spark):
    e = _table("epub_books").dropna(subset=["flat_text"])
    m = _pairs(set(e.flat_text))
    want = {b: mojibake.repair(t, m) for b, t in zip(e.book_id, e.flat_text)}
    assert sorted(_rows(spark, "p1_found")) == sorted((b,) for b, g in want.items() if g[1])
    assert {r[0]: r[1] for r in _rows(spark, "p1_restored")} == {b: g[0] for b, g in want.items() if g[1]}


def test_p2_brute_force(spark):
    want = set()
    for src, df, key, text in (("epub_sections", _table("epub_sections"), "id", "body"), ("mobi_books", _table("mobi_books"), "book_id", "html")):
        for i, t in zip(df[key], df[text]):
            want |= {(src, i, n.family if n.family != "?" else "markdown") for n in markup.scan(t or "")}
    assert set(_rows(spark, "p2_found")) == want
    assert len(_rows(spark, "p2_clean")) == len(_table("epub_sections").id.unique()) + len(_table("mobi_books").book_id.unique())


def test_p3_brute_force(spark):
    maps = lookalike.mapping()
    rows = []
    for field, df, key, text in (("title", _table("books"), "id", "title"), ("flat_text", _table("epub_books"), "book_id", "flat_text")):
        d = df[[key, text]].dropna().drop_duplicates()
        rows += [(field, k, look, t) for k, t, look in zip(d[key], d[text], lookalike.rebuild(d[text].tolist(), maps))]
    want = {(f, min(a, b), max(a, b)) for f, a, x, s in rows for g, b, y, t in rows if f == g and x == y and s != t and a != b}
    assert set(_rows(spark, "p3_found")) == want
    links = Counter((f, k) for f, a, b in want for k in (a, b))
    got = _rows(spark, "p3_classes")
    assert len(got) == len(rows) and all(r[3] == links[r[0], r[1]] for r in got)
    least = {}
    for f, k, look, _ in rows:
        least[f, look] = min(k, least.get((f, look), k))
    assert sorted((f, k, c) for f, k, c, _ in got) == sorted((f, k, least[f, look]) for f, k, look, _ in rows)
    assert len(_rows(spark, "p3_normalised")) == len(_table("epub_books"))


def test_p4_brute_force(spark):
    d = _table("pdf_texts").dropna(subset=["text"])
    counts = Counter(w for t in set(d.text) for w in scans._words_of(t))
    keys = sorted((scans.word_key(w), n) for w, n in counts.items())
    words = np.array([k for k, _ in keys]), np.array([n for _, n in keys])
    learned = scans.confusions(spark.createDataFrame(list(counts.items()), "word string, n long"))
    first = scans.Reader(*scans.initial(), words, learned)
    n = len(scans.STATES)
    move, emit = (scans.PRIOR * x for x in scans.initial())
    for t, title in zip(d.text, d.title):
        syms = [scans.symbol(f) for f in scans.observe(t, title, first)[1]]
        path = scans.viterbi(syms, *scans.initial())
        np.add.at(emit, (path, syms), 1)
        np.add.at(move, (path[:-1], path[1:]), 1)
    assert move.shape == (n, n)
    r = scans.Reader(move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True), words, learned)
    got = {b: r.label(t, title) for b, t, title in zip(d.book_id, d.text, d.title)}
    assert sorted(_rows(spark, "p4_found")) == sorted({(b, i + 1, k) for b, (cases, _) in got.items() for i, k in cases})
    assert dict(_rows(spark, "p4_paragraphs")) == {b: scans.paragraphs(t, got[b][1]) for b, t in zip(d.book_id, d.text)}


def _site_lines():
    names = {sitelines.name_hash(w) for t in ("documents", "books") for a in _table(t).author.dropna() for w in sitelines._WORD.findall(sitelines.fold(a))}
    key = sitelines.LineKeys(names).key
    folder = dict(zip(_table("books").id, _table("books").folder_id))
    rows, records = [], {}
    for src, df, k, text in (("documents", _table("documents"), "doc_id", "text"), ("epub_books", _table("epub_books"), "book_id", "flat_text")):
        for i, t, s in zip(df[k], df[text], df.source if src == "documents" else df.book_id.map(folder)):
            if isinstance(t, str) and t.strip() and s == s and s is not None:
                site = (src, s)
                records.setdefault(site, set()).add(i)
                rows += [(site, i, src, i, n, kk) for n, line in enumerate(t.split("\n"), 1) if (kk := key(line))]
    for i, b, t in zip(_table("chapters").id, _table("chapters").book_id, _table("chapters").title):
        site = ("epub_books", folder.get(b))
        if isinstance(t, str) and (kk := key(t)):
            rows.append((site, b, "chapters", i, 1, kk))
    count = {}
    for site, record, _, _, _, kk in rows:
        if record in records.get(site, ()):
            count.setdefault((site, kk), set()).add(record)
    good = {x for x, r in count.items() if len(r) >= 3 and len(r) * 10 >= len(records[x[0]])}
    return {(src, i, n) for site, _, src, i, n, kk in rows if (site, kk) in good}, {(site[1], kk): len(count[site, kk]) for site, kk in good}


def test_p6_brute_force(spark):
    want, keys = _site_lines()
    assert want and set(_rows(spark, "p6_found")) == want
    lines = _rows(spark, "p6_lines")
    assert sorted(r[4] for r in lines) == sorted(keys.values()) and all(0 < r[5] <= r[4] and r[6] <= r[4] for r in lines)
    # names by a join instead of an array
    assert {(r.src, r.record_id, r.line_no) for r in sitelines.Lines(spark, SF, most_names=0).found().collect()} == want
    cleaned = {(s, i): t for s, i, t in _rows(spark, "p6_cleaned")}
    gone = Counter((s, i) for s, i, _ in want if s != "chapters")
    for i, t in zip(_table("documents").doc_id, _table("documents").text):
        if isinstance(t, str):
            assert len(cleaned["documents", i].split("\n")) == max(len(t.split("\n")) - gone["documents", i], 1)


def test_copies_and_several_texts_of_a_record(spark):
    """A third of the rows are copies; one record has two texts; a title counts only where its text has not the line."""
    rec = [("s", i, b"A") for i in range(10)] + [("s", 20, b"B"), ("s", 20, b"C"), ("s", 21, b"D")]
    lines = [(b"A", b"x"), (b"B", b"x"), (b"C", b"x"), (b"C", b"y"), (b"D", b"y"), (b"A", b"x")]
    titles = [("s", 0, b"x"), ("s", 1, b"y"), ("s", 1, b"y"), ("s", 20, b"z"), ("s", 99, b"z")]
    per_key, sizes = sitelines.count_records(spark.createDataFrame(lines, "h binary, key binary"), spark.createDataFrame(rec, "site string, record long, h binary"), spark.createDataFrame(titles, "site string, record long, key binary"))
    assert {bytes(r.key): r.n_records for r in per_key.collect()} == {b"x": 11, b"y": 3, b"z": 1}
    assert [r.n_site for r in sizes.collect()] == [12]


def test_p7_brute_force(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(f"{tokenize.TOKENIZERS}/byte_bpe_50k.json")
    lib.encode_special_tokens = True
    d = _table("documents")
    want = {i: lib.encode(t, add_special_tokens=False).ids if isinstance(t, str) else [] for i, t in zip(d.doc_id, d.text)}
    assert {i: list(x) for i, x in _rows(spark, "p7_ids")} == want


def test_p8_whole_tables(spark):
    rows = registry.queries()["p8_mixture"](spark, SF).toPandas()
    shares = registry.queries()["p8_shares"](spark, SF).toPandas().set_index("source")
    assert rows.groupby("source").n_tokens.sum().to_dict() == shares.tokens[shares.tokens > 0].to_dict()
    assert abs(shares.actual_share.sum() - 1) < 1e-9
    whole = rows[rows.repetition == 0].groupby("doc_id").n_tokens.sum()
    first = rows[rows.token_offset == 0]
    assert len(registry.queries()["p8_texts"](spark, SF).collect()) == len(first) and (whole > 0).all()
    mix = _table("source_mix").groupby("source").max_repeats.max()
    assert all(shares.most_used[s] <= mix[s] for s in shares.index)
    targets = registry.queries()["p8_targets"](spark, SF).toPandas()
    assert set(targets.source) == set(shares.index)


def test_p9_against_one_pass(spark):
    """Features of the query are those of the texts one by one, with site lines known from problem 6."""
    found, _ = _site_lines()
    gone = {(i, n) for s, i, n in found if s == "documents"}
    d = _table("documents")
    st = quality.LineStats(quality.common_words(spark, SF))
    want, kinds = {}, set()
    for i, source, t in zip(d.doc_id, d.source, d.text):
        if not isinstance(t, str) or not t.strip():
            want[i] = 0
            continue
        rows, keep = [], []
        for n, line in enumerate(t.split("\n"), 1):
            if line and not line.isspace():
                rows.append([hash(line.strip()) & 0x7FFFFFFF, *st.of(line, sitelines._TOKEN.split(sitelines.fold(line))[1::2])])
                keep.append((i, n) not in gone)
        f = quality.features(np.array(rows), np.zeros(len(rows), dtype=np.int64), np.array(keep), 1)
        want[i] = int(f["whole_words"][0])
        row = pd.DataFrame({c: f[c] for c in quality.OWN})
        if row.chars[0] > 0 and any(rules.covers(r, row)[0] for r in rules.RULES):
            kinds.add((i,))
    assert set(_rows(spark, "p9_found")) == kinds and kinds
    assert {r[0]: r[1] for r in _rows(spark, "p9_stats")} == want
    names = spark.createDataFrame([], "name long")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    a, b = (quality.Stats(docs, names, ["the"], most_cases=m).own.select("h", "end_share", "lines").collect() for m in (None, 0))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_rules_are_what_fit_gives(spark):
    got, _ = quality.fit(spark, "/root/testdata/sf0.01")
    assert got == rules.RULES
    _, rows = quality.fit(spark, SF, 2000, seed=9)  # other books
    pred = np.any([rules.covers(r, rows) for r in rules.RULES], axis=0)
    assert (pred == rows.other).mean() > 0.95 and not pred[rows.form.isin(["prose", "short", "dialogue"])].mean() > 0.03


def test_sql(spark):
    from tests.util import connect, same

    con = connect(SF)
    for name, sql in registry.oracle_sql().items():
        same(spark, con, registry.queries()[name](spark, SF), sql)


TABLES = ("books", "chapters", "epub_books", "epub_sections", "mobi_books", "pdf_texts", "documents", "export_options", "source_mix", "common_words", "library_folders")


def _write(spark, src, dst, how):
    for t in TABLES:
        df = spark.read.parquet(f"{src}/{t}.parquet")
        how(t, df).write.parquet(f"{dst}/{t}.parquet")


FOUND = ["p1_found", "p2_found", "p3_found", "p3_classes", "p4_found", "p5_found", "p6_found", "p7_ids", "p8_mixture", "p8_shares", "p9_found", "p9_stats"]


def test_empty_tables(spark, tmp_path):
    _write(spark, SF, str(tmp_path), lambda t, df: df.where("false"))
    for name in FOUND:
        if name != "p8_shares":
            assert registry.queries()[name](spark, str(tmp_path)).count() == 0, name


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    def spoil(t, df):
        nulls = df.limit(2).select(*[F.lit(None).cast(df.schema[c].dataType).alias(c) if i else F.col(c) for i, c in enumerate(df.columns)])
        out = df.unionByName(df.limit(3)).unionByName(nulls) if t in ("documents", "pdf_texts", "epub_sections", "mobi_books", "epub_books", "books", "chapters") else df
        for c in ("k", "t", "site", "record", "look", "raw", "n", "kind", "line", "stop", "start"):
            if c not in out.columns:
                out = out.withColumn(c, F.lit("clash"))
        return out

    _write(spark, SF, str(tmp_path), spoil)
    for name in FOUND:
        assert registry.queries()[name](spark, str(tmp_path)).count() >= 0, name


LONG = {
    "lines": "“Qui donc” l'été Ã© 第一章 <b>x</b> **b** ''w'' $5 $$ a_b [[l|m]] `c` \\textbf{z} — tail-\n" * 900,
    "blanks": " " * 80_000,
    "one letter": "a" * 80_000,
    "one sign": "的" * 80_000,
    "open marks": "''x {{a <p $$x *a **b " * 4_000,
    "escaped": "&lt;p " * 12_000,
}


@pytest.mark.parametrize("name", sorted(LONG))
def test_very_long_texts(model, name):
    import time

    t = LONG[name]
    began = time.time()
    markup.clean(t, markup.scan(t))
    markup.tree(t, markup.scan(t))
    mojibake.repair(t, model)
    assert lookalike.rebuild([t], lookalike.mapping())
    assert scans.Reader(*scans.initial(), (np.zeros(0, np.int64), np.zeros(0, np.int32))).label(t, "x") is not None
    assert chunking.cuts(chunking.code_points(t), 500, 50)[-1] == len(t)
    keys = sitelines.LineKeys(np.zeros(0, dtype=np.int64))
    stats = quality.LineStats(["the"])
    for line in t.split("\n"):
        keys.key(line)
        stats.of(line, line.split())
    assert time.time() - began < 60
