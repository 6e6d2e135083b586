"""Problem 2: markup residue in text documents.

Method: every record is parsed to a DOM whose nodes come from four families of markup (HTML, Markdown, wiki, LaTeX).
A site style tree merges the DOMs of one site (the folder of the book): for every place in the tree it holds the
presentations seen there and the contents, with the number of records. A node's importance is the larger of the
entropies of presentation and of content over the site's records; branches of low importance whose own content comes
back (banners, navigation, export comments, also a few that rotate on a large site) are removed from every record, the
rest is written as clean text that keeps headings, lists, code blocks, tables and formulas.

p2_found reads the families off the merged tree's nodes. Markers that two families share go to the family of the
record's other markers; if there is none, to the one that the site's records agree on at the same places of the tree
(else Markdown). Importance decides what p2_clean removes, not what is markup.

No mark has a greatest length: closing marks are found by one search for each kind, whose result serves all places
before it, so every step takes time linear in the text.

Defined results: null, empty and clean bodies have no nodes and stay as they are; unclosed and stray tags are nodes
of their own; repeated rows give one result for each record; a record without a site keeps all its branches.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.entities import html5

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexmill.llm.common import book_sites
from codexmill.session import materialise
from codexmill.session import texts

#: A branch is removed only if its content is the same on at least this many of a site's records.
MIN_RECORDS = 3
#: Importance (entropy scaled to 0..1) below which a branch is removed.
IMPORTANCE = 0.2

# Element names of HTML, commands of LaTeX and named references.
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "tr", "table", "blockquote", "pre", "br", "hr", "section", "article", "header", "footer", "nav", "aside", "dl", "dt", "dd", "center", "body", "html", "title", "figure", "figcaption", "thead", "tbody", "tfoot", "form", "mbp:pagebreak"}
TAGS = BLOCKS | {
    "a", "abbr", "acronym", "address", "area", "audio", "b", "base", "basefont", "bdi", "bdo", "big", "button", "canvas", "caption", "cite", "code", "col", "colgroup", "data", "datalist", "del", "details", "dfn", "dialog", "dir", "em", "embed", "fieldset", "font", "frame", "frameset", "head", "hgroup", "i", "iframe", "img", "image", "input", "ins", "kbd", "label", "legend", "link", "main", "map", "mark", "menu", "meta", "meter", "nobr", "noscript", "object", "optgroup", "option", "output", "param", "picture", "progress", "q", "rp", "rt", "ruby", "s", "samp", "script", "select", "small", "source", "span", "strike", "strong", "style", "sub", "summary", "sup", "svg", "path", "td", "template", "textarea", "th", "time", "track", "tt", "u", "var", "video", "wbr", "guide", "reference", "o:p", "ref", "references",
}
COMMANDS = (
    "documentclass|usepackage|part|chapter|section|subsection|subsubsection|paragraph|subparagraph|begin|end|item|textbf|textit|texttt|textsc|textsf|textrm|textsl|textsuperscript|textsubscript|emph|em|bf|it|tt|sc|sl|rm|underline|footnote|footnotemark|footnotetext|marginpar|label|ref|pageref|eqref|cite|citep|citet|bibitem|href|url|includegraphics|caption|title|author|date|maketitle|tableofcontents|"
    "newpage|clearpage|pagebreak|linebreak|newline|noindent|indent|par|bigskip|medskip|smallskip|vspace|hspace|vfill|hfill|centering|raggedright|hline|multicolumn|ldots|dots|cdots|quad|qquad|frac|dfrac|tfrac|sqrt|sum|prod|int|lim|infty|alpha|beta|gamma|delta|epsilon|theta|lambda|mu|pi|sigma|phi|omega|times|cdot|leq|geq|neq|approx|pm|left|right|mathrm|mathbf|mathit|text|mbox|large|Large|LARGE|huge|Huge|small|footnotesize|scriptsize|tiny|normalsize|textquoteleft|textquoteright|textendash|textemdash|glqq|grqq|og|fg|input|include|appendix|index|today|LaTeX|TeX|S|P"
)
_REFERENCE = re.compile(r"&(?:#\d{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[A-Za-z][A-Za-z0-9]{1,31};)")
_NAMED = {n for n in html5 if n.endswith(";")}
#: Case counts in the commands of LaTeX.
_COMMAND = re.compile(rf"\\(?:{COMMANDS})(?![A-Za-z])\*?")
_ENVIRONMENT = r"(?:equation|align|gather|math|displaymath|eqnarray)\*?"


class Text:
    """A text with the places of closing marks: each is looked for once behind every place, so scanning takes linear time however many marks stay open."""

    def __init__(self, text: str):
        self.text = text
        self.at: dict[str, tuple[int, int, int]] = {}
        self._pairs: dict[int, int] | None = None

    def next(self, mark: re.Pattern, p: int) -> tuple[int, int] | None:
        """The span of the first match of a closing mark at or behind p."""
        asked, i, j = self.at.get(mark.pattern, (len(self.text) + 1, 0, 0))
        if not (asked <= p <= i):
            m = mark.search(self.text, p)
            i, j = m.span() if m else (len(self.text) + 1, 0)
            self.at[mark.pattern] = p, i, j
        return (i, j) if i <= len(self.text) else None

    def template(self, p: int) -> int:
        """The end of the template {{...}} that begins at p, templates inside it included, or -1. Other braces and backslashes are no template's."""
        if self._pairs is None:
            self._pairs, open_ = {}, []
            for m in _BRACES.finditer(self.text):
                if m.group() == "{{":
                    open_.append(m.start())
                elif m.group() == "}}" and open_:
                    i = open_.pop()
                    if m.start() > i + 2:
                        self._pairs[i] = m.end()
                else:
                    open_.clear()
        return self._pairs.get(p, -1)


_BRACES = re.compile(r"\{\{(?!\{)|\}\}|[{}\\]")


def _closed(start: str, stop: str, least: int = 0, flags: int = re.S | re.I):
    """A rule: what begins with `start` and ends with the first `stop` behind it, with at least so many characters in between."""
    first, last = re.compile(start, flags), re.compile(stop, flags)

    def rule(t: Text, p: int) -> int:
        m = first.match(t.text, p)
        got = t.next(last, m.end() + least) if m else None
        return got[1] if got else -1

    return rule


def _like(pattern: str):
    """A rule: a regular expression whose repetitions stop at the next mark of its own, line end or blank."""
    match = re.compile(pattern, re.S | re.I).match

    def rule(t: Text, p: int) -> int:
        m = match(t.text, p)
        return m.end() if m else -1

    return rule


def _comment(t: Text, p: int) -> int:
    if not t.text.startswith("<!--", p):
        return -1
    got = t.next(_COMMENT_END, p + 4)
    return got[1] if got else len(t.text)


_COMMENT_END = re.compile("-->")
_ELEMENT = re.compile(r"/?([a-z0-9:]+)(?=[\s/>&])", re.I)
_SCRIPT = re.compile(r"<(script|style)\b[^<>]*>", re.I)
_SCRIPT_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style")}
_TAG_END, _LT, _GT, _COMMENT_GT = re.compile(r"[^<>]*>|[^<>\n]*(?=\n|\Z)"), re.compile("&lt;"), re.compile("&gt;"), re.compile("--&gt;")
_FENCE, _FENCE_END, _FENCE_LINE = re.compile(r"(?m:^ {0,3}(?:```|~~~)[^\n`]*\n)"), re.compile(r"(?m:^ {0,3}(?:```|~~~) *$)"), re.compile(r"(?m:^ {0,3}```[^\n`]*$)")


def _script(t: Text, p: int) -> int:
    m = _SCRIPT.match(t.text, p)
    got = t.next(_SCRIPT_END[m.group(1).lower()], m.end()) if m else None
    return got[1] if got else -1


def _element(t: Text, p: int) -> int:
    """A tag of any length, or one that its line's end cuts off."""
    m = _ELEMENT.match(t.text, p + 1)
    if not m or m.group(1).lower() not in TAGS:
        return -1
    m = _TAG_END.match(t.text, m.end())
    return m.end() if m else -1


def _escaped(t: Text, p: int) -> int:
    if t.text.startswith("&lt;!--", p):
        got = t.next(_COMMENT_GT, p + 7)
        return got[1] if got else -1
    m = _ELEMENT.match(t.text, p + 4) if t.text.startswith("&lt;", p) else None
    if not m or m.group(1).lower() not in TAGS:
        return -1
    got, again = t.next(_GT, m.end()), t.next(_LT, m.end())
    return got[1] if got and not (again and again[0] < got[0]) else -1


def _fence(t: Text, p: int) -> int:
    m = _FENCE.match(t.text, p)
    got = t.next(_FENCE_END, m.end()) if m else None
    if got:
        return got[1]
    m = _FENCE_LINE.match(t.text, p)
    return m.end() if m else -1


#: (family, kind, characters it begins with inside a line, characters it begins with after blanks at a line's start, rule), tried in this order at each place.
_RULES = [
    ("html", "comment", "<", "", _comment),
    ("html", "script", "<", "", _script),
    ("html", "doctype", "<]", "", _like(r"<!DOCTYPE[^<>]*>|<\?xml[^<>]*>|<!\[CDATA\[|\]\]>")),
    ("html", "tag", "<", "", _element),
    ("html", "escaped", "&", "", _escaped),
    ("markdown", "fence", "", "`~", _fence),
    ("latex", "verbatim", "\\", "", _closed(r"\\begin\{(?:verbatim|lstlisting|minted)\*?\}", r"\\end\{(?:verbatim|lstlisting|minted)\*?\}")),
    ("latex", "formula", "$", "", _closed(r"\$\$", r"\$\$", 1)),
    ("latex", "formula", "\\", "", _closed(rf"\\begin\{{{_ENVIRONMENT}\}}", rf"\\end\{{{_ENVIRONMENT}\}}")),
    ("latex", "formula", "\\", "", _closed(r"\\\[", r"\\\]", 1)),
    ("latex", "formula", "\\", "", _closed(r"\\\(", r"\\\)", 1)),
    ("latex", "formula", "$", "", _like(r"\$(?![\s\d])(?=[^$\n\\^_={}]*[\\^_={}])[^$\n]+(?<!\s)\$(?!\d)")),
    ("latex", "command", "\\", "", lambda t, p: m.end() if (m := _COMMAND.match(t.text, p)) else -1),
    ("wiki", "table", "", "{|", _like(r"(?m:^\{\|[^\n]*$)|(?m:^\|\}[^\n]*$)|(?m:^\|[-+](?![-|: ]*\|)[^\n]*$)")),
    ("wiki", "template", "{", "", lambda t, p: t.template(p)),
    ("wiki", "link", "[", "", _like(r"\[\[[^\[\]\n]+\]\]|\[https?://[^\s\]]+(?: [^\]\n]*)?\]")),
    ("wiki", "heading", "", "=", _like(r"(?m:^={1,6} ?[^=\n][^\n]*?={1,6} *$)")),
    ("wiki", "emphasis", "'", "", _like(r"'{2,5}(?=[^'\n])(?:[^'\n]|'(?!'))+'{2,5}")),
    ("wiki", "magic", "_~<", "#", _like(r"(?-i:__[A-Z]{3,}__)|(?<!~)~{3,5}(?!~)(?<!\n~~~)|(?m:^#REDIRECT\b)|</?(?:nowiki|gallery)\b[^<>]*>")),
    ("markdown", "link", "![<", "[", _like(r"!?\[[^\[\]\n]*\]\([^()\s]*(?: \"[^\"\n]*\")?\)|\[[^\[\]\n]+\]\[[^\[\]\n]*\]|(?m:^ {0,3}\[[^\[\]\n^]+\]:\s+\S+)|<https?://[^\s<>]+>")),
    ("markdown", "footnote", "[", "", _like(r"\[\^[^\[\]\s]+\]:?")),
    ("markdown", "strong", "*_~", "", _like(r"\*\*(?=\S)[^*\n]+(?<=\S)\*\*|(?<![A-Za-z0-9_])__(?=\S)[^_\n]+(?<=\S)__(?![A-Za-z0-9_])|~~(?=\S)[^~\n]+~~|\*\*\*(?=\S)[^*\n]+\*\*\*")),
    ("markdown", "code", "`", "", _like(r"``[^\n]+?``|`[^`\n]+`")),
    ("markdown", "table", "", "|:-", _like(r"(?m:^ *+\|?(?: *+:?-{2,}+:? *+\|)+(?: *+:?-{2,}+:?)? *+\|? *+$)")),
    ("markdown", "task", "", "-*+", _like(r"(?m:^ {0,3}[-*+] \[[ xX]\] )")),
    ("markdown", "setext", "", "=-", _like(r"(?m:(?<=\n)(?:={3,}|-{3,}) *$)")),
    ("?", "heading", "", "#", _like(r"(?m:^#{1,6} +(?=\S))")),
    ("?", "emphasis", "*_", "", _like(r"(?<![\w*])\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*(?![\w*])|(?<=[㐀-鿿，。、：；！？”“])\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*(?!\*)|(?<![\w_/.])_(?=[^\s_])[^_\n]+(?<=[^\s_])_(?![\w_/.])")),
    ("?", "quote", "", ">", _like(r"(?m:^ {0,3}>+ ?(?=\S))")),
    ("?w", "bullet", "", "*#", _like(r"(?m:^\*{1,5} *(?=[^\s*]))|(?m:^#{2,6}(?=[^#\s]))")),
    ("?w", "indent", "", ":;", _like(r"(?m:^[:;]{1,6} ?(?=\S))")),
    ("??", "rule", "", "-*_", _like(r"(?m:^ {0,3}(?:-{3,}|\*{3,}|_{3,}) *$)")),
    ("??", "item", "", "-+0123456789", _like(r"(?m:^ {0,3}(?:[-+]|\d{1,3}\.) +(?=\S))")),
    ("html", "reference", "&", "", _like(_REFERENCE.pattern)),
]
_INLINE: dict[str, list[int]] = {}
_AT_START: dict[str, list[int]] = {}
for _k, (_, _, _a, _b, _) in enumerate(_RULES):
    for _c in _a:
        _INLINE.setdefault(_c, []).append(_k)
    for _c in _b:
        _AT_START.setdefault(_c, []).append(_k)
_BOTH = {c: sorted(set(_INLINE.get(c, [])) | set(_AT_START.get(c, []))) for c in {*_INLINE, *_AT_START}}
#: Where a node may begin: within a line, or at a line's start.
_PLACES = re.compile(r"[<&\\$*_\[`]|\{\{|''|~~|!\[|\]\]>")
_STARTS = re.compile(r"\n *[" + "".join(re.escape(c) for c in sorted(_AT_START)) + "]")


@dataclass(slots=True)
class Node:
    """A piece of markup: its span in the text, family, kind, name (of a tag or command) and style (attributes)."""

    start: int
    stop: int
    family: str
    kind: str
    name: str = ""
    style: str = ""


def _places(text: str) -> list[tuple[int, str, dict[str, list[int]]]]:
    """Places in order, each with the character that decides which rules are tried there."""
    out = [(m.start(), m.group()[0], _INLINE) for m in _PLACES.finditer(text)]
    starts = [(m.start() + 1, m.group()[-1], _BOTH if m.end() == m.start() + 2 else _AT_START) for m in _STARTS.finditer(text)]
    if m := _STARTS.match("\n" + text[: re.match(" *", text).end() + 1]):
        starts.append((0, m.group()[-1], _BOTH if m.end() == 2 else _AT_START))
    if not starts:
        return out
    taken = {p for p, _, rules in starts if rules is _BOTH}
    return sorted([x for x in out if x[0] not in taken] + starts, key=lambda x: x[0])


def scan(text: str) -> list[Node]:
    """The nodes of a text in order; families of shared markers are settled ('?' where the record has no other markers)."""
    out: list[Node] = []
    pre = False
    at = 0
    t = Text(text)
    for p, c, table in _places(text):
        if p < at:
            continue
        for k in table[c]:
            family, kind, _, _, rule = _RULES[k]
            stop = rule(t, p)
            if stop >= 0:
                break
        else:
            continue
        at = max(stop, p + 1)
        s = text[p:stop]
        node = Node(p, stop, family, kind)
        if kind == "reference":
            if s[1] != "#" and s[1:] not in _NAMED:
                continue
        elif kind in ("tag", "escaped"):
            inner = s[4:-4] if kind == "escaped" else s.strip("<>")
            m = re.match(r"/?[\w:]+", inner)
            node.name = m.group().lower() if m else "!"
            node.style = inner[m.end() :].strip() if m else ""
            if node.name.lstrip("/") == "pre":
                pre = not node.name.startswith("/")
        elif family == "latex" and kind == "command":
            node.name = s[1:].rstrip("*")
        elif kind in ("emphasis", "strong") and family in ("wiki", "markdown", "?"):
            node.name = s[:2]
            mark = len(s) - len(s.lstrip(s[0]))
            if family == "wiki" and len(s.strip("'")) == 0:
                continue
            at = p + mark  # markup inside it counts as well
            node.style = s
        if pre and family != "html":
            at = stop
            continue
        out.append(node)
    strong = {n.family for n in out if n.family in ("markdown", "wiki")}
    shared = "wiki" if strong == {"wiki"} else "markdown" if strong else "?"
    marked = bool(strong) or any(n.family == "?" for n in out)
    kept = []
    for n in out:
        if n.family in ("?w", "??") and not marked:
            continue
        if n.family == "?w":
            n.family = "wiki" if "wiki" in strong else shared
        elif n.family in ("?", "??"):
            n.family = shared
        kept.append(n)
    return kept


def _digest(s: str) -> bytes:
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=10).digest()


def _place(parent: bytes, name: str) -> bytes:
    """A place in the tree: the hash of its parent's and its own name, so that deep paths cost no more than flat ones."""
    return hashlib.blake2b(parent + b"/" + name.encode("utf-8", "surrogatepass"), digest_size=10).digest()


class _Path:
    """The open blocks: places from the root on, and where each name stands."""

    def __init__(self):
        self.places, self.names, self.of = [b""], [], {}

    def push(self, name: str) -> None:
        self.places.append(_place(self.places[-1], name))
        self.of.setdefault(name, []).append(len(self.names))
        self.names.append(name)

    def cut(self, name: str, first: bool) -> None:
        """Closes a block (its first or last opening) and all inside it."""
        if self.of.get(name):
            k = self.of[name][0 if first else -1]
            while len(self.names) > k:
                self.of[self.names.pop()].pop()
                self.places.pop()


_CLOSES_ITSELF = ("p", "li", "tr", "h1", "h2", "h3")
_DIGITS = re.compile(r"\d+")


def tree(text: str, nodes: list[Node]) -> list[tuple[str, bytes, str, int, int, str]]:
    """The record's DOM as branches: (family, place, style, start, stop, content).

    A branch is a comment, a script, or what lies between an opening tag of a block and the next tag of a block; in
    other markup, a line with a marker. `place` stands for the path of open blocks. Time is linear in the text."""
    out = []
    path = _Path()
    ends: list[int] = []  # of each node, where the next tag of a block of its kind begins
    nearest = {"tag": len(text), "escaped": len(text)}
    for n in reversed(nodes):
        ends.append(nearest.get(n.kind, 0))
        if n.kind in nearest and n.name.lstrip("/") in BLOCKS:
            nearest[n.kind] = n.start
    breaks = [m.start() for m in re.finditer("\n", text)] if any(n.family != "html" for n in nodes) else []
    for n, stop in zip(nodes, reversed(ends)):
        if n.family == "html" and n.kind in ("tag", "escaped"):
            name = n.name.lstrip("/")
            if n.name.startswith("/"):
                path.cut(name, False)
                continue
            style = _DIGITS.sub("#", n.style)
            if name in BLOCKS:
                if name in _CLOSES_ITSELF:
                    path.cut(name, True)
                out.append(("html", _place(path.places[-1], name), style, n.start, stop, _DIGITS.sub("#", _words(text[n.stop : stop]))))
                if name not in ("br", "hr"):
                    path.push(name)
                continue
            out.append(("html", _place(path.places[-1], name), style, n.start, n.stop, "*"))
        elif n.kind in ("comment", "script"):
            out.append(("html", _place(path.places[-1], n.kind), "", n.start, n.stop, _DIGITS.sub("#", _words(text[n.start : n.stop]))))
        else:
            k = bisect_left(breaks, n.start)
            i = breaks[k - 1] + 1 if k else 0
            k = bisect_left(breaks, n.stop)
            j = breaks[k] if k < len(breaks) else len(text)
            whole = n.start == i and n.kind not in ("bullet", "item", "emphasis", "strong")
            style = n.style if n.kind in ("tag", "escaped") else ""
            out.append((n.family, _place(path.places[-1], f"{n.kind} {n.name}"), style, i if whole else n.start, j if whole else n.stop, _DIGITS.sub("#", _words(text[i:j])) if whole else "*"))
    return out


def _words(s: str) -> str:
    return " ".join(re.sub(r"<[^<>]*>", " ", s).casefold().split())


def _heading(level: int, s: str) -> str:
    return f"\n\n{'#' * level} {s.strip()}\n\n"


_ARGUMENT, _BLANKS = re.compile(r"\s*(?:\[[^\[\]\n]*\])?\s*\{"), re.compile(r"[ \t]*")


def _groups(text: str) -> dict[int, int]:
    """Of every brace that is closed: where."""
    out, open_ = {}, []
    for m in re.finditer(r"(?<!\\)[{}]", text):
        if m.group() == "{":
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.start()
    return out


def clean(text: str, nodes: list[Node], dropped: list[tuple[int, int]] = ()) -> str:
    """Text without markup: headings as '# ', items as '- ', code indented by four spaces, formulas between '$$'."""
    if not nodes:
        return text
    cut = sorted(dropped)
    out: list[str] = []
    at = c = 0
    code: int | None = None  # where in `out` an open <pre> begins
    braces = _groups(text) if any(n.family == "latex" for n in nodes) else {}
    for n in nodes:
        while c < len(cut) and cut[c][1] <= n.start:
            if cut[c][1] > at:
                out.append(text[at : max(cut[c][0], at)])
                at = max(at, cut[c][1])
            c += 1
        if c < len(cut) and cut[c][0] <= n.start < cut[c][1]:
            if cut[c][0] > at:
                out.append(text[at : cut[c][0]])
            at = max(at, cut[c][1])
            continue
        if n.start < at:
            continue
        out.append(text[at : n.start])
        s = text[n.start : n.stop]
        at = n.stop
        name = n.name.lstrip("/")
        if n.family == "html":
            if n.kind == "reference":
                out.append(html.unescape(s))
            elif n.kind in ("tag", "escaped"):
                closing = n.name.startswith("/")
                if re.fullmatch(r"h[1-6]", name):
                    out.append("\n\n" if closing else f"\n\n{'#' * int(name[1])} ")
                elif name == "li":
                    out.append("" if closing else "\n- ")
                elif name in ("td", "th"):
                    out.append(" \t" if closing else "")
                elif name == "pre":
                    out.append("\n\n")
                    if not closing:
                        code = len(out)
                    elif code is not None:
                        body = "".join(out[code:]).strip("\n")
                        out[code:] = ["\n".join("    " + line for line in body.split("\n")) + "\n\n"]
                        code = None
                elif name in BLOCKS:
                    out.append("\n" if name in ("br", "tr", "ul", "ol") else "\n\n")
        elif n.kind == "fence":
            body = re.sub(r"\A *(?:```|~~~)[^\n]*\n?|\n? *(?:```|~~~) *\Z", "", s)
            out.append("\n" + "\n".join("    " + line for line in body.split("\n")) + "\n" if body else "")
        elif n.kind == "verbatim":
            body = re.sub(r"\A\\begin\{[^}]*\}(?:\[[^\]]*\])?\n?|\n?\\end\{[^}]*\}\Z", "", s)
            out.append("\n\n" + "\n".join("    " + line for line in body.split("\n")) + "\n\n")
        elif n.kind == "formula":
            body = re.sub(r"\A(?:\$\$?|\\\[|\\\(|\\begin\{[^}]*\})|(?:\$\$?|\\\]|\\\)|\\end\{[^}]*\})\Z", "", s).strip()
            out.append(f"$${body}$$")
        elif n.family == "latex":
            m = _ARGUMENT.match(text, at)
            end = braces.get(m.end() - 1) if m else None
            inner = text[m.end() : end] if end is not None else None
            if name in ("chapter", "part", "section", "subsection", "subsubsection", "title") and inner is not None:
                out.append(_heading({"part": 1, "chapter": 1, "title": 1, "section": 2, "subsection": 3, "subsubsection": 4}[name], inner))
                at = end + 1
            elif name == "item":
                out.append("\n- ")
                at = _BLANKS.match(text, at).end()
            elif name in ("begin", "end", "label", "ref", "pageref", "cite", "vspace", "hspace", "includegraphics", "documentclass", "usepackage", "input", "include", "index", "bibitem") and inner is not None:
                out.append("\n" if name in ("begin", "end") else "")
                at = end + 1
            elif name in ("ldots", "dots", "cdots"):
                out.append("…")
            elif inner is not None:
                out.append(f" ({inner})" if name == "footnote" else inner)
                at = end + 1
            elif name in ("em", "bf", "it", "tt", "sc", "sl", "rm"):
                at = _BLANKS.match(text, at).end()
        elif n.kind == "heading" and n.family == "wiki" and s[0] == "=":
            out.append(_heading(min(max(len(s) - len(s.lstrip("=")) - 1, 1), 6), s.strip(" =")))
        elif n.kind == "heading":
            wiki_item = n.family == "wiki"
            out.append("- " if wiki_item else s)
        elif n.kind == "setext":
            line = ""
            while out and "\n" not in line.rstrip("\n"):
                line = out.pop() + line
            line = line.rstrip("\n")
            i = line.rfind("\n") + 1
            out.append(line[:i] + ("# " if "=" in s else "## ") + line[i:] + "\n")
        elif n.kind in ("emphasis", "strong"):
            out.append(s.strip("*_~'"))
        elif n.kind == "code":
            out.append(s.strip("`"))
        elif n.kind == "link":
            body = s.strip("!<>")
            if body.startswith("[["):
                body = body[2:-2]
                out.append("" if re.match(r"(?i)(?:category|file|image|datei|fichier|archivo|файл|分类|文件):", body) and "|" not in body else body.rpartition("|")[2])
            elif re.match(r"\[[^\]]*\]:", body):
                out.append("")
            elif body.startswith("[http"):
                out.append(body[1:-1].partition(" ")[2] or body[1:-1])
            else:
                m = re.match(r"\[([^\]]*)\]", body)
                out.append(m.group(1) if m else body)
        elif n.kind in ("bullet", "item", "task"):
            out.append(s if re.match(r"\s*\d", s) else "- ")
        elif n.kind == "table" and n.family == "wiki":
            out.append("")
        elif n.kind in ("quote", "indent", "footnote", "template", "magic", "rule", "table"):
            out.append("")
    while c < len(cut):
        if cut[c][1] > at:
            out.append(text[at : max(cut[c][0], at)])
            at = max(at, cut[c][1])
        c += 1
    out.append(text[at:])
    res = "".join(out).replace("\xa0", " ")
    if any(n.kind == "escaped" for n in nodes):
        res = html.unescape(res)  # its references were escaped twice
    if any(n.kind == "table" for n in nodes):
        res = "\n".join(_row(line) for line in res.split("\n"))
    res = re.sub(r"[ \t]+\n", "\n", res)
    return re.sub(r"\n{3,}", "\n\n", res).strip("\n")


def _row(line: str) -> str:
    """Cells of a table's row apart by tabs."""
    t = line.strip()
    if not (t.startswith(("|", "!")) or t.endswith("|")):
        return line
    return "\t".join(c.strip() for c in re.split(r"\|\||\||!!", t.strip("|! ")))


def records(spark, sf_dir: str) -> DataFrame:
    """(src, record_id, site, text) of both tables."""
    sites = book_sites(spark, sf_dir)
    a = texts(spark, sf_dir, "epub_sections").select(F.lit("epub_sections").alias("src"), F.col("id").alias("record_id"), "book_id", F.col("body").alias("text"))
    b = texts(spark, sf_dir, "mobi_books").select(F.lit("mobi_books").alias("src"), F.col("book_id").alias("record_id"), "book_id", F.col("html").alias("text"))
    return a.unionByName(b).where("record_id is not null").join(sites, "book_id", "left").select("src", "record_id", F.col("folder_id").alias("site"), "text")


def branches(rows: DataFrame) -> DataFrame:
    """The branches of every record's DOM: (src, record_id, site, family, place, style, start, stop, content, first, last).

    `first` and `last` number the branches with a content at one place from the record's start and end. A record without
    branches has one row, whose family is null; family is '?' where a record has only markers that two families share."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for src, rid, site, text in zip(b["src"], b["record_id"], b["site"], b["text"]):
                site = None if site != site else site
                found = tree(text, scan(text)) if text else []
                if not found:
                    out.append((src, rid, site, *[None] * 8))
                total = Counter(x[1] for x in found if x[5] != "*")
                at: Counter = Counter()
                for family, place, style, i, j, content in found:
                    style = _digest(style)
                    if content == "*":
                        out.append((src, rid, site, family, place, style, i, j, None, None, None))
                    else:
                        at[place] += 1
                        out.append((src, rid, site, family, place, style, i, j, _digest(content), at[place], total[place] + 1 - at[place]))
            numbers = ["site", "start", "stop", "first", "last"]
            yield pd.DataFrame(out, columns=["src", "record_id", "site", "family", "place", "style", "start", "stop", "content", "first", "last"]).astype(dict.fromkeys(numbers, "Int64"))

    return rows.mapInPandas(part, "src string, record_id long, site long, family string, place binary, style binary, start long, stop long, content binary, first long, last long")


def style_tree(nodes: DataFrame) -> DataFrame:
    """The site style tree: (site, place, content, records, n_site, importance) of the contents that come back within a site.

    Branches at one place are aligned to nodes of the tree in three ways: by their number from the record's start, by
    their number from its end, and by their presentation. All entropies are to the base of the site's records (those
    without a node too). A content's importance is 1 less the entropy of its spread over the records (0 on all of them,
    1 on one), a node's content importance is the mean over its branches, and its presentation importance the entropy of
    its styles. A branch is as important as the largest of the three says, in the alignment where that is least. Counts
    of a hot site spread over (node, content)."""
    rows = nodes.where("site is not null")
    n_site = rows.groupBy("site").agg(F.count_distinct("src", "record_id").alias("n_site"))
    node = ["site", "place", "node"]
    align = F.array(F.concat(F.lit("<"), F.col("first").cast("string")), F.concat(F.lit(">"), F.col("last").cast("string")), F.concat(F.lit("="), F.hex("style")))
    at = rows.where("content is not null").select("site", "place", "style", "content", "src", "record_id", F.explode(align).alias("node"))
    same = at.select(*node, "content", "src", "record_id").distinct().groupBy(*node, "content").agg(F.count("*").alias("records")).join(n_site, "site")
    same = same.withColumn("own", F.when(F.col("n_site") > 1, 1.0 - F.log2("records") / F.log2("n_site")).otherwise(1.0))
    content = same.groupBy(*node).agg((F.sum(F.col("records") * F.col("own")) / F.sum("records")).alias("content_importance"))
    styles = at.groupBy(*node, "style").agg(F.count("*").alias("n"))
    presentation = styles.groupBy(*node).agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("bits"))
    out = same.where(F.col("records") >= MIN_RECORDS).join(content, node).join(presentation, node)
    importance = F.greatest("own", "content_importance", F.col("bits") / F.log2("n_site"))
    return out.groupBy("site", "place", "content").agg(F.max("records").alias("records"), F.max("n_site").alias("n_site"), F.min(importance).alias("importance"))


def settled(nodes: DataFrame) -> DataFrame:
    """(src, record_id, markup): the families of every record, by the merged tree.

    Where a record has only markers that two families share, they belong to the family that the site's other records
    have at the same places of the tree, if MIN_RECORDS of them at least agree on wiki; else they are Markdown."""
    own = nodes.where("family is not null").select("src", "record_id", "site", "place", "family").distinct()
    places = own.where("site is not null and family in ('wiki', 'markdown')").groupBy("site", "place").agg(F.count_if(F.col("family") == "wiki").alias("wiki"), F.count_if(F.col("family") == "markdown").alias("markdown"))
    wiki = places.where((F.col("markdown") == 0) & (F.col("wiki") >= MIN_RECORDS)).select("site", "place", F.lit(True).alias("is_wiki"))
    open_ = own.where("family = '?'").join(wiki, ["site", "place"], "left").groupBy("src", "record_id").agg(F.coalesce(F.bool_or("is_wiki"), F.lit(False)).alias("is_wiki"))
    told = open_.select("src", "record_id", F.when(F.col("is_wiki"), "wiki").otherwise("markdown").alias("markup"))
    return own.where("family <> '?'").select("src", "record_id", F.col("family").alias("markup")).unionByName(told).distinct()


def p2_found(spark, sf_dir):
    """(src, record_id, markup): the families of the nodes of each record's DOM, merged to the site style tree."""
    return settled(materialise(branches(records(spark, sf_dir)), "dom"))


def p2_clean(spark, sf_dir):
    """(src, record_id, text): clean text without the branches that are of low importance on the site."""
    rows = records(spark, sf_dir)
    nodes = materialise(branches(rows), "dom")
    low = style_tree(nodes).where(F.col("importance") < IMPORTANCE).select("site", "place", "content")
    cut = nodes.join(low, ["site", "place", "content"], "left_semi").groupBy("src", "record_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("cut"))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [None if t is None else clean(t, scan(t), [] if c is None else [(x["start"], x["stop"]) for x in c]) for t, c in zip(b["text"], b["cut"])]
            yield pd.DataFrame({"src": b["src"], "record_id": b["record_id"], "text": texts})

    return rows.dropDuplicates(["src", "record_id"]).join(cut, ["src", "record_id"], "left").select("src", "record_id", "text", "cut").mapInPandas(part, "src string, record_id long, text string")


QUERIES = {"p2_found": p2_found, "p2_clean": p2_clean}
SQL: dict[str, str] = {}
