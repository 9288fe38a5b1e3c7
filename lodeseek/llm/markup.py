"""Clean text from documents with HTML, Markdown, wiki or LaTeX markup.

Code blocks and formulas are set aside first, so nothing in them is taken for
markup. Then each kind of markup is stripped to a plain form that keeps
structure: ``#`` headings, ``- `` and numbered list items, fenced code blocks,
``$`` formulas and `` | `` between cells. What the stripping leaves behind is sifted
by the distribution of text over lines: text lengths are summed over a sliding
window of lines, any line with content opens a block, a dive of the sum to nothing
closes it, and the lines between are kept without residue of markup. Residue is a
line of signs of markup only, unless it is a row of a table or an item, or stands so
in the source and is no markup there.

Of a page's text, what HTML marks as a link, or as navigation, footer or aside,
has no length. The first surge of what is left is where the page's own text begins, its
last dive where that ends. Before and after, navigation, footers and asides are left out,
and so is a window of lines that are links only. A document without such marks loses nothing.

Signs of markup in other widths, blanks of other widths and invisible characters
among them are recognised on a folded copy. The copy carries for each character
what it stands for, so the clean text has the characters of the original.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from html.entities import html5

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.lookalike import mapping
from lodeseek.runtime import spread

KINDS = ("html", "markdown", "wiki", "latex")
WINDOW = 3
# Marks of headings and items that other markup has made, so that they are not taken for Markdown, and of cells.
HEAD, ITEM, CELL = "\x03", "\x04", "\x05"
# Marks around links, and around navigation, footers and asides.
LINK, LINKED, SIDE, SIDED = "\x06", "\x07", "\x0e", "\x0f"
_SIDES = ("nav", "footer", "aside")
_ASIDE = re.compile(rf"[{LINK}{LINKED}{SIDE}{SIDED}]")
_FURNISHED = re.compile(r"<(?:a|nav|footer|aside)\b", re.I)
# A line of nothing but these may be residue.
_SIGNS = re.compile(r"[\s|{}\[\]()<>=*_~`#^&;:!\\$/+-]+")
# A line that is markup even where it stands so in the source: rules, bullets, delimiters, openers and closers left alone.
_TOKEN = re.compile(r"([*_=~`#>|\\-])(?:\s*\1)*|[-:|+\s]+|\|[-+}]+|\{\||\{{2,}|\}{2,}|\[{2,}|\]{2,}|\${2}|<!--+|--+>")
_BRACKETS = re.compile(r"[{}\[\]\s]+")
_ITEM_OF_SIGNS = re.compile(r"-[ \t]+[+=<>~^&:/!]+")

# Names of HTML elements.
_ELEMENTS = (
    "a abbr address article aside audio b base big blockquote body br button canvas caption center cite code col "
    "colgroup dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form frame h1 h2 h3 "
    "h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta nav noscript "
    "object ol optgroup option p param picture pre q s samp script section select small source span strike strong "
    "style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"
)
_NAME = "(?:" + "|".join(sorted(_ELEMENTS.split(), key=len, reverse=True)) + ")"
_ATTRIBUTE = r"""(?:\s+[\w:.-]+(?:\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=`]+))?)"""
_BOTH = re.I | re.M
_TAG = re.compile(rf"<(?:/{_NAME}\s*|{_NAME}(?:(?:\s+[\w:.-]+\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>=`]+)){_ATTRIBUTE}*)?\s*/?)>|<!doctype\b[^<>]*>", _BOTH)
_REFERENCE = re.compile(r"&(?:#\d{1,7}|#x[0-9a-f]{1,6}|([a-z][a-z0-9]{1,31}));", re.I)
_ANY_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
_INNER_TAG = re.compile(r"<[^<>]*>")
_CODE_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_CELL_END = re.compile(r"\s*(?:\|\||!!)\s*")
_ITEM_COMMAND = re.compile(r"^[ \t]*\\item\b[ \t]*", re.M)
_ESCAPED = re.compile(r"\\([%&#_{}$])")
_BLANKS, _GAP, _MADE, _CELL = re.compile(r"[ \t]+"), re.compile(r"\n{3,}"), re.compile(f"[{HEAD}{ITEM}]"), re.compile(rf"[ \t]*{CELL}[ \t]*$|{CELL}", re.M)
_BLOCK, _BLOCK_LINE, _INLINE = re.compile(r"\x01(\d+)\x01"), re.compile(r"\x01(\d+)\x01block"), re.compile(r"\x02(\d+)\x02")
_CODE = re.compile(
    r"^(?P<fence>[ ]{0,3}(?P<mark>`{3,}|~{3,})[^\n`]*)$|(?P<pre><(?P<el>pre|code|script|style|textarea)\b[^<>]*>)|(?P<verb>\\begin\{(?P<env>verbatim\*?|lstlisting|minted|Verbatim)\})|(?P<wiki><(?P<wel>nowiki|source|syntaxhighlight)\b[^<>]*>)|(?P<rem><!--)",
    _BOTH,
)
_MATH_MARK = re.compile(r"\\(begin|end)\{((?:equation|align|gather|multline|eqnarray|displaymath|math)\*?)\}")
_MATH = re.compile(r"\$\$(?!\$)([^$]+)\$\$|\\\[([^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*?)\\\]|\\\(((?:[^\\\n]|\\[^()])*)\\\)|(?<![\w\\$])\$(?![\s$])([^$\n]*?[^\s\\$])\$(?![\w$])", re.S)
_MATHEMATICAL = re.compile(r"[\\^_=<>+{}]|^[A-Za-z](?:\([A-Za-z]\)|'{1,2})?$|^[A-Za-z] ?[-*/] ?[A-Za-z0-9]$")
_FRONT = re.compile(r"\A\s*---[ \t]*\n(?:.*\n)*?(?:---|\.\.\.)[ \t]*(?:\n|\Z)")
_FRONT_KEY = re.compile(r"^[\w -]+:", re.M)

_ATX = re.compile(r"^[ ]{0,3}(#{1,6})[ \t]+(\S.*?)(?:[ \t]+#+)?[ \t]*$", re.M)
_UNDERLINE = re.compile(r"[ ]{0,3}(={3,}|-{3,})[ \t]*")
_LIST = re.compile(r"^([ \t]*)([-*+]|\d{1,4}[.)])[ \t]+(?=\S)(\[[ xX]\][ \t]+)?", re.M)
_QUOTE = re.compile(r"^[ ]{0,3}(?:>[ ]?)+(?=\S|$)", re.M)
_DELIMITER = re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*$", re.M)
_IMAGE = re.compile(r"!\[([^\[\]\n]*)\](?:\([^()\n]*\)|\[[^\[\]\n]*\])")
_LINK = re.compile(r"(?<!!)\[([^\[\]\n]+)\]\((?:[^()\n]|\([^()\n]*\))*\)")
_REFLINK = re.compile(r"\[([^\[\]\n]+)\]\[([^\[\]\n]*)\]")
_DEFINITION = re.compile(r"^[ ]{0,3}\[(?!\^)[^\[\]\n]+\]:[ \t]*\S+.*$", re.M)
_NOTE = re.compile(r"\[\^[^\[\]\s]+\](?!:)")
_NOTE_TEXT = re.compile(r"^[ ]{0,3}\[\^[^\[\]\s]+\]:[ \t]*", re.M)
_AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+)>", re.I)
_SPAN = re.compile(r"(?<!`)(`{1,2})(?!`)([^`\n]+)\1(?!`)")
_STRIKE = re.compile(r"(?<!~)~~(?=[^\s~])([^~\n]*[^\s~])~~(?!~)")
_STAR = re.compile(r"(?<![0-9A-Za-z\u00c0-\u04ff*\\])(\*{1,3})(?=[^\s*])([^*\n]*[^\s*])\1(?![0-9A-Za-z\u00c0-\u04ff*])")
_LINE = re.compile(r"(?<![\w\\])(_{1,3})(?=[^\s_])([^\n_]*(?:(?<=\w)_(?=\w)[^\n_]*)*[^\s_])\1(?!\w)")

_WIKI_LINK = re.compile(r"\[\[([^\[\]\n|]+)(?:\|([^\[\]\n]*))?\]\]")
_WIKI_HEAD = re.compile(r"^(={1,6})(?!=)[ \t]*([^=\n](?:[^\n]*[^=\n])?)[ \t]*\1[ \t]*$", re.M)
_WIKI_QUOTE = re.compile(r"(?<![\w'])('{2,3}|'{5})(?=[^\s'])((?:[^'\n]|'(?!'))*[^\s'])\1(?![\w'])")
_TEMPLATE = re.compile(r"(?<![\\{\w])\{\{\s*[^\W\d_#:!][^{}]*\}\}")
_BRACE_TABLE = re.compile(r"^[ \t:]*\{\|.*?(?:^[ \t]*\|\}|\Z)", _BOTH | re.S)
_OUTER_LINK = re.compile(r"(?<![\[!\]])\[((?:https?|ftp)://[^\s\[\]]+)(?:[ \t]+([^\[\]\n]+))?\](?![\[(:])", re.I)

_ENV = re.compile(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\[\]\n]*\])?")
_COMMAND = re.compile(r"(?<![\w:\\])\\([A-Za-z]+)\*?(?:\[[^\[\]\n]*\])?\{")
_BARE = re.compile(r"(?<![\w:\\/])\\([A-Za-z]{2,})\b(?![\\/{])")
_SECTION = re.compile(r"\\((?:sub)*section|chapter|part|(?:sub)?paragraph)\*?\{([^{}]*)\}")
_BRACE = re.compile(r"~?\\([A-Za-z]+)\*?(?:\[[^\[\]\n]*\])?\{|[{}]")
_SILENT = {"cite", "citep", "citet", "ref", "eqref", "label", "includegraphics", "usepackage", "documentclass", "pageref", "input", "bibliography"}


class Folded(str):
    """A folded text with what each of its characters stands for; parts of it keep that."""

    origin: list[str]

    def __new__(cls, text: str, origin: list[str]):
        self = super().__new__(cls, text)
        self.origin = origin
        return self

    def __getitem__(self, key):
        part = str.__getitem__(self, key)
        return Folded(part, self.origin[key]) if isinstance(key, slice) else part

    def __add__(self, other):
        return join("", [self, other])

    def __radd__(self, other):
        return join("", [other, self])

    def _stripped(self, left: int, right: int):
        return self[left : max(left, right)]

    def strip(self, chars=None):
        return self._stripped(len(self) - len(str.lstrip(self, chars)), len(str.rstrip(self, chars)))

    def lstrip(self, chars=None):
        return self._stripped(len(self) - len(str.lstrip(self, chars)), len(self))

    def rstrip(self, chars=None):
        return self._stripped(0, len(str.rstrip(self, chars)))

    def split(self, sep):
        parts, at = [], 0
        for part in str.split(self, sep):
            parts.append(self[at : at + len(part)])
            at += len(part) + len(sep)
        return parts

    def rpartition(self, sep):
        at = self.rfind(sep)
        return (self[:at], sep, self[at + len(sep) :]) if at >= 0 else ("", "", self)


def join(sep: str, parts) -> str:
    parts = list(parts)
    text = sep.join(parts)
    if not any(isinstance(x, Folded) for x in parts):
        return text
    origin: list[str] = []
    for i, x in enumerate(parts):
        origin.extend(sep if i else "")
        origin.extend(x.origin if isinstance(x, Folded) else x)
    return Folded(text, origin)


class _Match:
    """A match whose groups keep what they stand for."""

    def __init__(self, m: re.Match, text: Folded):
        self.m, self.text = m, text

    def __getitem__(self, group):
        start, end = self.m.span(group)
        return None if start < 0 else self.text[start:end]


def sub(pattern: re.Pattern, make, text: str) -> str:
    """``pattern.sub(make, text)`` that keeps what the characters of a folded text stand for."""
    if not isinstance(text, Folded):
        return pattern.sub(make, text)
    parts, at = [], 0
    for m in pattern.finditer(text):
        parts += [text[at : m.start()], make(_Match(m, text))]
        at = m.end()
    return join("", [*parts, text[at:]]) if parts else text


_FOLD: dict[int, str] = {}


def fold(text: str) -> str:
    """``text`` with width forms, blanks and invisible characters folded; letters that only look alike stay.

    An invisible character goes with the one before it, or with the one after it where
    the one before may be a sign of markup.
    """
    if text.isascii():
        return text
    if not _FOLD:
        _FOLD.update({cp: "".join(map(chr, to)) for cp, to in mapping().items() if len(to) < 2})
    folded = text.translate(_FOLD)
    if folded == text:
        return text
    origin: list[str] = []
    signs, waiting = [], ""
    for ch in text:
        to = _FOLD.get(ord(ch), ch)
        if to:
            signs.append(to)
            if waiting and to == "\n" and origin and signs[-2] != "\n":
                origin[-1] += waiting
                waiting = ""
            origin.append(waiting + ch)
            waiting = ""
        elif waiting or not signs or (signs[-1].isascii() and not signs[-1].isalnum()):
            waiting += ch
        else:
            origin[-1] += ch
    if waiting and origin:
        origin[-1] += waiting
    return Folded(folded, origin)


def unfold(text: str) -> str:
    return "".join(text.origin) if isinstance(text, Folded) else text


def _unescape(text: str) -> str:
    return sub(_ANY_REFERENCE, lambda m: html.unescape(m[0]), text)


def _set_aside_code(text: str) -> tuple[str, list[str], set[str]]:
    """Replace code blocks by marked lines; also drops comments, scripts and styles."""
    kinds: set[str] = set()
    kept: list[str] = []
    out, at = [], 0

    def closing(pattern: str, start: int):
        return re.compile(pattern, _BOTH).search(text, start)

    missing: set[str] = set()
    while m := _CODE.search(text, at):
        if m["fence"]:
            key = rf"^[ ]{{0,3}}{re.escape(m['mark'][0])}{{{len(m['mark'])},}}[ \t]*$"
            kind = "markdown"
        elif m["pre"]:
            key, kind = rf"</{m['el']}\s*>", "html"
        elif m["verb"]:
            key, kind = r"\\end\{" + re.escape(m["env"]) + r"\}", "latex"
        elif m["wiki"]:
            key, kind = rf"</{m['wel']}\s*>", "wiki"
        else:
            key, kind = "-->", "html"
        end = None if key in missing else closing(key, m.end())
        if end is None:
            missing.add(key)
            if not m["fence"]:  # an opener without its end is no block
                out.append(text[at : m.end()])
                at = m.end()
                continue
        kinds.add(kind)
        body = text[m.end() : end.start() if end else len(text)]
        out.append(text[at : m.start()])
        inline = bool(m["el"]) and m["el"].lower() == "code" and "\n" not in body
        if m["rem"] or (m["el"] or "").lower() in ("script", "style"):
            out.append(" ")
        elif inline:
            out.append(_unescape(sub(_INNER_TAG, lambda m: "", body)))
        else:
            if m["pre"]:
                body = _unescape(sub(_CODE_TAG, lambda m: "", body))
            kept.append("```\n" + body.strip("\n") + "\n```")
            out.append(f"\n\x01{len(kept) - 1}\x01\n")
        at = end.end() if end else len(text)
    out.append(text[at:])
    return join("", out), kept, kinds


def _environments(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(start, start and end of the body, end) of the formula environments, each up to the first end of its name."""
    marks = list(_MATH_MARK.finditer(text))
    ends: dict[str, deque] = {}
    for m in marks:
        if m[1] == "end":
            ends.setdefault(m[2], deque()).append(m)
    at = 0
    for m in marks:
        own = ends.get(m[2])
        if m[1] == "end" or not own or m.start() < at:
            continue
        while own and own[0].start() < m.end():
            own.popleft()
        if own:
            yield m.start(), m.end(), own[0].start(), own[0].end()
            at = own[0].end()


def _set_aside_math(text: str, kept: list[str], kinds: set[str]) -> str:
    def keep(formula: str, block: bool) -> str:
        kinds.add("latex")
        sign = "$$" if block else "$"
        kept.append(sign + formula.strip() + sign)
        return f"\n\x01{len(kept) - 1}\x01\n" if block else f"\x02{len(kept) - 1}\x02"

    def formula(m: re.Match) -> str:
        for group, block in ((1, True), (2, True), (3, False)):
            if m[group] is not None:
                return keep(m[group], block)
        return keep(m[4], False) if _MATHEMATICAL.search(m[4]) else m[0]

    if r"\begin{" in text:
        parts, at = [], 0
        for start, first, last, end in _environments(text):
            parts += [text[at:start], keep(text[first:last], True)]
            at = end
        text = join("", [*parts, text[at:]]) if parts else text
    return sub(_MATH, formula, text) if "$" in text or "\\" in text else text


def _html(text: str, kinds: set[str], marked: bool = False) -> str:
    if not ("<" in text or "&" in text):
        return text

    def tag(m: re.Match) -> str:
        kinds.add("html")
        name = re.match(r"</?!?([a-z0-9]+)", m[0], re.I)[1].lower()
        ends = m[0][1] == "/"
        if marked and name == "a":
            return LINKED if ends else LINK
        if marked and name in _SIDES:
            return "\n" + SIDED if ends else "\n" + SIDE
        if re.fullmatch(r"h[1-6]", name):
            return "\n" if ends else "\n" + HEAD * int(name[1]) + " "
        if name == "li":
            return "" if ends else f"\n{ITEM} "
        if name in ("td", "th"):
            return "" if ends else f" |{CELL} "
        if name in ("br", "p", "div", "tr", "table", "ul", "ol", "section", "article", "blockquote", "hr", "header", "main", *_SIDES, "dl", "dt", "dd", "pre"):
            return "\n"
        return ""

    def reference(m: re.Match) -> str:
        if m[1] and m[1] + ";" not in html5:
            return m[0]
        kinds.add("html")
        return m[0]  # read at the end, so that no sign it stands for is taken for markup

    return sub(_REFERENCE, reference, sub(_TAG, tag, text))


def _wiki(text: str, kinds: set[str]) -> str:
    def mark(make):
        def replace(m: re.Match) -> str:
            kinds.add("wiki")
            return make(m)

        return replace

    def rows(m: re.Match) -> str:
        lines = []
        for line in m[0].split("\n")[1:]:
            line = line.strip()
            if line[:2] in ("|}", "|-", "|+"):
                continue
            row = sub(_CELL_END, lambda m: " | ", line.lstrip("!|").strip())
            lines.append(row + CELL if row else row)
        return join("\n", lines)

    def link(m: re.Match) -> str:
        if re.match(r"\s*category\s*:", m[1], re.I):
            return ""
        if re.match(r"\s*(?:file|image)\s*:", m[1], re.I):
            return (m[2] or "").rpartition("|")[2]
        return m[2] or m[1].strip()

    if "{|" in text:
        text = sub(_BRACE_TABLE, mark(rows), text)
    if "{{" in text:
        text = sub(_TEMPLATE, mark(lambda m: ""), text)
    if "[" in text:
        text = sub(_OUTER_LINK, mark(lambda m: m[2] or ""), sub(_WIKI_LINK, mark(link), text))
    if "=" in text:
        text = sub(_WIKI_HEAD, mark(lambda m: HEAD * len(m[1]) + " " + m[2].strip()) if "==" in text else (lambda m: m[0]), text)
    return sub(_WIKI_QUOTE, mark(lambda m: m[2]), text) if "''" in text else text


def _arguments(text: str) -> str:
    """``text`` with every command and its argument replaced by the argument, to any depth; a silent one by nothing.

    A command whose argument holds a brace of its own is left as it is.
    """
    out: list[str] = []
    opened: list[list] = []  # command or None, where its opener is in ``out``, whether its argument is free of braces
    at = 0
    for m in _BRACE.finditer(text):
        out += [text[at : m.start()], text[m.start() : m.end()]]
        at = m.end()
        if m[0] != "}":
            opened.append([m[1], len(out) - 1, True])
        elif opened:
            command, start, free = opened.pop()
            if command and free:
                out[start] = out[-1] = ""
                if command in _SILENT:
                    del out[start:]
            elif opened:
                opened[-1][2] = False
    return join("", [*out, text[at:]])


def _latex(text: str, kinds: set[str]) -> str:
    if "\\" not in text:
        return text
    if _ENV.search(text) or _COMMAND.search(text) or _BARE.search(text):
        kinds.add("latex")
    else:
        return text
    text = sub(_SECTION, lambda m: "\n" + HEAD * (1 + m[1].count("sub")) + " " + m[2].strip() + "\n", text)
    text = sub(_ENV, lambda m: "\n", text)
    before = ""
    while text != before:  # again only where an optional argument held a command
        before, text = text, _arguments(text)
    text = sub(_ITEM_COMMAND, lambda m: ITEM + " ", text)
    return sub(_ESCAPED, lambda m: m[1], sub(_BARE, lambda m: "", text))


def _table_rows(text: str, kinds: set[str]) -> str:
    lines = text.split("\n")
    out: list[str] = []
    inside = False
    for i, line in enumerate(lines):
        if "|" in line and "-" in line and i and "|" in lines[i - 1] and _DELIMITER.match(line):
            kinds.add("markdown")
            inside = True
            out[-1] = join(" | ", (x.strip() for x in out[-1].strip().strip("|").split("|"))) + CELL
        elif inside and "|" in line:
            out.append(join(" | ", (x.strip() for x in line.strip().strip("|").split("|"))) + CELL)
        else:
            inside = False
            out.append(line)
    return join("\n", out)


def _underlined(text: str, kinds: set[str]) -> str:
    out: list[str] = []
    for line in text.split("\n"):
        rule = _UNDERLINE.fullmatch(line)
        if rule and out and out[-1].strip() and "|" not in out[-1] and not _UNDERLINE.fullmatch(out[-1]) and not out[-1].startswith("\x01"):
            kinds.add("markdown")
            out[-1] = ("# " if rule[1][0] == "=" else "## ") + out[-1].strip()
        else:
            out.append(line)
    return join("\n", out)


def _markdown(text: str, kinds: set[str]) -> str:
    def mark(make):
        def replace(m: re.Match) -> str:
            kinds.add("markdown")
            return make(m)

        return replace

    if "`" in text:
        text = sub(_SPAN, mark(lambda m: m[2]), text)
    text = sub(_ATX, mark(lambda m: str(m[1]) + " " + m[2]), text) if "#" in text else text
    text = _table_rows(text, kinds) if "|" in text else text
    text = _underlined(text, kinds) if "===" in text or "---" in text else text
    text = sub(_LIST, mark(lambda m: str(m[1]) + ("- " if m[2] in "-*+" else str(m[2]) + " ")), text)
    text = sub(_QUOTE, mark(lambda m: ""), text) if ">" in text else text
    if "[" in text:
        text = sub(_NOTE, mark(lambda m: ""), sub(_NOTE_TEXT, mark(lambda m: ""), text))
        text = sub(_LINK, mark(lambda m: m[1]), sub(_IMAGE, mark(lambda m: m[1]), text))
        text = sub(_REFLINK, mark(lambda m: m[1]), sub(_DEFINITION, mark(lambda m: ""), text))
    if "<" in text:
        text = sub(_AUTOLINK, mark(lambda m: m[1]), text)
    text = sub(_STRIKE, mark(lambda m: m[1]), text) if "~~" in text else text
    text = sub(_STAR, mark(lambda m: m[2]), text) if "*" in text else text
    return sub(_LINE, mark(lambda m: m[2]), text) if "_" in text else text


def _content(line: str, given: set[str]) -> int:
    """Number of characters of content in a stripped line; 0 for residue. ``given`` are lines of signs that are text."""
    if length := sum(map(str.isalnum, line)):
        return length
    own = line.strip()
    if CELL in own:  # a row has content where any of its cells has
        own = own.replace("|", "").replace(CELL, "").strip()
    elif _SIGNS.fullmatch(own) and own not in given and not _ITEM_OF_SIGNS.fullmatch(own):
        return 0
    return len(own)


def line_blocks(lines: list[str], window: int = WINDOW, given: set[str] = frozenset()) -> list[str]:
    """The lines with content, and the blank ones up to where the text length over ``window`` lines dives to nothing."""
    length = [_content(line, given) for line in lines]
    total = [sum(length[i : i + window]) for i in range(len(lines))]
    kept, inside = [], False
    for i, line in enumerate(lines):
        if not inside and length[i]:
            inside = True
        elif inside and total[i] == 0:
            inside = False
            kept.append("")
        if inside and (length[i] or not line.strip()):
            kept.append(line)
    return kept


def _own_lines(lines: list[str], window: int = WINDOW) -> list[str]:
    """The lines without marks of links and sides, and without furniture before the first and after the last text that is in neither.

    Furniture is what stands in a side, and a window of lines that are links only.
    """
    inside, outside, linked, sided = [], [], 0, 0
    for line in lines:
        own, in_side = 0, sided > 0
        for ch in line:
            if ch in (LINK, LINKED):
                linked = max(0, linked + (1 if ch == LINK else -1))
            elif ch in (SIDE, SIDED):
                sided = max(0, sided + (1 if ch == SIDE else -1))
                in_side = in_side or sided > 0
            elif not linked and not sided and ch.isalnum():
                own += 1
        outside.append(own)
        inside.append(in_side)
    plain = [sub(_ASIDE, lambda m: "", x) for x in lines]
    texts = [i for i, n in enumerate(outside) if n]
    if not texts:
        return plain
    full = [any(map(str.isalnum, x)) for x in plain]
    run, drop = [], set()
    for i in [*range(len(lines)), len(lines)]:
        if i < len(lines) and (i < texts[0] or i > texts[-1]) and not outside[i]:
            if inside[i]:
                drop.add(i)
            elif full[i]:
                run.append(i)
        elif run:
            drop.update(run if len(run) >= window else ())
            run = []
    return [x for i, x in enumerate(plain) if i not in drop]


def analyse(content: str | None) -> tuple[list[str], str | None]:
    """The kinds of markup in ``content`` and its clean text."""
    if not content:
        return [], content
    folded = fold(content.replace("\r\n", "\n").replace("\r", "\n").translate(_MARKS))
    kinds, clean = _analyse(folded, False)
    if "html" in kinds and _FURNISHED.search(folded):  # once more with marks, which may stand in the way of other signs
        clean = _analyse(folded, True)[1]
    return [k for k in KINDS if k in kinds], unfold(clean)


_MARKS = dict.fromkeys([*range(1, 8), 14, 15])


def _analyse(folded: str, marked: bool) -> tuple[set[str], str]:
    kinds: set[str] = set()
    front = _FRONT.match(folded)
    if front and _FRONT_KEY.search(front[0]):
        kinds.add("markdown")
        folded = folded[front.end() :]
    text, kept, own = _set_aside_code(folded)
    kinds |= own
    text = _set_aside_math(text, kept, kinds)
    text = _markdown(_latex(_wiki(_html(text, kinds, marked), kinds), kinds), kinds)
    text = sub(_REFERENCE, lambda m: html.unescape(m[0]), text) if "html" in kinds else text
    text = sub(_MADE, lambda m: "#" if m[0] == HEAD else "-", text)
    text = sub(_INLINE, lambda m: kept[int(m[1])], text)
    lines = _own_lines(text.split("\n")) if marked else text.split("\n")
    lines = [sub(_BLANKS, lambda m: m[0] if m[0] == " " else " ", x).rstrip() if not x[:1].isspace() else x.rstrip() for x in lines]
    given: set[str] = set()
    if any(map(_SIGNS.fullmatch, lines)):
        own = {x for x in map(str.strip, str(folded).split("\n")) if _SIGNS.fullmatch(x) and not _TOKEN.fullmatch(x)}
        given = {x for x in own if not ("latex" in kinds and _BRACKETS.fullmatch(x))}  # closers of commands
    marks = [sub(_BLOCK, lambda m: "\x01" + m[1] + "\x01block", x) for x in lines]
    clean = sub(_GAP, lambda m: "\n\n", join("\n", line_blocks(marks, given=given))).strip()
    clean = sub(_CELL, lambda m: "", clean)
    return kinds, sub(_BLOCK_LINE, lambda m: kept[int(m[1])], clean)


def clean_markup(documents: DataFrame, key: list[str], content: str = "content") -> DataFrame:
    """(key, kinds array<string>, clean_text) for each row of ``documents``.

    Null content has no kinds and a null text; empty content an empty one.
    Rows are independent: repeated rows give repeated rows. Texts of any length
    are read whole; every pattern runs in time proportional to the text.
    """

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [analyse(t) for t in b.pop("_content")]
            b["kinds"] = [k for k, _ in found]
            b["clean_text"] = [t for _, t in found]
            yield b

    rows = documents.select(*key, F.col(content).alias("_content"))
    schema = ", ".join(f"`{c}` {t}" for c, t in documents.select(*key).dtypes) + ", kinds array<string>, clean_text string"
    return spread(rows).mapInPandas(strip, schema)
