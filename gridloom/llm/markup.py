"""Markup residue: HTML, Markdown, wiki and LaTeX texts to typed blocks of clean text.

A text is cut into flat blocks.  Each block carries shallow features: its word
count and link density, those of its neighbours, and which block marker the
markup gave it.  A decision tree trained on the small labelled table below
decides what a block is: ``heading``, ``list_item``, ``code``, ``formula``,
``value`` (a line of a data box), ``paragraph`` or ``drop`` (tables, captions,
category lines, navigation made of links).  A line that opens with ``#`` and
stands alone in a text whose markup nothing else tells may be a heading or an
item of a numbered list; its length and its neighbours decide.

Defined results: null, empty and blank texts give no blocks; a text without
any markup is one paragraph per blank-line block; unclosed constructs end at
the end of the text.  Whole texts are read, never prefixes.  Further columns
are ignored; repeated rows give repeated blocks unless ``distinct`` is set.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.wikivalue import ITEM, collapse, expand_template, has_markup, strip_inline, visible_lines
from gridloom.llm import dtree

MARKS = ("text", "head", "item", "verb", "math", "table", "media", "meta", "quote", "hash", "run", "box")
FEATURES = ("words", "links", "prev_words", "prev_links", "next_words", "next_links", *MARKS)

#: Labelled blocks: mark, words, link density, words and density before, words and density after, class.
TRAINING = """
text 42 0.00 0 0.00 38 0.00 paragraph
text 38 0.10 42 0.00 3 0.00 paragraph
text 7 0.00 3 0.00 0 0.00 paragraph
text 3 0.00 40 0.00 30 0.00 paragraph
text 1 0.00 40 0.00 30 0.00 paragraph
text 55 0.35 2 0.00 12 0.00 paragraph
text 12 0.60 20 0.10 18 0.00 paragraph
text 2 1.00 30 0.00 24 0.00 paragraph
text 4 1.00 25 0.05 6 0.00 paragraph
text 3 1.00 2 1.00 2 1.00 drop
text 2 1.00 3 1.00 4 1.00 drop
text 1 1.00 2 1.00 1 1.00 drop
text 0 0.00 10 0.00 10 0.00 drop
text 0 0.00 0 0.00 20 0.00 drop
head 2 0.00 40 0.00 33 0.00 heading
head 3 1.00 28 0.00 40 0.00 heading
head 3 1.00 2 1.00 2 1.00 heading
head 6 0.50 5 0.00 0 0.00 heading
head 1 0.00 0 0.00 0 0.00 heading
head 5 0.00 3 0.00 2 0.00 heading
head 0 0.00 40 0.00 33 0.00 drop
item 6 0.00 40 0.00 5 0.00 list_item
item 5 1.00 6 0.00 4 1.00 list_item
item 2 1.00 3 1.00 2 1.00 list_item
item 1 0.00 6 0.00 40 0.00 list_item
item 7 0.30 0 0.00 0 0.00 list_item
item 25 0.00 20 0.00 30 0.00 list_item
item 0 0.00 6 0.00 40 0.00 drop
verb 8 0.00 30 0.00 30 0.00 code
verb 2 0.00 3 0.00 44 0.00 code
verb 30 0.00 0 0.00 0 0.00 code
verb 1 0.00 2 1.00 2 1.00 code
verb 0 0.00 30 0.00 30 0.00 drop
math 4 0.00 30 0.00 30 0.00 formula
math 9 0.00 3 0.00 0 0.00 formula
math 1 0.00 2 1.00 2 1.00 formula
math 0 0.00 30 0.00 30 0.00 drop
table 12 0.20 30 0.00 30 0.00 drop
table 3 0.00 30 0.00 2 0.00 drop
table 40 1.00 2 0.00 0 0.00 drop
media 4 0.30 30 0.00 30 0.00 drop
media 1 0.00 3 0.00 3 0.00 drop
media 14 0.00 0 0.00 40 0.00 drop
meta 2 1.00 30 0.00 2 1.00 drop
meta 20 0.10 0 0.00 40 0.00 drop
meta 4 0.00 3 0.00 0 0.00 drop
quote 4 0.00 30 0.00 30 0.00 paragraph
quote 20 0.10 3 0.00 3 0.00 paragraph
quote 0 0.00 30 0.00 30 0.00 drop
hash 3 0.00 42 0.00 38 0.00 heading
hash 2 0.00 0 0.00 55 0.00 heading
hash 4 0.00 24 0.10 20 0.00 heading
hash 5 0.50 60 0.00 30 0.10 heading
hash 6 0.00 30 0.00 0 0.00 heading
hash 3 1.00 28 0.00 40 0.00 heading
hash 3 1.00 4 1.00 3 1.00 list_item
hash 2 1.00 3 1.00 0 0.00 list_item
hash 25 0.00 40 0.00 38 0.00 list_item
hash 19 0.10 18 0.00 22 0.00 list_item
hash 0 0.00 30 0.00 30 0.00 drop
run 3 0.00 40 0.00 4 0.00 list_item
run 4 0.00 6 0.00 30 0.00 list_item
run 5 0.20 3 0.00 4 0.00 list_item
run 25 0.00 9 0.00 38 0.00 list_item
run 0 0.00 30 0.00 30 0.00 drop
box 1 0.00 0 0.00 0 0.00 value
box 3 1.00 0 0.00 4 1.00 value
box 4 0.50 3 1.00 2 0.00 value
box 2 1.00 2 1.00 2 1.00 value
box 9 0.00 6 0.00 1 0.00 value
box 0 0.00 3 0.00 3 0.00 drop
box 0 0.00 0 0.00 0 0.00 drop
"""


def features(mark: str, now: tuple[int, float], before: tuple[int, float], after: tuple[int, float]) -> list[float]:
    return [*now, *before, *after, *(float(mark == m) for m in MARKS)]


@lru_cache(1)
def tree():
    """The block classifier, fitted on ``TRAINING`` once per process."""
    rows, labels = [], []
    for line in TRAINING.strip().splitlines():
        mark, *numbers, label = line.split()
        w, d, pw, pd_, nw, nd = map(float, numbers)
        rows.append(features(mark, (w, d), (pw, pd_), (nw, nd)))
        labels.append(label)
    return dtree.fit(rows, labels)


# A raw block is (mark, content, linked words).
Raw = tuple[str, str, int]

_SPACED = re.compile(r"[^\S\n]+")


def _nwords(text: str) -> int:
    return len(text.split())


# --- which markup -------------------------------------------------------------------------------------------------

#: signs of each markup: what a text must hold for the pattern to be tried, and the pattern
_SIGNS = {
    "latex": (
        ("\\", r"\\documentclass|\\begin\{\w+\*?\}|\\(?:sub)*section\*?\{|\\(?:emph|textbf|textit|underline|textsc|cite|href|item)\b|\{\\(?:bf|it|em|sc)\b"),
    ),
    "html": (
        ("<", r"(?i:<(?:p|html|body|head|div|article|main|section)\b[^<>]*>)"),
    ),
    "wiki": (
        ("[[", r"\[\[[^\[\]\n]+\]\]"),
        ("{{", r"\{\{[^{}\n]*(?:\||\}\})|(?i:\{\{infobox)"),
        ("{|", r"^\{\|"),
        ("<", r"(?i:<ref\b|<nowiki>|<math\b|<source\b|<syntaxhighlight\b)"),
        ("''", r"'''?[^'\n]+'''?"),
        ("://", r"(?i:\[https?://)\S+ [^\]\n]+\]"),
        ("==", r"^={2,6}[^=\n].*={2,6}\s*(?:<!--.*)?$"),
        ("__", r"__[A-Z]{3,}__"),
    ),
    "markdown": (
        ("](", r"\]\([^()\s]+(?: \"[^\"]*\")?\)"),
        ("**", r"\*\*[^*\s][^*\n]*\*\*"),
        ("__", r"(?<!\w)__[^_\s][^_\n]*__"),
        ("~~", r"~~[^~\n]+~~"),
        ("```", r"^```"),
        ("~~~", r"^~~~"),
        ("\n===", r"(?<=\S)[^\S\n]*\n={3,}\s*$"),
        ("\n---", r"(?<=\S)[^\S\n]*\n-{3,}\s*$"),
        ("|", r"^\|[-:| ]+\|\s*$"),
        ("*", r"(?<![\w*])\*[^\s*][^*\n]*\*(?![\w*])"),
        ("", r"^\s{0,3}(?:[-+]|\d{1,3}[.)]) \S"),
        ("$$", r"^\$\$"),
        ("\\", r"^\\[#*]"),
    ),
}
#: line starts that mean a list in wiki markup and a heading or list in Markdown; they decide only where nothing else does
_EITHER = re.compile(r"^#{1,6} ?\S|^\s{0,3}\*+ ?\S", re.M)
_INFOBOX = re.compile(r"\{\{\s*infobox", re.I)


@lru_cache(4096)
def _pattern(kind: str, held: tuple[bool, ...]) -> re.Pattern | None:
    """The signs of a markup that a text which holds these strings can show."""
    parts = [p for (_, p), yes in zip(_SIGNS[kind], held) if yes]
    return re.compile("|".join(parts), re.M) if parts else None


def _signs(kind: str, text: str) -> list[str]:
    pattern = _pattern(kind, tuple(sign in text for sign, _ in _SIGNS[kind]))
    return [m[0] for m in pattern.finditer(text)] if pattern else []


def dialect(text: str) -> str:
    """latex, html, wiki, markdown, either (list and heading signs that wiki and Markdown share, and nothing else) or plain."""
    box = bool(_INFOBOX.search(text))
    body = _drop_templates(text) if box else text
    found = {k: _signs(k, body) for k in _SIGNS}
    n = {k: len(x) for k, x in found.items()}
    if n["html"] and not box and n["html"] >= n["wiki"]:
        return "html"
    if n["latex"] and n["latex"] >= max(n["wiki"], n["markdown"]):
        return "latex"
    if box and n["wiki"] == 0 and n["markdown"] and not re.search(r"^\*\*?\s*\S|^#\s*\S", body, re.M):
        return "markdown"
    if n["wiki"] and n["wiki"] >= 0.5 * n["markdown"]:
        bare = re.fullmatch(r"\{\{\s*\w+\s*\}\}", found["wiki"][0])
        return "plain" if bare and n["wiki"] == 1 and not n["markdown"] else "wiki"
    if box:
        return "wiki"
    if n["markdown"]:
        return "markdown"
    if _EITHER.search(body):
        return "either"
    return "html" if re.search(r"</[a-z][a-z0-9]*>", text, re.I) else "plain"


# --- wiki ---------------------------------------------------------------------------------------------------------

_WIKI_SPECIAL = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<code>source|syntaxhighlight|pre)\b[^<>]*>(?P<body>.*?)(?:</(?P=code)\s*>|\Z)"
    r"|<math\b(?P<attr>[^<>]*)>(?P<math>.*?)(?:</math\s*>|\Z)|<nowiki\s*>(?P<plain>.*?)(?:</nowiki\s*>|\Z)"
    r"|<ref\b[^<>]*/\s*>|<ref\b[^<>]*>.*?(?:</ref\s*>|\Z)|<(?P<gone>script|style|gallery|timeline)\b[^<>]*>.*?(?:</(?P=gone)\s*>|\Z)",
    re.S | re.I,
)
_HOLD = re.compile("\x04(\\d+)\x05")
_WIKI_HEAD = re.compile(r"^(={1,6})(.+?)\1\s*$")
_WIKI_LIST = re.compile(r"^([*#:;]+)\s*(.*)$")
_CATEGORY = re.compile(r"^\s*\[\[\s*(?:category|kategorie)\s*:[^\[\]]*\]\]\s*$", re.I)
_MEDIA = re.compile(r"\[\[\s*(?:file|image|datei|bild)\s*:", re.I)
_TAGBLOCK = re.compile(r"<(li|h[1-6])\b[^<>]*>(.*?)(?:</\1\s*>|(?=<li\b)|\Z)", re.S | re.I)
_HIDE = re.compile(r"<(\w+)\b[^<>]*display\s*:\s*none[^<>]*>.*?</\1\s*>", re.S | re.I)
_LINKED = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]|\[https?://\S+ ([^\]\n]*)\]")
_INNER = re.compile(r"\{\{([^{}]*)\}\}")


def _balanced(text: str, at: int, opening: str, closing: str) -> int:
    """End of the construct opened at ``at``, or -1."""
    depth, scan = 0, re.compile(re.escape(opening) + "|" + re.escape(closing))
    for m in scan.finditer(text, at):
        depth += 1 if m[0] == opening else -1
        if depth == 0:
            return m.end()
    return -1


def _drop_templates(text: str) -> str:
    """Without data boxes; an unclosed one ends before the next heading."""
    while m := _INFOBOX.search(text):
        end = _balanced(text, m.start(), "{{", "}}")
        if end < 0:
            stop = re.compile(r"\n={2,}").search(text, m.start())
            end = stop.start() if stop else len(text)
        text = text[: m.start()] + text[end:]
    return text


def _drop_media(text: str) -> str:
    while m := _MEDIA.search(text):
        end = _balanced(text, m.start(), "[[", "]]")
        text = text[: m.start()] + text[end if end > 0 else m.start() + 2 :]
    return text


def _wiki_inline(text: str, held: list[tuple[str, str]]) -> str:
    text = strip_inline(text).replace(ITEM, " ")
    return collapse(_HOLD.sub(lambda m: held[int(m[1])][1], text))


def _wiki(text: str) -> Iterator[Raw]:
    held: list[tuple[str, str]] = []

    def hold(m: re.Match) -> str:
        if m["code"]:
            held.append(("verb", html.unescape(m["body"]) if m["code"].lower() == "pre" else m["body"]))
            return f"\n\x04{len(held) - 1}\x05\n"
        if m["math"] is not None:
            held.append(("math" if "block" in m["attr"] else "mathline", m["math"]))
            return f"\x04{len(held) - 1}\x05"
        if m["plain"] is not None:
            held.append(("plain", m["plain"]))
            return f"\x04{len(held) - 1}\x05"
        return ""

    text = _HIDE.sub("", _WIKI_SPECIAL.sub(hold, text))
    text = _drop_templates(text)
    before = ""
    while text != before and "{{" in text:  # each round resolves the innermost level
        before = text
        text = _INNER.sub(lambda m: expand_template(m[1]).replace(ITEM, "\n* "), text)
    text = _drop_media(text)
    text = _TAGBLOCK.sub(lambda m: f"\n\x06{m[1][0].lower()}{_SPACED.sub(' ', m[2]).replace(chr(10), ' ').strip()}\n", text)
    para: list[str] = []
    depth = 0

    def flush() -> Iterator[Raw]:
        if para:
            raw = " ".join(para)
            para.clear()
            yield "text", _wiki_inline(raw, held), sum(_nwords(a or b) for a, b in _LINKED.findall(raw))

    for line in text.split("\n"):
        s = line.strip()
        if s.startswith("{|"):
            depth += 1
        if depth:
            if s.startswith("|}"):
                depth -= 1
            if s:
                yield "table", "", 0
            continue
        bare = s.lstrip(":").strip()
        if (m := _HOLD.fullmatch(bare)) and held[int(m[1])][0] != "plain":
            yield from flush()
            mark, body = held[int(m[1])]
            yield "verb" if mark == "verb" else "math", body, 0
            continue
        if any(held[int(i)][0] == "math" for i in _HOLD.findall(s)):  # a displayed formula inside a line
            for part in re.split("(\x04\\d+\x05)", s):
                m = _HOLD.fullmatch(part)
                if m and held[int(m[1])][0] == "math":
                    yield from flush()
                    yield "math", held[int(m[1])][1], 0
                elif part.strip():
                    para.append(part)
            continue
        linked = sum(_nwords(a or b) for a, b in _LINKED.findall(s))
        if not s:
            yield from flush()
        elif s[0] == "\x06":
            yield from flush()
            yield "head" if s[1] == "h" else "item", _wiki_inline(s[2:], held), linked
        elif _CATEGORY.match(s):
            yield from flush()
            yield "meta", "", linked
        elif m := _WIKI_HEAD.match(s):
            yield from flush()
            yield "head", _wiki_inline(m[2], held), linked
        elif m := _WIKI_LIST.match(s):
            yield from flush()
            yield "item" if m[1][-1] in "*#" else "text", _wiki_inline(m[2], held), linked
        elif re.fullmatch(r"(?:__[A-Z]+__|-{4,})", s):
            yield from flush()
        else:
            para.append(s)
    yield from flush()


_HASH = re.compile(r"#{1,6}\s*(\S.*?)(?:\s+#+)?\s*$")
_STAR = re.compile(r"\s{0,3}\*+\s*(\S.*)$")


def _either(text: str) -> Iterator[Raw]:
    """Lines that open with ``#``: next to another list line they are a ``run``, else the tree has their length and neighbours."""
    lines = [*text.split("\n"), ""]
    listed = [bool(_HASH.match(x) or _STAR.match(x)) for x in lines]
    para: list[str] = []
    for i, line in enumerate(lines):
        if listed[i] or not line.strip():
            if para:
                yield from _wiki(" ".join(para))
                para = []
        if m := _HASH.match(line):
            yield "run" if (i and listed[i - 1]) or listed[i + 1] else "hash", _wiki_inline(m[1], []), 0
        elif m := _STAR.match(line):
            yield "item", _wiki_inline(m[1], []), 0
        elif line.strip():
            para.append(line.strip())


# --- HTML ---------------------------------------------------------------------------------------------------------

_HTML_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\w[^<>]*>|<(?P<gone>script|style|head|table|figure|figcaption|caption|noscript|template|svg|select|textarea)\b[^<>]*>.*?(?:</(?P=gone)\s*>|\Z)"
    r"|<pre\b[^<>]*>(?P<pre>.*?)(?:</pre\s*>|\Z)|<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9]*)\b(?P<attr>[^<>]*)>",
    re.S | re.I,
)
_BLOCK = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd body html hr br section article main header footer nav aside blockquote center form address sup_".split())
_DISPLAY = re.compile(r"\s*(?:\\\[(.*)\\\]|\$\$(.*)\$\$)\s*", re.S)
_HTML_TAG = re.compile(r"<!--.*?(?:-->|\Z)|</?[A-Za-z][^<>]*>", re.S)


def _html(text: str) -> Iterator[Raw]:
    text = _HIDE.sub("", text)
    buffer: list[str] = []
    mark, linked, in_link, at = "text", 0, False, 0

    def flush() -> Iterator[Raw]:
        nonlocal linked
        raw = html.unescape("".join(buffer))
        buffer.clear()
        if m := _DISPLAY.fullmatch(raw):
            yield "math", m[1] if m[1] is not None else m[2], 0
        elif raw.strip() or mark == "item":
            yield mark, collapse(raw), linked
        linked = 0

    for m in _HTML_TOKEN.finditer(text):
        piece = text[at : m.start()]
        at = m.end()
        buffer.append(piece)
        if in_link:
            linked += _nwords(piece)
        if m["pre"] is not None:
            yield from flush()
            yield "verb", html.unescape(_HTML_TAG.sub("", m["pre"])), 0
        elif m["gone"]:
            yield from flush()
            yield "table" if m["gone"].lower() == "table" else "meta", "", 0
        elif m["tag"]:
            tag = m["tag"].lower()
            if tag == "a":
                in_link = not m["close"]
            elif tag in _BLOCK:
                yield from flush()
                if not m["close"]:
                    mark = "head" if re.fullmatch(r"h[1-6]", tag) else "item" if tag == "li" else "quote" if tag == "blockquote" else mark if tag == "br" else "text"
                else:
                    mark = "text"
    buffer.append(text[at:])
    yield from flush()


# --- Markdown -----------------------------------------------------------------------------------------------------

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^`]*)$")
_ATX = re.compile(r"^ {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r"^ {0,3}(?:=+|-+)[ \t]*$")
_RULE = re.compile(r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
_MD_ITEM = re.compile(r"^(\s*)(?:[-+*]|\d{1,9}[.)])[ \t]+(?:\[[ xX]\][ \t]+)?(\S.*)$")
_MD_TABLE = re.compile(r"^\s*\|.*\|\s*$")
_MD_IMAGE = re.compile(r"!\[[^\[\]]*\](?:\([^()]*\)|\[[^\[\]]*\])")
_MD_LINK = re.compile(r"\[([^\[\]]*)\]\([^()\s]*(?:\s+(?:\"[^\"]*\"|'[^']*'))?\)|\[([^\[\]]+)\]\[[^\[\]]*\]")
_MD_AUTO = re.compile(r"<((?:https?|mailto):[^<>\s]+)>")
_MD_CODE = re.compile(r"(`+)(.+?)\1")
_MD_EMPH = re.compile(r"(?<!\\)(\*{1,3}|~~)(?=\S)(.+?)(?<=\S)(?<!\\)\1")
_MD_UNDER = re.compile(r"(?<![\w\\])(_{1,3})(?=\S)(.+?)(?<=\S)(?<!\\)\1(?!\w)")
_MD_ESC = re.compile(r"\\([!-/:-@\[-`{-~])")


def _md_inline(text: str) -> str:
    codes: list[str] = []

    def keep(m: re.Match) -> str:
        codes.append(m[2].strip())
        return f"\x04{len(codes) - 1}\x05"

    text = _MD_CODE.sub(keep, _MD_IMAGE.sub("", text))
    while (new := _MD_LINK.sub(lambda m: m[1] if m[1] is not None else m[2], text)) != text:
        text = new
    text = _MD_AUTO.sub(lambda m: m[1], text)
    text = re.sub(r"<!--.*?-->|</?[A-Za-z][^<>]*>", "", text)
    while (new := _MD_UNDER.sub(lambda m: m[2], _MD_EMPH.sub(lambda m: m[2], text))) != text:
        text = new
    text = html.unescape(_MD_ESC.sub(lambda m: m[1], text))
    return collapse(_HOLD.sub(lambda m: codes[int(m[1])], text))


def _markdown(text: str) -> Iterator[Raw]:
    lines = re.sub(r"<!--.*?(?:-->|\Z)", "", text, flags=re.S).split("\n")
    para: list[str] = []
    i, in_list = 0, False

    def raw(mark: str, s: str) -> Raw:
        return mark, _md_inline(s), sum(_nwords(a or b) for a, b in _MD_LINK.findall(s))

    def flush() -> Iterator[Raw]:
        if para:
            s = " ".join(para)
            para.clear()
            yield raw("text", s)

    while i < len(lines):
        line = lines[i].rstrip("\r")
        s = line.strip()
        i += 1
        if m := _FENCE.match(line):
            yield from flush()
            body = []
            while i < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$", lines[i]):
                body.append(lines[i])
                i += 1
            i += 1
            yield "verb", "\n".join(body), 0
        elif s.startswith("$$"):
            yield from flush()
            if len(s) > 4 and s.endswith("$$"):
                yield "math", s[2:-2], 0
            else:
                body = [s[2:]]
                while i < len(lines) and "$$" not in lines[i]:
                    body.append(lines[i])
                    i += 1
                if i < len(lines):
                    body.append(lines[i].split("$$")[0])
                    i += 1
                yield "math", "\n".join(body), 0
        elif not s:
            yield from flush()
        elif m := _ATX.match(line):
            yield from flush()
            in_list = False
            yield raw("head", m[1] or "")
        elif para and _SETEXT.match(line):
            head = " ".join(para)
            para.clear()
            yield raw("head", head)
        elif _RULE.match(line):
            yield from flush()
        elif (m := _MD_ITEM.match(line)) and (len(m[1].expandtabs(4)) < 4 or in_list):
            yield from flush()
            in_list, body = True, [m[2]]
            while i < len(lines) and lines[i].strip() and re.match(r"\s{2,}", lines[i]) and not _MD_ITEM.match(lines[i]) and not _FENCE.match(lines[i]):
                body.append(lines[i].strip())
                i += 1
            yield raw("item", " ".join(body))
        elif not para and re.match(r" {4}|\t", line) and not in_list:
            body = [line[4:] if line[0] == " " else line[1:]]
            while i < len(lines) and (re.match(r" {4}|\t", lines[i]) or not lines[i].strip()):
                body.append(lines[i][4:])
                i += 1
            yield "verb", "\n".join(body).rstrip(), 0
        elif _MD_TABLE.match(line):
            yield from flush()
            yield "table", "", 0
        elif s.startswith(">"):
            yield from flush()
            yield raw("quote", s.lstrip("> "))
        elif _MD_IMAGE.fullmatch(s):
            yield from flush()
            yield "media", "", 0
        else:
            if not para:
                in_list = False
            para.append(s)
    yield from flush()


# --- LaTeX --------------------------------------------------------------------------------------------------------

_TEX_SPECIAL = re.compile(
    r"\\begin\{(?P<env>verbatim\*?|lstlisting|minted|Verbatim|alltt)\}(?:\[[^\]]*\]|\{[^{}]*\})*(?P<code>.*?)(?:\\end\{(?P=env)\}|\Z)"
    r"|\\begin\{(?P<menv>equation\*?|align\*?|gather\*?|displaymath|multline\*?|eqnarray\*?)\}(?P<m1>.*?)(?:\\end\{(?P=menv)\}|\Z)"
    r"|(?<!\\)\\\[(?P<m2>.*?)(?:\\\]|\Z)|\$\$(?P<m3>.*?)(?:\$\$|\Z)"
    r"|\\begin\{(?P<gone>tabular[x*]?|table\*?|figure\*?|thebibliography|comment|tikzpicture)\}.*?(?:\\end\{(?P=gone)\}|\Z)"
    r"|(?<!\\)%[^\n]*\n?",
    re.S,
)
_TEX_SECTION = re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?\s*(?:\[[^\]]*\])?\s*(?=\{)")
_TEX_GONE = re.compile(r"\\(?:cite[tp]?|citep|citet|label|ref|eqref|pageref|footnote|caption|includegraphics|vspace|hspace|index|bibliography|bibliographystyle|usepackage|documentclass|pagestyle|thispagestyle|input|include|nocite)\*?\s*(?:\[[^\]]*\]\s*)*(?=\{)")
_TEX_CHARS = {"~": " ", "``": "“", "''": "”", "---": "—", "--": "–"}


def _group(text: str, at: int) -> tuple[str, int]:
    """Content and end of the brace group opening at ``at``."""
    depth = 0
    i = at
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return text[at + 1 : i], i + 1
        i += 1
    return text[at + 1 :], len(text)


def _tex_inline(text: str) -> str:
    while m := _TEX_GONE.search(text):
        _, end = _group(text, m.end())
        text = text[: m.start()] + text[end:]
    while m := re.search(r"\\href\s*(?=\{)", text):
        _, end = _group(text, m.end())
        gap = re.compile(r"\s*").match(text, end).end()
        shown, stop = _group(text, gap) if text[gap : gap + 1] == "{" else ("", end)
        text = text[: m.start()] + shown + text[stop:]
    text = re.sub(r"\\(?:bf|it|em|sc|tt|rm|sl|sf|bfseries|itshape|large|Large|small|tiny|centering|noindent|par|newpage|clearpage|maketitle|tableofcontents|hfill|medskip|bigskip|smallskip|quad|qquad)(?![A-Za-z])\s?", "", text)
    text = re.sub(r"\\\\(?:\[[^\]]*\])?", " ", text)
    text = re.sub(r"\\ldots|\\dots", "…", text)
    text = text.replace(r"\textbackslash", "\x07").replace("\\~{}", "\x08")
    text = re.sub(r"(?<!\\)~", " ", text)
    text = re.sub(r"\\([&%$#_{}])", lambda m: {"{": "\x0e", "}": "\x0f", "$": "\x10"}.get(m[1], m[1]), text)
    text = re.sub(r"\\[A-Za-z]+\*?\s*(?:\[[^\]]*\])?(?=\{)", "", text)
    text = re.sub(r"\\[A-Za-z]+\*?\s?|\\[ ,;:!/]", " ", text)
    text = re.sub(r"(?<!\\)\$([^$]*)\$", r"\1", text)
    text = text.replace("{", "").replace("}", "")
    return collapse(text.translate({0x07: "\\", 0x08: "~", 0x0E: "{", 0x0F: "}", 0x10: "$"}))


def _latex(text: str) -> Iterator[Raw]:
    held: list[tuple[str, str]] = []

    def hold(m: re.Match) -> str:
        if m["code"] is not None:
            held.append(("verb", m["code"]))
        elif m["gone"] or m[0].startswith("%"):
            return "\n" if m["gone"] else ""
        else:
            body = next(x for x in (m["m1"], m["m2"], m["m3"]) if x is not None)
            held.append(("math", re.sub(r"\\label\{[^{}]*\}|\\nonumber|\\notag", "", body)))
        return f"\n\n\x04{len(held) - 1}\x05\n\n"

    text = _TEX_SPECIAL.sub(hold, text)
    if m := re.search(r"\\begin\{document\}", text):
        text = text[m.end() :]
    text = text.split(r"\end{document}")[0]
    out, at = [], 0
    while m := _TEX_SECTION.search(text, at):
        title, end = _group(text, m.end())
        out += [text[at : m.start()], f"\n\n\x06{_SPACED.sub(' ', title).replace(chr(10), ' ')}\n\n"]
        at = end
    text = "".join([*out, text[at:]])
    text = re.sub(r"\\begin\{(?:itemize|enumerate|description)\}(?:\[[^\]]*\])?", "\n\n", text)
    text = re.sub(r"\\end\{(?:itemize|enumerate|description)\}", "\n\n", text)
    text = re.sub(r"\\item\b\s*(?:\[([^\]]*)\])?", lambda m: f"\n\n\x11{m[1] + ' ' if m[1] else ''}", text)
    text = re.sub(r"\\(?:begin|end)\{[A-Za-z*]+\}", "\n\n", text)
    for block in re.split(r"\n[ \t]*\n", text):
        s = block.strip()
        if not s:
            continue
        if m := _HOLD.fullmatch(s):
            yield held[int(m[1])][0], held[int(m[1])][1], 0
            continue
        linked = sum(_nwords(x) for x in re.findall(r"\\href\{[^{}]*\}\{([^{}]*)\}", s))
        if s[0] == "\x06":
            yield "head", _tex_inline(s[1:]), linked
        elif s[0] == "\x11":
            yield "item", _tex_inline(s[1:]), linked
        elif shown := _tex_inline(s):
            yield "text", shown, linked


def _plain(text: str) -> Iterator[Raw]:
    for block in re.split(r"\n\s*\n", text):
        if block.strip():
            yield "text", collapse(block), 0


_SEGMENT = {"wiki": _wiki, "either": _either, "html": _html, "markdown": _markdown, "latex": _latex, "plain": _plain}


def classify(raws: list[Raw]) -> list[tuple[str, str]]:
    """(kind, content) of the blocks that the tree keeps."""
    size = [(_nwords(c), min(1.0, k / max(1, _nwords(c)))) for _, c, k in raws]
    none, out = (0, 0.0), []
    for (mark, content, _), now, before, after in zip(raws, size, [none, *size], [*size[1:], none]):
        kind = _kind(mark, now, before, after)
        if kind != "drop":
            out.append((kind, content.strip("\n") if kind == "code" else content.strip()))
    return out


@lru_cache(100_000)
def _kind(mark: str, now: tuple[int, float], before: tuple[int, float], after: tuple[int, float]) -> str:
    return dtree.predict(tree(), features(mark, now, before, after))


def blocks(text: str | None) -> list[tuple[str, str]]:
    """(kind, content) of each kept block in reading order."""
    if text is None or not text.strip():
        return []
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return classify(list(_SEGMENT[dialect(text)](text)))


def box_lines(raw: str | None) -> list[str]:
    """The visible lines of a data-box value that holds markup; linked words are those of its links."""
    if not has_markup(raw):
        return []
    links = [collapse(strip_inline(a or b)) for a, b in _LINKED.findall(raw)]
    lines = [("box", line, sum(_nwords(x) for x in links if x and x in line)) for line in visible_lines(raw)]
    return [c for kind, c in classify(lines) if kind == "value"]


def clean_text(text: str | None) -> str | None:
    """Readable text: headings as ``# x``, list items as ``- x``, code fenced, formulas between ``$$``; null stays null."""
    if text is None:
        return None
    form = {"heading": "# {}", "list_item": "- {}", "code": "```\n{}\n```", "formula": "$$\n{}\n$$"}
    return "\n\n".join(form.get(kind, "{}").format(content) if kind in form else content for kind, content in blocks(text))


KINDS = ("heading", "list_item", "code", "formula")


def parts(df: DataFrame, key: str, text: str | None, boxes: tuple[str, ...] = (), kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(key, field, kind, content) of the kept blocks of a whole text column and of the lines of data-box columns, in one pass.

    Contents are distinct within a field of a row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            if text is not None:
                for k, raw in zip(batch["k"], batch["t"]):
                    rows += [(k, text, kind, c) for kind, c in dict.fromkeys((kind, collapse(c)) for kind, c in blocks(raw)) if kind in kinds and c]
            for i, field in enumerate(boxes):
                for k, raw in zip(batch["k"], batch[f"b{i}"]):
                    rows += [(k, field, "value", line) for line in dict.fromkeys(box_lines(raw))]
            yield pd.DataFrame(rows, columns=["k", "field", "kind", "content"]).astype({"k": "int64", "field": "object", "kind": "object", "content": "object"})

    own = [F.col(text).cast("string").alias("t")] if text is not None else []
    rows = df.select(F.col(key).cast("bigint").alias("k"), *own, *(F.col(b).cast("string").alias(f"b{i}") for i, b in enumerate(boxes))).where("k is not null")
    return rows.mapInPandas(run, "k bigint, field string, kind string, content string").withColumnRenamed("k", key)


def structure(df: DataFrame, key: str, field: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(key, field, kind, content) of the kept blocks of a whole text column, distinct within a text."""
    return parts(df, key, field, kinds=kinds)


def values(df: DataFrame, key: str, field: str) -> DataFrame:
    """(key, field, 'value', content): the visible lines of each value that holds markup."""
    return parts(df, key, None, (field,))
