"""Visible text of short wiki values (data-box fields).

``visible_lines(raw)`` gives the lines or list items that a reader of the
rendered value sees.  With ``mark=True`` every linked, emphasised or
no-wrap phrase is kept between ``OPEN`` and ``CLOSE`` so that a splitter can
treat it as one piece.
"""

from __future__ import annotations

import html
import re

OPEN, CLOSE, ITEM = "\x01", "\x02", "\x03"

MARKUP = re.compile(r"\[\[|\]\]|\{\{|\}\}|<[A-Za-z/!]|''|&(?:[A-Za-z]{2,8}|#\d{1,6}|#x[0-9A-Fa-f]{1,5});|\[https?://|(?:^|\n)[*#:;]")
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_REF = re.compile(r"<ref\b[^<>]*/\s*>|<ref\b[^<>]*>.*?(?:</ref\s*>|\Z)", re.S | re.I)
_HIDDEN = re.compile(r"<(script|style|gallery)\b[^<>]*>.*?</\1\s*>", re.S | re.I)
_BREAK = re.compile(r"<br\b[^<>]*>|</?(?:li|ul|ol|p|div|tr)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_FILE = re.compile(r"\[\[\s*(?:file|image|category|datei|bild)\s*:(?:[^\[\]]|\[\[[^\[\]]*\]\])*\]\]", re.I)
_LINK = re.compile(r"\[\[([^\[\]|]*)(?:\|([^\[\]]*))?\]\]")
_EXT = re.compile(r"\[(?:https?:)?//[^\s\]]+\s*([^\]]*)\]")
_TEMPLATE = re.compile(r"\{\{([^{}]*)\}\}")
_LISTLINE = re.compile(r"(?:^|\n)[ \t]*[*#]+[ \t]*")
_QUOTES = re.compile(r"'{2,5}")
_SPACE = re.compile(r"\s+")
#: a text without any of these holds nothing to resolve
_SPECIAL = re.compile(r"[\[\]{}<'&*#]")

#: templates whose parameters are list items
LISTS = frozenset({"plainlist", "ubl", "unbulleted list", "hlist", "flatlist", "plain list", "ublist", "bulleted list"})
#: templates that show their last positional parameter
SHOWN = frozenset({"nowrap", "nobr", "small", "big", "flag", "flagcountry", "lang", "nobold", "smaller", "larger", "center", "abbr", "flagu"})


def has_markup(raw: str | None) -> bool:
    return bool(raw) and MARKUP.search(raw) is not None


def _positional(parts: list[str]) -> list[str]:
    return [p for p in parts if not re.match(r"\s*[A-Za-z_]+\s*=", p)]


def _atoms(text: str) -> str:
    return text.replace(OPEN, "").replace(CLOSE, "")


def expand_template(body: str, mark: bool = False) -> str:
    """What a template without inner templates shows."""
    name, *parts = body.split("|")
    key = _SPACE.sub(" ", name.replace("_", " ")).strip().lower()
    if key in LISTS:
        shown = _positional(parts) if len(parts) > 1 or not re.search(r"(?:^|\n)\s*\*", "".join(parts)) else parts
        return ITEM + ITEM.join(shown) + ITEM
    if key in SHOWN:
        shown = _positional(parts)
        text = shown[0 if key == "abbr" else -1] if shown else ""
        return f"{OPEN}{_atoms(text)}{CLOSE}" if mark and text.strip() else text
    return ""


def strip_inline(text: str, mark: bool = False) -> str:
    """Resolve comments, references, links, templates and tags; breaks and list items become ``ITEM``."""
    if not _SPECIAL.search(text):
        return text
    if "<" in text:
        text = _BREAK.sub(ITEM, _HIDDEN.sub("", _REF.sub("", _COMMENT.sub("", text))))
    wrap = (lambda s: f"{OPEN}{_atoms(s)}{CLOSE}" if s.strip() else "") if mark else (lambda s: s)
    before = ""
    while text != before and ("[[" in text or "{{" in text):  # each round resolves the innermost level
        before = text
        text = _FILE.sub("", text)
        text = _LINK.sub(lambda m: wrap(m[2] if m[2] is not None and m[2].strip() else m[1].lstrip(":")), text)
        text = _TEMPLATE.sub(lambda m: expand_template(m[1], mark), text)
    if "[" in text:
        text = _EXT.sub(lambda m: m[1], text)
    if "{{" in text or "}}" in text:
        text = re.sub(r"\{\{[^{}\n]*$|\}\}", "", text)
    text = _LISTLINE.sub(ITEM, text)
    if mark:
        text = re.sub(r"('{2,5})((?:(?!'').)+?)\1", lambda m: wrap(m[2]), text)
    text = _TAG.sub("", _QUOTES.sub("", text))
    return html.unescape(text)


def collapse(text: str) -> str:
    """Trim and turn each run of white space, no-break space included, into one space."""
    return _SPACE.sub(" ", text.replace("\u00a0", " ").replace("\u200b", "")).strip()


def visible_lines(raw: str | None, mark: bool = False) -> list[str]:
    """Lines and list items of the rendered value, blank ones left out; [] for null."""
    if not raw:
        return []
    text = strip_inline(raw, mark)
    out = []
    for piece in re.split(f"[{ITEM}\n]", text):
        line = collapse(piece)
        if line.strip(OPEN + CLOSE + " "):
            out.append(line)
    return out
