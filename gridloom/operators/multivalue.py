"""Several values packed in one field: one row per value, position kept.

A parsing expression grammar reads the field.  Ordered alternatives are tried
at each place and the first that fits wins::

    field     <- json_list / list
    json_list <- '[' quoted (',' quoted)* ']' END
    list      <- item (SEPARATOR item)*
    item      <- quoted note? &(SEPARATOR / END) / bare
    quoted    <- '"' ( '""' / !'"' . )* '"'
    bare      <- ( bracketed / firm / inverted / !SEPARATOR . )*
    bracketed <- '(' (!')' .)* ')' / '[' ... ']' / OPEN (!CLOSE .)* CLOSE
    firm      <- W ', ' W (', ' W)* ' & ' W        one firm named after its partners
    inverted  <- W ', ' GIVEN &(' ' TYPE)          surname before given name
    SEPARATOR <- [;|•·\\t\\n] / ' / ' / ','

A quote that is never closed, or not followed by a separator, makes the
parser go back and read the value as bare text with its quote mark; such a
value carries the error flag ``malformed_quote``.  An opened bracket that is
never closed is read as ordinary text and flagged ``open_bracket``.  Empty
values take no position.

Defined results: null, empty and blank fields give no rows; a field without
separators gives one row at position 1; repeated values count again; rows
that repeat a key are read once; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.names import fold, is_given
from gridloom.functions.wikivalue import CLOSE, OPEN, collapse, has_markup, visible_lines

_HARD = re.compile(r"[;|•·\t\n\r]|(?<=\s)/(?=\s)|,")
_W = r"[^\W\d_][\w'’.-]*"
#: three partners joined by commas: "A, B & C", "A, B and C", "A, B, C & Co"
_FIRM = re.compile(rf"{_W}, {_W}(?:, {_W}(?= & Co\b)| (?:&|\+|and|und|et) (?!Co\b){_W})(?: & Co\b\.?)?(?:\s(?:Ltd|GmbH|Co|Inc|SA|SpA)\b\.?)?(?=\s*(?:\(|[;|•·\t\n\r,\x02]|/|$))")
#: words that say what kind of team it is; fixed values
_TYPE = r"(?:auto ?sp(?:ort|\.)|motor ?sports?|msport|racing|rcg|grand prix|g\.p\.|gp|engineering|engrg|eng\.|scuderia|scud\.|team|competition)"
_INVERTED = re.compile(rf"([^\W\d_]+), ({_W})(?= (?i:{_TYPE})(?!\w))")
_QUOTED = re.compile(r'"((?:[^"]|"")*)"')
_NOTE = re.compile(r"\s*(\([^()]*\))")
_AFTER = re.compile(r"\s*(?:[;|•·\t\n\r,]|/\s|$)")
_JSON = re.compile(r'\s*\[\s*("(?:[^"\\]|\\.)*"\s*(?:,\s*"(?:[^"\\]|\\.)*"\s*)*)\]\s*$')
_JSON_ITEM = re.compile(r'"((?:[^"\\]|\\.)*)"')
_BLANK = re.compile(r"[ \u00a0]*")
_BRACKET = {"(": ")", "[": "]", OPEN: CLOSE}

Value = tuple[str, str]


def _bare(text: str, at: int) -> tuple[str, int, str]:
    """Read a bare value from ``at``; gives the text, the end and an error flag."""
    start, flag, n, fresh = at, "", len(text), True
    while at < n:
        c = text[at]
        if c in _BRACKET:
            end = text.find(_BRACKET[c], at + 1)
            if end >= 0:
                at, fresh = end + 1, False
                continue
            flag = flag or "open_bracket"
        if fresh and not c.isspace():
            fresh = False
            if m := _FIRM.match(text, at):
                at = m.end()
                continue
            if (m := _INVERTED.match(text, at)) and is_given(fold(m[2])) and not is_given(fold(m[1])):
                at = m.end()
                continue
        if _HARD.match(text, at):
            break
        at += 1
    return text[start:at], at, flag


def _item(text: str, at: int) -> tuple[str, int, str]:
    while at < len(text) and text[at] in " \u00a0":
        at += 1
    if at < len(text) and text[at] == '"':
        if m := _QUOTED.match(text, at):
            note = _NOTE.match(text, m.end())
            end = note.end() if note else m.end()
            if _AFTER.match(text, end):
                value = m[1].replace('""', '"') + (f" {note[1]}" if note else "")
                return value, end, ""
        value, end, _ = _bare(text, at)  # backtrack: the quote is part of a bare value
        return value, max(end, at + 1), "malformed_quote"
    return _bare(text, at)


def parse_values(text: str | None) -> list[Value]:
    """(value, error flag) of each non-blank value in order."""
    if text is None or not text.strip():
        return []
    if m := _JSON.match(text):
        found = [(x.replace('\\"', '"').replace("\\\\", "\\"), "") for x in _JSON_ITEM.findall(m[1])]
    else:
        found, at = [], 0
        while at <= len(text):
            value, at, flag = _item(text, at)
            found.append((value, flag))
            if at >= len(text):
                break
            sep = _BLANK.match(text, at).end()
            if m := _HARD.match(text, sep):
                at = m.end()
            elif sep >= len(text):
                break
            else:
                at = max(sep, at + 1) if not value else sep
    out = []
    for value, flag in found:
        shown = collapse(value.replace(OPEN, "").replace(CLOSE, ""))
        if shown:
            out.append((shown, flag))
    return out


def parse_wiki_values(raw: str | None) -> list[Value]:
    """As :func:`parse_values`, over the visible lines of a wiki value."""
    if raw is None or not raw.strip():
        return []
    if not has_markup(raw):
        return parse_values(raw)
    out: list[Value] = []
    for line in visible_lines(raw, mark=True):
        out += parse_values(line)
    return out


def split_values(df: DataFrame, key: str, field: str, name: str, wiki: bool = False) -> DataFrame:
    """One row (field, rec_id, pos, value, error) per value of ``field``.

    ``name`` fills the column ``field``.  The key is cast to bigint.  Parsing
    runs in Arrow batches; the only shuffle removes repeated keys before it.
    """
    parse = parse_wiki_values if wiki else parse_values

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rec, pos, val, err = [], [], [], []
            for k, text in zip(batch["rec_id"], batch["raw"]):
                for i, (value, flag) in enumerate(parse(text), 1):
                    rec.append(k)
                    pos.append(i)
                    val.append(value)
                    err.append(flag or None)
            yield pd.DataFrame({"rec_id": pd.Series(rec, dtype="int64"), "pos": pd.Series(pos, dtype="int32"), "value": pd.Series(val, dtype="object"), "error": pd.Series(err, dtype="object")})

    rows = df.select(F.col(key).cast("bigint").alias("rec_id"), F.col(field).cast("string").alias("raw"))
    rows = rows.where(F.col("rec_id").isNotNull() & F.col("raw").rlike(r"\S")).dropDuplicates(["rec_id"])
    out = rows.mapInPandas(run, "rec_id bigint, pos int, value string, error string")
    return out.select(F.lit(name).alias("field"), "rec_id", "pos", "value", "error")
