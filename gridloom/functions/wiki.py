"""Fields and running text of wiki articles, as JVM expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.common import as_col
from gridloom.functions.text import collapse_space

#: aliases of each extracted field, the first one present wins; fixed values
FIELD_ALIASES = {
    "teams_wiki": ("teams", "team", "current_team", "team(s)"),
    "birth_place_wiki": ("birth_place",),
    "nationality_wiki": ("nationality",),
    "birth_date_wiki": ("birth_date", "born"),
    "championships_wiki": ("championships",),
    "wins_wiki": ("wins", "win"),
    "entries_wiki": ("entries", "races", "starts"),
    "podiums_wiki": ("podiums", "podium finishes"),
    "car_number_wiki": ("car_number", "car number"),
    "fastest_laps_wiki": ("fastest_laps", "fastest laps"),
    "pol_positions_wiki": ("pole positions", "poles"),
}
NUMBER_FIELDS = ("championships_wiki", "wins_wiki", "entries_wiki", "podiums_wiki", "car_number_wiki", "fastest_laps_wiki", "pol_positions_wiki")
#: words that make an article one about racing; fixed values
KEYWORDS = ("racing driver", "race car", "formula one", "nascar", "indycar", "motogp", "wrc", "karting")
#: a template without inner ones
TEMPLATE = r"\{\{[^{}]*\}\}"
#: one line of a data box: name and value; a value is what stands on its line
BOX_LINE = r"(?m)^[ \t\r\f\x0B]*\|[ \t\r\f\x0B]*([A-Za-z0-9_() ]+?)[ \t\r\f\x0B]*=[ \t\r\f\x0B]*([^ \t\r\f\x0B\n][^\n]*?)[ \t\r\f\x0B]*$"


def about_racing(text: Column | str) -> Column:
    """Not null and holding one of the keywords anywhere."""
    t = as_col(text)
    return t.isNotNull() & F.lower(t).rlike("|".join(KEYWORDS))


def infobox(text: Column | str) -> Column:
    """The first data box with its balanced braces; '' where there is none.

    A box that is never closed ends before the next heading, or with the text.
    """
    t = as_col(text)
    start = F.regexp_instr(t, F.lit(r"(?i)\{\{Infobox"))
    rest = F.when(start > 0, F.substring(t, start, F.length(t)))
    rest = F.regexp_replace(rest, r"(?s)\n={2,}[^\n]*?={2,}.*$", "")
    parts = F.regexp_extract_all(rest, F.lit(r"(?s)\{\{|\}\}|[^{}]+|[{}]"), F.lit(0))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(acc: Column, part: Column) -> Column:
        depth = acc["depth"] + F.when(part == "{{", 1).when(part == "}}", -1).otherwise(0)
        return F.when(acc["done"], acc).otherwise(F.struct(depth.alias("depth"), (acc["n"] + 1).alias("n"), (depth == 0).alias("done")))

    return F.coalesce(F.array_join(F.slice(parts, F.lit(1), F.aggregate(parts, zero, step)["n"]), ""), F.lit(""))


def fields(box: Column | str) -> Column:
    """map<name, value> of the lines ``| name = value``; empty values are skipped, the last of equal names wins.

    Names are lower case and may hold blanks; a value is what stands on its line.
    """
    b, pattern = as_col(box), F.lit("(?d)" + BOX_LINE)
    names = F.transform(F.regexp_extract_all(b, pattern, F.lit(1)), lambda k: F.lower(F.trim(k)))
    pairs = F.arrays_zip(names.alias("k"), F.regexp_extract_all(b, pattern, F.lit(2)).alias("v"))
    none = F.array().cast("array<struct<k:string,v:string>>")
    # folded once: an earlier pair of the same name makes way, and nothing is worked out again inside the lambda
    last = F.aggregate(pairs, none, lambda acc, p: F.concat(F.filter(acc, lambda q: q["k"] != p["k"]), F.array(F.struct(p["k"].alias("k"), p["v"].alias("v")))))
    return F.map_from_entries(last)


def field(box_fields: Column, names: tuple[str, ...]) -> Column:
    """The first name present, else ''."""
    return F.coalesce(*(F.try_element_at(box_fields, F.lit(n.lower())) for n in names), F.lit(""))


def _unlink(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\[\[([^|\]]+)\|([^\]]+)\]\]", "$2"), r"\[\[([^\]]+)\]\]", "$1")


def clean_value(value: Column | str) -> Column:
    """Links to their text, flat templates and tags away, '|' to a blank, white space collapsed; null gives ''."""
    v = _unlink(as_col(value))
    v = F.regexp_replace(F.regexp_replace(v, r"\{\{[^{}]+\}\}", ""), "(?s)<.*?>", "")
    return F.coalesce(collapse_space(F.replace(v, F.lit("|"), F.lit(" "))), F.lit(""))


def clean_birth_date(value: Column | str) -> Column:
    """year-month-day where three numbers make a real date, else the cleaned value."""
    v = as_col(value)
    pattern = r"(\d{4})[^0-9A-Za-z]{1,3}(\d{1,2})[^0-9A-Za-z]{1,3}(\d{1,2})(?:\D|$)"
    iso = F.concat_ws("-", F.regexp_extract(v, pattern, 1), F.lpad(F.regexp_extract(v, pattern, 2), 2, "0"), F.lpad(F.regexp_extract(v, pattern, 3), 2, "0"))
    return F.coalesce(F.when(v.rlike(pattern) & F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).isNotNull(), iso), clean_value(v))


def first_number(value: Column | str) -> Column:
    """The first run of digits as text, null where there is none."""
    digits = F.regexp_extract(as_col(value), r"([0-9]+)", 1)
    return F.when(digits != "", digits)


#: rewrites of the biography cleaner after templates are gone; fixed values in a fixed order
BIOGRAPHY_STEPS = (
    (r"(?s)<ref[^>]*/>", ""), (r"(?s)<ref[^>]*>.*?</ref>", ""), ("<[^>]+>", ""),
    (r"(?i)\[\[(?:File|Image):(?:[^\[\]]|\[\[[^\[\]]*\]\])*\]\]", ""), (r"\[\[Category:[^\]]*\]\]", ""),
    (r"\[\[([^|\]]+)\|([^\]]+)\]\]", "$2"), (r"\[\[([^\]]+)\]\]", "$1"), (r"\[https?://[^\]]+\]", ""),
    ("={2,}.*?={2,}", ""), (r"\|[A-Za-z0-9_ ]*=", ""), (r"\|-", ""), (r"\|\+", ""), (r"(?m)^\|", ""), ("!!", ""),
    (r"\b(?:colspan|rowspan|nowrap|style|background|nbsp)\b", ""), ("Category:[^\n]*", ""),
    (r"\b(?:thumb|thumbnail|left|right|center|frame)\b", ""), ("'{2,}", ""),
)
#: a word of the running text; fixed value
WORD = r"\b[A-Za-z][A-Za-z0-9\-']*\b"
#: letters beyond ASCII become '_', which is part of a word but starts none; other signs beyond ASCII become blanks
ASCII_STEPS = ((r"[^\p{L}\p{N}\x00-\x7F]", " "), (r"[^\x00-\x7F]", "_"))


def _plain_letters(text: Column) -> Column:
    for pattern, into in ASCII_STEPS:
        text = F.regexp_replace(text, pattern, into)
    return text


def without_templates(text: Column | str) -> Column:
    """Templates removed from the innermost outwards until none is left.

    There are as many rounds as templates are nested in depth; where single
    braces beside them made a new one, one round for each that is left.
    """
    rounds = lambda x, n: F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), x, lambda acc, _: F.regexp_replace(acc, TEMPLATE, ""))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, brace: Column) -> Column:
        now = F.when(brace == "{{", acc["now"] + 1).otherwise(F.greatest(acc["now"] - 1, F.lit(0)))
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    depth = lambda x: F.aggregate(F.regexp_extract_all(x, F.lit(r"\{\{|\}\}"), F.lit(0)), zero, step)["most"]
    left = lambda x: F.size(F.regexp_extract_all(x, F.lit(r"\}\}"), F.lit(0)))
    nested = lambda n: lambda x: F.when(x.rlike(TEMPLATE), rounds(x, n(x))).otherwise(x)
    return _once(_once(as_col(text), nested(depth)), nested(left))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that it names several times and that is worked out once."""
    return F.transform(F.array(value), use)[0]


def biography(text: Column | str, words: int = 1000) -> Column:
    """The first ``words`` words of two letters or more of an article's running text; null gives ''."""
    t = without_templates(_plain_letters(as_col(text)))
    for pattern, into in BIOGRAPHY_STEPS:
        t = F.regexp_replace(t, pattern, into)
    return F.coalesce(_words(t, words), F.lit(""))


def first_words(text: Column | str, words: int = 1000) -> Column:
    """The first words of two letters or more; a word that holds a letter beyond ASCII is left out."""
    return _words(_plain_letters(as_col(text)), words)


def _words(text: Column, words: int) -> Column:
    found = F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.length(w) >= 2)
    return F.array_join(F.slice(found, 1, words), " ")
