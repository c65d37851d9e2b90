"""Text expressions.  All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.common import as_col


def tokens(text: Column | str) -> Column:
    """Lower-case words made only of a-z and 0-9, in order; null gives an empty array.

    A word is a run of letters, digits and underscores of any script; a word
    that holds anything but a-z and 0-9 is dropped whole.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(as_col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(words, lambda w: w.rlike("^[a-z0-9]+$"))


def collapse_space(text: Column | str) -> Column:
    """Trim, and one blank for each run of white space, no-break spaces included."""
    return F.trim(F.regexp_replace(as_col(text), r"(?U)[\s ]+", " "))


def strip_tags(text: Column | str) -> Column:
    """Remove tags, decode ``&amp;``, ``&nbsp;`` and ``&quot;`` in this order, collapse white space."""
    out = F.regexp_replace(as_col(text), "<[^>]+>", "")
    for entity, char in (("&amp;", "&"), ("&nbsp;", " "), ("&quot;", '"')):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapse_space(out)


def normalise_name(name: Column | str) -> Column:
    """Lower case without a trailing note in brackets."""
    return F.lower(F.regexp_replace(as_col(name), r"\s+\(.*\)$", ""))


def blank_to_null(value: Column | str) -> Column:
    c = as_col(value)
    return F.when(F.length(F.trim(c)) > 0, F.trim(c))
