"""Typed values from text columns with fallbacks, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.common import as_col
from gridloom.functions.text import blank_to_null


def text_value(wiki: Column | str, base: Column | str) -> Column:
    """The wiki value, else the base value, trimmed; null where both are blank."""
    return F.coalesce(blank_to_null(wiki), blank_to_null(base))


def to_int(value: Column | str) -> Column:
    """A number cut towards zero; null for what is no plain decimal number."""
    v = F.trim(as_col(value))
    return F.when(v.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), v.try_cast("double").try_cast("int"))


def number_value(wiki: Column | str, base: Column | str) -> Column:
    """The wiki number, else the base number, else 0."""
    return F.coalesce(to_int(wiki), to_int(base), F.lit(0))


def birth_timestamp(wiki: Column | str, base: Column | str) -> Column:
    """Time of birth in UTC; null where neither a date nor a year can be read.

    The wiki value is taken when it is not empty.  Its first word is tried as
    year-month-day, year/month/day, day-month-year and year; else the first
    year of 19xx or 20xx counts as its first of January.
    """
    v = F.trim(F.coalesce(F.when(as_col(wiki) != "", as_col(wiki)), as_col(base)))
    first = F.split(v, r"\s+")[0]
    date = [F.regexp_extract(first, p, 0) for p in (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$")]
    tries = [F.try_to_timestamp(d, F.lit(f)) for d, f in zip(date, ("yyyy-M-d", "yyyy/M/d", "d-M-yyyy"))]
    only = F.when(first.rlike("^[0-9]{4}$"), F.try_to_timestamp(first, F.lit("yyyy")))
    year = F.regexp_extract(v, r"\b((?:19|20)[0-9]{2})\b", 1)
    return F.coalesce(*tries, only, F.when(year != "", F.try_to_timestamp(year, F.lit("yyyy"))))


def stat_text(number: Column | str, name: str) -> Column:
    """'21 wins' for a positive number, else null, so that the count can be searched as text."""
    return F.when(as_col(number) > 0, F.concat_ws(" ", as_col(number), F.lit(name)))


def shown(*values: Column | str, default: str) -> Column:
    """The first value that is not blank, else the default."""
    return F.coalesce(*(F.when(as_col(v) != "", as_col(v)) for v in values), F.lit(default))


def shortened(value: Column | str, most: int = 100) -> Column:
    v = as_col(value)
    return F.when(F.length(v) > most, F.concat(F.substring(v, 1, most), F.lit("..."))).otherwise(v)
