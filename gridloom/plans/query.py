"""The query language: numeric comparisons, words, modes, a sort prefix.

``parse`` turns a line into a :class:`QuerySpec`; nothing here touches Spark.

Comparisons are ``field op number`` with an unsigned integer, case and blanks
around the operator free.  ``>=`` and ``>`` reach up to ``HIGHEST``, ``<=``
and ``<`` down to 0.  For one field the operators are looked for in the order
of ``OPERATORS``; the first that occurs counts with its first value, all its
repetitions are removed, and other comparisons of that field stay as words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

#: fixed values of the language
NUMERIC = ("wins", "podiums", "poles", "starts", "fastest_laps", "championships")
OPERATORS = (">=", ">", "<=", "<", "==", "=")
HIGHEST = 999999
WHOLE_STOPS = frozenset({"driver", "drivers", "racer", "racers", "with"})
WORD_STOPS = frozenset({"driver", "drivers", "racer", "racers", "with", "has", "have", "and", "the"})
BOOSTS = {
    "driver_name": 5.0, "teams_wiki": 2.5, "biography": 0.2, "nationality_wiki": 5.0, "birth_place_wiki": 5.0, "birth_date_wiki": 1.5, "birth_date": 1.5,
    "car_number_wiki": 1.5, "wins_text": 3.0, "podiums_text": 3.0, "poles_text": 3.0, "starts_text": 3.0, "fastest_laps_text": 3.0, "championships_text": 3.0,
}
TOP = 5


class EmptyQuery(ValueError):
    """Neither a comparison nor a word is left."""


@dataclass(frozen=True)
class Range:
    field: str
    low: int
    high: int


@dataclass(frozen=True)
class QuerySpec:
    words: tuple[str, ...] = ()
    ranges: tuple[Range, ...] = ()
    use_or: bool = True
    fuzzy: bool = True
    sort_by: str | None = None
    k: int | None = TOP
    boosts: dict[str, float] = field(default_factory=lambda: dict(BOOSTS))


def bounds(op: str, n: int) -> tuple[int, int]:
    return {">=": (n, HIGHEST), ">": (n + 1, HIGHEST), "<=": (0, n), "<": (0, n - 1)}.get(op, (n, n))


def split_ranges(text: str) -> tuple[tuple[Range, ...], str]:
    """The comparisons of a query and what is left of it."""
    found = []
    for name in NUMERIC:
        for op in OPERATORS:
            pattern = re.compile(rf"\b{name}\s*{re.escape(op)}\s*([0-9]+)\b", re.I)
            if m := pattern.search(text):
                found.append(Range(name, *bounds(op, int(m[1]))))
                text = pattern.sub("", text)
                break
    return tuple(found), re.sub(r"\s+", " ", text).strip()


def split_sort(text: str) -> tuple[str | None, str]:
    """The field of a ``sort:field`` or ``sort: field`` prefix and the rest; an unknown field sorts by score."""
    m = re.match(r"\s*sort:\s*(\w+)(?:\s+(.*))?$", text, re.I | re.S)
    if not m:
        return None, text
    name = m[1].lower()
    return (name if name in NUMERIC else None), (m[2] or "")


def parse(text: str, use_or: bool = True, fuzzy: bool = True, k: int | None = TOP) -> QuerySpec:
    """A query line as a specification; raises :class:`EmptyQuery` where nothing is left to look for."""
    sort_by, rest = split_sort(text)
    ranges, rest = split_ranges(rest)
    words = () if rest in WHOLE_STOPS else tuple(w for w in rest.split() if w.lower() not in WORD_STOPS)
    if not words and not ranges:
        raise EmptyQuery(text)
    return QuerySpec(words, ranges, use_or, fuzzy, sort_by, k)


@dataclass
class Console:
    """State of an interactive session: mode words change it, other lines are queries."""

    use_or: bool = True
    fuzzy: bool = True

    def read(self, line: str) -> str | QuerySpec | None:
        """'exit', 'help', a message about a changed mode, a specification, or None for a blank line."""
        word = line.strip().lower()
        if not word:
            return None
        if word in ("exit", "quit", "q"):
            return "exit"
        if word in ("help", "h", "?"):
            return "help"
        if word in ("and", "or"):
            self.use_or = word == "or"
            return f"mode: {word}"
        if word in ("fuzzy", "fuzzy on", "fuzzy off", "exact"):
            self.fuzzy = word in ("fuzzy", "fuzzy on")
            return f"fuzzy: {'on' if self.fuzzy else 'off'}"
        return parse(line.strip(), self.use_or, self.fuzzy)


def limited(spec: QuerySpec, k: int | None) -> QuerySpec:
    return replace(spec, k=k)
