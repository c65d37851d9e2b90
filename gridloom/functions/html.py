"""Fields of an entity's HTML page, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.common import as_col
from gridloom.functions.text import strip_tags

#: fixed values: sections of a page that list teams, as id, whether only marked rows count, and the cell that holds the team (0: any)
TEAM_SECTIONS = (("championship-seasons", True, 2), ("non-championship-races", True, 4), ("teams", False, 0))
STATS = ("starts", "wins", "poles", "podiums")

#: marks of the pages: headings, the flag's picture, rows; fixed values
_HERO, _H1 = r'(?s)<h1[^>]*class="[^"]*hero__title[^"]*"[^>]*>(.*?)</h1>', r"(?s)<h1[^>]*>(.*?)</h1>"
_FLAG = r'(?s)<div[^>]*class="[^"]*database-data__content[^"]*database-data__icon[^"]*"[^>]*>.*?<img[^>]*alt="([^"]+)"[^>]*>'
_MARKED_ROW, _ROW = r'(?s)<tr[^>]*class="database-table__row"[^>]*>(.*?)</tr>', r"(?s)<tr[^>]*>(.*?)</tr>"
#: marks of the pages' labelled values; fixed values
_HEAD = r'<div[^>]*class="[^"]*database-data__head[^"]*"[^>]*>'
_CONTENT = r'</div>\s*<div[^>]*class="[^"]*database-data__content[^"]*"[^>]*>(.*?)</div>'


def _one(html: Column, pattern: str) -> Column:
    return F.regexp_extract(html, pattern, 1)


def page_title(html: Column | str) -> Column:
    """Text of the hero heading, else of the first heading, else ''."""
    h = as_col(html)
    return F.coalesce(strip_tags(F.when(h.rlike(_HERO), _one(h, _HERO)).otherwise(_one(h, _H1))), F.lit(""))


def born(html: Column | str) -> Column:
    """First three words of the value labelled Born."""
    words = F.split(strip_tags(_one(as_col(html), f"(?is){_HEAD}Born{_CONTENT}")), " ")
    return F.coalesce(F.array_join(F.slice(words, 1, 3), " "), F.lit(""))


def nationality(html: Column | str) -> Column:
    """Alternative text of the flag image; entities stay as they are."""
    return F.coalesce(F.trim(_one(as_col(html), _FLAG)), F.lit(""))


def stat(html: Column | str, name: str) -> Column:
    """The value labelled ``name``; the last one wins, '' where there is none."""
    found = F.regexp_extract_all(as_col(html), F.lit(f"(?is){_HEAD}{name}{_CONTENT}"), F.lit(1))
    return F.coalesce(strip_tags(F.try_element_at(found, F.lit(-1))), F.lit(""))


def section(html: Column | str, section_id: str) -> Column:
    """From the section's opening tag to the first closing tag; a section inside it ends it."""
    return _one(as_col(html), rf'(?is)<section[^>]+id="{section_id}"[^>]*>(.*?)</section>')


def section_teams(html: Column | str, section_id: str, marked: bool, cell: int) -> Column:
    """Distinct link texts of a section's rows, in order."""
    rows = F.regexp_extract_all(section(html, section_id), F.lit(_MARKED_ROW if marked else _ROW), F.lit(1))
    if cell:
        rows = F.transform(rows, lambda r: F.try_element_at(F.regexp_extract_all(r, F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1)), F.lit(cell)))
    else:
        rows = F.filter(rows, lambda r: ~r.contains("<th"))
    names = F.transform(rows, lambda r: strip_tags(_one(r, r"(?s)<a[^>]*>(.*?)</a>")))
    return F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "")))


def teams(html: Column | str) -> Column:
    """Teams of all sections, each once, in order."""
    return F.array_distinct(F.concat(*(section_teams(html, *s) for s in TEAM_SECTIONS)))


def links(html: Column | str, base: str) -> Column:
    """Distinct entity links of a listing page: the base address, a slug, a slash."""
    pattern = "".join("\\" + c if c in ".?+*()[]{}|^$\\" else c for c in base) + r"[a-z0-9\-]+/"
    return F.array_distinct(F.regexp_extract_all(as_col(html), F.lit(pattern), F.lit(0)))


def file_name(url: Column | str) -> Column:
    """Name under which a page is kept: its path with '_' for '/', 'index' for none."""
    path = F.regexp_replace(F.regexp_replace(as_col(url), r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/]*", "")
    name = F.replace(F.regexp_replace(path, r"^/+|/+$", ""), F.lit("/"), F.lit("_"))
    return F.concat(F.when(name == "", F.lit("index")).otherwise(name), F.lit(".html"))
