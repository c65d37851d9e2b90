"""Free-typed values mapped to the entries of a reference list, or reported as unmatched.

Typed values are cleaned of markup and folded.  They are joined with the names
of the list by a prefix-filtered q-gram set-similarity join (rarest q-grams
first, length and positional filters, exact Jaccard); the best candidate
within a length-dependent edit distance is kept, and a hint beside the name
(the country of a place) decides between entries of one name.  A list of at
most ``LIST_MOST`` entries is indexed on every worker, so the values are never
shuffled for it; a larger one is joined by shuffles, with the same result.  The
list of nations that tells the country of a place must not exceed the bound.

Defined results: null and blank values give no row; a value that no entry
matches, and words that say nothing (``unknown``, ``n/a``, ``?``) give
``ref_id`` 0; equal best candidates go to the one that the hint names, else
to the smaller ``ref_id``; a key that is repeated gives one row; an empty list
maps everything to 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.editdist import osa
from gridloom.functions.names import fold
from gridloom.functions.wikivalue import collapse, visible_lines
from gridloom.llm.setjoin import jaccard_join, qgrams

#: other everyday names of the countries; fixed values, by ISO code
OTHER_NAMES = {
    "GBR": "UK|U.K.|Great Britain|Britain|GB|England|English|Brit", "USA": "US|U.S.|U.S.A.|United States of America|America|Yankee",
    "DEU": "GER|Deutschland|Deutsch|Deutscher|Allemagne", "CHE": "SUI|Schweiz|Suisse|Svizzera|Schweizer", "AUT": "Österreich|Osterreich|Oesterreich|Österreicher",
    "ITA": "Italia|Italiano|Italien", "FRA": "Française|Français|Francais|Frankreich|la France", "ESP": "España|Español|Spanien|SPA",
    "BRA": "Brasil|Brasileiro|Brazillian", "BEL": "België|Belgique|Belgien|Belgisch", "NLD": "NED|Holland|The Netherlands|Nederland|Hollander|Dutchman",
    "SWE": "Sverige|Svensk|Schweden", "DNK": "DEN|Danmark|Dansk|Dane", "FIN": "Suomi|Finn", "JPN": "Nippon|JAP", "MEX": "México|Mexicano",
    "PRT": "POR|Português|Portugues", "ARG": "Argentinean|Argentinian|Argentino", "POL": "Polska|Pole|Polski", "CZE": "Czechia|Česko|Czech Rep.",
    "NOR": "Norge|Norsk", "IRL": "Éire|Eire|IRE|Republic of Ireland", "NZL": "Kiwi|N. Zealand|Aotearoa|NZ", "HUN": "Magyarország|Magyar|Magyarorszag",
    "RUS": "Rossiya|Russian Federation|Россия", "ZAF": "RSA|S. Africa|Suid-Afrika", "MCO": "Monégasque|MON|Monacan", "GRC": "GRE|Hellas|Hellenic", "HRV": "CRO|Hrvatska|Croat",
    "SVN": "SLO|Slovenija|Slovene", "ROU": "România|ROM|Rumania", "TUR": "Türkiye|Turkiye|Turk", "CHN": "PRC|Zhongguo|People's Republic of China", "IND": "Bharat", "IDN": "INA",
    "MYS": "MAS", "CHL": "CHI", "URY": "URU", "EST": "Eesti", "LVA": "LAT|Latvija|Lett", "LTU": "Lietuva|LIT", "UKR": "Ukraina", "LUX": "Lëtzebuerg|Luxemburg|Luxembourger",
    "LIE": "Liechtenstein's", "AUS": "Aussie|Oz", "CAN": "Canuck", "MAR": "Maroc|MOR", "THA": "Siam", "COL": "COL.", "VEN": "VEN.",
}

#: words for nothing known
NOTHING = frozenset("unknown n/a na none null tbc tbd tba various stateless ? - – — not recorded not known see notes see text europe world".split()) | {"not recorded", "not known", "see notes", "see text", "n / a"}

_NOTE = re.compile(r"\s*\((?:all series|racing driver|driver|by birth|naturali[sz]ed|licen[cs]e)\)\s*", re.I)
_TAIL = re.compile(r"\s+(?:racing\s+)?(?:driver|racer|citizen|national|nationality|born)\s*$|\s*[.;:]+\s*$", re.I)
_FLAG = re.compile(r"\{\{\s*flag(?:icon|country|u|deco)?\s*\|\s*([^|{}]+)", re.I)


def flat(text: str) -> str:
    """Folded letters and digits with single blanks."""
    return re.sub(r"[^a-z0-9а-я]+", " ", fold(text)).strip()


def clean_nationality(raw: str | None) -> list[str] | None:
    """Folded readings of a typed nationality, best first; None for blank, [] for a word that says nothing."""
    if raw is None or not raw.strip():
        return None
    text = collapse(_NOTE.sub(" ", " ".join(visible_lines(raw))))
    if not text:
        flag = _FLAG.search(raw)
        if not flag:
            return None if not collapse(raw) else []
        text = flag[1]
    if text.lower() in NOTHING:
        return []
    out = [text]
    while (cut := _TAIL.sub("", out[-1])) != out[-1]:
        out.append(cut)
    if m := re.fullmatch(r"(.+?)\s*\(([^()]+)\)", text):
        out += [m[1], m[2]]
    for sep in ("/", ",", ";", "|"):
        if sep in text:
            out += [p for p in text.split(sep) if p.strip()]
    out = [f for f in dict.fromkeys(map(flat, out)) if f]
    return out[::-1] if len(out) > 1 and not re.search(r"[(/,;|]", text) else out


_SAINT = re.compile(r"\b(?:st|ste)\b\.?\s*(?=[a-z])")


def clean_place(raw: str | None, countries: dict[str, str]) -> tuple[str, str, str] | None:
    """(name, region, country code) of a typed birth place; None for blank, an empty name where it says nothing."""
    if raw is None or not raw.strip():
        return None
    text = collapse(", ".join(visible_lines(raw)))
    if not text:
        return None
    parts = [p for p in (x.strip() for x in text.split(",")) if p]
    if not parts or parts[0].lower() in NOTHING:
        return ("", "", "")
    code, region = "", ""
    if len(parts) > 1:
        code = countries.get(flat(parts[-1]), "")
        region = flat(" ".join(parts[1:-1] if code else parts[1:]))
    head = parts[0]
    words = head.split()
    if len(parts) == 1:
        if flat(head) in countries:
            return ("", "", countries[flat(head)])
        for n in (4, 3, 2, 1):  # "Town Country" without a comma
            if len(words) > n and (found := countries.get(flat(" ".join(words[-n:])))):
                code, head = found, " ".join(words[:-n])
                break
    return (place_form(head), region, code)


def place_form(name: str) -> str:
    """One spelling for the usual short forms of place names."""
    f = fold(re.sub(r"\((?:city|town|region|village)\)", "", name, flags=re.I))
    f = _SAINT.sub("saint ", f)
    f = re.sub(r"\b(?:upr|up)\b\.?\s+", "upper ", f)
    f = re.sub(r"\b(?:lwr|low)\b\.?\s+", "lower ", f)
    f = re.sub(r"\bpt\b\.?\s+", "port ", f)
    f = re.sub(r"\s+(?:o\.|on|upon|a\.)\s+|-o\.?-|-on-", " on ", f)
    f = re.sub(r"[^a-z0-9]+", " ", f).strip()
    return re.sub(r"(?<=[a-z]{3})brueck\b", "bruck", f)


def most_edits(n: int, loose: bool) -> int:
    """Edits allowed for a name of ``n`` characters; ``loose`` for the long names of places."""
    if loose:
        return 1 if n <= 6 else 2 if n <= 13 else 3
    return 0 if n <= 3 else 1 if n <= 9 else 2


NATION_SIM = 0.3  # least Jaccard similarity of q-gram sets
PLACE_SIM = 0.3


class NameIndex:
    """Prefix-filter index over the names of a bounded list.

    Any fixed order of q-grams keeps the join exact; this one takes their
    rarity in the list, q-grams that the list lacks first.
    """

    def __init__(self, names: list[str], sim: float, loose: bool) -> None:
        self.sim, self.loose = sim, loose
        self.df: dict[str, int] = {}
        sets = {n: grams(n) for n in dict.fromkeys(names)}
        for g in sets.values():
            for x in g:
                self.df[x] = self.df.get(x, 0) + 1
        self.post: dict[str, list[tuple[str, int, int]]] = {}
        self.sets = sets
        for n, g in sets.items():
            for pos, x in enumerate(self._prefix(g)):
                self.post.setdefault(x, []).append((n, len(g), pos))
        self.kept: dict[str, list[tuple[int, float, str]]] = {}

    def _prefix(self, g: frozenset[str]) -> list[str]:
        order = sorted(g, key=lambda x: (self.df.get(x, 0), x))
        return order[: len(g) - math.ceil(len(g) * self.sim - 1e-9) + 1]

    def match(self, value: str) -> list[tuple[int, float, str]]:
        """(edits, -similarity, name) of every name within the allowed edits, best first."""
        if value in self.kept:
            return self.kept[value]
        g = grams(value)
        n, best = len(g), {}
        for pos, x in enumerate(self._prefix(g)):
            for name, m, at in self.post.get(x, ()):
                if name in best or m < self.sim * n - 1e-9 or n < self.sim * m - 1e-9:
                    continue
                need = math.ceil(self.sim / (1 + self.sim) * (n + m) - 1e-9)
                if min(n - pos, m - at) >= need:
                    best[name] = m
        out = []
        for name, m in best.items():
            common = len(g & self.sets[name])
            sim = common / (n + m - common)
            if sim >= self.sim - 1e-9:
                most = most_edits(max(len(value), len(name)), self.loose)
                d = osa(value, name, most)
                if d <= most:
                    out.append((d, -sim, name))
        out.sort()
        if len(self.kept) < 50_000:
            self.kept[value] = out
        return out


def grams(text: str, q: int = 2) -> frozenset[str]:
    padded = f"^{text}$"
    return frozenset(padded[i : i + q] for i in range(max(1, len(padded) - q + 1)))


LIST_MOST = 50_000  # entries of a reference list; it is sent to every worker


def read_list(entries: DataFrame, *columns: str, most: int = LIST_MOST) -> list:
    """The rows of a reference list, which must not exceed ``most``."""
    rows = entries.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the reference list has more than {most} entries; map it with match_large()")
    return rows


def fits(entries: DataFrame, most: int) -> bool:
    """Whether a list is short enough to be sent to every worker."""
    return entries.limit(most + 1).count() <= most


def match_large(values: DataFrame, names: DataFrame, sim: float, loose: bool) -> DataFrame:
    """(value, alias, sim, d) for a list of any size: the same join as shuffles in the JVM.

    ``values`` has ``value``, ``names`` has ``alias``; both folded.
    """
    left = values.select("value").distinct().select(F.concat(F.lit("v"), "value").alias("id"), qgrams("value").alias("toks"))
    right = names.select("alias").distinct().select(F.concat(F.lit("n"), "alias").alias("id"), qgrams("alias").alias("toks"))

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            most = most_edits(max(len(x), len(y)), loose)
            d = osa(x, y, most)
            out.append(d if d <= most else -1)
        return pd.Series(out, dtype="int32")

    pairs = jaccard_join(left, right, sim).select(F.substring("ida", 2, 1 << 20).alias("value"), F.substring("idb", 2, 1 << 20).alias("alias"), "sim")
    return pairs.withColumn("d", distance("value", "alias")).where("d >= 0")


def nation_names(demonym: str | None, country: str | None, code: str | None) -> list[str]:
    """Folded names of a nation: demonym, country, code and everyday names."""
    return [flat(x) for x in (demonym, country, code, *OTHER_NAMES.get(code or "", "").split("|")) if x and flat(x)]


def nation_index(rows: list) -> tuple[NameIndex, dict[str, int]]:
    """The index of a list of nations (demonym, country, code, everyday names) and the entry of each name."""
    entry: dict[str, int] = {}
    for r in sorted(rows, key=lambda r: r["ref_id"]):
        for x in nation_names(r["demonym"], r["country"], r["code"]):
            entry.setdefault(x, r["ref_id"])
    return NameIndex(list(entry), NATION_SIM, loose=False), entry


def typed_values(df: DataFrame, key: str, field: str, name: str, hint: str | None = None) -> DataFrame:
    """(field, rec_id, raw, hint) of the non-blank values, one per key; ``hint`` is a column beside them or null."""
    beside = F.col(hint).cast("string") if hint else F.lit(None).cast("string")
    rows = df.select(F.lit(name).alias("field"), F.col(key).cast("bigint").alias("rec_id"), F.col(field).cast("string").alias("raw"), beside.alias("hint"))
    return rows.where(F.col("rec_id").isNotNull() & F.col("raw").rlike(r"\S")).dropDuplicates(["rec_id"])


def _mapped(typed: DataFrame, choose) -> DataFrame:
    """(field, rec_id, ref_id): ``choose`` gives the entry of a raw value with its hint, or None for no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(f, k, r) for f, k, raw, hint in zip(b["field"], b["rec_id"], b["raw"], b["hint"]) if (r := choose(raw, hint)) is not None]
            yield pd.DataFrame(out, columns=["field", "rec_id", "ref_id"]).astype({"field": "object", "rec_id": "int64", "ref_id": "int64"})

    return typed.mapInPandas(run, "field string, rec_id bigint, ref_id bigint")


def _aliased(entries: DataFrame, columns: tuple[str, ...], names, kept: tuple[str, ...] = ()) -> DataFrame:
    """(alias, ref_id, kept ...): every folded name of every entry, read where the entries are; ``kept`` columns as texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rest = list(zip(*(b[c] for c in kept))) or [()] * len(b)
            rows = [(a, r, *k) for r, k, values in zip(b["ref_id"], rest, zip(*(b[c] for c in columns))) for a in dict.fromkeys(names(*values))]
            yield pd.DataFrame(rows, columns=["alias", "ref_id", *kept]).astype({"alias": "object", "ref_id": "int64", **dict.fromkeys(kept, "object")})

    rows = entries.select(F.col("ref_id").cast("bigint"), *(F.col(c).cast("string").alias(c) for c in dict.fromkeys((*columns, *kept))))
    return rows.where("ref_id is not null").mapInPandas(run, ", ".join(["alias string, ref_id bigint", *(f"{k} string" for k in kept)]))


def _best(read: DataFrame, candidates: DataFrame, *order: Column) -> DataFrame:
    """(field, rec_id, ref_id): the first candidate of each record by ``order``, 0 where it has none."""
    best = candidates.groupBy("field", "rec_id").agg(F.min(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), "ref_id"))["ref_id"].alias("ref_id"))
    return read.select("field", "rec_id").distinct().join(best, ["field", "rec_id"], "left").select("field", "rec_id", F.coalesce("ref_id", F.lit(0)).alias("ref_id"))


def _nationalities_large(typed: DataFrame, entries: DataFrame) -> DataFrame:
    def read_forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, k, i, form) for f, k, raw in zip(b["field"], b["rec_id"], b["raw"]) if (forms := clean_nationality(raw)) is not None for i, form in enumerate(forms or [None])]
            yield pd.DataFrame(rows, columns=["field", "rec_id", "pos", "value"]).astype({"field": "object", "rec_id": "int64", "pos": "int32", "value": "object"})

    read = typed.select("field", "rec_id", "raw").mapInPandas(read_forms, "field string, rec_id bigint, pos int, value string")
    names = _aliased(entries, ("demonym", "country", "code"), nation_names).groupBy("alias").agg(F.min("ref_id").alias("ref_id"))
    near = match_large(read.where("value is not null"), names, NATION_SIM, loose=False)
    found = read.join(near, "value").join(names, "alias")
    return _best(read, found, F.col("d"), F.col("pos"), -F.col("sim"))


def _places_large(typed: DataFrame, entries: DataFrame, nations: DataFrame) -> DataFrame:
    listed = read_list(nations, "ref_id", "demonym", "country", "code")
    codes, (nation, entry), code_of = country_codes(listed), nation_index(listed), {r["ref_id"]: r["code"] for r in listed}

    def read_places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f, k, raw, hint in zip(b["field"], b["rec_id"], b["raw"], b["hint"]):
                if (place := clean_place(raw, codes)) is not None:
                    hits = [m[0] for form in clean_nationality(hint) or () if (m := nation.match(form))]
                    rows.append((f, k, *place, code_of[entry[min(hits)[2]]] if hits else ""))
            yield pd.DataFrame(rows, columns=["field", "rec_id", "value", "region", "code", "hinted"]).astype({"rec_id": "int64", **dict.fromkeys(["field", "value", "region", "code", "hinted"], "object")})

    @F.pandas_udf("boolean")
    def elsewhere(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([bool(x) and osa(x, flat(y or ""), 3) > 3 for x, y in zip(a, b)])

    read = typed.select("field", "rec_id", "raw", "hint").mapInPandas(read_places, "field string, rec_id bigint, value string, region string, code string, hinted string")
    its = ("its_region", "its_code")
    towns = _aliased(entries.select("ref_id", "place", "local_name", F.col("region").alias("its_region"), F.coalesce("code", F.lit("")).alias("its_code")), ("place", "local_name"), lambda *xs: [place_form(x) for x in xs if x and place_form(x)], its)
    near = match_large(read.where("value <> ''"), towns, PLACE_SIM, loose=True)
    found = read.join(near, "value").join(towns, "alias")
    several = found.groupBy("field", "rec_id").agg((F.count_if(F.col("d") < 2) > 1).alias("several"))
    found = found.join(several, ["field", "rec_id"])
    home = F.when((F.col("code") == "") & F.col("several"), F.col("hinted")).otherwise("")
    clash = (F.col("code") != "") & (F.col("code") != F.col("its_code"))
    found = found.where(~clash | (F.col("d") == 0))  # a near name in another country is another town
    return _best(read, found, F.col("d") + 2 * clash.cast("int") + elsewhere("region", "its_region").cast("int"), F.col("its_code") != home, -F.col("sim"))


def map_nationalities(typed: DataFrame, entries: DataFrame, most: int = LIST_MOST) -> DataFrame:
    """(field, rec_id, ref_id) for each non-blank value of :func:`typed_values` rows; lists beyond ``most`` entries are joined."""
    if not fits(entries, most):
        return _nationalities_large(typed, entries)
    index, entry = nation_index(read_list(entries, "ref_id", "demonym", "country", "code"))

    def choose(raw: str, _: str | None) -> int | None:
        forms = clean_nationality(raw)
        if forms is None:
            return None
        found = [(d, pos, s, entry[name]) for pos, form in enumerate(forms) for d, s, name in index.match(form)]
        return min(found)[3] if found else 0

    return _mapped(typed, choose)


def map_places(typed: DataFrame, entries: DataFrame, nations: DataFrame, most: int = LIST_MOST) -> DataFrame:
    """(field, rec_id, ref_id) for each non-blank birth place of :func:`typed_values` rows; lists beyond ``most`` entries are joined.

    A hint is read as a nationality; where a place names no country, towns of
    one name in that country go before others.
    """
    if not fits(entries, most):
        return _places_large(typed, entries, nations)
    listed = read_list(nations, "ref_id", "demonym", "country", "code")
    codes = country_codes(listed)
    nation, nation_entry = nation_index(listed)
    nation_code = {r["ref_id"]: r["code"] for r in listed}
    towns: dict[str, list[tuple[int, str, str]]] = {}
    for r in read_list(entries, "ref_id", "place", "region", "code", "local_name"):
        for x in (r["place"], r["local_name"]):
            if x and place_form(x):
                towns.setdefault(place_form(x), []).append((r["ref_id"], flat(r["region"] or ""), r["code"] or ""))
    index = NameIndex(list(towns), PLACE_SIM, loose=True)

    def choose(raw: str, hint: str | None) -> int | None:
        place = clean_place(raw, codes)
        if place is None:
            return None
        name, region, code = place
        home = ""
        if not code and name and sum(len(towns[x]) for d, _, x in index.match(name) if d < 2) > 1:
            found = [m[0] for f in clean_nationality(hint) or () if (m := nation.match(f))]
            home = nation_code[nation_entry[min(found)[2]]] if found else ""
        best = []
        for d, s, alias in index.match(name) if name else ():
            for ref_id, its_region, its_code in towns[alias]:
                clash = bool(code) and code != its_code
                if clash and d:  # a near name in another country is another town
                    continue
                other = bool(region) and osa(region, its_region, 3) > 3
                best.append((d + 2 * clash + other, its_code != home, s, ref_id))
        return min(best)[3] if best else 0

    return _mapped(typed, choose)


def country_codes(rows: list) -> dict[str, str]:
    """Folded name -> code of a list of nations."""
    out: dict[str, str] = {}
    for r in rows:
        for x in nation_names(r["country"], r["demonym"], r["code"]):
            out.setdefault(x, r["code"])
    return out
