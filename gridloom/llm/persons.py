"""Matching people across two sources that share no key.

Names become fixed bit vectors of their padded bigrams.  Close pairs are found
exactly by multi-index hashing: a 64-bit vector is cut into one piece more
than the radius has bits, and two vectors within the radius agree on one piece
at least, so an equality join on (block, piece number, piece) loses no such
pair.  Blocks are what the two records must share anyway in one of these ways:
the whole birth date, with family names or with given names close; the first
letter and the birth year; the first letter and the nation, where a birth year
is missing; the whole name, where a date is wrong.  Candidates are scored
field by field with Dice similarities, the weighted score is turned into a
confidence by a calibrated logistic curve.

Defined results: null and blank names match nothing; a missing date or
nationality neither supports nor contradicts; several pages or articles of
one person give every combination; rows that repeat a key are read once; ties
are all kept; further columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.editdist import osa
from gridloom.functions.names import expand_given, fold, is_given
from gridloom.llm.canonical import NameIndex, clean_nationality, nation_index, read_list
from gridloom.sources.tables import checkpoint, spread

BITS = 64
RADIUS = 7  # bits; one slip changes 6 at most
WIDE = 12  # bits of the family name, within one whole birth date: two slips
GIVEN = 6  # bits of the given name, within one whole birth date: one slip

MONTHS = {m: i // 2 + 1 for i, m in enumerate("january jan february feb march mar april apr may may june jun july jul august aug september sep october oct november nov december dec".split())} | {"sept": 9}

_PAREN = re.compile(r"\(([^()]*)\)")
_NOT_PERSON = re.compile(r"^(?:list of|\d{4}\b)|\(disambiguation\)|\b(?:circuit|grand prix|g\.p\.|motorsports?|msport|racing ltd|autosport|scuderia|engineering)$|&", re.I)


def vector(text: str) -> int:
    """The bigrams of a folded word as bits of a signed 64-bit number."""
    padded = f"^{text}$"
    v = 0
    for i in range(len(padded) - 1):
        v |= 1 << (zlib.crc32(padded[i : i + 2].encode()) % BITS)
    return v - (1 << 64) if v >> 63 else v


def dice(a: int, b: int) -> float:
    a, b = a & (2**64 - 1), b & (2**64 - 1)
    both = a.bit_count() + b.bit_count()
    return 2 * (a & b).bit_count() / both if both else 0.0


def parse_name(name: str | None) -> tuple[str, str, int]:
    """(family name, given name or initial, birth year of a note) of a typed name; empty where there is none."""
    if name is None:
        return "", "", 0
    year = 0
    for note in _PAREN.findall(name):
        if m := re.search(r"\b(1[89]\d\d|20\d\d)\b", note):
            year = int(m[1])
    text = re.sub(r"\s+", " ", _PAREN.sub(" ", name.replace("_", " "))).strip(" ,")
    if not text:
        return "", "", year
    if "," in text:
        family, _, given = text.partition(",")
        words, given_words = family.split(), given.split()
        family = words[-1] if words else ""
    else:
        words = text.split()
        first, last = words[0], words[-1]
        if len(words) == 1:
            family, given_words = first, []
        elif len(first) > 2 and first.isupper() and not text.isupper():
            family, given_words = first, words[1:]
        elif len(fold(last).strip(".")) == 1 or (is_given(fold(last)) and not is_given(fold(first)) and len(fold(first).strip(".")) > 1):
            family, given_words = first, words[1:]
        else:
            family, given_words = last, words[:-1]
    clean = lambda w: re.sub(r"[^a-z]", "", fold(w))
    return clean(family), clean(given_words[0]) if given_words else "", year


_YMD = re.compile(r"\b(\d{4})[-/.|](\d{1,2})[-/.|](\d{1,2})\b")
_DMY = re.compile(r"\b(\d{1,2})[./-](\d{1,2})[./-](\d{4})\b")
_DMONY = re.compile(r"\b(\d{1,2})(?:st|nd|rd|th)?\.?\s+([A-Za-z]+)\.?,?\s+(\d{4})\b")
_MONDY = re.compile(r"\b([A-Za-z]+)\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})\b")
_MONY = re.compile(r"\b([A-Za-z]+)\.?,?\s+(\d{4})\b")
_YM = re.compile(r"\b(\d{4})[-/|](\d{1,2})\b")
_Y = re.compile(r"(?<!\d)(1[89]\d\d|20\d\d)(?!\d)")


def parse_date(text: str | None) -> tuple[int, int, int]:
    """(year, month, day), 0 for what is not known."""
    if not text:
        return 0, 0, 0
    t = re.sub(r"<ref\b.*?(?:/>|</ref>)|\|?\s*[md]f\s*=\s*\w+\s*", "", text, flags=re.S)
    t = re.sub(r"\s*\|\s*", "|", t)

    def ok(y: int, m: int, d: int) -> tuple[int, int, int]:
        return (y, m, d) if 1 <= m <= 12 and 1 <= d <= 31 else (y, 0, 0)

    if m := _YMD.search(t):
        return ok(int(m[1]), int(m[2]), int(m[3]))
    if m := _DMY.search(t):
        return ok(int(m[3]), int(m[2]), int(m[1]))
    if (m := _DMONY.search(t)) and m[2].lower() in MONTHS:
        return ok(int(m[3]), MONTHS[m[2].lower()], int(m[1]))
    if (m := _MONDY.search(t)) and m[1].lower() in MONTHS:
        return ok(int(m[3]), MONTHS[m[1].lower()], int(m[2]))
    if (m := _MONY.search(t)) and m[1].lower() in MONTHS:
        return int(m[2]), MONTHS[m[1].lower()], 0
    if m := _YM.search(t):
        return (int(m[1]), int(m[2]), 0) if 1 <= int(m[2]) <= 12 else (int(m[1]), 0, 0)
    if m := _Y.search(t):
        return int(m[1]), 0, 0
    return 0, 0, 0


_INLINE = re.compile(r"<!--.*?-->|<ref\b[^<>]*/>|<ref\b.*?</ref>|</?[A-Za-z][^<>]*>|\\(?:emph|textbf|textit|textsc|underline)\{|\\href\{[^{}]*\}\{|\{\\(?:bf|it)\s|\{\{nowrap\|"
                     r"|\[\[[^\[\]|]*\||\[https?://\S+ |\]\([^()]*\)|'{2,}|[*~{}\[\]]{1,3}|(?<![\w])_{1,2}|_{1,2}(?![\w])", re.S)  # fmt: skip
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n")
#: a stop ends a sentence after a word of three letters or more, and after a number unless a month follows
_STOP = re.compile(rf"(?<=[a-z]{{3}})[.!?](?=\s)|(?<=\d)[.!?](?=\s+(?!(?i:{'|'.join(MONTHS)})\b)[A-Z])")
_BORN = re.compile(r"\bborn\b[^()]*?(?:\d{4})")
_NATION = re.compile(r"\b(?:is|was) an? ((?:[A-Z][\w-]+\s?){1,3}?)\s*(?:racing|race|formula|rally|former)?\s*driver")


def facts(text: str | None) -> tuple[str, str]:
    """(birth date, nationality) as the running text of an article states them; whole sentences of the whole text are searched."""
    if not text:
        return "", ""
    born = nation = ""
    for part in _PARAGRAPH.split(text):
        dated, named = not born and "born" in part, not nation and "driver" in part
        if not dated and not named:
            continue
        plain = re.sub(r"\s+", " ", html.unescape(_INLINE.sub("", part)).replace("~", " "))
        if named and (m := _NATION.search(plain)):
            nation = m[1].strip()
        at = plain.find("born") if dated else -1
        while at >= 0:
            stop = _STOP.search(plain, at)
            if (m := _BORN.match(plain, at, stop.start() if stop else len(plain))) and parse_date(m[0])[0]:
                born = m[0]
                break
            at = plain.find("born", at + 4)
        if born and nation:
            break
    return born, nation


def given_score(a: str, b: str) -> float:
    """Agreement of two given names: same 1, slip 0.9, short form 0.85, initial 0.7, one missing 0.5, else 0."""
    if not a or not b:
        return 0.5
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.7 if {x[0] for x in expand_given(a)} & {x[0] for x in expand_given(b)} else 0.0
    if set(expand_given(a)) & set(expand_given(b)):
        return 0.85
    near = min(osa(x, y, 3) for x in expand_given(a) for y in expand_given(b))
    short = min(len(a), len(b))
    return 0.9 if near == 1 else 0.75 if near == 2 and short >= 4 else 0.7 if near == 3 and short >= 7 else 0.0


def date_score(a: tuple[int, int, int], b: tuple[int, int, int]) -> float:
    """Agreement of two dates: whole 1, month 0.9, year 0.8, missing 0.5, one part wrong 0.4, days and months swapped 0.8, else 0."""
    if not a[0] or not b[0]:
        return 0.5
    parts = [x == y for x, y in zip(a, b) if x and y]
    if all(parts):
        return (0.8, 0.9, 1.0)[len(parts) - 1]
    if len(parts) == 3:
        if a[0] == b[0] and (a[1], a[2]) == (b[2], b[1]):
            return 0.8
        if sum(parts) == 2:
            return 0.4
    return 0.0


WEIGHTS = {"family": 4.0, "given": 2.0, "date": 3.5, "nation": 1.0}
#: logistic curve set to the share of true pairs at each score on sf0.1, estimated from nationality held out (README)
SLOPE, MIDDLE = 200.0, 0.748


def weighted(family: float, given: float, date: float, nation: float) -> float:
    w = WEIGHTS
    return (w["family"] * family + w["given"] * given + w["date"] * date + w["nation"] * nation) / sum(w.values())


def confidence(score: float) -> float:
    return 1.0 / (1.0 + math.exp(-SLOPE * (score - MIDDLE)))


FIELDS = "family string, given string, initials array<string>, y int, m int, d int, nation bigint, sv bigint, gvs array<bigint>"


def _nation_id(index: NameIndex, entry: dict[str, int], *raws: str | None) -> int:
    for raw in raws:
        for form in clean_nationality(raw) or ():
            if hit := index.match(form):
                return entry[hit[0][2]]
    return 0


def _records(df: DataFrame, id_type: str, nations: DataFrame, article: bool) -> DataFrame:
    """(id, family, given, date, nation, vector) of (id, name, date, nationality[, text]) rows; ``initials`` is '?' where the given name is missing."""
    index, entry = nation_index(read_list(nations, "ref_id", "demonym", "country", "code"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, name, date, nation, text in zip(b["id"], b["name"], b["date"], b["nationality"], b["text"]):
                if name is None or (article and _NOT_PERSON.search(name.strip())):
                    continue
                family, given, year = parse_name(name)
                if not family:
                    continue
                when = parse_date(date)
                said = ""
                if article:
                    born, said = facts(text)
                    own = parse_date(born)
                    if sum(map(bool, own)) > sum(map(bool, when)) and (not when[0] or own[0] == when[0]):
                        when = own
                if not when[0] and year:
                    when = (year, 0, 0)
                initials = sorted({x[0] for x in expand_given(given)}) if given else ["?"]
                out.append((i, family, given, initials, *when, _nation_id(index, entry, nation, said), vector(family), sorted({vector(g) for g in expand_given(given)}) if len(given) > 1 else []))
            yield pd.DataFrame(out, columns=["id", "family", "given", "initials", "y", "m", "d", "nation", "sv", "gvs"]).astype({"family": "object", "given": "object", "y": "int32", "m": "int32", "d": "int32", "nation": "int64", "sv": "int64"})

    return df.mapInPandas(run, f"id {id_type}, {FIELDS}")


def _piece_keys(when: Column, far: int, bits: Column, *block: Column) -> list[Column]:
    """A struct (key, far, bits) for each of the ``far + 1`` pieces of a vector within a block, null where ``when`` is false."""
    width = -(-BITS // (far + 1))
    pieces = (F.shiftrightunsigned(bits, i * width).bitwiseAND(F.lit((1 << width) - 1)) for i in range(far + 1))
    return [_key(when, far, bits, *block, F.lit(i), p) for i, p in enumerate(pieces)]


def _key(when: Column, far: int, bits: Column, *parts: Column) -> Column:
    return F.when(when, F.struct(F.xxhash64(*parts).alias("key"), F.lit(far).cast("tinyint").alias("far"), bits.alias("bits")))


def _keys(rows: DataFrame, side: str) -> DataFrame:
    """(id, key, far, bits): hashed join keys of every record with the radius and the vector of each, see the module's text.

    Two keys of one hash only add candidates, which are scored like all
    others.  No higher-order functions, so all of it is compiled.
    """
    y, sv, nation = F.col("y"), F.col("sv"), F.col("nation")
    dated = (y > 0) & (F.col("m") > 0) & (F.col("d") > 0)
    date = y * 10_000 + F.col("m") * 100 + F.col("d")
    mine, other = ("m", "n") if side == "a" else ("n", "m")

    def keyed(df: DataFrame, keys: list[Column]) -> DataFrame:
        return df.select(F.col("id").alias(f"id_{side}"), F.inline(F.array(*keys))).where("key is not null")

    whole = _piece_keys(dated, WIDE, sv, F.lit("b"), date)
    same = _key(F.length("given") > 1, RADIUS, sv, F.lit("x"), F.col("family"), F.col("given"))
    by_name = keyed(rows, [*whole, same])
    by_given = keyed(rows.where(dated).select("id", date.alias("date"), F.explode("gvs").alias("g")), _piece_keys(F.lit(True), GIVEN, F.col("g"), F.lit("g"), F.col("date")))
    # no year on one side: the nation must agree or be unknown on one side, else no score suffices
    known, undated, i = nation > 0, y == 0, F.col("i")
    keys = _piece_keys(y > 0, RADIUS, sv, F.lit("e"), i, y)
    for owner, who in ((mine, undated), (other, F.lit(True))):
        own = owner == mine
        keys += _piece_keys(who & known, RADIUS, sv, F.lit(owner), i, nation)
        keys += _piece_keys(who & known if own else ~known, RADIUS, sv, F.lit(f"{owner}z"), i)
        keys += _piece_keys(who & ~known if own else F.lit(True), RADIUS, sv, F.lit(f"{owner}a"), i)
    # an initial on one side: all names of that letter and date on the other
    keys += [_key(dated & (F.length("given") == 1), BITS, sv, F.lit(f"{mine}i"), i, date), _key(dated, BITS, sv, F.lit(f"{other}i"), i, date)]
    by_initial = keyed(rows.withColumn("i", F.explode("initials")), keys)
    return by_name.unionByName(by_given).unionByName(by_initial).withColumnRenamed("bits", f"bits_{side}")


LEAST = 0.01  # the blocks lose no pair of this confidence or more for a clashing nation


def match(left: DataFrame, right: DataFrame, nations: DataFrame, id_type: str = "string", least: float = 0.5) -> DataFrame:
    """(id_a, id_b, confidence) of the pairs with a confidence of ``least`` or more, which is ``LEAST`` at least.

    ``left`` has id, name, date, nationality; ``right`` also text, searched
    for the date and nationality that its data fields lack.  The records read
    from both are short and are kept, as keys and scores need them.
    """
    if least < LEAST:
        raise ValueError(f"the blocks find the pairs of confidence {LEAST} or more")
    spark = left.sparkSession
    a = _records(left.select("id", "name", "date", "nationality", F.lit(None).cast("string").alias("text")), id_type, nations, article=False)
    b = _records(spread(right.select("id", "name", "date", "nationality", "text")), "bigint", nations, article=True)
    a, b = checkpoint(a, spark), checkpoint(b, spark)
    close = F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= F.col("far")
    cand = _keys(a, "a").join(_keys(b, "b"), ["key", "far"]).where(close).select("id_a", "id_b").distinct()
    cols = ("family", "given", "y", "m", "d", "nation", "sv")
    full = cand.join(a.select(F.col("id").alias("id_a"), *(F.col(c).alias(f"a_{c}") for c in cols)), "id_a").join(b.select(F.col("id").alias("id_b"), *(F.col(c).alias(f"b_{c}") for c in cols)), "id_b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            scores = []
            for r in p.itertuples(index=False):
                scores.append(confidence(pair_score(r)))
            yield pd.DataFrame({"id_a": p["id_a"], "id_b": p["id_b"], "confidence": scores})

    return full.mapInPandas(run, f"id_a {id_type}, id_b bigint, confidence double").where(F.col("confidence") >= least)


def pair_score(r) -> float:
    """Weighted Dice score of a candidate pair; 0 where the family names are not one word with slips."""
    d = 0 if r.a_family == r.b_family else osa(r.a_family, r.b_family, 5)
    given = given_score(r.a_given, r.b_given)
    date = date_score((r.a_y, r.a_m, r.a_d), (r.b_y, r.b_m, r.b_d))
    nation = 0.5 if not r.a_nation or not r.b_nation else float(r.a_nation == r.b_nation)
    if d > 2 or (d == 2 and min(len(r.a_family), len(r.b_family)) < 8):
        # slips on both sides, or a name cut short: all else must agree
        most = 5 if min(len(r.a_family), len(r.b_family)) >= 8 else 3
        initial = given == 0.7 and nation == 1.0 and d < most and 1 in (len(r.a_given), len(r.b_given))
        if date < 1.0 or nation == 0.0 or d > most or (given < 0.85 and not initial):
            return 0.0
    if given == 0.0:  # brothers and sisters share family, nation and sometimes the date
        return 0.0
    return weighted(max(dice(r.a_sv, r.b_sv), 1 - 0.1 * d), given, date, nation)  # five slips count as one half
