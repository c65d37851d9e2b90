"""Variant spellings of organisation names linked to one another.

A name is read into its parts: given name or initial, key words (family names,
coined brands, partners), and the word for its kind of business with its
abbreviations.  Three joins find the links:

1. key words that one slip of the fingers apart are brought together by a
   prefix-filtered q-gram set-similarity join over the distinct key words; a
   rare word goes to the best supported neighbour whose uses agree with it;
2. names with the same key words come together by key;
3. a name with an initial, or without a given name or partner, goes to the
   organisation of that family name whose soft weighted token similarity is
   best, where rare tokens count more than common ones.

Different founders are different organisations, even under one family name.

Defined results: null, empty and blank names give no row; a name without key
words is linked only to names of the same folded tokens; rows that repeat a
name_id are read once; ties between founders give no link; further columns
are ignored.  No group is collected whole: an organisation is a key, and
founders of one family name are at most as many as there are given names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.editdist import one_typo
from gridloom.functions.names import GIVEN_NAMES, expand_given, fold, is_given
from gridloom.llm.setjoin import jaccard_join, qgrams
from gridloom.sources.tables import checkpoint

#: kinds of business and their short forms; fixed values
KINDS = {
    "grandprix": r"grand[ -]?prix|g\.? ?p\.?(?!\w)",
    "autosport": r"auto[ -]?sp(?:ort)?s?\b\.?",
    "motorsport": r"m(?:otor)?[ -]?sports?\b",
    "racing": r"racing\b|rcg\b\.?|race\b",
    "engineering": r"engineering\b|engrg\b\.?|engg\b\.?|eng\b\.?",
    "scuderia": r"scuderia\b|scud\b\.?",
    "competition": r"competition\b|comp\b\.?",
}
_KINDS = [(kind, re.compile(rf"(?<!\w)(?:{p})")) for kind, p in KINDS.items()]
_LEGAL = re.compile(r"(?<!\w)(?:ltd|gmbh|co|inc|spa|s\.?a|ag|kg|plc|llc|team|the|equipe|ecurie)(?!\w)\.?")
_JOINERS = frozenset({"and", "und", "et", "of"})
_PARTNERS = re.compile(r"&|\+|/| and | und |,.*,")

#: q-grams of key words and the least Jaccard similarity of their sets.  One slip changes four trigrams at most on either
#: side, so where one word has ``RICH`` of them 3 of 11 are common; poorer words, short or repetitive, are joined by
#: bigrams, of which one slip changes three at most and leaves two, so 2 of 8 are common
Q, SIM, RICH = 3, 0.25, 7

#: how many times as often as its slip a word is met at least, where given names do not tell
RATIO = 2


def parse(name: str) -> tuple[str, list[str], str, bool]:
    """(given, key words sorted, kind, partners?) of a typed name.

    ``given`` is a folded given name, an initial, or empty.  An initial among
    partners stays with the key words.
    """
    f = fold(name)
    kind = ""
    for k, p in _KINDS:
        if p.search(f):
            kind = kind or k
            f = p.sub(" ", f)
    partners = bool(_PARTNERS.search(f))
    f = _LEGAL.sub(" ", f)
    words = [w for w in re.split(r"[^a-z0-9]+", f) if w and w not in _JOINERS]
    long = [w for w in words if len(w) > 1]
    if not long:
        return "", sorted(words), kind, False
    if partners and len(words) > 1:
        return "", sorted(words), kind, True
    given = ""
    rest = list(words)
    if len(words) > 1:
        known = [w for w in words if len(w) == 1 or is_given(w)]
        if known and len(known) < len(words):
            given = known[0]
            rest.remove(given)
        elif len(words) == 2:
            near = [w for w in words if len(w) > 3 and any(one_typo(w, g) for g in GIVEN_NAMES)]
            if len(near) == 1:
                given = next(g for g in sorted(GIVEN_NAMES) if one_typo(near[0], g))
                rest.remove(near[0])
    rest = [w for w in rest if len(w) > 1] or rest
    return given, sorted(rest), kind, len(rest) > 1


def agree(a: str, b: str) -> float:
    """How well two given names agree: 1 the same, 0.9 a short form, 0.7 an initial, 0.5 one missing, 0 not at all."""
    if not a or not b:
        return 0.5
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        firsts = {x[0] for x in expand_given(a)} & {x[0] for x in expand_given(b)}
        return 0.7 if firsts else 0.0
    return 0.9 if set(expand_given(a)) & set(expand_given(b)) else 0.0


def soft_score(family_weight: float, given: float, kind: float) -> float:
    """Weighted mean of token similarities; the family name weighs by its rarity, the common words less."""
    return (family_weight + 2.0 * given + 1.0 * kind) / (family_weight + 3.0)


def _parsed(df: DataFrame, id_: str, field: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, *parse(n)) for k, n in zip(b["id"], b["name"])]
            yield pd.DataFrame(out, columns=["id", "given", "keys", "kind", "partners"]).astype({"id": "int64", "partners": "bool"})

    rows = df.select(F.col(id_).cast("bigint").alias("id"), F.col(field).cast("string").alias("name")).where(F.col("id").isNotNull() & F.col("name").rlike(r"(?U)[\p{L}\p{N}]")).dropDuplicates(["id"])
    return rows.mapInPandas(run, "id bigint, given string, keys array<string>, kind string, partners boolean")


def slips(words: DataFrame) -> DataFrame:
    """(ida, idb), ``ida < idb``: all pairs of the distinct words of four letters or more that are one slip apart."""
    sets = words.select(F.col("word").alias("id"), qgrams("word", Q).alias("toks"))
    poor = sets.where(F.size("toks") < RICH).select("id", qgrams("id", Q - 1).alias("toks"))
    pairs = jaccard_join(sets, None, SIM).unionByName(jaccard_join(poor, None, SIM)).where(F.abs(F.length("ida") - F.length("idb")) <= 1)

    @F.pandas_udf("boolean")
    def slip(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one_typo(x, y) for x, y in zip(a, b)])

    near = pairs.select("ida", "idb").where(F.levenshtein("ida", "idb", 2) >= 0)  # a swap counts two there; few pairs reach Python
    return near.distinct().where(slip("ida", "idb"))


def canonical_words(parsed: DataFrame) -> DataFrame:
    """(word, root): each key word that is a slip of a better supported one, and that one.

    The neighbour must share the kind of business where both are known.  A
    word met in one or two names says little for itself and goes to any better
    supported neighbour; a word met more often goes to one whose people share a
    given name with it, or, where that tells nothing, to one that is met, or
    leads to a word met, at least ``RATIO`` times as often.  Words with
    different people stand for themselves.
    """
    uses = parsed.select("id", "kind", "given", F.explode("keys").alias("word")).where(F.length("word") > 3)
    words = uses.groupBy("word").agg(
        F.countDistinct("id").alias("n"),
        F.collect_set(F.when(F.col("kind") != "", F.col("kind"))).alias("kinds"),  # at most one per kind
        F.collect_set(F.when(F.length("given") > 0, F.col("given"))).alias("givens"),  # names, short forms and initials: bounded
    )
    words = checkpoint(words, parsed.sparkSession)
    pairs = slips(words.select("word"))
    both = pairs.select(F.col("ida").alias("word"), F.col("idb").alias("other")).unionByName(pairs.select(F.col("idb").alias("word"), F.col("ida").alias("other")))
    w, o = words.select("word", "n", "kinds", "givens"), words.select(F.col("word").alias("other"), F.col("n").alias("on"), F.col("kinds").alias("okinds"), F.col("givens").alias("ogivens"))
    met = both.join(w, "word").join(o, "other")
    free = lambda a, b: (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)

    @F.pandas_udf("double")
    def people(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([max((agree(x, y) for x in g for y in h), default=0.5) for g, h in zip(a, b)], dtype="float64")

    met = met.where(free("kinds", "okinds")).withColumn("people", people("givens", "ogivens"))
    met = checkpoint(met.select("word", "other", "n", "on", "people"), parsed.sparkSession)
    # of two words met as often, the one with more neighbours is the likelier root
    degree = met.groupBy("word").agg(F.count("*").alias("deg"), F.max("on").alias("reach"))
    met = met.join(degree.select("word", "deg"), "word").join(degree.select(F.col("word").alias("other"), F.col("deg").alias("odeg"), "reach"), "other")
    backed = F.greatest("on", "reach") >= F.col("n") * RATIO  # the neighbour may be a slip of the word so often met
    met = met.where((F.col("n") <= 2) | (F.col("people") >= 0.9) | ((F.col("people") > 0) & backed))
    mine, its = F.struct("n", "deg", "other"), F.struct("on", "odeg", "word")  # the smaller word wins the last tie
    met = met.where(mine < its)
    return met.groupBy("word").agg(F.min(F.struct((-F.col("on")).alias("n"), (-F.col("odeg")).alias("deg"), "other")).alias("m")).select("word", F.col("m.other").alias("root"))


def link(df: DataFrame, id_: str = "name_id", field: str = "team_name") -> DataFrame:
    """(id, org, confidence): the organisation key of every name."""
    spark = df.sparkSession
    parsed = checkpoint(_parsed(df, id_, field), spark)
    roots = checkpoint(canonical_words(parsed), spark)
    # slips of slips: hops are doubled until every word is at its supported one; support grows with each hop, so there is no ring
    more = True
    while more:
        far = roots.alias("a").join(roots.alias("b"), F.col("a.root") == F.col("b.word"), "left").select(F.col("a.word").alias("word"), F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved"))
        roots = checkpoint(far, spark)
        more = not roots.where("moved").isEmpty()
        roots = roots.drop("moved")
    words = parsed.select("id", F.posexplode("keys").alias("pos", "word")).join(roots, "word", "left")
    keys = words.groupBy("id").agg(F.array_sort(F.collect_list(F.coalesce("root", "word"))).alias("keys"))
    names = parsed.drop("keys").join(keys, "id", "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
    names = checkpoint(names, spark)
    single = F.size("keys") == 1

    # partners: an initial stands for the partner of that letter in the firm that shares the other names
    firms = names.where("partners")
    whole = firms.where(~F.exists("keys", lambda k: F.length(k) == 1))
    known = whole.select("keys", "kind").distinct().select("keys", "kind", F.explode("keys").alias("shared"))
    part = firms.where(F.exists("keys", lambda k: F.length(k) == 1))
    open_ = part.select("id", "kind", "keys", F.explode(F.filter("keys", lambda k: F.length(k) > 1)).alias("shared"))
    fit = open_.alias("p").join(known.alias("f"), "shared").where((F.size("p.keys") == F.size("f.keys")) & ((F.col("p.kind") == F.col("f.kind")) | (F.col("p.kind") == "") | (F.col("f.kind") == "")))
    fit = fit.where(F.forall("p.keys", lambda k: F.exists("f.keys", lambda g: F.when(F.length(k) == 1, F.substring(g, 1, 1) == k).otherwise(g == k))))
    fit = fit.groupBy("id").agg(F.min(F.array_join("f.keys", " ")).alias("org"), F.countDistinct("f.keys").alias("n")).where("n = 1")
    firm = whole.select("id", F.concat(F.lit("f:"), F.array_join("keys", " ")).alias("org"), F.lit(1.0).alias("confidence"))
    rest = part.join(fit, "id", "left").select("id", F.concat(F.lit("f:"), F.coalesce("org", F.array_join("keys", " "))).alias("org"), F.when(F.col("org").isNotNull(), 0.8).otherwise(1.0).alias("confidence"))

    # people and brands share a family name or a brand
    one = names.where(~F.col("partners")).withColumn("family", F.when(single, F.col("keys")[0]).otherwise(F.array_join("keys", " ")))
    support = one.groupBy("family").agg(F.count("*").alias("n"))
    founders = one.where(F.length("given") > 1).groupBy("family", "given", "kind").agg(F.count("*").alias("n"))
    founders = founders.groupBy("family").agg(F.collect_list(F.struct("given", "kind", "n")).alias("founders"))
    total = one.agg(F.count("*").alias("total"))
    seen = one.join(support, "family").join(founders, "family", "left").crossJoin(F.broadcast(total))  # one row

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            org, sure = [], []
            for family, given, kind, found, n, total_ in zip(b["family"], b["given"], b["kind"], b["founders"], b["n"], b["total"]):
                if found is None or len(found) == 0:
                    org.append(f"b:{family}")
                    sure.append(1.0)
                    continue
                people: dict[str, set[str]] = {}
                weight: dict[str, int] = {}
                for x in found:
                    people.setdefault(x["given"], set()).add(x["kind"])
                    weight[x["given"]] = weight.get(x["given"], 0) + x["n"]
                main = {g: _main_form(g, people, weight) for g in people}
                rarity = math.log(1 + total_ / n)
                best: dict[str, float] = {}
                for g, kinds in people.items():
                    a = agree(given, g)
                    k = 0.5 if not kind or kinds <= {""} else 1.0 if kind in kinds else 0.0
                    if a == 0.0 or (k == 0.0 and a < 0.9):
                        continue
                    s = soft_score(rarity, a, k)
                    best[main[g]] = max(best.get(main[g], 0.0), s)
                order = sorted(best.items(), key=lambda x: -x[1])
                if order and (len(order) == 1 or order[0][1] > order[1][1] + 1e-9):
                    org.append(f"p:{family}|{order[0][0]}")
                    sure.append(order[0][1])
                else:
                    org.append(f"p:{family}|{given}|{kind}" if given else f"b:{family}|{kind}")
                    sure.append(1.0)
            yield pd.DataFrame({"id": b["id"], "org": org, "confidence": sure})

    people = seen.select("id", "family", "given", "kind", "founders", "n", "total").mapInPandas(settle, "id bigint, org string, confidence double")
    return firm.unionByName(rest).unionByName(people)


def _main_form(given: str, people: dict[str, set[str]], weight: dict[str, int]) -> str:
    """The full given name that a short form stands for within a family; the form itself where none fits."""
    kin = [g for g in people if g != given and agree(given, g) == 0.9 and (people[g] & people[given] or {""} in (people[g], people[given]) or "" in people[g] | people[given])]
    full = [g for g in [given, *kin] if g in GIVEN_NAMES]
    if given in GIVEN_NAMES or not full:
        return given
    return max(full, key=lambda g: (weight[g], g))


def pairs(linked: DataFrame) -> DataFrame:
    """(name_id_a, name_id_b) of every two names of one organisation, smaller id first."""
    linked = checkpoint(linked.select("org", "id"), linked.sparkSession)
    a = linked.select("org", F.col("id").alias("name_id_a"))
    b = linked.select("org", F.col("id").alias("name_id_b"))
    return a.join(b, "org").where("name_id_a < name_id_b").select("name_id_a", "name_id_b")


def classes(linked: DataFrame) -> DataFrame:
    """One row per name: its class id (the smallest id of the organisation) and its number of links."""
    w = Window.partitionBy("org")
    return linked.select("id", F.min("id").over(w).alias("class_id"), (F.count("*").over(w) - 1).alias("links"), F.round("confidence", 4).alias("confidence"))
