"""A query specification as one DataFrame plan over the index tables.

Scoring is BM25 per field with the field's boost.  A word may match several
fields; its matches add up.  With OR a document needs one word, with AND every
word.  Range filters must hold and add 1 each.  Fuzzy words match terms within
one edit (words of less than five characters) or two, where a swap of
neighbouring characters is one edit; an edit lowers the score
by ``edits / length of the shorter``; each word keeps at most ``EXPANSIONS``
terms per field, the nearest first.  When the search is exact, a word with
``*`` or ``?`` is a pattern, and ``field:word``, ``+word``, ``-word``,
``word~1`` and ``word^2`` are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.values import shortened, shown
from gridloom.operators.index import BLANK_FIELDS, Index
from gridloom.plans.query import QuerySpec

K1, B = 1.2, 0.75
EXPANSIONS = 50


def edits(word: str) -> int:
    return 1 if len(word) < 5 else 2


def swapped(word: str, most: int) -> dict[str, int]:
    """The word and what up to ``most`` swaps of neighbouring characters make of it, with the number of swaps."""
    out, last = {word: 0}, [word]
    for n in range(1, most + 1):
        last = [w[:i] + w[i + 1] + w[i] + w[i + 2 :] for w in last for i in range(len(w) - 1)]
        for w in last:
            out.setdefault(w, n)
    return out


def exact_terms(word: str, field: str) -> list[str]:
    """A query word as the field's analyser cuts it."""
    low = word.lower()
    return [low] if field in BLANK_FIELDS else re.findall(r"\w+", low)


@dataclass(frozen=True)
class ExactWord:
    """A word of an exact search: its text, the fields it is looked for in with their factors, and the edits allowed."""

    text: str
    fields: dict[str, float]
    edits: int = 0


def exact_word(word: str, boosts: dict[str, float]) -> ExactWord | None:
    """Read ``[+]  [field:] text [~n] [^factor]``; None for ``-text`` and ``!text``, which alone match nothing.

    A field named there is searched for every field of the search, so its
    factor is the sum of all boosts; an unknown field matches nothing.
    Brackets, quotes and what else the grammar has none of are no letters, so
    the analyser drops them.
    """
    if word[:1] in ("-", "!"):
        return None
    word, factor, most = word.lstrip("+"), 1.0, 0
    if m := re.fullmatch(r"(.+)\^(\d+(?:\.\d+)?)", word):
        word, factor = m[1], float(m[2])
    if m := re.fullmatch(r"(.+)~(\d?)", word):
        word, most = m[1], min(2, int(m[2] or 2))
    fields = boosts
    if m := re.fullmatch(r"([A-Za-z_]\w*):(.+)", word):
        word, fields = m[2], {m[1].lower(): sum(boosts.values())}
    return ExactWord(word, {f: b * factor for f, b in fields.items()}, most)


def _exact(spec: QuerySpec) -> list[tuple[int, ExactWord]]:
    return [(w, e) for w, word in enumerate(spec.words) if (e := exact_word(word, spec.boosts))]


def literal_terms(spec: QuerySpec) -> list[str] | None:
    """All terms that an exact search without patterns can hit, so that scans of the index read little else; else None."""
    words = _exact(spec)
    if spec.fuzzy or any(e.edits or "*" in e.text or "?" in e.text for _, e in words):
        return None
    return sorted({t for _, e in words for f in e.fields for t in exact_terms(e.text, f)})


def _patterns(word: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in word.lower()) + "$"


def _of_query(table: DataFrame, spec: QuerySpec) -> DataFrame:
    """The rows of a table by field and term that a query may need; both filters reach the scan."""
    fields = set(spec.boosts) if spec.fuzzy else {f for _, e in _exact(spec) for f in e.fields}
    table = table.where(F.col("field").isin(*sorted(fields)))
    terms = literal_terms(spec)
    return table if terms is None else table.where(F.col("term").isin(*terms))


def pieces(word: str, most: int) -> list[str]:
    """``most + 1`` pieces of a word, one of which stands unchanged in whatever ``most`` edits make of it; none for short words."""
    if len(word) <= most:
        return []
    cuts = [round(i * len(word) / (most + 1)) for i in range(most + 2)]
    return [word[a:b] for a, b in zip(cuts, cuts[1:])]


def _near_rows(w: int, word: str, most: int, field: str, boost: float) -> list[tuple]:
    return [(w, field, v, most, boost, n, pieces(v, most - n)) for v, n in swapped(word.lower(), most).items()]


def word_terms(index: Index, spec: QuerySpec) -> DataFrame:
    """(w, field, term, df, factor): the terms of the vocabulary that each word of the query means."""
    spark = index.doc.sparkSession
    plain, patterns, near = [], [], []
    if spec.fuzzy:
        near = [r for w, word in enumerate(spec.words) for f, b in spec.boosts.items() for r in _near_rows(w, word, edits(word), f, b)]
    else:
        for w, e in _exact(spec):
            for field, boost in e.fields.items():
                if e.edits:
                    near += [r for t in exact_terms(e.text, field) for r in _near_rows(w, t, e.edits, field, boost)]
                elif "*" in e.text or "?" in e.text:
                    patterns.append((w, field, _patterns(e.text), boost))
                else:
                    plain += [(w, field, t, boost) for t in exact_terms(e.text, field)]
    vocabulary = _of_query(index.term_stats, spec)
    columns = ("w", "field", "term", "df", "factor")
    out = vocabulary.limit(0).select(F.lit(0).alias("w"), "field", "term", "df", F.lit(0.0).alias("factor"))
    # the words of one query times fields are broadcast below
    if plain:
        want = F.broadcast(spark.createDataFrame(plain, "w int, field string, word string, factor double"))
        out = out.unionByName(vocabulary.join(want, "field").where("term = word").select(*columns))
    if patterns:
        like = F.broadcast(spark.createDataFrame(patterns, "w int, field string, pattern string, factor double"))
        out = out.unionByName(vocabulary.join(like, "field").where(F.expr("term rlike pattern")).select(*columns))
    if near:
        want = F.broadcast(spark.createDataFrame(near, "w int, field string, word string, most int, boost double, swaps int, pieces array<string>"))
        left = F.col("most") - F.col("swaps")
        met = vocabulary.join(want, "field").where(F.abs(F.length("term") - F.length("word")) <= left)
        met = met.where((F.size("pieces") == 0) | F.exists("pieces", lambda p: F.contains("term", p)))  # exact: no term within the edits lacks all pieces
        met = met.withColumn("d", F.levenshtein("term", "word", 2)).where((F.col("d") >= 0) & (F.col("d") <= left)).withColumn("d", F.col("d") + F.col("swaps"))
        met = met.groupBy("w", "field", "term", "df", "boost").agg(F.min("d").alias("d"), F.first(F.length("word")).alias("length"))
        met = met.withColumn("factor", F.col("boost") * (1 - F.col("d") / F.least(F.length("term"), F.col("length")))).where("factor > 0")
        best = Window.partitionBy("w", "field").orderBy("d", "term")
        out = out.unionByName(met.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= EXPANSIONS).select(*columns))
    return out


def scores(index: Index, spec: QuerySpec) -> DataFrame:
    """(doc_key, score) of the documents that the words match."""
    terms = word_terms(index, spec)
    hits = _of_query(index.posting, spec).join(terms, ["field", "term"]).join(F.broadcast(index.field_stats), "field")  # one row per field
    idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    per_word = hits.groupBy("doc_key", "w").agg(F.sum(F.col("factor") * idf * F.col("tf") / norm).alias("s"))
    total = per_word.groupBy("doc_key").agg(F.sum("s").alias("score"), F.count("*").alias("n"))
    if not spec.use_or:
        total = total.where(F.col("n") == len(spec.words))
    return total.select("doc_key", "score")


def matches(index: Index, spec: QuerySpec) -> DataFrame:
    """Every matching document with its score: filters on the documents, joined with the scored words."""
    docs = index.doc
    for r in spec.ranges:
        docs = docs.where(F.col(r.field).between(r.low, r.high))
    if not spec.words:
        return docs.withColumn("score", F.lit(float(len(spec.ranges))))
    return docs.join(scores(index, spec), "doc_key").withColumn("score", F.col("score") + len(spec.ranges))


def search(index: Index, spec: QuerySpec) -> DataFrame:
    """The best ``k`` documents (all where ``k`` is None) with their rank; ties go to the smaller key.

    With ``sort_by`` the field decides, descending, and there is no score.
    """
    found = matches(index, spec)
    order = [F.desc(spec.sort_by), F.asc("doc_key")] if spec.sort_by else [F.desc(F.round("score", 4)), F.asc("doc_key")]
    if spec.sort_by:
        found = found.withColumn("score", F.lit(None).cast("double"))
    if spec.k is not None:
        found = found.orderBy(*order).limit(spec.k)  # one top-k step, no full sort
    return found.withColumn("rank", F.row_number().over(Window.orderBy(*order))) if spec.k is not None else found


def total_hits(index: Index, spec: QuerySpec) -> DataFrame:
    """The exact number of matching documents."""
    return matches(index, spec).agg(F.count("*").alias("hits"))


def display(found: DataFrame) -> DataFrame:
    """Result lines with the defaults that a reader sees."""
    teams = shown("teams_wiki", *(["former_teams_wiki"] if "former_teams_wiki" in found.columns else []), default="none")
    return found.select(
        "doc_key", shown("driver_name", default="Unknown").alias("name"), shown("birth_date_wiki", "birth_date", default="unknown").alias("birth"),
        shown("birth_place_wiki", default="unknown").alias("place"), shown("nationality_wiki", default="unknown").alias("nationality"), shortened(teams).alias("teams"),
        *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("wins", "podiums", "championships", "starts", "poles")),
    )
