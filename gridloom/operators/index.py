"""Typed documents, postings and statistics: the tables that a search reads.

``doc`` has one row per document, ``posting`` one per (field, term, document)
with the term's count and the field's length, ``term_stats`` and
``field_stats`` the counts that scoring needs.  ``save`` writes them as
parquet, postings partitioned by field and sorted by term, so a query reads
only the row groups of its words.  ``register_views`` names the tables for SQL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.common import as_col
from gridloom.functions.values import birth_timestamp, number_value, stat_text, text_value, to_int
from gridloom.functions.text import blank_to_null

#: text fields (fixed values): name -> (wiki column, base column or none)
TEXT_FIELDS = {
    "birth_place_wiki": ("birth_place_wiki", "birth_place"), "nationality_wiki": ("nationality_wiki", "nationality"),
    "driver_name": ("driver_name", None), "teams_wiki": ("teams_wiki", None), "former_teams_wiki": ("former_teams_wiki", None),
    "car_number_wiki": ("car_number_wiki", None), "birth_date_wiki": ("birth_date_wiki", None), "birth_date": ("birth_date", None), "biography": ("first_1000_words", None),
}
#: numeric fields (fixed values): name -> (wiki column, base column)
NUMBER_FIELDS = {
    "wins": ("wins_wiki", "wins"), "podiums": ("podiums_wiki", "podiums"), "poles": ("pol_positions_wiki", "poles"),
    "starts": ("entries_wiki", "starts"), "fastest_laps": ("fastest_laps_wiki", "fastest_laps"), "championships": ("championships_wiki", None),
}
#: fields cut at blanks only; all others are cut at everything that is no letter or digit
BLANK_FIELDS = frozenset({"birth_date", "birth_date_wiki"})
KEY = "driver_id"


def analyse(text: Column | str, blanks: bool = False) -> Column:
    """Lower-case terms of a text; both sides of a search use the same."""
    t = F.lower(as_col(text))
    return F.filter(F.split(t, r"\s+"), lambda w: w != "") if blanks else F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def documents(rows: DataFrame) -> DataFrame:
    """Typed documents; columns that the registry does not name go to ``extras`` where they are not empty.

    A key that is repeated gives one document, so building twice changes nothing.
    """
    have = set(rows.columns)
    rows = rows.dropDuplicates([KEY])
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    text = {n: text_value(col(w), col(b)) if b else blank_to_null(col(w)) for n, (w, b) in TEXT_FIELDS.items()}
    number = {n: number_value(col(w), col(b)) if b else F.coalesce(to_int(col(w)), F.lit(0)) for n, (w, b) in NUMBER_FIELDS.items()}
    used = {KEY, *(c for w, b in TEXT_FIELDS.values() for c in (w, b) if c), *(c for w, b in NUMBER_FIELDS.values() for c in (w, b) if c)}
    rest = [c for c in rows.columns if c not in used]
    extras = F.map_filter(F.create_map(*(x for c in rest for x in (F.lit(c), F.col(c).cast("string")))), lambda _, v: v.isNotNull() & (v != "")) if rest else F.create_map().cast("map<string,string>")
    return rows.select(
        F.col(KEY).alias("doc_key"),
        *(c.alias(n) for n, c in text.items()),
        *(c.alias(n) for n, c in number.items()),
        *(stat_text(c, n).alias(f"{n}_text") for n, c in number.items()),
        birth_timestamp(col("birth_date_wiki"), col("birth_date")).alias("birth_ts"),
        extras.alias("extras"),
    )


def searchable() -> tuple[str, ...]:
    return (*TEXT_FIELDS, *(f"{n}_text" for n in NUMBER_FIELDS))


def postings(docs: DataFrame, fields: tuple[str, ...] | None = None) -> DataFrame:
    """(field, term, doc_key, tf, dl) in one pass over the documents."""
    names = [f for f in (fields or searchable()) if f in docs.columns]
    each = F.array(*(F.struct(F.lit(f).alias("field"), analyse(f, f in BLANK_FIELDS).alias("terms")) for f in names))
    flat = docs.select("doc_key", F.explode(each).alias("e")).select("doc_key", "e.field", F.size("e.terms").alias("dl"), F.explode("e.terms").alias("term"))
    return flat.groupBy("field", "term", "doc_key").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def term_stats(post: DataFrame) -> DataFrame:
    return post.groupBy("field", "term").agg(F.count("*").alias("df"))


def field_stats(post: DataFrame) -> DataFrame:
    """(field, n_docs, avgdl) over the documents that have the field."""
    lengths = post.groupBy("field", "doc_key").agg(F.sum("tf").alias("dl"))
    return lengths.groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


@dataclass
class Index:
    doc: DataFrame
    posting: DataFrame
    term_stats: DataFrame
    field_stats: DataFrame

    @classmethod
    def of(cls, rows: DataFrame) -> Index:
        doc = documents(rows)
        post = postings(doc)
        return cls(doc, post, term_stats(post), field_stats(post))

    def save(self, folder: str) -> None:
        """Overwrite the tables; building twice leaves one copy of every document."""
        self.doc.write.mode("overwrite").parquet(f"{folder}/doc")
        # ranges that end inside a term where need be: no word makes a large partition
        self.posting.repartitionByRange("field", "term", "doc_key").sortWithinPartitions("field", "term").write.mode("overwrite").partitionBy("field").parquet(f"{folder}/posting")
        post = self.posting.sparkSession.read.parquet(f"{folder}/posting")
        term_stats(post).sortWithinPartitions("field", "term").write.mode("overwrite").partitionBy("field").parquet(f"{folder}/term_stats")
        field_stats(post).coalesce(1).write.mode("overwrite").parquet(f"{folder}/field_stats")

    def register_views(self, prefix: str = "index_") -> None:
        """The tables as temporary views ``<prefix>doc``, ``posting``, ``term_stats`` and ``field_stats``."""
        for name in ("doc", "posting", "term_stats", "field_stats"):
            getattr(self, name).createOrReplaceTempView(prefix + name)

    def counters(self) -> DataFrame:
        """One row: documents, postings and distinct terms of the index."""
        terms = self.term_stats.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("postings"), F.countDistinct("term").alias("terms"))
        return self.doc.agg(F.count("*").alias("documents")).crossJoin(terms)  # one row each

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Index:
        return cls(*(spark.read.parquet(f"{folder}/{t}") for t in ("doc", "posting", "term_stats", "field_stats")))
