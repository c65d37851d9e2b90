"""Prefix-filtered set-similarity join.

Both sides are sets of tokens.  Tokens are ordered by global rarity; two sets
of Jaccard similarity ``t`` or more share a token within their first
``n - ceil(t * n) + 1`` tokens, so only those prefixes are joined.  Length and
positional filters drop most candidates before the exact similarity is
computed from the whole sets.  Everything is plain joins in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.common import as_col
from gridloom.sources.tables import checkpoint


def qgrams(text: Column | str, q: int = 2) -> Column:
    """Distinct q-grams of a text padded with one mark at either end."""
    padded = F.concat(F.lit("^"), as_col(text), F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - F.lit(q - 1), F.lit(1))), lambda i: F.substring(padded, i, F.lit(q))))


def _ordered(sets: DataFrame, ranks: DataFrame, id_: str) -> DataFrame:
    """(id, n, toks): tokens of each set, rarest first; ties by the token itself."""
    flat = sets.select(id_, F.explode("toks").alias("tok")).join(ranks, "tok")
    return flat.groupBy(id_).agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("o")).select(id_, F.size("o").alias("n"), F.col("o.tok").alias("toks"))


def _prefixes(sets: DataFrame, t: float, id_: str, suffix: str) -> DataFrame:
    keep = F.col("n") - F.ceil(F.col("n") * F.lit(t) - F.lit(1e-9)) + 1
    pre = sets.select(F.col(id_).alias(f"id{suffix}"), F.col("n").alias(f"n{suffix}"), F.posexplode(F.slice("toks", F.lit(1), keep.cast("int"))).alias(f"p{suffix}", "tok"))
    return pre


def jaccard_join(left: DataFrame, right: DataFrame | None, t: float, id_: str = "id") -> DataFrame:
    """(ida, idb, sim) of all pairs with Jaccard similarity ``t`` or more.

    ``left`` and ``right`` have ``id`` and ``toks`` (array<string>).  With
    ``right`` None it is a self-join and each pair comes once, ``ida < idb``.
    Empty sets match nothing.
    """
    both = left if right is None else left.select(id_, "toks").unionByName(right.select(id_, "toks"))
    ranks = both.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count("*").alias("df"))
    # each side is read four times below; a checkpoint keeps the plan small
    a = checkpoint(_ordered(left, ranks, id_), left.sparkSession)
    b = a if right is None else checkpoint(_ordered(right, ranks, id_), left.sparkSession)
    cand = _prefixes(a, t, id_, "a").join(_prefixes(b, t, id_, "b"), "tok")
    if right is None:
        cand = cand.where("ida < idb")
    need = F.ceil(F.lit(t / (1 + t)) * (F.col("na") + F.col("nb")) - F.lit(1e-9))
    left_a, left_b = F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")
    cand = cand.where((F.col("na") >= F.col("nb") * t - 1e-9) & (F.col("nb") >= F.col("na") * t - 1e-9))
    # positional filter at the first common token: what is left on both sides must suffice
    cand = cand.groupBy("ida", "idb").agg(F.min(F.struct("pa", "pb", "na", "nb")).alias("f")).select("ida", "idb", "f.*").where(F.least(left_a, left_b) >= need)
    sets_a = a.select(F.col(id_).alias("ida"), F.col("toks").alias("ta"))
    sets_b = b.select(F.col(id_).alias("idb"), F.col("toks").alias("tb"))
    full = cand.select("ida", "idb").join(sets_a, "ida").join(sets_b, "idb")
    common = F.size(F.array_intersect("ta", "tb"))
    return full.select("ida", "idb", (common / (F.size("ta") + F.size("tb") - common)).alias("sim")).where(F.col("sim") >= t - 1e-9)
