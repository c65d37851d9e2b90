"""Term statistics and TF-IDF ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.common import as_col
from gridloom.functions.text import tokens


def term_frequency(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf); the count is combined before the shuffle."""
    return docs.select(key, F.explode(tokens(text)).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """(term, df)."""
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def corpus_size(docs: DataFrame) -> DataFrame:
    """One row (n); documents without tokens count."""
    return docs.agg(F.count("*").alias("n"))


def idf_classic(n: Column | str, df: Column | str) -> Column:
    n, df = as_col(n), as_col(df)
    return F.when(df > 0, F.ln(n / df)).otherwise(0.0)


def idf_probabilistic(n: Column | str, df: Column | str) -> Column:
    """Negative for terms of more than half the documents, 0 where the ratio is not defined."""
    n, df = as_col(n), as_col(df)
    return F.when((df > 0) & (df < n), F.ln((n - df) / df)).otherwise(0.0)


IDF = {"classic": idf_classic, "probabilistic": idf_probabilistic}


def inverse_document_frequency(tf: DataFrame, docs: DataFrame, kind: str) -> DataFrame:
    """(term, df, idf)."""
    one = F.broadcast(corpus_size(docs))  # one row
    return document_frequency(tf).crossJoin(one).select("term", "df", IDF[kind]("n", "df").alias("idf"))


def weights(docs: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """(term, key, tf, weight): raw frequency times idf."""
    tf = term_frequency(docs, key, text)
    idf = inverse_document_frequency(tf, docs, kind)
    return tf.join(idf, "term", "left").select("term", key, "tf", (F.col("tf") * F.coalesce("idf", F.lit(0.0))).alias("weight"))


def rank(docs: DataFrame, key: str, text: str, queries: Sequence[str], k: int = 5, kinds: Sequence[str] = tuple(IDF)) -> DataFrame:
    """(query, variant, rank, key, score): the best ``k`` documents of each query by each variant, in one job.

    A term that a query repeats counts as often.  Only the queries' terms
    leave the first aggregation; ties go to the smaller key.
    """
    spark = docs.sparkSession
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "q int, query string")
    wanted = asked.select("q", "query", F.explode(tokens("query")).alias("term"))
    all_ = docs.select(key, tokens(text).alias("toks"))
    hits = all_.select(key, F.explode("toks").alias("term")).join(F.broadcast(wanted.select("term").distinct()), "term")  # the words of the queries
    tf = hits.groupBy("term", key).agg(F.count("*").alias("tf"))
    stat = document_frequency(tf).crossJoin(F.broadcast(corpus_size(docs)))
    scores = tf.join(F.broadcast(stat), "term").join(F.broadcast(wanted), "term")  # one row per word of the queries
    parts = [scores.select("q", "query", F.lit(v).alias("variant"), key, (F.col("tf") * IDF[v]("n", "df")).alias("w")) for v in kinds]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    total = every.groupBy("q", "query", "variant", key).agg(F.sum("w").alias("score"))
    w = Window.partitionBy("q", "variant").orderBy(F.desc(F.round("score", 4)), key)
    return total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "variant", "rank", key, F.round("score", 4).alias("score"))
