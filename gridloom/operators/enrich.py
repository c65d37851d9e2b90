"""Entity records enriched with the article of the same name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import wiki
from gridloom.functions.text import normalise_name


def join_by_name(entities: DataFrame, articles: DataFrame, name: str = "driver_name", title: str = "title") -> DataFrame:
    """Inner join on the normalised name; equal titles fan out, null names match nothing.

    No broadcast is forced: the planner broadcasts the entities where their
    measured size allows it and sorts both sides otherwise.
    """
    left = entities.withColumn("_key", normalise_name(name))
    right = articles.withColumn("_key", normalise_name(title))
    return left.join(right, "_key").drop("_key")


def article_fields(articles: DataFrame, text: str = "text") -> DataFrame:
    """The articles with the data-box fields, cleaned, and the first words of the running text."""
    raw = articles.withColumn("_f", F.explode(F.array(wiki.infobox(text)))).withColumn("_f", F.explode(F.array(wiki.fields("_f"))))  # the box once, its fields once
    out = raw
    for name, aliases in wiki.FIELD_ALIASES.items():
        value = wiki.field(F.col("_f"), aliases)
        if name == "birth_date_wiki":
            value = wiki.clean_birth_date(value)
        elif name in wiki.NUMBER_FIELDS:
            value = wiki.first_number(wiki.clean_value(value))
        else:
            value = wiki.clean_value(value)
        out = out.withColumn(name, value)
    return out.withColumn("first_1000_words", wiki.biography(text)).drop("_f")


def enrich(entities: DataFrame, articles: DataFrame) -> DataFrame:
    """Entities with the fields of the racing articles of their name.

    The keyword filter stands below the join, so it reaches the articles' scan.
    """
    racing = articles.select("title", "text").where(wiki.about_racing("text"))
    return article_fields(join_by_name(entities, racing)).drop("text")
