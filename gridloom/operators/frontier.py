"""The resumable list of links to fetch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.html import file_name

VISITED = " VISITED"


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(url, visited) of link-file lines; blank lines are skipped, a trailing mark says that a link was fetched."""
    line = F.trim(F.col(column))
    seen = line.endswith(VISITED)
    return lines.where(line != "").select(F.when(seen, F.regexp_replace(line, f"{VISITED}$", "")).otherwise(line).alias("url"), seen.alias("visited"))


def format_lines(links: DataFrame) -> DataFrame:
    return links.select(F.concat(F.col("url"), F.when(F.coalesce("visited", F.lit(False)), F.lit(VISITED)).otherwise(F.lit(""))).alias("value"))


def dedup(links: DataFrame, order: str) -> DataFrame:
    """The first row of every url by ``order``; an aggregation, so a hot url is combined before the shuffle."""
    rest = [c for c in links.columns if c != "url"]
    first = links.groupBy("url").agg(F.min_by(F.struct(*rest), F.col(order)).alias("r"))
    return first.select("url", *(F.col(f"r.{c}").alias(c) for c in rest))


def merge_new(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Existing links and the unknown ones among those found, unvisited, each once."""
    new = found.select("url").where("url is not null").distinct().join(existing.select("url"), "url", "left_anti")
    return existing.select("url", "visited").unionByName(new.select("url", F.lit(False).alias("visited")))


def merge_flags(existing: DataFrame, found: DataFrame) -> DataFrame:
    """(url, visited): every link of both once, visited where either says so; combined before the shuffle."""
    both = existing.select("url", "visited").unionByName(found.select("url", "visited")).where("url is not null")
    return both.groupBy("url").agg(F.max(F.coalesce("visited", F.lit(False))).alias("visited"))


def unvisited(links: DataFrame) -> DataFrame:
    """Links not fetched yet; an unknown flag counts as not fetched."""
    return links.where(~F.coalesce("visited", F.lit(False)))


def to_fetch(links: DataFrame, pages: DataFrame, page_name: str = "page_name") -> DataFrame:
    """Unvisited links whose page is not in the store yet."""
    return unvisited(links).withColumn("page_name", file_name("url")).join(pages.select(F.col(page_name).alias("page_name")).distinct(), "page_name", "left_anti")


def counters(links: DataFrame) -> DataFrame:
    return links.agg(
        F.count("*").alias("links"), F.countDistinct("url").alias("urls"), F.count_if(F.coalesce("visited", F.lit(False))).alias("visited"), F.count_if(~F.coalesce("visited", F.lit(False))).alias("open")
    )
