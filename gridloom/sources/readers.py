"""Readers and writers of the pipeline's files."""

from __future__ import annotations

import html
import re
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import html as H
from gridloom.operators import frontier

#: columns of an extracted entity; fixed values
ENTITY_COLUMNS = ("driver_id", "driver_name", "birth_date", "nationality", "teams", "starts", "wins", "poles", "podiums")
ENTITY_SCHEMA = ", ".join(f"{c} string" for c in ENTITY_COLUMNS)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) is not None and len(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)) > 0


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """(url, visited) of a link file; a missing file has no links."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "url string, visited boolean")
    return frontier.parse_lines(spark.read.text(path))


def write_links(links: DataFrame, path: str) -> None:
    frontier.format_lines(links).write.mode("overwrite").text(path)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(page_name, html) of the ``*.html`` files of a folder; a missing or empty folder has no pages."""
    if not _exists(spark, f"{folder}/*.html"):
        return spark.createDataFrame([], "page_name string, html string")
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.html").text(folder)
    return files.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("page_name"), F.col("value").alias("html"))


def entities(pages: DataFrame) -> DataFrame:
    """One entity record per page; a page without the marks of an entity gives empty fields, never an error."""
    return pages.select(
        F.col("page_name").alias("driver_id"), H.page_title("html").alias("driver_name"), H.born("html").alias("birth_date"), H.nationality("html").alias("nationality"),
        F.array_join(H.teams("html"), "; ").alias("teams"), *(H.stat("html", s).alias(s) for s in H.STATS),
    )


def sorted_out(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages that hold an entity, and (page_name, reason) of those that do not: unread, empty, or without a heading."""
    h = F.col("html")
    reason = F.when(h.isNull(), "unread").when(F.trim(h) == "", "empty").when(H.page_title(h) == "", "no heading")
    marked = pages.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").select("page_name", "reason")


def page_counters(pages: DataFrame) -> DataFrame:
    """One row (files, saved, rejected) in one pass."""
    good, bad = sorted_out(pages)
    both = good.select(F.lit(1).alias("ok")).unionByName(bad.select(F.lit(0).alias("ok")))
    return both.agg(F.count("*").alias("files"), F.coalesce(F.sum("ok"), F.lit(0)).alias("saved"), F.count_if(F.col("ok") == 0).alias("rejected"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with a header; without a schema every column is text, so no second pass infers types."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_wiki_xml(spark: SparkSession, path: str) -> DataFrame:
    """(title, text) of the pages of an encyclopedia dump; texts with and without attributes fit one schema."""
    page = spark.read.format("xml").option("rowTag", "page").schema("title string, revision struct<text:string>").load(path)
    return page.select("title", F.col("revision.text").alias("text"))


def http_get(url: str, timeout: float = 20.0) -> str | None:
    """The page, or None where it cannot be read."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "gridloom"}), timeout=timeout) as r:
            return r.read().decode("utf-8", "replace")
    except (urllib.error.URLError, OSError, ValueError):
        return None


def listing_pages(first: str, get: Callable[[str], str | None] = http_get, following: str = r'<a[^>]*rel="next"[^>]*href="([^"]+)"', most: int | None = None) -> Iterator[tuple[int, str]]:
    """(number, html) of a listing and the pages it leads to, one after the other, as each names the next.

    Ends where a page cannot be read, names no further one, or names one that was read.
    """
    url, seen = first, set()
    while url and url not in seen and (most is None or len(seen) < most):
        seen.add(url)
        page = get(url)
        if page is None:
            return
        yield len(seen), page
        found = re.search(following, page)
        url = urllib.parse.urljoin(url, html.unescape(found[1])) if found else None


def fetch(links: DataFrame, get: Callable[[str], str | None] = http_get, pause: float = 1.5, lanes: int = 8, tries: int = 1) -> DataFrame:
    """(url, page_name, html, ok) of every link, fetched where the partitions are; failures stay unvisited.

    At most ``lanes`` partitions fetch, and each waits ``lanes * pause``
    between two requests, so all together send one in ``pause`` seconds
    however large the cluster is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for b in batches:
            got = []
            for u in b["url"]:
                page = None
                for _ in range(tries):
                    page = get(u)
                    time.sleep(lanes * pause)
                    if page is not None:
                        break
                got.append(page)
            yield pd.DataFrame({"url": b["url"], "page_name": b["page_name"], "html": got, "ok": [bool(x) for x in got]})

    links = links.repartition(lanes, "url")
    return links.select("url", H.file_name("url").alias("page_name")).mapInPandas(run, "url string, page_name string, html string, ok boolean")
