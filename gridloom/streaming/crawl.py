"""The frontier as a stream: link files that arrive are merged into the table of links.

The table is a folder of versions ``v<number>-<batch>-<query>``, of which the
highest finished one counts.  A batch writes a new version beside the last and
touches nothing else, so a crash at any moment leaves the last version whole;
a batch that is run again after its version was finished changes nothing.  The
version before the last stays for readers that have opened it, older ones go.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gridloom.operators import frontier

SCHEMA = "url string, visited boolean"


def read_links(spark: SparkSession, folder: str) -> DataFrame:
    """(url, visited) of the link files that appear in a folder."""
    return frontier.parse_lines(spark.readStream.text(folder))


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, table: str) -> list[tuple[int, str]]:
    """(number, folder name) of the finished versions, oldest first; a missing table has none."""
    files, path = _files(spark, table)
    if not files.exists(path):
        return []
    found = []
    for status in files.listStatus(path):
        name = status.getPath().getName()
        if (m := re.fullmatch(r"v(\d+)-.*", name)) and files.exists(_files(spark, f"{table}/{name}/_SUCCESS")[1]):
            found.append((int(m[1]), name))
    return sorted(found)


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """(url, visited) of the last finished version."""
    found = versions(spark, table)
    return spark.read.schema(SCHEMA).parquet(f"{table}/{found[-1][1]}") if found else spark.createDataFrame([], SCHEMA)


def merge_into(links: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Merge every micro-batch into the table; ends when all present files are read.

    A link once marked as visited stays so, whichever file said it.
    """
    spark = links.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        query = json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]
        found = versions(spark, table)
        own = f"{number}-{query}"
        if found and found[-1][1].split("-", 1)[1] == own:
            return  # finished before the stream was stopped
        name = f"v{found[-1][0] + 1 if found else 0}-{own}"
        frontier.merge_flags(read_table(spark, table), batch).write.mode("overwrite").parquet(f"{table}/{name}")
        for _, old in found[:-1]:
            files, path = _files(spark, f"{table}/{old}")
            files.delete(path, True)

    return links.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
