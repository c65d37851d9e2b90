"""Interactive search over a saved index: ``python -m gridloom.cli FOLDER``."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from gridloom.operators.index import Index
from gridloom.plans import search
from gridloom.plans.query import Console, EmptyQuery, QuerySpec

HELP = "words, comparisons such as wins>8, 'sort: wins WORDS', and, or, fuzzy on, fuzzy off, exit"


def main(folder: str) -> None:
    spark = SparkSession.builder.appName("gridloom").getOrCreate()
    index, console = Index.load(spark, folder), Console()
    index.term_stats.cache()
    for line in sys.stdin:
        try:
            said = console.read(line)
        except EmptyQuery:
            print("nothing to look for")
            continue
        if said == "exit":
            break
        if isinstance(said, QuerySpec):
            print(search.total_hits(index, said).first()["hits"], "results")
            search.display(search.search(index, said)).show(truncate=False)
        elif said:
            print(HELP if said == "help" else said)


if __name__ == "__main__":
    main(sys.argv[1])
