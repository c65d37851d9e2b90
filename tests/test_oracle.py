import pytest
from conftest import DATA
from oracle import check

from gridloom.plans.core_queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    check(spark, DATA / "sf0.001", QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, str(DATA / "sf0.001")).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and df.columns == ["query", "variant", "rank", "doc_id", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize(("name", "source", "key", "column"), [("driver_page_fields", "drivers", "driver_id", "name"), ("driver_page_teams", "drivers_teams", "rec_id", "teams")])
def test_pages_of_all_records_are_read(spark, name, source, key, column):
    found = QUERIES[name](spark, str(DATA / "sf0.001"))
    want = {r[0] for r in spark.read.parquet(str(DATA / "sf0.001" / f"{source}.parquet")).select(key).collect()}
    assert {r[0] for r in found.select("page_id").collect()} == want and found.where(f"{column} <> ''").count() > len(want) // 2
