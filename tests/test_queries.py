"""Every registered query with SQL against DuckDB; the others run and give a stable schema."""

import duckdb
import pytest

from threadlens.plans import queries

from .compare import compared

SF = "/root/testdata/sf0.001"
PLAIN = sorted(set(queries.QUERIES) - set(queries.SQL))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    assert compared(spark, duckdb.connect(), queries.QUERIES[name], queries.SQL[name], SF)
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", PLAIN)
def test_runs(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got.columns) > 1 and (len(got) or name == "learned_titles")
    spark.catalog.clearCache()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
