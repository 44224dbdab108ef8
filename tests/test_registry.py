"""Registered queries against their SQL on the smallest driver tables."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


def test_entry(spark):
    assert entry.entry(spark).count() == 7


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


LLM = {name for name in entry.queries() if name == "pipeline" or re.match(r"op\d+_", name)}  # tested in tests/llm


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - LLM))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert df.columns == columns
    assert ordered(map(tuple, df.collect())) == ordered(result.fetchall())
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - LLM))
def test_query_yields_rows(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0
    spark.catalog.clearCache()
