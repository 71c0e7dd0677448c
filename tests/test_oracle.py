"""Every registered query against its SQL counterpart on the smallest data."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as registry
from oracle_texts import TEXTS

SF_DIR = os.environ.get("HEATSHEET_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.date()
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(plain, key=repr)


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"create view {table} as select * from read_parquet('{SF_DIR}/{table}.parquet')"
        )
    return connection


@pytest.mark.parametrize("name", sorted(registry.core_queries()))
def test_matches_sql(spark, oracle, name):
    df = registry.core_queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for slow in ("Python", "Pandas", "NestedLoop", "Cartesian"):
        assert slow not in plan
    ours = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    result = oracle.execute(TEXTS[name])
    columns = [c[0] for c in result.description]
    theirs = _sorted_rows(columns, result.fetchall())
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    for mine, other in zip(ours[1], theirs[1]):
        assert mine == other


def test_every_query_has_sql():
    assert set(registry.core_queries()) == set(TEXTS)
