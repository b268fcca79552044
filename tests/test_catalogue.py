"""Every registered query of the event-time operators against DuckDB on the same files."""

import math
import os

import duckdb
import pytest

from tickloom.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x + 0.0:.10g}"
        return str(x)

    return sorted(tuple(cell(v[i]) for i in order) for v in values)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    sql = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in sql.description]
    assert sorted(got.columns) == sorted(columns)
    mine = [tuple(r) for r in got.collect()]
    theirs = sql.fetchall()
    assert len(mine) == len(theirs)
    assert rows(got.columns, mine) == rows(columns, theirs)
