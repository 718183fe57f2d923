"""Every registered query that has SQL agrees with it, on the smallest tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from sparkweave.plans import catalog

TABLES = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for file in TABLES.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def plain(value):
    if isinstance(value, float | decimal.Decimal):
        value = float(value)
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return f"{float(value):.9g}" if abs(value) < 10**9 else str(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


@pytest.mark.skipif(not TABLES.exists(), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    found = catalog.queries()[name](spark, str(TABLES))
    names = sorted(found.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in found.collect())
    wanted = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(columns) == names
    want = sorted(tuple(plain(r[columns.index(c)]) for c in names) for r in wanted.fetchall())
    assert got == want


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
