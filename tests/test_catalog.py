"""Every registered query runs on the small tables and matches its SQL."""

import duckdb
import pytest

import check
from ringwarden.plans.catalog import CATALOG


@pytest.fixture(scope="module")
def con(folder):
    connection = duckdb.connect()
    for t in check.TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(n for n, q in CATALOG.items() if q.sql))
def test_query_matches_sql(spark, folder, con, name):
    df = CATALOG[name].run(spark, folder)
    got = check.rows_of(df.columns, df.collect())
    cursor = con.execute(CATALOG[name].sql)
    assert got == check.rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
