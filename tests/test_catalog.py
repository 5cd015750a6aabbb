"""Every registered query of the library against its SQL, and entry()."""

import duckdb
import pytest

import __spark_entry__ as entry
from arborlake.plans import catalog
from verify import TABLES, rows_of


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    if name not in catalog.SQL:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == rows_of(rel.columns, rel.fetchall())


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
