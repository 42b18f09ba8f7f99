"""Every registered query of the graph engine against its SQL."""

import os

import duckdb
import pytest

from weftgraph import catalog

FOLDER = "/root/testdata/sf0.001"
SLOW = {"coloring_valid"}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return con


def rows(df):
    names = sorted(df.columns)
    return sorted(tuple(str(x) if x == x else "null" for x in r) for r in df[names].astype(object).where(df[names].notna(), float("nan")).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - SLOW))
def test_query(spark, sql, name):
    found, wanted = catalog.queries()[name](spark, FOLDER).toPandas(), sql.sql(catalog.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    for c in found.columns:
        if found[c].dtype.kind in "iuf":
            found[c], wanted[c] = found[c].astype(float), wanted[c].astype(float)
    assert rows(found) == rows(wanted)


def test_every_query_has_sql():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()
