"""Every registered query against its SQL on the small tables (the driver does the same at another size)."""

import glob
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(df):
    names = sorted(df.columns)
    text = lambda x: "null" if x is None or x != x else f"{x:.7g}" if isinstance(x, float) else str(x)
    return names, sorted(tuple(text(x) for x in r) for r in df[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"))
def test_equals_sql(spark, con, name):
    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(con.sql(entry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(n for n in set(entry.queries()) - set(entry.oracle_sql()) if not n.startswith("op") and n != "pipeline"))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
