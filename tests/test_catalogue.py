"""Every query with SQL gives SQL's rows, over the smallest tables where they are there."""

import os

import duckdb
import pytest

import tools_compare
from causerie import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def test_entry_has_a_query_for_all_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_as_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        path = f"{SF}/{t}" + ("/*.parquet" if os.path.isdir(f"{SF}/{t}") else "")
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    df = catalogue.QUERIES[name](spark, SF)
    found = con.execute(catalogue.SQL[name])
    cols = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(cols)
    assert tools_compare.rows(df.columns, [tuple(r) for r in df.collect()]) == tools_compare.rows(cols, found.fetchall())
