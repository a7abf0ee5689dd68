"""Every base query gives the rows of its SQL."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from sluice import queries  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, db, name):
    df = queries.queries()[name](spark, SF)
    found = db.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert plain(df.select(*[f"`{c}`" for c in columns]).collect()) == plain([[r[k] for k in at] for r in found.fetchall()])
