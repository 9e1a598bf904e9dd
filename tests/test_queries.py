"""Every registered query beside its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tidelog import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(repr(tuple(row[c] for c in columns)) for row in df.collect())
    if name not in plans.oracle_sql():
        return
    got = duck.execute(plans.oracle_sql()[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == columns
    theirs = sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in got.fetchall())
    assert mine == theirs


def test_registry():
    import __spark_entry__

    assert set(plans.oracle_sql()) <= set(plans.queries()) <= set(__spark_entry__.queries())


def test_entry(spark):
    import __spark_entry__

    if SF.endswith("sf0.001"):
        assert __spark_entry__.entry(spark).columns == ["id", "score"]
