"""Every registered query of the engine against its SQL, in two engines."""

import glob
import os

import duckdb
import pytest

from folioforge.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = db.sql(queries.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = db.sql(f"select {quoted} from ({queries.ORACLE_SQL[name]})").fetchall()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=key) == sorted(want, key=key)


def test_all_have_sql():
    assert set(queries.ORACLE_SQL) == set(queries.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
