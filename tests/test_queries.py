"""Every query with SQL equals DuckDB's result of that SQL, as a multiset, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from palimp.plans import base

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(base.ORACLES))
def test_equals_sql(spark, duck, tmp_path, name):
    out = f"{tmp_path}/out"
    base.QUERIES[name](spark, DATA).write.parquet(out)
    spark_rows, sql_rows = duck.sql(f"select * from '{out}/*.parquet'"), duck.sql(base.ORACLES[name])
    assert dict(zip(spark_rows.columns, map(str, spark_rows.types))) == dict(zip(sql_rows.columns, map(str, sql_rows.types)))
    cols = ", ".join(f'"{c}"' for c in spark_rows.columns)
    for a, b in (("spark_rows", "sql_rows"), ("sql_rows", "spark_rows")):
        assert duck.sql(f"select {cols} from {a} except all select {cols} from {b}").fetchall() == []


@pytest.mark.parametrize("name", sorted(set(base.QUERIES) - set(base.ORACLES)))
def test_runs(spark, name):
    assert base.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert 0 < entry.entry(spark).count() <= 24


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
