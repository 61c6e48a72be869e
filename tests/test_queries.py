"""Every registered query that has SQL gives that SQL's rows."""

import datetime
import os

import duckdb
import pytest

from foliant.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    return con


def rows(table):
    def plain(v):
        if isinstance(v, float):
            return round(v, 9) + 0.0
        if isinstance(v, datetime.datetime):
            return v.isoformat()
        return v

    return sorted((tuple((k, str(plain(r[k]))) for k in sorted(r)) for r in table.to_pylist()))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_match_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toArrow()
    assert rows(got) == rows(duck.sql(ORACLE_SQL[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns[0] == "engine"
