"""Registered queries against their SQL counterparts at the smallest scale.

By default the headline queries run (about a minute); PANELWEAVE_ALL=1 runs every one.
"""

import os
import sys

import duckdb
import pytest
from conftest import SF

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from bench import HEADLINE  # noqa: E402
from check import TABLES, rows  # noqa: E402

QUERIES, SQL = entry.queries(), entry.oracle_sql()
CHOSEN = list(QUERIES) if os.environ.get("PANELWEAVE_ALL") else [*HEADLINE, "q_ols_fit"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in CHOSEN if n in SQL])
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows(names, cur.fetchall())


@pytest.mark.parametrize("name", [n for n in CHOSEN if n not in SQL])
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
