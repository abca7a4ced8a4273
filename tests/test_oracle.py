"""Registered queries against their DuckDB SQL on the sf0.001 tables."""

import os
import sys

import duckdb
import pytest

from conftest import ROOT, SF001

sys.path.insert(0, os.path.join(ROOT, "tools"))
import __spark_entry__ as E  # noqa: E402
from oracle_check import frame_hash  # noqa: E402
from prefmine.sources.testdata import TABLES  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    s = E.queries()[name](spark, SF001).toPandas()
    d = con.execute(E.oracle_sql()[name]).fetchdf()
    assert sorted(s.columns) == sorted(d.columns)
    assert len(s) == len(d)
    assert frame_hash(s) == frame_hash(d)


def test_every_query_has_oracle():
    assert not {q for q in set(E.queries()) - set(E.oracle_sql()) if not q.startswith("op") and q != "pipeline"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
