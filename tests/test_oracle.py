"""Registered queries against their DuckDB oracle SQL on the smallest tables."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

from multisvm.plans.oracle import oracle_sql
from multisvm.plans.queries import QUERIES

NAMES = list(oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("embeddings", "lineitem", "part"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def test_every_query_has_an_oracle():
    assert set(QUERIES) - set(NAMES) == {"kmeans_parallel"}
    assert set(NAMES) <= set(QUERIES) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    got = _norm(E.queries()[name](spark, SF_SMALL).toPandas())
    want = _norm(con.execute(E.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        a, b = got[c].to_numpy(), want[c].to_numpy()
        if a.dtype.kind == "f" or b.dtype.kind == "f":
            assert np.array_equal(a.astype(float), b.astype(float), equal_nan=True), c
        else:
            assert list(a) == list(b), c


def test_entry_runs(spark):
    df = E.entry(spark)
    assert set(df.columns) >= {"label", "precision", "recall", "false_positive_rate", "f1"}
    assert df.count() > 0
