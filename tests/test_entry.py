"""The driver contract: entry(), and every registered query against its
oracle SQL on the smallest data set."""

from __future__ import annotations

import math
import os

import pytest

import __spark_entry__ as E
from lotline.plans import registry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test data not present")


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"slice", "bin_kind", "bin", "devrevstep", "quantity", "percentage"} <= set(df.columns)


def test_every_query_has_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql())
    assert set(registry.queries()) <= set(E.queries())


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    from lotline.sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SMALL)
    scols = df.columns
    srows = df.collect()
    res = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(scols) == sorted(ocols)
    order = sorted(range(len(scols)), key=lambda i: scols[i])
    oorder = sorted(range(len(ocols)), key=lambda i: ocols[i])
    s = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in srows)
    o = sorted(repr(tuple(_norm(r[i]) for i in oorder)) for r in orows)
    assert s == o
