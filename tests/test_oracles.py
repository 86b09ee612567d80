"""Every registered query of the core against its oracle, on the smallest tables."""

import math
import os

import pytest

from touchline.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


def value(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    mine = sorted((tuple(value(r[c]) for c in names) for r in df.collect()), key=str)
    cur = duck.execute(ORACLES[name])
    theirs_names = [d[0] for d in cur.description]
    assert sorted(theirs_names) == names
    theirs = sorted((tuple(value(r[theirs_names.index(c)]) for c in names) for r in cur.fetchall()), key=str)
    assert mine == theirs


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
