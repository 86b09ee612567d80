"""Registered queries that SQL can express, against DuckDB."""

import os

import pytest

from touchline.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    cur = c.execute(ORACLES[name])
    theirs = [d[0] for d in cur.description]
    assert sorted(theirs) == names
    mine = sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)
    assert mine == sorted((tuple(r[theirs.index(n)] for n in names) for r in cur.fetchall()), key=str)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
