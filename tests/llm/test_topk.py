import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm.topk import Block, block_top, index_rows, top_k


def brute(vectors, k):
    rows = [(i, np.floor(np.array(v, float) * 256).astype(object)) for i, v in vectors]
    width = max(len(v) for _, v in rows)
    rows = [(i, np.array([int(x) for x in v] + [0] * (width - len(v)), object)) for i, v in rows]
    out = {}
    for q, qv in rows:
        if q % 50 == 0:
            scored = sorted((-min(max(int(qv @ v), -(2**63)), 2**63 - 1), i) for i, v in rows if i != q)[:k]
            out[q] = [(i, min(max(-s, -(2**63)), 2**63 - 1)) for s, i in scored]
    return out


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("scale", (0.2, 1.0, 1e5, 1e30))
def test_exact(spark, scale):
    rng = np.random.default_rng(5)
    base = rng.normal(0, scale, (400, 12))
    base[100:120] = base[0]  # ties
    base[200:260] = np.round(base[200:260], 1)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)]
    got = ranked(top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0))
    assert got == brute(rows, 5)


def test_block_bounds_hold():
    rng = np.random.default_rng(0)
    for _ in range(20):
        q, c = rng.integers(-300, 300, (7, 9)), rng.integers(-300, 300, (60, 9))
        block = Block(index_rows(0, 0, np.arange(100, 160), c))
        assert (block.exact(np.arange(60), np.int64) == c).all() and [w for w, _ in block.segments] == sorted((w for w, _ in block.segments), reverse=True)
        at, to, s = block_top(np.arange(7), q, block, 5, np.full(7, -np.inf))
        full = q @ c.T
        for i in range(7):
            assert sorted(s[at == i].tolist(), reverse=True) == sorted(full[i].tolist(), reverse=True)[:5]


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf")]), (5, [None, 1.0]), (6, []), (None, [1.0, 1.0]), (50, [0.5, 0.5]), (50, [0.25, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = ranked(top_k(df, F.col("vec_id") % 50 == 0))
    assert set(got) == {0, 50} and got[0][0] == (1, 65536) and all(v != 0 for v, _ in got[0])
    assert len(got[0]) == 4 and {v for v, _ in got[50]} == {0, 1, 6}
    assert top_k(df.where("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_bar_is_carried_from_block_to_block(spark, monkeypatch):
    from touchline.llm import topk

    monkeypatch.setattr(topk, "CANDIDATES", 16)
    monkeypatch.setattr(topk, "LEAST_SHARES", 2)
    rng = np.random.default_rng(2)
    base = rng.normal(0, 1, (300, 6))
    base[40:80] = base[50]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    assert ranked(top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0)) == brute(rows, 5)
