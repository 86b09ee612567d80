import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import hard_negatives
from touchline.llm.hard_negatives import Block, INDEX, angles_to, index_row, mine, unit


def brute(rows, k=5, m=3):
    width = max((len(v) for _, _, v in rows), default=0)
    held = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    whole = [(i, lab, [int(x) * 256 if abs(x) >= 2**52 else int(np.floor(x * 256)) for x in v] + [0] * (width - len(v))) for i, lab, v in rows]
    score = lambda a, b: held(sum(x * y for x, y in zip(a, b)))
    out = []
    for i, lab, v in whole:
        if i % 50:
            continue
        near = sorted((-score(v, w), j) for j, other, w in whole if other == lab and j != i)[:k]
        for p, j in near:
            bad = sorted((-s, n) for n, other, w in whole if other != lab and 50 * -p <= 100 * (s := score(v, w)) <= 95 * -p)[:m]
            out += [(i, j, r, n, -p, -s) for r, (s, n) in enumerate(bad, 1)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("id", F.lit("clash"))
    out = mine(df, F.col("label"), F.col("vec_id") % 50 == 0)
    return sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("scale", (0.3, 1e4, 1e12, 1e40))
def test_exact(spark, monkeypatch, scale):
    monkeypatch.setattr(hard_negatives, "WINDOW", 8)
    rng = np.random.default_rng(2)
    centre = rng.normal(0, scale, (4, 10))
    v = centre[rng.integers(0, 4, 300)] + rng.normal(0, scale / 2, (300, 10))
    v[60:90] = v[30]  # ties
    v[100:110] = 0
    rows = [(i, int(rng.integers(0, 4)), [float(x) for x in r]) for i, r in enumerate(v)]
    assert run(spark, rows) == brute(rows)


def test_bounds_hold():
    rng = np.random.default_rng(0)
    for n in (1, 2, 40):
        c, q = rng.integers(-300, 300, (n, 6)), rng.integers(-300, 300, (9, 6))
        c[0], q[0], q[1] = 0, 0, c[-1]
        references = unit(c[: min(n, 5)])[0]
        b = Block(dict(zip((x.split()[0] for x in INDEX.split(", ")), index_row(0, 0, np.arange(n), np.zeros(n, np.int64), c, references))), 6)
        directions, norms = unit(q)
        lower, upper = b.bounds(angles_to(directions, references), norms, 6)
        for w, (lo, hi) in enumerate(zip(b.cuts[:-1], b.cuts[1:])):
            s = b.scores(q, slice(lo, hi))
            assert (s >= lower[:, w : w + 1]).all() and (s <= upper[:, w : w + 1]).all()


def test_bounds_leave_windows_out():
    rng = np.random.default_rng(1)
    centre = rng.normal(0, 200, (8, 32))
    c = np.floor(centre[np.repeat(np.arange(8), 100)] + rng.normal(0, 10, (800, 32))).astype(np.int64)
    references = unit(centre)[0]
    b = Block(dict(zip((x.split()[0] for x in INDEX.split(", ")), index_row(0, 0, np.arange(800), np.zeros(800, np.int64), c, references))), 32)
    directions, norms = unit(c[:1])
    _, upper = b.bounds(angles_to(directions, references), norms, 32)
    assert (upper < 0.9 * norms[0] ** 2).mean() > 0.5


def test_odd_rows(spark):
    rows = [(0, 1, [1.0, 0.0]), (50, 1, [1.0]), (2, None, [1.0]), (3, 1, None), (4, 2, [float("nan"), 1.0]), (5, 2, [None, 1.0]), (6, 2, [0.75, 9.0]), (None, 2, [0.75]), (7, 2, [0.96]), (8, 2, [0.5]), (8, 2, [0.5]), (9, 1, [])]
    got = run(spark, rows)
    assert got == brute([r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])])
    assert run(spark, [(1, 1, [1.0])]) == []
