import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from touchline.llm.embed_dedup import BITS, near_duplicates, passes_for


def brute(rows):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.stack([v / np.linalg.norm(v) for _, v in good])
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(good))
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(good))])
        if (new == label).all():
            break
        label = new
    ids = np.array([i for i, _ in good])
    return {i: (int(near[k].sum()), int(min(ids[label == label[k]]))) for k, (i, _) in enumerate(good)}


def test_links_and_components(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (12, 16))
    points = [c + rng.normal(0, s, 16) for c, s, n in zip(centres, [0.02, 0.1, 0.25, 0.3] * 3, [40, 3, 25, 60] * 3) for _ in range(n)] + list(rng.normal(0, 1, (150, 16)))
    points += [points[0]] * 30  # exact copies
    rows = [(1000 - i, [float(np.float32(x)) for x in v]) for i, v in enumerate(points)]
    got = {r.vec_id: r for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    total, found = sum(n for n, _ in want.values()), sum(r.n_links for r in got.values())
    assert found >= 0.9 * total and all(got[i].n_links <= n for i, (n, _) in want.items())
    assert np.mean([got[i].component_id == c for i, (_, c) in want.items()]) >= 0.95
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (None, [1.0, 0.0]), (8, [1e-30, 0.0]), (9, [0.0, 1.0]), (10, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("component", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got[1] == (3, 1, True) and got[2] == got[3] == got[8] == (3, 1, False) and got[9] == (0, 9, True)
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 10)) and got[None] == (0, None, True)
    assert near_duplicates(df.where("vec_id > 99")).count() == 0


@pytest.mark.parametrize("n, topics", [(4_000, 0), (40_000, 0), (24_000, 12)], ids=("small", "large", "topics"))
def test_isolated_pairs_near_the_threshold(spark, n, topics):
    """Each of 600 pairs at cosine 0.905, alone or among rows of a topic at mutual cosines of about 0.6, is found at any size."""
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.standard_normal((n, 64)))
    if topics:
        x = unit(np.sqrt(0.6) * unit(rng.standard_normal((topics, 64)))[np.arange(n) % topics] + np.sqrt(0.4) * x)
    aside = rng.standard_normal((600, 64))
    aside = unit(aside - (aside * x[:600]).sum(1, keepdims=True) * x[:600])
    x = np.concatenate([x, 0.905 * x[:600] + np.sqrt(1 - 0.905**2) * aside])
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    got = {r.vec_id: r for r in near_duplicates(df).where(f"vec_id >= {n}").collect()}
    assert len(got) == 600 and np.mean([not got[n + i].kept and got[n + i].n_links >= 1 for i in range(600)]) >= 0.995


def test_passes_follow_the_size():
    p = 1 - np.arccos(0.9) / np.pi
    for n in (0, 1, 1_000, 10**5, 10**7, 10**9):
        window, passes = passes_for(n, 0.9)
        k = max(0, np.ceil(np.log2(max(n, 1) / window)))
        assert 1 - (1 - p**k) ** passes >= 0.999 and (n > window or passes == 1) and window <= max(64, n // 4)
    assert 1 < passes_for(1_000, 0.9)[1] < passes_for(10**5, 0.9)[1] < passes_for(10**7, 0.9)[1]


@pytest.mark.parametrize("n", (500, 2_000, 8_000))
def test_passes_find_what_all_pairs_do(spark, n):
    """Groups at cosines from 0.85 to 0.95 among random rows, by windows much shorter than the table."""
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 32))
    for g in range(n // 20):
        own = slice(10 * g, 10 * g + 5)
        x[own] = x[10 * g] + rng.uniform(0.2, 0.5) * x[own]
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    want = brute(rows)
    assert np.mean([got[i] == want[i] for i in want if want[i][0]]) >= 0.99 and sum(k > 0 for k, _ in want.values()) > n // 20
    assert all(got[i] == (0, i) for i in want if not want[i][0])


def test_passes_meet_what_is_promised():
    """Isolated pairs at cosine 0.905 that a window of any pass holds, in numpy alone, at sizes up to 300,000 rows."""
    rng = np.random.default_rng(9)
    for n in (20_000, 300_000):
        x = rng.standard_normal((n, 16)).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        aside = rng.standard_normal((500, 16))
        aside -= (aside * x[:500]).sum(1, keepdims=True) * x[:500]
        aside /= np.linalg.norm(aside, axis=1, keepdims=True)
        x = np.concatenate([x, 0.905 * x[:500] + np.sqrt(1 - 0.905**2) * aside])
        window, passes = passes_for(n + 500, 0.9)
        met = np.zeros(500, bool)
        for _ in range(passes):
            rank = np.argsort(np.argsort((x @ rng.standard_normal((16, BITS)) > 0) @ (1 << np.arange(BITS)[::-1])))
            met |= np.abs(rank[:500] - rank[n:]) <= window
        assert met.mean() >= 0.99
