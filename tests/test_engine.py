import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from touchline.operators import order, skyline
from touchline.plans import refresh, star
from touchline.sources import drift, paged, pages
from touchline.sources.catalog import Catalog
from touchline.streaming import keyed


def brute(rows):
    return {i for i, g, x in rows if not any(h == g and all(a >= b for a, b in zip(y, x)) and any(a > b for a, b in zip(y, x)) for _, h, y in rows)}


@pytest.mark.parametrize("shape", ("random", "opposed", "one price", "ties"))
def test_skyline(spark, monkeypatch, shape):
    monkeypatch.setattr(skyline, "CELL", 16)
    monkeypatch.setattr(skyline, "RANGES", 4)
    rng = np.random.default_rng(1)
    x = rng.integers(0, 40, (400, 3)).astype(float)
    if shape == "opposed":
        x[:, 1], x[:, 2] = 40 - x[:, 0], rng.integers(0, 2, 400)
    if shape == "one price":
        x[:350, 0] = 7
    if shape == "ties":
        x = x % 4
    rows = [(i, "a" if i % 3 else None, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, g string, x array<double>")
    got = {r.id for r in skyline.skyline(df, ["g"], [F.col("x")[k] for k in range(3)], ["id"]).collect()}
    assert got == brute(rows)


def test_skyline_of_odd_rows(spark):
    rows = [(1, 1.0, None), (2, float("nan"), 2.0), (3, 1.0, 2.0), (4, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    of = lambda d: {r.id for r in skyline.skyline(d, [], [F.col("a"), F.col("b")], ["id"]).collect()}
    assert of(df) == {3, 4} and of(df.where("false")) == set()


def test_rank_equals_a_window(spark):
    rows = [(i, i * 7 % 13 if i % 11 else None, i % 2) for i in range(300)] + [(500 + i, 5, 1) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, total long, side long").repartition(5)
    got = order.ranked(df, {"total": True, "side": False})
    want = df.withColumn("rank", F.rank().over(W.orderBy(F.desc("total"), "side")).cast("long"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    keys = df.select("total", "side")
    assert sorted(map(str, order.ranked(keys, {"total": True, "side": False}).collect())) == sorted(map(str, want.drop("id").collect()))
    assert order.ranked(df.where("false"), {"total": True}).collect() == []
    with pytest.raises(ValueError):
        order.ranked(df, {"total": True}, "side")


def test_order_statistics(spark, monkeypatch):
    monkeypatch.setattr(order, "BINS", 5)
    rng = np.random.default_rng(2)
    values = [int(v) for v in rng.integers(-10**12, 10**12, 200)] + [3] * 150 + [2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v long")
    places = [0, 1, 100, 201, 351]
    assert order.nth_values(df, "v", places) == [sorted(values)[p] for p in places]
    small = spark.createDataFrame([(v,) for v in (4, 1, 3, 9)], "v long")
    assert order.quantile(small, "v", 0.5) == 3.5 and order.quantile(small, "v", 0.25) == np.quantile([4, 1, 3, 9], 0.25)
    assert order.quantile(small.where("false"), "v", 0.5) is None


def test_no_window_over_all_managers(spark):
    out = star.derived(spark, "/root/testdata/sf0.001", "standings")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("__part" in line for line in plan.splitlines() if "Window" in line)


def landed_readings(spark, folder, k, rows):
    spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, value double").write.parquet(f"{folder}/{k}")


def test_keyed_state_over_restarts(spark, tmp_path):
    at = lambda h: dt.datetime(2026, 1, 1) + dt.timedelta(hours=h)
    landed, target, check = (str(tmp_path / x) for x in ("landed", "target", "check"))
    take = lambda: keyed.take_readings(spark, f"{landed}/*", "user_id bigint, event_id bigint, ts timestamp, value double", target, check, late="2 hours", quiet_ms=10 * 3600000).awaitTermination()
    landed_readings(spark, landed, 0, [(1, 1, at(0), 5.0), (1, 2, at(1), 6.0), (2, 3, at(1), 1.0)])
    take()
    take()  # nothing new: nothing repeated
    landed_readings(spark, landed, 1, [(1, 4, at(4), 7.0), (1, 5, at(-9), 9.0), (2, 6, at(20), 2.0)])
    take()
    landed_readings(spark, landed, 2, [(1, 7, at(30), 8.0), (2, 8, at(19), 3.0)])
    take()
    got = sorted((r.kind, r.user_id, r.event_id, r.value, r.previous) for r in spark.read.schema(keyed.OUT).parquet(target).collect())
    assert got == [
        # 4 is quiet once the watermark (18 h) has passed 14 h; 8 is in time and the last of its key; 5 is late.
        ("quiet", 1, 4, 7.0, None),
        ("reading", 1, 1, 5.0, None), ("reading", 1, 2, 6.0, 5.0), ("reading", 1, 4, 7.0, 6.0), ("reading", 1, 7, 8.0, None),
        ("reading", 2, 3, 1.0, None), ("reading", 2, 6, 2.0, 1.0), ("reading", 2, 8, 3.0, 2.0),
    ]


def test_keyed_state_lies_by_buckets_of_users(spark, tmp_path):
    """Users share a call and a row of state; nobody is one of them; who is quiet to the millisecond when the watermark comes is quiet."""
    at = lambda h: dt.datetime(2026, 1, 1) + dt.timedelta(hours=h)
    landed, target, check = (str(tmp_path / x) for x in ("landed", "target", "check"))
    take = lambda: keyed.take_readings(spark, f"{landed}/*", "user_id bigint, event_id bigint, ts timestamp, value double", target, check, late="2 hours", quiet_ms=10 * 3600000)
    users = [*range(1500), None]
    landed_readings(spark, landed, 0, [(u, 2 * k + i, at(i), float(k + i)) for k, u in enumerate(users) for i in (0, 1)])
    run = take()
    run.awaitTermination()
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3 * keyed.BUCKETS
    # The watermark comes to 11 h, which is 10 h after the last reading of everyone but user 3.
    landed_readings(spark, landed, 1, [(3, 10000, at(13), 5.0), (None, 10001, at(12), None)])
    take().awaitTermination()
    rows = spark.read.schema(keyed.OUT).parquet(target).collect()
    assert sorted(r.user_id for r in rows if r.kind == "quiet") == [u for u in users[:-1] if u != 3] and all(r.event_id % 2 == 1 and r.previous is None for r in rows if r.kind == "quiet")
    got = {r.event_id: (r.user_id, r.value, r.previous) for r in rows if r.kind == "reading"}
    assert len(got) == 2 * len(users) + 2 and got[10000] == (3, 5.0, 4.0) and got[10001][0] is None and got[10001][2] == 1501.0
    assert all(got[2 * k] == (u, float(k), None) and got[2 * k + 1] == (u, float(k + 1), float(k)) for k, u in enumerate(users))


def page(folder, n, entries):
    (folder / f"page-{n:03d}.json").write_text(json.dumps({"standings": {"page": n, "has_next": True, "results": [{"entry": e, "rank": e, "total": 10 * e} for e in entries]}}))


def test_paged_source_and_stream(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    paged.register(spark)
    uri = f"file://{folder}"
    read = lambda: sorted((r.page, r.entry, r.total) for r in spark.read.format(paged.NAME).option("path", uri).load().where("error is null").collect())
    assert read() == []
    page(folder, 1, [1, 2])
    page(folder, 2, [])
    (folder / "page-003.json").write_text('{"standings": ')
    (folder / "page-004.json").write_text("[]")
    (folder / "_ignored.json").write_text("x")
    assert read() == [(1, 1, 10), (1, 2, 20)]
    bad = spark.read.format(paged.NAME).option("path", uri).load().where("error is not null")
    assert sorted(r.error for r in bad.collect()) == ["page-003.json: JSONDecodeError", "page-004.json: TypeError"]
    assert spark.read.format(paged.NAME).option("path", uri).load().rdd.getNumPartitions() == 4

    def stream():
        out = spark.readStream.format(paged.NAME).option("path", uri).load().writeStream.format("parquet").option("path", str(tmp_path / "out"))
        out.option("checkpointLocation", str(tmp_path / "check")).trigger(once=True).start().awaitTermination()
        return sorted(r.entry for r in spark.read.parquet(str(tmp_path / "out")).where("error is null").collect())

    assert stream() == [1, 2]
    page(folder, 5, [9])
    assert stream() == [1, 2, 9]


def test_drifting_payloads(spark):
    rows = [(1, '{"k": 3}'), (2, '{"k": "4", "v": {"x": [1, 2]}}'), (3, "{"), (4, None), (5, '{"k": "no"}')]
    df = drift.opened(spark.createDataFrame(rows, "id int, t string"), "t")
    out = drift.typed(df, {"k": ("$.k", "bigint"), "x": ("$.v.x[1]", "int"), "gone": ("$.a.b", "string")})
    assert [(r.id, r.k, r.x, r.gone) for r in out.orderBy("id").collect()] == [(1, 3, None, None), (2, 4, 2, None), (3, None, None, None), (4, None, None, None), (5, None, None, None)]
    assert {r["shape"]: r.n for r in drift.shapes(df).collect()}["OBJECT<k: BIGINT>"] == 1
    assert [r.x for r in drift.exploded(df, "payload", "$.v.x", "x").select(F.col("x").cast("int").alias("x")).collect()] == [1, 2]


def test_page_elements_and_tables(spark):
    html = '<h1 class="x">A <b>b</b></h1><a href="/q">go\n<i>on</i></a><a name="n">no</a><!-- <table><tr><th>c</th></tr><tr><td>1</td></tr></table> -->'
    df = spark.createDataFrame([(1, html), (2, None), (3, "just a moment")], "page int, html string")
    got = {(r.page, r.kind, r.place, r.target, r.text) for r in pages.page_elements(df, "page").collect()}
    assert got == {(1, "heading", 1, "h1", "A b"), (1, "link", 1, "/q", "go\non")}
    assert [(r.page, r.place, r.cells) for r in pages.table_rows(df, "page").orderBy("place").collect()] == [(1, 0, ["c"]), (1, 1, ["1"])]


def live(points, lines):
    stats = [{"identifier": "minutes", "points": p, "value": 90} for p in lines]
    return json.dumps({"elements": [{"id": 1, "stats": {"minutes": 90, "total_points": points}, "explain": [{"fixture": 1, "stats": stats}]}]})


def test_one_gameweek_is_rewritten_alone(spark, tmp_path):
    for g, points in ((1, 2), (2, 3)):
        (tmp_path / f"live-{g}.json").write_text(live(points, [2]))
    store = Catalog(spark, str(tmp_path / "store"))
    files = lambda g: sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "store/game/live_stats.parquet" / f"gw={g}").glob("part-*"))
    assert refresh.load_live(store, str(tmp_path), [1, 2]) == 1
    first, second = files(1), files(2)
    (tmp_path / "live-2.json").write_text(live(3, [2, 1]))
    assert refresh.load_live(store, str(tmp_path), [2]) == 0
    assert files(1) == first and files(2) != second
    assert sorted((r.gw, r.total_points, r.adds_up) for r in store.load("game/live_stats").collect()) == [(1, 2, True), (2, 3, True)]
    assert refresh.load_live(store, str(tmp_path), []) == 0


def test_history_provider_and_page_jobs(spark, tmp_path):
    store, landed = Catalog(spark, str(tmp_path / "store")), str(tmp_path)
    with pytest.raises(FileNotFoundError):
        refresh.load_history(store, landed)
    (tmp_path / "season-2023-24.csv").write_text("name,element,GW,minutes\nA B,1,1,90\nC D,2,1,0\n")
    (tmp_path / "season-2024-25.csv").write_text("name,element,GW,minutes\nA B,1,1,45\n")
    (tmp_path / "lookup-2024-25.csv").write_text("element,position_lookup,team_lookup\n1,GKP,Leeds\n")
    assert refresh.load_history(store, landed) == 3
    rows = {(r.season, r.element): (r.minutes, r.position, r.team) for r in store.load("history/merged_gw").collect()}
    assert rows["2024-25", 1] == (45.0, "GK", "Leeds") and len(rows) == 3
    (tmp_path / "provider-EPL-2024.json").write_text(json.dumps({"players": [{"id": "7", "player_name": "A", "goals": "2"}], "dates": []}))
    assert refresh.load_provider(store, landed) == 1
    (tmp_path / "page-a.html").write_text("<title>Just a moment</title>")
    with pytest.raises(RuntimeError):
        refresh.load_pages(store, landed)
    (tmp_path / "page-b.html").write_text("<table><tr><th>x</th></tr><tr><td>1</td></tr></table>")
    assert refresh.load_pages(store, landed) == 2
    jobs = {"pages": lambda: 1 / 0, "history": lambda: refresh.load_history(store, landed)}
    done, code = refresh.run_jobs(jobs, frozenset({"pages"}))
    assert code == 0 and done["history"] == "ok"


def test_fit_in_steps_equals_the_local_fit(spark):
    import pandas as pd

    from touchline.operators import strength

    rng = np.random.default_rng(3)
    teams = [f"t{i}" for i in range(8)]
    rows = [(f"202{s}", dt.date(2020 + s, 1, 1) + dt.timedelta(days=7 * k), h, a, int(rng.poisson(1.6)), int(rng.poisson(1.1)))
            for s in range(3) for k, (h, a) in enumerate((h, a) for h in teams[s : s + 6] for a in teams[s : s + 6] if h != a)]
    df = spark.createDataFrame(rows, "season string, date date, home_team string, away_team string, home_goals int, away_goals int")
    as_of = pd.Timestamp("2023-06-01")
    want = strength.fit(df, as_of, 250.0)
    got, left = strength.fit_in_steps(df, as_of, 250.0)
    assert got.converged and got.promoted == want.promoted and got.n_matches == want.n_matches and got.defaults == pytest.approx(want.defaults)
    assert got.attack == pytest.approx(want.attack, abs=1e-4) and got.concede == pytest.approx(want.concede, abs=1e-4)
    assert (got.home_adv, got.base, got.rho) == pytest.approx((want.home_adv, want.base, want.rho), abs=2e-4)
    assert left[["attack", "concede"]].abs().to_numpy().max() < 1e-3
    assert strength.fit_in_steps(df.where("false"), as_of, 250.0)[0].attack == {}
