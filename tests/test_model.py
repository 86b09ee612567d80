import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.functions import scoring
from touchline.operators import backtest, matches, minutes, rates, simulate, strength


def league_table(seasons=(2001, 2002, 2003), teams=6, seed=0):
    rng = np.random.default_rng(seed)
    power, rows = rng.normal(0, 0.3, teams + 3), []
    for k, s in enumerate(seasons):
        here = [t for t in range(teams + 3) if t < teams - 1 or t == teams - 1 + k]
        for h in here:
            for a in here:
                if h != a:
                    rows.append((s, pd.Timestamp(f"{s}-08-01") + pd.Timedelta(days=int(rng.integers(0, 280))), f"T{h}", f"T{a}", int(rng.poisson(np.exp(0.4 + power[h] - power[a]))), int(rng.poisson(np.exp(0.1 + power[a] - power[h])))))
    return pd.DataFrame(rows, columns=["season", "date", "home_team", "away_team", "home_goals", "away_goals"])


def test_gradient_matches_differences():
    t = league_table()
    teams = sorted(set(t.home_team))
    at = {x: i for i, x in enumerate(teams)}
    n = len(teams)
    pair = [("T0", "T1")]
    slot = np.array([0 if p == pair[0] else -1 for p in zip(t.home_team, t.away_team)])
    f = strength.objective(t.home_team.map(at).to_numpy(), t.away_team.map(at).to_numpy(), t.home_goals.to_numpy(float), t.away_goals.to_numpy(float), np.full(len(t), 0.7), np.full(n, 0.5), np.zeros(n), np.full(n, 0.1), slot, np.array([2.0]))
    x = np.random.default_rng(1).normal(0, 0.1, 2 * n + 4)
    _, g = f(x)
    for i in range(len(x)):
        d = np.zeros(len(x))
        d[i] = 1e-6
        assert (f(x + d)[0] - f(x - d)[0]) / 2e-6 == pytest.approx(g[i], rel=1e-4, abs=1e-4)


def test_fit_finds_a_minimum_within_bounds():
    t = league_table()
    m = strength.fit_matches(t, pd.Timestamp("2004-07-01"), 400.0)
    assert m.converged and strength.RHO_BOUNDS[0] <= m.rho <= strength.RHO_BOUNDS[1] and m.n_matches == len(t)
    better = sorted(m.attack, key=m.attack.get)
    scored = t.groupby("home_team").home_goals.mean()
    assert scored[better[-1]] > scored[better[0]]
    assert m.rates("new", "T0") == m.rates("newer", "T0")


def test_walk_forward_and_pairs(spark):
    df = spark.createDataFrame(league_table())
    out = strength.walk_forward(df, (100.0, 800.0), n_folds=1)
    assert {r.half_life_days: r.oos_matches > 0 for r in out.collect()} == {100.0: True, 800.0: True}
    assert strength.best_half_life(out) in (100.0, 800.0)
    found = strength.pairwise_effects(df, 400.0, at_least=3, n_folds=1)
    assert found["pairs"] and found["verdict"] in ("kept", "not supported")


def test_score_matrix_adds_up(spark):
    df = spark.createDataFrame([("A", "B", 1.5, 1.1)], "home_team string, away_team string, lambda_home double, lambda_away double")
    cells = strength.score_matrix(df, -0.1, ["home_team", "away_team"])
    p = {(r.h, r.a): r.p for r in cells.collect()}
    assert sum(p.values()) == pytest.approx(1.0) and len(p) == 121
    assert p[1, 1] / p[2, 2] == pytest.approx((1.5 * 1.1 * 1.1) / (1.5**2 / 2 * 1.1**2 / 2), rel=1e-9)


def test_promotions_and_matches(spark):
    df = spark.createDataFrame(league_table())
    promoted = {(r.season, r.team) for r in matches.find_promotions(matches.sides(df)).collect()}
    assert promoted == {(2002, "T6"), (2003, "T7")}
    prior = matches.promoted_prior(matches.sides(df)).first()
    assert prior.promotions == 2 and prior.attack != 0
    assert matches.promoted_prior(matches.sides(df), exclude_season=2002).first().promotions == 1
    none = matches.promoted_prior(matches.sides(df.where("season = 2001"))).first()
    assert (none.attack, none.concede, none.promotions) == (0.0, 0.0, 0)
    rows = spark.createDataFrame(
        [("s", 1, "Man United", True, 2, 1, "2026-01-01"), ("s", 1, "manchester united", True, 2, 1, "2026-01-01"), ("s", 1, "Spurs", False, 2, 1, "2026-01-01"), ("s", 2, "Spurs", True, None, 1, "2026-01-01")],
        "season string, fixture int, team string, was_home boolean, team_h_score int, team_a_score int, kickoff_time string",
    )
    m = matches.match_table(rows).collect()
    assert len(m) == 1 and (m[0].away_team, m[0].home_goals) == ("Spurs", 2)
    assert matches.folds(df, 2).count() == 2


def test_minutes(spark):
    priors = minutes.fallback_priors(spark)
    assert priors.count() == 12
    elements = spark.createDataFrame([(1, "A B", 4, 1, 80, "a", None), (2, "C D", 4, 1, 80, "d", None), (3, "E F", 1, 2, 45, "u", 50)], "id int, full_name string, element_type int, team int, now_cost int, status string, chance_of_playing_next_round int")
    so_far = spark.createDataFrame([(1, 90, 1), (1, 80, 1), (2, 20, 0)], "element int, minutes int, starts int")
    own = spark.createDataFrame([("a b", 30, 1.0, 1.0)], "name_key string, prior_games int, p_play_obs double, p_start_obs double")
    got = {r.player_id: r for r in minutes.estimate_minutes(elements, so_far, 2, priors, own).collect()}
    weight = 30 / 36
    assert got[1].p_start == pytest.approx((2 + 2 * (weight + (1 - weight) * 0.72 * 0.92)) / 4)
    assert got[2].p_play == pytest.approx((1 + 2 * 0.32) / 4 * 0.75) and got[3].p_play == 0.0
    for r in got.values():
        assert 0 <= r.p_start <= r.p_play <= 1 and r.exp_minutes == pytest.approx(r.p_start * r.minutes_if_started + r.p_sub * r.minutes_if_sub)


def test_rates(spark):
    edges = spark.createDataFrame([(3, [40.0, 60.0, 80.0, 120.0])], "position int, edges array<double>")
    priors = spark.createDataFrame([(3, 1, "goals_scored", 0.2, 5.0)], "position int, tier int, stat string, mu double, n0 double")
    cols = ", ".join(f"{s} int" for s in rates.STATS)
    players = spark.createDataFrame([(1, 3, 70, 900, 4, 0, 0, 0, 0, 9), (2, 1, 45, 900, 1, 0, 0, 0, 0, 30)], f"player_id int, position int, price int, minutes int, {cols}")
    provider = spark.createDataFrame([(1, 6.0, None)], "player_id int, xg double, xa double")
    got = {r.player_id: r for r in rates.posterior_rates(players, priors, edges, provider).collect()}
    assert got[1].goals_scored_p90 == pytest.approx((5 * 0.2 + 5.0) / 15) and got[1].saves_p90 == 0.0
    assert got[2].goals_scored_p90 == 0.0 and got[2].saves_p90 == pytest.approx((6 * 1.0 + 30) / 16)
    left = spark.createDataFrame([(1, "x", "t1"), (2, "y", "t9"), (3, "z", "t9"), (4, "z", "t8")], "id int, name_key string, team_key string")
    right = spark.createDataFrame([(10, "x", "t1"), (11, "y", "t2"), (12, "z", "t3")], "row_id int, name_key string, team_key string")
    assert {(r.id, r.row_id) for r in rates.name_match(left, right).collect()} == {(1, 10), (2, 11)}


def cast(spark):
    cols = "player_id int, position int, team int, price int, p_play double, p_start double, exp_minutes double, minutes_if_started double, minutes_if_sub double, " + ", ".join(f"{s}_p90 double" for s in rates.STATS) + ", yellow_p90 double, red_p90 double, own_goal_p90 double"
    rows = [(t * 10 + i, p, t, 50, 0.9, 0.8, 70.0, 85.0, 20.0, 0.3 if p > 1 else 0.0, 0.2 if p > 1 else 0.0, 3.0, 1.5, 4.0, 3.0 if p == 1 else 0.0, 0.1, 0.005, 0.003) for t in (1, 2) for i, p in enumerate([1, 2, 2, 3, 3, 4])]
    rows.append((99, 4, 1, 50, 0.01, 0.0, 0.0, 80.0, 20.0, *[0.1] * 6, 0.1, 0.0, 0.0))
    return spark.createDataFrame(rows, cols)


def test_simulation(spark):
    fixtures = spark.createDataFrame([(1, 1, 1, 2, 1.6, 1.1), (1, 2, 2, 1, 1.2, 1.2), (2, 3, 1, 2, 1.6, 1.1)], "gw int, fixture int, home_id int, away_id int, lambda_home double, lambda_away double")
    players = cast(spark)
    a = simulate.simulate(fixtures, players, rho=-0.1, assisted=0.8, n_sims=150, seed=3)
    b = simulate.simulate(fixtures.repartition(7), players.repartition(5), rho=-0.1, assisted=0.8, n_sims=150, seed=3)
    got, again = ({(r.player_id, r.gw): r for r in df.collect()} for df in (a, b))
    assert got == again and len(got) == 13 * 2
    assert got[99, 1].ep == 0.0 and got[99, 1].p90 == 0.0
    assert got[15, 1].ep > 1.4 * got[15, 2].ep  # two matches in gameweek 1
    assert all(r.p10 <= r.p25 <= r.p50 <= r.p75 <= r.p90 for r in got.values())
    scores = simulate.scorelines(fixtures, -0.1, 1500, 3).groupBy("fixture").agg(F.avg("home_goals").alias("m")).collect()
    assert {r.fixture: r.m for r in scores}[1] == pytest.approx(1.6, abs=0.15)


def test_draws(spark):
    df = spark.range(20000).select(
        simulate.poisson_draw(F.lit(1.7), simulate.uniform(1, "p", F.col("id"))).alias("k"), simulate.normal(1, "n", F.col("id")).alias("z"), simulate.uniform(1, "u", F.col("id")).alias("u")
    ).agg(F.avg("k").alias("km"), F.var_samp("k").alias("kv"), F.avg("z").alias("zm"), F.stddev("z").alias("zs"), F.min("u").alias("lo"), F.max("u").alias("hi")).first()
    assert df.km == pytest.approx(1.7, abs=0.05) and df.kv == pytest.approx(1.7, abs=0.1) and df.zm == pytest.approx(0, abs=0.03) and df.zs == pytest.approx(1, abs=0.03) and 0 < df.lo < df.hi < 1


def test_backtest(spark):
    df = spark.createDataFrame([(float(i), 1.0, 2.0, 3.0, 4.0, 5.0) for i in range(1, 6)], "actual double, p10 double, p25 double, p50 double, p75 double, p90 double")
    got = {r["quantile"]: (r.nominal, r.coverage) for r in backtest.calibration(df).collect()}
    assert got["p50"] == (0.5, 0.6) and got["p10-p90"] == (0.8, 1.0) and got["p25-p75"] == (0.5, 0.6)
    e = backtest.errors(spark.createDataFrame([(3.0, 1.0), (0.0, 0.0)], "p double, actual double"), "p").first()
    assert e.rmse == pytest.approx(2**0.5) and (e.mae, e.n) == (1.0, 2)
    actual = spark.createDataFrame([("a", 1, 1, 4.0), ("a", 2, 1, 2.0), ("b", 1, 1, 9.0), ("b", 2, 1, 1.0)], "season string, gw int, element int, actual double")
    base = {(r.season, r.gw): r.baseline for r in backtest.season_mean_baseline(actual, actual.select("season", "gw").distinct()).collect()}
    assert base == {("a", 2): 4.0, ("b", 1): 3.0, ("b", 2): 9.0}


def test_simulated_counts_are_drawn_in_columns(spark):
    """No lambda follows a distribution row by row."""
    fixtures = spark.createDataFrame([(1, 1, 1, 2, 1.6, 1.1), (1, 2, 2, 1, 1.2, 1.2)], "gw int, fixture int, home_id int, away_id int, lambda_home double, lambda_away double")
    filled = cast(spark).na.fill({"yellow_p90": 0.08, "red_p90": 0.003, "own_goal_p90": 0.002})
    cells = simulate.simulate_cells(fixtures, filled, simulate.scorelines(fixtures, -0.1, 20, 3), 0.8, 3, 1.35, 20)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "ArrowEvalPython" in plan


def test_counts_of_columns_are_those_of_rows(spark):
    rate = [0.0, -1.0, 0.003, 0.4, 1.7, 9.0, 40.0, 120.0, float("nan")]
    pdf = pd.DataFrame([(r, (i + 0.5) / 50) for r in rate[:-1] for i in range(50)] + [(0.5, 1 - 2**-53)], columns=["rate", "u"])
    want = [r.k for r in spark.createDataFrame(pdf).select(simulate.poisson_draw(F.col("rate"), F.col("u")).alias("k")).collect()]
    assert simulate.poisson_counts(pdf["rate"].to_numpy(), pdf["u"].to_numpy()).tolist() == want
    assert simulate.poisson_counts(np.array([float("nan")]), np.array([0.5])).tolist() == [0]


def test_names_that_many_share_are_not_paired(spark):
    """Rows joined stay as many as the left side has, however many rows share a name and team on the right."""
    left = spark.range(300).select(F.col("id"), F.lit("a").alias("name_key"), F.lit("t").alias("team_key"))
    right = spark.range(400).select((F.col("id") + 5).alias("row_id"), F.lit("a").alias("name_key"), F.lit("t").alias("team_key"))
    for by_name in (True, False):
        got = rates.name_match(left, right, by_name=by_name)
        assert {tuple(r) for r in got.collect()} == {(i, 5) for i in range(300)}
        assert "min(row_id" in got._jdf.queryExecution().optimizedPlan().toString() and "row_number" not in got._jdf.queryExecution().optimizedPlan().toString()


def squads(spark, n):
    """Two teams of n players."""
    line = cast(spark).where("player_id in (10, 11, 13, 15)")
    return line.crossJoin(spark.range(n // 2).withColumnRenamed("id", "k")).withColumns({"player_id": F.col("k") * 20 + F.col("position"), "team": (F.col("position") % 2 + 1).cast("int")}).drop("k")


MATCHES_OF_TWO = [(1, 1, 1, 2, 1.6, 1.1), (1, 2, 2, 1, 1.2, 1.2), (2, 3, 1, 2, 1.6, 1.1)], "gw int, fixture int, home_id int, away_id int, lambda_home double, lambda_away double"


def shuffled_rows(spark, run):
    """Rows that all stages of a run shuffle."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (x.apply(i) for x in [store.stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)] for i in range(x.size()))}
    before = stages()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in stages().items() if k not in before)


def test_simulated_players_are_not_shuffled(spark):
    fixtures, players, sims = spark.createDataFrame(*MATCHES_OF_TWO), squads(spark, 300), 40
    rows = shuffled_rows(spark, lambda: simulate.simulate(fixtures, players, rho=-0.1, assisted=0.8, n_sims=sims, seed=3).collect())
    assert 0 < rows < 600 * 3 * sims / 2


@pytest.mark.parametrize("kind", ("int", "bigint"))
def test_chunks_of_players_give_what_their_rows_give(spark, monkeypatch, kind):
    """Whole numbers equal those of simulate_cells(), however players are cut into chunks and simulations into blocks."""
    fixtures = spark.createDataFrame(*MATCHES_OF_TWO)
    unlikely = F.when(F.col("player_id") == 23, 0.01).otherwise(F.col("p_play"))
    # Rates that are missing or below 0 draw nothing.
    players = squads(spark, 24).withColumns({"player_id": F.col("player_id").cast(kind), "p_play": unlikely, "tackles_p90": F.when(F.col("player_id") % 3 > 0, F.col("tackles_p90")), "assists_p90": F.when(F.col("player_id") == 4, -1.0).otherwise(F.col("assists_p90"))})
    filled = players.na.fill({"yellow_p90": 0.08, "red_p90": 0.003, "own_goal_p90": 0.002})
    cells = simulate.simulate_cells(fixtures, filled, simulate.scorelines(fixtures, -0.1, 30, 3), 0.8, 3, 1.35, 30)
    table = lambda df: {(r.player_id, r.gw): (r.ep, round(r.sd, 9), r.p10, r.p25, r.p50, r.p75, r.p90) for r in df.collect()}
    want = table(simulate.summarise(cells, fixtures, players, 30))
    assert len(want) == 96 and want[23, 1] == (0.0,) * 7 and want[4, 1][0] > 0
    for chunk, held in ((500, 1 << 16), (5, 16), (1, 4)):
        monkeypatch.setattr(simulate, "CHUNK", chunk)
        monkeypatch.setattr(simulate, "CELLS", held)
        assert table(simulate.simulate(fixtures, players, rho=-0.1, assisted=0.8, n_sims=30, seed=3)) == want
    assert table(simulate.simulate(fixtures, players.where("false"), rho=-0.1, assisted=0.8, n_sims=30, seed=3)) == {}


def test_hashes_of_arrays_are_those_of_columns(spark):
    values = [0, 1, -1, 7, 2**31 - 1, -(2**31)]
    df = spark.createDataFrame([(v, v * 2**31 + 5) for v in values], "i int, l bigint")
    rows = df.select(F.xxhash64(F.lit(7), F.lit("play")).alias("k"), F.xxhash64(F.lit(7), F.lit("play"), "i").alias("i"), F.xxhash64(F.lit(7), F.lit("play"), "i", "l").alias("l"), simulate.uniform(7, "play", F.col("i"), F.col("l")).alias("u")).collect()
    state = np.array([r.k for r in rows]).view(np.uint64)
    narrow = simulate.hashed(np.array(values), state, False)
    wide = simulate.hashed(np.array([v * 2**31 + 5 for v in values]), narrow, True)
    assert narrow.view(np.int64).tolist() == [r.i for r in rows] and wide.view(np.int64).tolist() == [r.l for r in rows]
    assert simulate.uniforms(wide).tolist() == [r.u for r in rows]


def test_scores_of_arrays_are_those_of_columns(spark):
    rng = np.random.default_rng(5)
    names = [s for s in scoring.R.API_STATS if not s.startswith("penalties")] + ["bonus"]
    lines = pd.DataFrame({s: rng.integers(0, {"minutes": 97, "recoveries": 14}.get(s, 7), 400) * (rng.random(400) < 0.8) for s in names}).assign(position=rng.integers(1, 5, 400), k=range(400))
    df = spark.createDataFrame(lines)
    stats = scoring.stat_columns(df)
    want = df.select(scoring.points(stats, F.col("position")).alias("p"), scoring.bps(stats, F.col("position")).alias("b")).orderBy("k").collect()
    arrays = {s: lines[s].to_numpy() for s in names}
    assert scoring.points_of(arrays, lines["position"].to_numpy()).tolist() == [r.p for r in want]
    assert scoring.bps_of(arrays, lines["position"].to_numpy()).tolist() == [r.b for r in want]
    with pytest.raises(ValueError):
        scoring.bps_of(arrays, np.full(400, 5))
