"""Absent users, hits, as-of joins of hot keys, tallies, manager states and appended partitions."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.operators import backtest, league, optimise, rates, state, strength
from touchline.sources.catalog import Catalog, key_range


def test_a_user_who_is_absent_leaves_gaps_empty(spark):
    standings = spark.createDataFrame([(e, 100 - e, e) for e in range(1, 13)], "entry long, total long, rank int")
    got = {r.label: (r.total, r.gap) for r in league.gap_targets(standings, 99, 10).collect()}
    assert got["1st"] == (99.0, None) and got["median"][1] is None and "one place up" not in got
    assert league.catchup_plan(standings, 99, 3).count() == 1 and league.gap_targets(standings, 3, 10).where("label = 'one place up'").first().total == 98.0


def test_hits_cost_points(spark):
    plan = spark.createDataFrame([(1, 7, True, True), (1, 8, True, False), (1, 9, False, False), (2, 7, True, False)], "gw int, player_id long, starts boolean, captain boolean")
    ep = spark.createDataFrame([(1, 7, 5.0), (1, 8, 2.0), (2, 7, 4.0)], "gw int, player_id long, ep double")
    hits = spark.createDataFrame([(1, 2), (2, 0)], "gw int, hits int")
    assert state.plan_points(plan, ep).first().ep == 16.0 and state.plan_points(plan, ep, hits).first().ep == 8.0
    assert state.plan_points(plan.where("gw > 9"), ep, hits.where("gw > 9")).first().ep == 0.0


def test_as_of_equals_a_search_for_each_row(spark):
    rng = np.random.default_rng(4)
    start = dt.datetime(2024, 1, 1)
    at = lambda k: start + dt.timedelta(hours=int(k))
    events = [(int(u), at(t), None if t % 11 == 0 else float(t)) for u, t in zip(rng.choice([1, 1, 1, 2, 3], 400), rng.integers(0, 4000, 400))]
    asked = [(u, at(t)) for u in (1, 2, 4) for t in range(0, 4200, 150)]
    df = spark.createDataFrame(events, "user long, ts timestamp_ntz, value double")
    out = state.latest_before(df, spark.createDataFrame(asked, "user long, as_of timestamp_ntz"), ["user"], "ts", "as_of", "value").collect()
    low = float("-inf")
    want = {}
    for u, t in asked:
        own = [(s, low if v is None else v, v) for k, s, v in events if k == u and s <= t]
        want[u, t] = max(own)[2] if own else None
    assert {(r.user, r.as_of): r.value for r in out} == want and len(out) == len(asked)


def test_baseline_takes_weeks_before_and_the_last_season(spark):
    rows = [(1, 1, 7, 2.0), (1, 2, 7, 4.0), (1, 2, 8, 6.0), (2, 1, 7, 9.0), (2, 3, 7, 1.0)]
    actual = spark.createDataFrame(rows, "season int, gw int, element long, actual double")
    got = {(r.season, r.gw, r.element): r.baseline for r in backtest.season_mean_baseline(actual, actual.select("season", "gw").distinct()).collect()}
    assert got == {(1, 2, 7): 2.0, (2, 1, 7): 3.0, (2, 1, 8): 6.0, (2, 3, 7): 9.0}


def test_recent_gameweeks(spark):
    rows = spark.createDataFrame([(g,) for g in (1, 2, 2, 5, 9)] + [(None,)], "gw int")
    assert sorted(r.gw for r in backtest.recent_gameweeks(rows, 2).collect()) == [5, 9]


def test_tallies_say_what_the_matches_say(spark):
    rng = np.random.default_rng(2)
    teams = [f"t{i}" for i in range(6)]
    rows = [(2000, dt.datetime(2003, 1, 1) + dt.timedelta(days=int(d)), h, a, int(rng.poisson(1.5)), int(rng.poisson(1.1))) for d in range(200) for h, a in [rng.choice(teams, 2, replace=False).tolist()]]
    df = spark.createDataFrame(rows, "season int, date timestamp_ntz, home_team string, away_team string, home_goals int, away_goals int")
    as_of = pd.Timestamp("2003-08-01")
    one, other = strength.fit_matches(df.toPandas(), as_of, 100.0), strength.fit_matches(strength.tallies(df, as_of, 100.0).toPandas(), as_of, 100.0)
    assert one.n_matches == other.n_matches == 200 and one.home_adv == pytest.approx(other.home_adv, abs=1e-3)
    assert all(one.attack[t] == pytest.approx(other.attack[t], abs=2e-3) for t in teams)


def test_rows_of_several_clubs_match_nobody(spark):
    rows = spark.createDataFrame([(1, "A"), (2, "A,B"), (3, None)], "row_id long, team_title string")
    assert sorted(r.row_id for r in rates.one_club(rows).collect()) == [1, 3]


def test_manager_state(spark):
    boot = spark.createDataFrame([([(7, 1, 3, 55, 2), (8, 4, 3, 60, None)],)], "elements array<struct<id:int,element_type:int,team:int,now_cost:int,cost_change_start:int>>")
    week = "struct<event:int,points:int,value:int,bank:int,event_transfers:int,event_transfers_cost:int,points_on_bench:int>"
    history = spark.createDataFrame([(1, [(1, 50, 1000, 5, 0, 0, 2), (2, 40, 1001, 7, 1, 0, 3)], [("Triple_Captain", 2)])], f"entry long, current array<{week}>, chips array<struct<name:string,event:int>>")
    picks = spark.createDataFrame(
        [(1, g, [(7, 1, 1, False, True), (8, 2, 3, True, False)]) for g in (1, 2)], "entry long, gw int, picks array<struct<element:int,position:int,multiplier:int,is_captain:boolean,is_vice_captain:boolean>>"
    )
    moves = spark.createDataFrame([(1, 8, 50, "2024-01-01"), (1, 8, 57, "2024-02-01")], "entry long, element_in int, element_in_cost int, time string")
    r = state.manager_state(boot, history, picks, moves).first()
    assert (r.entry, r.as_of_gw, r.bank, r.free) == (1, 2, 7, 1) and {c.chip: c.left for c in r.chips} == {"wildcard": 2, "freehit": 2, "bboost": 2, "3xc": 1}
    assert [(p.element, p.bought, p.selling, p.is_captain) for p in r.squad] == [(7, 53, 54, False), (8, 57, 58, True)]
    with pytest.raises(ValueError, match="no gameweek"):
        state.manager_state(boot, history.withColumn("current", F.slice("current", 1, 0)), picks, moves)


def test_append_replaces_only_its_partition(spark, tmp_path):
    store = Catalog(spark, f"file://{tmp_path}")
    one = spark.createDataFrame([(1, "a")], "id int, v string")
    store.append(one, "p/h", taken="1")
    store.append(one.withColumn("v", F.lit("b")), "p/h", taken="2")
    store.append(one.withColumn("v", F.lit("c")), "p/h", taken="1")
    assert sorted(r.v for r in store.load("p/h").collect()) == ["b", "c"] and store.names() == ["p/h"]
    assert tuple(key_range(one, "id").first()) == (1, "1", "1")


def test_best_squad_equals_enumeration():
    """Of a pool small enough to try every squad."""
    rng = np.random.default_rng(6)
    counts = {1: 3, 2: 6, 3: 6, 4: 4}
    pool = pd.DataFrame([(k, p, k % 7, int(rng.integers(40, 100)), float(rng.uniform(1, 8))) for k, p in enumerate(p for p, n in counts.items() for _ in range(n))], columns=["player_id", "position", "team", "price", "ep"])
    budget, best = 1040, -1.0
    by = {p: pool.index[pool["position"] == p].tolist() for p in counts}
    for parts in itertools.product(*[itertools.combinations(by[p], optimise.SIZE[p]) for p in counts]):
        squad = np.array([i for part in parts for i in part])
        if pool["price"].to_numpy()[squad].sum() <= budget and np.bincount(pool["team"].to_numpy()[squad]).max() <= 3:
            best = max(best, optimise.best_eleven(pool["position"].to_numpy()[squad], pool["ep"].to_numpy()[squad])[4])
    assert best > 0  # some squad is affordable
    got = optimise.optimise_squad(pool, budget)
    assert got.status == "Optimal" and got.value == pytest.approx(best)


def test_provider_falls_back_to_pages(tmp_path):
    from touchline.sources import fetch

    pages = {
        "http://p/getLeagueData/EPL/2024": (200, b'{"players": [1], "teams": {}, "dates": []}'), "http://p/getTeamData/Man_City/2024": (404, b""), "http://p/team/Man_City/2024": (200, b"<script>var datesData = JSON.parse('[{\"id\": \"5\"}]')</script>"),
        "http://p/getPlayerData/7": (200, b'{"matches": [{"id": "1"}]}'), "http://p/getMatchData/9": (404, b""), "http://p/match/9": (200, b"<html>nothing</html>"),
        "http://p/open": (200, b"<table></table>"), "http://p/shut": (200, b"<title>Just a moment</title>"), "http://p/gone": (404, b""),
    }
    client = fetch.Client(str(tmp_path), spacing=0, transport=lambda url, data, headers, timeout: (*pages[url], {}), sleep=lambda s: None)
    api = fetch.ProviderApi(client, "http://p/")
    assert api.league("EPL", "2024")["players"] == [1] and api.team("Man City", "2024") == {"dates": [{"id": "5"}], "players": [], "statistics": {}}
    assert api.player("7") == {"player_id": "7", "matches": [{"id": "1"}], "shots": []}
    with pytest.raises(fetch.FetchError, match="neither"):
        api.match_shots("9")
    site = fetch.GuardedPages(client, "http://p")
    assert site.fetch("open") == "<table></table>" and [(p, ok) for p, ok, _ in site.probe(["open", "shut", "gone"])] == [("open", True), ("shut", False), ("gone", False)]


def test_decision_of_a_manager(spark, tmp_path, capsys):
    """A whole squad from documents, its options compared, and the report of ten blocks."""
    import json

    from touchline.__main__ import main
    from touchline.plans import briefs

    counts = [1, 1, 1] + [2] * 6 + [3] * 6 + [4] * 4
    elements = [{"id": k, "web_name": f"p{k}", "team": k % 8 + 1, "element_type": p, "now_cost": 50 + k, "cost_change_start": 0, "status": "a", "minutes": 90, "total_points": k} for k, p in enumerate(counts)]
    landed = tmp_path / "landed"
    landed.mkdir()
    put = lambda name, value: (landed / f"{name}.json").write_text(json.dumps(value))
    put("bootstrap", {"elements": elements, "teams": [{"id": t, "name": f"T{t}", "short_name": f"T{t}"} for t in range(1, 9)], "events": [{"id": 1, "deadline_time": "2026-08-21T17:30:00Z", "finished": True}]})
    squad = [0, 1, *range(3, 8), *range(9, 14), *range(15, 18)]
    put("picks-5-1", {"entry": 5, "gw": 1, "automatic_subs": [], "picks": [{"element": e, "position": k + 1, "multiplier": 1, "is_captain": k == 3, "is_vice_captain": k == 4} for k, e in enumerate(squad)]})
    put("history-5", {"entry": 5, "current": [{"event": 1, "points": 40, "value": 1000, "bank": 30, "event_transfers": 0, "event_transfers_cost": 0, "points_on_bench": 0}], "chips": [{"name": "wildcard", "event": 1, "time": ""}]})
    put("transfers-5", [{"entry": 5, "event": 1, "element_in": 3, "element_in_cost": 51, "element_out": 8, "element_out_cost": 50, "time": "2026-08-01"}])
    root = tmp_path / "store"
    ep = spark.createDataFrame([(k, g, p, k % 8 + 1, 50 + k, float((k * 7 + g) % 11)) for k, p in enumerate(counts) for g in (2, 3)], "player_id long, gw int, position int, team int, price int, ep double")
    Catalog(spark, str(root)).save(ep, "projections/gw2-3")
    out = tmp_path / "decision.json"
    assert main(["decide", "--root", str(root), "--landed", str(landed), "--entry", "5", "--out", str(out)]) == 0
    record = json.loads(out.read_text())
    assert set(record["options"]) == {"hold", "wildcard", "freehit", "bboost", "3xc"} and record["best"] in record["options"] and "best:" in capsys.readouterr().out
    assert record["options"]["bboost"]["objective"] >= record["options"]["hold"]["objective"]
    picks = spark.createDataFrame([(e, 1, k, k + 1, 2 if k == e else 1, k == e, k == e + 1) for e in (5, 6) for k in range(e, e + 11)], "entry long, gw int, element long, slot int, multiplier int, is_captain boolean, is_vice_captain boolean")
    tables = {
        "standings": spark.createDataFrame([(5, 50, 1), (6, 40, 2)], "entry long, total long, rank int"), "picks": picks, "chips": spark.createDataFrame([], "entry long, name string, gw int"),
        "manager_gw": spark.createDataFrame([(5, 1, 50, 1000, 5, 0, 0), (6, 1, 40, 1000, 5, 0, 0)], "entry long, gw int, points int, value int, bank int, hits int, points_on_bench int"),
        "auto_subs": spark.createDataFrame([], "entry long, gw int, element_out long, element_in long"),
    }
    live = spark.createDataFrame([(1, k, k % 5, 90) for k in range(30)], "gw int, element long, points int, minutes int")
    players = spark.createDataFrame([(k, f"p{k}", "T", "MID") for k in range(30)], "element long, name string, team string, position string")
    blocks = briefs.league_blocks(tables, players, live, live.select("gw").distinct(), 6, 1, remaining=30)
    assert len(blocks) == 10 and all(b.count() > 0 for n, b in blocks.items() if n not in ("Totals that do not add up",))
    assert {r.topic: r.value for r in blocks["Takeaways"].collect()}["rival most alike"] == "5" and briefs.orphans(tables["standings"], picks, 6, 1, 1).collect()[0].element == 16
    assert briefs.deadline(spark.createDataFrame([(1, "2026-08-21T17:30:00Z")], "id int, deadline_time string"), 1).select(F.unix_seconds("deadline")).first()[0] == 1787333400
