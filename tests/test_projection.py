"""Projection and replay over two small invented seasons, and the command line."""

import json

import numpy as np
import pandas as pd
import pytest

from touchline.__main__ import main
from touchline.plans import projection
from touchline.sources.archive import CANONICAL, KINDS
from touchline.sources.catalog import Catalog

CLUBS = ["Arsenal", "Chelsea", "Everton", "Fulham"]


@pytest.fixture(scope="module")
def history(spark):
    rng, rows = np.random.default_rng(0), []
    for s, season in enumerate(("2024-25", "2025-26")):
        fixture = 0
        for gw in range(1, 7):
            order = rng.permutation(4)
            for h, a in ((order[0], order[1]), (order[2], order[3])):
                fixture += 1
                goals = rng.poisson(1.4), rng.poisson(1.1)
                for side, club in enumerate((h, a)):
                    for k, pos in enumerate(["GK", "DEF", "DEF", "MID", "MID", "FWD"]):
                        row = dict.fromkeys(CANONICAL)
                        minutes = float(rng.choice([90, 75, 20, 0], p=[0.6, 0.2, 0.1, 0.1]))
                        row |= {c: 0.0 for c in CANONICAL if c not in KINDS} | {
                            "season": season, "gw": gw, "element": 100 * s + int(club) * 10 + k, "name": f"Player {club} {k}", "position": pos, "team": CLUBS[club], "fixture": float(fixture),
                            "kickoff_time": (pd.Timestamp(f"{season[:4]}-08-01") + pd.Timedelta(days=7 * gw)).to_pydatetime(), "was_home": side == 0, "minutes": minutes, "starts": float(minutes > 45),
                            "team_h_score": float(goals[0]), "team_a_score": float(goals[1]), "value": 45.0 + 5 * k, "goals_conceded": float(goals[1 - side]), "recoveries": float(rng.integers(0, 8)), "tackles": float(rng.integers(0, 4)),
                            "clearances_blocks_interceptions": float(rng.integers(0, 6)), "saves": 3.0 * (pos == "GK"), "goals_scored": float(k > 2 and rng.random() < 0.3), "assists": float(k > 2 and rng.random() < 0.2),
                        }
                        row["clean_sheets"] = None
                        rows.append(tuple(row[c] for c in CANONICAL))
    return spark.createDataFrame(rows, ", ".join(f"{c} {KINDS.get(c, 'double')}" for c in CANONICAL)).cache()


def test_project(spark, history):
    elements = spark.createDataFrame([(c * 10 + k, f"Player {c} {k}", p, c + 1, 45 + 5 * k, "a", None, 180, 1, 0, 4, 2, 6, 3) for c in range(4) for k, p in enumerate([1, 2, 2, 3, 3, 4])],
        "id int, full_name string, element_type int, team int, now_cost int, status string, chance_of_playing_next_round int, minutes int, goals_scored int, assists int, clearances_blocks_interceptions int, tackles int, recoveries int, saves int")
    teams = spark.createDataFrame([(i + 1, c) for i, c in enumerate(CLUBS)], "id int, name string")
    fixtures = spark.createDataFrame([(1, 3, 1, 2), (2, 3, 3, 4), (3, 4, 1, 3)], "id int, event int, team_h int, team_a int")
    so_far = spark.createDataFrame([(c * 10 + k, 90, 1) for c in range(4) for k in range(6)] * 2, "element int, minutes int, starts int")
    out = projection.project(elements, teams, fixtures, so_far, history, [3, 4], pd.Timestamp("2026-08-20"), n_gws=2, n_sims=40, seed=1)
    rows = {(r.player_id, r.gw): r for r in out.collect()}
    assert len(rows) == 48 and rows[0, 3].ep > 0 and rows[10, 4].ep == 0.0
    assert all(r.p10 <= r.p50 <= r.p90 and r.sd >= 0 and r.exp_minutes > 0 for r in rows.values())


def test_backtest(history):
    out = projection.run_backtest(history, [("2025-26", 4)], n_sims=30)
    assert out["predictions"].count() >= 20
    errors = {r.model: r for r in out["errors"].collect()}
    assert set(errors) == {"ep", "baseline"} and errors["ep"].rmse < 6 and errors["ep"].n > 10
    assert out["calibration"].count() == 7


def test_commands(spark, tmp_path, capsys):
    landed = tmp_path / "landed"
    landed.mkdir()
    boot = {"elements": [{"id": 1, "web_name": "A", "first_name": "A", "second_name": "B", "team": 1, "element_type": 3, "now_cost": 55, "status": "i", "selected_by_percent": "1.0", "minutes": 90,
                          "price_change_projections": [{"offset": 0, "projected_percent": "90", "likelihood": 1}]}],
            "teams": [{"id": 1, "name": "Arsenal", "short_name": "ARS"}], "events": [{"id": 1, "deadline_time": "2026-08-21T17:30:00Z", "finished": True}]}
    (landed / "bootstrap.json").write_text(json.dumps(boot))
    (landed / "fixtures-1.json").write_text(json.dumps([{"id": 1, "event": 1, "stats": [{"identifier": "bps", "h": [{"element": 1, "value": 9}], "a": []}, {"identifier": "bonus", "h": [{"element": 1, "value": 3}], "a": []}]}]))
    (landed / "live-1.json").write_text(json.dumps({"elements": [{"id": 1, "stats": {"minutes": 90, "total_points": 2}, "explain": [{"fixture": 1, "stats": [{"identifier": "minutes", "points": 2, "value": 90}]}]}]}))
    entry = {"active_chip": None, "automatic_subs": [], "picks": [{"element": 1, "position": 1, "multiplier": 2, "is_captain": True, "is_vice_captain": False}]}
    for e in (7, 8):
        (landed / f"picks-{e}-1.json").write_text(json.dumps({"entry": e, "gw": 1} | entry))
        (landed / f"history-{e}.json").write_text(json.dumps({"entry": e, "current": [{"event": 1, "points": 4, "value": 1000, "bank": 0, "event_transfers": 0, "event_transfers_cost": 0, "points_on_bench": 0}], "chips": []}))
    (landed / "standings.json").write_text(json.dumps({"standings": {"has_next": False, "results": [{"entry": 7, "entry_name": "x", "player_name": "y", "rank": 1, "total": 4}, {"entry": 8, "entry_name": "x", "player_name": "y", "rank": 2, "total": 3}]}}))
    root = str(tmp_path / "store")
    run = lambda *a: main([a[0], "--root", root, "--landed", str(landed), "--gws", "1", *a[1:]])
    assert run("refresh") == 0
    for command, mark in (("tables", "game/elements"), ("movers", "rise"), ("risks", "injured"), ("reconcile", "yes"), ("brief", "<html>")):
        assert run(command) == 0 and mark in capsys.readouterr().out, command
    assert run("brief", "--entry", "8") == 0
    page = capsys.readouterr().out
    # The squad that was picked, the fixtures of the gameweeks asked for, and when the first one closes.
    assert "2026-08-21 17:30:00" in page and page.count("<td>ARS</td>") >= 1 and "<h2>Fixtures</h2><table>" in page and "<h2>Squad</h2><table>" in page
    assert run("league", "--entry", "8") == 0 and "125.00" not in capsys.readouterr().out
    assert Catalog(spark, root).exists("prices/history")
