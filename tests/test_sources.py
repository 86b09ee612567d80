import json

import pytest
from pyspark.sql import functions as F

from touchline.functions import names
from touchline.sources import archive, fetch, pages, payloads as P
from touchline.sources.catalog import Catalog, stringified


def test_catalog(spark, tmp_path):
    store = Catalog(spark, str(tmp_path))
    for bad in ("", "/x", "a/../b", "a//b"):
        with pytest.raises(ValueError):
            store.path_for(bad)
    with pytest.raises(FileNotFoundError):
        store.load("a/b")
    assert store.age_days("a/b") is None and store.names() == []
    store.save(spark.range(3), "a/b")
    store.save(spark.range(5).withColumn("none", F.lit(None)), "a/b")
    assert store.load("a/b").count() == 5 and store.names() == ["a/b"] and store.describe() == [("a/b", 5, 2)]
    assert store.age_days("a/b") < 1 and store.newest("a") == "a/b"
    nested = spark.createDataFrame([(1, ["x"])], "a int, b array<string>")
    assert stringified(nested).first().b == '["x"]'


LIVE = {"elements": [
    {"id": 1, "modified": False, "stats": {"minutes": 90, "goals_scored": 1, "total_points": 6, "ict_index": "11.8", "influence": "none"},
     "explain": [{"fixture": 3, "stats": [{"identifier": "minutes", "points": 2, "value": 90, "points_modification": 0}, {"identifier": "goals_scored", "points": 4, "value": 1}]}]},
    {"id": 2, "modified": False, "stats": {"minutes": 0, "total_points": 0}, "explain": [{"fixture": 3, "stats": [{"identifier": "minutes", "points": 0, "value": 0, "points_modification": 0}]}]},
]}


def test_live_payload(spark, tmp_path):
    (tmp_path / "live.json").write_text(json.dumps(LIVE))
    doc = P.read_json(spark, str(tmp_path / "live.json"), P.LIVE, ("elements",))
    points = {r.element: r for r in P.live_points_frame(doc, 1).collect()}
    assert points[1].ict_index == 11.8 and points[1].influence is None and points[1].gw == 1
    lines = P.live_explain_frame(doc, 1)
    rebuilt = {r.element: r.p for r in lines.groupBy("element").agg(F.sum(F.col("points") + F.col("points_modification")).alias("p")).collect()}
    assert rebuilt == {e: r.total_points for e, r in points.items()}
    with pytest.raises(ValueError):
        P.read_json(spark, str(tmp_path / "live.json"), "nothing string", ("nothing",))


def test_fixture_payload(spark, tmp_path):
    doc = [{"id": 1, "event": 1, "kickoff_time": "2026-08-21T19:00:00Z", "finished": True, "team_h": 1, "team_a": 2, "stats": [{"identifier": "bps", "h": [{"value": 41, "element": 15}], "a": [{"value": -3, "element": 9}]}, {"identifier": "saves", "h": [], "a": []}]},
           {"id": 2, "event": 2, "kickoff_time": None, "finished": False, "team_h": 3, "team_a": 4, "stats": []}]
    (tmp_path / "f.json").write_text(json.dumps(doc))
    f = P.read_json(spark, str(tmp_path / "f.json"), P.FIXTURES)
    assert {(r.side, r.element, r.value) for r in P.fixture_stats_frame(f).collect()} == {("h", 15, 41), ("a", 9, -3)}
    flat = P.fixtures_frame(f)
    assert "stats" not in flat.columns and dict(flat.dtypes)["kickoff_time"] == "timestamp"
    assert [r.gw for r in P.final_gameweeks(f).collect()] == [1]
    assert {(r.gw, r.team) for r in P.pending_teams(f).collect()} == {(2, 3), (2, 4)}


def test_events_and_elements(spark):
    events = spark.createDataFrame([(1, True, True, False, False), (2, False, False, True, False), (3, False, False, False, True)], "id int, finished boolean, data_checked boolean, is_current boolean, is_next boolean")
    assert (P.marked_event(events, "is_current"), P.marked_event(events, "is_next"), P.finished_events(events)) == (2, 3, [1])
    assert [r.gw for r in P.gameweeks_played(events).collect()] == [1, 2]
    elements = spark.createDataFrame([(1, "A", None, 1, 1, 45), (2, "B", "C", 9, 4, 50)], "id int, first_name string, second_name string, team int, element_type int, now_cost int")
    teams = spark.createDataFrame([(1, "Arsenal", "ARS")], "id int, name string, short_name string")
    got = {r.id: r for r in P.elements_frame(elements, teams).collect()}
    assert (got[1].full_name, got[1].position, got[1].team_short, got[1].price) == ("A", "GKP", "ARS", 4.5) and got[2].team_name is None


def test_shots(spark):
    row = spark.createDataFrame([([("1", "2026", "5", "2026-01-01 12:00:00", "7", "9", "X", "h", "H", "A", "1", "0", "Goal", "0.9", "0.5", "0.3", "s", "t", "l", None)], None)], P.SHOTS)
    out = P.shots_frame(row)
    assert len(out.columns) == 22
    s = out.first()
    assert s.team == "H" and s.is_goal and s.xg == 0.3 and s.minute == 7.0
    empty = P.shots_frame(spark.createDataFrame([(None, None)], P.SHOTS))
    assert empty.count() == 0 and empty.columns == out.columns


def test_archive_seasons(spark, tmp_path):
    old, new = tmp_path / "old.csv", tmp_path / "new.csv"
    old.write_bytes("name,element,round,GW,minutes,was_home,kickoff_time,kickoff_time_formatted,tackled,id\nAaron_Cresswéll_376,376,1,1,90,True,2016-08-15T19:00:00Z,x,2,9\n".encode("latin-1"))
    new.write_text("name,position,team,xP,element,round,minutes,was_home,expected_goals\nBukayo Saka,GKP,Arsenal,4.5,7,3,abc,false,0.4\n")
    lookup = spark.createDataFrame([(376, "DEF", "West Ham")], "element int, position_lookup string, team_lookup string")
    a = archive.normalise_season(archive.read_csv(spark, str(old)), "2016-17", lookup)
    b = archive.normalise_season(archive.read_csv(spark, str(new)), "2026-27")
    assert a.columns[: len(archive.CANONICAL)] == list(archive.CANONICAL) and "tackled" in a.columns and "id" not in a.columns
    both = {r.season: r for r in archive.union_seasons([a, b]).collect()}
    first, last = both["2016-17"], both["2026-27"]
    assert (first["name"], first.element, first.gw, first.position, first.team, first.was_home, first.tackled) == ("Aaron Cresswéll", 376, 1, "DEF", "West Ham", True, "2")
    assert (last.position, last.gw, last.minutes, last.xp, last.expected_goals, last.was_home, last.tackled) == ("GK", 3, None, 4.5, 0.4, False, None)


def test_names(spark):
    for raw, key in (("Ødegaard", "degaard"), ("Groß", "gro"), ("João  Félix-Silva", "joao felix silva"), ("O'Brien", "o brien"), (None, "")):
        assert names.player_key_of(raw) == key
    df = spark.createDataFrame([("Ødegaard", " manchester   united "), ("O'Brien Jr.", "New Club"), (None, None)], "n string, c string")
    got = df.select(names.player_key(F.col("n")).alias("k"), names.club(F.col("c")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("degaard", "Man Utd"), ("o brien jr", "New Club"), ("", "")]
    split = spark.createDataFrame([("A_B_376",), ("A_B",), ("376",)], "n string")
    name, number = names.split_trailing_id(F.col("n"))
    assert [tuple(r) for r in split.select(name, number).collect()] == [("A B", 376), ("A B", None), ("376", None)]


def test_pages(spark):
    html = r"<script>var data = JSON.parse('\x7B\x22a\x22:\x22\xc3\xa9\x22\x7D')</script>"
    assert pages.embedded_json(html, "data") == {"a": "é"}
    with pytest.raises(ValueError):
        pages.embedded_json(html, "other")
    hidden = "<p>x</p><!-- note --><!--<table><tr><th></th><th colspan='2'>Expected</th></tr><tr><th>Name</th><th>xG</th><th>xA</th></tr><tr><td>S</td><td>1</td><td>2</td></tr></table>-->"
    assert pages.page_tables(hidden) == [(["Name", "Expected_xG", "Expected_xA"], [["S", "1", "2"]])]
    for bad in ("<p>none</p>", "<title>Just a moment...</title><table></table>"):
        with pytest.raises(ValueError):
            pages.page_tables(bad)
    row = spark.createDataFrame([(hidden,)], "h string").select(pages.uncommented(F.col("h")).alias("u"), pages.without_comments(F.col("h")).alias("w"), pages.challenged(F.lit("Just a moment")).alias("c")).first()
    assert row.u.startswith("<p>x</p><!-- note --><table>") and row.w == "<p>x</p>" and row.c


def test_client(tmp_path):
    answers = [(503, b"", {"Retry-After": "7"}), (200, b'{"elements": [], "teams": [], "events": []}', {})]
    slept = []
    client = fetch.Client(str(tmp_path), spacing=0.0, transport=lambda *a: answers.pop(0), sleep=slept.append)
    api = fetch.GameApi(client, "http://example.test/api")
    assert api.bootstrap()["teams"] == [] and 7.0 in slept and client.calls == 2
    assert api.bootstrap()["teams"] == [] and client.hits == 1
    broken = fetch.Client(str(tmp_path / "x"), spacing=0.0, transport=lambda *a: (200, b"[]", {}), sleep=slept.append)
    with pytest.raises(fetch.FetchError):
        fetch.GameApi(broken, "http://example.test").bootstrap()
    with pytest.raises(fetch.FetchError):
        fetch.Client(str(tmp_path / "y"), offline=True).get("http://example.test/z")
    seen = list(fetch.GameApi(fetch.Client(str(tmp_path / "w"), spacing=0.0, transport=lambda *a: (404, b"", {})), "http://example.test").sweep([1, 2]))
    assert [(e, s) for e, s, _ in seen] == [(1, None), (2, None)] and all(err for *_, err in seen)
    assert fetch.cache_key("http://a/b", {"y": 1, "x": 2}) == fetch.cache_key("http://a/b", {"x": 2, "y": 1})
    assert 1 <= fetch.retry_delay(0, "500") <= 1.5 and fetch.retry_delay(9, None) <= 30.5


def test_paged_standings(tmp_path):
    page = [{"standings": {"has_next": True, "results": [{"entry": 1}]}}, {"standings": {"has_next": False, "results": [{"entry": 2}]}}]
    client = fetch.Client(str(tmp_path), spacing=0.0, transport=lambda *a: (200, json.dumps(page.pop(0)).encode(), {}))
    assert [r["entry"] for r in fetch.GameApi(client, "http://example.test").all_standings(5)] == [1, 2]


def test_a_table_is_found_while_it_is_replaced(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    path = catalog.save(spark.range(3), "a/t")
    # A writer lost between the renames: only what was set aside is there, beside an older leftover.
    (tmp_path / "a" / "t.parquet").rename(tmp_path / "a" / "t.parquet.old-20")
    spark.range(9).write.parquet(f"{path}.old-7")
    assert catalog.exists("a/t") and catalog.load("a/t").count() == 3 and catalog.names() == ["a/t"] and catalog.age_days("a/t") < 1
    catalog.save(spark.range(5), "a/t")
    assert catalog.load("a/t").count() == 5 and not catalog.exists("a/other")
