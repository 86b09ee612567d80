"""Stat lines with known points, and bonus ties."""

import pytest
from pyspark.sql import functions as F

from touchline.operators import reconcile
from touchline.functions import rules as R, scoring
from touchline.operators.bonus import allocate_bonus, bonus_from_fixture_stats
from touchline.operators.reconcile import reconcile_bonus, reconcile_points

GKP, DEF, MID, FWD = 1, 2, 3, 4
FIELDS = [*R.API_STATS, *R.OPTA_STATS, "bonus", "defensive_contribution"]
NULLABLE = {"clean_sheets", "defensive_contribution", *R.OPTA_STATS}
#: (expected points, position, stat line); clean sheets are 0 unless given or None.
POINTS = [
    (0, FWD, dict(minutes=0, goals_scored=2, bonus=3)), (1, MID, dict(minutes=57)), (1, MID, dict(minutes=59)), (2, MID, dict(minutes=60)), (5, FWD, dict(minutes=58, goals_scored=1)),
    (23, MID, dict(minutes=90, goals_scored=3, assists=1, goals_conceded=2, bonus=3)), (17, DEF, dict(minutes=77, goals_scored=1, assists=1, clean_sheets=1, bonus=2)),
    (13, FWD, dict(minutes=90, goals_scored=2, bonus=3)), (16, GKP, dict(minutes=90, goals_scored=1, clean_sheets=1)), (1, GKP, dict(minutes=90, goals_conceded=4, saves=4)),
    (10, GKP, dict(minutes=90, clean_sheets=1, saves=3, bonus=3)), (7, GKP, dict(minutes=90, penalties_saved=1, goals_conceded=1)), (-2, DEF, dict(minutes=90, own_goals=1, goals_conceded=4)),
    (-2, MID, dict(minutes=39, red_cards=1, goals_conceded=4)), (0, FWD, dict(minutes=90, penalties_missed=1)), (0, MID, dict(minutes=19, yellow_cards=1)),
    (8, DEF, dict(minutes=90, clean_sheets=1, defensive_contribution=10)), (1, DEF, dict(minutes=90, goals_conceded=3, defensive_contribution=9)), (4, MID, dict(minutes=90, defensive_contribution=12)),
    (2, MID, dict(minutes=90, defensive_contribution=11)), (4, DEF, dict(minutes=90, defensive_contribution=40)), (6, DEF, dict(minutes=90, clean_sheets=None)), (1, DEF, dict(minutes=45, clean_sheets=None)),
    (2, DEF, dict(minutes=90, goals_conceded=1, clean_sheets=None)), (3, MID, dict(minutes=90, clean_sheets=None)), (6, GKP, dict(minutes=90, clean_sheets=1)), (2, FWD, dict(minutes=90, clean_sheets=1)),
    (2, GKP, dict(minutes=90, defensive_contribution=30)), (2, DEF, dict(minutes=90, clearances_blocks_interceptions=5, tackles=4, recoveries=8)), (4, MID, dict(minutes=90, clearances_blocks_interceptions=5, tackles=4, recoveries=8)),
]
BPS = [
    (28, MID, dict(minutes=90, goals_scored=1, tackles=2)), (-6, DEF, dict(minutes=90, goals_conceded=3)), (10, DEF, dict(minutes=90, clearances_blocks_interceptions=8, recoveries=6)),
    (42, FWD, dict(minutes=90, goals_scored=2, penalties_scored=1)), (10, GKP, dict(minutes=90, saves=1, saves_from_inside_box=3, big_chance_saves=1)), (6, MID, dict(minutes=90, passes_attempted=29, pass_completion_pct=95.0)),
    (12, MID, dict(minutes=90, passes_attempted=30, pass_completion_pct=95.0)), (10, MID, dict(minutes=90, passes_attempted=60, pass_completion_pct=85.0)), (3, MID, dict(minutes=30)), (0, MID, dict(minutes=0, goals_scored=1)),
    (18, DEF, dict(minutes=90, clean_sheets=1)),
]


def frame(spark, cases):
    schema = "n int, expected int, position int, " + ", ".join(f"{f} {'double' if f == 'pass_completion_pct' else 'int'}" for f in FIELDS)
    rows = []
    for n, (expected, position, line) in enumerate(cases):
        line = {"clean_sheets": 0} | line
        rows.append((n, expected, position, *[line.get(f, None if f in NULLABLE else 0) for f in FIELDS]))
    return spark.createDataFrame(rows, schema)


def test_points(spark):
    df = frame(spark, POINTS)
    out = df.select("n", "expected", scoring.points(scoring.stat_columns(df), F.col("position")).alias("got"), scoring.point_lines(scoring.stat_columns(df), F.col("position")).alias("lines")).collect()
    assert [(r.n, r.got) for r in out] == [(r.n, r.expected) for r in out]
    assert all(sum(x.points for x in r.lines) == r.got and all(x.points for x in r.lines) for r in out)


def test_bonus_line_is_optional(spark):
    df = frame(spark, [(0, FWD, dict(minutes=90, goals_scored=1, bonus=3))])
    cols = scoring.stat_columns(df)
    assert df.select(scoring.points(cols, F.col("position"), include_bonus=False).alias("p")).first().p == 6


def test_bps(spark):
    df = frame(spark, BPS)
    out = df.select("n", "expected", scoring.bps(scoring.stat_columns(df), F.col("position")).alias("got")).collect()
    assert [(r.n, r.got) for r in out] == [(r.n, r.expected) for r in out]


def test_absent_opta_inputs_are_named(spark):
    df = frame(spark, [(0, MID, dict(minutes=90, key_passes=1))])
    names = df.select(scoring.bps_assumed_zero(scoring.stat_columns(df)).alias("x")).first().x
    assert "key_passes" not in names and len(names) == len(R.OPTA_STATS) - 1


def test_unknown_position_raises(spark):
    df = frame(spark, [(0, 5, dict(minutes=90))])
    with pytest.raises(Exception, match="unknown position"):
        df.select(scoring.points(scoring.stat_columns(df), F.col("position"))).collect()


def test_double_gameweek_is_scored_match_by_match(spark):
    df = frame(spark, [(0, DEF, dict(minutes=45, defensive_contribution=6)), (0, DEF, dict(minutes=45, defensive_contribution=6))]).withColumn("player", F.lit(1))
    assert scoring.gameweek_points(df, ["player"]).first().points == 2


@pytest.mark.parametrize("scores,expected", [
    ((40, 30, 20, 10), (3, 2, 1, 0)), ((60, 60, 38, 33), (3, 3, 1, 0)), ((39, 27, 27, 24), (3, 2, 2, 0)), ((37, 28, 28, 28, 25), (3, 2, 2, 2, 0)),
    ((40, 30, 20, 20, 10), (3, 2, 1, 1, 0)), ((50, 50, 50, 40), (3, 3, 3, 0)),
])
def test_bonus_ties(spark, scores, expected):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(scores)], "fixture int, element int, bps int")
    out = {r.element: r.bonus for r in allocate_bonus(df).collect()}
    assert tuple(out[i] for i in range(len(scores))) == expected


def test_reconciliation(spark):
    stats = spark.createDataFrame([(1, "bps", "h", 7, 40), (1, "bps", "a", 8, 30), (1, "goals", "h", 7, 1)], "fixture int, identifier string, side string, element int, value int")
    assert {r.element: r.bonus for r in bonus_from_fixture_stats(stats).collect()} == {7: 3, 8: 2}
    scores = stats.where("identifier = 'bps'").select("fixture", "element", F.col("value").alias("bps"))
    given = spark.createDataFrame([(1, 7, 3), (1, 8, 2)], "fixture int, element int, bonus int")
    assert reconcile_bonus(scores, given).first().agrees
    assert not reconcile_bonus(scores, given.where("element = 7")).first().agrees
    df = frame(spark, [(2, MID, dict(minutes=90))])
    published = spark.createDataFrame([(0, "minutes", 2, 0)], "n int, identifier string, points int, points_modification int")
    row = reconcile_points(df, published, ["n"]).first()
    assert (row.engine, row.published, row.agrees) == (2, 2, True)


def test_lines_that_one_side_lacks(spark):
    rows = spark.createDataFrame([(1, 3, 90, 1), (2, 3, 90, 0), (3, 3, 0, 2)], "fixture long, position int, minutes int, goals_scored int")
    lines = [(1, "minutes", 2, None), (1, "goals_scored", 5, None), (1, "clean_sheets", 1, 0), (2, "minutes", 1, 1), (2, "assists", 3, None), (4, "minutes", 2, None), (4, "luck", 0, None), (5, "luck", 1, -1), (6, "luck", 1, 0)]
    published = spark.createDataFrame(lines, "fixture long, identifier string, points int, points_modification int")
    got = {r.fixture: (r.engine, r.published, r.agrees) for r in reconcile.reconcile_points(rows, published, ["fixture"]).collect()}
    # Fixture 3 has no line on either side; a name that the rules lack agrees if it is worth nothing.
    assert got == {1: (8, 8, True), 2: (3, 5, False), 4: (0, 2, False), 5: (0, 0, True), 6: (0, 1, False)}
