"""Nested payloads flattened into typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.rules import POSITIONS

_STATS = "minutes goals_scored assists clean_sheets goals_conceded own_goals penalties_saved penalties_missed yellow_cards red_cards saves bonus bps".split()
_MORE = "clearances_blocks_interceptions recoveries tackles defensive_contribution starts".split()
#: Numbers that come as text.
TEXT_NUMBERS = (
    "influence", "creativity", "threat", "ict_index", "expected_goals", "expected_assists", "expected_goal_involvements", "expected_goals_conceded",
)
_ENTRY = "array<struct<value int, element int>>"
FIXTURES = (
    "code long, event int, finished boolean, finished_provisional boolean, id int, kickoff_time string, minutes int, provisional_start_time boolean, started boolean, "
    f"team_a int, team_a_score int, team_h int, team_h_score int, stats array<struct<identifier string, a {_ENTRY}, h {_ENTRY}>>, team_h_difficulty int, team_a_difficulty int, pulse_id int"
)
LIVE = (
    "elements array<struct<id int, modified boolean, stats struct<" + ", ".join(f"{c} int" for c in _STATS + _MORE) + ", " + ", ".join(f"{c} string" for c in TEXT_NUMBERS)
    + ", total_points int, in_dreamteam boolean, played boolean>, explain array<struct<fixture int, stats array<struct<identifier string, points int, value int, points_modification int>>>>>>"
)
ELEMENTS = (
    "id int, web_name string, first_name string, second_name string, team int, element_type int, now_cost int, cost_change_start int, cost_change_event int, status string, news string, "
    "chance_of_playing_next_round int, selected_by_percent string, minutes int, total_points int, transfers_in_event int, transfers_out_event int, price_change_hourly_rate int, "
    "price_change_projections array<struct<offset int, projected_percent string, likelihood int>>, price_change_locked_until string, price_change_calibrating boolean"
)
EVENTS = "id int, name string, deadline_time string, finished boolean, data_checked boolean, is_current boolean, is_next boolean"
BOOTSTRAP = f"elements array<struct<{ELEMENTS}>>, teams array<struct<id int, name string, short_name string>>, events array<struct<{EVENTS}>>"
PICKS = (
    "entry int, gw int, picks array<struct<element int, position int, multiplier int, is_captain boolean, is_vice_captain boolean>>, "
    "automatic_subs array<struct<element_in int, element_out int>>, active_chip string"
)
HISTORY = (
    "entry int, current array<struct<event int, points int, value int, bank int, event_transfers int, event_transfers_cost int, points_on_bench int>>, chips array<struct<name string, event int, time string>>"
)
TRANSFERS = "entry int, event int, element_in int, element_in_cost int, element_out int, element_out_cost int, time string"
STANDINGS = "standings struct<has_next boolean, results array<struct<entry int, entry_name string, player_name string, rank int, total int>>>"
PLAYERS_PROVIDER = ("games", "time", "goals", "xG", "assists", "xA", "shots", "key_passes", "yellow_cards", "red_cards", "npg", "npxG", "xGChain", "xGBuildup")
_SIDE = "struct<id: string, title: string, short_title: string>"
_BOTH = "struct<h: string, a: string>"
PROVIDER = (
    f"players array<struct<id: string, player_name: string, team_title: string, position: string, {', '.join(f'{c}: string' for c in PLAYERS_PROVIDER)}>>, "
    f"dates array<struct<id: string, isResult: boolean, h: {_SIDE}, a: {_SIDE}, goals: {_BOTH}, xG: {_BOTH}, datetime: string>>"
)
_SHOT = (
    "id string, season string, match_id string, date string, minute string, player_id string, player string, h_a string, h_team string, a_team string, h_goals string, a_goals string, "
    "result string, X string, Y string, xG string, situation string, shotType string, lastAction string, player_assisted string"
)
SHOTS = f"h array<struct<{_SHOT}>>, a array<struct<{_SHOT}>>"


def read_json(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Landed documents by an explicit schema; ValueError where a required field is missing from any."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    for field in required:
        if not df.where(F.col(field).isNull()).isEmpty():
            raise ValueError(f"{path}: a document lacks {field!r}")
    return df


def rows_of(payload: DataFrame, field: str) -> DataFrame:
    """A row per element of an array of structs."""
    return payload.select(F.explode(field).alias("r")).select("r.*")


def elements_frame(elements: DataFrame, teams: DataFrame) -> DataFrame:
    """Players with position, team names, full_name and price in full units."""
    names = F.broadcast(teams.select(F.col("id").alias("team"), F.col("name").alias("team_name"), F.col("short_name").alias("team_short")))
    label = F.create_map(*[F.lit(x) for p in POSITIONS.items() for x in p])
    full = F.trim(F.concat_ws(" ", F.coalesce("first_name", F.lit("")), F.coalesce("second_name", F.lit(""))))
    return elements.join(names, "team", "left").withColumns({"position": F.try_element_at(label, F.col("element_type")), "full_name": full, "price": F.col("now_cost") / 10})


def events_frame(events: DataFrame) -> DataFrame:
    return events.withColumn("deadline_time", F.try_to_timestamp("deadline_time"))


def fixtures_frame(fixtures: DataFrame) -> DataFrame:
    return fixtures.drop("stats").withColumn("kickoff_time", F.try_to_timestamp("kickoff_time"))


def fixture_stats_frame(fixtures: DataFrame) -> DataFrame:
    """(fixture, event, identifier, side, element, value) from the nested statistics."""
    sides = F.explode(F.array(F.struct(F.lit("h").alias("side"), F.col("s.h").alias("items")), F.struct(F.lit("a").alias("side"), F.col("s.a").alias("items"))))
    return (
        fixtures.select(F.col("id").alias("fixture"), "event", F.explode("stats").alias("s")).select("fixture", "event", "s.identifier", sides.alias("x"))
        .select("fixture", "event", "identifier", "x.side", F.explode("x.items").alias("i")).select("fixture", "event", "identifier", "side", "i.element", "i.value")
    )


def live_points_frame(payload: DataFrame, gw: int) -> DataFrame:
    """(gw, element, statistics), numbers that come as text coerced, null where they are none."""
    rows = payload.select(F.explode("elements").alias("e")).select(F.lit(gw).alias("gw"), F.col("e.id").alias("element"), "e.stats.*")
    return rows.withColumns({c: F.col(c).try_cast("double") for c in TEXT_NUMBERS if c in rows.columns})


def live_explain_frame(payload: DataFrame, gw: int) -> DataFrame:
    """(gw, element, fixture, identifier, value, points, points_modification)."""
    fixtures = payload.select(F.explode("elements").alias("e")).select(F.col("e.id").alias("element"), F.explode("e.explain").alias("x"))
    return fixtures.select("element", "x.fixture", F.explode("x.stats").alias("s")).select(
        F.lit(gw).alias("gw"), "element", "fixture", "s.identifier", "s.value", "s.points", F.coalesce("s.points_modification", F.lit(0)).alias("points_modification")
    )


def provider_players(payload: DataFrame, season: str, league: str) -> DataFrame:
    rows = rows_of(payload, "players")
    return rows.withColumns({c: F.col(c).try_cast("double") for c in PLAYERS_PROVIDER if c in rows.columns} | {"season": F.lit(season), "league": F.lit(league)})


def provider_fixtures(payload: DataFrame, season: str, league: str) -> DataFrame:
    """Matches with the sides' structs flattened."""
    m = payload.select(F.explode("dates").alias("m"))
    number = lambda c: F.col(c).try_cast("double")
    return m.select(
        F.lit(season).alias("season"), F.lit(league).alias("league"), F.col("m.id").alias("match_id"), F.coalesce("m.isResult", F.lit(False)).alias("is_result"),
        F.col("m.datetime").try_cast("timestamp_ntz").alias("datetime"), F.col("m.h.id").alias("h_team_id"), F.col("m.h.title").alias("h_team"), F.col("m.a.id").alias("a_team_id"),
        F.col("m.a.title").alias("a_team"), number("m.goals.h").alias("h_goals"), number("m.goals.a").alias("a_goals"), number("m.xG.h").alias("h_xg"), number("m.xG.a").alias("a_xg"),
    )


def shots_frame(payload: DataFrame, match_id: str | None = None) -> DataFrame:
    """22 columns, a row per shot of either side; no shots give no rows of the same columns."""
    side = lambda s: F.struct(F.lit(s).alias("side"), F.col(s).alias("shots"))
    return _shot_rows(payload.select(F.explode(F.array(side("h"), side("a"))).alias("x")).select(F.explode("x.shots").alias("s"), "x.side"), match_id)


def _shot_rows(s: DataFrame, match_id: str | None) -> DataFrame:
    """The columns of shots_frame() from rows (s, side)."""
    number = lambda c: F.col(f"s.{c}").try_cast("double")
    return s.select(
        "s.season", F.coalesce("s.match_id", F.lit(match_id)).alias("match_id"), F.col("s.id").alias("shot_id"), F.col("s.date").try_cast("timestamp_ntz").alias("date"), number("minute").alias("minute"),
        "s.player_id", "s.player", F.when(F.col("s.h_a") == "h", F.col("s.h_team")).otherwise(F.col("s.a_team")).alias("team"), F.coalesce("s.h_a", "side").alias("h_a"), "s.h_team", "s.a_team",
        number("h_goals").alias("h_goals"), number("a_goals").alias("a_goals"), "s.result", F.coalesce(F.col("s.result") == "Goal", F.lit(False)).alias("is_goal"), number("X").alias("x"), number("Y").alias("y"),
        number("xG").alias("xg"), "s.situation", F.col("s.shotType").alias("shot_type"), F.col("s.lastAction").alias("last_action"), "s.player_assisted",
    )


def player_matches(payload: DataFrame) -> DataFrame:
    """A row per match of documents (player_id, matches), numbers and dates that come as text coerced."""
    rows = payload.select("player_id", F.explode("matches").alias("m")).select("player_id", "m.*")
    numbers = ("goals", "shots", "xG", "time", "h_goals", "a_goals", "xA", "assists", "key_passes", "npg", "npxG", "xGChain", "xGBuildup")
    out = rows.withColumns({c: F.col(c).try_cast("double") for c in numbers if c in rows.columns})
    return out.withColumn("date", F.col("date").try_cast("timestamp_ntz")) if "date" in rows.columns else out


def player_shots(payload: DataFrame, match_id: str | None = None) -> DataFrame:
    """shots_frame() of documents (shots), which are not parted by side."""
    return _shot_rows(payload.select(F.explode("shots").alias("s"), F.lit("h").alias("side")), match_id)


def team_matches(payload: DataFrame, team: str, season: str) -> DataFrame:
    """A row per match of a club's documents (dates), with its side and result."""
    m = payload.select(F.explode("dates").alias("m"))
    number = lambda c: F.col(c).try_cast("double")
    return m.select(
        F.lit(team).alias("team"), F.lit(season).alias("season"), F.col("m.id").alias("match_id"), F.coalesce("m.isResult", F.lit(False)).alias("is_result"), "m.side", "m.result",
        F.col("m.datetime").try_cast("timestamp_ntz").alias("datetime"), F.col("m.h.title").alias("h_team"), F.col("m.a.title").alias("a_team"),
        number("m.goals.h").alias("h_goals"), number("m.goals.a").alias("a_goals"), number("m.xG.h").alias("h_xg"), number("m.xG.a").alias("a_xg"),
    )


# ---------------------------------------------------------------- events and league tables


def gameweeks_played(events: DataFrame) -> DataFrame:
    """(gw), sorted: finished, checked or current."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    return events.where(flag("finished") | flag("data_checked") | flag("is_current")).select(F.col("id").alias("gw")).distinct().orderBy("gw")


def event_marks(events: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys (a season, of which the calendar bounds the gameweeks): current, next, and the finished gameweeks in order, those whose data are checked and all."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    ids = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("id"))))
    return events.groupBy(*keys).agg(
        F.min(F.when(flag("is_current"), F.col("id"))).alias("current"), F.min(F.when(flag("is_next"), F.col("id"))).alias("next"), ids(flag("finished") & flag("data_checked")).alias("finished"), ids(flag("finished")).alias("finished_unchecked")
    )


def marked_event(events: DataFrame, mark: str) -> int | None:
    """The id of the first event with is_current or is_next."""
    row = events.where(mark).agg(F.min("id").alias("id")).first()
    return row["id"]


def finished_events(events: DataFrame, checked: bool = True) -> list[int]:
    cond = F.col("finished") & (F.coalesce("data_checked", F.lit(False)) if checked else F.lit(True))
    return sorted(r["id"] for r in events.where(cond).select("id").collect())


def final_gameweeks(fixtures: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """(gw) whose fixtures are all finished; gameweeks without fixtures by their event's flags."""
    by_fixture = fixtures.groupBy(F.col("event").alias("gw")).agg(F.bool_and(F.coalesce("finished", F.lit(False))).alias("done"))
    if events is not None:
        rest = events.select(F.col("id").alias("gw"), (F.coalesce("finished", F.lit(False)) | F.coalesce("data_checked", F.lit(False))).alias("done")).join(by_fixture, "gw", "left_anti")
        by_fixture = by_fixture.unionByName(rest)
    return by_fixture.where("done").select("gw")


def pending_teams(fixtures: DataFrame) -> DataFrame:
    """(gw, team) still to play."""
    open_ = ~(F.coalesce("finished", F.lit(False)) | F.coalesce("finished_provisional", F.lit(False)))
    return fixtures.where(open_).select(F.col("event").alias("gw"), F.explode(F.array("team_h", "team_a")).alias("team")).distinct()


def league_tables(picks: DataFrame, histories: DataFrame, standings: DataFrame) -> dict[str, DataFrame]:
    """The normalised league tables of landed documents."""
    p = picks.select("entry", "gw", F.explode("picks").alias("p")).select("entry", "gw", "p.element", F.col("p.position").alias("slot"), "p.multiplier", "p.is_captain", "p.is_vice_captain")
    current = histories.select("entry", F.explode("current").alias("c")).select(
        "entry", F.col("c.event").alias("gw"), "c.points", "c.value", "c.bank", F.col("c.event_transfers").alias("made"), F.col("c.event_transfers_cost").alias("hits"), "c.points_on_bench"
    )
    return {
        "picks": p, "manager_gw": current, "auto_subs": picks.select("entry", "gw", F.explode("automatic_subs").alias("s")).select("entry", "gw", "s.element_out", "s.element_in"),
        "chips": histories.select("entry", F.explode("chips").alias("c")).select("entry", "c.name", F.col("c.event").alias("gw")),
        "standings": standings.select(F.explode("standings.results").alias("r")).select("r.*").dropDuplicates(["entry"]),
    }
