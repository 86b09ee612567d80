"""Scoring rules as data. The game's points and bonus-system tables, by position 1 to 4."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

GKP, DEF, MID, FWD = 1, 2, 3, 4
POSITIONS = {GKP: "GKP", DEF: "DEF", MID: "MID", FWD: "FWD"}

# Points.
LONG_PLAY, SHORT_POINTS, LONG_POINTS = 60, 1, 2
GOAL = {GKP: 10, DEF: 6, MID: 5, FWD: 4}
ASSIST = 3
CLEAN_SHEET = {GKP: 4, DEF: 4, MID: 1, FWD: 0}
CONCEDED = {GKP: -1, DEF: -1, MID: 0, FWD: 0}
CONCEDED_PER, SAVES_PER = 2, 3
PENALTY_SAVED, PENALTY_MISSED, OWN_GOAL, YELLOW, RED = 5, -2, -2, -1, -3
DEFCON = {GKP: 0, DEF: 2, MID: 2, FWD: 2}
DEFCON_FROM = {DEF: 10, MID: 12, FWD: 12}
BONUS = (3, 2, 1)

# Bonus system. Plain actions: (name of the line, statistic, value of one).
BPS_SHORT, BPS_LONG = 3, 6
BPS_GOAL = {GKP: 12, DEF: 12, MID: 18, FWD: 24}
BPS_CLEAN_SHEET = {GKP: 12, DEF: 12, MID: 0, FWD: 0}
BPS_CONCEDED = {GKP: -4, DEF: -4, MID: 0, FWD: 0}
BPS_PENALTY_GOAL = 12
BPS_PER_THREE = ("clearances_blocks_interceptions", "recoveries")
BPS_ACTIONS = (
    ("assists", "assists", 9),
    ("saves", "saves", 2),
    ("penalties_saved", "penalties_saved", 7),
    ("successful_tackles", "tackles", 2),
    ("goal_line_clearances", "goal_line_clearances", 9),
    ("key_passes", "key_passes", 1),
    ("big_chances_created", "big_chances_created", 3),
    ("open_play_crosses", "open_play_crosses", 1),
    ("dribbles", "dribbles", 1),
    ("shots_on_target", "shots_on_target", 2),
    ("winning_goals", "winning_goals", 3),
    ("fouls_won", "fouls_won", 1),
    ("penalties_conceded", "penalties_conceded", -3),
    ("penalties_missed", "penalties_missed", -6),
    ("yellow_cards", "yellow_cards", -3),
    ("red_cards", "red_cards", -9),
    ("own_goals", "own_goals", -6),
    ("big_chances_missed", "big_chances_missed", -3),
    ("errors_leading_to_goal", "errors_leading_to_goal", -3),
    ("errors_leading_to_goal_attempt", "errors_leading_to_goal_attempt", -1),
    ("fouls_conceded", "fouls_conceded", -1),
    ("offsides", "offsides", -1),
    ("shots_off_target", "shots_off_target", -1),
)
#: Part of saves, never more of them than saves: (name of the line, statistic, value of one).
BPS_SAVE_KINDS = (("save_from_inside_box", "saves_from_inside_box", 1), ("big_chance_saves", "big_chance_saves", 1))
BPS_PASSES_FROM = 30
BPS_PASS_BANDS = ((90.0, 6), (80.0, 4), (70.0, 2))

API_STATS = (
    "minutes", "goals_scored", "assists", "clean_sheets", "goals_conceded", "own_goals", "penalties_saved", "penalties_missed",
    "yellow_cards", "red_cards", "saves", "clearances_blocks_interceptions", "recoveries", "tackles",
)
OPTA_STATS = (
    "penalties_scored", "saves_from_inside_box", "big_chance_saves", "goal_line_clearances", "key_passes", "big_chances_created",
    "open_play_crosses", "dribbles", "shots_on_target", "shots_off_target", "winning_goals", "fouls_won", "fouls_conceded", "offsides",
    "big_chances_missed", "errors_leading_to_goal", "errors_leading_to_goal_attempt", "penalties_conceded", "passes_attempted", "pass_completion_pct",
)


def by_position(table: dict[int, int], position: Column) -> Column:
    """The table's value for the position; null where it has none."""
    out = F.lit(None).cast("int")
    for p, v in table.items():
        out = F.when(position == p, F.lit(v)).otherwise(out)
    return out


def checked(position: Column) -> Column:
    """The position, or an error where it is not 1 to 4."""
    return F.when(position.isin(*POSITIONS), position.cast("int")).otherwise(F.raise_error(position_error(position)).cast("int"))


def position_error(position: Column) -> Column:
    """What is wrong with a position, null where nothing is."""
    return F.when(~F.coalesce(position.isin(*POSITIONS), F.lit(False)), F.concat(F.lit("unknown position "), F.coalesce(position.cast("string"), F.lit("null"))))
