"""Points and bonus-system scores of stat lines, as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from . import rules as R

LINE = "array<struct<identifier:string,value:double,points:int>>"


def _whole(stats: Mapping[str, Column], name: str) -> Column:
    """A statistic as an integer; absent or null is 0."""
    return F.coalesce(stats[name].cast("int"), F.lit(0)) if name in stats else F.lit(0)


def _line(name: str, value: Column, points: Column) -> Column:
    return F.struct(F.lit(name).alias("identifier"), value.cast("double").alias("value"), points.cast("int").alias("points"))


def stat_columns(df: DataFrame) -> dict[str, Column]:
    """The statistics that a DataFrame has as columns."""
    return {c: F.col(c) for c in df.columns if c in (*R.API_STATS, *R.OPTA_STATS, "bonus", "defensive_contribution")}


def defensive_contribution(stats: Mapping[str, Column], position: Column) -> Column:
    """The published tally, else the sum of its parts; recoveries count ahead of the defence, and keepers have none."""
    parts = _whole(stats, "clearances_blocks_interceptions") + _whole(stats, "tackles")
    own = parts + F.when(position == R.DEF, 0).otherwise(_whole(stats, "recoveries"))
    if "defensive_contribution" in stats:
        own = F.coalesce(stats["defensive_contribution"].cast("int"), own)
    return F.when(position == R.GKP, 0).otherwise(own)


def _point_terms(stats: Mapping[str, Column], position: Column, include_bonus: bool) -> list[tuple[str, Column, Column]]:
    """(name, value, points) of every rule."""
    n = lambda name: _whole(stats, name)
    minutes = n("minutes")
    sheet = ((minutes >= R.LONG_PLAY) & (n("goals_conceded") == 0)).cast("int")
    if "clean_sheets" in stats:
        sheet = F.coalesce(stats["clean_sheets"].cast("int"), sheet)
    defcon = defensive_contribution(stats, position)
    per = lambda name, size: F.floor(n(name) / size).cast("int")
    terms = [
        ("minutes", minutes, F.when(minutes >= R.LONG_PLAY, R.LONG_POINTS).otherwise(R.SHORT_POINTS)),
        ("goals_scored", n("goals_scored"), n("goals_scored") * R.by_position(R.GOAL, position)),
        ("assists", n("assists"), n("assists") * R.ASSIST),
        ("clean_sheets", sheet, sheet * R.by_position(R.CLEAN_SHEET, position)),
        ("goals_conceded", n("goals_conceded"), per("goals_conceded", R.CONCEDED_PER) * R.by_position(R.CONCEDED, position)),
        ("saves", n("saves"), per("saves", R.SAVES_PER)),
        ("penalties_saved", n("penalties_saved"), n("penalties_saved") * R.PENALTY_SAVED),
        ("penalties_missed", n("penalties_missed"), n("penalties_missed") * R.PENALTY_MISSED),
        ("own_goals", n("own_goals"), n("own_goals") * R.OWN_GOAL),
        ("yellow_cards", n("yellow_cards"), n("yellow_cards") * R.YELLOW),
        ("red_cards", n("red_cards"), n("red_cards") * R.RED),
        ("defensive_contribution", defcon, F.when(defcon >= R.by_position(R.DEFCON_FROM, position), R.by_position(R.DEFCON, position)).otherwise(0)),
    ]
    return terms + [("bonus", n("bonus"), n("bonus"))] * include_bonus


def _lines(terms: list[tuple[str, Column, Column]], minutes: Column) -> Column:
    every = F.array(*[_line(*t) for t in terms])
    return F.when(minutes > 0, F.filter(every, lambda x: x["points"] != 0)).otherwise(F.array().cast(LINE))


def _total(terms: list[tuple[str, Column, Column]], minutes: Column) -> Column:
    return F.when(minutes > 0, reduce(Column.__add__, [t[2] for t in terms])).otherwise(0).cast("int")


def point_lines(stats: Mapping[str, Column], position: Column, *, include_bonus: bool = True) -> Column:
    """Array of the lines (identifier, value, points) that are not 0; none without minutes."""
    return _lines(_point_terms(stats, R.checked(position), include_bonus), _whole(stats, "minutes"))


def points(stats: Mapping[str, Column], position: Column, *, include_bonus: bool = True) -> Column:
    """Points of one stat line of one match."""
    return _total(_point_terms(stats, R.checked(position), include_bonus), _whole(stats, "minutes"))


def term_sums(rows: DataFrame, keys: list[str], position: str = "position", *, include_bonus: bool = True) -> tuple[DataFrame, list[str]]:
    """(keys, and for each term n_<name>, lines that are not 0, and s_<name>, their points), and the names: one aggregation of columns, whatever the number of lines."""
    terms = _point_terms(stat_columns(rows), R.checked(F.col(position)), include_bonus)
    plays = _whole(stat_columns(rows), "minutes") > 0
    flat = rows.select(*keys, *[F.when(plays, points).otherwise(0).cast("int").alias(f"__{name}") for name, _, points in terms])
    names = [name for name, _, _ in terms]
    return flat.groupBy(*keys).agg(*[x for n in names for x in (F.sum(f"__{n}").alias(f"s_{n}"), F.count_if(F.col(f"__{n}") != 0).alias(f"n_{n}"))]), names


def line_totals(rows: DataFrame, keys: list[str], position: str = "position", *, include_bonus: bool = True) -> DataFrame:
    """(keys, identifier, lines, points): the lines of point_lines() by name, how many and their sum; names without a line have no row."""
    sums, names = term_sums(rows, keys, position, include_bonus=include_bonus)
    every = F.array(*[F.struct(F.lit(n).alias("identifier"), F.col(f"n_{n}").alias("lines"), F.col(f"s_{n}").alias("points")) for n in names])
    return sums.select(*keys, F.explode(every).alias("l")).select(*keys, "l.*").where("lines > 0")


def gameweek_points(matches: DataFrame, keys: list[str], position: str = "position") -> DataFrame:
    """Points over several matches: scored match by match (the rules start anew in each), then summed."""
    return matches.withColumn("__p", points(stat_columns(matches), F.col(position))).groupBy(*keys).agg(F.sum("__p").alias("points"))


def _bps_terms(stats: Mapping[str, Column], position: Column) -> list[tuple[str, Column, Column]]:
    n = lambda name: _whole(stats, name)
    minutes, goals = n("minutes"), n("goals_scored")
    from_spot = F.least(n("penalties_scored"), goals)
    terms = [
        ("minutes", minutes, F.when(minutes >= R.LONG_PLAY, R.BPS_LONG).otherwise(R.BPS_SHORT)),
        ("goals_scored", goals - from_spot, (goals - from_spot) * R.by_position(R.BPS_GOAL, position)),
        ("penalties_scored", from_spot, from_spot * R.BPS_PENALTY_GOAL),
        ("clean_sheets", n("clean_sheets"), n("clean_sheets") * R.by_position(R.BPS_CLEAN_SHEET, position)),
        ("goals_conceded", n("goals_conceded"), n("goals_conceded") * R.by_position(R.BPS_CONCEDED, position)),
    ]
    terms += [(name, n(stat), n(stat) * value) for name, stat, value in R.BPS_ACTIONS]
    terms += [(name, F.least(n(stat), n("saves")), F.least(n(stat), n("saves")) * value) for name, stat, value in R.BPS_SAVE_KINDS]
    terms += [(name, n(name), F.floor(n(name) / 3).cast("int")) for name in R.BPS_PER_THREE]
    share = F.coalesce(stats["pass_completion_pct"].cast("double"), F.lit(0.0)) if "pass_completion_pct" in stats else F.lit(0.0)
    band = F.lit(0)
    for floor, award in sorted(R.BPS_PASS_BANDS):
        band = F.when(share >= floor, award).otherwise(band)
    return terms + [("pass_percentage", share, F.when(n("passes_attempted") >= R.BPS_PASSES_FROM, band).otherwise(0))]


def bps_lines(stats: Mapping[str, Column], position: Column) -> Column:
    return _lines(_bps_terms(stats, R.checked(position)), _whole(stats, "minutes"))


def bps(stats: Mapping[str, Column], position: Column) -> Column:
    """Bonus-system score of one match. A clean sheet counts as given: absent is 0, not derived."""
    return _total(_bps_terms(stats, R.checked(position)), _whole(stats, "minutes"))


def _of_positions(table: dict[int, float], position: np.ndarray, absent: float = 0) -> np.ndarray:
    """by_position() of an array."""
    if len(unknown := sorted(set(position.tolist()) - set(R.POSITIONS))):
        raise ValueError(f"unknown position {unknown[0]}")
    return np.array([table.get(int(p), absent) for p in position])


def points_of(stats: Mapping[str, np.ndarray], position: np.ndarray) -> np.ndarray:
    """points() of arrays of API_STATS (and bonus), simulations by players, at the players' positions; penalties are not among them."""
    n, at = stats, lambda table, absent=0: _of_positions(table, position, absent)
    tally = n["clearances_blocks_interceptions"] + n["tackles"] + np.where(position == R.DEF, 0, n["recoveries"])
    total = (
        np.where(n["minutes"] >= R.LONG_PLAY, R.LONG_POINTS, R.SHORT_POINTS) + n["goals_scored"] * at(R.GOAL) + n["assists"] * R.ASSIST + n["clean_sheets"] * at(R.CLEAN_SHEET)
        + n["goals_conceded"] // R.CONCEDED_PER * at(R.CONCEDED) + n["saves"] // R.SAVES_PER + n["own_goals"] * R.OWN_GOAL + n["yellow_cards"] * R.YELLOW + n["red_cards"] * R.RED
        + np.where(tally >= at(R.DEFCON_FROM, np.inf), at(R.DEFCON), 0) + n["bonus"]
    )
    return np.where(n["minutes"] > 0, total, 0)


def bps_of(stats: Mapping[str, np.ndarray], position: np.ndarray) -> np.ndarray:
    """bps() of arrays as in points_of()."""
    n, at = stats, lambda table: _of_positions(table, position)
    total = (
        np.where(n["minutes"] >= R.LONG_PLAY, R.BPS_LONG, R.BPS_SHORT) + n["goals_scored"] * at(R.BPS_GOAL) + n["clean_sheets"] * at(R.BPS_CLEAN_SHEET) + n["goals_conceded"] * at(R.BPS_CONCEDED)
        + sum(n[stat] * value for _, stat, value in R.BPS_ACTIONS if stat in n) + sum(n[stat] // 3 for stat in R.BPS_PER_THREE)
    )
    return np.where(n["minutes"] > 0, total, 0)


def bps_assumed_zero(stats: Mapping[str, Column]) -> Column:
    """Names, sorted, of the statistics that only the full feed has and that are absent or null here."""
    missing = [F.when(stats[s].isNull(), F.lit(s)) if s in stats else F.lit(s) for s in sorted(R.OPTA_STATS)]
    named = F.array_compact(F.array(*missing))
    return F.when(_whole(stats, "minutes") > 0, named).otherwise(F.array().cast("array<string>"))
