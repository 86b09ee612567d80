"""Season archives of drifting columns, reconciled onto one schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.names import position_label, split_trailing_id

#: The canonical columns in order, and their types.
TEXT = ("season", "name", "position", "team")
CANONICAL = (
    "season", "gw", "element", "name", "position", "team", "opponent_team", "fixture", "kickoff_time", "was_home", "minutes", "starts", "total_points",
    "goals_scored", "assists", "clean_sheets", "goals_conceded", "own_goals", "penalties_saved", "penalties_missed", "yellow_cards", "red_cards", "saves",
    "bonus", "bps", "influence", "creativity", "threat", "ict_index", "expected_goals", "expected_assists", "expected_goal_involvements",
    "expected_goals_conceded", "defensive_contribution", "tackles", "recoveries", "clearances_blocks_interceptions", "xp", "value", "selected",
    "transfers_in", "transfers_out", "transfers_balance", "team_h_score", "team_a_score",
)
DROPPED = ("id", "kickoff_time_formatted", "modified")
KINDS = {c: "string" for c in TEXT} | {"gw": "bigint", "element": "bigint", "kickoff_time": "timestamp", "was_home": "boolean"}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, all text: UTF-8 (with or without mark) where it decodes, else Latin-1.

    Which it is, is seen from the bytes by Spark's own reader, since a path may be in any store.
    """
    raw = spark.read.format("binaryFile").load(path).select("content")
    damaged = raw.select(F.decode(F.encode(F.try_validate_utf8(F.col("content").cast("string")), "UTF-8"), "UTF-8").isNull().alias("bad"))
    latin = not damaged.where("bad").isEmpty()
    df = spark.read.option("header", True).option("encoding", "ISO-8859-1" if latin else "UTF-8").option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.removeprefix("﻿") for c in df.columns])


def normalise_season(raw: DataFrame, season: str, lookup: DataFrame | None = None) -> DataFrame:
    """One season onto CANONICAL, further columns after it by name. lookup: element, position_lookup, team_lookup.

    GW, else round, is the gameweek; a trailing number of a name is the element where there is no
    such column; what does not parse is null.
    """
    df = raw.drop(*[c for c in raw.columns if c.lower() in DROPPED])
    names = {"GW": "gw", "round": "round_num", "xP": "xp"}
    df = df.toDF(*[names.get(c, c.lower()) for c in df.columns])
    has = set(df.columns)
    null = F.lit(None).cast("string")
    name, trailing = split_trailing_id(F.col("name")) if "name" in has else (null, null.cast("bigint"))
    whole = lambda c: F.col(c).try_cast("double").cast("bigint")
    df = df.withColumns({
        "name": name, "element": whole("element") if "element" in has else trailing,
        "gw": whole("gw") if "gw" in has else whole("round_num") if "round_num" in has else null.cast("bigint"),
    })
    if lookup is not None:
        extra = lookup.select(F.col("element").cast("bigint").alias("element"), "position_lookup", "team_lookup")
        df = df.join(extra, "element", "left").withColumns({c: F.coalesce(F.col(c) if c in has else null, f"{c}_lookup") for c in ("position", "team")}).drop("position_lookup", "team_lookup")
    out = {}
    for c in CANONICAL:
        kind = KINDS.get(c, "double")
        if c == "season":
            out[c] = F.lit(season)
        elif c not in df.columns:
            out[c] = F.lit(None).cast(kind)
        elif c == "position":
            out[c] = position_label(F.col(c))
        elif c == "kickoff_time":
            out[c] = F.try_to_timestamp(c)
        elif c == "was_home":
            out[c] = F.when(F.lower(c) == "true", True).when(F.lower(c) == "false", False)
        elif kind == "double":
            out[c] = F.col(c).try_cast("double")
        else:
            out[c] = F.col(c).cast(kind)
    extras = sorted(set(df.columns) - set(CANONICAL))
    return df.select(*[v.alias(k) for k, v in out.items()], *extras)


def union_seasons(seasons: list[DataFrame]) -> DataFrame:
    """Seasons one after the other, columns by name, absent ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), seasons)
