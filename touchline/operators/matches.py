"""Match tables, decay weights and promotions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.names import club
from .league import with_scalars

#: Goals a match below which a promoted side's ratio is not followed to minus infinity.
RATE_FLOOR = 0.15


def season_summary(history: DataFrame) -> DataFrame:
    """Per season (null kept): rows, players, first and last gameweek and kickoff."""
    return history.groupBy("season").agg(
        F.count("*").alias("rows"), F.count_distinct("element").alias("players"), F.min("gw").alias("gw_min"), F.max("gw").alias("gw_max"),
        F.min("kickoff_time").alias("first_kickoff"), F.max("kickoff_time").alias("last_kickoff"),
    )


def match_table(rows: DataFrame, live: DataFrame | None = None, live_season: str | None = None, *, canonical: bool = True) -> DataFrame:
    """One row per match of player rows (season, fixture, team, was_home, team_h_score, team_a_score, kickoff_time).

    One aggregation by (season, fixture) instead of a join of home and away
    rows. Each side's team is its most frequent one, ties to the smaller name, so that a late
    mover's later club does not name the match. live, a table of this form
    (season, date, home_team, away_team, home_goals, away_goals), replaces live_season.
    """
    kept = rows if live_season is None else rows.where(~F.col("season").eqNullSafe(live_season))
    scored = kept.na.drop(subset=["fixture", "team", "was_home", "team_h_score", "team_a_score"])
    named = F.mode("team", True)
    side = lambda home: scored.where("was_home" if home else "not was_home").groupBy("season", "fixture")
    if canonical:
        name = club
    else:
        name = lambda c: c
    home = side(True).agg(named.alias("home_team"), F.min("kickoff_time").alias("date"), F.min("team_h_score").alias("home_goals"), F.min("team_a_score").alias("away_goals"))
    away = side(False).agg(named.alias("away_team"))
    out = home.join(away, ["season", "fixture"]).select(
        "season", "date", name(F.col("home_team")).alias("home_team"), name(F.col("away_team")).alias("away_team"),
        F.col("home_goals").cast("int").alias("home_goals"), F.col("away_goals").cast("int").alias("away_goals"),
    )
    return (out if live is None else out.unionByName(live.select(out.columns))).na.drop()


def live_matches(fixtures: DataFrame, teams: DataFrame, season: str) -> DataFrame:
    """Played matches of the running season, by the clubs' names."""
    names = lambda side: F.broadcast(teams.select(F.col("id").alias(f"team_{side}"), club(F.col("name")).alias(f"{side}_name")))
    played = fixtures.where("team_h_score is not null and team_a_score is not null")
    return played.join(names("h"), "team_h").join(names("a"), "team_a").select(
        F.lit(season).alias("season"), F.try_to_timestamp("kickoff_time").alias("date"), F.col("h_name").alias("home_team"), F.col("a_name").alias("away_team"),
        F.col("team_h_score").cast("int").alias("home_goals"), F.col("team_a_score").cast("int").alias("away_goals"),
    )


def decay_weight(date: Column, as_of: Column, half_life_days: float) -> Column:
    """0.5 to the power of the age in half-lives; what is not past weighs 1."""
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(date.cast("timestamp"))) / F.lit(86_400_000_000.0)
    return F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / F.lit(float(half_life_days)))


def sides(matches: DataFrame) -> DataFrame:
    """Two rows per match: season, date, team, goals_for, goals_against."""
    view = lambda team, own, other: F.struct(F.col(team).alias("team"), F.col(own).alias("goals_for"), F.col(other).alias("goals_against"))
    both = F.explode(F.array(view("home_team", "home_goals", "away_goals"), view("away_team", "away_goals", "home_goals")))
    return matches.select("season", "date", both.alias("s")).select("season", "date", "s.*")


def effective_sample_sizes(matches: DataFrame, as_of: Column, half_life_days: float) -> DataFrame:
    """(team, effective_n): decayed number of matches."""
    return sides(matches).groupBy("team").agg(F.sum(decay_weight(F.col("date"), as_of, half_life_days)).alias("effective_n"))


def find_promotions(team_rows: DataFrame) -> DataFrame:
    """(season, team, games, goals_for, goals_against) of teams absent in the season present before; of sides() rows.

    Seasons are ranked among themselves; a team-season is joined with the
    team's own in the season before, and the first season promotes none.
    """
    seasons = team_rows.select("season").distinct().withColumn("n", F.dense_rank().over(W.orderBy("season")))
    totals = team_rows.groupBy("season", "team").agg(F.count("*").alias("games"), F.sum("goals_for").alias("goals_for"), F.sum("goals_against").alias("goals_against"))
    numbered = totals.join(seasons, "season")
    before = numbered.select("team", (F.col("n") + 1).alias("n"))
    return numbered.where("n > 1").join(before, ["team", "n"], "left_anti").select("season", "team", "games", "goals_for", "goals_against")


def promotion_offsets(team_rows: DataFrame) -> DataFrame:
    """find_promotions() plus log ratios of its goals a match to the season's average."""
    average = team_rows.groupBy("season").agg(F.avg("goals_for").alias("league_avg"))
    ratio = lambda goals: F.ln(F.greatest(F.col(goals) / F.col("games"), F.lit(RATE_FLOOR)) / F.col("league_avg"))
    return find_promotions(team_rows).join(average, "season").withColumns({"attack_offset": ratio("goals_for"), "concede_offset": ratio("goals_against")})


def promoted_prior(team_rows: DataFrame, exclude_season: str | int | None = None) -> DataFrame:
    """One row (attack, concede, promotions): means over promotions by games; 0 without any."""
    rows = promotion_offsets(team_rows)
    if exclude_season is not None:
        rows = rows.where(F.col("season") != exclude_season)
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("games")), F.sum("games")), F.lit(0.0))
    return rows.agg(mean("attack_offset").alias("attack"), mean("concede_offset").alias("concede"), F.count("*").alias("promotions"))


def meetings(matches: DataFrame, at_least: int = 6) -> DataFrame:
    """(home_team, away_team, meetings) of ordered pairs that met often enough."""
    return matches.groupBy("home_team", "away_team").agg(F.count("*").alias("meetings")).where(F.col("meetings") >= at_least)


def folds(matches: DataFrame, n_folds: int = 5, test_days: float = 56.0) -> DataFrame:
    """(fold_season, cutoff, test_end): walk-forward folds at the start of the last seasons."""
    starts = matches.groupBy(F.col("season").alias("fold_season")).agg(F.min("date").alias("cutoff"))
    numbered = with_scalars(starts.withColumn("r", F.dense_rank().over(W.orderBy(F.desc("fold_season")))), starts.agg(F.count("*").alias("n")))
    last = numbered.where((F.col("r") <= n_folds) & (F.col("r") < F.col("n")) | ((F.col("n") > n_folds) & (F.col("r") == n_folds)))
    return last.select("fold_season", "cutoff", (F.col("cutoff") + F.make_dt_interval(days=F.lit(int(test_days)))).alias("test_end"))
