"""Projections end to end, and their replay over the past."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.names import club, player_key
from ..operators import backtest, matches, minutes, rates, simulate, strength

HALF_LIFE = 250.0
#: Fixed value: the first season whose archive has defensive actions.
DEFENSIVE_FROM = "2025-26"


def position_coded(history: DataFrame) -> DataFrame:
    """history with positions 1 to 4 instead of labels."""
    return history.withColumn("position", minutes.position_code(F.col("position")))


def recent(history: DataFrame, n: int) -> DataFrame:
    """The last n seasons."""
    last = history.select("season").distinct().orderBy(F.desc("season")).limit(n)
    return history.join(F.broadcast(last), "season", "left_semi")


def player_table(elements: DataFrame, so_far: DataFrame, history: DataFrame, n_gws: int, provider: DataFrame | None = None) -> DataFrame:
    """Minutes, rates and card rates of every player.

    elements: id, full_name, element_type, team, now_cost, status, chance_of_playing_next_round, minutes and the statistics so far.
    """
    coded = position_coded(history)
    priors = minutes.position_priors(coded.where("starts is not null"), max(1, n_gws), minutes.fallback_priors(history.sparkSession))
    by_player = minutes.player_priors(recent(history, 1).where("name is not null"), player_key(F.col("name")))
    times = minutes.estimate_minutes(elements, so_far, n_gws, priors, by_player)
    edges = rates.price_edges(coded)
    attacking = rates.player_seasons(recent(coded, 6), ("goals_scored", "assists", "saves"))
    defensive = rates.player_seasons(coded.where(F.col("season") >= DEFENSIVE_FROM), rates.DEFENSIVE)
    prior = rates.rate_priors(attacking.unionByName(defensive), edges)
    players = elements.select(F.col("id").alias("player_id"), F.col("element_type").cast("int").alias("position"), F.col("now_cost").alias("price"), "minutes", *rates.STATS)
    per90 = rates.posterior_rates(players, prior, edges, provider)
    cards = rates.card_rates(recent(coded, 4))
    return times.join(per90, "player_id", "left").join(F.broadcast(cards), "position", "left")


def project(
    elements: DataFrame, teams: DataFrame, fixtures: DataFrame, so_far: DataFrame, history: DataFrame, gws: list[int], as_of: pd.Timestamp, *, n_gws: int,
    provider: DataFrame | None = None, live: DataFrame | None = None, live_season: str | None = None, n_sims: int = 5000, seed: int = 0, half_life: float = HALF_LIFE,
) -> DataFrame:
    """One row per player and gameweek: the points distribution. All gameweeks are simulated in one plan."""
    table = matches.match_table(history, live, live_season)
    model = strength.fit(table, as_of, half_life)
    names = lambda side: F.broadcast(teams.select(F.col("id").alias(f"team_{side}"), club(F.col("name")).alias(f"{'home' if side == 'h' else 'away'}_team")))
    ahead = fixtures.where(F.col("event").isin(*gws)).join(names("h"), "team_h").join(names("a"), "team_a").select(
        F.col("event").alias("gw"), F.col("id").alias("fixture"), "home_team", "away_team", F.col("team_h").alias("home_id"), F.col("team_a").alias("away_id")
    )
    rated = strength.with_rates(ahead, F.broadcast(model.ratings(history.sparkSession)), model.home_adv, model.base, model.defaults)
    assisted = rates.assisted_fraction(recent(history, 4)).first()["fraction"]
    players = player_table(elements, so_far, history, n_gws, provider)
    return simulate.simulate(rated, players, rho=model.rho, assisted=assisted, n_sims=n_sims, seed=seed)


def replay(history: DataFrame, season: str, gw: int, *, n_sims: int = 2000, half_life: float = HALF_LIFE, recent_window: int | None = None) -> DataFrame:
    """(season, gw, element, ep, quantiles) of a past gameweek from what was known before it.

    Everything is cut at the gameweek's first kickoff; a player's price and
    club are the latest seen by then. recent_window: how many of the last gameweeks minutes are estimated from, all by default. The seed is a stable function of season and gameweek.
    """
    target = history.where((F.col("season") == season) & (F.col("gw") == gw))
    cutoff = target.agg(F.min("kickoff_time").alias("t")).first()["t"]
    before = history.where(F.col("kickoff_time") < F.lit(cutoff))
    own = before.where(F.col("season") == season)
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("kickoff_time"))).alias(c)
    known = own.groupBy("element").agg(latest("name"), latest("position"), latest("team"), latest("value"), F.sum("minutes").alias("minutes"), *[F.sum(F.coalesce(s, F.lit(0))).alias(s) for s in rates.STATS])
    elements = known.select(
        F.col("element").alias("id"), F.col("name").alias("full_name"), minutes.position_code(F.col("position")).alias("element_type"), club(F.col("team")).alias("team"), F.col("value").cast("int").alias("now_cost"),
        F.lit("a").alias("status"), F.lit(None).cast("int").alias("chance_of_playing_next_round"), "minutes", *rates.STATS,
    )
    seen = own if recent_window is None else backtest.recent_gameweeks(own, recent_window)
    played = seen.agg(F.count_distinct("gw").alias("n")).first()["n"]
    players = player_table(elements, seen.select("element", "minutes", "starts"), before.where(F.col("season") < season), played)
    ahead = matches.match_table(target.withColumns({"team_h_score": F.coalesce("team_h_score", F.lit(0.0)), "team_a_score": F.coalesce("team_a_score", F.lit(0.0))}))
    model = strength.fit(matches.match_table(before), pd.Timestamp(cutoff), half_life)
    fixtures = ahead.select(F.lit(gw).alias("gw"), F.xxhash64("home_team", "away_team").alias("fixture"), "home_team", "away_team", F.col("home_team").alias("home_id"), F.col("away_team").alias("away_id"))
    rated = strength.with_rates(fixtures, F.broadcast(model.ratings(history.sparkSession)), model.home_adv, model.base, model.defaults)
    seed = int(season[:4]) * 100 + gw
    assisted = rates.assisted_fraction(before).first()["fraction"]
    out = simulate.simulate(rated, players, rho=model.rho, assisted=assisted, n_sims=n_sims, seed=seed)
    return out.select(F.lit(season).alias("season"), "gw", F.col("player_id").alias("element"), "ep", "p10", "p25", "p50", "p75", "p90")


def run_backtest(history: DataFrame, targets: list[tuple[str, int]], **how) -> dict[str, DataFrame]:
    """Predictions of the targets, errors of the model and the season-mean baseline, and calibration."""
    from functools import reduce

    predicted = reduce(DataFrame.unionByName, [replay(history, s, g, **how) for s, g in targets])
    actual = backtest.rescore(position_coded(history)).withColumn("actual", F.col("actual").cast("double"))
    wanted = predicted.select("season", "gw").distinct()
    base = backtest.season_mean_baseline(actual, wanted)
    scored = predicted.join(actual, ["season", "gw", "element"], "left").na.fill(0.0, ["actual"])
    return {"predictions": predicted, "errors": backtest.compare(predicted, actual, base), "calibration": backtest.calibration(scored)}
