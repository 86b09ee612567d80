"""Registered queries on nested payloads, pages, streams, simulation and optimisation."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import names
from ..operators import optimise, rates, simulate, state, strength
from ..sources import pages
from ..streaming import windows
from .registry import MATCHES, Star, _matches, query


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(s: Star) -> DataFrame:
    return s.events.select("event_id", F.from_json("props", "k string")["k"].try_cast("bigint").alias("k"))


@query("SELECT page_id, length(regexp_replace(html, '<!--.*?-->', '', 'gs')) AS visible, CAST(html LIKE '%<table%' AS BOOLEAN) AS has_table FROM pages")
def html_uncomment(s: Star) -> DataFrame:
    return s.pages.select("page_id", F.length(pages.without_comments(F.col("html"))).cast("bigint").alias("visible"), pages.uncommented(F.col("html")).contains("<table").alias("has_table"))


@query("SELECT p_partkey AS id, upper(split_part(p_brand, '#', 1)) AS label, p_partkey AS trailing, concat('A ', CAST(p_partkey % 9 AS VARCHAR(9))) AS name FROM part")
def split_names(s: Star) -> DataFrame:
    raw = F.concat_ws("_", F.lit("A"), (F.col("p_partkey") % 9).cast("string"), F.col("p_partkey").cast("string"))
    name, number = names.split_trailing_id(raw)
    return s.part.select(F.col("p_partkey").alias("id"), names.position_label(F.split_part("p_brand", F.lit("#"), F.lit(1))).alias("label"), number.alias("trailing"), name.alias("name"))


@query(f"""WITH w AS (SELECT c_custkey AS player_id, c_acctbal / 1000.0 AS ep, abs(c_acctbal) / 2000.0 AS sd, (c_custkey % 13) / 10.0 AS eo FROM customer)
    SELECT player_id, round(ep + 0.34 * (1 - greatest(0, least(1, eo))) * sd, 8)::DOUBLE AS objective_score FROM w""")
def rank_utility(s: Star) -> DataFrame:
    rows = s.customer.select(F.col("c_custkey").alias("player_id"), (F.col("c_acctbal") / 1000.0).alias("ep"), (F.abs("c_acctbal") / 2000.0).alias("sd"))
    eo = s.customer.select(F.col("c_custkey").alias("player_id"), ((F.col("c_custkey") % 13) / 10.0).alias("eo"))
    return state.rank_utility(rows, eo, 0.34).select("player_id", F.round("objective_score", 8).alias("objective_score"))


@query("""SELECT p.entry, p.element, CAST(p.element % 100 + 40 AS INT) AS now_cost, coalesce(max_by(l.price, struct_pack(t := l.kickoff_time, p := l.price)), p.element % 100 + 40 - p.element % 7) AS bought
    FROM (SELECT DISTINCT entry, element FROM {picks} WHERE gw = 1997) AS p LEFT JOIN (SELECT entry, element, kickoff_time, CAST(round(price) AS BIGINT) AS price FROM {line} WHERE season < 1997) AS l ON p.entry = l.entry AND p.element = l.element GROUP BY p.entry, p.element""")
def purchase_price(s: Star) -> DataFrame:
    held = s.picks.where("gw = 1997").select("entry", "element").distinct()
    moves = s.line.where("season < 1997").select("entry", F.col("element").alias("element_in"), F.col("kickoff_time").alias("time"), F.round("price").cast("bigint").alias("element_in_cost"))
    prices = s.part.select(F.col("p_partkey").alias("element"), (F.col("p_partkey") % 100 + 40).cast("int").alias("now_cost"), (F.col("p_partkey") % 7).alias("cost_change_start"))
    return state.purchase_prices(held, moves, prices).withColumn("bought", F.col("bought").cast("bigint"))


@query("""WITH e AS (SELECT user_id, ts, value FROM events), a AS (SELECT DISTINCT user_id, date_trunc('week', ts) AS as_of FROM events)
    SELECT a.user_id, a.as_of, round(max_by(e.value, e.ts), 4) AS value FROM a LEFT JOIN e ON a.user_id = e.user_id AND e.ts <= a.as_of GROUP BY 1, 2""")
def as_of_latest(s: Star) -> DataFrame:
    at = s.events.select("user_id", F.date_trunc("week", "ts").cast("timestamp_ntz").alias("as_of")).distinct()
    return state.latest_before(s.events, at, ["user_id"], "ts", "as_of", "value").select("user_id", "as_of", F.round("value", 4).alias("value"))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_window(s: Star) -> DataFrame:
    """The same aggregation as a batch would do, run as a stream over the landed table."""
    schema = s.events.schema
    stream = s.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{s.sf_dir}/events.parquet*")
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    out = windows.tumbling(timed, "1 day", ["event_type"], late="2 hours", n=F.count("*"), total=F.sum("value"))
    return windows.drain(out, f"stream_window_{zlib.crc32(s.sf_dir.encode())}").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), k AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
    SELECT user_id, min(ts) AS session_start, count(*) AS n FROM k GROUP BY user_id, s""")
def event_sessions(s: Star) -> DataFrame:
    timed = s.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.sessions(timed, "6 hours", ["user_id"], n=F.count("*")).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


# ---------------------------------------------------------------- no SQL form


#: Of each fixture; the operator's default is 5000, ten times the work. README has the times.
SIMULATIONS = 500


def _fixtures_and_players(s: Star) -> tuple[DataFrame, DataFrame]:
    """Twenty clubs of brands' parts, a round of fixtures, and rates from the history."""
    spark = s.spark
    fixtures = spark.range(10).select(
        F.lit(1).alias("gw"), F.col("id").alias("fixture"), (F.col("id") * 2).alias("home_id"), (F.col("id") * 2 + 1).alias("away_id"), (1.2 + F.col("id") * 0.05).alias("lambda_home"), (1.4 - F.col("id") * 0.05).alias("lambda_away")
    )
    history = s.history.where("season = 2000")
    edges = rates.price_edges(history)
    totals = history.groupBy(F.col("element").alias("player_id"), "position").agg(F.max("value").alias("price"), F.sum("minutes").alias("minutes"), *[F.sum(c).alias(c) for c in rates.STATS])
    per90 = rates.posterior_rates(totals, rates.rate_priors(rates.player_seasons(history), edges), edges)
    times = totals.select(
        "player_id", F.col("position").cast("int").alias("position"), (F.col("player_id") % 20).alias("team"), F.col("price").cast("int").alias("price"),
        F.lit(0.9).alias("p_play"), F.lit(0.7).alias("p_start"), F.lit(0.2).alias("p_sub"), F.lit(65.0).alias("exp_minutes"), F.lit(83.0).alias("minutes_if_started"), F.lit(22.0).alias("minutes_if_sub"),
    )
    return fixtures, times.join(per90, "player_id").join(F.broadcast(rates.card_rates(s.stats)), "position")


@query()
def simulate_points(s: Star) -> DataFrame:
    fixtures, players = _fixtures_and_players(s)
    return simulate.simulate(fixtures, players, rho=-0.1, assisted=0.8, n_sims=SIMULATIONS, seed=7)


@query()
def strength_fit(s: Star) -> DataFrame:
    table = _matches(s)
    model, _ = strength.fit_in_steps(table, pd.Timestamp("2002-01-01"), 250.0)
    return strength.rating_table(model.ratings(s.spark), model.home_adv, model.base)


@query(f"""WITH {MATCHES}, t AS (SELECT home_team AS team FROM m UNION ALL SELECT away_team FROM m) SELECT team, count(*) AS matches, 0.0::DOUBLE AS attack, 0.0::DOUBLE AS concede FROM t GROUP BY team""")
def strength_gradient(s: Star) -> DataFrame:
    """What is left of the gradient at each side's fitted effects, to two places: nothing."""
    table = _matches(s)
    _, left = strength.fit_in_steps(table, pd.Timestamp("2002-01-01"), 250.0)
    sides = table.select(F.explode(F.array("home_team", "away_team")).alias("team")).groupBy("team").agg(F.count("*").alias("matches"))
    rest = s.spark.createDataFrame(left.assign(attack=left["attack"].abs(), concede=left["concede"].abs()))
    return sides.join(rest, "team").select("team", "matches", F.round("attack", 2).alias("attack"), F.round("concede", 2).alias("concede"))


@query()
def half_life(s: Star) -> DataFrame:
    return strength.walk_forward(_matches(s))


def _projections(s: Star) -> pd.DataFrame:
    """Every player that a plan over four gameweeks may need: all that the driver gets, which grows with the players that nobody beats, not with all."""
    rows = s.projections.withColumns({"team": F.col("player_id") % 20, "sd": F.lit(2.0)})
    return rows.join(state.planning_pool(rows, weeks=[1, 2, 3, 4]), "player_id", "left_semi").toPandas()


@query()
def squad_milp(s: Star) -> DataFrame:
    frame = _projections(s)
    best = optimise.optimise_squad(frame.groupby("player_id").agg({"position": "first", "team": "first", "price": "first", "ep": "sum"}).reset_index())
    rows = [(p, p in best.starters, p == best.captain, p == best.vice, best.status) for p in best.squad]
    return s.spark.createDataFrame(rows, "player_id long, starts boolean, captain boolean, vice boolean, status string")


def _start(frame: pd.DataFrame) -> optimise.Start:
    base = frame.groupby("player_id").agg({"position": "first", "team": "first", "price": "first"}).reset_index()
    squad = optimise.optimise_squad(base.assign(ep=np.where(base["player_id"] % 3 == 0, 1.0, 2.0))).squad
    return optimise.Start(tuple(squad), 20, 1)


@query()
def multiweek_plan(s: Star) -> DataFrame:
    frame = _projections(s)
    plan = optimise.solve_horizon(frame, _start(frame))
    rows = [(w.gw, len(w.bought), w.hits, w.free, w.bank, w.points, w.captain) for w in plan.weeks]
    return s.spark.createDataFrame(rows, "gw int, bought int, hits int, free int, bank int, points double, captain long")


@query()
def chip_search(s: Star) -> DataFrame:
    frame = _projections(s)
    return optimise.search_chips(s.spark, frame, _start(frame), ["3xc", "bboost"])
