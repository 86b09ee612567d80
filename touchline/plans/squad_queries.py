"""Registered queries on squads, risks, baselines and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scoring
from ..operators import backtest, league, matches, minutes, monitor, optimise, rates, simulate, state
from . import briefs, projection
from .registry import CONTENTION, GW, LINES, SETTLED, STATUS, SWINGS, USER, Star, _matches, _settled, _swings, _weights, query, r4
from .registry import MATCHES, PRIORS

# ---------------------------------------------------------------- league


def _transfers(s: Star) -> DataFrame:
    return s.line.where("ln = 3").select("entry", F.col("season").alias("gw"), F.col("element").alias("element_in"), F.col("team").alias("element_out"))


PROFILES = f"""{CONTENTION}, mine AS (SELECT DISTINCT element FROM {{picks}} WHERE gw = {GW} AND entry = {USER}),
    sq AS (SELECT p.entry, list_sort(list(p.element)) AS squad, count(*) FILTER (WHERE multiplier >= 1) AS starters, count(m.element) AS overlap_with_user, max(CASE WHEN is_captain THEN p.element END) AS captain,
    max(CASE WHEN is_vice_captain THEN p.element END) AS vice FROM {{picks}} AS p LEFT JOIN mine AS m USING (element) WHERE gw = {GW} GROUP BY p.entry),
    fo AS (SELECT entry, max(points) AS best_gw, min(points) AS worst_gw, stddev_pop(points) AS consistency, sum(hits) AS hits_taken, max_by(points % 50, gw) AS bank FROM {{manager_gw}} GROUP BY entry),
    tr AS (SELECT entry, count(*) AS n_transfers FROM {{line}} WHERE ln = 3 GROUP BY entry), ch AS (SELECT entry, count(*) AS used FROM {{manager_gw}} WHERE gw % 4 = 0 GROUP BY entry)"""


@query(f"""WITH {PROFILES} SELECT s.entry, total, len(squad) AS squad_size, coalesce(starters, 0) AS starters, coalesce(overlap_with_user, 0) AS overlap_with_user, captain, vice, coalesce(best_gw, 0) AS best_gw, coalesce(worst_gw, 0) AS worst_gw,
    round(coalesce(consistency, 0), 4) AS consistency, CAST(coalesce(hits_taken, 0) AS BIGINT) AS hits_taken, coalesce(n_transfers, 0) AS n_transfers, round(coalesce(bank, 0) / 10.0, 4)::DOUBLE AS bank, round(coalesce(weight, 0), 8) AS threat_weight,
    CAST(total - (SELECT total FROM {{standings}} WHERE entry = {USER}) AS BIGINT) AS gap_to_user, CAST(CASE WHEN coalesce(used, 0) >= 2 THEN 3 ELSE 4 END AS INT) AS chips FROM {{standings}} AS s LEFT JOIN sq ON s.entry = sq.entry LEFT JOIN fo ON s.entry = fo.entry LEFT JOIN tr ON s.entry = tr.entry
    LEFT JOIN ch ON s.entry = ch.entry LEFT JOIN weights AS w ON s.entry = w.entry""")
def profiles(s: Star) -> DataFrame:
    weeks = s.manager_gw.withColumns({"points_on_bench": F.lit(0), "value": F.lit(1000), "bank": F.col("points") % 50})
    chips = s.manager_gw.where("gw % 4 = 0").select("entry", F.lit("wildcard").alias("name"), "gw")
    out = league.profiles(s.standings, s.picks, weeks, _transfers(s), chips, _weights(s), USER, GW)
    return out.select(
        "entry", "total", F.when(F.col("squad").isNotNull(), F.size("squad")).cast("bigint").alias("squad_size"), "starters", "overlap_with_user", "captain", "vice", "best_gw", "worst_gw", F.round("consistency", 4).alias("consistency"),
        F.col("hits_taken").cast("bigint").alias("hits_taken"), "n_transfers", F.round("bank", 4).alias("bank"), F.round("threat_weight", 8).alias("threat_weight"), "gap_to_user", F.size("chips_left").alias("chips"),
    )


@query(f"""WITH v AS (SELECT var_pop(points) AS v FROM {{manager_gw}} GROUP BY gw HAVING count(*) > 1), d AS (SELECT sqrt(avg(v)) * sqrt(2.0) * 6 AS sd FROM v), m AS (SELECT total AS mine FROM {{standings}} WHERE entry = {USER})
    SELECT round(sd, 4) AS sd_rest_diff, round(coalesce(max(CASE WHEN rank = 1 THEN total - mine END) / sd, 0), 4) AS first_in_sd, round(coalesce(max(CASE WHEN rank = 5 THEN total - mine END) / sd, 0), 4) AS fifth_in_sd,
    round(coalesce(max(CASE WHEN rank = 10 THEN total - mine END) / sd, 0), 4) AS tenth_in_sd FROM {{standings}} CROSS JOIN m CROSS JOIN d GROUP BY sd""")
def win_context(s: Star) -> DataFrame:
    out = league.win_context(s.standings, s.manager_gw, USER)
    return out.select(*[F.round(c, 4).alias(c) for c in ("sd_rest_diff", "first_in_sd", "fifth_in_sd", "tenth_in_sd")])


@query(f"""WITH {SETTLED} SELECT m.entry, m.gw, CAST(sum((CASE WHEN m.gw % 2 = 1 THEN m.multiplier ELSE p.multiplier END) * coalesce(points, 0)) AS BIGINT) AS score FROM mult AS m
    JOIN {{picks}} AS p ON m.entry = p.entry AND m.gw = p.gw AND m.element = p.element LEFT JOIN {{live}} AS l ON m.gw = l.gw AND m.element = l.element GROUP BY m.entry, m.gw""")
def unsettled_scores(s: Star) -> DataFrame:
    """Substitutions and the vice-captain count in final gameweeks only, here the odd ones."""
    settled = league.effective_multipliers(s.settled_picks, s.auto_subs, None, s.settled_picks.where("gw % 2 = 1").select("gw").distinct())
    return league.gameweek_scores(settled).withColumn("score", F.col("score").cast("bigint"))


@query(f"""WITH {SWINGS}, o AS (SELECT element, 100.0 * count(*) / (SELECT count(*) FROM {{standings}}) AS owned_pct, max(entry = {USER}) AS user_owns FROM {{picks}} WHERE gw = {GW} GROUP BY element)
    SELECT swings.element, round(swing, 4) AS swing, round(coalesce(owned_pct, 0), 4) AS owned_pct, CASE WHEN coalesce(user_owns, false) AND coalesce(owned_pct, 0) <= 0.5 THEN 'differential' WHEN NOT coalesce(user_owns, false) AND coalesce(owned_pct, 0) >= 0.2 THEN 'liability'
    WHEN coalesce(user_owns, false) OR ever_used THEN 'shared' END AS kind FROM swings LEFT JOIN o ON swings.element = o.element""")
def user_positions(s: Star) -> DataFrame:
    swings = _swings(s)
    owned = league.ownership_table(s.standings, s.picks, _weights(s), GW, USER)
    return league.user_position(swings, owned, 0.5, 0.2).select("element", F.round("swing", 4).alias("swing"), F.round("owned_pct", 4).alias("owned_pct"), "kind")


PLAYERS = """pl AS (SELECT p_partkey AS element, concat('player ', CAST(p_partkey AS VARCHAR)) AS name, CASE p_partkey % 4 WHEN 0 THEN 'GKP' WHEN 1 THEN 'DEF' WHEN 2 THEN 'MID' ELSE 'FWD' END AS position FROM part WHERE p_partkey % 5 <> 0)"""


def _players(s: Star) -> DataFrame:
    key = F.col("p_partkey")
    label = F.element_at(F.array(*map(F.lit, ("GKP", "DEF", "MID", "FWD"))), (key % 4 + 1).cast("int"))
    return s.part.where("p_partkey % 5 <> 0").select(key.alias("element"), F.concat(F.lit("player "), key.cast("string")).alias("name"), F.lit("ABC").alias("team"), label.alias("position"))


@query(f"""WITH {PLAYERS} SELECT l.entry, season AS gw, concat('GW', season, ': ', coalesce(o.name, concat('#', l.team)), ' -> ', coalesce(i.name, concat('#', l.element))) AS line FROM {{line}} AS l
    LEFT JOIN pl AS o ON l.team = o.element LEFT JOIN pl AS i ON l.element = i.element WHERE ln = 3""")
def transfer_lines(s: Star) -> DataFrame:
    return league.transfer_log(_transfers(s), _players(s))


@query(f"""WITH {PLAYERS}, pts AS (SELECT element, sum(points) AS points FROM {{live}} GROUP BY element), r AS (SELECT p.entry, multiplier < 1 AS bench, pl.position, concat(name, CASE WHEN is_captain THEN '(C)' WHEN is_vice_captain THEN '(V)' ELSE '' END) AS tagged,
    coalesce(points, 0) AS points FROM {{picks}} AS p JOIN pl ON p.element = pl.element LEFT JOIN pts ON p.element = pts.element WHERE gw = {GW})
    SELECT entry, CAST(row_number() OVER (PARTITION BY entry ORDER BY bench, CASE position WHEN 'GKP' THEN 1 WHEN 'DEF' THEN 2 WHEN 'MID' THEN 3 ELSE 4 END, points DESC, tagged) AS INT) AS place,
    printf('%s%s %-20s %-4s %3dpts', CASE WHEN bench THEN 'BENCH ' ELSE '      ' END, position, tagged, 'ABC', CAST(points AS BIGINT)) AS line FROM r""")
def squad_listing(s: Star) -> DataFrame:
    return league.squad_lines(s.standings, s.picks, _players(s), s.live, GW)


# ---------------------------------------------------------------- scoring


@query("SELECT fixture, element, q, CAST(greatest(0, 4 - rank() OVER (PARTITION BY fixture ORDER BY q DESC)) AS INT) AS bonus FROM {line}")
def bonus_rows(s: Star) -> DataFrame:
    from ..operators import bonus

    return bonus.allocate_bonus(s.line.select("fixture", "element", "q"), bps="q")


@query(f"""WITH {LINES} SELECT season, gw, element, CAST(sum(plays * (CASE WHEN minutes >= 60 THEN 2 ELSE 1 END + goals_scored * g + assists * 3 + CASE WHEN minutes >= 60 AND goals_conceded = 0 THEN cs ELSE 0 END
    - CASE WHEN position <= 2 THEN goals_conceded // 2 ELSE 0 END + saves // 3 + penalties_saved * 5 - penalties_missed * 2 - own_goals * 2 - yellow_cards - red_cards * 3
    + CASE WHEN position = 2 AND dc >= 10 OR position > 2 AND dc >= 12 THEN 2 ELSE 0 END + bonus)) AS BIGINT) AS actual FROM scored GROUP BY season, gw, element""")
def rescored(s: Star) -> DataFrame:
    """Matches are scored one by one, then summed over the gameweek."""
    return backtest.rescore(s.stats)


@query(f"""WITH {LINES} SELECT fixture, CAST(sum(points) FILTER (WHERE identifier <> 'bonus') AS BIGINT) AS points FROM l GROUP BY fixture""")
def points_without_bonus(s: Star) -> DataFrame:
    rows = s.stats
    return rows.withColumn("p", scoring.points(scoring.stat_columns(rows), F.col("position"), include_bonus=False)).groupBy("fixture").agg(F.sum("p").alias("points"))


@query("""SELECT fixture, CAST(sum(CASE WHEN minutes > 0 THEN (CASE WHEN minutes >= 60 THEN 2 ELSE 1 END) + CASE WHEN given > 0 THEN CASE position WHEN 3 THEN given WHEN 4 THEN 0 ELSE given * 4 END ELSE 0 END
    + CASE WHEN position = 1 THEN 0 WHEN position = 2 AND tally >= 10 THEN 2 WHEN position > 2 AND tally >= 12 THEN 2 ELSE 0 END ELSE 0 END) AS BIGINT) AS points
    FROM (SELECT fixture, minutes, position, yellow_cards AS given, saves * 2 AS tally FROM {stats}) AS x GROUP BY fixture""")
def published_tallies(s: Star) -> DataFrame:
    """Clean sheets and defensive contributions as published, rather than derived."""
    rows = s.stats.select("fixture", "minutes", "position", F.col("yellow_cards").alias("clean_sheets"), (F.col("saves") * 2).alias("defensive_contribution"))
    return scoring.gameweek_points(rows, ["fixture"])


# ---------------------------------------------------------------- monitoring


@query("SELECT player_id, now_cost FROM {prices} WHERE ts = (SELECT max(ts) FROM {prices})")
def latest_snapshot(s: Star) -> DataFrame:
    return monitor.latest_snapshot(s.prices).select("player_id", "now_cost")


@query("""WITH w AS (SELECT element AS player_id, gw, min(minutes) AS minutes FROM {history} WHERE season = 1997 GROUP BY 1, 2)
    SELECT player_id, CAST(min_by(minutes, gw) AS BIGINT) AS first, CAST(max_by(minutes, gw) AS BIGINT) AS last, count(*) AS weeks, string_agg(CAST(minutes AS VARCHAR), ',' ORDER BY gw) AS series FROM w GROUP BY player_id""")
def minutes_trend(s: Star) -> DataFrame:
    rows = s.history.where("season = 1997").groupBy(F.col("element").alias("player_id"), "gw").agg(F.min("minutes").alias("minutes"))
    return monitor.minutes_trend(rows).withColumn("series", F.array_join(F.col("series").cast("array<string>"), ","))


RISKS = f"""e AS (SELECT p_partkey AS player_id, {STATUS} AS st, p_partkey % 200 AS m, (40 + p_partkey % 90) / 10.0 AS price, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 4 * 25 END AS ch, p_partkey % 11 = 0 AS bench FROM part),
    w AS (SELECT element AS player_id, min_by(minutes, gw) AS f, max_by(minutes, gw) AS l, count(*) AS n FROM {{history}} WHERE season = 1997 GROUP BY 1),
    r AS (SELECT player_id, price, 'flagged' AS kind, CASE WHEN st = 'u' OR coalesce(ch, -1) = 0 THEN 'critical' ELSE 'high' END AS severity, NOT (st = 'u' OR coalesce(ch, -1) = 0) AS needs_check FROM e WHERE st <> 'a'
    UNION ALL SELECT player_id, price, 'zero-minutes', CASE WHEN price >= 6.0 THEN 'critical' ELSE 'high' END, true FROM e WHERE st = 'a' AND m = 0 AND NOT bench
    UNION ALL SELECT player_id, price, 'low-minutes', CASE WHEN price >= 5.5 THEN 'high' ELSE 'medium' END, price >= 5.5 FROM e WHERE st = 'a' AND m > 0 AND m < 135 AND NOT bench
    UNION ALL SELECT e.player_id, price, 'dropped', 'high', true FROM e JOIN w ON e.player_id = w.player_id WHERE n >= 2 AND f >= 45 AND l = 0
    UNION ALL SELECT player_id, price, 'market-selling', 'medium', true FROM e WHERE player_id % 17 = 0)"""


def _risk_elements(s: Star) -> DataFrame:
    key = F.col("p_partkey")
    return s.part.select(
        key.alias("id"), F.col("p_name").alias("web_name"), F.col("p_brand").alias("team"), (key % 4 + 1).alias("element_type"), (40 + key % 90).alias("now_cost"), (key % 200).alias("minutes"), F.expr(STATUS).alias("status"),
        F.lit(None).cast("string").alias("news"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 4 * 25 END").alias("chance_of_playing_next_round"),
    )


def _risks(s: Star) -> DataFrame:
    elements = _risk_elements(s)
    trend = monitor.minutes_trend(s.history.where("season = 1997").select(F.col("element").alias("player_id"), "gw", "minutes"))
    prices = s.part.select(F.col("p_partkey").alias("player_id"), F.when(F.col("p_partkey") % 17 == 0, -600).otherwise(100).alias("hourly_rate"), F.lit(1.5).alias("proj_pct_today"))
    bench = s.part.where("p_partkey % 11 = 0").select(F.col("p_partkey").alias("player_id"))
    return monitor.scan_risks(elements, 3, trend, prices, bench)


@query(f"WITH {RISKS} SELECT player_id, kind, severity, round(price, 2)::DOUBLE AS price, needs_check FROM r")
def risk_rows(s: Star) -> DataFrame:
    return _risks(s).select("player_id", "kind", "severity", F.round("price", 2).alias("price"), "needs_check")


@query(f"""WITH {RISKS} SELECT r.player_id, kind, replace(CASE kind WHEN 'flagged' THEN 'Will %s be fit?' WHEN 'zero-minutes' THEN 'Why has %s not played?' WHEN 'low-minutes' THEN 'Is %s rotated or unfit?' WHEN 'dropped' THEN 'Why was %s dropped?'
    ELSE 'What do the sellers of %s know?' END, '%s', p_name) AS question FROM r JOIN part ON r.player_id = p_partkey WHERE needs_check""")
def open_questions(s: Star) -> DataFrame:
    return monitor.open_questions(_risks(s))


@query(f"""WITH q AS (SELECT DISTINCT element FROM {{picks}} WHERE gw = {GW} AND entry = {USER}), e AS (SELECT p_partkey AS player_id, {STATUS} AS st, p_partkey % 200 AS m, p_partkey % 4 AS p, (40 + p_partkey % 90) / 10.0 AS price,
    CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 4 * 25 END AS ch FROM part JOIN q ON p_partkey = element),
    b AS (SELECT player_id FROM (SELECT player_id, row_number() OVER (ORDER BY m DESC, player_id) AS r FROM e WHERE p = 0) AS k WHERE r > 1)
    SELECT player_id, 'flagged' AS kind FROM e WHERE st <> 'a' UNION ALL SELECT player_id, 'zero-minutes' FROM e WHERE st = 'a' AND m = 0 AND player_id NOT IN (SELECT player_id FROM b)
    UNION ALL SELECT player_id, 'low-minutes' FROM e WHERE st = 'a' AND m > 0 AND m < 135 AND player_id NOT IN (SELECT player_id FROM b)""")
def squad_risks(s: Star) -> DataFrame:
    """A squad's keepers but the one with most minutes are meant to sit."""
    squad = s.picks.where(f"gw = {GW} and entry = {USER}").select(F.col("element").alias("player_id")).distinct()
    return monitor.squad_risks(_risk_elements(s), squad, 3).select("player_id", "kind")


# ---------------------------------------------------------------- model


ESTIMATES = """WITH s AS (SELECT season, element, min(position) AS position, count(*) FILTER (WHERE gw <= 6) AS ne, count(*) FILTER (WHERE gw > 6) AS nl, count(*) FILTER (WHERE gw <= 6 AND minutes > 0) AS ep, count(*) FILTER (WHERE gw <= 6 AND starts > 0) AS es,
    count(*) FILTER (WHERE gw > 6 AND minutes > 0) AS lp, count(*) FILTER (WHERE gw > 6 AND starts > 0) AS ls, coalesce(sum(minutes) FILTER (WHERE gw > 6 AND starts > 0), 0) AS ms,
    count(*) FILTER (WHERE gw > 6 AND minutes > 0 AND starts = 0) AS lb, coalesce(sum(minutes) FILTER (WHERE gw > 6 AND minutes > 0 AND starts = 0), 0) AS mb FROM {history} GROUP BY 1, 2),
    found AS (SELECT CAST(position AS INT) AS position, CASE WHEN es > 0 THEN 'started' WHEN ep > 0 THEN 'subbed' ELSE 'unused' END AS bucket, CAST(sum(lp) AS DOUBLE) / sum(nl) AS pp, CAST(sum(ls) AS DOUBLE) / sum(nl) AS ps,
    coalesce(CAST(sum(ms) AS DOUBLE) / nullif(sum(ls), 0), 80.0) AS mst, coalesce(CAST(sum(mb) AS DOUBLE) / nullif(sum(lb), 0), 22.0) AS msu FROM s WHERE ne > 0 AND nl > 0 GROUP BY 1, 2),
    fb(position, bucket, pp, st, mst, msu) AS (VALUES %s), priors AS (SELECT position, bucket, pp, ps, mst, msu FROM found UNION ALL SELECT position, bucket, pp, pp * st, mst, msu FROM fb WHERE NOT EXISTS (SELECT 1 FROM found WHERE found.position = fb.position AND found.bucket = fb.bucket)),
    own AS (SELECT element, count(*) FILTER (WHERE minutes > 0) AS gp, count(*) FILTER (WHERE starts > 0) AS gs, coalesce(sum(minutes) FILTER (WHERE starts > 0), 0) AS ms, count(*) FILTER (WHERE minutes > 0 AND starts = 0) AS nb,
    coalesce(sum(minutes) FILTER (WHERE minutes > 0 AND starts = 0), 0) AS mb FROM {history} WHERE season = 2001 AND gw <= 2 GROUP BY element),
    nm AS (SELECT concat('player ', CAST(element %% 700 AS VARCHAR)) AS name_key, count(*) AS games, avg(CASE WHEN minutes > 0 THEN 1.0 ELSE 0.0 END) AS po, avg(CASE WHEN starts > 0 THEN 1.0 ELSE 0.0 END) AS so FROM {history} WHERE season = 2000 GROUP BY 1 HAVING count(*) >= 5),
    e AS (SELECT p_partkey AS player_id, CAST(p_partkey %% 4 + 1 AS INT) AS position, CAST(40 + p_partkey %% 90 AS INT) AS price, coalesce(gp, 0) AS gp, coalesce(gs, 0) AS gs, coalesce(ms, 0) AS ms, coalesce(nb, 0) AS nb, coalesce(mb, 0) AS mb,
    CASE WHEN coalesce(gs, 0) > 0 THEN 'started' WHEN coalesce(gp, 0) > 0 THEN 'subbed' ELSE 'unused' END AS bucket, concat('player ', CAST(p_partkey %% 700 AS VARCHAR)) AS name_key FROM part LEFT JOIN own ON p_partkey = element),
    k AS (SELECT e.*, pr.mst, pr.msu, %s AS pp, %s AS ps FROM e LEFT JOIN priors AS pr ON e.position = pr.position AND e.bucket = pr.bucket LEFT JOIN nm ON e.name_key = nm.name_key),
    m AS (SELECT player_id, position, price, (gp + 2 * pp) / 4 AS p_play, least((gs + 2 * ps) / 4, (gp + 2 * pp) / 4) AS p_start, (ms + 2 * mst) / (gs + 2) AS minutes_if_started, (mb + 2 * msu) / (nb + 2) AS minutes_if_sub FROM k)
    SELECT player_id, position, price, round(p_play, 6) AS p_play, round(p_start, 6) AS p_start, round(minutes_if_started, 4) AS minutes_if_started, round(minutes_if_sub, 4) AS minutes_if_sub,
    round(p_start * minutes_if_started + greatest(0, p_play - p_start) * minutes_if_sub, 4) AS exp_minutes FROM m"""
FALLBACK = ", ".join(
    f"({p}, '{bucket}', {play}::DOUBLE, {starts}::DOUBLE, {a}::DOUBLE, {b}::DOUBLE)" for p, plays in minutes.FALLBACK_PLAY.items() for play, (bucket, starts, a, b) in zip(plays, minutes.FALLBACK_BUCKETS)
)


def _estimates(s: Star, by_player: DataFrame | None) -> DataFrame:
    key = F.col("p_partkey")
    elements = s.parts.select(
        key.alias("id"), F.concat(F.lit("Player-"), (key % 700).cast("string")).alias("full_name"), (key % 4 + 1).alias("element_type"), F.col("p_brand").alias("team"), (40 + key % 90).alias("now_cost"),
        F.lit("a").alias("status"), F.lit(None).cast("int").alias("chance_of_playing_next_round"),
    )
    priors = minutes.position_priors(s.history, 6, minutes.fallback_priors(s.spark))
    out = minutes.estimate_minutes(elements, s.history.where("season = 2001 and gw <= 2"), 2, priors, by_player)
    six = {c: F.round(c, 6) for c in ("p_play", "p_start")}
    return out.withColumns(six | r4("minutes_if_started", "minutes_if_sub", "exp_minutes")).select("player_id", "position", "price", "p_play", "p_start", "minutes_if_started", "minutes_if_sub", "exp_minutes")


@query(ESTIMATES % (FALLBACK, "pr.pp", "pr.ps"))
def estimated_minutes(s: Star) -> DataFrame:
    """After two gameweeks of a season, by positions' priors."""
    return _estimates(s, None)


@query(ESTIMATES % (FALLBACK, "CASE WHEN games IS NULL THEN pr.pp ELSE games / (games + 6.0) * po + (1 - games / (games + 6.0)) * pr.pp END", "CASE WHEN games IS NULL THEN pr.ps ELSE games / (games + 6.0) * so + (1 - games / (games + 6.0)) * pr.ps END"))
def estimated_minutes_by_name(s: Star) -> DataFrame:
    """The same, with players' own records of the season before, by name."""
    from ..functions.names import player_key

    key = player_key(F.concat(F.lit("Player-"), (F.col("element") % 700).cast("string")))
    return _estimates(s, minutes.player_priors(s.history.where("season = 2000"), key))


BLENDED = f"""{PRIORS}, pl AS (SELECT element AS player_id, position, max(value) AS price, sum(minutes) AS minutes, sum(goals_scored) AS goals_scored, sum(assists) AS assists, sum(clearances_blocks_interceptions) AS cbi, sum(tackles) AS tackles, sum(recoveries) AS recoveries,
    sum(saves) AS saves FROM {{history}} GROUP BY 1, 2), ev AS (SELECT pl.player_id, position, price, minutes, unnest(['goals_scored', 'assists', 'clearances_blocks_interceptions', 'tackles', 'recoveries', 'saves']) AS stat,
    unnest([CASE WHEN player_id % 3 = 0 THEN goals_scored ELSE 0.5 * goals_scored + 0.5 * (player_id % 9) END, CASE WHEN player_id % 3 = 0 THEN assists ELSE 0.5 * assists + 0.5 * (player_id % 7) END, cbi, tackles, recoveries, saves]) AS e FROM pl),
    k AS (SELECT ev.*, CASE WHEN price >= e2 THEN 2 WHEN price >= e1 THEN 1 ELSE 0 END AS tier FROM ev JOIN edges USING (position)),
    f AS (SELECT player_id, k.stat, CASE WHEN (k.position = 1) = (k.stat = 'saves') THEN (n0 * mu + e) / (n0 + minutes / 90.0) ELSE 0.0 END AS rate FROM k LEFT JOIN priors AS p ON k.position = p.position AND k.tier = p.tier AND k.stat = p.stat)"""


@query(f"WITH {BLENDED} SELECT player_id, " + ", ".join(f"round(max(rate) FILTER (WHERE stat = '{c}'), 6) AS {c}_p90" for c in rates.STATS) + " FROM f GROUP BY player_id")
def blended_rates(s: Star) -> DataFrame:
    """All six rates, goals and assists averaged with a provider's expected ones where it has the player."""
    edges = rates.price_edges(s.history)
    players = s.history.groupBy(F.col("element").alias("player_id"), "position").agg(F.max("value").alias("price"), F.sum("minutes").alias("minutes"), *[F.sum(c).alias(c) for c in rates.STATS])
    provider = s.part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("player_id"), (F.col("p_partkey") % 9).cast("double").alias("xg"), (F.col("p_partkey") % 7).cast("double").alias("xa"))
    priors = rates.rate_priors(rates.player_seasons(s.history), edges)
    return rates.posterior_rates(players, priors, edges, provider).select("player_id", *[F.round(f"{c}_p90", 6).alias(f"{c}_p90") for c in rates.STATS])


#: What a projection is given before it draws. Seasons are 25 years later, so that the archive has defensive actions from 2000 on; rates look six seasons back, cards four.
INPUT_PRIORS = PRIORS.replace("(stat = 'saves') GROUP", "(stat = 'saves') AND season >= CASE WHEN stat IN ('goals_scored', 'assists', 'saves') THEN 1996 ELSE 2000 END GROUP")
INPUT_MINUTES = (ESTIMATES % (
    FALLBACK, "CASE WHEN games IS NULL THEN pr.pp ELSE games / (games + 6.0) * po + (1 - games / (games + 6.0)) * pr.pp END", "CASE WHEN games IS NULL THEN pr.ps ELSE games / (games + 6.0) * so + (1 - games / (games + 6.0)) * pr.ps END"
)).replace("gw <= 6", "gw <= 2").replace("gw > 6", "gw > 2").replace("season = 2000", "season = 2001")
SO_FAR = {"goals_scored": 5, "assists": 4, "clearances_blocks_interceptions": 30, "tackles": 20, "recoveries": 25, "saves": 15}


@query(f"""SELECT t.player_id, t.position, p_play, p_start, exp_minutes, {", ".join(f"{c}_p90" for c in SO_FAR)}, yellow_p90, red_p90, own_goal_p90 FROM ({INPUT_MINUTES}) AS t JOIN (WITH {INPUT_PRIORS},
    ev AS (SELECT p_partkey AS player_id, p_partkey % 4 + 1 AS position, 40 + p_partkey % 90 AS price, p_partkey % 200 AS minutes, unnest([{", ".join(f"'{c}'" for c in SO_FAR)}]) AS stat, unnest([{", ".join(f"p_partkey % {n}" for n in SO_FAR.values())}]) AS e FROM part),
    k AS (SELECT ev.*, CASE WHEN price >= e2 THEN 2 WHEN price >= e1 THEN 1 ELSE 0 END AS tier FROM ev JOIN edges USING (position)),
    f AS (SELECT player_id, k.stat, CASE WHEN (k.position = 1) = (k.stat = 'saves') THEN (n0 * mu + e) / (n0 + minutes / 90.0) ELSE 0.0 END AS rate FROM k LEFT JOIN priors AS p ON k.position = p.position AND k.tier = p.tier AND k.stat = p.stat)
    SELECT player_id, {", ".join(f"round(max(rate) FILTER (WHERE stat = '{c}'), 6) AS {c}_p90" for c in SO_FAR)} FROM f GROUP BY player_id) AS r ON t.player_id = r.player_id
    LEFT JOIN (SELECT position, round(sum(yellow_cards) / (sum(minutes) / 90.0), 6) AS yellow_p90, round(sum(red_cards) / (sum(minutes) / 90.0), 6) AS red_p90, round(sum(own_goals) / (sum(minutes) / 90.0), 6) AS own_goal_p90 FROM {{history}} WHERE minutes > 0 AND season >= 1998 GROUP BY 1) AS c ON t.position = c.position""")
def player_inputs(s: Star) -> DataFrame:
    """Minutes, rates and cards of every player, joined as a projection takes them."""
    key, shirt = F.col("p_partkey"), lambda c: F.concat(F.lit("Player-"), (F.col(c) % 700).cast("string"))
    label = F.element_at(F.array(*map(F.lit, ("GK", "DEF", "MID", "FWD"))), (F.col("element") % 4 + 1).cast("int"))
    season = F.concat((F.col("season") + 25).cast("string"), F.lit("-"), F.lpad(((F.col("season") + 26) % 100).cast("string"), 2, "0"))
    history = s.history.withColumns({"season": season, "name": shirt("element"), "position": label})
    elements = s.parts.select(
        key.alias("id"), shirt("p_partkey").alias("full_name"), (key % 4 + 1).alias("element_type"), F.col("p_brand").alias("team"), (40 + key % 90).alias("now_cost"), F.lit("a").alias("status"), F.lit(None).cast("int").alias("chance_of_playing_next_round"),
        (key % 200).alias("minutes"), *[(key % n).alias(c) for c, n in SO_FAR.items()],
    )
    out = projection.player_table(elements, s.history.where("season = 2001 and gw <= 2"), history, 2)
    six = ["p_play", "p_start", *[f"{c}_p90" for c in SO_FAR], "yellow_p90", "red_p90", "own_goal_p90"]
    return out.select("player_id", "position", F.round("exp_minutes", 4).alias("exp_minutes"), *[F.round(c, 6).alias(c) for c in six])


@query("SELECT id, row_id FROM (SELECT c_custkey AS id, p_partkey AS row_id, row_number() OVER (PARTITION BY c_custkey ORDER BY p_partkey) AS r FROM customer JOIN part ON c_custkey % 900 = p_partkey % 900 AND c_custkey % 7 = p_partkey % 7 WHERE p_partkey % 4 <> 0) AS x WHERE r = 1")
def provider_match(s: Star) -> DataFrame:
    """Rows of a provider whose club is a list, of a player who moved, match nobody."""
    key = F.col("p_partkey")
    team = F.concat(F.lit("t"), (key % 7).cast("string"))
    provider = s.part.select(key.alias("row_id"), F.concat(F.lit("name "), (key % 900).cast("string")).alias("name_key"), F.when(key % 4 == 0, F.concat(team, F.lit(",t9"))).otherwise(team).alias("team_title"))
    left = s.customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("name "), (F.col("c_custkey") % 900).cast("string")).alias("name_key"), F.concat(F.lit("t"), (F.col("c_custkey") % 7).cast("string")).alias("team_key"))
    return rates.name_match(left, rates.one_club(provider).withColumn("team_key", F.col("team_title")), by_name=False)


@query(f"""WITH {MATCHES}, st AS (SELECT season AS fold_season, min(date) AS cutoff, dense_rank() OVER (ORDER BY season DESC) AS r, count(*) OVER () AS n FROM m GROUP BY season)
    SELECT fold_season, cutoff, cutoff + INTERVAL 56 DAY AS test_end FROM st WHERE r <= 5 AND r < n OR n > 5 AND r = 5""")
def backtest_folds(s: Star) -> DataFrame:
    return matches.folds(_matches(s))


@query("SELECT gw, round(power(0.84, row_number() OVER (ORDER BY gw) - 1), 8) AS factor FROM (SELECT DISTINCT gw FROM {history}) AS g")
def discount_factors(s: Star) -> DataFrame:
    return state.discounts(s.history, 0.84).withColumn("factor", F.round("factor", 8))


@query("SELECT element, gw, CAST(minutes AS BIGINT) AS minutes FROM {history} WHERE season = 1997 AND gw IN (SELECT DISTINCT gw FROM {history} WHERE season = 1997 ORDER BY gw DESC LIMIT 4)")
def recent_window(s: Star) -> DataFrame:
    return backtest.recent_gameweeks(s.history.where("season = 1997"), 4).select("element", "gw", "minutes")


@query("""WITH p AS (SELECT season, gw, element, (element % 50) / 5.0 AS ep FROM {history}), a AS (SELECT season, gw, element, minutes AS actual FROM {history} WHERE element % 6 <> 0), b AS (SELECT season, gw, element, 3.5 AS baseline FROM {history} WHERE element % 4 <> 0),
    j AS (SELECT ep, coalesce(actual, 0) AS actual, coalesce(baseline, 0) AS baseline FROM p LEFT JOIN a USING (season, gw, element) LEFT JOIN b USING (season, gw, element)), k AS (SELECT * FROM j WHERE ep > 2 OR actual > 2 OR baseline > 2)
    SELECT 'ep' AS model, round(sqrt(avg((ep - actual) * (ep - actual))), 4) AS rmse, round(avg(abs(ep - actual)), 4)::DOUBLE AS mae, count(*) AS n FROM k UNION ALL SELECT 'baseline', round(sqrt(avg((baseline - actual) * (baseline - actual))), 4), round(avg(abs(baseline - actual)), 4)::DOUBLE, count(*) FROM k""")
def model_errors(s: Star) -> DataFrame:
    keys = ["season", "gw", "element"]
    predicted = s.history.select(*keys, (F.col("element") % 50 / 5.0).alias("ep"))
    actual = s.history.where("element % 6 <> 0").select(*keys, F.col("minutes").cast("double").alias("actual"))
    base = s.history.where("element % 4 <> 0").select(*keys, F.lit(3.5).alias("baseline"))
    return backtest.compare(predicted, actual, base, relevant=2.0).withColumns(r4("rmse", "mae"))


@query("""WITH c AS (SELECT season AS gw, element AS player_id, fixture % 8 AS sim, sum(q % 9) AS points FROM {line} GROUP BY 1, 2, 3), f AS (SELECT gw, player_id, avg(points) AS ep, stddev_pop(points) AS sd, quantile_cont(points, 0.1) AS p10, quantile_cont(points, 0.5) AS p50, quantile_cont(points, 0.9) AS p90
    FROM c GROUP BY 1, 2), g AS (SELECT DISTINCT season AS gw FROM {line}) SELECT g.gw, p_partkey AS player_id, round(coalesce(ep, 0), 4) AS ep, round(coalesce(sd, 0), 4) AS sd, round(coalesce(p10, 0), 4) AS p10, round(coalesce(p50, 0), 4) AS p50, round(coalesce(p90, 0), 4) AS p90
    FROM g CROSS JOIN part LEFT JOIN f ON g.gw = f.gw AND p_partkey = f.player_id""")
def points_summary(s: Star) -> DataFrame:
    """Distributions of simulated points, matches of a double gameweek summed in each simulation."""
    cells = s.line.select(F.col("season").alias("gw"), F.col("element").alias("player_id"), (F.col("fixture") % 8).alias("sim"), (F.col("q") % 9).alias("points"))
    zero = F.lit(0.0)
    players = s.part.select(F.col("p_partkey").alias("player_id"), F.lit(1).alias("position"), F.lit(1).alias("team"), F.lit(50).alias("price"), zero.alias("p_play"), zero.alias("p_start"), zero.alias("exp_minutes"))
    out = simulate.summarise(cells, cells.select("gw"), players, 8)
    return out.select("gw", "player_id", *[F.round(c, 4).alias(c) for c in ("ep", "sd", "p10", "p50", "p90")])


# ---------------------------------------------------------------- decisions


@query("""WITH b AS (SELECT entry, gw, count(*) AS n, count(DISTINCT element) AS d, count(*) FILTER (WHERE element % 4 = 0) AS p1, count(*) FILTER (WHERE element % 4 = 1) AS p2, count(*) FILTER (WHERE element % 4 = 2) AS p3, count(*) FILTER (WHERE element % 4 = 3) AS p4 FROM {picks} WHERE gw = 1997 GROUP BY 1, 2),
    c AS (SELECT entry, max(k) AS club FROM (SELECT entry, element % 20 AS t, count(*) AS k FROM {picks} WHERE gw = 1997 GROUP BY 1, 2) AS x GROUP BY entry), m AS (SELECT entry, points % 50 - 1 AS bank, CAST(gw % 7 AS INT) AS free FROM {manager_gw} WHERE gw = 1997)
    SELECT m.entry, concat_ws(',', CASE WHEN coalesce(n, 0) <> 15 THEN 'size' END, CASE WHEN n <> d THEN 'repeated' END, CASE WHEN club > 3 THEN 'club' END, CASE WHEN coalesce(p1, 0) <> 2 THEN 'position 1' END, CASE WHEN coalesce(p2, 0) <> 5 THEN 'position 2' END,
    CASE WHEN coalesce(p3, 0) <> 5 THEN 'position 3' END, CASE WHEN coalesce(p4, 0) <> 3 THEN 'position 4' END, CASE WHEN NOT free BETWEEN 1 AND 5 THEN 'free transfers' END, CASE WHEN bank < 0 THEN 'bank' END) AS faults FROM m LEFT JOIN b ON m.entry = b.entry LEFT JOIN c ON m.entry = c.entry""")
def squad_faults(s: Star) -> DataFrame:
    held = s.picks.where("gw = 1997").select("entry", "element", (F.col("element") % 4 + 1).alias("position"), (F.col("element") % 20).alias("team"))
    managers = s.manager_gw.where("gw = 1997").select("entry", (F.col("points") % 50 - 1).alias("bank"), (F.col("gw") % 7).alias("free"))
    return state.squad_faults(held, managers).withColumn("faults", F.array_join("faults", ","))


@query("""SELECT round(sum((CASE WHEN slot <= 3 THEN 1 ELSE 0 END + CASE WHEN is_captain THEN 1 ELSE 0 END) * (p.element % 60) / 10.0) - 4 * (SELECT sum(hits) FROM {manager_gw} WHERE entry = 1), 4)::DOUBLE AS ep FROM {picks} AS p WHERE entry = 1""")
def plan_value(s: Star) -> DataFrame:
    """Expected points of starters and captains, less hits."""
    plan = s.picks.where("entry = 1").select("gw", F.col("element").alias("player_id"), (F.col("slot") <= 3).alias("starts"), F.col("is_captain").alias("captain"))
    expected = s.picks.select("gw", F.col("element").alias("player_id")).distinct().withColumn("ep", F.col("player_id") % 60 / 10.0)
    return state.plan_points(plan, expected, s.manager_gw.where("entry = 1").select("gw", "hits")).withColumn("ep", F.round("ep", 4))


@query("SELECT player_id, gw, ep, objective_score FROM (SELECT player_id, gw, ep, ep AS objective_score, row_number() OVER (PARTITION BY gw ORDER BY ep DESC, player_id) AS r FROM {projections}) AS x WHERE r <= 25")
def best_projections(s: Star) -> DataFrame:
    """The 25 best of each gameweek by the plain objective."""
    return state.best(state.plain_objective(s.projections), 25, "objective_score", ["gw"]).select("player_id", "gw", "ep", "objective_score")


@query("""SELECT gw, round(coalesce(max(ep) FILTER (WHERE player_id = 7), 0) - coalesce(max(ep) FILTER (WHERE player_id = 11), 0), 4) AS gain FROM {projections} GROUP BY gw""")
def transfer_gain(s: Star) -> DataFrame:
    return state.ep_gap(s.projections, 7, 11).withColumn("gain", F.round("gain", 4))


@query("SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN '3xc' WHEN 1 THEN 'bboost' WHEN 2 THEN 'freehit' WHEN 3 THEN 'wildcard' ELSE 'mystery' END AS chip FROM customer")
def chip_names(s: Star) -> DataFrame:
    key = F.col("c_custkey")
    given = F.element_at(F.array(*map(F.lit, ("Triple_Captain", "BENCH_BOOST", "free_hit", "wildcard", "Mystery"))), (key % 5 + 1).cast("int"))
    return s.customer.select(key.alias("id"), state.chip_name(given).alias("chip"))


@query("""SELECT * FROM (VALUES ('affordable', true), ('at most three of a club', true), ('captain starts', true), ('eleven start', true), ('fifteen different players', true), ('one keeper starts', true),
    ('positions 2 5 5 3', true), ('proven optimal', true), ('three defenders and a forward start', true), ('vice starts', true)) AS t(rule, holds)""")
def squad_rules(s: Star) -> DataFrame:
    """What must hold for a best squad of the whole pool of candidates."""
    pool = state.candidate_pool(s.projections, 20, weeks=[1, 2, 3, 4]).select("player_id", "position", (F.col("player_id") % 20).alias("team"), "price", F.col("total").alias("ep")).toPandas()
    best = optimise.optimise_squad(pool)
    rows = pool.set_index("player_id").loc[list(best.squad)]
    starts = rows.loc[list(best.starters)]["position"].value_counts()
    holds = {
        "affordable": rows["price"].sum() <= 1000, "at most three of a club": rows["team"].value_counts().max() <= 3, "captain starts": best.captain in best.starters, "vice starts": best.vice in best.starters,
        "eleven start": len(set(best.starters)) == 11, "fifteen different players": len(set(best.squad)) == 15, "one keeper starts": starts.get(1, 0) == 1, "three defenders and a forward start": starts.get(2, 0) >= 3 and starts.get(4, 0) >= 1,
        "positions 2 5 5 3": [int((rows["position"] == p).sum()) for p in (1, 2, 3, 4)] == [2, 5, 5, 3], "proven optimal": best.status == "Optimal",
    }
    return s.spark.createDataFrame([(k, bool(v)) for k, v in holds.items()], "rule string, holds boolean")


# ---------------------------------------------------------------- briefs


@query(f"""SELECT p_partkey AS player_id, p_name AS name, coalesce(substr(n_name, 1, 3), '???') AS team, slot, round((40 + p_partkey % 90) / 10.0, 4)::DOUBLE AS price, round(CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE (p_partkey % 400) / 10.0 END, 4)::DOUBLE AS selected_by, slot > 11 AS benched
    FROM (SELECT element, CAST(slot * 3 AS INT) AS slot FROM {{picks}} WHERE gw = {GW} AND entry = {USER}) AS p JOIN part ON p.element = p_partkey LEFT JOIN nation ON p_partkey % 30 = n_nationkey""")
def squad_page(s: Star) -> DataFrame:
    key = F.col("p_partkey")
    elements = s.part.select(
        key.alias("id"), F.col("p_name").alias("web_name"), (key % 30).alias("team"), (key % 4 + 1).alias("element_type"), (40 + key % 90).alias("now_cost"), F.lit(1).alias("total_points"), F.lit(90).alias("minutes"), F.lit(None).cast("string").alias("status"),
        F.lit(" late ").alias("news"), F.when(key % 6 == 0, "n/a").otherwise((key % 400 / 10).cast("string")).alias("selected_by_percent"),
    )
    teams = s.nation.select(F.col("n_nationkey").alias("id"), F.substring("n_name", 1, 3).alias("short_name"))
    picks = s.picks.withColumn("slot", (F.col("slot") * 3).cast("int"))
    return briefs.squad_rows(picks, elements, teams, USER, GW).select("player_id", "name", "team", "slot", F.round("price", 4).alias("price"), F.round("selected_by", 4).alias("selected_by"), "benched")


@query("""SELECT CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat(strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d'), ' 00:00') END AS kickoff, coalesce(h.n_name, '???') AS home, coalesce(a.n_name, '???') AS away, CAST(o_orderkey % 5 AS INT) AS home_difficulty, CAST(o_custkey % 5 AS INT) AS away_difficulty
    FROM orders LEFT JOIN nation AS h ON o_custkey % 30 = h.n_nationkey LEFT JOIN nation AS a ON o_orderkey % 30 = a.n_nationkey""")
def fixture_page(s: Star) -> DataFrame:
    key, other = F.col("o_orderkey"), F.col("o_custkey")
    fixtures = s.orders.select(
        F.when(key % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T00:00:00Z'")).alias("kickoff_time"), (other % 30).alias("team_h"), (key % 30).alias("team_a"), (key % 5).cast("int").alias("team_h_difficulty"), (other % 5).cast("int").alias("team_a_difficulty")
    )
    return briefs.fixture_rows(fixtures, s.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("short_name")))


@query(f"""WITH m AS (SELECT max(rank) AS user_rank, max(total) AS user_total FROM {{standings}} WHERE entry = {USER})
    SELECT count(*) AS managers, max(total) AS leader, round(quantile_cont(total, 0.5), 4) AS median, round(avg(total), 4) AS mean, min(total) AS last, user_rank, user_total, 36 AS remaining FROM {{standings}} CROSS JOIN m GROUP BY user_rank, user_total""")
def league_overview(s: Star) -> DataFrame:
    return briefs.overview(s.standings, USER, 36).withColumns(r4("median", "mean"))


@query(f"""SELECT DISTINCT element FROM {{picks}} WHERE gw = {GW} AND entry = {USER} AND element NOT IN (SELECT element FROM {{picks}} JOIN {{standings}} USING (entry) WHERE gw = {GW} AND rank <= 10)""")
def squad_orphans(s: Star) -> DataFrame:
    return briefs.orphans(s.standings, s.picks, USER, GW)
