"""Registered queries: each operator on the star schema, with the SQL that DuckDB checks it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import scoring
from ..functions.names import player_key
from ..operators import backtest, bonus, league, matches, minutes, monitor, rates, reconcile, state, strength
from .star import GW, USER, by_fixture, oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Star:
    """The views of one folder, each read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def heads(self) -> DataFrame:
        """Orders, dealt as lines are by fixture."""
        return by_fixture(self.spark, self.sf_dir, "orders", "o_orderkey")

    @property
    def parts(self) -> DataFrame:
        """Parts, dealt by key in as many tasks: a file of them may be a single split."""
        return by_fixture(self.spark, self.sf_dir, "part", "p_partkey")

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[Star], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Star(spark, sf_dir))
        if sql:
            ORACLES[key] = oracle(sql)
        return f

    return add


def r4(*names: str) -> dict[str, Column]:
    """These columns to four places, as the oracle rounds them."""
    return {n: F.round(n, 4) for n in names}


WEIGHTS = {
    "uniform": "1.0", "rank": "greatest(0.0, CAST(n - rank + 1 AS DOUBLE) / n)", "gap": "greatest(0.0, CAST(total - mine AS DOUBLE))",
    "contention": "exp(-CAST(lead - total AS DOUBLE) / greatest(1.0, coalesce(sd, 0.0)))",
}
WEIGHT_CTE = f"""raw AS (SELECT entry, CAST(%s AS DOUBLE) AS w FROM (SELECT *, count(*) OVER () AS n, max(total) OVER () AS lead, stddev_samp(total) OVER () AS sd,
    (SELECT total FROM {{standings}} WHERE entry = {USER}) AS mine FROM {{standings}} WHERE entry <> {USER}) AS x),
    weights AS (SELECT entry, CASE WHEN sum(w) OVER () > 0 THEN w / sum(w) OVER () ELSE 1.0 / count(*) OVER () END AS weight FROM raw)"""
CONTENTION = WEIGHT_CTE % WEIGHTS["contention"]


def _weights(s: Star) -> DataFrame:
    return league.threat_weights(s.standings, USER)


for _scheme, _raw in WEIGHTS.items():
    query(f"WITH {WEIGHT_CTE % _raw} SELECT entry, round(weight, 8) AS weight FROM weights", f"threat_weights_{_scheme}")(
        lambda s, scheme=_scheme: league.threat_weights(s.standings, USER, scheme).withColumn("weight", F.round("weight", 8))
    )


@query(f"""WITH {CONTENTION}, own AS (SELECT element, count(*) AS owners, sum(CASE WHEN multiplier >= 1 THEN 1 ELSE 0 END) AS st, sum(CASE WHEN is_captain THEN 1 ELSE 0 END) AS cap,
    sum(multiplier) AS m, sum(coalesce(weight, 0)) AS wo, sum(coalesce(weight, 0) * CASE WHEN is_captain THEN 2 ELSE 1 END) AS we
    FROM {{picks}} LEFT JOIN weights USING (entry) WHERE gw = {GW} GROUP BY element), n AS (SELECT count(*) AS n FROM {{standings}})
    SELECT element, owners, round(100.0 * owners / n, 4) AS owned_pct, round(100.0 * st / n, 4) AS start_pct, round(100.0 * cap / n, 4) AS captain_pct,
    round(100.0 * (owners + cap) / n, 4) AS eo_pct, round(100.0 * m / n, 4) AS mult_eo_pct, round(100.0 * wo, 4) AS w_owned_pct, round(100.0 * we, 4) AS w_eo_pct FROM own, n""")
def effective_ownership(s: Star) -> DataFrame:
    out = league.ownership_table(s.standings, s.picks, _weights(s), GW, USER).drop("user_owns", "user_mult")
    return out.withColumns(r4("owned_pct", "start_pct", "captain_pct", "eo_pct", "mult_eo_pct", "w_owned_pct", "w_eo_pct"))


SETTLED = """settled AS (SELECT p.entry, p.gw, p.element, p.is_captain, p.is_vice_captain, p.multiplier, coalesce(l.minutes, 0) AS minutes,
    CASE WHEN p.element = a.element_out THEN 0 WHEN p.element = a.element_in THEN 1 ELSE p.multiplier END AS subbed FROM {picks} AS p LEFT JOIN {live} AS l ON p.gw = l.gw AND p.element = l.element
    LEFT JOIN {auto_subs} AS a ON p.entry = a.entry AND p.gw = a.gw),
    arm AS (SELECT entry, gw, max(CASE WHEN is_captain THEN multiplier END) AS cm, max(CASE WHEN is_captain AND minutes = 0 THEN 1 WHEN is_captain THEN 0 END) AS cout,
    max(CASE WHEN is_vice_captain AND minutes > 0 THEN 1 WHEN is_vice_captain THEN 0 END) AS vin FROM settled GROUP BY entry, gw),
    mult AS (SELECT entry, gw, element, CASE WHEN cout = 1 AND vin = 1 AND is_vice_captain THEN cm WHEN cout = 1 AND vin = 1 AND is_captain AND subbed > 1 THEN 1 ELSE subbed END AS multiplier
    FROM settled JOIN arm USING (entry, gw))"""


def _settled(s: Star) -> DataFrame:
    """Settled picks carry their points, and have the gameweeks that live has: live is not derived for them."""
    return league.effective_multipliers(s.settled_picks, s.auto_subs, None, s.settled_picks.select("gw").distinct())


@query(f"WITH {SETTLED} SELECT entry, m.gw, CAST(sum(multiplier * coalesce(points, 0)) AS BIGINT) AS score FROM mult AS m LEFT JOIN {{live}} AS l ON m.gw = l.gw AND m.element = l.element GROUP BY entry, m.gw")
def gameweek_scores(s: Star) -> DataFrame:
    return league.gameweek_scores(_settled(s)).withColumn("score", F.col("score").cast("bigint"))


@query(f"""WITH {SETTLED}, sc AS (SELECT entry, sum(multiplier * coalesce(points, 0)) AS score FROM mult AS m LEFT JOIN {{live}} AS l ON m.gw = l.gw AND m.element = l.element GROUP BY entry),
    h AS (SELECT entry, sum(hits) AS hits FROM {{manager_gw}} GROUP BY entry)
    SELECT s.entry, total, CAST(coalesce(score, 0) - coalesce(hits, 0) AS BIGINT) AS calc, CAST(coalesce(score, 0) - coalesce(hits, 0) - total AS BIGINT) AS delta
    FROM {{standings}} AS s LEFT JOIN sc ON s.entry = sc.entry LEFT JOIN h ON s.entry = h.entry""")
def verify_totals(s: Star) -> DataFrame:
    return league.verify_totals(s.standings, league.gameweek_scores(_settled(s)), s.manager_gw)


SWINGS = f"""{CONTENTION}, {SETTLED}, g AS (SELECT m.element, m.gw, sum(CASE WHEN m.entry = {USER} THEN multiplier ELSE 0 END) AS mine, sum(multiplier) AS field,
    sum(multiplier * coalesce(weight, 0)) AS wf FROM mult AS m LEFT JOIN weights AS w ON m.entry = w.entry GROUP BY m.element, m.gw),
    swings AS (SELECT g.element, sum((mine - CAST(field AS DOUBLE) / n) * coalesce(points, 0)) AS swing, sum((mine - wf) * coalesce(points, 0)) AS w_swing,
    CAST(sum(mine * coalesce(points, 0)) AS BIGINT) AS user_points, max(mine > 0) AS ever_used
    FROM g CROSS JOIN (SELECT count(*) AS n FROM {{standings}}) AS nn LEFT JOIN {{live}} AS l ON g.gw = l.gw AND g.element = l.element GROUP BY g.element)"""


def _swings(s: Star) -> DataFrame:
    return league.player_swings(_settled(s), None, _weights(s), s.standings, USER)


@query(f"WITH {SWINGS} SELECT element, round(swing, 4) AS swing, round(w_swing, 4) AS w_swing, user_points FROM swings")
def player_swings(s: Star) -> DataFrame:
    return _swings(s).drop("ever_used").withColumns(r4("swing", "w_swing"))


@query(f"""WITH {SWINGS}, o AS (SELECT element, 100.0 * count(*) / (SELECT count(*) FROM {{standings}}) AS owned_pct, max(entry = {USER}) AS user_owns FROM {{picks}} WHERE gw = {GW} GROUP BY element),
    k AS (SELECT swing, CASE WHEN coalesce(user_owns, false) AND coalesce(owned_pct, 0) <= 0.5 THEN 'differential' WHEN NOT coalesce(user_owns, false) AND coalesce(owned_pct, 0) >= 0.2 THEN 'liability'
    WHEN coalesce(user_owns, false) OR ever_used THEN 'shared' END AS kind FROM swings LEFT JOIN o USING (element))
    SELECT kind, count(*) AS elements, round(sum(swing), 4) AS swing FROM k GROUP BY kind""")
def user_position(s: Star) -> DataFrame:
    owned = league.ownership_table(s.standings, s.picks, _weights(s), GW, USER)
    return league.user_position(_swings(s), owned, 0.5, 0.2).groupBy("kind").agg(F.count("*").alias("elements"), F.round(F.sum("swing"), 4).alias("swing"))


@query(f"""SELECT p.element, count(*) AS captains, round(100.0 * count(*) / (SELECT count(*) FROM {{standings}}), 4) AS pct, coalesce(max(l.points), 0) AS points
    FROM {{picks}} AS p LEFT JOIN {{live}} AS l ON p.gw = l.gw AND p.element = l.element WHERE p.gw = {GW} AND is_captain GROUP BY p.element""")
def captaincy(s: Star) -> DataFrame:
    return league.captaincy_table(s.standings, s.picks, s.live, GW).withColumns(r4("pct"))


@query(f"""SELECT element, count(*) AS group_owners, (SELECT count(*) FROM {{standings}} WHERE rank <= 50) AS group_size FROM {{picks}} JOIN {{standings}} USING (entry)
    WHERE gw = {GW} AND rank <= 50 AND element NOT IN (SELECT element FROM {{picks}} WHERE gw = {GW} AND entry = {USER}) GROUP BY element""")
def transfer_targets(s: Star) -> DataFrame:
    return league.transfer_targets(s.standings, s.picks, USER, GW, 50)


@query(f"""WITH m AS (SELECT total AS mine, rank AS my_rank FROM {{standings}} WHERE entry = {USER}), f AS (SELECT CAST(v AS INT) AS place, l AS label FROM (VALUES (1, '1st'), (5, 'top-5'), (10, 'top-10')) AS t(v, l)
    UNION ALL SELECT my_rank - 1, 'one place up' FROM m WHERE my_rank > 1),
    a AS (SELECT label, s.rank AS place, CAST(total AS DOUBLE) AS total, CAST(total - mine AS DOUBLE) AS gap, CAST(total - mine AS DOUBLE) / 36 AS per_gw FROM f JOIN {{standings}} AS s ON s.rank = f.place CROSS JOIN m
    UNION ALL SELECT 'median', NULL, floor(quantile_cont(total, 0.5)), floor(quantile_cont(total, 0.5)) - max(mine), (floor(quantile_cont(total, 0.5)) - max(mine)) / 36 FROM {{standings}} CROSS JOIN m
    UNION ALL SELECT 'league average', NULL, round_even(avg(total), 0), round_even(avg(total) - max(mine), 0), (avg(total) - max(mine)) / 36 FROM {{standings}} CROSS JOIN m)
    SELECT label, place, total, gap, round(per_gw, 4) AS per_gw FROM a""")
def gap_targets(s: Star) -> DataFrame:
    return league.gap_targets(s.standings, USER, 36).withColumns(r4("per_gw"))


@query(f"""WITH u AS (SELECT element, multiplier AS mine FROM {{picks}} WHERE gw = {GW} AND entry = {USER}), z AS (SELECT count(*) AS squad, sum(mine) AS mass, count(*) FILTER (WHERE mine >= 1) AS xi FROM u),
    j AS (SELECT entry, count(*) AS ss, count(*) FILTER (WHERE mine >= 1 AND multiplier >= 1) AS sx, sum(least(mine, multiplier)) AS dead FROM {{picks}} JOIN u USING (element) WHERE gw = {GW} AND entry <> {USER} GROUP BY entry)
    SELECT s.entry, rank, total, coalesce(ss, 0) AS shared_squad, coalesce(sx, 0) AS shared_xi, round(100.0 * coalesce(ss, 0) / greatest(1, squad), 4) AS shared_pct,
    round(coalesce(100.0 * coalesce(dead, 0) / nullif(mass, 0), 0), 4) AS dead_weight_pct, xi - coalesce(sx, 0) AS live_edge FROM {{standings}} AS s CROSS JOIN z LEFT JOIN j ON s.entry = j.entry WHERE s.entry <> {USER}""")
def overlap(s: Star) -> DataFrame:
    return league.squad_overlap(s.standings, s.picks, USER, GW).withColumns(r4("shared_pct", "dead_weight_pct"))


@query("""WITH v AS (SELECT var_pop(points) AS v FROM {manager_gw} GROUP BY gw HAVING count(*) > 1)
    SELECT round(sqrt(avg(v)), 6) AS sd_gw_score, round(sqrt(avg(v)) * sqrt(2.0), 6) AS sd_gw_diff, round(sqrt(avg(v)) * sqrt(2.0) * 6, 6) AS sd_rest_diff FROM v""")
def noise_scale(s: Star) -> DataFrame:
    return league.noise_scale(s.manager_gw, 36).select(*[F.round(c, 6).alias(c) for c in ("sd_gw_score", "sd_gw_diff", "sd_rest_diff")])


@query(f"""WITH m AS (SELECT total AS mine FROM {{standings}} WHERE entry = {USER})
    SELECT round(mine / 7, 4) AS user_ppg, round(avg(total) / 7, 4) AS league_ppg, round(max(total) / 7, 4) AS leader_ppg, round(max(total) / 7 + (max(total) - mine) / 36, 4) AS required_ppg,
    round((max(total) - mine) / 36, 4) AS required_edge FROM {{standings}} CROSS JOIN m GROUP BY mine""")
def catchup_plan(s: Star) -> DataFrame:
    out = league.catchup_plan(s.standings, USER, 7)
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


PROFILE = f"""o AS (SELECT element, count(*) AS owners FROM {{picks}} WHERE gw = {GW} GROUP BY element), n AS (SELECT count(*) AS n FROM {{standings}}),
    t AS (SELECT entry, avg(100.0 * (owners - 1) / greatest(1, n - 1)) AS s FROM {{picks}} JOIN o USING (element) CROSS JOIN n WHERE gw = {GW} GROUP BY entry),
    sc AS (SELECT st.entry, coalesce(s, 0.0) AS template_score FROM {{standings}} AS st LEFT JOIN t ON st.entry = t.entry),
    z AS (SELECT entry, template_score, (template_score - avg(template_score) OVER ()) / CASE WHEN stddev_pop(template_score) OVER () > 0 THEN stddev_pop(template_score) OVER () ELSE 1.0 END AS template_z FROM sc)"""


@query(f"""WITH {PROFILE} SELECT entry, round(template_score, 4) AS template_score, round(template_z, 4) AS template_z,
    CASE WHEN template_z >= 0.75 THEN 'template' WHEN template_z <= -0.75 THEN 'differential' ELSE 'balanced' END AS style FROM z""")
def template_scores(s: Star) -> DataFrame:
    return league.template_scores(s.standings, s.picks, GW).withColumns(r4("template_score", "template_z"))


@query(f"WITH {PROFILE} SELECT CASE WHEN template_z >= 0.75 THEN 'template' WHEN template_z <= -0.75 THEN 'differential' ELSE 'balanced' END AS style, count(*) AS managers FROM z GROUP BY 1")
def style_summary(s: Star) -> DataFrame:
    return league.style_summary(league.template_scores(s.standings, s.picks, GW))


# ---------------------------------------------------------------- scoring


@query("""WITH r AS (SELECT fixture, greatest(0, 4 - rank() OVER (PARTITION BY fixture ORDER BY q DESC)) AS bonus FROM {line}) SELECT CAST(bonus AS INT) AS bonus, count(*) AS players FROM r GROUP BY 1""")
def bonus_allocation(s: Star) -> DataFrame:
    return bonus.allocate_bonus(s.line, bps="q").groupBy("bonus").agg(F.count("*").alias("players"))


SCORED = """scored AS (SELECT *, CASE WHEN minutes > 0 THEN 1 ELSE 0 END AS plays, CASE position WHEN 1 THEN 10 WHEN 2 THEN 6 WHEN 3 THEN 5 ELSE 4 END AS g, CASE position WHEN 1 THEN 4 WHEN 2 THEN 4 WHEN 3 THEN 1 ELSE 0 END AS cs,
    clearances_blocks_interceptions + tackles + CASE WHEN position = 2 THEN 0 ELSE recoveries END AS dc FROM {stats})"""
#: The points of a row's lines in plain SQL.
WORTH = {
    "minutes": "plays * CASE WHEN minutes >= 60 THEN 2 ELSE 1 END", "goals_scored": "plays * goals_scored * g", "assists": "plays * assists * 3", "clean_sheets": "plays * CASE WHEN minutes >= 60 AND goals_conceded = 0 THEN cs ELSE 0 END",
    "goals_conceded": "-plays * CASE WHEN position <= 2 THEN goals_conceded // 2 ELSE 0 END", "saves": "plays * (saves // 3)", "penalties_saved": "plays * penalties_saved * 5", "penalties_missed": "-plays * penalties_missed * 2",
    "own_goals": "-plays * own_goals * 2", "yellow_cards": "-plays * yellow_cards", "red_cards": "-plays * red_cards * 3",
    "defensive_contribution": "plays * CASE WHEN position = 2 AND dc >= 10 OR position > 2 AND dc >= 12 THEN 2 ELSE 0 END", "bonus": "plays * bonus",
}
LINES = SCORED + ", l AS (" + " UNION ALL ".join(f"SELECT fixture, '{name}' AS identifier, {worth} AS points FROM scored" for name, worth in WORTH.items()) + ")"


@query(f"WITH {LINES} SELECT fixture, CAST(sum(points) AS BIGINT) AS points FROM l GROUP BY fixture")
def points_score(s: Star) -> DataFrame:
    return scoring.gameweek_points(s.stats, ["fixture"])


@query(f"WITH {LINES} SELECT identifier, count(*) AS lines, CAST(sum(points) AS BIGINT) AS points FROM l WHERE points <> 0 GROUP BY identifier")
def points_lines(s: Star) -> DataFrame:
    return scoring.line_totals(s.stats, [])


@query("""SELECT fixture, CAST(sum(CASE WHEN minutes > 0 THEN CASE WHEN minutes >= 60 THEN 6 ELSE 3 END + goals_scored * CASE position WHEN 3 THEN 18 WHEN 4 THEN 24 ELSE 12 END + assists * 9
    + CASE WHEN position <= 2 THEN -4 * goals_conceded ELSE 0 END + saves * 2 + penalties_saved * 7 + tackles * 2 + clearances_blocks_interceptions // 3 + recoveries // 3 - penalties_missed * 6 - yellow_cards * 3
    - red_cards * 9 - own_goals * 6 ELSE 0 END) AS BIGINT) AS bps FROM {stats} GROUP BY fixture""")
def bps_score(s: Star) -> DataFrame:
    rows = s.stats
    return rows.withColumn("b", scoring.bps(scoring.stat_columns(rows), F.col("position"))).groupBy("fixture").agg(F.sum("b").alias("bps"))


PUBLISHED = f"""{LINES}, published AS (SELECT fixture, identifier, points, CASE WHEN fixture % 11 = 0 AND identifier = 'minutes' THEN 1 ELSE 0 END AS points_modification FROM l WHERE points <> 0)"""


@query(f"""WITH {PUBLISHED}, b AS (SELECT fixture, identifier, sum(points) AS mine, sum(points + points_modification) AS theirs FROM published GROUP BY 1, 2)
    SELECT fixture, CAST(sum(mine) AS BIGINT) AS engine, CAST(sum(theirs) AS BIGINT) AS published, bool_and(mine = theirs) AS agrees FROM b GROUP BY fixture""")
def points_reconcile(s: Star) -> DataFrame:
    """Against lines that the rules' plain SQL publishes, one point modified for each playing row of every eleventh fixture."""
    worth = ", ".join(f"'{name}', CAST({sql.replace('//', 'div')} AS INT)" for name, sql in WORTH.items())
    lines = s.spark.sql(f"WITH {SCORED} SELECT fixture, stack({len(WORTH)}, {worth}) AS (identifier, points) FROM scored", stats=s.stats)
    late = F.when((F.col("fixture") % 11 == 0) & (F.col("identifier") == "minutes"), 1).otherwise(0)
    published = lines.where("points <> 0").withColumn("points_modification", late)
    return reconcile.reconcile_points(s.stats, published, ["fixture"])


# ---------------------------------------------------------------- history and model


@query("""SELECT season, count(*) AS rows, count(DISTINCT element) AS players, min(gw) AS gw_min, max(gw) AS gw_max, min(kickoff_time) AS first_kickoff, max(kickoff_time) AS last_kickoff FROM {line} GROUP BY season""")
def season_summary(s: Star) -> DataFrame:
    return matches.season_summary(s.line)


MATCHES = """side AS (SELECT season, fixture, was_home, team, count(*) AS c, min(kickoff_time) AS date, min(team_h_score) AS hg, min(team_a_score) AS ag FROM {player_rows} GROUP BY 1, 2, 3, 4),
    pick AS (SELECT *, row_number() OVER (PARTITION BY season, fixture, was_home ORDER BY c DESC, team) AS r FROM side),
    m AS (SELECT h.season, h.fixture, h.date, h.team AS home_team, a.team AS away_team, CAST(h.hg AS INT) AS home_goals, CAST(h.ag AS INT) AS away_goals FROM pick AS h JOIN pick AS a ON h.season = a.season AND h.fixture = a.fixture
    WHERE h.was_home AND NOT a.was_home AND h.r = 1 AND a.r = 1)"""


def _matches(s: Star) -> DataFrame:
    return matches.match_table(s.player_rows)


@query(f"WITH {MATCHES} SELECT season, date, home_team, away_team, home_goals, away_goals, count(*) AS n FROM m GROUP BY ALL")
def match_table(s: Star) -> DataFrame:
    out = _matches(s)
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


@query(f"""WITH {MATCHES}, w AS (SELECT home_team AS team, date FROM m UNION ALL SELECT away_team, date FROM m)
    SELECT team, round(sum(power(0.5, greatest(0.0, (epoch_us(TIMESTAMP '2000-01-01') - epoch_us(date)) / 86400000000.0) / 250.0)), 4) AS effective_n FROM w GROUP BY team""")
def effective_n(s: Star) -> DataFrame:
    return matches.effective_sample_sizes(_matches(s), F.lit("2000-01-01").cast("timestamp"), 250.0).withColumns(r4("effective_n"))


PROMOTED = """tot AS (SELECT season, team, count(*) AS games, sum(goals_for) AS gf, sum(goals_against) AS ga FROM {club_rows} GROUP BY 1, 2), sn AS (SELECT DISTINCT season FROM {club_rows}),
    ord AS (SELECT season, lag(season) OVER (ORDER BY season) AS prev FROM sn), p AS (SELECT t.* FROM tot AS t JOIN ord USING (season) WHERE prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tot AS b WHERE b.season = ord.prev AND b.team = t.team))"""


@query(f"WITH {PROMOTED} SELECT season, team, games, CAST(gf AS BIGINT) AS goals_for, CAST(ga AS BIGINT) AS goals_against FROM p")
def promotions(s: Star) -> DataFrame:
    return matches.find_promotions(s.club_rows)


@query(f"""WITH {PROMOTED}, av AS (SELECT season, avg(goals_for) AS la FROM {{club_rows}} GROUP BY season)
    SELECT round(coalesce(sum(games * ln(greatest(CAST(gf AS DOUBLE) / games, 0.15) / la)) / nullif(sum(games), 0), 0), 6) AS attack, round(coalesce(sum(games * ln(greatest(CAST(ga AS DOUBLE) / games, 0.15) / la)) / nullif(sum(games), 0), 0), 6) AS concede,
    count(*) AS promotions FROM p JOIN av USING (season)""")
def promoted_prior(s: Star) -> DataFrame:
    return matches.promoted_prior(s.club_rows).withColumns({"attack": F.round("attack", 6), "concede": F.round("concede", 6)})


@query(f"WITH {MATCHES} SELECT home_team, away_team, count(*) AS meetings FROM m GROUP BY 1, 2 HAVING count(*) >= 6")
def meetings(s: Star) -> DataFrame:
    return matches.meetings(_matches(s))


@query("""WITH s AS (SELECT season, element, min(position) AS position, count(*) FILTER (WHERE gw <= 6) AS ne, count(*) FILTER (WHERE gw > 6) AS nl, count(*) FILTER (WHERE gw <= 6 AND minutes > 0) AS ep, count(*) FILTER (WHERE gw <= 6 AND starts > 0) AS es,
    count(*) FILTER (WHERE gw > 6 AND minutes > 0) AS lp, count(*) FILTER (WHERE gw > 6 AND starts > 0) AS ls, coalesce(sum(minutes) FILTER (WHERE gw > 6 AND starts > 0), 0) AS ms,
    count(*) FILTER (WHERE gw > 6 AND minutes > 0 AND starts = 0) AS lb, coalesce(sum(minutes) FILTER (WHERE gw > 6 AND minutes > 0 AND starts = 0), 0) AS mb FROM {history} GROUP BY 1, 2)
    SELECT CAST(position AS INT) AS position, CASE WHEN es > 0 THEN 'started' WHEN ep > 0 THEN 'subbed' ELSE 'unused' END AS bucket, round(CAST(sum(lp) AS DOUBLE) / sum(nl), 4) AS p_play, round(CAST(sum(ls) AS DOUBLE) / sum(nl), 4) AS p_start,
    round(coalesce(CAST(sum(ms) AS DOUBLE) / nullif(sum(ls), 0), 80.0), 4) AS minutes_started, round(coalesce(CAST(sum(mb) AS DOUBLE) / nullif(sum(lb), 0), 22.0), 4) AS minutes_sub, count(*) AS n_player_seasons FROM s WHERE ne > 0 AND nl > 0 GROUP BY 1, 2""")
def position_priors(s: Star) -> DataFrame:
    return minutes.position_priors(s.history, 6).withColumns(r4("p_play", "p_start", "minutes_started", "minutes_sub"))


@query("""SELECT concat('player ', CAST(element % 700 AS VARCHAR(9))) AS name_key, count(*) AS prior_games, round(avg(CASE WHEN minutes > 0 THEN 1.0 ELSE 0.0 END), 4) AS p_play_obs, round(avg(CASE WHEN starts > 0 THEN 1.0 ELSE 0.0 END), 4) AS p_start_obs
    FROM {history} WHERE season = 2000 GROUP BY 1 HAVING count(*) >= 5""")
def player_priors(s: Star) -> DataFrame:
    key = player_key(F.concat(F.lit("Player-"), (F.col("element") % 700).cast("string")))
    return minutes.player_priors(s.history.where("season = 2000"), key).withColumns(r4("p_play_obs", "p_start_obs"))


EDGES = "edges AS (SELECT position, quantile_cont(value, 0.0) AS e0, quantile_cont(value, 1.0 / 3) AS e1, quantile_cont(value, 2.0 / 3) AS e2, quantile_cont(value, 1.0) AS e3 FROM {history} WHERE minutes > 0 GROUP BY position)"


@query(f"WITH {EDGES} SELECT CAST(position AS BIGINT) AS position, round(e0, 4) AS e0, round(e1, 4) AS e1, round(e2, 4) AS e2, round(e3, 4) AS e3 FROM edges")
def price_edges(s: Star) -> DataFrame:
    return rates.price_edges(s.history).select(F.col("position").cast("bigint").alias("position"), *[F.round(F.col("edges")[i], 4).alias(f"e{i}") for i in range(4)])


PRIORS = f"""{EDGES}, long AS (SELECT season, element, position, value, minutes, unnest(['goals_scored', 'assists', 'clearances_blocks_interceptions', 'tackles', 'recoveries', 'saves']) AS stat,
    unnest([goals_scored, assists, clearances_blocks_interceptions, tackles, recoveries, saves]) AS ev FROM {{history}}),
    ps AS (SELECT season, element, position, stat, sum(ev) AS ev, sum(minutes) AS minutes, avg(value) AS price FROM long WHERE (position = 1) = (stat = 'saves') GROUP BY 1, 2, 3, 4 HAVING sum(minutes) > 0),
    tt AS (SELECT ps.*, minutes / 90.0 AS x, CASE WHEN price >= e2 THEN 2 WHEN price >= e1 THEN 1 ELSE 0 END AS tier FROM ps JOIN edges USING (position)),
    ag AS (SELECT position, tier, stat, greatest(sum(ev) / sum(x), 1e-4) AS mu, count(*) FILTER (WHERE minutes >= 180) AS n, sum(x) FILTER (WHERE minutes >= 180) AS w, sum(x * (ev / x)) FILTER (WHERE minutes >= 180) AS wr,
    sum(x * (ev / x) * (ev / x)) FILTER (WHERE minutes >= 180) AS wrr, count(DISTINCT element) AS n_players FROM tt GROUP BY 1, 2, 3),
    priors AS (SELECT position, tier, stat, mu, CASE WHEN n < 8 THEN 6.0 ELSE greatest(2.0, least(30.0, mu / greatest(wrr / w - (wr / w) * (wr / w) - mu * n / w, mu * mu / 50.0))) END AS n0, n_players FROM ag)"""


@query(f"WITH {PRIORS} SELECT CAST(position AS BIGINT) AS position, tier, stat, round(mu, 6) AS mu, round(n0, 4) AS n0, n_players FROM priors")
def rate_priors(s: Star) -> DataFrame:
    out = rates.rate_priors(rates.player_seasons(s.history), rates.price_edges(s.history))
    return out.withColumns({"position": F.col("position").cast("bigint"), "mu": F.round("mu", 6), "n0": F.round("n0", 4)})


@query(f"""WITH {PRIORS}, pl AS (SELECT element AS player_id, position, max(value) AS price, sum(minutes) AS minutes, sum(goals_scored) AS goals_scored, sum(saves) AS saves FROM {{history}} WHERE season = 2000 GROUP BY 1, 2),
    lg AS (SELECT pl.*, unnest(['goals_scored', 'saves']) AS stat, unnest([goals_scored, saves]) AS ev FROM pl), k AS (SELECT lg.*, CASE WHEN price >= e2 THEN 2 WHEN price >= e1 THEN 1 ELSE 0 END AS tier FROM lg JOIN edges USING (position)),
    f AS (SELECT player_id, k.stat, CASE WHEN (k.position = 1) = (k.stat = 'saves') THEN (n0 * mu + ev) / (n0 + minutes / 90.0) ELSE 0.0 END AS rate FROM k LEFT JOIN priors AS p ON k.position = p.position AND k.tier = p.tier AND k.stat = p.stat)
    SELECT player_id, round(max(rate) FILTER (WHERE stat = 'goals_scored'), 6) AS goals_scored_p90, round(max(rate) FILTER (WHERE stat = 'saves'), 6) AS saves_p90 FROM f GROUP BY player_id""")
def posterior_rates(s: Star) -> DataFrame:
    edges, stats = rates.price_edges(s.history), ("goals_scored", "saves")
    players = s.history.where("season = 2000").groupBy(F.col("element").alias("player_id"), "position").agg(
        F.max("value").alias("price"), F.sum("minutes").alias("minutes"), *[F.sum(c).alias(c) for c in ("goals_scored", "assists", "saves")]
    )
    priors = rates.rate_priors(rates.player_seasons(s.history), edges)
    return rates.posterior_rates(players, priors, edges, stats=stats).select("player_id", *[F.round(f"{c}_p90", 6).alias(f"{c}_p90") for c in stats])


@query("""SELECT position, round(sum(yellow_cards) / (sum(minutes) / 90.0), 6) AS yellow_p90, round(sum(red_cards) / (sum(minutes) / 90.0), 6) AS red_p90, round(sum(own_goals) / (sum(minutes) / 90.0), 6) AS own_goal_p90
    FROM {stats} WHERE minutes > 0 GROUP BY position""")
def card_rates(s: Star) -> DataFrame:
    return rates.card_rates(s.stats).select("position", *[F.round(c, 6).alias(c) for c in ("yellow_p90", "red_p90", "own_goal_p90")])


@query("SELECT round(greatest(0.3, least(0.95, CAST(sum(assists) AS DOUBLE) / sum(goals_scored))), 6) AS fraction FROM {stats}")
def assist_fraction(s: Star) -> DataFrame:
    return rates.assisted_fraction(s.stats).withColumn("fraction", F.round("fraction", 6))


@query("""WITH l AS (SELECT c_custkey AS id, concat('name ', CAST(c_custkey % 900 AS VARCHAR(9))) AS name_key, concat('t', CAST(c_custkey % 7 AS VARCHAR(9))) AS team_key FROM customer),
    r AS (SELECT p_partkey AS row_id, concat('name ', CAST(p_partkey % 1100 AS VARCHAR(9))) AS name_key, concat('t', CAST(p_partkey % 5 AS VARCHAR(9))) AS team_key FROM part),
    b AS (SELECT id, row_id, 0 AS pass FROM l JOIN r USING (name_key, team_key)), rest AS (SELECT * FROM l WHERE id NOT IN (SELECT id FROM b)),
    e AS (SELECT id, row_id, 1 AS pass FROM rest JOIN r USING (name_key) WHERE name_key IN (SELECT name_key FROM rest GROUP BY 1 HAVING count(*) = 1) AND name_key IN (SELECT name_key FROM r GROUP BY 1 HAVING count(*) = 1)),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pass, row_id) AS n FROM (SELECT * FROM b UNION ALL SELECT * FROM e) AS u) SELECT id, row_id FROM k WHERE n = 1""")
def name_match(s: Star) -> DataFrame:
    text = lambda prefix, c, n: F.concat(F.lit(prefix), (F.col(c) % n).cast("string"))
    left = s.customer.select(F.col("c_custkey").alias("id"), text("name ", "c_custkey", 900).alias("name_key"), text("t", "c_custkey", 7).alias("team_key"))
    right = s.part.select(F.col("p_partkey").alias("row_id"), text("name ", "p_partkey", 1100).alias("name_key"), text("t", "p_partkey", 5).alias("team_key"))
    return rates.name_match(left, right)


SHARES = f"""WITH t AS (SELECT DISTINCT home_team, away_team FROM (WITH {MATCHES} SELECT * FROM m) AS mm),
    f AS (SELECT home_team, away_team, exp(0.45 + length(home_team) * 0.01 - length(away_team) * 0.02) AS lh, exp(0.2 + length(away_team) * 0.01 - length(home_team) * 0.02) AS la FROM t),
    c AS (SELECT f.*, h, a, exp(h * ln(lh) - lh - ln(CAST(factorial(h) AS DOUBLE))) * exp(a * ln(la) - la - ln(CAST(factorial(a) AS DOUBLE))) * CASE WHEN h = 0 AND a = 0 THEN 1 - lh * la * (-0.1) WHEN h = 0 AND a = 1 THEN 1 + lh * (-0.1)
    WHEN h = 1 AND a = 0 THEN 1 + la * (-0.1) WHEN h = 1 AND a = 1 THEN 1 + 0.1 ELSE 1 END AS p FROM f, (SELECT CAST(range AS INT) AS h FROM range(11)) AS hh, (SELECT CAST(range AS INT) AS a FROM range(11)) AS aa)"""


@query(f"{SHARES} SELECT home_team, away_team, h, a, round(greatest(p, 0) / sum(greatest(p, 0)) OVER (PARTITION BY home_team, away_team), 8) AS p FROM c")
def score_matrix(s: Star) -> DataFrame:
    teams = _matches(s).select("home_team", "away_team").distinct()
    # Effects that depend on the name alone stand in for fitted ones.
    ratings = teams.select(F.explode(F.array("home_team", "away_team")).alias("team")).distinct().select("team", (F.length("team") * 0.01).alias("attack"), (F.length("team") * -0.02).alias("concede"))
    rated = strength.with_rates(teams, ratings, 0.25, 0.2)
    return strength.score_matrix(rated, -0.1, ["home_team", "away_team"]).select("home_team", "away_team", "h", "a", F.round("p", 8).alias("p"))


QUANTILES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


@query("""WITH a AS (SELECT gw, minutes AS actual, quantile_cont(minutes, 0.1) OVER (PARTITION BY gw) AS p10, quantile_cont(minutes, 0.25) OVER (PARTITION BY gw) AS p25, quantile_cont(minutes, 0.5) OVER (PARTITION BY gw) AS p50,
    quantile_cont(minutes, 0.75) OVER (PARTITION BY gw) AS p75, quantile_cont(minutes, 0.9) OVER (PARTITION BY gw) AS p90 FROM {history})
    SELECT 'p10' AS quantile, 0.1::DOUBLE AS nominal, round(avg(CASE WHEN actual <= p10 THEN 1.0 ELSE 0.0 END), 4) AS coverage FROM a UNION ALL SELECT 'p25', 0.25, round(avg(CASE WHEN actual <= p25 THEN 1.0 ELSE 0.0 END), 4) FROM a
    UNION ALL SELECT 'p50', 0.5, round(avg(CASE WHEN actual <= p50 THEN 1.0 ELSE 0.0 END), 4) FROM a UNION ALL SELECT 'p75', 0.75, round(avg(CASE WHEN actual <= p75 THEN 1.0 ELSE 0.0 END), 4) FROM a
    UNION ALL SELECT 'p90', 0.9, round(avg(CASE WHEN actual <= p90 THEN 1.0 ELSE 0.0 END), 4) FROM a UNION ALL SELECT 'p10-p90', 0.8, round(avg(CASE WHEN actual BETWEEN p10 AND p90 THEN 1.0 ELSE 0.0 END), 4) FROM a
    UNION ALL SELECT 'p25-p75', 0.5, round(avg(CASE WHEN actual BETWEEN p25 AND p75 THEN 1.0 ELSE 0.0 END), 4) FROM a""")
def calibration(s: Star) -> DataFrame:
    rows = s.history.select("gw", F.col("minutes").cast("double").alias("actual"))
    q = rows.groupBy("gw").agg(F.percentile("actual", F.array(*map(F.lit, QUANTILES.values()))).alias("q"))
    both = rows.join(F.broadcast(q), "gw").select("actual", *[F.col("q")[i].alias(n) for i, n in enumerate(QUANTILES)])
    return backtest.calibration(both).withColumns(r4("coverage"))


@query("SELECT season, round(sqrt(avg((minutes - 45.0) * (minutes - 45.0))), 4) AS rmse, round(avg(abs(minutes - 45.0)), 4) AS mae, count(*) AS n FROM {history} GROUP BY season")
def error_metrics(s: Star) -> DataFrame:
    rows = s.history.select("season", F.lit(45.0).alias("guess"), F.col("minutes").alias("actual"))
    return backtest.errors(rows, "guess", keys=["season"]).withColumns(r4("rmse", "mae"))


@query("""WITH t AS (SELECT DISTINCT season, gw FROM {history}), e AS (SELECT t.season, t.gw, h.element, avg(h.minutes) AS baseline FROM t JOIN {history} AS h ON h.season = t.season AND h.gw < t.gw GROUP BY 1, 2, 3),
    f AS (SELECT t.season, t.gw, h.element, avg(h.minutes) AS baseline FROM t JOIN {history} AS h ON h.season = t.season - 1 WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.season = t.season AND e.gw = t.gw) GROUP BY 1, 2, 3)
    SELECT season, gw, element, round(baseline, 4) AS baseline FROM e UNION ALL SELECT season, gw, element, round(baseline, 4) FROM f""")
def season_mean_baseline(s: Star) -> DataFrame:
    actuals = s.history.select("season", "gw", "element", F.col("minutes").alias("actual"))
    return backtest.season_mean_baseline(actuals, actuals.select("season", "gw").distinct()).withColumns(r4("baseline"))


# ---------------------------------------------------------------- decisions and monitoring


@query("""WITH v AS (SELECT season, player_id, min(position) AS position, min_by(price, gw) AS price, coalesce(avg(ep) FILTER (WHERE gw = 1), 0) AS a, coalesce(avg(ep) FILTER (WHERE gw = 2), 0) AS b, coalesce(avg(ep) FILTER (WHERE gw = 3), 0) AS c,
    coalesce(avg(ep) FILTER (WHERE gw = 4), 0) AS d, sum(ep) AS total FROM {outlook} GROUP BY season, player_id),
    k AS (SELECT * FROM v AS i WHERE NOT EXISTS (SELECT 1 FROM v AS j WHERE j.season = i.season AND j.position = i.position AND j.player_id <> i.player_id AND j.price <= i.price AND j.a >= i.a AND j.b >= i.b AND j.c >= i.c AND j.d >= i.d
    AND (j.price < i.price OR j.a > i.a OR j.b > i.b OR j.c > i.c OR j.d > i.d))), n AS (SELECT *, row_number() OVER (PARTITION BY season, position ORDER BY total DESC, player_id) AS r FROM k)
    SELECT season, player_id, position, price, round(total, 4) AS total FROM n WHERE r <= 20""")
def dominance_pool(s: Star) -> DataFrame:
    """Each season's pool over a horizon of four gameweeks."""
    return state.candidate_pool(s.outlook, 20, weeks=[1, 2, 3, 4], by=("season",)).select("season", "player_id", "position", "price", F.round("total", 4).alias("total"))


@query("""WITH RECURSIVE w AS (SELECT entry, made, chip, row_number() OVER (PARTITION BY entry ORDER BY gw) AS r FROM {weeks}), f AS (SELECT entry, r, 1 AS free FROM w WHERE r = 1 UNION ALL
    SELECT w.entry, w.r, CASE WHEN w.chip = 'wildcard' THEN f.free ELSE least(5, f.free - least(w.made, f.free) + 1) END FROM f JOIN w ON w.entry = f.entry AND w.r = f.r + 1) SELECT entry, CAST(max_by(free, r) AS INT) AS free FROM f GROUP BY entry""")
def free_transfer_bank(s: Star) -> DataFrame:
    return state.free_transfers(s.weeks)


@query("""SELECT p_partkey AS element, CASE WHEN n <= b THEN n ELSE b + (n - b) // 2 END AS price FROM (SELECT p_partkey, CAST(p_size AS INT) + 40 AS n, CAST(p_partkey % 50 AS INT) + 40 AS b FROM part) AS x""")
def selling_price(s: Star) -> DataFrame:
    now, bought = F.col("p_size").cast("int") + 40, (F.col("p_partkey") % 50).cast("int") + 40
    return s.part.select(F.col("p_partkey").alias("element"), state.selling_price(bought, now).alias("price"))


STATUS = "CASE p_partkey % 7 WHEN 0 THEN 'u' WHEN 1 THEN 'n' WHEN 2 THEN 'd' WHEN 3 THEN 'i' WHEN 4 THEN 's' ELSE 'a' END"


@query(f"""SELECT p_partkey AS element, round(CASE WHEN st IN ('u', 'n') THEN 0.0 WHEN st = 'a' THEN 1.0 WHEN ch IS NULL THEN CASE WHEN st = 'd' THEN 0.75 ELSE 0.10 END ELSE greatest(0, least(100, ch)) / 100.0 END, 4)::DOUBLE AS multiplier
    FROM (SELECT p_partkey, {STATUS} AS st, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 130 - 10 END AS ch FROM part) AS x""")
def availability(s: Star) -> DataFrame:
    chance = F.expr("CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 130 - 10 END")
    return s.part.select(F.col("p_partkey").alias("element"), F.round(minutes.availability(F.expr(STATUS), chance), 4).alias("multiplier"))


@query(f"""WITH e AS (SELECT p_partkey AS player_id, {STATUS} AS st, p_partkey % 200 AS m, (40 + p_partkey % 90) / 10.0 AS price, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 4 * 25 END AS ch FROM part),
    r AS (SELECT player_id, 'flagged' AS kind, CASE WHEN st = 'u' OR coalesce(ch, -1) = 0 THEN 'critical' ELSE 'high' END AS severity FROM e WHERE st <> 'a' UNION ALL SELECT player_id, 'zero-minutes', CASE WHEN price >= 6.0 THEN 'critical' ELSE 'high' END FROM e WHERE st = 'a' AND m = 0
    UNION ALL SELECT player_id, 'low-minutes', CASE WHEN price >= 5.5 THEN 'high' ELSE 'medium' END FROM e WHERE st = 'a' AND m > 0 AND m < 135) SELECT kind, severity, count(*) AS players FROM r GROUP BY 1, 2""")
def risk_scan(s: Star) -> DataFrame:
    elements = s.part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("web_name"), F.col("p_brand").alias("team"), (F.col("p_partkey") % 4 + 1).alias("element_type"), (40 + F.col("p_partkey") % 90).alias("now_cost"),
        (F.col("p_partkey") % 200).alias("minutes"), F.expr(STATUS).alias("status"), F.lit(None).cast("string").alias("news"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 4 * 25 END").alias("chance_of_playing_next_round"),
    )
    return monitor.scan_risks(elements, 3).groupBy("kind", "severity").agg(F.count("*").alias("players"))


@query("SELECT player_id, max_by(now_cost, struct_pack(t := ts, e := event_id)) AS now_cost FROM {prices} GROUP BY 1")
def latest_price(s: Star) -> DataFrame:
    return monitor.deduplicate(s.prices, ["player_id"], [F.col("ts"), F.col("event_id")]).select("player_id", "now_cost")


@query("SELECT day, player_id, event_id, now_cost FROM (SELECT *, row_number() OVER (PARTITION BY day, player_id ORDER BY ts DESC, event_id DESC) AS r FROM {prices}) AS x WHERE r = 1")
def snapshot_dedupe(s: Star) -> DataFrame:
    return monitor.deduplicate(s.prices, ["day", "player_id"], [F.col("ts"), F.col("event_id")]).select("day", "player_id", "event_id", "now_cost")


@query("SELECT event_id, player_id, round(proj_pct_today, 4) AS pct, CASE WHEN proj_pct_today > 0 THEN 'rise' ELSE 'fall' END AS direction FROM {prices} WHERE abs(proj_pct_today) >= 40 AND event_type <> 'error'")
def movers(s: Star) -> DataFrame:
    frame = s.prices.withColumn("calibrating", F.col("event_type") == "error").withColumn("locked_until", F.lit(None).cast("string"))
    return monitor.movers(frame, 40.0).select("event_id", "player_id", F.round("proj_pct_today", 4).alias("pct"), "direction")


from . import check_queries as _checks, engine_queries as _engine, more_queries as _more, source_queries as _sources, squad_queries as _squads  # noqa: E402,F401  register the rest
