"""Registered queries on the sources' payloads and archives: documents are nested from the star schema, and flattened by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import names
from ..operators import bonus, matches, monitor, reconcile, state
from ..sources import archive, pages
from ..sources import payloads as P
from ..sources.catalog import Catalog, key_range, storable
from .registry import Star, query
from .star import scratch

#: Documents are dealt by the remainder of an id by this, so that none grows with the whole table.
DEALT = 64


def _some(value: Column, of: str, n: int) -> Column:
    """The value, null in every n-th row."""
    return F.when(F.col(of) % n != 0, value)


# ---------------------------------------------------------------- catalog


@query("SELECT s_suppkey, s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def catalog_round_trip(s: Star) -> DataFrame:
    """Save twice under one name, so that the second replaces the first, and load."""
    catalog = Catalog(s.spark, scratch(s.spark, "catalog"))
    rows = s.supplier.select("s_suppkey", "s_nationkey", F.round("s_acctbal", 2).alias("s_acctbal"))
    catalog.save(rows.limit(1), "a/suppliers")
    catalog.save(rows, "a/suppliers")
    return catalog.load("a/suppliers")


@query("SELECT r_regionkey AS id, r_name AS name, CAST(NULL AS VARCHAR) AS nothing, CAST(r_regionkey AS VARCHAR) AS mixed FROM region")
def storable_columns(s: Star) -> DataFrame:
    mixed = s.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).alias("nothing"), F.col("r_regionkey").cast("string").alias("mixed"))
    catalog = Catalog(s.spark, scratch(s.spark, "catalog"))
    catalog.save(storable(mixed), "mixed")
    return catalog.load("mixed")


@query("""SELECT 'orders' AS name, count(*) AS rows, CAST(min(o_orderdate) AS DATE)::VARCHAR AS first, CAST(max(o_orderdate) AS DATE)::VARCHAR AS last FROM orders
    UNION ALL SELECT 'events', count(*), CAST(min(ts) AS DATE)::VARCHAR, CAST(max(ts) AS DATE)::VARCHAR FROM events UNION ALL SELECT 'weeks', count(*), min(gw)::VARCHAR, max(gw)::VARCHAR FROM {weeks}""")
def key_ranges(s: Star) -> DataFrame:
    dated = {"orders": (s.orders, "o_orderdate"), "events": (s.events, "ts"), "weeks": (s.weeks, "gw")}
    out = [key_range(df, c).select(F.lit(n).alias("name"), "rows", "first", "last") for n, (df, c) in dated.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT count(DISTINCT ts) AS snapshots, count(*) AS rows FROM {prices}")
def distinct_snapshots(s: Star) -> DataFrame:
    return monitor.distinct_snapshots(s.prices)


# ---------------------------------------------------------------- game payloads


def _elements(s: Star) -> DataFrame:
    part = s.part
    key = F.col("p_partkey")
    projection = lambda offset, percent: F.struct(F.lit(offset).alias("offset"), percent.alias("projected_percent"), (key % 5).cast("int").alias("likelihood"))
    return part.select(
        key.cast("int").alias("id"), F.col("p_name").alias("web_name"), _some(F.col("p_brand"), "p_partkey", 3).alias("first_name"), F.col("p_name").alias("second_name"), (key % 25).cast("int").alias("team"),
        (key % 5).cast("int").alias("element_type"), (40 + key % 90).cast("int").alias("now_cost"), _some((key % 7).cast("int"), "p_partkey", 4).alias("cost_change_start"), (key % 3).cast("int").alias("cost_change_event"),
        F.lit("a").alias("status"), F.when(key % 6 == 0, "n/a").otherwise((key % 400 / 10).cast("string")).alias("selected_by_percent"), _some((key % 1000).cast("int"), "p_partkey", 5).alias("transfers_in_event"),
        (key % 900).cast("int").alias("transfers_out_event"), (key % 50 - 25).cast("int").alias("price_change_hourly_rate"),
        F.when(key % 8 == 0, F.array().cast("array<struct<offset:int,projected_percent:string,likelihood:int>>")).otherwise(
            F.array(projection(1, (key % 90).cast("string")), projection(0, F.when(key % 9 == 0, "none").otherwise((key % 80).cast("string"))), projection(0, F.lit("999")))
        ).alias("price_change_projections"),
        F.lit(None).cast("string").alias("price_change_locked_until"), _some(key % 2 == 0, "p_partkey", 10).alias("price_change_calibrating"),
    )


@query("""SELECT CAST(p_partkey AS INT) AS id, CASE p_partkey % 5 WHEN 1 THEN 'GKP' WHEN 2 THEN 'DEF' WHEN 3 THEN 'MID' WHEN 4 THEN 'FWD' END AS position, n_name AS team_name, substr(n_name, 1, 3) AS team_short,
    trim(concat(CASE WHEN p_partkey % 3 <> 0 THEN p_brand ELSE '' END, ' ', p_name)) AS full_name, round((40 + p_partkey % 90) / 10.0, 4)::DOUBLE AS price FROM part LEFT JOIN nation ON p_partkey % 25 = n_nationkey""")
def elements_table(s: Star) -> DataFrame:
    teams = s.nation.select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name"), F.substring("n_name", 1, 3).alias("short_name"))
    return P.elements_frame(_elements(s), teams).select("id", "position", "team_name", "team_short", "full_name", F.round("price", 4).alias("price"))


@query("""SELECT CAST(p_partkey AS INT) AS player_id, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE CAST(p_partkey % 7 AS INT) END AS cost_change_start,
    CAST(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey % 1000 END - p_partkey % 900 AS INT) AS net_transfers_event, round(CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE (p_partkey % 400) / 10.0 END, 4)::DOUBLE AS selected_by_percent,
    CASE WHEN p_partkey % 8 = 0 OR p_partkey % 9 = 0 THEN NULL ELSE CAST(p_partkey % 80 AS DOUBLE) END AS proj_pct_today, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE CAST(p_partkey % 5 AS INT) END AS proj_likelihood_today,
    CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE CAST(p_partkey % 90 AS DOUBLE) END AS proj_pct_tomorrow, CASE WHEN p_partkey % 10 = 0 THEN false ELSE p_partkey % 2 = 0 END AS calibrating FROM part""")
def price_snapshot(s: Star) -> DataFrame:
    rows = monitor.price_rows(_elements(s), F.lit("2024-01-01T00:00:00Z").cast("timestamp"))
    return rows.select("player_id", "cost_change_start", "net_transfers_event", F.round("selected_by_percent", 4).alias("selected_by_percent"), "proj_pct_today", "proj_likelihood_today", "proj_pct_tomorrow", "calibrating")


def _fixtures(s: Star, event: str = "CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT)") -> DataFrame:
    """A fixture per order: kickoff as text, unplayed and unfinished ones among them, statistics nested by side; gameweeks are months, or as said."""
    key = F.col("o_orderkey")
    items = lambda home: F.array_sort(F.collect_list(F.when((F.col("ln") % 2 == 1) == home, F.struct(F.col("q").alias("value"), F.col("element").cast("int").alias("element")))))
    stats = s.line.groupBy("fixture").agg(
        F.array(*[F.struct(F.lit(name).alias("identifier"), items(False).alias("a"), items(True).alias("h")) for name in ("bps", "threat")]).alias("stats")
    )
    heads = s.heads.select(
        key.alias("id"), F.expr(event).alias("event"), (key % 4 != 0).alias("finished"), _some(key % 8 == 0, "o_orderkey", 12).alias("finished_provisional"),
        F.when(key % 7 == 0, "to be fixed").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T00:00:00Z'")).alias("kickoff_time"), (F.col("o_custkey") % 20).cast("int").alias("team_h"), (key % 20).cast("int").alias("team_a"),
        _some((key % 4).cast("int"), "o_orderkey", 5).alias("team_h_score"), (key % 3).cast("int").alias("team_a_score"),
    )
    return heads.join(stats, F.col("id") == F.col("fixture"), "left").drop("fixture")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(epoch(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS BIGINT) END AS kickoff FROM orders")
def fixtures_table(s: Star) -> DataFrame:
    return P.fixtures_frame(_fixtures(s)).select("id", F.unix_seconds("kickoff_time").alias("kickoff"))


@query("SELECT user_id AS id, CAST(floor(epoch(max(ts))) AS BIGINT) AS deadline FROM events GROUP BY 1 UNION ALL SELECT -1, NULL")
def events_table(s: Star) -> DataFrame:
    events = s.events.groupBy(F.col("user_id").alias("id")).agg(F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("deadline_time"))
    odd = s.spark.createDataFrame([(-1, "soon")], "id long, deadline_time string")
    return P.events_frame(events.unionByName(odd)).select("id", F.unix_seconds("deadline_time").alias("deadline"))


@query("""SELECT fixture, identifier, CASE WHEN ln % 2 = 1 THEN 'h' ELSE 'a' END AS side, CAST(element AS INT) AS element, q AS value FROM {line} CROSS JOIN (VALUES ('bps'), ('threat')) AS t(identifier)""")
def fixture_statistics(s: Star) -> DataFrame:
    return P.fixture_stats_frame(_fixtures(s)).drop("event")


@query("SELECT fixture, CAST(element AS INT) AS element, q AS bps, CAST(greatest(0, 4 - rank() OVER (PARTITION BY fixture ORDER BY q DESC)) AS INT) AS bonus FROM {line}")
def fixture_bonus(s: Star) -> DataFrame:
    return bonus.bonus_from_fixture_stats(P.fixture_stats_frame(_fixtures(s)))


@query("""WITH g AS (SELECT fixture, CAST(element AS INT) AS element, q, CAST(greatest(0, 4 - rank() OVER (PARTITION BY fixture ORDER BY q DESC)) AS INT) AS b FROM {line}),
    p AS (SELECT fixture, element, CAST(max(b + CASE WHEN fixture % 11 = 0 AND b = 3 THEN 1 ELSE 0 END) AS INT) AS given FROM g GROUP BY 1, 2)
    SELECT g.fixture, count(*) AS players, bool_and(b = coalesce(given, 0)) AS agrees FROM g LEFT JOIN p ON g.fixture = p.fixture AND g.element = p.element GROUP BY g.fixture""")
def bonus_reconcile(s: Star) -> DataFrame:
    """Published bonus is that of the rules, but for one point too much in every eleventh fixture."""
    own = bonus.bonus_from_fixture_stats(P.fixture_stats_frame(_fixtures(s)))
    given = own.withColumn("bonus", F.col("bonus") + ((F.col("fixture") % 11 == 0) & (F.col("bonus") == 3)).cast("int")).groupBy("fixture", "element").agg(F.max("bonus").alias("bonus"))
    return reconcile.reconcile_bonus(own.drop("bonus"), given)


@query("""SELECT CAST(o_custkey * 10000 + year(o_orderdate) AS BIGINT) AS gw FROM orders GROUP BY 1 HAVING bool_and(o_orderkey % 4 <> 0) UNION ALL SELECT 1 UNION ALL SELECT 2""")
def final_weeks(s: Star) -> DataFrame:
    """By all fixtures, a gameweek being a customer's year, and by the flags of weeks without fixtures."""
    events = s.spark.createDataFrame([(1, True, False), (2, False, True), (3, False, None)], "id int, finished boolean, data_checked boolean")
    return P.final_gameweeks(_fixtures(s, "o_custkey * 10000 + year(o_orderdate)"), events)


@query("""WITH f AS (SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT) AS gw, CAST(o_custkey % 20 AS INT) AS h, CAST(o_orderkey % 20 AS INT) AS a FROM orders
    WHERE o_orderkey % 4 = 0 AND NOT (o_orderkey % 12 <> 0 AND o_orderkey % 8 = 0)) SELECT gw, h AS team FROM f UNION SELECT gw, a FROM f""")
def pending_clubs(s: Star) -> DataFrame:
    return P.pending_teams(_fixtures(s))


@query("SELECT CAST(c_custkey AS INT) AS gw FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0 OR c_custkey = 7")
def weeks_played(s: Star) -> DataFrame:
    key = F.col("c_custkey")
    events = s.customer.select(key.cast("int").alias("id"), _some(key % 3 == 0, "c_custkey", 10).alias("finished"), (key % 5 == 0).alias("data_checked"), (key == 7).alias("is_current"))
    return P.gameweeks_played(events.withColumn("finished", F.when(F.col("id") % 30 == 0, True).otherwise(F.col("finished"))))


@query("""SELECT 'now' AS season, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(epoch(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS BIGINT) END AS kickoff, h.n_name AS home_team, a.n_name AS away_team, CAST(o_orderkey % 4 AS INT) AS home_goals,
    CAST(o_orderkey % 3 AS INT) AS away_goals FROM orders JOIN nation AS h ON o_custkey % 20 = h.n_nationkey JOIN nation AS a ON o_orderkey % 20 = a.n_nationkey WHERE o_orderkey % 5 <> 0""")
def live_match_table(s: Star) -> DataFrame:
    teams = s.nation.select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name"))
    out = matches.live_matches(_fixtures(s), teams, "now")
    return out.select("season", F.unix_seconds("date").alias("kickoff"), "home_team", "away_team", "home_goals", "away_goals")


# ---------------------------------------------------------------- live payloads


def _live_payload(s: Star) -> DataFrame:
    """Documents of 1997: per element its statistics and the lines of its fixtures."""
    lines = F.array(
        F.struct(F.lit("minutes").alias("identifier"), F.when(F.col("minutes") > 0, 2).otherwise(0).alias("points"), F.col("minutes").alias("value"), F.when(F.col("element") % 7 == 0, 1).alias("points_modification")),
        F.struct(F.lit("goals_scored").alias("identifier"), (F.col("goals_scored") * 4).alias("points"), F.col("goals_scored").alias("value"), F.lit(None).cast("int").alias("points_modification")),
    )
    rows = s.stats.where("season = 1997").groupBy("element").agg(
        F.sum("minutes").cast("int").alias("minutes"), F.collect_list(F.struct(F.col("fixture"), lines.alias("stats"))).alias("explain"),
        F.sum(F.when(F.col("minutes") > 0, 2).otherwise(0) + F.col("goals_scored") * 4 + F.when(F.col("element") % 7 == 0, 1).otherwise(0)).cast("int").alias("rebuilt"),
    )
    stats = F.struct("minutes", F.when(F.col("element") % 4 == 0, "n/a").otherwise((F.col("minutes") / 2).cast("string")).alias("influence"), (F.col("rebuilt") + F.when(F.col("element") % 13 == 0, 1).otherwise(0)).alias("total_points"))
    element = F.struct(F.col("element").cast("int").alias("id"), stats.alias("stats"), "explain")
    return rows.select((F.col("element") % DEALT).alias("d"), F.floor(F.col("element") / 1000).alias("e"), element.alias("x")).groupBy("d", "e").agg(F.collect_list("x").alias("elements")).select("elements")


LIVE = """l AS (SELECT CAST(element AS INT) AS element, fixture, minutes, goals_scored, CASE WHEN minutes > 0 THEN 2 ELSE 0 END AS mp, CASE WHEN element % 7 = 0 THEN 1 ELSE 0 END AS mod FROM {stats} WHERE season = 1997)"""


@query(f"""WITH {LIVE} SELECT 1997 AS gw, element, CAST(sum(minutes) AS INT) AS minutes, CASE WHEN element % 4 = 0 THEN NULL ELSE round(sum(minutes) / 2.0, 4) END::DOUBLE AS influence,
    CAST(sum(mp + goals_scored * 4 + mod) + CASE WHEN element % 13 = 0 THEN 1 ELSE 0 END AS INT) AS total_points FROM l GROUP BY element""")
def live_points(s: Star) -> DataFrame:
    return P.live_points_frame(_live_payload(s), 1997).withColumn("influence", F.round("influence", 4))


@query(f"""WITH {LIVE} SELECT 1997 AS gw, element, fixture, 'minutes' AS identifier, minutes AS value, mp AS points, mod AS points_modification FROM l UNION ALL SELECT 1997, element, fixture, 'goals_scored', goals_scored, goals_scored * 4, 0 FROM l""")
def live_explain(s: Star) -> DataFrame:
    return P.live_explain_frame(_live_payload(s), 1997)


@query(f"""WITH {LIVE} SELECT 1997 AS gw, element, CAST(sum(mp + goals_scored * 4 + mod) + CASE WHEN element % 13 = 0 THEN 1 ELSE 0 END AS INT) AS total_points, CAST(sum(mp + goals_scored * 4 + mod) AS BIGINT) AS rebuilt FROM l GROUP BY element""")
def points_rebuilt(s: Star) -> DataFrame:
    payload = _live_payload(s)
    return reconcile.rebuilt_points(P.live_explain_frame(payload, 1997), P.live_points_frame(payload, 1997))


# ---------------------------------------------------------------- provider payloads


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS player_name, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey % 38 AS DOUBLE) END AS games, round((p_partkey % 700) / 100.0, 4)::DOUBLE AS "xG", '2024' AS season, 'EPL' AS league FROM part""")
def provider_players(s: Star) -> DataFrame:
    key = F.col("p_partkey")
    player = F.struct(key.cast("string").alias("id"), F.col("p_name").alias("player_name"), F.when(key % 5 == 0, "none").otherwise((key % 38).cast("string")).alias("games"), (key % 700 / 100).cast("string").alias("xG"))
    payload = s.part.groupBy(F.floor(key / 1000)).agg(F.collect_list(player).alias("players")).select("players")
    return P.provider_players(payload, "2024", "EPL").withColumn("xG", F.round("xG", 4))


def _match(side: bool = False) -> Column:
    key = F.col("o_orderkey")
    of = lambda name, h, a: F.struct(h.alias("h"), a.alias("a")).alias(name)
    club = lambda n: F.struct(n.cast("string").alias("id"), F.concat(F.lit("club "), n.cast("string")).alias("title"))
    fields = [
        key.cast("string").alias("id"), _some(key % 4 != 0, "o_orderkey", 6).alias("isResult"), F.when(key % 9 == 0, "later").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("datetime"),
        club(F.col("o_custkey") % 20).alias("h"), club(key % 20).alias("a"), of("goals", (key % 4).cast("string"), F.when(key % 5 == 0, F.lit(None)).otherwise((key % 3).cast("string"))),
        of("xG", (key % 300 / 100).cast("string"), F.lit("?")),
    ]
    return F.struct(*fields, *([F.when(key % 2 == 0, "h").otherwise("a").alias("side"), F.when(key % 3 == 0, "w").otherwise("d").alias("result")] if side else []))


def _dates(s: Star, side: bool = False) -> DataFrame:
    return s.orders.groupBy(F.floor(F.col("o_orderkey") / 1000)).agg(F.collect_list(_match(side)).alias("dates")).select("dates")


MATCH = """CAST(o_orderkey AS VARCHAR) AS match_id, CASE WHEN o_orderkey % 6 = 0 THEN false ELSE o_orderkey % 4 <> 0 END AS is_result, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS datetime,
    concat('club ', CAST(o_custkey % 20 AS VARCHAR)) AS h_team, concat('club ', CAST(o_orderkey % 20 AS VARCHAR)) AS a_team, CAST(o_orderkey % 4 AS DOUBLE) AS h_goals,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 3 AS DOUBLE) END AS a_goals, round((o_orderkey % 300) / 100.0, 4)::DOUBLE AS h_xg, CAST(NULL AS DOUBLE) AS a_xg"""


@query(f"SELECT '2024' AS season, 'EPL' AS league, CAST(o_custkey % 20 AS VARCHAR) AS h_team_id, CAST(o_orderkey % 20 AS VARCHAR) AS a_team_id, {MATCH} FROM orders")
def provider_fixtures(s: Star) -> DataFrame:
    return P.provider_fixtures(_dates(s), "2024", "EPL").withColumn("h_xg", F.round("h_xg", 4))


@query(f"SELECT 'club 3' AS team, '2024' AS season, CASE WHEN o_orderkey % 2 = 0 THEN 'h' ELSE 'a' END AS side, CASE WHEN o_orderkey % 3 = 0 THEN 'w' ELSE 'd' END AS result, {MATCH} FROM orders")
def team_matches(s: Star) -> DataFrame:
    return P.team_matches(_dates(s, True), "club 3", "2024").withColumn("h_xg", F.round("h_xg", 4))


@query("""SELECT CAST(element AS VARCHAR) AS player_id, CASE WHEN fixture % 9 = 0 THEN NULL ELSE CAST(kickoff_time AS TIMESTAMP) END AS date, CAST(d % 3 AS DOUBLE) AS goals, CASE WHEN q % 5 = 0 THEN NULL ELSE CAST(q AS DOUBLE) END AS time,
    CAST(fixture AS VARCHAR) AS id FROM {line}""")
def player_matches(s: Star) -> DataFrame:
    match = F.struct(F.col("fixture").cast("string").alias("id"), F.when(F.col("fixture") % 9 == 0, "?").otherwise(F.date_format("kickoff_time", "yyyy-MM-dd")).alias("date"), (F.col("d") % 3).cast("string").alias("goals"), F.when(F.col("q") % 5 == 0, "-").otherwise(F.col("q").cast("string")).alias("time"))
    payload = s.line.groupBy(F.col("element").cast("string").alias("player_id")).agg(F.collect_list(match).alias("matches"))
    return P.player_matches(payload)


SHOT = """SELECT CAST(season AS VARCHAR) AS season, CASE WHEN ln % 5 = 0 THEN 'm1' ELSE CAST(fixture AS VARCHAR) END AS match_id, CAST(fixture * 10 + ln AS VARCHAR) AS shot_id, CAST(q AS DOUBLE) AS minute, CAST(element AS VARCHAR) AS player_id,
    CASE WHEN ln % 2 = 1 THEN concat('club ', CAST(team % 20 AS VARCHAR)) ELSE concat('club ', CAST(element % 20 AS VARCHAR)) END AS team, CASE WHEN ln % 2 = 1 THEN 'h' ELSE 'a' END AS h_a, d = 1 AS is_goal,
    CASE WHEN t = 0 THEN NULL ELSE round(d / 100.0, 4)::DOUBLE END AS xg FROM {line}"""


def _shots(s: Star) -> DataFrame:
    """(key, h, a): shots of either side, nested by match."""
    text = lambda c: F.col(c).cast("string")
    club = lambda c: F.concat(F.lit("club "), (F.col(c) % 20).cast("string"))
    side = F.when(F.col("ln") % 2 == 1, "h").otherwise("a")
    none = {c: F.lit(None).cast("string").alias(c) for c in ("date", "player", "X", "Y", "situation", "shotType", "lastAction", "player_assisted")}
    shot = F.struct(
        (F.col("fixture") * 10 + F.col("ln")).cast("string").alias("id"), text("season").alias("season"), F.when(F.col("ln") % 5 != 0, text("fixture")).alias("match_id"), text("q").alias("minute"), text("element").alias("player_id"), side.alias("h_a"),
        club("team").alias("h_team"), club("element").alias("a_team"), F.lit("1").alias("h_goals"), F.lit("x").alias("a_goals"), F.when(F.col("d") == 1, "Goal").otherwise("Missed").alias("result"),
        F.when(F.col("t") == 0, "?").otherwise((F.col("d") / 100).cast("string")).alias("xG"), *none.values(),
    )
    sided = lambda home: F.collect_list(F.when((F.col("ln") % 2 == 1) == home, shot))
    return s.line.groupBy("fixture").agg(sided(True).alias("h"), sided(False).alias("a"))


@query(SHOT)
def match_shots(s: Star) -> DataFrame:
    out = P.shots_frame(_shots(s), "m1")
    return out.select("season", "match_id", "shot_id", "minute", "player_id", "team", "h_a", "is_goal", F.round("xg", 4).alias("xg"))


@query(SHOT)
def player_shots(s: Star) -> DataFrame:
    """A player's shots come as one list, whatever the side."""
    out = P.player_shots(_shots(s).select(F.concat("h", "a").alias("shots")), "m1")
    return out.select("season", "match_id", "shot_id", "minute", "player_id", "team", "h_a", "is_goal", F.round("xg", 4).alias("xg"))


# ---------------------------------------------------------------- season archives


@query("""WITH p AS (SELECT p_partkey AS k, p_brand AS b FROM part)
    SELECT '2016-17' AS season, k % 38 + 1 AS gw, k AS element, concat('A ', CAST(k % 9 AS VARCHAR)) AS name, CASE k % 4 WHEN 0 THEN 'GK' WHEN 1 THEN 'DEF' WHEN 2 THEN 'MID' ELSE NULL END AS position, CASE WHEN k % 4 = 3 THEN NULL ELSE concat('club ', CAST(k % 20 AS VARCHAR)) END AS team,
    k % 2 = 0 AS was_home, CASE WHEN k % 6 = 0 THEN NULL ELSE CAST(k % 90 AS DOUBLE) END AS minutes, CAST(NULL AS DOUBLE) AS xp, b AS odd_column FROM p
    UNION ALL SELECT '2020-21', k % 38 + 1, k, concat('B ', CAST(k % 9 AS VARCHAR)), upper(CASE k % 4 WHEN 0 THEN 'GK' ELSE 'mid' END), concat('town ', CAST(k % 20 AS VARCHAR)), NULL, CAST(k % 90 AS DOUBLE), round((k % 70) / 10.0, 4)::DOUBLE, NULL FROM p""")
def season_rows(s: Star) -> DataFrame:
    """Two seasons of drifting columns: names with ids and a lookup in one, a gameweek and positions of its own in the other."""
    key = F.col("p_partkey")
    text = lambda c: c.cast("string")
    old = s.part.select(
        F.concat(F.lit("A_"), text(key % 9), F.lit("_"), text(key)).alias("name"), text(key % 38 + 1).alias("round"), F.when(key % 6 == 0, "-").otherwise(text(key % 90)).alias("minutes"),
        F.when(key % 2 == 0, "True").otherwise("False").alias("was_home"), F.col("p_brand").alias("odd_column"), F.lit("x").alias("modified"),
    )
    lookup = s.part.where("p_partkey % 4 <> 3").select(
        key.alias("element"), F.element_at(F.array(*map(F.lit, ("Goalkeeper", "DEF", "MID"))), (key % 4 + 1).cast("int")).alias("position_lookup"), F.concat(F.lit("club "), text(key % 20)).alias("team_lookup")
    )
    new = s.part.select(
        F.concat(F.lit("B "), text(key % 9)).alias("name"), text(key).alias("element"), text(key % 38 + 1).alias("GW"), F.lit("99").alias("round"), F.when(key % 4 == 0, " gkp ").otherwise("mid").alias("position"),
        F.concat(F.lit("town "), text(key % 20)).alias("team"), text(key % 90).alias("minutes"), text(key % 70 / 10).alias("xP"),
    )
    both = archive.union_seasons([archive.normalise_season(old, "2016-17", lookup), archive.normalise_season(new, "2020-21")])
    return both.select("season", "gw", "element", "name", "position", "team", "was_home", "minutes", F.round("xp", 4).alias("xp"), "odd_column")


@query("SELECT n_nationkey AS id, CASE n_nationkey % 5 WHEN 0 THEN 'Man Utd' WHEN 1 THEN 'Spurs' WHEN 2 THEN 'Nott''m Forest' WHEN 3 THEN n_name ELSE '' END AS club FROM nation")
def club_names(s: Star) -> DataFrame:
    """Spellings with odd blanks and case, an unknown club and none."""
    key = F.col("n_nationkey") % 5
    spelt = F.when(key == 0, "  manchester   UNITED ").when(key == 1, "Tottenham Hotspur").when(key == 2, "nforest").when(key == 3, F.col("n_name"))
    return s.nation.select(F.col("n_nationkey").alias("id"), names.club(spelt).alias("club"))


@query("SELECT n_nationkey AS id, concat('jose o neil ', trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g'))) AS key FROM nation")
def folded_names(s: Star) -> DataFrame:
    """Accents, apostrophes and dots fall away; these names go through Python."""
    return s.nation.select(F.col("n_nationkey").alias("id"), names.player_key(F.concat(F.lit("José  O'Néil. "), F.col("n_name"))).alias("key"))


@query("SELECT page_id, lower(substr(coalesce(html, ''), 1, 4000)) SIMILAR TO '.*(just a moment|cf-challenge|challenge-platform|cf_chl_opt|enable javascript and cookies|attention required).*' AS blocked FROM pages")
def page_challenges(s: Star) -> DataFrame:
    return s.pages.select("page_id", pages.challenged(F.coalesce("html", F.lit(""))).alias("blocked"))


# ---------------------------------------------------------------- league payloads


def _documents(s: Star) -> tuple[DataFrame, DataFrame]:
    """(picks, histories): a document per manager and gameweek, and one per manager."""
    pick = F.struct(F.col("element").cast("int").alias("element"), F.col("slot").cast("int").alias("position"), "multiplier", "is_captain", "is_vice_captain")
    picks = s.picks.groupBy("entry", "gw").agg(F.collect_list(pick).alias("picks")).join(
        s.auto_subs.select("entry", "gw", F.array(F.struct("element_in", "element_out")).alias("automatic_subs")), ["entry", "gw"], "left"
    )
    week = F.struct(F.col("gw").alias("event"), "points", F.lit(1000).alias("value"), (F.col("points") % 50).alias("bank"), (F.col("gw") % 3).alias("event_transfers"), F.col("hits").alias("event_transfers_cost"), F.lit(3).alias("points_on_bench"))
    chip = F.when(F.col("gw") % 4 == 0, F.struct(F.when(F.col("entry") % 2 == 0, "wildcard").otherwise("Triple_Captain").alias("name"), F.col("gw").alias("event")))
    return picks, s.manager_gw.groupBy("entry").agg(F.array_sort(F.collect_list(week)).alias("current"), F.collect_list(chip).alias("chips"))


def _league(s: Star) -> dict[str, DataFrame]:
    picks, histories = _documents(s)
    row = F.struct("entry", "rank", "total")
    standings = s.standings.groupBy(F.floor(F.col("rank") / 50)).agg(F.collect_list(row).alias("results")).select(F.struct("results").alias("standings"))
    return P.league_tables(picks, histories, standings)


@query("SELECT entry, gw, CAST(element AS INT) AS element, CAST(slot AS INT) AS slot, multiplier, is_captain, is_vice_captain FROM {picks}")
def league_picks(s: Star) -> DataFrame:
    return _league(s)["picks"]


@query("SELECT entry, gw, element_out, element_in FROM {auto_subs}")
def league_subs(s: Star) -> DataFrame:
    return _league(s)["auto_subs"]


@query("SELECT entry, gw, points, CAST(points % 50 AS INT) AS bank, CAST(gw % 3 AS INT) AS made, hits FROM {manager_gw}")
def league_weeks(s: Star) -> DataFrame:
    return _league(s)["manager_gw"].select("entry", "gw", "points", "bank", "made", "hits")


@query("SELECT entry, rank, total FROM {standings}")
def league_standings(s: Star) -> DataFrame:
    return _league(s)["standings"]


@query("""WITH t(chip) AS (VALUES ('wildcard'), ('freehit'), ('bboost'), ('3xc')), u AS (SELECT entry, CASE WHEN entry % 2 = 0 THEN 'wildcard' ELSE '3xc' END AS chip, count(*) AS used FROM {manager_gw} WHERE gw % 4 = 0 GROUP BY 1, 2)
    SELECT s.entry, t.chip, CAST(greatest(0, 2 - coalesce(used, 0)) AS INT) AS left FROM {standings} AS s CROSS JOIN t LEFT JOIN u ON s.entry = u.entry AND t.chip = u.chip""".replace("AS left FROM", 'AS "left" FROM'))
def chips_left(s: Star) -> DataFrame:
    from ..operators import league

    chips = _league(s)["chips"].withColumn("name", state.chip_name(F.col("name")))
    return league.chips_left(s.standings, chips)


@query("""WITH RECURSIVE w AS (SELECT entry, gw, CAST(gw % 3 AS INT) AS made, gw % 4 = 0 AND entry % 2 = 0 AS keeps, row_number() OVER (PARTITION BY entry ORDER BY gw) AS r FROM {manager_gw}),
    f AS (SELECT entry, r, 1 AS free FROM w WHERE r = 1 UNION ALL SELECT w.entry, w.r, CASE WHEN keeps THEN free ELSE least(5, free - least(made, free) + 1) END FROM f JOIN w ON w.entry = f.entry AND w.r = f.r + 1),
    lastw AS (SELECT entry, max(gw) AS gw, max_by(points % 50, gw) AS bank FROM {manager_gw} GROUP BY entry), b AS (SELECT entry, max_by(free, r) AS free FROM f GROUP BY entry),
    m AS (SELECT entry, element, max_by(CAST(round(price) AS INT), struct_pack(t := kickoff_time, p := CAST(round(price) AS INT))) AS paid FROM {line} WHERE season < 1998 GROUP BY 1, 2),
    h AS (SELECT p.entry, count(*) AS players, CAST(sum(coalesce(paid, 40 + p.element % 90 - CASE WHEN p.element % 4 = 0 THEN 0 ELSE p.element % 7 END)) AS BIGINT) AS paid,
    CAST(sum(CASE WHEN 40 + p.element % 90 <= coalesce(paid, 40 + p.element % 90 - CASE WHEN p.element % 4 = 0 THEN 0 ELSE p.element % 7 END) THEN 40 + p.element % 90
    ELSE coalesce(paid, 40 + p.element % 90 - CASE WHEN p.element % 4 = 0 THEN 0 ELSE p.element % 7 END) + (40 + p.element % 90 - coalesce(paid, 40 + p.element % 90 - CASE WHEN p.element % 4 = 0 THEN 0 ELSE p.element % 7 END)) // 2 END) AS BIGINT) AS selling
    FROM {picks} AS p JOIN lastw ON p.entry = lastw.entry AND p.gw = lastw.gw LEFT JOIN m ON p.entry = m.entry AND p.element = m.element GROUP BY p.entry)
    SELECT lastw.entry, lastw.gw AS as_of_gw, CAST(bank AS INT) AS bank, CAST(free AS INT) AS free, players, paid, selling FROM lastw JOIN b ON lastw.entry = b.entry JOIN h ON lastw.entry = h.entry""")
def manager_states(s: Star) -> DataFrame:
    """Squads from documents: armbands, prices paid and now, the bank and the replayed transfers."""
    picks, histories = _documents(s)
    boot = _elements(s).groupBy((F.col("id") % DEALT), F.floor(F.col("id") / 1000)).agg(F.collect_list(F.struct("id", "element_type", "team", "now_cost", "cost_change_start")).alias("elements")).select("elements")
    moves = s.line.where("season < 1998").select("entry", F.col("element").alias("element_in"), F.round("price").cast("int").alias("element_in_cost"), F.col("kickoff_time").alias("time"))
    squads = state.manager_state(boot, histories, picks, moves)
    total = lambda f: F.aggregate("squad", F.lit(0).cast("bigint"), lambda acc, p: acc + p[f])
    return squads.select("entry", "as_of_gw", "bank", "free", F.size("squad").cast("bigint").alias("players"), total("bought").alias("paid"), total("selling").alias("selling"))
