"""Registered queries on checks, marks and listings: full rosters, full feeds, gameweek marks, columns, stored tables and encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import rules, scoring
from ..operators import minutes, reconcile, state
from ..sources import archive, payloads as P
from ..sources.catalog import Catalog
from ..storage import scratch
from . import briefs
from .registry import Star, query

# ---------------------------------------------------------------- scoring


@query("""WITH e AS (SELECT element, season, CAST(sum(q) AS INT) AS bps, CAST(sum(minutes) AS INT) AS minutes FROM (SELECT element, season, q, q * 2 % 97 AS minutes FROM {line}) AS x GROUP BY 1, 2),
    r AS (SELECT DISTINCT l.fixture, l.element, l.season FROM {line} AS l), b AS (SELECT r.fixture, r.element, bps, CAST(greatest(0, 4 - rank() OVER (PARTITION BY r.fixture ORDER BY bps DESC)) AS INT) AS bonus
    FROM r JOIN e ON r.element = e.element AND r.season = e.season WHERE minutes > 0)
    SELECT fixture, count(*) AS players, bool_and(NOT (fixture % 11 = 0 AND bonus = 3)) AS agrees FROM b GROUP BY fixture""")
def bonus_reconcile_live(s: Star) -> DataFrame:
    """Whole rosters from the live documents of all seasons; in every eleventh fixture the published bonus is one too much for the best."""
    own = s.line.select("season", "fixture", F.col("element").cast("int").alias("id"), "q", (F.col("q") * 2 % 97).alias("minutes"))
    stats = own.groupBy("season", "id").agg(F.sum("minutes").cast("int").alias("minutes"), F.sum("q").cast("int").alias("bps"))
    rows = own.select("season", "fixture", "id").distinct().join(stats, ["season", "id"]).where("minutes > 0")
    right = reconcile.allocate_bonus(rows)
    given = right.select("season", "fixture", "id", (F.col("bonus") + ((F.col("fixture") % 11 == 0) & (F.col("bonus") == 3)).cast("int")).alias("bonus"))
    lines = own.groupBy("season", "id", "fixture").agg(F.lit(1).alias("n")).join(given, ["season", "id", "fixture"], "left")
    elements = lines.groupBy("season", "id").agg(F.collect_list(F.struct("fixture", F.coalesce("bonus", F.lit(0)).alias("bonus"))).alias("explain")).join(stats, ["season", "id"])
    return reconcile.reconcile_rosters(elements)


FEED = {
    "penalties_scored": "d % 2", "saves_from_inside_box": "q % 5", "big_chance_saves": "q % 3", "goal_line_clearances": "t % 2", "key_passes": "q % 6", "big_chances_created": "d % 3", "open_play_crosses": "q % 4", "dribbles": "t % 5",
    "shots_on_target": "d % 5", "shots_off_target": "q % 2", "winning_goals": "d % 2", "fouls_won": "t % 3", "fouls_conceded": "q % 3", "offsides": "d % 4", "big_chances_missed": "t % 2", "errors_leading_to_goal": "q % 2",
    "errors_leading_to_goal_attempt": "d % 3", "penalties_conceded": "t % 2", "passes_attempted": "q", "pass_completion_pct": "q * 2.0",
}


@query(f"""WITH f AS (SELECT fixture, ln % 4 + 1 AS p, q * 2 % 97 AS m, d % 3 AS g, t % 2 AS a, ln % 5 AS gc, q % 7 AS sv, (q % 5 = 0)::INT AS cs, {", ".join(f"{v} AS {k}" for k, v in FEED.items())} FROM {{line}}), k AS (SELECT *, least(penalties_scored, g) AS spot FROM f),
    b AS (SELECT fixture, CASE WHEN m = 0 THEN 0 ELSE CASE WHEN m >= 60 THEN 6 ELSE 3 END + (g - spot) * CASE p WHEN 3 THEN 18 WHEN 4 THEN 24 ELSE 12 END + spot * 12 + a * 9 + CASE WHEN p <= 2 THEN cs * 12 - gc * 4 ELSE 0 END + sv * 2
    + least(saves_from_inside_box, sv) + least(big_chance_saves, sv) + goal_line_clearances * 9 + key_passes + big_chances_created * 3 + open_play_crosses + dribbles + shots_on_target * 2 + winning_goals * 3 + fouls_won
    - penalties_conceded * 3 - big_chances_missed * 3 - errors_leading_to_goal * 3 - errors_leading_to_goal_attempt - fouls_conceded - offsides - shots_off_target
    + CASE WHEN passes_attempted < 30 THEN 0 WHEN pass_completion_pct >= 90 THEN 6 WHEN pass_completion_pct >= 80 THEN 4 WHEN pass_completion_pct >= 70 THEN 2 ELSE 0 END END AS bps FROM k)
    SELECT fixture, CAST(sum(bps) AS BIGINT) AS bps, count(*) AS players, count(*) FILTER (WHERE bps < 0) AS below_zero FROM b GROUP BY fixture""")
def bps_full_feed(s: Star) -> DataFrame:
    """Every term of the bonus system, those included that only the full feed has."""
    q, d, t, ln = (F.col(c) for c in ("q", "d", "t", "ln"))
    own = {"minutes": q * 2 % 97, "goals_scored": d % 3, "assists": t % 2, "goals_conceded": ln % 5, "saves": q % 7, "clean_sheets": (q % 5 == 0).cast("int")} | {k: F.expr(v) for k, v in FEED.items()}
    rows = s.line.select("fixture", (ln % 4 + 1).alias("position"), *[c.alias(n) for n, c in own.items()])
    scored = rows.withColumn("b", scoring.bps(scoring.stat_columns(rows), F.col("position")))
    return scored.groupBy("fixture").agg(F.sum("b").alias("bps"), F.count("*").alias("players"), F.count_if(F.col("b") < 0).alias("below_zero"))


@query("""SELECT p, CASE WHEN p BETWEEN 1 AND 4 THEN NULL ELSE concat('unknown position ', coalesce(CAST(p AS VARCHAR), 'null')) END AS error, count(*) AS rows
    FROM (SELECT CASE WHEN q % 9 = 0 THEN NULL ELSE ln - q % 2 END AS p FROM {line}) AS x GROUP BY 1, 2""")
def position_errors(s: Star) -> DataFrame:
    """Positions that scoring would stop at, with what it says of them."""
    rows = s.line.select(F.when(F.col("q") % 9 != 0, F.col("ln") - F.col("q") % 2).alias("p"))
    return rows.groupBy("p", rules.position_error(F.col("p")).alias("error")).agg(F.count("*").alias("rows"))


# ---------------------------------------------------------------- gameweeks and managers


@query("""WITH e AS (SELECT user_id % 13 AS season, event_id AS id, event_id % 3 = 0 AS done, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 2 = 0 END AS checked, event_id % 50 = 7 AS now, event_id % 50 = 8 AS next FROM events)
    SELECT season, min(id) FILTER (WHERE now) AS current, min(id) FILTER (WHERE next) AS next, count(*) FILTER (WHERE done AND coalesce(checked, false)) AS finished, max(id) FILTER (WHERE done AND coalesce(checked, false)) AS last_finished,
    count(*) FILTER (WHERE done) AS finished_unchecked FROM e GROUP BY season""")
def event_marks(s: Star) -> DataFrame:
    key = F.col("event_id")
    events = s.events.select((F.col("user_id") % 13).alias("season"), key.alias("id"), (key % 3 == 0).alias("finished"), F.when(key % 4 != 0, key % 2 == 0).alias("data_checked"), (key % 50 == 7).alias("is_current"), (key % 50 == 8).alias("is_next"))
    return P.event_marks(events, ["season"]).select(
        "season", "current", "next", F.size("finished").cast("bigint").alias("finished"), F.array_max("finished").alias("last_finished"), F.size("finished_unchecked").cast("bigint").alias("finished_unchecked")
    )


@query(f"""WITH m AS (SELECT max(total) AS lead FROM {{standings}}), b AS (SELECT entry, CAST(lead - total AS DOUBLE) AS behind, CAST(entry % 5 AS INT) AS remaining FROM {{standings}} CROSS JOIN m)
    SELECT entry, remaining, round(CASE WHEN remaining > 0 THEN behind / remaining WHEN behind > 0 THEN NULL ELSE 0.0 END, 4) AS urgency,
    round(CASE WHEN behind <= 0 THEN 0.15 WHEN remaining <= 0 THEN 1.15 ELSE least(0.15 + 0.08 * behind / remaining, 1.15) END, 6)::DOUBLE AS appetite FROM b""")
def risk_appetites(s: Star) -> DataFrame:
    """Of every manager against the leader; no weeks left is an infinite urgency, null here."""
    lead = s.standings.agg(F.max("total").alias("lead"))
    rows = s.standings.crossJoin(F.broadcast(lead)).select("entry", (F.col("entry") % 5).cast("int").alias("remaining"), (F.col("lead") - F.col("total")).cast("double").alias("behind"))
    out = rows.withColumns({"u": state.urgency_of(F.col("behind"), F.col("remaining")), "appetite": state.appetite_of(F.col("behind"), F.col("remaining"))})
    return out.select("entry", "remaining", F.when(F.col("u") < float("inf"), F.round("u", 4)).alias("urgency"), F.round("appetite", 6).alias("appetite"))


@query("""SELECT o_orderkey AS id, CASE WHEN x <= 0 THEN 'passed' WHEN x >= 86400 THEN concat(x // 86400, 'd ', x // 3600 % 24, 'h') ELSE concat(x // 3600, 'h ', x % 3600 // 60, 'm') END AS left_text FROM (SELECT o_orderkey, (o_orderkey * 37 - 50000) % 400000 AS x FROM orders) AS y""")
def countdowns(s: Star) -> DataFrame:
    return s.orders.select(F.col("o_orderkey").alias("id"), briefs.countdown((F.col("o_orderkey") * 37 - 50000) % 400000).alias("left_text"))


@query("""SELECT 'numbers' AS feed, CAST(s_nationkey AS VARCHAR) AS team, 'bigint' AS kind, count(*) AS players FROM supplier GROUP BY 2 UNION ALL SELECT 'names', CASE WHEN s_nationkey = 3 THEN n_name ELSE CAST(s_nationkey AS VARCHAR) END, 'string', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 2""")
def team_ids(s: Star) -> DataFrame:
    """Clubs given as text: all of them numbers in one feed, one of them a name in the other."""
    rows = s.supplier.join(s.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_nationkey").cast("string").alias("number"), F.when(F.col("s_nationkey") == 3, F.col("n_name")).otherwise(F.col("s_nationkey").cast("string")).alias("name"))
    out = []
    for feed, c in (("numbers", "number"), ("names", "name")):
        df = minutes.numeric_teams(rows.select(F.col(c).alias("team")))
        out.append(df.groupBy(F.col("team").cast("string").alias("team")).agg(F.count("*").alias("players")).select(F.lit(feed).alias("feed"), "team", F.lit(dict(df.dtypes)["team"]).alias("kind"), "players"))
    return out[0].unionByName(out[1])


# ---------------------------------------------------------------- tables and files


@query("""WITH c(place, name) AS (VALUES (1, 'season'), (2, 'gw'), (3, 'element'), (4, 'name'), (45, 'team_a_score'), (46, 'a_extra'), (47, 'm_extra'), (48, 'z_extra')) SELECT CAST(place AS INT) AS place, name, (SELECT count(*) FROM part) AS rows FROM c""")
def column_order(s: Star) -> DataFrame:
    """The first, the last canonical and the further columns of a season as they come: further ones by name."""
    key = F.col("p_partkey").cast("string")
    raw = s.part.select(key.alias("z_extra"), key.alias("team_a_score"), F.col("p_name").alias("name"), key.alias("GW"), key.alias("element"), key.alias("a_extra"), key.alias("m_extra"))
    out = archive.normalise_season(raw, "2020-21")
    shown = [(k, c) for k, c in enumerate(out.columns, 1) if k <= 4 or k >= 45]
    return out.agg(F.count("*").alias("rows")).select(F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(c).alias("name")) for k, c in shown])).alias("c"), "rows").select("c.place", "c.name", "rows")


@query("""SELECT 'geo/nation' AS name, count(*) AS rows, 4 AS columns, true AS fresh, false AS newest FROM nation UNION ALL SELECT 'geo/region', count(*), 3, true, true FROM region UNION ALL SELECT 'supplier', count(*), 2, true, false FROM supplier""")
def stored_tables(s: Star) -> DataFrame:
    """What a catalog lists of tables saved one after the other."""
    catalog = Catalog(s.spark, scratch(s.spark, "catalog"))
    catalog.save(s.supplier.select("s_suppkey", "s_name"), "supplier")
    catalog.save(s.nation.select("n_nationkey", "n_name", "n_regionkey", F.lit(1).alias("one")), "geo/nation")
    catalog.save(s.region.select("r_regionkey", "r_name", F.lit(None).alias("none")), "geo/region")
    newest = catalog.newest("geo")
    found = [(n, rows, columns, catalog.age_days(n) < 1, n == newest) for n, rows, columns in catalog.describe()]
    return s.spark.createDataFrame(found, "name string, rows long, columns int, fresh boolean, newest boolean")


@query("""SELECT form, p_partkey AS id, concat('José Muñoz ', p_name) AS name FROM part CROSS JOIN (VALUES ('UTF-8'), ('ISO-8859-1')) AS t(form)""")
def csv_encodings(s: Star) -> DataFrame:
    """The same names in files of two encodings, each found out from its bytes."""
    rows = s.part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("José Muñoz "), F.col("p_name")).alias("name"))
    out = []
    for form in ("UTF-8", "ISO-8859-1"):
        folder = scratch(s.spark, "csv")
        rows.write.option("header", True).option("encoding", form).csv(folder)
        out.append(archive.read_csv(s.spark, folder).select(F.lit(form).alias("form"), F.col("id").cast("bigint").alias("id"), "name"))
    return out[0].unionByName(out[1])
