"""What reports are made of: each block a DataFrame, collected only when it is rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import league
from ..operators.order import quantile


def squad_rows(picks: DataFrame, elements: DataFrame, teams: DataFrame, entry: int, gw: int) -> DataFrame:
    """A manager's squad of a gameweek by slot, with what a page shows of each player; slots after the eleventh are benched."""
    own = picks.where((F.col("entry") == entry) & (F.col("gw") == gw))
    facts = elements.select(
        F.col("id").alias("player_id"), F.col("web_name").alias("name"), F.col("team").alias("team_id"), F.col("element_type").alias("position"), (F.col("now_cost") / 10).alias("price"), F.col("total_points").alias("points"), "minutes",
        F.coalesce("status", F.lit("a")).alias("status"), F.trim(F.coalesce("news", F.lit(""))).alias("news"), F.coalesce(F.col("selected_by_percent").try_cast("double"), F.lit(0.0)).alias("selected_by"),
    )
    names = teams.select(F.col("id").alias("team_id"), F.col("short_name").alias("team"))
    rows = own.join(facts, own["element"] == facts["player_id"]).join(names, "team_id", "left").withColumn("team", F.coalesce("team", F.lit("???")))
    shown = ("player_id", "name", "team", "position", "price", "points", "minutes", "status", "news", "selected_by", "slot", "is_captain", "is_vice_captain")
    return rows.select(*shown, (F.col("slot") > 11).alias("benched")).orderBy("slot")


def fixture_rows(fixtures: DataFrame, teams: DataFrame) -> DataFrame:
    """(kickoff, home, away, home_difficulty, away_difficulty), kickoff as text to the minute, empty where it is not set."""
    side = lambda c: teams.select(F.col("id").alias(f"team_{c}"), F.col("short_name").alias(f"name_{c}"))
    rows = fixtures.join(side("h"), "team_h", "left").join(side("a"), "team_a", "left")
    kickoff = F.replace(F.substring(F.coalesce("kickoff_time", F.lit("")), 1, 16), F.lit("T"), F.lit(" "))
    named = lambda c: F.coalesce(f"name_{c}", F.lit("???"))
    return rows.select(kickoff.alias("kickoff"), named("h").alias("home"), named("a").alias("away"), F.col("team_h_difficulty").alias("home_difficulty"), F.col("team_a_difficulty").alias("away_difficulty")).orderBy("kickoff")


def deadline(events: DataFrame, gw: int) -> DataFrame:
    """One row (deadline): the gameweek's, null where there is no such gameweek."""
    return events.where(F.col("id") == gw).agg(F.min(F.try_to_timestamp("deadline_time")).alias("deadline"))


def countdown(seconds: Column) -> Column:
    """report.countdown() of a column of whole seconds."""
    part = lambda size, of=None: F.floor((seconds % of if of else seconds) / size).cast("string")
    return F.when(seconds <= 0, "passed").when(seconds >= 86400, F.concat(part(86400), F.lit("d "), part(3600, 86400), F.lit("h"))).otherwise(F.concat(part(3600), F.lit("h "), part(60, 3600), F.lit("m")))


def overview(standings: DataFrame, user: int, remaining: int) -> DataFrame:
    """One row: managers, the totals of leader, median, mean and last, and the user's place and total."""
    mine = standings.where(F.col("entry") == user).agg(F.max("rank").alias("user_rank"), F.max("total").alias("user_total"))
    facts = standings.agg(F.count("*").alias("managers"), F.max("total").alias("leader"), F.lit(quantile(standings, "total", 0.5)).cast("double").alias("median"), F.avg("total").alias("mean"), F.min("total").alias("last"))
    return league.with_scalars(facts, mine).withColumn("remaining", F.lit(remaining))


def orphans(standings: DataFrame, picks: DataFrame, user: int, gw: int, top_n: int = 10) -> DataFrame:
    """(element): the user's players that nobody among the leaders has."""
    shared = league.transfer_targets(standings, picks, user, gw, top_n, owned_by_user=True)
    return picks.where((F.col("gw") == gw) & (F.col("entry") == user)).select("element").distinct().join(shared, "element", "left_anti")


def takeaways(swings: DataFrame, overlaps: DataFrame, gaps: DataFrame) -> DataFrame:
    """(topic, value): the greatest gain and loss, the rival most alike, and what the leader must be beaten by each gameweek."""
    best, worst = F.max_by("element", F.struct("swing", -F.col("element"))), F.min_by("element", F.struct("swing", "element"))
    rows = swings.agg(best.alias("b"), worst.alias("w")).select(F.expr("stack(2, 'greatest gain', b, 'greatest loss', w)").alias("topic", "value"))
    alike = overlaps.agg(F.max_by("entry", F.struct("shared_squad", -F.col("rank"))).alias("value")).select(F.lit("rival most alike").alias("topic"), "value")
    edge = gaps.where("label = '1st'").select(F.lit("points a gameweek on the leader").alias("topic"), F.round("per_gw", 2).alias("value"))
    text = lambda df: df.select("topic", F.col("value").cast("string").alias("value"))
    return text(rows).unionByName(text(alike)).unionByName(text(edge))


def league_blocks(tables: dict[str, DataFrame], players: DataFrame, live: DataFrame, final: DataFrame, user: int, gw: int, *, remaining: int, top_n: int = 10) -> dict[str, DataFrame]:
    """The ten blocks of a league report, in order. tables: payloads.league_tables(); transfers may be among them."""
    standings, picks, weeks = tables["standings"], tables["picks"], tables["manager_gw"]
    weights = league.threat_weights(standings, user)
    settled = league.effective_multipliers(picks, tables["auto_subs"], live, final)
    swings = league.player_swings(settled, live, weights, standings, user)
    owned = league.ownership_table(standings, picks, weights, gw, user)
    named = players.select("element", "name", "team", "position")
    overlaps, gaps = league.squad_overlap(standings, picks, user, gw), league.gap_targets(standings, user, remaining)
    moves = tables.get("transfers")
    moves = picks.sparkSession.createDataFrame([], "entry long, gw int, element_in long, element_out long") if moves is None else moves
    position = league.user_position(swings, owned).where("kind is not null").join(named, "element")
    return {
        "Overview": overview(standings, user, remaining),
        "Totals that do not add up": league.verify_totals(standings, league.gameweek_scores(settled, live), weeks).where("delta <> 0").orderBy("entry"),
        "Ownership": owned.join(named, "element").orderBy(F.desc("eo_pct"), "element"),
        "Your position": position.orderBy("kind", F.desc("swing"), "element"),
        "Targets": league.transfer_targets(standings, picks, user, gw, top_n).join(named, "element").orderBy(F.desc("group_owners"), "element"),
        "Gaps": gaps,
        "Overlap": overlaps.orderBy("rank"),
        "Rivals": league.profiles(standings, picks, weeks, moves, tables["chips"], weights, user, gw).drop("squad").orderBy("rank"),
        "Your squad": league.squad_lines(standings, picks, players, live, gw).where(F.col("entry") == user).orderBy("place").select("line"),
        "Takeaways": takeaways(swings, overlaps, gaps),
    }
