"""Price snapshots and availability risks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SNAPSHOT = (
    "ts", "player_id", "web_name", "team", "position", "now_cost", "cost_change_start", "cost_change_event", "transfers_in_event", "transfers_out_event",
    "net_transfers_event", "selected_by_percent", "hourly_rate", "proj_pct_today", "proj_likelihood_today", "proj_pct_tomorrow", "locked_until", "calibrating", "status",
)
#: Meanings of the status codes, and the order of severities.
STATUS = {"a": "available", "d": "doubtful", "i": "injured", "s": "suspended", "u": "unavailable", "n": "not in squad"}
SEVERITY = ("critical", "high", "medium", "low")


def projection_at(projections: Column, offset: int) -> Column:
    """The first projection (offset, projected_percent, likelihood) of a day; null without one."""
    return F.try_element_at(F.filter(projections, lambda p: p["offset"] == offset), F.lit(1))


def price_rows(elements: DataFrame, taken_at: Column) -> DataFrame:
    """SNAPSHOT columns of the players' payload."""
    today, tomorrow = projection_at(F.col("price_change_projections"), 0), projection_at(F.col("price_change_projections"), 1)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return elements.select(
        taken_at.alias("ts"), F.col("id").alias("player_id"), "web_name", "team", F.col("element_type").alias("position"), "now_cost",
        zero("cost_change_start").alias("cost_change_start"), zero("cost_change_event").alias("cost_change_event"),
        zero("transfers_in_event").alias("transfers_in_event"), zero("transfers_out_event").alias("transfers_out_event"),
        (zero("transfers_in_event") - zero("transfers_out_event")).alias("net_transfers_event"),
        F.coalesce(F.col("selected_by_percent").try_cast("double"), F.lit(0.0)).alias("selected_by_percent"), F.col("price_change_hourly_rate").alias("hourly_rate"),
        today["projected_percent"].try_cast("double").alias("proj_pct_today"), today["likelihood"].alias("proj_likelihood_today"),
        tomorrow["projected_percent"].try_cast("double").alias("proj_pct_tomorrow"), F.col("price_change_locked_until").alias("locked_until"),
        F.coalesce("price_change_calibrating", F.lit(False)).alias("calibrating"), "status",
    )


def deduplicate(rows: DataFrame, keys: list[str], order: list[Column], last: bool = True) -> DataFrame:
    """The last (or first) row of each key in the given order, which should name every row that is to differ."""
    by = [c.desc() if last else c.asc() for c in order]
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).where("__r = 1").drop("__r")


def latest_snapshot(history: DataFrame) -> DataFrame:
    """Rows of the newest time; the maximum is one row that the filter is joined with."""
    return history.join(F.broadcast(history.agg(F.max("ts").alias("ts"))), "ts", "left_semi")


def distinct_snapshots(history: DataFrame) -> DataFrame:
    """One row (snapshots, rows)."""
    return history.agg(F.count_distinct("ts").alias("snapshots"), F.count("*").alias("rows"))


def movers(frame: DataFrame, threshold: float = 75.0) -> DataFrame:
    """Players near a price change with its direction, the nearest first; locked and calibrating prices are left out."""
    near = (F.abs("proj_pct_today") >= threshold) & ~F.col("calibrating") & F.col("locked_until").isNull()
    return frame.where(near).withColumn("direction", F.when(F.col("proj_pct_today") > 0, "rise").otherwise("fall")).orderBy(F.desc(F.abs("proj_pct_today")), "player_id")


def minutes_trend(history: DataFrame) -> DataFrame:
    """(player_id, first, last, weeks, series) of rows (player_id, gw, minutes)."""
    ordered = F.array_sort(F.collect_list(F.struct("gw", "minutes")))
    return history.groupBy("player_id").agg(F.min_by("minutes", "gw").alias("first"), F.max_by("minutes", "gw").alias("last"), F.count("*").alias("weeks"), F.transform(ordered, lambda x: x["minutes"]).alias("series"))


def scan_risks(elements: DataFrame, gws_played: int, trend: DataFrame | None = None, prices: DataFrame | None = None, intended_bench: DataFrame | None = None) -> DataFrame:
    """(player_id, web_name, team, position, price, severity, kind, detail, needs_check), a row per risk.

    All tests are one array of structs per player, exploded: flagged
    status, no or few minutes although available (unless meant for the bench), dropped from
    the first to the last gameweek, and heavy selling.
    """
    rows = elements.withColumns({"player_id": F.col("id"), "price": F.col("now_cost") / 10, "position": F.col("element_type"), "minutes": F.coalesce("minutes", F.lit(0)), "status": F.coalesce("status", F.lit("a"))})
    if intended_bench is not None:
        rows = rows.join(intended_bench.select("player_id", F.lit(True).alias("__bench")), "player_id", "left")
    benched = F.coalesce("__bench", F.lit(False)) if intended_bench is not None else F.lit(False)
    price, minutes, status, chance = F.col("price"), F.col("minutes"), F.col("status"), F.col("chance_of_playing_next_round")
    full = gws_played * 90
    gone = F.coalesce((status == "u") | (chance == 0), F.lit(False))
    risk = lambda severity, kind, detail, check: F.struct(severity.alias("severity"), F.lit(kind).alias("kind"), detail.alias("detail"), check.alias("needs_check"))
    meaning = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in STATUS.items() for x in p]), status), F.lit("unknown"))
    shown = F.coalesce(chance.cast("string"), F.lit("None"))
    news = F.when(F.coalesce("news", F.lit("")) == "", "no news text").otherwise(F.trim("news"))
    idle = (status == "a") & F.lit(gws_played >= 2) & (minutes == 0) & ~benched
    few = (status == "a") & F.lit(full > 0) & (minutes < 0.5 * full) & ~benched & ~idle
    share = F.round(100.0 * minutes / full, 0).cast("int") if full else F.lit(0)
    tests = [
        F.when(status != "a", risk(F.when(gone, "critical").otherwise("high"), "flagged", F.format_string("status=%s (%s), chance_next=%s. %s", status, meaning, shown, news), ~gone)),
        F.when(idle, risk(F.when(price >= 6.0, "critical").otherwise("high"), "zero-minutes", F.format_string("available but 0 minutes in %d gameweeks", F.lit(gws_played)), F.lit(True))),
        F.when(few, risk(F.when(price >= 5.5, "high").otherwise("medium"), "low-minutes", F.format_string("%d of %d minutes (%d%%)", minutes, F.lit(full), share), price >= 5.5)),
    ]
    if trend is not None:
        rows = rows.join(trend, "player_id", "left")
        dropped = (F.col("weeks") >= 2) & (F.col("first") >= 45) & (F.col("last") == 0)
        tests.append(F.when(dropped, risk(F.lit("high"), "dropped", F.format_string("from %d minutes to 0: [%s]", "first", F.array_join(F.col("series").cast("array<string>"), ", ")), F.lit(True))))
    if prices is not None:
        rows = rows.join(prices.select("player_id", "hourly_rate", "proj_pct_today"), "player_id", "left")
        tests.append(F.when(F.col("hourly_rate") < -500, risk(F.lit("medium"), "market-selling", F.format_string("hourly rate %d, projection %s", "hourly_rate", F.col("proj_pct_today").cast("string")), F.lit(True))))
    out = rows.select("player_id", "web_name", "team", "position", "price", F.explode(F.array_compact(F.array(*tests))).alias("r")).select("player_id", "web_name", "team", "position", "price", "r.*")
    return out.orderBy(F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("severity")), F.desc("price"), "player_id")


def backup_keepers(squad: DataFrame) -> DataFrame:
    """(player_id) of all keepers but the one with most minutes, who are meant to sit; of squad(player_id, position, minutes)."""
    place = F.row_number().over(W.orderBy(F.desc("minutes"), "player_id"))
    return squad.where("position = 1").withColumn("__r", place).where("__r > 1").select("player_id")


def squad_risks(elements: DataFrame, squad: DataFrame, gws_played: int, **more) -> DataFrame:
    """scan_risks() of a squad(player_id), its backup keeper being meant for the bench."""
    own = elements.join(squad.select(F.col("player_id").alias("id")), "id", "left_semi")
    bench = backup_keepers(own.select(F.col("id").alias("player_id"), F.col("element_type").alias("position"), F.coalesce("minutes", F.lit(0)).alias("minutes")))
    return scan_risks(own, gws_played, intended_bench=bench, **more)


def open_questions(risks: DataFrame) -> DataFrame:
    """A question for each risk that a person should look at."""
    ask = {"flagged": "Will %s be fit?", "zero-minutes": "Why has %s not played?", "low-minutes": "Is %s rotated or unfit?", "dropped": "Why was %s dropped?", "market-selling": "What do the sellers of %s know?"}
    text = F.lit("What about %s?")
    for kind, q in ask.items():
        text = F.when(F.col("kind") == kind, q).otherwise(text)
    return risks.where("needs_check").select("player_id", "kind", F.replace(text, F.lit("%s"), F.col("web_name")).alias("question"))
