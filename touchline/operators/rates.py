"""Per-90 rates: price tiers, moment-matched priors, posteriors and name matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


STATS = ("goals_scored", "assists", "clearances_blocks_interceptions", "tackles", "recoveries", "saves")
DEFENSIVE = ("clearances_blocks_interceptions", "tackles", "recoveries")
#: Full minutes from which a player-season says something about the spread, and how many must.
MOMENT_MINUTES, MOMENT_ROWS = 180, 8
N0_FEW, N0_NONE, N0_LEAST, N0_MOST = 6.0, 4.0, 2.0, 30.0
#: Mean rates by position where history has none; 0.2 for others.
FALLBACK_MU = {
    (1, "saves"): 1.0,
    (2, "goals_scored"): 0.05, (2, "assists"): 0.05, (2, "clearances_blocks_interceptions"): 1.3, (2, "tackles"): 0.6, (2, "recoveries"): 2.2,
    (3, "goals_scored"): 0.12, (3, "assists"): 0.10, (3, "clearances_blocks_interceptions"): 0.5, (3, "tackles"): 0.5, (3, "recoveries"): 1.8,
    (4, "goals_scored"): 0.30, (4, "assists"): 0.10, (4, "clearances_blocks_interceptions"): 0.15, (4, "tackles"): 0.3, (4, "recoveries"): 1.2,
}


def price_edges(rows: DataFrame, tiers: int = 3) -> DataFrame:
    """(position, edges): the distinct quantiles that part a position's prices, of rows with minutes; at least two."""
    at = F.array(*[F.lit(k / tiers) for k in range(tiers + 1)])
    edges = F.array_distinct(F.percentile("value", at))
    found = rows.where("minutes > 0 and value is not null").groupBy("position").agg(edges.alias("e"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return found.select("position", F.when(F.size("e") < 2, F.array(F.col("lo") - 1.0, F.col("hi") + 1.0)).otherwise(F.col("e")).alias("edges"))


def tier(price: Column, edges: Column) -> Column:
    """Index of the tier a price falls in, those beyond the edges in the outer tiers."""
    below = F.size(F.filter(edges, lambda e: e <= price)) - 1
    return F.greatest(F.lit(0), F.least(below, F.size(edges) - 2))


def fallback_mu(position: Column, stat: Column) -> Column:
    table = F.create_map(*[x for (p, s), v in FALLBACK_MU.items() for x in (F.lit(f"{p}:{s}"), F.lit(v))])
    return F.coalesce(F.try_element_at(table, F.concat_ws(":", position.cast("string"), stat)), F.lit(0.2))


def by_stat(stats: dict[str, Column]) -> Column:
    """A row per statistic, with the fields of its struct: rows stay where they lie, which an unpivot does not say."""
    return F.inline(F.array(*[F.struct(F.lit(s).alias("stat"), x.alias("x")) for s, x in stats.items()]))


def player_seasons(rows: DataFrame, stats: tuple[str, ...] = STATS) -> DataFrame:
    """(season, element, position, stat, events, minutes, price) of rows (season, element, position, value, minutes, stats...); keepers only save, others never.

    Statistics are summed as columns, each over the rows where it is not null, and become rows afterwards.
    """
    keys = ["season", "element", "position"]
    known = lambda s, c: F.when(F.col(s).isNotNull(), F.col(c))
    wide = rows.na.drop(subset=["position", "value", "minutes"]).groupBy(*keys).agg(*[
        f.alias(f"{s}_{n}") for s in stats for n, f in (("events", F.sum(s)), ("minutes", F.sum(known(s, "minutes"))), ("price", F.avg(known(s, "value"))))
    ])
    long = wide.select(*keys, by_stat({s: F.struct(*[F.col(f"{s}_{n}").alias(n) for n in ("events", "minutes", "price")]) for s in stats}))
    return long.where(((F.col("position") == 1) == (F.col("stat") == "saves")) & (F.col("x.minutes") > 0)).select(*keys, "stat", "x.*")


def rate_priors(seasons: DataFrame, edges: DataFrame) -> DataFrame:
    """(position, tier, stat, mu, n0, n_players) by moments, all in one aggregation.

    mu is events over exposure; the variance of the rates weighted by
    exposure, less what Poisson sampling explains, gives n0 = mu / variance
    within bounds. Weighted moments come from sums of w, w r and w r squared.
    """
    x = F.col("minutes") / 90.0
    rate = F.col("events") / x
    enough = F.col("minutes") >= MOMENT_MINUTES
    some = lambda c: F.sum(F.when(enough, c))
    sums = seasons.join(F.broadcast(edges), "position").groupBy("position", tier(F.col("price"), F.col("edges")).alias("tier"), "stat").agg(
        F.greatest(F.try_divide(F.sum("events").cast("double"), F.sum(x)), F.lit(1e-4)).alias("mu"), F.count_if(enough).alias("n"),
        some(x).alias("w"), some(x * rate).alias("wr"), some(x * rate * rate).alias("wrr"), F.count_distinct("element").alias("n_players"),
    )
    mean = F.col("wr") / F.col("w")
    spread = F.col("wrr") / F.col("w") - mean * mean - F.col("mu") * F.col("n") / F.col("w")
    n0 = F.col("mu") / F.greatest(spread, F.col("mu") * F.col("mu") / 50.0)
    clipped = F.greatest(F.lit(N0_LEAST), F.least(F.lit(N0_MOST), n0))
    return sums.select("position", "tier", "stat", "mu", F.when(F.col("n") < MOMENT_ROWS, N0_FEW).otherwise(clipped).alias("n0"), "n_players")


def posterior_rates(players: DataFrame, priors: DataFrame, edges: DataFrame, provider: DataFrame | None = None, stats: tuple[str, ...] = STATS, blend: float = 0.5) -> DataFrame:
    """player_id and <stat>_p90: (n0 mu + events) / (n0 + exposure).

    players: player_id, position, price, minutes and the statistics so far. provider: player_id,
    xg, xa, which are averaged into goals and assists. Keepers have saves only, others none.
    """
    rows = players if provider is None else players.join(provider.select("player_id", "xg", "xa"), "player_id", "left")
    mixed = lambda stat, x: F.coalesce((1 - blend) * F.col(stat) + blend * F.col(x), F.col(stat).cast("double")) if provider is not None else F.col(stat).cast("double")
    events = {s: mixed(s, {"goals_scored": "xg", "assists": "xa"}[s]) if s in ("goals_scored", "assists") else F.col(s).cast("double") for s in stats}
    exposure = (F.greatest(F.lit(0), F.col("minutes")) / 90.0).alias("__exposure")
    long = rows.select("player_id", "position", "price", exposure, by_stat({s: F.greatest(F.lit(0.0), e) for s, e in events.items()})).withColumnsRenamed({"x": "events", "__exposure": "x"})
    placed = long.join(F.broadcast(edges), "position", "left").withColumn("tier", F.coalesce(tier(F.col("price"), F.col("edges")), F.lit(0)))
    known = placed.join(F.broadcast(priors.select("position", "tier", "stat", "mu", "n0")), ["position", "tier", "stat"], "left")
    mu, n0 = F.coalesce("mu", fallback_mu(F.col("position"), F.col("stat"))), F.coalesce("n0", F.lit(N0_FEW))
    rate = (n0 * mu + F.coalesce("events", F.lit(0.0))) / (n0 + F.col("x"))
    own = (F.col("position") == 1) == (F.col("stat") == "saves")
    wide = known.withColumn("rate", F.when(own, rate).otherwise(0.0)).groupBy("player_id").pivot("stat", list(stats)).agg(F.first("rate"))
    return wide.select("player_id", *[F.col(s).alias(f"{s}_p90") for s in stats])


def card_rates(rows: DataFrame) -> DataFrame:
    """(position, yellow_p90, red_p90, own_goal_p90)."""
    per90 = lambda c: F.try_divide(F.sum(c).cast("double"), F.sum("minutes") / 90.0)
    return rows.where("minutes > 0 and position is not null").groupBy("position").agg(
        F.coalesce(per90("yellow_cards"), F.lit(0.08)).alias("yellow_p90"), F.coalesce(per90("red_cards"), F.lit(0.003)).alias("red_p90"),
        F.coalesce(per90("own_goals"), F.lit(0.002)).alias("own_goal_p90"),
    )


def assisted_fraction(rows: DataFrame) -> DataFrame:
    """One row (fraction): assists over goals between .3 and .95; .65 without goals."""
    share = F.try_divide(F.sum("assists").cast("double"), F.sum("goals_scored"))
    return rows.agg(F.coalesce(F.greatest(F.lit(0.3), F.least(F.lit(0.95), share)), F.lit(0.65)).alias("fraction"))


def one_club(provider: DataFrame, team: str = "team_title") -> DataFrame:
    """Rows of a provider whose club is one club: a player who moved has a list of them, and is matched by neither."""
    return provider.where(F.coalesce(~F.col(team).contains(","), F.lit(True)))


def name_match(left: DataFrame, right: DataFrame, *, id_col: str = "id", row_col: str = "row_id", by_name: bool = True) -> DataFrame:
    """(id, row_id): left rows (id, name_key, team_key) matched with right rows (row_id, name_key, team_key).

    By name and team; of what is left, unless by_name is false, by a name that is unique among
    it and on the right. One row per id, team matches first, then the smallest row_id. Rows of
    several clubs should be left out first: one_club().
    """
    # The right side's least row of a key is all that can be taken, so no rows are paired.
    least = right.groupBy("name_key", "team_key").agg(F.min(row_col).alias(row_col))
    both = left.join(least, ["name_key", "team_key"]).select(id_col, row_col, F.lit(0).alias("pass"))
    taken = lambda df: df.groupBy(id_col).agg(F.min(F.struct("pass", row_col)).alias("__m")).select(id_col, F.col("__m")[row_col].alias(row_col))
    if not by_name:
        return taken(both)
    rest = left.join(both.select(id_col).distinct(), id_col, "left_anti")
    once = lambda df: df.groupBy("name_key").agg(F.count("*").alias("n")).where("n = 1").select("name_key")
    names = once(rest).join(once(right), "name_key")
    extra = rest.join(names, "name_key").join(right.select(row_col, "name_key"), "name_key").select(id_col, row_col, F.lit(1).alias("pass"))
    return taken(both.unionByName(extra))
