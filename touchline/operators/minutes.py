"""Playing time: priors by position and early involvement, and shrunken estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.names import player_key

#: Positions of the season archive.
POSITION_CODES = {"GK": 1, "DEF": 2, "MID": 3, "FWD": 4}
#: Minutes assumed where no row shows any.
MINUTES_STARTED, MINUTES_SUB = 80.0, 22.0
#: Availability of a doubtful status whose chance is not given.
DOUBT = {"d": 0.75, "i": 0.10, "s": 0.10}
PRIOR_COLUMNS = ("position", "bucket", "p_play", "p_start", "minutes_started", "minutes_sub", "n_player_seasons")
#: Chance to play by position after having started, come on or not played, and what goes with each of those.
FALLBACK_PLAY = {1: (0.90, 0.30, 0.03), 2: (0.82, 0.25, 0.06), 3: (0.75, 0.30, 0.08), 4: (0.72, 0.32, 0.09)}
FALLBACK_BUCKETS = (("started", 0.92, 84.0, 24.0), ("subbed", 0.35, 75.0, 20.0), ("unused", 0.5, 70.0, 18.0))


def fallback_priors(spark: SparkSession) -> DataFrame:
    """The twelve priors that stand where history has none."""
    rows = [
        (p, b, play, play * starts, m_start, m_sub, 0)
        for p, plays in FALLBACK_PLAY.items() for play, (b, starts, m_start, m_sub) in zip(plays, FALLBACK_BUCKETS)
    ]
    return spark.createDataFrame(rows, "position int, bucket string, p_play double, p_start double, minutes_started double, minutes_sub double, n_player_seasons long")


def position_code(label: Column) -> Column:
    return F.create_map(*[F.lit(x) for p in POSITION_CODES.items() for x in p])[label]


def appearance_bucket(played: Column, started: Column) -> Column:
    return F.when(started > 0, "started").when(played > 0, "subbed").otherwise("unused")


def availability(status: Column, chance: Column) -> Column:
    """Multiplier in [0, 1]: 0 for the gone, the given chance (or a default) for the doubtful, 1 otherwise."""
    default = F.create_map(*[F.lit(x) for p in DOUBT.items() for x in p])[status]
    given = F.when(chance.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), chance.cast("double"))) / 100.0)
    return F.when(status.isin("u", "n"), 0.0).when(status.isin(*DOUBT), F.coalesce(given, default)).otherwise(1.0)


def position_priors(history: DataFrame, early_gws: int = 2, fallback: DataFrame | None = None) -> DataFrame:
    """PRIOR_COLUMNS: how much players of a position play later in a season, by what they did in its first gameweeks.

    history: season, element, gw, position (1 to 4), minutes, starts. Two
    aggregations: by player and season, then by position and bucket.
    """
    early, late = F.col("gw") <= early_gws, F.col("gw") > early_gws
    played, started = F.col("minutes") > 0, F.coalesce("starts", F.lit(0)) > 0
    subbed = played & ~started
    total = lambda cond, value=F.lit(1): F.sum(F.when(cond, value).otherwise(0))
    seasons = history.na.drop(subset=["position", "minutes", "gw"]).groupBy("season", "element").agg(
        F.min_by(F.when(early, F.col("position")), F.col("gw")).alias("position"), F.count_if(early).alias("n_early"), F.count_if(late).alias("n_late"),
        F.count_if(early & played).alias("early_played"), F.count_if(early & started).alias("early_started"),
        F.count_if(late & played).alias("played"), F.count_if(late & started).alias("started"), total(late & started, F.col("minutes")).alias("m_started"),
        F.count_if(late & subbed).alias("subbed"), total(late & subbed, F.col("minutes")).alias("m_sub"),
    ).where("n_early > 0 and n_late > 0")
    share = lambda a, b, none=None: F.coalesce(F.try_divide(F.sum(a).cast("double"), F.sum(b)), F.lit(none))
    found = seasons.groupBy(F.col("position").cast("int").alias("position"), appearance_bucket(F.col("early_played"), F.col("early_started")).alias("bucket")).agg(
        share("played", "n_late").alias("p_play"), share("started", "n_late").alias("p_start"), share("m_started", "started", MINUTES_STARTED).alias("minutes_started"),
        share("m_sub", "subbed", MINUTES_SUB).alias("minutes_sub"), F.count("*").alias("n_player_seasons"),
    ).select(*PRIOR_COLUMNS)
    if fallback is None:
        return found
    return found.unionByName(fallback.join(found.select("position", "bucket"), ["position", "bucket"], "left_anti").select(*PRIOR_COLUMNS))


def player_priors(history: DataFrame, key: Column, min_games: int = 5) -> DataFrame:
    """(name_key, prior_games, p_play_obs, p_start_obs) of those seen often enough; by name, since ids change every season."""
    played, started = F.col("minutes") > 0, F.coalesce("starts", F.lit(0)) > 0
    return history.where("minutes is not null").groupBy(key.alias("name_key")).agg(
        F.count("*").alias("prior_games"), F.avg(played.cast("double")).alias("p_play_obs"), F.avg(started.cast("double")).alias("p_start_obs")
    ).where((F.col("prior_games") >= min_games) & F.col("name_key").isNotNull())


def estimate_minutes(
    elements: DataFrame, so_far: DataFrame, n_gws: int, priors: DataFrame, by_player: DataFrame | None = None, *, prior_weight: float = 6.0, pseudo: float = 2.0
) -> DataFrame:
    """player_id, position, team, price, status, p_play, p_start, p_sub, exp_minutes, minutes_if_started, minutes_if_sub.

    elements: id, full_name, element_type, team, now_cost, status,
    chance_of_playing_next_round. so_far: element, minutes, starts of the gameweeks
    played. Own counts are shrunk by pseudo gameweeks of the prior, which a player's
    earlier record replaces by games / (games + prior_weight). Only missing counts are filled
    with 0; a chance that is not given stays so.
    """
    played, started = F.col("minutes") > 0, F.coalesce("starts", F.lit(0)) > 0
    own = so_far.groupBy(F.col("element").alias("id")).agg(
        F.count_if(played).alias("gp"), F.count_if(started).alias("gs"), F.count_if(started).alias("n_started"), F.sum(F.when(started, F.col("minutes"))).alias("m_started"),
        F.count_if(played & ~started).alias("n_sub"), F.sum(F.when(played & ~started, F.col("minutes"))).alias("m_sub"),
    )
    counts = ["gp", "gs", "n_started", "m_started", "n_sub", "m_sub"]
    rows = elements.join(own, "id", "left").na.fill(0, counts).withColumn("position", F.col("element_type").cast("int"))
    rows = rows.withColumn("bucket", appearance_bucket(F.col("gp"), F.col("gs"))).join(
        F.broadcast(priors.select("position", "bucket", *[F.col(c).alias(f"{c}_prior") for c in ("p_play", "p_start", "minutes_started", "minutes_sub")])), ["position", "bucket"], "left"
    )
    prior = {c: F.col(f"{c}_prior") for c in ("p_play", "p_start", "minutes_started", "minutes_sub")}
    if by_player is not None:
        rows = rows.withColumn("name_key", player_key(F.col("full_name"))).join(by_player, "name_key", "left")
        weight = F.col("prior_games") / (F.col("prior_games") + prior_weight)
        for c in ("p_play", "p_start"):
            prior[c] = F.coalesce(weight * F.col(f"{c}_obs") + (1 - weight) * prior[c], prior[c])
    shrunk = lambda count, c: (F.col(count) + pseudo * prior[c]) / (n_gws + pseudo) if n_gws > 0 else prior[c]
    play = shrunk("gp", "p_play")
    start = F.least(shrunk("gs", "p_start"), play)
    minutes = lambda n, m, c: (F.col(m) + pseudo * prior[c]) / (F.col(n) + pseudo)
    able = availability(F.col("status"), F.col("chance_of_playing_next_round"))
    out = rows.select(
        F.col("id").alias("player_id"), "position", "team", F.coalesce(F.col("now_cost").cast("int"), F.lit(0)).alias("price"), "status",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), play * able)).alias("p_play"), F.greatest(F.lit(0.0), start * able).alias("__start"),
        minutes("n_started", "m_started", "minutes_started").alias("minutes_if_started"), minutes("n_sub", "m_sub", "minutes_sub").alias("minutes_if_sub"),
    ).withColumn("p_start", F.least("__start", "p_play")).withColumn("p_sub", F.greatest(F.lit(0.0), F.col("p_play") - F.col("p_start")))
    exp = F.col("p_start") * F.col("minutes_if_started") + F.col("p_sub") * F.col("minutes_if_sub")
    return out.withColumn("exp_minutes", exp).drop("__start")


def numeric_teams(df: DataFrame, column: str = "team") -> DataFrame:
    """df with clubs as numbers if every one of them is a whole number, else as they are."""
    named = df.where(F.col(column).isNotNull() & F.col(column).cast("string").try_cast("bigint").isNull())
    return df.withColumn(column, F.col(column).cast("bigint")) if named.isEmpty() else df
