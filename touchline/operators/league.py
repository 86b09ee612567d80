"""Mini-league analytics over normalised tables.

Tables: standings(entry, entry_name, player_name, rank, total),
picks(entry, gw, element, slot, multiplier, is_captain, is_vice_captain),
auto_subs(entry, gw, element_out, element_in), manager_gw(entry, gw, points,
value, bank, hits, points_on_bench), chips(entry, name, gw), transfers(entry,
gw, element_in, element_out), live(gw, element, points, minutes),
players(element, name, team, position, price, global_owned_pct), final(gw).
"""

from __future__ import annotations

from math import floor

from pyspark.sql import DataFrame, Window as W, functions as F

from .order import quantile

SCHEMES = ("uniform", "rank", "gap", "contention")


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """df with the columns of a global aggregate, whose single row is what is broadcast."""
    return df.crossJoin(F.broadcast(one_row))


# ---------------------------------------------------------------- weights


def threat_weights(standings: DataFrame, user: int, scheme: str = "contention", tau: float | None = None, exclude_user: bool = True) -> DataFrame:
    """(entry, weight), weights adding up to 1: how much each manager matters for winning the league.

    uniform; rank: falling by rank; gap: points ahead of the user;
    contention: exp(-(leader - total) / tau), tau the standard deviation
    of the totals, at least 1. Where all weigh nothing, all weigh the same.
    """
    if scheme not in SCHEMES:
        raise ValueError(f"unknown scheme {scheme!r}")
    rows = standings.where(F.col("entry") != user) if exclude_user else standings
    mine = standings.where(F.col("entry") == user).agg(F.coalesce(F.max("total"), F.lit(0)).alias("__mine"))
    facts = rows.agg(F.count("*").alias("__n"), F.max("total").alias("__lead"), F.coalesce(F.stddev_samp("total"), F.lit(0.0)).alias("__sd"))
    n, behind = F.col("__n"), (F.col("__lead") - F.col("total")).cast("double")
    scale = F.lit(float(tau)) if tau is not None else F.greatest(F.lit(1.0), F.col("__sd"))
    raw = {
        "uniform": F.lit(1.0),
        "rank": F.greatest(F.lit(0.0), (n - F.col("rank") + 1) / n),
        "gap": F.greatest(F.lit(0.0), (F.col("total") - F.col("__mine")).cast("double")),
        "contention": F.exp(-behind / scale),
    }[scheme]
    weighed = with_scalars(with_scalars(rows, facts), mine).select("entry", raw.alias("__w"), n.alias("__n"))
    total = weighed.agg(F.sum("__w").alias("__sum"))
    return with_scalars(weighed, total).select(
        "entry", F.when(F.col("__sum") > 0, F.col("__w") / F.col("__sum")).otherwise(1.0 / F.col("__n")).alias("weight")
    )


# ---------------------------------------------------------------- ownership


def ownership_table(standings: DataFrame, picks: DataFrame, weights: DataFrame, gw: int | None = None, user: int | None = None) -> DataFrame:
    """Per element owned by anyone: owners and percentages of the league.

    owned, started, captained; effective ownership (owned + captained), the
    same by multipliers, and both of the first kind by threat weight.
    """
    rows = picks if gw is None else picks.where(F.col("gw") == gw)
    rows = rows.join(standings.select("entry"), "entry", "left_semi").join(weights, "entry", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    captain, multiplier = F.col("is_captain").cast("int"), F.col("multiplier")
    sums = rows.groupBy("element").agg(
        F.count("*").alias("owners"), F.count_if(multiplier >= 1).alias("__s"), F.sum(captain).alias("__c"), F.sum(multiplier).alias("__m"),
        F.sum("weight").alias("__wo"), F.sum(F.col("weight") * (1 + captain)).alias("__we"),
        F.max(F.when(F.col("entry") == (user if user is not None else F.lit(None)), multiplier)).alias("__u"),
    )
    percent = lambda c: 100.0 * c / F.col("__n")
    return with_scalars(sums, standings.agg(F.count("*").alias("__n"))).select(
        "element", "owners", percent(F.col("owners")).alias("owned_pct"), percent(F.col("__s")).alias("start_pct"), percent(F.col("__c")).alias("captain_pct"),
        percent(F.col("owners") + F.col("__c")).alias("eo_pct"), percent(F.col("__m")).alias("mult_eo_pct"),
        (100.0 * F.col("__wo")).alias("w_owned_pct"), (100.0 * F.col("__we")).alias("w_eo_pct"),
        F.col("__u").isNotNull().alias("user_owns"), F.coalesce("__u", F.lit(0)).alias("user_mult"),
    )


def captaincy_table(standings: DataFrame, picks: DataFrame, live: DataFrame, gw: int) -> DataFrame:
    """Per captained element of a gameweek: captains, percentage of the league, points."""
    counts = picks.where((F.col("gw") == gw) & F.col("is_captain")).groupBy("element").agg(F.count("*").alias("captains"))
    points = live.where(F.col("gw") == gw).select("element", "points")
    return with_scalars(counts.join(points, "element", "left"), standings.agg(F.count("*").alias("__n"))).select(
        "element", "captains", (100.0 * F.col("captains") / F.col("__n")).alias("pct"), F.coalesce("points", F.lit(0)).alias("points")
    )


# ---------------------------------------------------------------- settlement


def effective_multipliers(picks: DataFrame, auto_subs: DataFrame, live: DataFrame | None, final: DataFrame) -> DataFrame:
    """(entry, gw, element, multiplier) as settled.

    Only in final gameweeks: substituted elements count 0 and their
    substitutes 1; then, if the captain did not play and the vice did, a
    multiple captain counts 1 and the vice takes the captain's multiplier.
    picks may carry points and minutes of their element already (with_live);
    then points are kept, and tables that lie by manager meet where they are.
    The gameweeks of final are broadcast: the calendar bounds their number.
    """
    carried = {"points", "minutes"} <= set(picks.columns)
    keys = ["entry", "gw"]
    # The few of one manager's gameweek, so that tables meet by manager and gameweek alone.
    subs = auto_subs.groupBy(*keys).agg(F.collect_set("element_out").alias("outs"), F.collect_set("element_in").alias("ins"))
    settled = (
        (picks if carried else with_live(picks, live)).join(subs, keys, "left")
        .join(F.broadcast(final.select("gw").distinct().withColumn("is_final", F.lit(True))), "gw", "left").withColumn("minutes", F.coalesce("minutes", F.lit(0)))
        .withColumn("is_final", F.coalesce("is_final", F.lit(False)))
    )
    own = W.partitionBy(*keys)
    captain_out = F.max(F.when(F.col("is_captain"), F.col("minutes") == 0)).over(own)
    vice_in = F.max(F.when(F.col("is_vice_captain"), F.col("minutes") > 0)).over(own)
    captain_mult = F.max(F.when(F.col("is_captain"), F.col("multiplier"))).over(own)
    falls = F.col("is_final") & F.coalesce(captain_out & vice_in, F.lit(False))
    among = lambda c: F.col("is_final") & F.array_contains(c, F.col("element"))
    subbed = F.when(among("ins"), 1).when(among("outs"), 0).otherwise(F.col("multiplier"))
    out = (
        F.when(falls & F.col("is_vice_captain"), captain_mult)
        .when(falls & F.col("is_captain") & (subbed > 1), 1)
        .otherwise(subbed)
    )
    return settled.select(*keys, "element", out.cast("int").alias("multiplier"), *["points"] * carried)


def with_live(picks: DataFrame, live: DataFrame) -> DataFrame:
    """picks with the points and minutes of their element, null where it has none."""
    return picks.join(live.select("gw", "element", "points", "minutes"), ["gw", "element"], "left")


def gameweek_scores(multipliers: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """(entry, gw, score) from settled multipliers, which may carry points already."""
    scored = multipliers if "points" in multipliers.columns else multipliers.join(live.select("gw", "element", "points"), ["gw", "element"], "left")
    return scored.groupBy("entry", "gw").agg(F.sum(F.col("multiplier") * F.coalesce("points", F.lit(0))).alias("score"))


def verify_totals(standings: DataFrame, scores: DataFrame, manager_gw: DataFrame) -> DataFrame:
    """(entry, total, calc, delta): standings against recomputed scores less transfer hits of scored gameweeks, which the calendar bounds."""
    hits = manager_gw.join(F.broadcast(scores.select("gw").distinct()), "gw", "left_semi").groupBy("entry").agg(F.sum("hits").alias("hits"))
    calc = scores.groupBy("entry").agg(F.sum("score").alias("score"))
    return standings.join(calc, "entry", "left").join(hits, "entry", "left").select(
        "entry", "total", (F.coalesce("score", F.lit(0)) - F.coalesce("hits", F.lit(0))).alias("calc")
    ).withColumn("delta", F.col("calc") - F.col("total"))


# ---------------------------------------------------------------- swings


def player_swings(multipliers: DataFrame, live: DataFrame | None, weights: DataFrame, standings: DataFrame, user: int) -> DataFrame:
    """(element, swing, w_swing, user_points, points): what the user gained on each element against the mean and weighted field.

    Per gameweek (user's multiplier - field's mean multiplier) * points,
    summed; one aggregation by (element, gameweek), whose rows the sum by element meets.
    multipliers may carry points already; then live is not read.
    """
    carried = "points" in multipliers.columns
    rows = multipliers.join(weights, "entry", "left")
    per_gw = rows.groupBy("element", "gw").agg(
        F.sum(F.when(F.col("entry") == user, F.col("multiplier")).otherwise(0)).alias("mine"),
        F.sum("multiplier").alias("field"), F.sum(F.col("multiplier") * F.coalesce("weight", F.lit(0.0))).alias("w_field"), *[F.max("points").alias("points")] * carried,
    )
    per_gw = (per_gw if carried else per_gw.join(live.select("element", "gw", "points"), ["element", "gw"], "left")).withColumn("points", F.coalesce("points", F.lit(0)))
    n = standings.agg(F.count("*").alias("__n"))
    return with_scalars(per_gw, n).groupBy("element").agg(
        F.sum((F.col("mine") - F.col("field") / F.col("__n")) * F.col("points")).alias("swing"),
        F.sum((F.col("mine") - F.col("w_field")) * F.col("points")).alias("w_swing"),
        F.sum(F.col("mine") * F.col("points")).alias("user_points"),
        F.max(F.col("mine") > 0).alias("ever_used"),
    )


def user_position(swings: DataFrame, ownership: DataFrame, differential: float = 33.0, liability: float = 25.0) -> DataFrame:
    """swings plus owned_pct and kind: differential (the user's, few others'), liability (others', not the user's), shared, or null."""
    rows = swings.join(ownership.select("element", "owned_pct", "user_owns"), "element", "left").withColumns({
        "owned_pct": F.coalesce("owned_pct", F.lit(0.0)), "user_owns": F.coalesce("user_owns", F.lit(False)),
    })
    kind = (
        F.when(F.col("user_owns") & (F.col("owned_pct") <= differential), "differential")
        .when(~F.col("user_owns") & (F.col("owned_pct") >= liability), "liability")
        .when(F.col("user_owns") | F.col("ever_used"), "shared")
    )
    return rows.withColumn("kind", kind)


def transfer_targets(standings: DataFrame, picks: DataFrame, user: int, gw: int, top_n: int = 10, owned_by_user: bool = False) -> DataFrame:
    """(element, group_owners, group_size): what the leaders own and the user does not (or does)."""
    leaders = standings.where(F.col("rank") <= top_n)
    rows = picks.where(F.col("gw") == gw)
    mine = rows.where(F.col("entry") == user).select("element").distinct()
    counts = rows.join(leaders.select("entry"), "entry", "left_semi").groupBy("element").agg(F.count("*").alias("group_owners"))
    kept = counts.join(mine, "element", "left_semi" if owned_by_user else "left_anti")
    return with_scalars(kept, leaders.agg(F.count("*").alias("group_size")))


# ---------------------------------------------------------------- gaps


def gap_targets(standings: DataFrame, user: int, remaining: int) -> DataFrame:
    """(label, place, total, gap, per_gw) from the user to the 1st, 5th and 10th, the median, the mean and one place up; gaps are null for a user who is not there."""
    n = standings.agg(F.count("*").alias("n"))
    # An aggregate, that a user who is absent leaves gaps empty rather than everything.
    mine = standings.where(F.col("entry") == user).agg(F.max("total").alias("mine"), F.max("rank").alias("my_rank"))
    base = with_scalars(n, mine)
    rungs = base.select("n", "mine", F.explode(F.array(
        *[F.struct(F.lit(label).alias("label"), F.lit(r).alias("place")) for r, label in ((1, "1st"), (5, "top-5"), (10, "top-10"))],
        F.struct(F.lit("one place up").alias("label"), (F.col("my_rank") - 1).cast("int").alias("place")),
    )).alias("r")).select("n", "mine", "r.label", F.least("r.place", F.col("n").cast("int")).alias("place")).where("place >= 1")
    # Ranks are counted anew, that ties in rank leave no rung empty; only the rungs' rows are looked up.
    order = F.row_number().over(W.orderBy("rank", "entry"))
    top = standings.orderBy("rank", "entry").limit(10)
    near = with_scalars(standings, mine).where(F.col("rank") < F.col("my_rank")).orderBy(F.desc("rank"), F.desc("entry")).limit(1).select(F.lit("one place up").alias("label"), "total")
    ladder = top.withColumn("place", order).select("place", F.col("total").alias("rung_total"))
    fixed = rungs.where("label <> 'one place up'").join(ladder, "place").select("label", "place", F.col("rung_total").alias("total"), "mine")
    above = rungs.where("label = 'one place up'").join(near, "label").select("label", "place", "total", "mine")
    half = quantile(standings, "total", 0.5)
    middle = mine.select(F.lit("median").alias("label"), F.lit(None).cast("int").alias("place"), F.lit(None if half is None else floor(half)).cast("long").alias("total"), "mine")
    gap = F.col("total") - F.col("mine")
    out = fixed.unionByName(above).unionByName(middle).select("label", "place", F.col("total").cast("double").alias("total"), gap.cast("double").alias("gap"), (gap / remaining).alias("per_gw"))
    mean = with_scalars(standings.agg(F.avg("total").alias("avg")), mine).select(
        F.lit("league average").alias("label"), F.lit(None).cast("int").alias("place"), F.bround("avg", 0).alias("total"),
        F.bround(F.col("avg") - F.col("mine"), 0).alias("gap"), ((F.col("avg") - F.col("mine")) / remaining).alias("per_gw"),
    )
    return out.unionByName(mean)


def squad_overlap(standings: DataFrame, picks: DataFrame, user: int, gw: int) -> DataFrame:
    """Per rival: shared squad and eleven, and dead_weight_pct, the share of the user's multipliers that the rival's cancel."""
    rows = picks.where(F.col("gw") == gw)
    mine = rows.where(F.col("entry") == user).select("element", F.col("multiplier").alias("mine"))
    size = mine.agg(F.count("*").alias("squad"), F.sum("mine").alias("mass"), F.count_if(F.col("mine") >= 1).alias("xi"))
    met = rows.where(F.col("entry") != user).join(mine, "element").groupBy("entry").agg(
        F.count("*").alias("shared_squad"), F.count_if((F.col("mine") >= 1) & (F.col("multiplier") >= 1)).alias("shared_xi"), F.sum(F.least("mine", "multiplier")).alias("dead")
    )
    rivals = standings.where(F.col("entry") != user).select("entry", "rank", "total")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return with_scalars(rivals.join(met, "entry", "left"), size).select(
        "entry", "rank", "total", zero("shared_squad").alias("shared_squad"), zero("shared_xi").alias("shared_xi"),
        (100.0 * zero("shared_squad") / F.greatest(F.lit(1), F.col("squad"))).alias("shared_pct"),
        F.coalesce(F.try_divide(100.0 * zero("dead"), F.col("mass")), F.lit(0.0)).alias("dead_weight_pct"), (F.col("xi") - zero("shared_xi")).alias("live_edge"),
    )


def noise_scale(manager_gw: DataFrame, remaining: int) -> DataFrame:
    """One row: spread of a gameweek's scores (mean of the variances within gameweeks), of a difference of two, and of that over the rest."""
    within = manager_gw.groupBy("gw").agg(F.var_pop("points").alias("v"), F.count("*").alias("n")).where("n > 1")
    sd = F.coalesce(F.sqrt(F.avg("v")), F.lit(0.0))
    return within.agg(sd.alias("sd_gw_score")).withColumn("sd_gw_diff", F.col("sd_gw_score") * F.sqrt(F.lit(2.0))).withColumn(
        "sd_rest_diff", F.col("sd_gw_diff") * F.sqrt(F.lit(float(remaining)))
    )


def win_context(standings: DataFrame, manager_gw: DataFrame, user: int, remaining: int = 36) -> DataFrame:
    """noise_scale() plus the user's gaps to the 1st, 5th and 10th in such deviations."""
    gaps = gap_targets(standings, user, remaining).where(F.col("label").isin("1st", "top-5", "top-10"))
    one = gaps.agg(*[F.max(F.when(F.col("label") == label, F.col("gap"))).alias(name) for label, name in (("1st", "g1"), ("top-5", "g5"), ("top-10", "g10"))])
    sized = with_scalars(noise_scale(manager_gw, remaining), one)
    in_sd = lambda g: F.coalesce(F.try_divide(F.col(g), F.col("sd_rest_diff")), F.lit(0.0))
    return sized.select("sd_gw_score", "sd_gw_diff", "sd_rest_diff", in_sd("g1").alias("first_in_sd"), in_sd("g5").alias("fifth_in_sd"), in_sd("g10").alias("tenth_in_sd"))


def catchup_plan(standings: DataFrame, user: int, played: int, remaining: int = 36) -> DataFrame:
    """One row: points a gameweek of the user, league and leader, and those needed on top of the leader's."""
    facts = standings.agg(F.avg("total").alias("avg"), F.max("total").alias("lead"))
    mine = standings.where(F.col("entry") == user).agg(F.max("total").alias("mine"))
    both = with_scalars(facts, mine)
    return both.select(
        (F.col("mine") / played).alias("user_ppg"), (F.col("avg") / played).alias("league_ppg"), (F.col("lead") / played).alias("leader_ppg"),
        (F.col("lead") / played + (F.col("lead") - F.col("mine")) / remaining).alias("required_ppg"), ((F.col("lead") - F.col("mine")) / remaining).alias("required_edge"),
    )


# ---------------------------------------------------------------- profiles

#: Chips of a season, each of which may be played twice.
CHIPS = ("wildcard", "freehit", "bboost", "3xc")
CHIPS_OF_A_KIND = 2


def chips_left(entries: DataFrame, chips: DataFrame) -> DataFrame:
    """(entry, chip, left)."""
    used = chips.groupBy("entry", F.col("name").alias("chip")).agg(F.count("*").alias("used"))
    every = entries.select("entry", F.explode(F.array(*map(F.lit, CHIPS))).alias("chip"))
    return every.join(used, ["entry", "chip"], "left").select("entry", "chip", F.greatest(F.lit(0), F.lit(CHIPS_OF_A_KIND) - F.coalesce("used", F.lit(0))).cast("int").alias("left"))


def template_scores(standings: DataFrame, picks: DataFrame, gw: int) -> DataFrame:
    """(entry, template_score, template_z, style): mean ownership of a manager's squad among the others, against the league's.

    The owners of an element are counted once and joined back, rather than
    windowed, so that an element that everyone owns is met in a join that AQE can split.
    """
    rows = picks.where(F.col("gw") == gw)
    owners = rows.groupBy("element").agg(F.count("*").alias("owners"))
    n = standings.agg(F.count("*").alias("__n"))
    others = with_scalars(rows.join(owners, "element"), n).withColumn("pct", 100.0 * (F.col("owners") - 1) / F.greatest(F.lit(1), F.col("__n") - 1))
    score = standings.select("entry").join(others.groupBy("entry").agg(F.avg("pct").alias("s")), "entry", "left").select("entry", F.coalesce("s", F.lit(0.0)).alias("template_score"))
    facts = score.agg(F.avg("template_score").alias("__mu"), F.stddev_pop("template_score").alias("__sd"))
    z = (F.col("template_score") - F.col("__mu")) / F.when(F.col("__sd") > 0, F.col("__sd")).otherwise(1.0)
    style = F.when(F.col("template_z") >= 0.75, "template").when(F.col("template_z") <= -0.75, "differential").otherwise("balanced")
    return with_scalars(score, facts).withColumn("template_z", z).withColumn("style", style).select("entry", "template_score", "template_z", "style")


def profiles(standings: DataFrame, picks: DataFrame, manager_gw: DataFrame, transfers: DataFrame, chips: DataFrame, weights: DataFrame, user: int, gw: int) -> DataFrame:
    """One row per manager: squad, form, hits, style, overlap with the user and threat."""
    mine = picks.where((F.col("gw") == gw) & (F.col("entry") == user)).select("element").distinct()
    rows = picks.where(F.col("gw") == gw).join(mine.withColumn("__m", F.lit(1)), "element", "left")
    squad = rows.groupBy("entry").agg(
        F.sort_array(F.collect_list("element")).alias("squad"), F.count_if(F.col("multiplier") >= 1).alias("starters"), F.count("__m").alias("overlap_with_user"),
        F.max(F.when(F.col("is_captain"), F.col("element"))).alias("captain"), F.max(F.when(F.col("is_vice_captain"), F.col("element"))).alias("vice"),
    )
    form = manager_gw.groupBy("entry").agg(
        F.max("points").alias("best_gw"), F.min("points").alias("worst_gw"), F.stddev_pop("points").alias("consistency"), F.sum("hits").alias("hits_taken"),
        F.sum("points_on_bench").alias("points_on_bench"), F.max_by((F.col("value") + F.col("bank")) / 10, "gw").alias("team_value"), F.max_by(F.col("bank") / 10, "gw").alias("bank"),
    )
    moves = transfers.groupBy("entry").agg(F.count("*").alias("n_transfers"))
    left = chips_left(standings, chips).groupBy("entry").agg(F.sort_array(F.collect_list(F.when(F.col("left") > 0, F.col("chip")))).alias("chips_left"))
    total = standings.where(F.col("entry") == user).agg(F.max("total").alias("__mine"))
    out = standings
    for part in (squad, form, moves, left, template_scores(standings, picks, gw), weights.withColumnRenamed("weight", "threat_weight")):
        out = out.join(part, "entry", "left")
    out = with_scalars(out, total).withColumn("gap_to_user", F.col("total") - F.col("__mine")).drop("__mine")
    return out.na.fill(0, ["starters", "overlap_with_user", "best_gw", "worst_gw", "hits_taken", "points_on_bench", "n_transfers"]).na.fill(0.0, ["consistency", "threat_weight", "team_value", "bank"])


def style_summary(profile: DataFrame) -> DataFrame:
    return profile.groupBy("style").agg(F.count("*").alias("managers"))


def squad_lines(standings: DataFrame, picks: DataFrame, players: DataFrame, live: DataFrame, gw: int) -> DataFrame:
    """(entry, place, line): each squad's listing, starters first, then by position and season points."""
    season = live.groupBy("element").agg(F.sum("points").alias("points"))
    order = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in ("GKP", "DEF", "MID", "FWD")]), F.col("position")), F.lit(9))
    rows = picks.where(F.col("gw") == gw).join(standings.select("entry"), "entry", "left_semi").join(players, "element").join(season, "element", "left")
    tag = F.when(F.col("is_captain"), "(C)").when(F.col("is_vice_captain"), "(V)").otherwise("")
    bench, points = F.col("multiplier") < 1, F.coalesce("points", F.lit(0))
    place = F.row_number().over(W.partitionBy("entry").orderBy(bench, order, F.desc(points), F.concat("name", tag)))
    text = F.format_string("%s%s %-20s %-4s %3dpts", F.when(bench, "BENCH ").otherwise("      "), "position", F.concat("name", tag), "team", points)
    return rows.select("entry", place.alias("place"), text.alias("line"))


def transfer_log(transfers: DataFrame, players: DataFrame) -> DataFrame:
    """(entry, gw, line), a line per transfer."""
    names = players.select("element", "name")
    named = lambda c: F.coalesce(F.col(f"{c}_name"), F.concat(F.lit("#"), F.col(c).cast("string")))
    rows = transfers
    for c in ("element_out", "element_in"):
        rows = rows.join(names.select(F.col("element").alias(c), F.col("name").alias(f"{c}_name")), c, "left")
    return rows.select("entry", "gw", F.format_string("GW%d: %s -> %s", "gw", named("element_out"), named("element_in")).alias("line"))
