"""Manager state: selling prices, banked transfers, purchase prices, chips and objectives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .skyline import skyline

#: Transfers that may be banked at most, and the squad's shape by position 1 to 4.
MOST_FREE = 5
SQUAD = {1: 2, 2: 5, 3: 5, 4: 3}
CLUB_LIMIT = 3
#: Other names of the chips.
CHIP_ALIASES = {"wildcard": "wildcard", "freehit": "freehit", "bboost": "bboost", "3xc": "3xc", "triple_captain": "3xc", "bench_boost": "bboost", "free_hit": "freehit"}
#: Chips whose week uses up no banked transfers.
UNLIMITED = ("wildcard", "freehit")


def selling_price(bought: Column, now: Column) -> Column:
    """A loss is borne in full; of a gain half, rounded down, is kept. Tenths."""
    return F.when(now <= bought, now).otherwise(bought + F.floor((now - bought) / 2)).cast("int")


def free_transfers(weeks: DataFrame, key: str = "entry") -> DataFrame:
    """(key, free): transfers banked after the weeks (key, gw, made, chip) in order.

    A fold over each manager's at most 38 weeks: the first sets 1, a week of an
    unlimited chip leaves the bank as it is, another spends and adds one, up to MOST_FREE.
    """
    ordered = F.array_sort(F.collect_list(F.struct("gw", F.col("made").cast("int").alias("made"), F.coalesce(F.col("chip").isin(*UNLIMITED), F.lit(False)).alias("keeps"))))
    after = F.aggregate(
        F.slice(F.col("w"), F.lit(2), F.greatest(F.size("w"), F.lit(1))), F.lit(1),
        lambda free, w: F.when(w["keeps"], free).otherwise(F.least(F.lit(MOST_FREE), free - F.least(w["made"], free) + 1)),
    )
    return weeks.groupBy(key).agg(ordered.alias("w")).select(key, after.alias("free"))


def purchase_prices(holdings: DataFrame, transfers: DataFrame, prices: DataFrame) -> DataFrame:
    """holdings(entry, element) plus bought: the price of the latest transfer in, else the price at the season's start."""
    latest = transfers.groupBy("entry", F.col("element_in").alias("element")).agg(F.max_by("element_in_cost", F.struct("time", "element_in_cost")).alias("paid"))
    start = prices.select("element", "now_cost", (F.col("now_cost") - F.coalesce("cost_change_start", F.lit(0))).alias("started"))
    return holdings.join(latest, ["entry", "element"], "left").join(start, "element", "left").select("entry", "element", "now_cost", F.coalesce("paid", "started").alias("bought"))


def latest_before(events: DataFrame, at: DataFrame, keys: list[str], time: str, as_of: str, value: str, *, bucket: str = "month") -> DataFrame:
    """As-of join: for each row of at(keys, as_of), the value of the latest event up to it, null without one.

    Events and questions are put in one order of time and the last value is carried on, within
    buckets of time; what a bucket begins with is the last of the buckets before. A key that
    holds a third of all events is thus dealt to as many tasks as it has buckets, and no pair of event and question is formed.
    """
    known = events.where(F.col(time).isNotNull()).select(*keys, F.col(time).alias("__t"), F.struct(F.col(value).alias("v")).alias("__v"), F.lit(0).alias("__asks"))
    asked = at.select(*keys, F.col(as_of).alias("__t"), F.lit(None).cast(known.schema["__v"].dataType).alias("__v"), F.lit(1).alias("__asks"))
    rows = known.unionByName(asked).withColumn("__b", F.date_trunc(bucket, "__t"))
    whole = rows.groupBy(*keys, "__b").agg(F.max_by("__v", F.when(F.col("__asks") == 0, F.struct("__t", "__v"))).alias("__last"))
    earlier = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    carried = whole.select(*keys, "__b", F.last("__last", True).over(earlier).alias("__before"))
    inside = W.partitionBy(*keys, "__b").orderBy("__t", "__asks", "__v").rowsBetween(W.unboundedPreceding, 0)
    found = rows.withColumn("__own", F.last("__v", True).over(inside)).where("__asks = 1").join(carried, [*keys, "__b"], "left")
    return found.select(*keys, F.col("__t").alias(as_of), F.coalesce("__own", "__before")["v"].alias(value))


def chip_name(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CHIP_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(name)), F.lower(name))


def squad_faults(holdings: DataFrame, managers: DataFrame) -> DataFrame:
    """(entry, faults): what is wrong with squads(entry, element, position, team) and managers(entry, bank, free)."""
    by_club = holdings.groupBy("entry", "team").agg(F.count("*").alias("n")).groupBy("entry").agg(F.max("n").alias("club"))
    sizes = holdings.groupBy("entry").agg(
        F.count("*").alias("n"), F.count_distinct("element").alias("d"), *[F.count_if(F.col("position") == p).alias(f"pos{p}") for p in SQUAD]
    ).join(by_club, "entry")
    rows = managers.join(sizes, "entry", "left")
    tests = [
        (F.coalesce("n", F.lit(0)) != sum(SQUAD.values()), "size"), (F.col("n") != F.col("d"), "repeated"), (F.col("club") > CLUB_LIMIT, "club"),
        *[(F.coalesce(f"pos{p}", F.lit(0)) != k, f"position {p}") for p, k in SQUAD.items()], (~F.col("free").between(1, MOST_FREE), "free transfers"), (F.col("bank") < 0, "bank"),
    ]
    return rows.select("entry", F.array_compact(F.array(*[F.when(t, F.lit(name)) for t, name in tests])).alias("faults"))


# ---------------------------------------------------------------- objectives


def urgency(points_behind: float, remaining: int) -> float:
    """Points to make up in each remaining gameweek."""
    if remaining <= 0:
        return float("inf") if points_behind > 0 else 0.0
    return points_behind / remaining


def recommended_lambda(points_behind: float, remaining: int, base: float = 0.15, scale: float = 0.08) -> float:
    """Risk appetite: base, plus scale for each point behind a gameweek, at most 1 more."""
    return base if points_behind <= 0 else min(base + scale * urgency(points_behind, remaining), base + 1.0)


def urgency_of(behind: Column, remaining: Column) -> Column:
    """urgency() of columns."""
    return F.when(remaining > 0, behind / F.nullif(remaining, F.lit(0))).when(behind > 0, float("inf")).otherwise(0.0)


def appetite_of(behind: Column, remaining: Column, base: float = 0.15, scale: float = 0.08) -> Column:
    """recommended_lambda() of columns."""
    return F.when(behind <= 0, base).otherwise(F.least(base + scale * urgency_of(behind, remaining), F.lit(base + 1.0)))


def plain_objective(projections: DataFrame, out: str = "objective_score") -> DataFrame:
    return projections.withColumn(out, F.col("ep"))


def best(projections: DataFrame, n: int, by: str, keys: list[str]) -> DataFrame:
    """The n rows of each key with the greatest value of a column, ties to the smaller player_id."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(by), "player_id"))
    return projections.withColumn("__r", place).where(F.col("__r") <= n).drop("__r")


def rank_utility(projections: DataFrame, ownership: DataFrame, lam: float, out: str = "objective_score") -> DataFrame:
    """projections plus ep + lam (1 - EO) sd; ownership(player_id, eo), absent 0, held in [0, 1]."""
    if lam < 0:
        raise ValueError("lam must not be negative")
    if missing := {"ep", "sd"} - set(projections.columns):
        raise ValueError(f"projections lack {sorted(missing)}")
    eo = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("__eo", F.lit(0.0))))
    joined = projections.join(ownership.select("player_id", F.col("eo").cast("double").alias("__eo")), "player_id", "left")
    return joined.withColumn(out, F.col("ep") + lam * (1.0 - eo) * F.col("sd")).drop("__eo")


def plan_points(plan: DataFrame, projections: DataFrame, hits: DataFrame | None = None, cost: float = 4.0) -> DataFrame:
    """One row (ep): starters and captain again of plan(gw, player_id, starts, captain), less cost for each of hits(gw, hits)."""
    rows = plan.join(projections.select("gw", "player_id", "ep"), ["gw", "player_id"], "left")
    gained = rows.agg(F.coalesce(F.sum((F.col("starts").cast("int") + F.col("captain").cast("int")) * F.coalesce("ep", F.lit(0.0))), F.lit(0.0)).alias("ep"))
    if hits is None:
        return gained
    taken = hits.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("__hits"))
    return gained.crossJoin(F.broadcast(taken)).select((F.col("ep") - cost * F.col("__hits")).alias("ep"))


def manager_state(bootstrap: DataFrame, history: DataFrame, picks: DataFrame, transfers: DataFrame) -> DataFrame:
    """One row per manager (entry, as_of_gw, bank, free, chips, squad) from landed documents.

    bootstrap: elements; history: entry, current, chips; picks: entry, gw, picks; transfers: entry,
    element_in, element_in_cost, time. The squad is that of the last gameweek played, each player
    with position, team, price paid (the latest transfer in, else the season's first price), price now and armband;
    free is replayed from the transfers made. ValueError for a manager without a gameweek.
    """
    if not history.where("current is null or size(current) = 0").isEmpty():
        raise ValueError("a manager has no gameweek yet")
    weeks = history.select("entry", F.explode("current").alias("c"))
    chips = history.select("entry", F.explode("chips").alias("c")).select("entry", F.col("c.event").alias("gw"), chip_name(F.col("c.name")).alias("chip"))
    made = weeks.select("entry", F.col("c.event").alias("gw"), F.col("c.event_transfers").alias("made")).join(chips, ["entry", "gw"], "left")
    last = weeks.groupBy("entry").agg(F.max("c.event").alias("as_of_gw"), F.max_by("c.bank", "c.event").alias("bank"))
    own = picks.join(last, (picks["entry"] == last["entry"]) & (F.col("gw") == F.col("as_of_gw"))).select(picks["entry"], F.explode("picks").alias("p"))
    held = own.select("entry", "p.element", F.col("p.position").alias("slot"), "p.multiplier", "p.is_captain", "p.is_vice_captain")
    elements = bootstrap.select(F.explode("elements").alias("e")).select("e.*")
    paid = purchase_prices(held, transfers, elements.withColumnRenamed("id", "element"))
    facts = elements.select(F.col("id").alias("element"), F.col("element_type").alias("position"), "team")
    player = F.struct("slot", "element", "position", "team", "bought", "now_cost", selling_price(F.col("bought"), F.col("now_cost")).alias("selling"), "multiplier", "is_captain", "is_vice_captain")
    squads = held.join(paid, ["entry", "element"]).join(facts, "element").groupBy("entry").agg(F.array_sort(F.collect_list(player)).alias("squad"))
    used = chips.groupBy("entry").agg(F.array_sort(F.collect_list("chip")).alias("played"))
    still = lambda c: F.greatest(F.lit(0), F.lit(2) - F.size(F.filter("played", lambda x: x == c)))
    left = F.array(*[F.struct(F.lit(c).alias("chip"), still(c).alias("left")) for c in ("wildcard", "freehit", "bboost", "3xc")])
    return (
        last.join(free_transfers(made), "entry").join(squads, "entry").join(used, "entry", "left").withColumn("played", F.coalesce("played", F.array().cast("array<string>")))
        .select("entry", "as_of_gw", "bank", "free", left.alias("chips"), "squad")
    )


# ---------------------------------------------------------------- candidates


def discounts(gws: DataFrame, gamma: float) -> DataFrame:
    """(gw, factor): gamma to the power of the gameweek's place."""
    return gws.select("gw").distinct().withColumn("factor", F.pow(F.lit(float(gamma)), F.row_number().over(W.orderBy("gw")) - 1))


def candidate_pool(projections: DataFrame, per_position: int, owned: DataFrame | None = None, *, weeks: list[int] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, player_id, position, price, total, eps): players worth considering, and the owned, of each value of the columns `by`.

    A player goes if another of the position costs no more and is
    expected no less in every week, and is strictly better in one of these: the
    rest is the skyline of low price and high expectations. Of it the per_position best by
    total stay. Price is the first week's; a week without a row counts 0, several rows of a week are averaged.
    """
    weeks = weeks or sorted(r["gw"] for r in projections.select("gw").distinct().collect())
    by_week = F.array(*[F.coalesce(F.avg(F.when(F.col("gw") == g, F.col("ep"))), F.lit(0.0)) for g in weeks])
    rows = projections.groupBy(*by, "player_id").agg(
        F.first("position").alias("position"), F.min_by("price", "gw").alias("price"), by_week.alias("eps"), F.sum("ep").alias("total")
    )
    ids = [*by, "player_id"]
    unbeaten = skyline(rows, [*by, "position"], [-F.col("price"), *[F.col("eps")[k] for k in range(len(weeks))]], ids)
    best = rows.join(unbeaten, ids, "left_semi").withColumn("__r", F.row_number().over(W.partitionBy(*by, "position").orderBy(F.desc("total"), "player_id")))
    kept = best.where(F.col("__r") <= per_position).drop("__r")
    if owned is None:
        return kept
    return kept.unionByName(rows.join(owned.select("player_id").distinct(), "player_id", "left_semi").join(kept.select(*ids), ids, "left_anti"))


def planning_pool(projections: DataFrame, *, weeks: list[int]) -> DataFrame:
    """(player_id): every player that a plan over the weeks may need, however many there are; projections have position, team, price and ep.

    Of one club, at most min(CLUB_LIMIT, a position's places) players of a position are in a squad at a time, so a plan that
    buys one holds fewer than that beside it in a week: `others` at most in all weeks. If more than these cost no
    more and are expected no less in every week (ties to the smaller player_id), one of them is free to be bought instead, at no
    loss: club, position, money and transfers stay as good. So players whom more than `others` beat can go, and
    the best plan, with any transfers and chips, is kept. Who is owned has to be added. Several rows of a week add up, a week without a row counts 0.
    """
    others = (min(CLUB_LIMIT, max(SQUAD.values())) - 1) * len(weeks)
    by_week = F.array(*[F.coalesce(F.sum(F.when(F.col("gw") == g, F.col("ep"))), F.lit(0.0)) for g in weeks])
    rows = projections.where(F.col("gw").isin(*weeks)).groupBy("player_id").agg(
        F.min_by("position", "gw").alias("position"), F.min_by("team", "gw").alias("team"), F.min_by("price", "gw").alias("price"), by_week.alias("eps")
    )
    return skyline(rows, ["team", "position"], [-F.col("price"), *[F.col("eps")[k] for k in range(len(weeks))]], ["player_id"], most=others + 1, tie=-F.col("player_id"))


def ep_gap(projections: DataFrame, player_in: int, player_out: int) -> DataFrame:
    """Per gameweek what a transfer is expected to add."""
    of = lambda p: F.coalesce(F.max(F.when(F.col("player_id") == p, F.col("ep"))), F.lit(0.0))
    return projections.groupBy("gw").agg((of(player_in) - of(player_out)).alias("gain")).orderBy("gw")
